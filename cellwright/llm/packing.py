"""Vector best-fit packing of tokenized documents into sequences.

A document is its token ids and an end id.  Documents longer than a sequence are cut into
full pieces with a shorter one first.  Pieces are packed by vector best fit, largest first: a
sequence has a residual of tokens, of documents and of attention cost (squared piece
lengths); among the open sequences that hold a piece under every constraint the one of
smallest weighted residual norm after placing it (``rule="norm"``), or of largest weighted
dot product of residual and demand (``rule="dot"``), is chosen.

A sequence may be held to at most ``documents`` pieces and ``attention`` summed squares.  Without
limits of a caller's own their capacities are those that the tokens allow, one piece a token
and the square of the size: the fewest sequences are wanted, so neither may close a sequence
that has tokens left.  Both still decide, through ``WEIGHTS``, which of the sequences that are about
equally full takes a piece.

Tokenizing streams over the documents and keeps only each piece's length and checksum.
Packing works on blocks of about ``BLOCK`` pieces dealt out by a hash, so no task grows with
the input; a block leaves a sequence or two partly filled, some hundredths of a percent.

Defined results: null text is empty, and an empty document is its end id alone; very long texts
are cut, no id is lost; repeated rows and ties are packed one by one; rows without doc_id keep a
null id; columns other than doc_id and text are not looked at; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.bpe import ranks_of
from cellwright.llm.common import shared_checkpoint

SEQUENCE = 2048
BLOCK = 8192
END_ID = 0
#: Of the residual tokens, documents and attention cost, each as a share of its capacity.
WEIGHTS = (1.0, 0.25, 0.25)
#: Fixed value: the one special token of the vocabulary and its id.
SPECIAL = {"<|endoftext|>": 50256}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def encoder(vocabulary: str):
    """Byte-level BPE of a vocabulary in JSON or of a rank file, with its special token."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("cellwright", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(vocabulary), special_tokens=SPECIAL)


def token_ids(text: str | None, vocabulary: str) -> np.ndarray:
    """Ids of a whole text, the end id last."""
    ids = encoder(vocabulary).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids.astype("<u4"), np.uint32(END_ID))


def cut(length: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first may be shorter."""
    first = length % size
    starts = ([0] if first else []) + list(range(first, length, size))
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], length], strict=True)]


def pieces(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = token_ids(text, vocabulary)
                for n, (start, length) in enumerate(cut(len(ids), size)):
                    rows.append((doc_id, n, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, PIECES)


def best_fit(
    lengths: np.ndarray,
    size: int = SEQUENCE,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, for pieces no longer than ``size``."""
    capacity = np.array([size, documents or size, attention or size * size], float)
    left = np.empty((len(lengths) + 1, 3))
    number = np.empty(len(lengths) + 1, np.int64)
    opened = used = 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    scale = np.sqrt(np.array(weights)) / capacity
    for at in np.argsort(-lengths, kind="stable"):
        demand = np.array([lengths[at], 1, float(lengths[at]) ** 2])
        after = left[:opened] - demand
        fits = np.flatnonzero((after >= 0).all(1))
        if len(fits):
            if rule == "norm":
                score = ((after[fits] * scale) ** 2).sum(1)
                place = fits[np.argmin(score)]
            else:
                score = ((left[fits] * scale) * (demand * scale)).sum(1)
                place = fits[np.argmax(score)]
        else:
            place, left[opened], number[opened] = opened, capacity, used
            opened, used = opened + 1, used + 1
        sequence[at], offset[at] = number[place], int(size - left[place, 0])
        left[place] -= demand
        if left[place].min() <= 0:  # nothing more goes in: the last open one takes its place
            opened -= 1
            left[place], number[place] = left[opened], number[opened]
    return sequence, offset


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    size: int = SEQUENCE,
    documents: int | None = None,
    attention: int | None = None,
    rule: str = "norm",
) -> DataFrame:
    """Place every piece of every document in a sequence.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset.
    """
    cut_up = shared_checkpoint(pieces(docs, vocabulary, size))
    blocks = max(1, -(-cut_up.count() // BLOCK))
    dealt = cut_up.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(blocks)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start"], kind="stable")
        sequence, offset = best_fit(rows["length"].to_numpy(np.int64), size, documents, attention, rule=rule)
        return rows.assign(sequence_id=(rows["block"].to_numpy(np.int64) << 32) | sequence, offset=offset).drop(columns="block")

    return dealt.groupBy("block").applyInPandas(place, f"{PIECES}, sequence_id long, offset long")
