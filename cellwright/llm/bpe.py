"""Byte-level BPE with the tiktoken library and a local rank file: texts to ids, ids to bytes.

``encode`` adds the ids of every whole text.  A long text is cut where a match of the splitting
pattern ends whatever stands around it, and the parts are encoded one by one, so the library never
gets more than about ``CHUNK`` characters: its pattern matcher overflows its stack on white
space of some hundred thousand characters.  Safe places are between a visible character and white
space, and between a letter or digit and punctuation; a long run of white space is one match
but for its last character, which belongs to what follows, and is merged as a single piece.

``decode`` gives the bytes of each row's ids, looked up batch by batch.  Bytes, not text: ids
cut anywhere need not end at a character.

Both are Arrow maps over the rows as they are partitioned, without a shuffle.

Defined results: a null text is an empty one and has no ids; null ids have no bytes; a row with an
id that is no rank has null bytes; very long texts are encoded whole; repeated rows are encoded one
by one; an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

CHUNK = 65_536
#: Bytes of texts, or ids, that a task holds as Python objects at once, unless one row alone has more.
PORTION = 1 << 20
#: The white space of the pattern, letters that every Unicode version has, and marks.
WHITE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LETTERS = "0-9A-Za-z\xc0-\xd6\xd8-\xf6Α-Ρα-ωА-яء-غअ-हぁ-ゖァ-ヺ一-龥가-힣"
MARKS = "!-/:-@\\[-`{-~、。！，"
SAFE = re.compile(rf"(?<=[^{WHITE}])(?=[ \t\r\n])|(?<=[{LETTERS}])(?=[{MARKS}])")
LONG_WHITE = re.compile(rf"[{WHITE}]{{{CHUNK // 4},}}")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_of_character() -> dict[str, int]:
    """The alphabet that byte-level vocabularies are written in: visible bytes stand for themselves, the others come after U+00FF."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


@cache
def ranks_of(vocabulary: str) -> dict[bytes, int]:
    """Token bytes to ids, of a rank file or of a byte-level BPE file in JSON.

    The JSON's merges have to make the tokens in the order of their ids, as ranks do.
    """
    if not vocabulary.endswith(".json"):
        with open(vocabulary, "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(vocabulary, encoding="utf-8") as file:
        model = json.load(file)["model"]
    byte = byte_of_character()
    merged = [m if isinstance(m, str) else "".join(m) for m in model["merges"]]
    ids = [model["vocab"][m.replace(" ", "")] for m in merged]
    if ids != sorted(ids):
        raise ValueError(f"the merges of {vocabulary} are not in the order of their ids")
    return {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}


@cache
def encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(vocabulary), special_tokens={})


@cache
def byte_lengths(vocabulary: str) -> np.ndarray:
    """Bytes of each id; -1 where no token has the id."""
    ranks = ranks_of(vocabulary)
    lengths = np.full(max(ranks.values()) + 1, -1, np.int64)
    lengths[list(ranks.values())] = [len(token) for token in ranks]
    return lengths


def safe_parts(text: str, size: int = CHUNK) -> Iterator[tuple[str, bool]]:
    """The text in parts that may be encoded one by one, and whether a part is one piece to merge."""
    if len(text) <= size:
        yield text, False
        return
    at = 0
    for run in [*LONG_WHITE.finditer(text), None]:
        stop = run.start() if run else len(text)
        while at < stop:
            place = SAFE.search(text, at + size, stop) if stop - at > size else None
            cut = place.start() if place else stop
            yield text[at:cut], False
            at = cut
        if run:
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[stop:at], True


def text_ids(text: str | None, vocabulary: str, size: int = CHUNK) -> list[int]:
    """Ids of a whole text, without special tokens."""
    if not text:
        return []
    coder = encoder(vocabulary)
    if len(text) <= size:
        return coder.encode_ordinary(text)
    ids: list[int] = []
    for part, single in safe_parts(text, size):
        ids += coder._encode_single_piece(part) if single else coder.encode_ordinary(part)
    return ids


def portions(batch: pa.RecordBatch, column: str, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose texts or lists of one column sum up to about ``most``; a longer one has its own."""
    values = batch.column(column)
    sizes = (pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length)(values).fill_null(0).to_numpy()
    part = np.cumsum(sizes, dtype=np.int64) // most
    edges = np.flatnonzero(np.diff(part, prepend=-1))
    for start, stop in zip(edges, [*edges[1:], len(part)], strict=True):
        yield batch.slice(start, stop - start)


def list_column(ids: list[np.ndarray]) -> pa.ListArray:
    """An Arrow list column of rows of ids."""
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(row) for row in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The rows with their ids in one more column."""
    vocabulary = vocabulary or default_ranks()
    schema = df.drop(ids).withColumn(ids, F.lit(None).cast(ArrayType(IntegerType(), False))).schema
    frame = df.drop(ids).withColumn(ids, F.col(text).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, ids):
                column = list_column([np.array(text_ids(t.as_py(), vocabulary), np.int32) for t in batch.column(ids)])
                yield batch.set_column(batch.num_columns - 1, ids, column)

    return frame.mapInArrow(run, schema)


def bytes_column(ids: pa.ListArray, vocabulary: str) -> pa.Array:
    """The bytes of each row of ids; null where one is no id."""
    lengths, values = byte_lengths(vocabulary), ids.flatten()
    known = values.is_valid().to_numpy(zero_copy_only=False)
    values = values.fill_null(-1).to_numpy()
    known &= (values >= 0) & (values < len(lengths))
    known[known] = lengths[values[known]] >= 0
    sizes = ids.value_lengths().fill_null(0).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.zeros(len(sizes), bool)
    bad[row[~known]] = True
    kept = values[~bad[row]]
    data = encoder(vocabulary).decode_bytes(kept.tolist())
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(np.bincount(row[~bad[row]], weights=lengths[kept], minlength=len(sizes)).astype(np.int64), out=ends[1:])
    return pa.array([None if bad[i] else data[ends[i] : ends[i + 1]] for i in range(len(sizes))], pa.binary())


def decode(df: DataFrame, ids: str = "ids", data: str = "data", vocabulary: str | None = None) -> DataFrame:
    """The rows with the bytes of their ids in one more column."""
    vocabulary = vocabulary or default_ranks()
    schema = df.drop(data).withColumn(data, F.lit(None).cast(BinaryType())).schema
    frame = df.drop(data).withColumn(data, F.lit(None).cast(BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, ids):
                yield batch.set_column(batch.num_columns - 1, data, bytes_column(batch.column(ids), vocabulary))

    return frame.mapInArrow(run, schema)


def coding_digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """For each document the number and the SHA-256 of its ids, and the SHA-256 of the bytes they decode to."""
    coded = decode(encode(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), vocabulary=vocabulary).drop("text"), vocabulary=vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
