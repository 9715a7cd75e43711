"""Alignment of two tokenizers over the same bytes: shared boundaries, overlap links, and id pairs counted corpus-wide.

A is byte-level BPE of space+text, B a piece model of the text, which adds that space itself.
Each token ends at a byte offset.  The shorter of the two end lists drives a galloping search
(exponential, then binary) into the longer: an end found there is a common boundary, the common
boundaries cut the tokens into groups, and the difference of two ranks in a row is the range of
longer tokens that a shorter one overlaps.  Searches start at the place of an end a few before,
all ends of a level at once as arrays.

The corpus is tokenized once.  Documents are kept as ids in blocks of about ``BLOCK_TOKENS``
tokens, in a table of the shared folder bucketed by block.  A block's links are counted by id pair
before they leave the task; the counts of all blocks are summed, and the sums go back to the
blocks that hold the pair: one row per block and pair, never one per link, so a pair that every
document holds has a row per block.  Ids do not shuffle, as the buckets already place them.
The counts of a B id are at most one for each A id, whatever the corpus.

Defined results: texts that are null, empty, or whose A or B bytes joined differ from space+text
have no tokens, links or groups; very long texts are aligned whole; repeated rows count and are
returned one by one; a row without doc_id keeps a null id; ties for the highest count are all
best; an empty table gives an empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.llm.bpe import byte_lengths, list_column, portions, text_ids
from cellwright.llm.common import partitions_for, shared_folder

BLOCK_TOKENS = 2_000_000
#: Ends that share a starting place on each level of the search.
STRIDE = 8
TOKENS = "block long, row int, doc_id long, a_ids array<int>, b_ids array<int>"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@cache
def piece_model(vocabulary: str):
    """The piece model and the bytes of each of its ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


@cache
def piece_lengths(vocabulary: str) -> np.ndarray:
    return np.array([len(b) for b in piece_model(vocabulary)[1]], np.int64)


# The alignment itself, over arrays


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """How many ends of ``long`` are below each end of ``short``; both ascend, the last of ``long`` is not below any."""
    if len(short) <= STRIDE:
        low = np.zeros(len(short), np.int64)
    else:
        low = np.repeat(gallop(short[::STRIDE], long), STRIDE)[: len(short)]
    high = low.copy()
    active, step = np.flatnonzero(long[low] < short), 1
    while len(active):  # step on twice as far until the end is reached
        probe = np.minimum(low[active] + step, len(long) - 1)
        beyond = long[probe] >= short[active]
        done, active = active[beyond], active[~beyond]
        low[done], high[done], low[active] = low[done] + 1, probe[beyond], probe[~beyond]
        step *= 2
    active = np.flatnonzero(low < high)
    while len(active):  # halve what lies between
        middle = (low[active] + high[active]) // 2
        below = long[middle] < short[active]
        low[active[below]], high[active[~below]] = middle[below] + 1, middle[~below]
        active = active[low[active] < high[active]]
    return high


class Alignment(NamedTuple):
    """Of tokens in a row: ends of groups on both sides, and of each driving token the first and the last it overlaps."""

    a_cuts: np.ndarray
    b_cuts: np.ndarray
    a_drives: bool
    first: np.ndarray
    last: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(A token, B token) of each overlapping pair, in text order."""
        width = self.last - self.first + 1
        driver = np.repeat(np.arange(len(width)), width)
        other = np.arange(len(driver)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.first, width)
        return (driver, other) if self.a_drives else (other, driver)


def align(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Alignment:
    """Align tokens of the given byte lengths, which sum to the same on both sides; whole documents may follow each other."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    a_drives = len(a_ends) <= len(b_ends)
    short, long = (a_ends, b_ends) if a_drives else (b_ends, a_ends)
    if not len(short):
        return Alignment(*(np.zeros(0, np.int64),) * 2, a_drives, *(np.zeros(0, np.int64),) * 2)
    rank = gallop(short, long)
    common = long[rank] == short
    first = np.zeros(len(short), np.int64)
    first[1:] = rank[:-1] + common[:-1]  # after the end of the token before
    own, other = np.flatnonzero(common) + 1, rank[common] + 1
    return Alignment(*((own, other) if a_drives else (other, own)), a_drives, first, rank)


def digits_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to size - 1 as bytes, one column for each place, and how many each has."""
    numbers = [str(i).encode() for i in range(size)]
    return np.array(numbers, "S6").view(np.uint8).reshape(size, 6), np.array([len(n) for n in numbers], np.int64)


def written_groups(a_ids: np.ndarray, b_ids: np.ndarray, found: Alignment, digits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The text ``a1,a2|b1;a3|b2,b3;`` of all groups as bytes, and where each group ends in it."""
    total = len(a_ids) + len(b_ids)
    if not total:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    a_before, b_before = np.concatenate([[0], found.a_cuts[:-1]]), np.concatenate([[0], found.b_cuts[:-1]])
    a_place = np.arange(len(a_ids)) + np.repeat(b_before, found.a_cuts - a_before)
    b_place = np.arange(len(b_ids)) + np.repeat(found.a_cuts, found.b_cuts - b_before)
    ids, mark = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[a_place], ids[b_place] = a_ids, b_ids
    mark[a_place[found.a_cuts - 1]], mark[b_place[found.b_cuts - 1]] = ord("|"), ord(";")
    figures, width = digits
    size = width[ids]
    ends = np.cumsum(size + 1)
    text = np.empty(int(ends[-1]), np.uint8)
    text[ends - 1] = mark
    start = ends - 1 - size
    for place in range(figures.shape[1]):
        has = np.flatnonzero(size > place)
        if not len(has):
            break
        text[start[has] + place] = figures[ids[has], place]
    return text, ends[b_place[found.b_cuts - 1]]


# Over tables


def tokenized(docs: DataFrame, a_vocabulary: str | None = None, b_vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Each row's ids under both tokenizers, with the block that it belongs to and its number there."""
    a_default, b_default = default_vocabularies()
    a_vocabulary, b_vocabulary = a_vocabulary or a_default, b_vocabulary or b_default

    def ids_of(text: str | None) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        model, pieces = piece_model(b_vocabulary)
        a, b = text_ids(" " + text, a_vocabulary), model.encode(text)
        # A's bytes are always the text's: every byte is a token, and merges keep them
        return (a, b) if b"".join([pieces[i] for i in b]) == (" " + text).encode() else ([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, row, held = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in (portion for whole in batches for portion in portions(whole, "text")):
            blocks, rows, a_ids, b_ids = [], [], [], []
            for text in batch.column("text"):
                a, b = (np.array(ids, np.int32) for ids in ids_of(text.as_py()))
                if held and held + len(a) + len(b) > block_tokens:
                    number, row, held = number + 1, 0, 0
                blocks.append(task | number)
                rows.append(row)
                a_ids.append(a)
                b_ids.append(b)
                row, held = row + 1, held + len(a) + len(b)
            yield pa.record_batch([pa.array(blocks, pa.int64()), pa.array(rows, pa.int32()), batch.column("doc_id"), list_column(a_ids), list_column(b_ids)], ["block", "row", "doc_id", "a_ids", "b_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKENS)


def lengths_of(a_vocabulary: str, b_vocabulary: str, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return byte_lengths(a_vocabulary)[a], piece_lengths(b_vocabulary)[b]


def values_of(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.int64)


def sizes_of(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.value_lengths().fill_null(0).to_numpy().astype(np.int64)


def aligned(tokens: DataFrame, a_vocabulary: str | None = None, b_vocabulary: str | None = None) -> DataFrame:
    """doc_id with its groups (the A and the B ids of each) and its links (numbers of the A and the B token)."""
    a_default, b_default = default_vocabularies()
    a_vocabulary, b_vocabulary = a_vocabulary or a_default, b_vocabulary or b_default
    schema = "doc_id long, groups array<struct<a_ids: array<int>, b_ids: array<int>>>, links array<struct<a: int, b: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [pa.int64(), pa.list_(pa.struct([("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
        for batch in batches:
            groups, links = [], []
            for a, b in zip(batch.column("a_ids").to_pylist(), batch.column("b_ids").to_pylist(), strict=True):
                found = align(*lengths_of(a_vocabulary, b_vocabulary, np.array(a, np.int64), np.array(b, np.int64)))
                cuts = zip([0, *found.a_cuts], found.a_cuts, [0, *found.b_cuts], found.b_cuts, strict=False)
                groups.append([{"a_ids": a[i:j], "b_ids": b[k:m]} for i, j, k, m in cuts])
                links.append([{"a": int(i), "b": int(j)} for i, j in zip(*found.links(), strict=True)])
            yield pa.record_batch([batch.column("doc_id"), pa.array(groups, kind[1]), pa.array(links, kind[2])], ["doc_id", "groups", "links"])

    return tokens.mapInArrow(run, schema)


def codes_of(a: np.ndarray, b: np.ndarray, found: Alignment) -> np.ndarray:
    """Each link's id pair as one number; ids of A and of B have 16 bits each."""
    i, j = found.links()
    return (a[i].astype(np.uint32) << np.uint32(16)) | b[j].astype(np.uint32)


def block_pairs(tokens: DataFrame, a_vocabulary: str, b_vocabulary: str) -> DataFrame:
    """block, code and n: the links of each id pair, counted by block and batch of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.diff(blocks, prepend=blocks[:1] - 1, append=blocks[-1:] - 1)) if len(blocks) else []
            for start, stop in zip(edges, edges[1:], strict=False):
                part = batch.slice(start, stop - start)
                a, b = values_of(part.column("a_ids")), values_of(part.column("b_ids"))
                codes, n = np.unique(codes_of(a, b, align(*lengths_of(a_vocabulary, b_vocabulary, a, b))), return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(codes), blocks[start])), pa.array(codes.astype(np.int64)), pa.array(n)], ["block", "code", "n"])

    return tokens.mapInArrow(run, "block long, code long, n long")


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, compressed."""
    path = f"{shared_folder(df.sparkSession)}/pairs_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """code, its links in the corpus, and whether no A id is linked with the B id more often."""
    total = pairs.groupBy("code").agg(F.sum("n").alias("total"))
    most = F.max("total").over(Window.partitionBy(F.col("code") % 65536))  # at most one row for each A id
    return total.select("code", "total", (F.col("total") == most).alias("best"))


def scored(tokens: DataFrame, counts: DataFrame, a_vocabulary: str, b_vocabulary: str) -> DataFrame:
    """The figures of each document, from its block's ids and the corpus-wide counts of the block's pairs."""

    def run(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("row").to_numpy())
        rows = rows.take(pa.array(order))
        a, b = values_of(rows.column("a_ids")), values_of(rows.column("b_ids"))
        n_a, n_b = sizes_of(rows.column("a_ids")), sizes_of(rows.column("b_ids"))
        found = align(*lengths_of(a_vocabulary, b_vocabulary, a, b))
        a_stop = np.cumsum(n_a)
        # a document ends where its last A token does, which is the end of a group and of a link
        groups_upto = np.searchsorted(found.a_cuts, a_stop, "right")
        width = found.last - found.first + 1
        driver_stop = a_stop if found.a_drives else np.cumsum(n_b)
        links_upto = np.concatenate([[0], np.cumsum(width)])[driver_stop]
        known = pairs.column("code").to_numpy()
        by_code = np.argsort(known)
        at = by_code[np.searchsorted(known, codes_of(a, b, found).astype(np.int64), sorter=by_code)] if len(known) else np.zeros(0, np.int64)
        best_upto = np.concatenate([[0], np.cumsum(pairs.column("best").to_numpy(zero_copy_only=False)[at].astype(np.int64))])[links_upto]
        sum_upto = np.concatenate([[0], np.cumsum(pairs.column("total").to_numpy()[at])])[links_upto]
        text, ends = written_groups(a, b, found, digits_of(a_vocabulary, b_vocabulary))
        text_upto = np.concatenate([[0], ends])[groups_upto]
        whole, shas, start = memoryview(text), [], 0
        for stop in text_upto.tolist():
            shas.append(hashlib.sha256(whole[start : stop - 1]).hexdigest() if stop > start else "")  # without the last ;
            start = stop
        each = [np.diff(x, prepend=0) for x in (groups_upto, links_upto, best_upto, sum_upto)]
        return pa.table([rows.column("doc_id"), *map(pa.array, (n_a, n_b, *each)), pa.array(shas, pa.string())], [c.split()[0] for c in DIGEST.split(", ")])

    return tokens.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, DIGEST)


@cache
def digits_of(a_vocabulary: str, b_vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    return digits_table(max(len(byte_lengths(a_vocabulary)), len(piece_lengths(b_vocabulary))))


def bucketed(tokens: DataFrame) -> DataFrame:
    """The rows written once to the shared folder, in files by block, and read back in place: no exchange is needed by block."""
    spark = tokens.sparkSession
    name = f"tokens_{uuid.uuid4().hex}"
    tokens.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/{name}").bucketBy(partitions_for(spark), "block").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved here; the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def alignment_digest(docs: DataFrame, a_vocabulary: str | None = None, b_vocabulary: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """For each document its tokens, groups and links, how many links are their B id's commonest pair, and the sum of their counts."""
    a_default, b_default = default_vocabularies()
    a_vocabulary, b_vocabulary = a_vocabulary or a_default, b_vocabulary or b_default
    tokens = bucketed(tokenized(docs, a_vocabulary, b_vocabulary, block_tokens))
    pairs = stored(block_pairs(tokens, a_vocabulary, b_vocabulary))
    counts = pairs.select("block", "code").join(pair_counts(pairs), "code")
    return scored(tokens, counts, a_vocabulary, b_vocabulary)
