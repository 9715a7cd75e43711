"""SimHash near-duplicates with Golay-code fuzzy hashing.

Fingerprints are 64-bit majorities over the XXH64 values of word shingles.  To find all
pairs within ``MAX_BITS`` = 4 differing bits without comparing everything, a fingerprint is
cut into two 23-bit segments and an 18-bit rest.  The perfect binary Golay code maps every
23-bit word to one of 4,096 codewords at most 3 bits away; a segment's keys are the codeword
indices of the word and of all words one bit off, at most six.  Two segments up to two bits
apart always have such an index in common: that of a word half-way.  By the pigeonhole
principle four errors either leave one of the three parts untouched, found by its exact
value, or put one or two errors into each 23-bit segment, found by a pair of indices.  Every
candidate is verified by its Hamming distance, so the links are exact and complete.

Equal fingerprints are merged before keys are made, so exact copies cost one row.  A bucket
is compared in blocks of at most ``BLOCK`` fingerprints (larger buckets in all pairs of their
blocks), and of each block only a spanning forest leaves the task.

A pair's keys have 24 bits, so in a bucket of unrelated fingerprints work grows with the square
of their number over 2^24; it is numpy work on 64-bit words, a few nanoseconds a pair.

Defined results: null, empty and blank texts have fingerprint zero and link like any other;
very long texts are hashed whole, their bits counted in parts; rows without doc_id are
fingerprinted and linked too, and their component has a null id if it has no other; repeated
rows are kept; columns other than doc_id and text are not looked at, whatever their names.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import ROW_KEY, components, partitions_for, shared_checkpoint, with_row_key

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BLOCK = 4096
#: Groups up to this size are compared by shifting the sorted column, larger ones by search.
SMALL = 8
#: Classes are joined to documents through so many salts.
SALTS = 16
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^9+x^7+x^6+x^5+x+1.
GOLAY = 0b101011100011
SEGMENT = 23


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(starts))  # noqa: B905
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, keep) with the fingerprint's bits as a signed long; kept columns are longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, width, seed) for t in batch["text"]), np.uint64, len(batch))
            yield batch.drop(columns="text").assign(fp=prints.view(np.int64))

    schema = ", ".join(f"{c} long" for c in ("doc_id", *keep, "fp"))
    return docs.select(F.col("doc_id").cast("long"), *keep, F.col("text").cast("string")).mapInPandas(run, schema)


@cache
def _decoder() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of single bits, and the error pattern (weight 3 at most) of every syndrome."""

    def remainder(word: int) -> int:
        for bit in range(SEGMENT - 1, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    single = np.array([remainder(1 << b) for b in range(SEGMENT)], np.uint32)
    leaders = np.zeros(1 << 11, np.uint32)
    bits = range(SEGMENT)
    for i in bits:
        leaders[single[i]] = 1 << i
        for j in range(i):
            leaders[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                leaders[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return single, leaders


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    single, leaders = _decoder()
    syndrome = np.zeros(words.shape, np.uint32)
    for bit in range(SEGMENT):
        syndrome ^= np.where(words >> np.uint32(bit) & np.uint32(1), single[bit], np.uint32(0))
    return (words ^ leaders[syndrome]) >> np.uint32(11)


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each word and of its one-bit neighbours: a matrix of 24 columns and a mask of first occurrences."""
    flips = np.concatenate([[0], 1 << np.arange(SEGMENT)]).astype(np.uint32)
    found = np.sort(codeword_index(words[:, None] ^ flips[None, :]), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, first


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all bucket keys of unsigned fingerprints."""
    low = np.uint64((1 << SEGMENT) - 1)
    a, b = (prints & low).astype(np.uint32), (prints >> np.uint64(SEGMENT) & low).astype(np.uint32)
    rest = prints >> np.uint64(2 * SEGMENT)
    rows, keys = [], []
    for kind, part in enumerate((a, b, rest)):
        rows.append(np.arange(len(prints)))
        keys.append(part.astype(np.int64) | kind << 60)
    ka, fa = segment_keys(a)
    kb, fb = segment_keys(b)
    ra, ca = np.nonzero(fa)
    rb, cb = np.nonzero(fb)
    na, nb = fa.sum(1), fb.sum(1)
    starts = np.cumsum(nb) - nb
    times = nb[ra]  # each index of segment a meets all of segment b
    left = np.repeat(np.arange(len(ra)), times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + starts[ra[left]]
    rows.append(ra[left])
    keys.append(ka[ra[left], ca[left]].astype(np.int64) << 12 | kb[rb[right], cb[right]].astype(np.int64) | 3 << 60)
    assert len(left) == int((na * nb).sum())
    return np.concatenate(rows), np.concatenate(keys)


def bucket_links(key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside runs of equal keys; of larger runs only a spanning forest."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    us, vs = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    at = np.flatnonzero(small)
    for shift in range(1, SMALL):
        at = at[at + shift < len(key)]
        at = at[key[at] == key[at + shift]]
        near = at[np.bitwise_count(prints[at] ^ prints[at + shift]) <= MAX_BITS]
        us.append(prints[near])
        vs.append(prints[near + shift])
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        left = prints[start : start + size]
        while len(left) > 1:
            frontier, left = [left[0]], left[1:]
            while frontier and len(left):
                node = frontier.pop()
                near = np.bitwise_count(left ^ node) <= MAX_BITS
                if near.any():
                    hit, left = left[near], left[~near]
                    us.append(np.full(len(hit), node, np.uint64))
                    vs.append(hit)
                    frontier += list(hit)
    return np.concatenate(us), np.concatenate(vs)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` within ``MAX_BITS``."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fp"].to_numpy(np.int64)
            rows, keys = keys_of(values.view(np.uint64))
            yield pd.DataFrame({"key": keys, "fp": values[rows]})

    keys = prints.select("fp").mapInPandas(emit, "key long, fp long")
    hot = shared_checkpoint(keys.groupBy("key").count().where(F.col("count") > BLOCK))
    if hot.isEmpty():
        blocks = keys.withColumn("block", F.lit(0).cast("long"))
    else:
        blocks = keys.join(hot, "key", "left").withColumn("m", F.ceil(F.coalesce("count", F.lit(1)) / BLOCK))
        blocks = blocks.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("m")))
        blocks = blocks.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
        blocks = blocks.select("key", (F.least("i", "j") * F.col("m") + F.greatest("i", "j")).alias("block"), "fp")
    parts = partitions_for(prints.sparkSession)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (batch["key"] == batch["key"].iloc[-1]) & (batch["block"] == batch["block"].iloc[-1])
            held, whole = batch[last], batch[~last]
            if len(whole):
                yield found(whole)
        if held is not None and len(held):
            yield found(held)

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        key, block = rows["key"].to_numpy(np.int64), rows["block"].to_numpy(np.int64)
        run = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        u, v = bucket_links(run, rows["fp"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    ordered = blocks.repartition(parts, "key", "block").sortWithinPartitions("key", "block")
    return ordered.mapInPandas(link, "u long, v long").distinct()


def _classified(docs: DataFrame, width: int, seed: int, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, keep, fp, root (a fingerprint of the component) and component_id of every document."""
    prints = shared_checkpoint(fingerprints(docs, width, seed, keep))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = components(fingerprint_links(nodes))
    named = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(roots, "root").select("fp", "root", "component_id")
    # one fingerprint may be a third of all rows (empty texts, copies), so its class goes to salts
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id", *keep), F.lit(SALTS)).cast("int"))
    return dealt.join(classes, ["fp", "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Fingerprint and component of every document.

    Returns doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable).
    """
    found = _classified(docs, width, seed, ())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component: a row with its smallest doc_id, its columns unchanged.

    Rows are told apart by all their columns; of rows equal in all of them one stays.  A
    component without any doc_id keeps one row too.
    """
    keyed = with_row_key(docs)
    found = _classified(keyed, SHINGLE, SEED, ROW_KEY).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = found.groupBy("root").agg(F.min(F.struct(*ROW_KEY)).alias("first")).select("first.*")
    return keyed.join(first, list(ROW_KEY), "left_semi").dropDuplicates(list(ROW_KEY)).select(*docs.columns)
