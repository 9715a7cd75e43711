"""Approximate nearest neighbours: stable projections indexed by kd-trees.

Vectors are scaled to unit length, where Euclidean distance orders as cosine does, and
projected to ``PROJECTIONS`` dimensions by Gaussian (2-stable) directions: the squared
projected distance over the squared true distance follows a chi-square law.  The projections
of a block of vectors are held in a kd-tree.  A query takes its leaves in order of projected
distance, verifies each leaf's vectors exactly, and stops when the chi-square test holds:
what is left is so far away in projection that a vector nearer than the k-th found would have
been met before with probability ``CONFIDENCE``.

Equal vectors are one entry of the index with their smallest ids, so a vector that fills the
table costs one row; each task keeps only that many before they shuffle.  The index is dealt
into blocks of bounded size; a block's vectors come first in its partition, become one tree,
and queries stream through it batch by batch, so no task holds more than a block.  A query
first searches the block that its own vector is in.  Its k-th score there bounds the search
in all others: their test holds from the first leaf on, and a block whose leaves are all
beyond the bound costs a comparison of boxes.  Each block's best go to a ranked merge.
Recall is measured in the tests.

Before products are taken, vectors are scaled by powers of two, which changes no digit of a
cosine but keeps very small and very large components from vanishing or overflowing.

Defined results: vectors that are null, empty or zero or hold null or non-finite components
take no part, nor do rows without an id; repeated rows of an id are entries and queries of
their own, each with its ranks, and find each other;
vectors of other dimensions are not compared; equal scores go to the smaller id, so all rows
that tie with the k-th are kept until ids decide; fewer than k candidates give fewer rows;
columns other than vec_id and the vector are not looked at; an empty table an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.llm.common import partitions_for, shared_checkpoint

PROJECTIONS = 12
CONFIDENCE = 0.93
LEAF = 32
#: Leaves that are verified before the first test; each further step takes as many as all before it.
STEP = 4
INDEX_BLOCK = 16_384
SEED = 7
FOUND = "query long, query_id long, vec_id long, score double"


def chi_square_quantile(probability: float, dof: int) -> float:
    """Quantile of the chi-square distribution for an even number of degrees of freedom."""
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        tail = math.exp(-mid / 2) * sum((mid / 2) ** k / math.factorial(k) for k in range(dof // 2))
        low, high = (mid, high) if 1 - tail < probability else (low, mid)
    return low


def rescaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component lies between a half and one."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))
    return np.ldexp(vectors, -exponent)


class ProjectedTree:
    """A kd-tree over projected unit vectors, its leaves contiguous rows."""

    def __init__(self, vectors: np.ndarray):
        self.given, vectors = vectors, rescaled(vectors)
        self.norms = np.sqrt((vectors * vectors).sum(1))
        axes = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        projected = (vectors / self.norms[:, None]) @ axes
        order, starts, todo = np.arange(len(vectors)), [], [(0, len(vectors))]
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                starts.append(a)
                continue
            part = projected[order[a:b]]
            axis, middle = int(np.argmax(np.ptp(part, axis=0))), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], middle)]
            todo += [(a, a + middle), (a + middle, b)]
        self.axes, self.order = axes, order
        self.starts = np.array(sorted(starts))
        self.ends = np.append(self.starts[1:], len(vectors))
        self.vectors, self.norms = vectors[order], self.norms[order]
        self.projected = projected[order]
        self.low = np.minimum.reduceat(self.projected, self.starts)
        self.high = np.maximum.reduceat(self.projected, self.starts)

    def nearest(self, query: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """(row, cosine) of the k nearest found and of all found that tie with the last, and how many rows were verified.

        Rows below ``least`` need not be found.
        """
        query = rescaled(query)
        norm = np.sqrt((query * query).sum())
        at = query / norm @ self.axes
        bound = (np.maximum(np.maximum(self.low - at, at - self.high), 0) ** 2).sum(1)
        leaves = np.argsort(bound, kind="stable")
        limit = chi_square_quantile_cached()
        rows, scores, seen, i, step = np.empty(0, np.int64), np.empty(0), 0, 0, STEP
        while i < len(leaves):
            last = max(scores.min(), least) if len(scores) >= k else least if least > -np.inf else None
            if last is not None and bound[leaves[i]] > limit * max(0.0, 2 - 2 * last) + 1e-12:
                break
            found = np.concatenate([np.arange(self.starts[x], self.ends[x]) for x in leaves[i : i + step]])
            if last is not None:  # the same test for each vector of the leaves
                apart = ((self.projected[found] - at) ** 2).sum(1)
                found = found[apart <= limit * max(0.0, 2 - 2 * last) + 1e-12]
            i, step = i + step, max(step, i)
            seen += len(found)
            cosine = (self.vectors[found] * query).sum(1) / (self.norms[found] * norm)
            rows, scores = np.concatenate([rows, found]), np.concatenate([scores, cosine])
            if len(scores) > k:
                best = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                rows, scores = rows[best], scores[best]
        return self.order[rows], scores, seen


def chi_square_quantile_cached(cache: dict[tuple[float, int], float] = {}) -> float:  # noqa: B006
    key = (CONFIDENCE, PROJECTIONS)
    if key not in cache:
        cache[key] = chi_square_quantile(*key)
    return cache[key]


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, v): ids and vectors, in double precision, of the rows that take part."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    return rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, column: str = "embedding") -> DataFrame:
    """The k nearest by cosine of every row whose vec_id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id and score.
    """
    rows = usable(vectors, column)
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = shared_checkpoint(entries.withColumn("dim", F.size("v")))
    blocks = max(1, -(-entries.count() // INDEX_BLOCK))
    block = F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int")
    asking = shared_checkpoint(rows.where(F.col("vec_id") % every == 0))
    queries = asking.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"), block.alias("own"))
    index = entries.select("dim", block.alias("block"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("query"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("double").alias("least"), "ids", "v")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, tree, ids = None, [], None, []
        for batch in batches:
            for here, part in batch.groupby(["dim", "block", "turn"], sort=True):
                if here[:2] != key:
                    key, held, tree = here[:2], [], None
                if not here[2]:
                    held.append(part)
                    continue
                if tree is None and held:
                    whole = pd.concat(held)
                    tree, ids, held = ProjectedTree(np.stack(whole["v"].to_list())), whole["ids"].to_list(), []
                if tree is not None:
                    yield answers(tree, ids, part)

    def answers(tree: ProjectedTree, ids: list, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query, query_id, v, least in zip(part["query"], part["query_id"], part["v"], part["least"], strict=True):
            v = np.asarray(v)
            found, scores, _ = tree.nearest(v, k + 1, -np.inf if least is None or np.isnan(least) else least)
            best = []
            for row, s in zip(found, scores, strict=True):
                others = list(ids[row])
                if query_id in others and np.array_equal(tree.given[row], v):
                    others.remove(query_id)  # the query's own row
                best += [(-s, i) for i in others]
            out += [(int(query), int(query_id), i, -s) for s, i in sorted(best)[:k]]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score"]).astype({"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})

    parts = max(blocks, partitions_for(vectors.sparkSession))

    def searched(asked: DataFrame) -> DataFrame:
        dealt = index.unionByName(asked).repartition(parts, "dim", "block").sortWithinPartitions("dim", "block", "turn")
        return shared_checkpoint(dealt.mapInPandas(search, FOUND))

    visit = [F.lit(1).alias("turn"), "query", "query_id", "least", F.lit(None).cast("array<long>").alias("ids"), "v"]
    found = searched(queries.withColumn("least", F.lit(None).cast("double")).select("dim", F.col("own").alias("block"), *visit))
    if blocks > 1:
        bounds = found.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).select("query", "least")
        others = F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(blocks - 1)), F.col("own")))
        found = found.unionByName(searched(queries.join(bounds, "query", "left").withColumn("block", others).select("dim", "block", *visit)))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
