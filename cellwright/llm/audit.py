"""How five filters interact: what each removes at every step of all 120 orders, per part of the corpus.

A document is a mask, the set of filters that it fails.  In an order of the filters it is removed
at its first failing one, so the orders that remove it at step k with filter f are those that start
with k - 1 filters it passes and then f: for each such prefix one interval of the 120
lexicographic (Lehmer) ranks, (5 - k)! long.  The documents are counted by mask; each count is
added where an interval starts and taken off where it ends, and prefix sums over the ranks give
every order's removals.  What follows the masks has at most 32 rows a part, whatever the input.

Documents are read once; the identical-text rule compares SHA-256 values of whole texts.  Its
groups are reduced to their least doc_id before they shuffle, and the least ids go back to the
documents by (doc_id, text), a key that no group of copies shares.

Defined results: a null text is an empty one, and equal to it; a null lang is the part of the
empty string; very long texts are counted whole; repeated rows of one doc_id count one by one, and
none of them is a copy of the others, as their ids tie; a row without doc_id is no one's copy
and has no label; several labels of a document hold together; an empty table has no part and gives
no row; columns other than doc_id, text and lang (of labels: doc_id, quality, toxic) are not
looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm.common import shared_checkpoint, words_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]  # by Lehmer rank
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def rank_of(prefix: str) -> int:
    """Lehmer rank of the first order that starts with these filters."""
    rank, rest = 0, FILTERS
    for at, name in enumerate(prefix):
        rank += rest.index(name) * factorial(len(FILTERS) - 1 - at)
        rest = rest.replace(name, "")
    return rank


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, end rank) of all orders that remove a document of the mask at the step."""
    rows = []
    for step in range(1, len(FILTERS) + 1):
        for prefix in permutations(range(len(FILTERS)), step):
            start = rank_of("".join(FILTERS[f] for f in prefix))
            passed = sum(1 << f for f in prefix[:-1])
            rows += [(mask, step, start, start + factorial(len(FILTERS) - step)) for mask in range(1 << len(FILTERS)) if mask >> prefix[-1] & 1 and not mask & passed]
    return rows


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: too few words, too few distinct ones, too many capitals, a character of markup."""
    whole = F.coalesce(text, F.lit(""))
    words = words_of(text)
    failed = (
        F.size(words) < 200,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        F.regexp_count(whole, F.lit("[A-Z]")) * 100 > F.length(whole) * 3,
        whole.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << n).otherwise(0) for n, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and the mask of failed filters of each row."""
    text = F.col("text")
    facts = shared_checkpoint(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
            text_failures(text).alias("own"),
            F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"),
        )
    )
    first = facts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    copy = F.when(F.col("doc_id").isNotNull() & F.col("is_first").isNull(), 1 << 4).otherwise(0)
    return facts.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", (F.col("own") + copy).cast("int").alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and its documents: n, those labelled good and those labelled toxic."""
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    return masks(docs).join(marked, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def _fixed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the 120 orders or of their intervals; its size depends on the number of filters alone."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def interactions(counts: DataFrame) -> DataFrame:
    """All orders and steps of each part, from its counts by mask."""
    spark = counts.sparkSession
    counts = shared_checkpoint(counts)  # read for the removals, the totals and the spine
    inside = counts.join(_fixed(spark, intervals(), "mask int, step int, start int, stop int"), "mask")
    ends = inside.select(
        "part", "step",
        F.explode(F.array(F.struct(F.col("start").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("stop").alias("rank"), F.lit(-1).alias("sign")))).alias("end"),
        "n", "good", "toxic",
    )
    steps = ends.groupBy("part", "step", F.col("end.rank").alias("rank")).agg(*(F.sum(F.col("end.sign") * F.col(c)).alias(f"d_{c}") for c in ("n", "good", "toxic")))
    of = {f: F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0)) for i, f in enumerate(FILTERS)}
    alone = {f: F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i, f in enumerate(FILTERS)}
    totals = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*(F.struct(F.lit(f).alias("filter"), of[f].alias("fails"), alone[f].alias("unique_fails")) for f in FILTERS)).alias("each"),
    )
    spine = totals.select("part", "total", "each", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank")).join(
        _fixed(spark, list(enumerate(ORDERS)), "rank int, filter_order string"), "rank"
    )
    spine = spine.select("*", F.posexplode("each").alias("place", "own")).select(
        "part", "total", "rank", "filter_order", F.expr("instr(filter_order, own.filter)").alias("step"), "own.filter", "own.fails", "own.unique_fails"
    )
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    dense = spine.join(steps, ["part", "step", "rank"], "left").withColumns(
        {name: F.coalesce(F.sum(d).over(upto), F.lit(0)).cast("long") for name, d in (("removed", "d_n"), ("good_lost", "d_good"), ("toxic_lost", "d_toxic"))}
    )
    through = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return dense.select(
        "part", "filter_order", "step",
        (F.col("total") - F.sum("removed").over(through)).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every step of every order of the five filters, for each language."""
    return interactions(mask_counts(docs, labels))
