"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the five ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Columns that name a row by its contents, see ``with_row_key``.
ROW_KEY = ("__r1", "__r2")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in local mode a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cellwright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def compacted(df: DataFrame, rows: int = 65_536) -> DataFrame:
    """A checkpointed DataFrame with one partition for about so many rows, where it has more than that takes.

    Small intermediate results otherwise keep the partitions of the shuffle that made them, and
    every later exchange writes a file for each.
    """
    return df.coalesce(max(1, -(-df.count() // rows)))


def with_row_key(df: DataFrame) -> DataFrame:
    """Add ``ROW_KEY``: 128 bits of all columns, so that rows with one id but other contents stay apart.

    Rows that are equal in every column share the key; they are interchangeable.
    """
    return df.withColumns({"__r1": F.xxhash64(*df.columns), "__r2": F.xxhash64(F.lit("row"), *df.columns)})


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def word_count(text: Column) -> Column:
    """Number of words of a text without keeping them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(array: str) -> str:
    """SQL of the running sums of an integer array, each including its own place, in n log n steps."""
    grown = "transform(a, (x, i) -> x + coalesce(get(a, i - shiftleft(1, k)), 0))"
    rounds = f"sequence(0, cast(floor(log2(greatest(size({array}), 1))) AS int))"
    return f"aggregate({rounds}, {array}, (a, k) -> {grown})"


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` holds pairs of ids of any orderable type.  Returns (node, component) for each
    node on an edge, component being the smallest id reachable.  Every round is a pair of
    group minima and equi-joins, so no component ever sits in one task; rounds stop when all
    edges lead straight to a node that leads nowhere, which takes a number logarithmic in the
    longest chain.
    """
    current = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    while True:
        current = compacted(shared_checkpoint(_small_star(_large_star(current))))
        inner = current.select(F.col("v").alias("u")).distinct()
        several = current.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if current.join(inner, "u", "left_semi").select("u").unionByName(several).isEmpty():
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(low, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
