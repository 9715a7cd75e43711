"""Alignment of regions whose sides are on one row, and index maps in blocks: the results of the operators on cells."""

from pyspark.sql import functions as F

from cellwright.operators import alignment as A
from cellwright.plans import alignment as P

PAIRS = [(1, 0, "abcde", "abXXe"), (1, 1, "a", "b"), (1, 2, "", ""), (1, 3, "é😀 x", "é😀-x"), (2, 0, "same " * 40, "same " * 40), (2, 1, "x" * 150, "x" * 70 + "y" + "x" * 79)]


def rows(df):
    return sorted(map(repr, df.collect()))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_equal_texts_give_the_runs_of_their_cells(spark):
    pairs = spark.createDataFrame(PAIRS, "doc_id long, region long, text string, other string")
    ours = A.align_equal_texts(pairs)
    assert exchanges(ours) == 0
    theirs = A.align_equal_width(P.cells_of("text")(pairs), P.cells_of("other")(pairs))
    assert ours.columns == theirs.columns and rows(ours) == rows(theirs)


def test_raw_runs_over_blocks_are_those_cell_by_cell(spark):
    runs = spark.createDataFrame([(1, 0, 0, 149), (1, 0, 160, 170), (1, 1, 63, 64), (2, 0, 5, 5), (3, 0, 0, 3)], "doc_id long, region long, first int, last int")
    index = spark.createDataFrame([(d, p, p + p // 10 + (p > 70)) for d in (1, 2) for p in range(165) if p != 100], "doc_id long, pos int, raw_pos int")
    at = runs.select("doc_id", "region", "first", F.explode(F.sequence("first", "last")).alias("pos")).join(index, ["doc_id", "pos"]).withColumn("tag", F.lit("equal"))
    theirs = A.merge_runs(at.withColumnRenamed("first", "run"), ["doc_id", "region", "run"], "raw_pos").select("doc_id", "region", "run", F.col("first").alias("raw_first"), F.col("last").alias("raw_last"))
    ours = A.project_raw(runs, index)
    assert ours.columns == theirs.columns and rows(ours) == rows(theirs)
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "pos#" not in "".join(x for x in plan.split("\n") if "Exchange hash" in x)


def test_gaps_of_both_sides_are_found_on_one_row(spark):
    pairs = spark.createDataFrame([(1, 0, "a  b c", "a b  c "), (1, 1, " ", ""), (1, 2, "ab", "a b"), (1, 3, "ab", "b a"), (1, 4, "", "  ")], "doc_id long, region long, text string, other string")
    ours = A.blank_only_gaps(pairs)
    assert exchanges(ours) == 0
    assert sorted(map(tuple, ours.collect())) == [(1, 0, 1, 1, 1, 0), (1, 0, 2, 1, 0, 1), (1, 0, 3, 0, 0, 1), (1, 1, 0, 0, 1, 0), (1, 2, 1, 0, 0, 1), (1, 4, 0, 0, 0, 2)]
    assert rows(A.align_blank_only(pairs.drop("other"), pairs.select("doc_id", "region", F.col("other").alias("text")))) == rows(ours)
