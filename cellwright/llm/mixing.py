"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions.

Sources share a token budget by weight; a source's target stops at ``MAX_EPOCHS`` times its
size and what it cannot use is shared again by weight (water-filling, solved in closed form
over the sources ordered by cap per weight).  Complete epochs come first: every document of a
source is taken floor(target / size) times.  The rest is a weighted sample without
replacement: each document gets the key u^(1/w), u a hash of the document and w its quality weight,
and documents are taken in falling key order while the prefix sum of sizes stays within the
rest; the gap that the first one too many leaves is filled by further prefix sums over the
next documents that fit.

A source may hold most rows, so no source is ever sorted as a whole: keys fall into buckets
of about ``BUCKET`` documents, prefix sums run over the buckets, and only the one bucket in
which a source's budget ends is ordered.  Only the table of sources, one short row each, is
ordered in a single task.

Defined results: null and blank texts have size 0 and are never taken; a null source is a
source of its own, last in order; u comes from doc_id and text, so rows without doc_id differ by
their texts; ties go by doc_id, then size, and equal rows count one by one; a very long text
that no budget holds is passed over for smaller ones; columns other than doc_id, text and source
are not looked at; an empty table gives an empty result.  Reruns agree, as nothing but the rows
decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.llm.common import ROW_KEY, shared_checkpoint, with_row_key, word_count

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
BUCKET = 2048
SALTS = 16
#: Passes over a source's last bucket: its prefix, then smaller documents for the gap.
FILLS = 4
LEAST_WEIGHT = 0.5
#: Copies of one row that are made at once.
RUN = 1024


def quality_weight(text: Column, size: Column) -> Column:
    """From 1 for plain prose down to ``LEAST_WEIGHT`` by the number of symbols a word."""
    symbols = F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0))
    return F.greatest(F.lit(LEAST_WEIGHT), 1.0 - symbols.cast("double") / F.greatest(size, F.lit(1)))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) that depends on the document alone: 52 bits of an MD5 value."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digits = F.substring(F.md5(name.cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sized: DataFrame) -> DataFrame:
    """(key, source_size, n, target) for each source of rows with key, source and size."""
    sources = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    sources = sources.withColumn("w", F.get(weights, F.pmod(place, F.lit(len(WEIGHTS)))))
    cap = F.col("source_size") * float(MAX_EPOCHS)
    sources = sources.withColumns({"cap": cap, "total": BUDGET_SHARE * F.sum("source_size").over(Window.partitionBy())})
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    sources = sources.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    # the first source that is not full has the highest level of those that are not
    water = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy())
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", water * F.col("w")))
    return sources.select("key", "source_size", "n", target.alias("target"))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Join each source's values to its rows, over salts because one source may be most rows."""
    spread = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(spread, ["key", "salt"]).select(*rows.columns, *(c for c in sources.columns if c != "key"))


def mix(docs: DataFrame, *keep: str) -> DataFrame:
    """How many words of each document the mix takes.

    Returns doc_id, size, source_size, target, taken (0, or size times a number of copies) and
    the columns named in ``keep``.
    """
    sized = docs.select(
        F.col("doc_id").cast("long"), "source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("key"),
        word_count(F.col("text")).alias("size"), F.col("text"), *keep,
    )
    rank = F.pow(uniform(F.col("doc_id"), F.col("text")), 1 / quality_weight(F.col("text"), F.col("size")))
    sized = sized.withColumn("rank", rank).withColumn("salt", F.pmod(F.xxhash64("doc_id", "rank"), F.lit(SALTS)).cast("int"))
    sized = shared_checkpoint(sized.drop("text"))
    plan = source_targets(sized)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs)
    plan = plan.withColumns({"rest": F.col("target") - F.col("epochs") * F.col("source_size"), "buckets": F.ceil(F.col("n") / BUCKET)})
    plan = shared_checkpoint(plan.drop("n"))
    rows = _with_source(sized.drop("source"), plan)
    rows = rows.withColumn("bucket", F.floor((1 - F.col("rank")) * F.col("buckets")))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("s"), F.first("rest").alias("rest"))
    upto = F.sum("s").over(Window.partitionBy("key").orderBy("bucket"))
    sums = sums.withColumn("upto", upto)
    ends = sums.where("upto > rest").groupBy("key").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("s")).alias("before")), "bucket").alias("end"))
    ends = plan.select("key").join(ends, "key", "left").select("key", F.col("end.bucket").alias("end"), F.col("end.before").alias("before"))
    rows = _with_source(rows, shared_checkpoint(ends))
    inside = rows.where("bucket = end")
    order = Window.partitionBy("key").orderBy(F.col("rank").desc(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumns({"gap": F.col("rest") - F.col("before"), "more": F.lit(False)})
    for _ in range(FILLS):  # the prefix, then what still fits into the gap that it leaves
        open_size = F.when(~F.col("more") & (F.col("size") <= F.col("gap")), F.col("size"))
        inside = inside.withColumn("now", F.coalesce(F.sum(open_size).over(order) <= F.col("gap"), F.lit(False)) & open_size.isNotNull())
        spent = F.sum(F.when(F.col("now"), F.col("size")).otherwise(0)).over(Window.partitionBy("key"))
        inside = inside.withColumns({"more": F.col("more") | F.col("now"), "gap": F.col("gap") - spent})
    inside = inside.drop("gap", "now")
    others = rows.where("end IS NULL OR bucket <> end")
    others = others.withColumn("more", F.when(F.col("end").isNull(), F.col("rest") > 0).otherwise(F.col("bucket") < F.col("end")))
    copies = F.col("epochs") + F.when(F.col("more"), 1).otherwise(0)
    return inside.unionByName(others).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), *keep)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents in their mix: each as many times as it is taken, its columns unchanged.

    Rows are told apart by all their columns; equal rows are interchangeable, so one of them
    comes as often as all of them are taken, dealt out in runs of ``RUN`` copies.
    """
    keyed = with_row_key(docs)
    taken = mix(keyed, *ROW_KEY).where("taken > 0").groupBy(*ROW_KEY).agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias("__copies"))
    joined = keyed.join(taken, list(ROW_KEY)).dropDuplicates(list(ROW_KEY))
    runs = joined.withColumn("__left", F.explode(F.expr(f"sequence(__copies, 1, -{RUN}L)")))
    runs = runs.withColumn("__copy", F.explode(F.expr(f"sequence(1, cast(least(__left, {RUN}) AS int))")))
    return runs.select(*docs.columns)
