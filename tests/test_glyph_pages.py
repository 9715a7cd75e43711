"""J23 on the page's row and masks of whole texts: the same as from lines that meet, and from characters one by one."""

from pyspark.sql import functions as F

from cellwright.functions.braille import ascii_mask, to_masks
from cellwright.operators import localization as G
from cellwright.plans import localization as P

TEXTS = ["a,b 12 #c d e f, g é h " * 40, "é ß ü", "😀a b,", "", None, ",", "w 3 x 3 ,y", "one two\rthree `{|}~ [x]\\^_ " * 30]


def rows(df):
    return sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def test_spans_meet_glyphs_on_the_row(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    ours, theirs = P.QUERIES["j23_spans_to_glyphs"](spark, sf), G.line_spans_to_glyphs(P.spans(spark, sf), P.cell_lines(spark, sf), P.drawn(spark, sf))
    assert ours.dtypes == theirs.dtypes and rows(ours) == rows(theirs) and ours.count() > 30
    long = lambda df: df.withColumn("spans", F.expr("transform(spans, s -> named_struct('id', s.id, 'start', s.start - 3, 'end', s.start + 40))"))
    wide = P.spans(spark, sf).withColumns({"start": F.col("start") - 3, "end": F.col("start") + 40})
    assert rows(G.page_spans_to_glyphs(long(P.drawn_pages(spark, sf)))) == rows(G.line_spans_to_glyphs(wide, P.cell_lines(spark, sf), P.drawn(spark, sf)))
    plan = ours._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_masks_of_texts_are_those_of_their_characters(spark):
    texts = ["", None, "".join(map(chr, range(1, 300))) + "😀ÿ", *TEXTS]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    one = F.transform(F.filter(F.split("t", ""), lambda x: x != ""), lambda x: ascii_mask(x))
    assert df.where(~to_masks(F.col("t")).eqNullSafe(one)).count() == 0
    assert df.select(to_masks(F.col("t")).alias("m")).dtypes == df.select(one.alias("m")).dtypes
