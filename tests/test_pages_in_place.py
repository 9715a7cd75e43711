"""Lines, candidates and findings placed on the rows of documents and pages: the same rows as by windows and joins."""

from pyspark.sql import functions as F

from cellwright.operators import corpus
from cellwright.operators import evaluation as V
from cellwright.operators import validation
from cellwright.plans import corpus as P
from cellwright.plans import evaluation as E
from cellwright.plans import mathspans
from cellwright.plans.validation import printed_lines, sides
from cellwright.sources.testdata import expected_cells, lines_in_place, manifest, manifest_in_place, placed_lines, placed_pages

TEXTS = ["a,b 12 #c d e f, g é h " * 20, "é ß ü 😀a", "", None, " \n ", ",", "word " * 9000, "x" * 400 + " y\nz"]


def table(spark, path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows(df):
    return sorted(map(repr, df.collect()))


def moves(df):
    """Exchanges of a plan other than the one that deals out documents."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "REPARTITION_BY_COL" not in x]


def test_lines_on_their_document_are_placed_lines_and_do_not_move(spark, tmp_path):
    sf = table(spark, tmp_path)
    ours, theirs = lines_in_place(spark, sf), placed_lines(spark, sf)
    assert ours.dtypes == theirs.dtypes and rows(ours) == rows(theirs)
    inlined = placed_pages(spark, sf).select("doc_id", "page_no", F.inline("lines"))
    assert rows(inlined.select(*theirs.columns)) == rows(theirs)
    assert rows(manifest_in_place(spark, sf)) == rows(manifest(spark, sf))
    for df in (ours, manifest_in_place(spark, sf)):
        assert not moves(df) and "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_quota_sample_derives_its_candidates_once(spark, tmp_path):
    sf = table(spark, tmp_path)
    sample = P.QUERIES["t2_quota_sample"](spark, sf)
    assert not moves(sample) and sample._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1
    cands = spark.createDataFrame([(1, "a", 1, 1, 0), (2, "z", 1, 1, 3)], "doc_id long, family string, page_no int, line_no int, expected_start long")
    assert sorted(map(tuple, corpus.quota_sample(cands, {"a": 1}).collect())) == [(1, "a", 0, 0), (2, "a", None, 1)]


def test_candidates_and_outcomes_of_a_page_stay_on_its_row(spark, tmp_path):
    sf = table(spark, tmp_path)
    for name in ("j28_match_candidates", "j29_assign_findings", "t5_first_n"):
        plan = E.QUERIES[name](spark, sf)
        assert not moves(plan) and "Join" not in plan._jdf.queryExecution().executedPlan().toString(), name
    own, theirs = E.scored(spark, sf)
    states = V.assign_findings(own, V.match_candidates(own, theirs))
    assert rows(E.QUERIES["j29_assign_findings"](spark, sf)) == rows(states)
    quality = V.quality(own, states.where("state = 'DETECTED'"), theirs)
    assert rows(E.QUERIES["a11_assigned_quality"](spark, sf).select(*quality.columns)) == rows(quality)


def test_large_pages_meet_by_keys_as_small_ones_do(spark, monkeypatch):
    box = "array(named_struct('line', cast(id % 3 AS int), 'cell', cast(id * 5 % 11 AS int)))"
    op = "CASE id % 2 WHEN 0 THEN 'insert' ELSE 'delete' END"
    own = spark.range(40).selectExpr("id % 2 AS doc_id", "1 AS page_no", "concat('M', id) AS mut_id", f"{op} AS operation", "id * 2 AS start", "id * 2 + id % 2 AS end", f"CASE WHEN id % 7 = 0 THEN slice({box}, 1, 0) ELSE {box} END AS boxes")
    theirs = spark.range(45).selectExpr("id % 2 AS doc_id", "1 AS page_no", "concat('F', id) AS find_id", f"{op} AS operation", "id * 2 + id % 5 - 3 AS start", "id * 2 + id % 2 AS end", f"CASE WHEN id % 5 = 0 THEN slice({box}, 1, 0) ELSE {box} END AS boxes")
    m, f = own.alias("m"), theirs.alias("f")
    brute = m.join(f, F.expr("m.doc_id = f.doc_id AND m.operation = f.operation AND (abs(m.start - f.start) <= 4 OR arrays_overlap(m.boxes, f.boxes))"))
    score = "4 * int(size(m.boxes) > 0 AND m.boxes = f.boxes) + 2 * int(m.start = f.start AND m.end = f.end) + int(arrays_overlap(m.boxes, f.boxes))"
    brute = rows(brute.selectExpr("m.doc_id", "m.page_no", "mut_id", "find_id", "m.start", f"bigint({score}) AS score"))
    assert rows(V.match_candidates(own, theirs)) == brute
    monkeypatch.setattr(V, "PAGE_PAIRS", 0)
    assert rows(V.match_candidates(own, theirs)) == brute


def test_lines_of_both_sides_are_those_of_their_cells(spark, tmp_path):
    sf = table(spark, tmp_path)
    cells, muts = expected_cells(spark, sf), manifest(spark, sf)
    assert rows(printed_lines(spark, sf)) == rows(validation.line_texts(cells))
    ours, theirs = sides(spark, sf)[2], validation.line_texts(validation.actual_cells(cells, muts))
    assert rows(ours.drop("first")) == rows(theirs.drop("first"))
    plan = validation.actual_lines(printed_lines(spark, sf), muts)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan.split("Union")[0] and "pos#" not in plan.split("Union")[0]  # no cell is ordered


def test_math_pages_are_made_where_their_documents_are(spark, tmp_path):
    assert not moves(mathspans.pages(spark, table(spark, tmp_path)))


def test_boxes_off_target_are_found_on_their_row(spark, tmp_path):
    sf = table(spark, tmp_path)
    ours = E.QUERIES["u3_off_target"](spark, sf)
    boxes = E.rendered(spark, sf)
    theirs = V.off_target(boxes, boxes.where("c % 3 = 0"), boxes.where("c % 5 = 0"))
    plan = ours._jdf.queryExecution().executedPlan().toString()
    assert not moves(ours) and "Join" not in plan and ours.dtypes == theirs.dtypes and rows(ours) == rows(theirs)
    array = "array<struct<x0:double,top:double>>"
    listed = spark.createDataFrame([(1, 1, [(1.0, 2.0), (1.0, 2.0), (None, 2.0), (float("nan"), 1.0), (0.0, 1.0), (3.0, 1.0)], [(None, 2.0), (float("nan"), 1.0)], [(-0.0, 1.0)]), (1, 2, [(5.0, 5.0)], None, [])], f"doc_id long, page_no int, boxes {array}, required {array}, allowed {array}")
    side = lambda c: listed.select("doc_id", "page_no", F.inline(c))
    assert rows(V.off_target_on_rows(listed)) == rows(V.off_target(side("boxes"), side("required"), side("allowed")))
