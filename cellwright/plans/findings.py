"""Registered queries of the rules and findings family and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.operators import findings as R
from cellwright.plans.differences import BR, block_ranges
from cellwright.sources.testdata import expected_cells, layout_lines, manifest_in_place, source_blocks, sql

RULES = [("R1", "body", False, 2), ("R2", "body", True, 1), ("R3", "heading", False, 2), ("R4", "body", False, 1), ("R5", "list", True, 3)]
TYPE = "CASE (doc_id + seq) % 3 WHEN 0 THEN 'body' WHEN 1 THEN 'heading' ELSE 'list' END"
RESULT = "CASE (doc_id * 3 + seq * 5 + k) % 11 WHEN 0 THEN 'REVIEW' WHEN 1 THEN 'EXCLUDED' WHEN 2 THEN 'CORRECTED' ELSE 'PASS' END"
CATEGORY = "CASE (doc_id + seq) % 5 WHEN 0 THEN 'layout_only' WHEN 1 THEN 'literary' WHEN 2 THEN 'math' WHEN 3 THEN 'review' ELSE 'switch' END"


def typed(s, d):
    return source_blocks(s, d).withColumns({"source_type": F.expr(TYPE), "math": F.expr("seq % 2 = 0")})


def results(s, d):
    rows = source_blocks(s, d).where("(doc_id + seq) % 7 <> 0").withColumn("k", F.explode(F.expr("sequence(0, cast((doc_id + seq) % 3 AS int))")))
    return rows.select("doc_id", "page_no", "block_no", F.expr("concat('R', k)").alias("rule_id"), F.expr(RESULT).alias("status"), F.expr("concat('family', k)").alias("family"))


RES = f"res AS (SELECT doc_id, page_no, block_no, 'R' || k AS rule_id, {RESULT} AS status, 'family' || k AS family FROM (SELECT *, unnest(generate_series(0, (doc_id + seq) % 3)) AS k FROM blocks WHERE (doc_id + seq) % 7 <> 0))"
STAT = "st AS (SELECT doc_id, page_no, block_no, CASE coalesce(min(CASE status WHEN 'REVIEW' THEN 1 WHEN 'EXCLUDED' THEN 2 WHEN 'CORRECTED' THEN 3 WHEN 'PASS' THEN 4 END), 1) WHEN 1 THEN 'REVIEW' WHEN 2 THEN 'EXCLUDED' WHEN 3 THEN 'CORRECTED' ELSE 'PASS' END AS status FROM blocks LEFT JOIN res USING (doc_id, page_no, block_no) GROUP BY ALL)"


def muts(s, d):
    return manifest_in_place(s, d).withColumnRenamed("mutation_id", "diff_id")


def owned(s, d):
    return source_blocks(s, d).where("seq % 2 = 0").select("doc_id", "page_no", "block_no", F.col("seq").alias("diff_id"))


def inserts(s, d):
    return block_ranges(s, d).select("doc_id", F.col("seq").alias("diff_id"), F.expr("CASE WHEN doc_id % 2 = 0 THEN end ELSE start END").alias("expected_start"), F.expr("CASE WHEN seq % 3 = 0 THEN seq + 100 END").alias("owner"))


def sites(s, d):
    return expected_cells(s, d).where("mask IS NOT NULL AND pos % 3 = 0").select("doc_id", F.col("pos").alias("expected_start"), F.expr("pos % 2 = 0").alias("following_equal"))


def matches(s, d):
    rows = muts(s, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return rows.select("doc_id", "diff_id", F.expr("page_no + (expected_start + k) % 3").cast("int").alias("actual_page"))


def findings(s, d):
    status = F.expr("CASE WHEN expected_start % 5 = 0 THEN 'REVIEW' WHEN expected_start % 7 = 0 THEN 'EXCLUDED' ELSE 'ERROR' END")
    return muts(s, d).select("doc_id", "page_no", "expected_start", status.alias("status"))


FIND = "fi AS (SELECT doc_id, page_no, expected_start, CASE WHEN expected_start % 5 = 0 THEN 'REVIEW' WHEN expected_start % 7 = 0 THEN 'EXCLUDED' ELSE 'ERROR' END AS status FROM muts)"


def sourced(s, d):
    return source_blocks(s, d).select(F.expr("CASE doc_id % 3 WHEN 0 THEN 'translation' WHEN 1 THEN 'format' ELSE 'structure' END").alias("source"), F.expr("CASE WHEN seq % 4 = 0 THEN 'high' ELSE 'review' END").alias("confidence"), F.expr("length(text) % 5 = 0").alias("ignored"))


def categorized(s, d):
    return source_blocks(s, d).select("doc_id", F.expr(CATEGORY).alias("category"))


def sizes(s, d):
    return source_blocks(s, d).groupBy("doc_id").agg(F.sum(F.length("text")).alias("cells"))


def corrections(s, d):
    return source_blocks(s, d).select(
        F.concat_ws(":", "doc_id", "seq").alias("key"), F.expr("CASE WHEN seq % 9 = 0 THEN '' ELSE concat('c', seq) END").alias("id"), F.expr("CASE seq % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'both' WHEN 3 THEN '3' END").alias("grade"),
        F.expr("CASE doc_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' ELSE ' ' END").alias("category"), F.expr("CASE WHEN seq % 2 = 0 THEN 'book' END").alias("source"), F.expr("CASE WHEN seq % 4 = 0 THEN true WHEN seq % 4 = 2 THEN false END").alias("verified"),
    )


CORR = "co AS (SELECT doc_id || ':' || seq AS key, CASE WHEN seq % 9 = 0 THEN '' ELSE 'c' || seq END AS id, CASE seq % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'both' WHEN 3 THEN '3' END AS grade, CASE doc_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' ELSE ' ' END AS category, CASE WHEN seq % 2 = 0 THEN 'book' END AS source, CASE WHEN seq % 4 = 0 THEN true WHEN seq % 4 = 2 THEN false END AS verified FROM blocks)"
VIOL = """vi AS (SELECT key, 'missing_id' AS problem FROM co WHERE coalesce(trim(id), '') = '' UNION ALL SELECT key, 'missing_grade' FROM co WHERE coalesce(trim(grade), '') = '' UNION ALL SELECT key, 'missing_category' FROM co WHERE coalesce(trim(category), '') = ''
    UNION ALL SELECT key, 'bad_grade' FROM co WHERE grade NOT IN ('1', '2', 'both') UNION ALL SELECT key, 'bad_category' FROM co WHERE trim(category) <> '' AND category NOT IN ('A', 'B', 'C', 'D') UNION ALL SELECT key, 'unverified' FROM co WHERE category IN ('A', 'B', 'C') AND (source IS NULL OR NOT coalesce(verified, false)))"""


def translations(s, d):
    return source_blocks(s, d).where("length(text) % 3 <> 0").select(F.expr("CASE WHEN length(text) % 2 = 0 THEN 'one' ELSE 'two' END").alias("table_name"), "text", F.concat(F.lit('<'), 'text').alias("cells"))


QUERIES = {
    "j19_dispatch_rules": lambda s, d: R.dispatch_rules(typed(s, d), s.createDataFrame(RULES, "rule_id string, scope string, needs_math boolean, priority int")),
    "j20_attach_rule": lambda s, d: R.attach_rule(owned(s, d), results(s, d)),
    "j21_exclude_special_blocks": lambda s, d: R.exclude_special_blocks(owned(s, d), R.block_status(source_blocks(s, d), results(s, d))),
    "j22_adopt_previous_block": lambda s, d: R.adopt_previous_block(inserts(s, d), block_ranges(s, d)),
    "j26_capital_defects": lambda s, d: R.capital_defects(muts(s, d), sites(s, d)),
    "j27_displaced": lambda s, d: R.displaced(muts(s, d), matches(s, d)),
    "j34_lookup_translation": lambda s, d: R.lookup_translation(source_blocks(s, d).withColumn("table_name", F.lit("one")), translations(s, d)),
    "a5_doc_stats": lambda s, d: R.doc_stats(expected_cells(s, d), muts(s, d)),
    "a6_page_counts": lambda s, d: R.page_counts(findings(s, d)),
    "a7_accuracy": lambda s, d: R.accuracy(categorized(s, d), sizes(s, d)),
    "a8_report_totals": lambda s, d: R.report_totals(sourced(s, d)),
    "a9_rule_coverage": lambda s, d: R.rule_coverage(results(s, d)),
    "a17_block_status": lambda s, d: R.block_status(source_blocks(s, d), results(s, d)),
    "t4_number_findings": lambda s, d: R.number_findings(findings(s, d)),
    "u1_union_findings": lambda s, d: R.union_findings(findings(s, d).select("doc_id", "page_no", "status"), categorized(s, d), layout_lines(s, d).where("length(raw_line) > 44").select("doc_id", "page_no", F.lit("ERROR").alias("status"), F.lit("line_width").alias("category"))),
    "s10_correction_violations": lambda s, d: R.load_corrections(corrections(s, d))[1],
    "p15_corrections_for": lambda s, d: R.corrections_for(R.load_corrections(corrections(s, d))[0], "1", ["A", "B", "D"]).select("key", "grade", "category"),
}

ORACLE_SQL = {
    "j19_dispatch_rules": sql("blocks", f", t AS (SELECT *, {TYPE} AS source_type, seq % 2 = 0 AS math FROM blocks), r(rule_id, scope, needs_math, priority) AS (VALUES ('R1', 'body', false, 2), ('R2', 'body', true, 1), ('R3', 'heading', false, 2), ('R4', 'body', false, 1), ('R5', 'list', true, 3)) SELECT doc_id, page_no, block_no, rule_id, row_number() OVER (PARTITION BY doc_id, page_no, block_no ORDER BY priority, rule_id) AS turn FROM t JOIN r ON scope = source_type AND (NOT needs_math OR math)"),
    "j20_attach_rule": sql("blocks", f", {RES}, g AS (SELECT doc_id, page_no, block_no, arg_min(rule_id, (CASE status WHEN 'REVIEW' THEN '0' WHEN 'EXCLUDED' THEN '1' ELSE '2' END) || rule_id) AS rule_id FROM res GROUP BY ALL) SELECT b.doc_id, b.page_no, b.block_no, seq AS diff_id, rule_id FROM blocks b LEFT JOIN g ON g.doc_id = b.doc_id AND g.page_no = b.page_no AND g.block_no = b.block_no WHERE seq % 2 = 0"),
    "j21_exclude_special_blocks": sql("blocks", f", {RES}, {STAT} SELECT b.doc_id, b.page_no, b.block_no, seq AS diff_id FROM blocks b JOIN st USING (doc_id, page_no, block_no) WHERE seq % 2 = 0 AND status NOT IN ('REVIEW', 'EXCLUDED')"),
    "j22_adopt_previous_block": sql("blocks", f", {BR}, i AS (SELECT doc_id, seq AS diff_id, CASE WHEN doc_id % 2 = 0 THEN \"end\" ELSE start END AS expected_start, CASE WHEN seq % 3 = 0 THEN seq + 100 END AS owner FROM br) SELECT i.doc_id, diff_id, expected_start, coalesce(owner, seq) AS owner FROM i LEFT JOIN br ON br.doc_id = i.doc_id AND br.\"end\" = expected_start"),
    "j26_capital_defects": sql("lines cells muts", "SELECT doc_id, mutation_id AS diff_id, expected_start, CASE operation WHEN 'delete' THEN 'missing' WHEN 'substitute' THEN 'wrong' ELSE 'unnecessary' END AS defect FROM muts WHERE expected_start % 6 = 0 AND operation <> 'transpose'"),
    "j27_displaced": sql("lines cells muts", ", p AS (SELECT doc_id, mutation_id AS diff_id, page_no, list_sort(list_distinct([page_no + expected_start % 3, page_no + (expected_start + 1) % 3])) AS pages FROM muts) SELECT * FROM p WHERE NOT list_contains(pages, page_no)"),
    "j34_lookup_translation": sql("blocks", "SELECT doc_id, seq, CASE WHEN length(text) % 6 IN (2, 4) THEN '<' || text END AS cells, CASE WHEN length(text) % 6 IN (2, 4) THEN 'PASS' ELSE 'REVIEW' END AS status FROM blocks"),
    "a5_doc_stats": sql("lines cells muts", ", s AS (SELECT doc_id, count(*) AS expected_cells FROM cells GROUP BY doc_id), f AS (SELECT doc_id, count(*) AS differences, sum(len(expected_cells)) AS touched, count(*) FILTER (operation = 'substitute') AS substitute, count(*) FILTER (operation = 'delete') AS \"delete\", count(*) FILTER (operation = 'insert') AS \"insert\", count(*) FILTER (operation = 'transpose') AS transpose FROM muts GROUP BY doc_id) SELECT doc_id, expected_cells, coalesce(differences, 0) AS differences, coalesce(touched, 0) AS touched, coalesce(substitute, 0) AS substitute, coalesce(\"delete\", 0) AS \"delete\", coalesce(\"insert\", 0) AS \"insert\", coalesce(transpose, 0) AS transpose, (expected_cells - coalesce(touched, 0)) / expected_cells AS accuracy FROM s LEFT JOIN f USING (doc_id)"),
    "a6_page_counts": sql("lines cells muts", f", {FIND} SELECT doc_id, page_no, count(*) FILTER (status = 'ERROR') AS \"ERROR\", count(*) FILTER (status = 'REVIEW') AS \"REVIEW\", count(*) FILTER (status = 'EXCLUDED') AS \"EXCLUDED\" FROM fi GROUP BY ALL"),
    "a7_accuracy": sql("blocks", f", c AS (SELECT doc_id, length(text) AS n, {CATEGORY} AS category FROM blocks), g AS (SELECT doc_id, sum(n) AS cells, count(*) FILTER (category IN ('literary', 'math')) AS true_differences, count(*) AS all_differences FROM c GROUP BY doc_id) SELECT *, CASE WHEN cells = 0 THEN 1.0 ELSE 1 - least(true_differences, cells) / cells END AS accuracy FROM g"),
    "a8_report_totals": sql("blocks", ", f AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'translation' WHEN 1 THEN 'format' ELSE 'structure' END AS source, CASE WHEN seq % 4 = 0 THEN 'high' ELSE 'review' END AS confidence, length(text) % 5 = 0 AS ignored FROM blocks) SELECT source, confidence, grouping_id(source, confidence) AS level, count(*) AS n, sum(CASE WHEN ignored THEN 1 ELSE 0 END) AS ignored FROM f GROUP BY ROLLUP (source, confidence)"),
    "a9_rule_coverage": sql("blocks", f", {RES} SELECT family, count(*) FILTER (status = 'REVIEW') AS \"REVIEW\", count(*) FILTER (status = 'EXCLUDED') AS \"EXCLUDED\", count(*) FILTER (status = 'CORRECTED') AS \"CORRECTED\", count(*) FILTER (status = 'PASS') AS \"PASS\" FROM res GROUP BY family"),
    "a17_block_status": sql("blocks", f", {RES}, {STAT} SELECT * FROM st"),
    "t4_number_findings": sql("lines cells muts", f", {FIND} SELECT doc_id, page_no, expected_start, status, CASE WHEN status = 'ERROR' THEN 'E' ELSE 'R' END || lpad(CAST(row_number() OVER (PARTITION BY doc_id, status = 'ERROR' ORDER BY page_no, expected_start) AS VARCHAR), 5, '0') AS issue_id FROM fi"),
    "u1_union_findings": sql("lines blocks cells muts", f", {FIND} SELECT doc_id, page_no, status, NULL AS category FROM fi UNION ALL SELECT doc_id, NULL, NULL, {CATEGORY} FROM blocks UNION ALL SELECT doc_id, page_no, 'ERROR', 'line_width' FROM lines WHERE length(raw_line) > 44"),
    "s10_correction_violations": sql("blocks", f", {CORR}, {VIOL} SELECT * FROM vi"),
    "p15_corrections_for": sql("blocks", f", {CORR}, {VIOL} SELECT key, grade, category FROM co WHERE key NOT IN (SELECT key FROM vi) AND grade IN ('1', 'both') AND category IN ('A', 'B', 'D')"),
}
