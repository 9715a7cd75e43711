"""Rules, findings and reports.

Blocks are (doc_id, page_no, block_no, ...), rule results (doc_id, page_no, block_no, rule_id,
status), differences (doc_id, page_no, block_no, expected_start, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = ["doc_id", "page_no", "block_no"]
#: Statuses from worst to best.
SEVERITY = ("REVIEW", "EXCLUDED", "CORRECTED", "PASS")


def _doc():
    return Window.partitionBy("doc_id")


def dispatch_rules(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (rule_id, scope, needs_math, priority) for each block (source_type, math), in order of priority and id."""
    met = blocks.join(rules, F.col("scope") == F.col("source_type")).where("NOT needs_math OR math")
    order = Window.partitionBy(*BLOCK).orderBy("priority", "rule_id")
    return met.select(*BLOCK, "rule_id", F.row_number().over(order).alias("turn"))


def block_status(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """Worst status of each block's rule results; a block without any goes to review."""
    rank = F.array_position(F.array(*(F.lit(s) for s in SEVERITY)), F.col("status"))
    worst = results.groupBy(*BLOCK).agg(F.min(rank).alias("r"))
    status = F.get(F.array(*(F.lit(s) for s in SEVERITY)), (F.coalesce("r", F.lit(1)) - 1).cast("int"))
    return blocks.select(*BLOCK).join(worst, BLOCK, "left").select(*BLOCK, status.alias("status"))


def attach_rule(diffs: DataFrame, results: DataFrame) -> DataFrame:
    """Each difference with its block's governing rule: a review first, then an exclusion, then the first."""
    precedence = F.struct(F.when(F.col("status") == "REVIEW", 0).when(F.col("status") == "EXCLUDED", 1).otherwise(2).alias("p"), F.col("rule_id"))
    rule = results.groupBy(*BLOCK).agg(F.min(precedence).alias("g"))
    return diffs.join(rule, BLOCK, "left").select(*diffs.columns, F.col("g.rule_id").alias("rule_id"))


def exclude_special_blocks(diffs: DataFrame, statuses: DataFrame) -> DataFrame:
    """Differences that no review or excluded block owns."""
    return diffs.join(statuses.where("status IN ('REVIEW', 'EXCLUDED')"), BLOCK, "left_anti")


def adopt_previous_block(inserts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Insertions without an owner take the block that ends just before them; blocks are (doc_id, seq, start, end)."""
    ends = blocks.select("doc_id", F.col("end").alias("expected_start"), "seq")
    return inserts.join(ends, ["doc_id", "expected_start"], "left").select("doc_id", "diff_id", "expected_start", F.coalesce("owner", "seq").alias("owner"))


def capital_defects(diffs: DataFrame, sites: DataFrame) -> DataFrame:
    """Differences at capital sites (doc_id, expected_start, following_equal): missing, wrong or unnecessary sign."""
    kind = F.when(F.col("operation") == "delete", "missing").when(F.col("operation") == "substitute", "wrong").when(F.col("operation") == "insert", "unnecessary")
    return diffs.join(sites.where("following_equal"), ["doc_id", "expected_start"]).select("doc_id", "diff_id", "expected_start", kind.alias("defect")).where("defect IS NOT NULL")


def displaced(diffs: DataFrame, matches: DataFrame) -> DataFrame:
    """Differences all of whose matched cells lie on other pages than their own; matches are (doc_id, diff_id, actual_page)."""
    pages = matches.groupBy("doc_id", "diff_id").agg(F.array_sort(F.collect_set("actual_page")).alias("pages"))
    return diffs.join(pages, ["doc_id", "diff_id"]).where(~F.array_contains("pages", F.col("page_no"))).select("doc_id", "diff_id", "page_no", "pages")


def lookup_translation(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """Expected cells by lookup of (table_name, text); misses go to review."""
    keyed = table.select("table_name", F.xxhash64("text").alias("h"), "text", "cells").dropDuplicates(["table_name", "text"])
    out = blocks.withColumn("h", F.xxhash64("text")).join(keyed, ["table_name", "h", "text"], "left")
    return out.select("doc_id", "seq", "cells", F.when(F.col("cells").isNull(), "REVIEW").otherwise("PASS").alias("status"))


def doc_stats(cells: DataFrame, diffs: DataFrame) -> DataFrame:
    """A5: expected and differing cells, accuracy and differences by operation of each document."""
    size = cells.groupBy("doc_id").agg(F.count("*").alias("expected_cells"))
    count = lambda op: F.count(F.when(F.col("operation") == op, 1)).alias(op)
    found = diffs.groupBy("doc_id").agg(F.count("*").alias("differences"), F.sum(F.size("expected_cells")).alias("touched"), *(count(o) for o in ("substitute", "delete", "insert", "transpose")))
    out = size.join(found, "doc_id", "left").fillna(0)
    return out.withColumn("accuracy", (F.col("expected_cells") - F.col("touched")) / F.col("expected_cells"))


def page_counts(findings: DataFrame) -> DataFrame:
    """Findings of each status on each page."""
    return findings.groupBy("doc_id", "page_no").pivot("status", ["ERROR", "REVIEW", "EXCLUDED"]).count().fillna(0)


#: Categories that are no true difference.
IGNORED = ("layout_only", "spacing_only", "review", "excluded", "numeric_sign_guard", "switch")


def accuracy(diffs: DataFrame, sizes: DataFrame) -> DataFrame:
    """True differences and accuracy; a document without cells has accuracy 1."""
    true = F.sum(F.when(F.col("category").isin(*IGNORED), 0).otherwise(1))
    found = diffs.groupBy("doc_id").agg(true.alias("true_differences"), F.count("*").alias("all_differences"))
    out = sizes.join(found, "doc_id", "left").fillna(0)
    return out.withColumn("accuracy", F.when(F.col("cells") == 0, 1.0).otherwise(1 - F.least("true_differences", "cells") / F.col("cells")))


def report_totals(findings: DataFrame) -> DataFrame:
    """Counts by source and confidence, with totals of each source and of all."""
    totals = findings.rollup("source", "confidence").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(F.col("ignored").cast("long")).alias("ignored"))
    return totals


def rule_coverage(results: DataFrame) -> DataFrame:
    """Results of each family by status."""
    return results.groupBy("family").pivot("status", list(SEVERITY)).count().fillna(0)


def number_findings(findings: DataFrame) -> DataFrame:
    """T4: ids of findings: errors by their place among all differences, reviews and exclusions by their joint order."""
    kind = F.when(F.col("status") == "ERROR", "E").otherwise("R")
    order = Window.partitionBy("doc_id", "kind").orderBy("page_no", "expected_start")
    return findings.withColumn("kind", kind).withColumn("issue_id", F.concat("kind", F.lpad(F.row_number().over(order).cast("string"), 5, "0"))).drop("kind")


def union_findings(*parts: DataFrame) -> DataFrame:
    """Findings of several sources in one schema; what a source lacks is null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def load_corrections(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, violations) of correction rows: id, grade and category are required and known, A-C need source and verified."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    problems = F.array_compact(
        F.array(
            *(F.when(blank(c), F.lit(f"missing_{c}")) for c in ("id", "grade", "category")),
            F.when(~blank("grade") & ~F.col("grade").isin("1", "2", "both"), "bad_grade"),
            F.when(~blank("category") & ~F.col("category").isin("A", "B", "C", "D"), "bad_category"),
            F.when(F.col("category").isin("A", "B", "C") & (blank("source") | ~F.coalesce("verified", F.lit(False))), "unverified"),
        )
    )
    checked = rows.withColumn("problems", problems)
    return checked.where("size(problems) = 0").drop("problems"), checked.select("key", F.explode("problems").alias("problem"))


def corrections_for(corrections: DataFrame, grade: str, categories: list[str]) -> DataFrame:
    """Corrections of a grade (``both`` fits any) and categories."""
    return corrections.where(F.col("grade").isin(grade, "both") & F.col("category").isin(*categories))
