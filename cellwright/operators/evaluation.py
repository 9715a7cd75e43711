"""Scoring findings against a mutation manifest, and coverage of audit cases.

Mutations are (doc_id, page_no, mut_id, operation, family, start, end, boxes), findings (doc_id,
page_no, find_id, operation, start, end, boxes); boxes are their places on the page as an array
of (line, cell).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = ["doc_id", "page_no"]
REACH = 4


def repair_swapped(rows: DataFrame, number: str, text: str) -> DataFrame:
    """Where two columns were swapped, told by their contents, swap them back."""
    swapped = ~F.col(number).rlike("^[0-9]+$") & F.col(text).rlike("^[0-9]+$")
    return rows.withColumns({"repaired": swapped, number: F.when(swapped, F.col(text)).otherwise(F.col(number)), text: F.when(swapped, F.col(number)).otherwise(F.col(text))})


#: Pairs of a page up to which all are compared where they are; beyond it they meet by keys.
PAGE_PAIRS = 1 << 14
CANDIDATES = T.ArrayType(T.StructType().add("find_id", "string").add("score", "long").add("f0", "long"))
MET = T.ArrayType(T.StructType().add("start", "long").add("mut_id", "string").add("cands", CANDIDATES))


@F.pandas_udf(MET)
def meet_by_keys(muts: pd.Series, finds: pd.Series) -> pd.Series:
    """J28 of large pages: findings met by operation and blocks of nine starts, or boxes; null for the pages that are none."""
    width = 2 * REACH + 1

    def meet(muts, finds) -> list[dict]:
        places = [{tuple(b.values()) for b in f["boxes"]} for f in finds]
        keyed: dict[tuple, list[int]] = {}
        for k, f in enumerate(finds):
            for key in (("near", f["start"] // width), *places[k]):
                keyed.setdefault((f["operation"], key), []).append(k)
        out = []
        for m in muts:
            own, start, block = {tuple(b.values()) for b in m["boxes"]}, m["start"], m["start"] // width
            near = (k for n in (block - 1, block, block + 1) for k in keyed.get((m["operation"], ("near", n)), ()) if abs(start - finds[k]["start"]) <= REACH)
            cands = []
            for k in dict.fromkeys((*near, *(k for box in own for k in keyed.get((m["operation"], box), ())))):
                f = finds[k]
                score = 4 * (bool(own) and own == places[k]) + 2 * (start == f["start"] and m["end"] == f["end"]) + (not own.isdisjoint(places[k]))
                cands.append({"find_id": f["find_id"], "score": int(score), "f0": f["start"]})
            out.append({"start": start, "mut_id": m["mut_id"], "cands": cands})
        return sorted(out, key=lambda m: (m["start"], m["mut_id"]))

    return pd.Series([None if m is None else meet(m, f) for m, f in zip(muts, finds, strict=True)])


def pages_of(muts: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, page_no, muts, finds): the mutations and the findings of each page on one row."""
    side = lambda df, name, own: df.select(*PAGE, F.struct(own, "operation", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "boxes").alias(name))
    rows = side(muts, "m", "mut_id").unionByName(side(findings, "f", "find_id"), allowMissingColumns=True)
    return rows.groupBy(*PAGE).agg(F.collect_list("m").alias("muts"), F.collect_list("f").alias("finds"))


def meet_on_pages(pages: DataFrame) -> DataFrame:
    """J28 of ``pages_of``: ``met``, the mutations in order as (start, mut_id, cands), cands being (find_id, score, f0) with the finding's start.

    Pairs are compared on their page's row and never become rows of their own.
    """
    same = "array_sort(array_distinct(m.boxes)) = array_sort(array_distinct(f.boxes))"
    shared = "size(array_intersect(m.boxes, f.boxes)) > 0"
    score = f"4 * cast(size(m.boxes) > 0 AND {same} AS bigint) + 2 * cast(m.start = f.start AND m.end = f.end AS bigint) + cast({shared} AS bigint)"
    met = f"filter(finds, f -> f.operation = m.operation AND (abs(m.start - f.start) <= {REACH} OR {shared}))"
    here = F.expr(f"array_sort(transform(muts, m -> named_struct('start', m.start, 'mut_id', m.mut_id, 'cands', transform({met}, f -> named_struct('find_id', f.find_id, 'score', {score}, 'f0', f.start)))))")
    large = F.size("muts").cast("long") * F.size("finds") > PAGE_PAIRS
    return pages.withColumn("keyed", meet_by_keys(F.when(large, F.col("muts")), F.when(large, F.col("finds")))).withColumn("met", F.when(large, F.col("keyed")).otherwise(here)).drop("keyed")


def page_candidates(pages: DataFrame) -> DataFrame:
    """J28's rows of ``pages_of``."""
    rows = meet_on_pages(pages).select(*PAGE, F.explode("met").alias("m"))
    return rows.select(*PAGE, "m.mut_id", "m.start", F.explode("m.cands").alias("c")).select(*PAGE, "mut_id", "c.find_id", "start", "c.score")


def match_candidates(muts: DataFrame, findings: DataFrame) -> DataFrame:
    """Pairs of one operation whose starts are within ±4 or that share a box, scored 4·equal boxes + 2·equal span + shared box.

    ``validation.candidates`` adds proofs and pages.
    """
    return page_candidates(pages_of(muts, findings))


def unique_best(cands: DataFrame, key: str = "mut_id") -> DataFrame:
    """The best candidate of each key, with a flag where the best score is tied."""
    own = Window.partitionBy("doc_id", key)
    ranked = cands.withColumn("r", F.rank().over(own.orderBy(F.col("score").desc())))
    best = ranked.where("r = 1").withColumn("tied", F.count("*").over(own) > 1)
    return best.groupBy("doc_id", key).agg(F.min("find_id").alias("find_id"), F.max("score").alias("score"), F.max("tied").alias("tied"))


def assign_findings(muts: DataFrame, cands: DataFrame) -> DataFrame:
    """One-to-one in order of mutations on each page: DETECTED, AMBIGUOUS where the best score is tied, MISSED."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, page_no, cands in zip(batch["doc_id"], batch["page_no"], batch["cands"], strict=True):
                used: set[str] = set()
                for (_, mut), group in groupby(sorted(cands, key=lambda c: (c["start"], c["mut_id"])), key=lambda c: (c["start"], c["mut_id"])):
                    free = [c for c in group if c["find_id"] is not None and c["find_id"] not in used]
                    top = max((c["score"] for c in free), default=None)
                    best = [c["find_id"] for c in free if c["score"] == top]
                    state = "MISSED" if not best else "DETECTED" if len(best) == 1 else "AMBIGUOUS"
                    chosen = best[0] if state == "DETECTED" else None
                    used |= {chosen} - {None}
                    out.append((doc_id, page_no, mut, chosen, state))
            yield pd.DataFrame(out, columns=[*PAGE, "mut_id", "find_id", "state"])

    rows = muts.select(*PAGE, "mut_id", "start").join(cands.drop("start"), [*PAGE, "mut_id"], "left")
    pages = rows.groupBy(*PAGE).agg(F.collect_list(F.struct("start", "mut_id", "find_id", "score")).alias("cands"))  # one page
    return pages.mapInPandas(assign, "doc_id long, page_no int, mut_id string, find_id string, state string")


OUTCOMES = "array<struct<mut_id:string,find_id:string,state:string,exact:boolean>>"


def assign_on_pages(pages: DataFrame) -> DataFrame:
    """J29 of ``meet_on_pages``: ``outcomes``, the page's mutations as (mut_id, find_id, state, exact), exact where the finding starts with its mutation."""
    free = "filter(m.cands, c -> c.find_id IS NOT NULL AND NOT array_contains(s.used, c.find_id))"
    best = "filter(free, c -> c.score = array_max(transform(free, d -> d.score)))"
    chosen = "CASE WHEN size(best) = 1 THEN best[0] END"
    state = "CASE size(best) WHEN 0 THEN 'MISSED' WHEN 1 THEN 'DETECTED' ELSE 'AMBIGUOUS' END"
    outcome = f"named_struct('mut_id', m.mut_id, 'find_id', ({chosen}).find_id, 'state', {state}, 'exact', coalesce(({chosen}).f0 = m.start, false))"
    step = f"named_struct('used', concat(s.used, transform(filter(best, b -> size(best) = 1), b -> b.find_id)), 'out', concat(s.out, array({outcome})))"
    first = f"named_struct('used', cast(array() AS array<string>), 'out', cast(array() AS {OUTCOMES}))"
    here = F.expr(f"aggregate(met, {first}, (s, m) -> transform(array({free}), free -> transform(array({best}), best -> {step})[0])[0], s -> s.out)")
    return pages.withColumn("outcomes", here)


def page_quality(pages: DataFrame) -> DataFrame:
    """A11 of ``assign_on_pages``: ``quality`` of the detected, counted on each page's row; finding ids are unique in a document."""
    found = F.filter("outcomes", lambda o: o["state"] == "DETECTED")
    stray = F.array_except(F.transform("finds", lambda f: f["find_id"]), F.transform(found, lambda o: o["find_id"]))
    rows = pages.select("doc_id", F.size("muts").alias("injected"), F.size(found).alias("detected"), F.size(F.filter(found, lambda o: o["exact"])).alias("exact"), F.size(stray).alias("false_positives"))
    total = rows.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in rows.columns[1:])).where("injected > 0")
    return total.withColumn("missed", F.col("injected") - F.col("detected"))


def run_equivalence(muts: DataFrame, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Findings credited to mutations of the same operation inside one run of equal cells (deletions also to the cell after it); runs are (doc_id, page_no, run, first, last)."""
    at = runs.select(*PAGE, "run", F.explode(F.expr("sequence(first, last + 1)")).alias("pos"), "last")
    m = muts.join(at, [F.col("start") == F.col("pos"), *(muts[k] == at[k] for k in PAGE)]).where("pos <= last").select(*(muts[k] for k in PAGE), "mut_id", "operation", "run")
    f = findings.join(at, [F.col("start") == F.col("pos"), *(findings[k] == at[k] for k in PAGE)]).where("pos <= last OR operation = 'delete'").select(*(findings[k] for k in PAGE), "find_id", "operation", "run")
    return m.join(f, [*PAGE, "operation", "run"]).where(F.col("operation").isin("insert", "delete")).select(*PAGE, "mut_id", "find_id").distinct()


def grouped_deletions(findings: DataFrame, muts: DataFrame) -> DataFrame:
    """Deletions of k adjacent cells credit all k mutations only if every one is in the manifest."""
    cells = findings.where("operation = 'delete' AND end - start > 1").select("doc_id", "find_id", (F.col("end") - F.col("start")).alias("k"), F.explode(F.expr("sequence(start, end - 1)")).alias("start"))
    hit = cells.join(muts.where("operation = 'delete'").select("doc_id", "start", "mut_id"), ["doc_id", "start"])
    whole = hit.groupBy("doc_id", "find_id").agg(F.count("*").alias("n"), F.max("k").alias("k"), F.array_sort(F.collect_list("mut_id")).alias("mut_ids"))
    return whole.where("n = k").select("doc_id", "find_id", "mut_ids")


def attribute_case(diffs: DataFrame, spans: DataFrame) -> DataFrame:
    """The case whose span (case_id, start, end) holds a difference, else the one of nearest start; spans do not overlap."""
    s = spans.select("doc_id", F.col("start").alias("at"), F.struct("start", "end", "case_id").alias("s"), F.lit(0).alias("o"), F.lit(None).cast("string").alias("diff_id"))
    d = diffs.select("doc_id", F.col("start").alias("at"), F.lit(None).cast(s.schema["s"].dataType).alias("s"), F.lit(1).alias("o"), "diff_id")
    order = Window.partitionBy("doc_id").orderBy("at", "o")
    rows = s.unionByName(d).withColumns({"b": F.last("s", ignorenulls=True).over(order), "a": F.first("s", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    inside = F.col("at") < F.col("b.end")
    nearer = F.col("a").isNull() | (F.col("at") - F.col("b.start") <= F.col("a.start") - F.col("at"))
    case = F.when(F.col("b").isNotNull() & (inside | nearer), F.col("b.case_id")).otherwise(F.col("a.case_id"))
    return rows.where("o = 1").select("doc_id", "diff_id", F.col("at").alias("start"), case.alias("case_id"))


def citation_coverage(scope: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases of each required citation: equal to it or extending it by a dot, by an equi-join on all dotted prefixes."""
    parts = F.split("citation", "[.]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    each = cases.select("case_id", F.explode(prefixes).alias("required"))
    return scope.join(each, "required").groupBy("required").agg(F.count("*").alias("cases"))


def coverage_closure(scope: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per required citation COVERED with positive and negative evidence, PARTIAL with some, UNTESTED without; and its number of tests."""
    any_of = lambda k: F.coalesce(F.bool_or(F.col("kind") == k), F.lit(False))
    out = scope.join(evidence, "required", "left").groupBy("required").agg(any_of("positive").alias("p"), any_of("negative").alias("n"), F.count_distinct("test_id").alias("tests"))
    status = F.when(F.col("p") & F.col("n"), "COVERED").when(F.col("tests") > 0, "PARTIAL").otherwise("UNTESTED")
    return out.select("required", status.alias("status"), "tests")


def audit_outcomes(cases: DataFrame) -> DataFrame:
    """Outcome of each case (expected, accepted, provisional, actual) and counts by family."""
    outcome = (
        F.when(F.col("actual") == F.col("expected"), "exact").when(F.array_contains(F.split("accepted", "[|]"), F.col("actual")), "accepted")
        .when(F.col("provisional"), "provisional").otherwise("fail")
    )
    return cases.withColumn("outcome", outcome).groupBy("family").pivot("outcome", ["exact", "accepted", "provisional", "fail"]).count().fillna(0)


def explode_variants(cases: DataFrame) -> DataFrame:
    """one row for each pipe-joined accepted variant."""
    return cases.select("case_id", F.posexplode(F.split("accepted", "[|]")).alias("n", "variant"))


def evaluation_summary(outcomes: DataFrame) -> DataFrame:
    """A10: counts of states overall, by family, by operation and by both."""
    return outcomes.cube("family", "operation", "state").agg(F.grouping_id().alias("level"), F.count("*").alias("n")).where("level % 2 = 0")


def quality(muts: DataFrame, outcomes: DataFrame, findings: DataFrame) -> DataFrame:
    """Per document injected, detected and missed mutations, findings without a mutation, and exact starts."""
    rows = muts.join(outcomes.select("doc_id", "mut_id", "find_id"), ["doc_id", "mut_id"], "left")
    starts = findings.select("doc_id", "find_id", F.col("start").alias("f0"))
    rows = rows.join(starts, ["doc_id", "find_id"], "left")
    injected = rows.groupBy("doc_id").agg(F.count("*").alias("injected"), F.count("find_id").alias("detected"), F.count(F.when(F.col("start") == F.col("f0"), 1)).alias("exact"))
    stray = findings.join(outcomes.where("find_id IS NOT NULL"), ["doc_id", "find_id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("false_positives"))
    return injected.join(stray, "doc_id", "left").fillna(0).withColumn("missed", F.col("injected") - F.col("detected"))


def first_n(rows: DataFrame, keys: list[str], order: list[str], n: int = 5) -> DataFrame:
    """T5: the first n rows of each key."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= n).drop("r")


def geometry_relation(a: Column, b: Column) -> Column:
    """Equal, overlap or apart, of two arrays of rounded boxes."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0), "equal").when(common > 0, "overlap").otherwise("apart")


def off_target(boxes: DataFrame, required: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rendered boxes that are neither required nor allowed."""
    keys = [*PAGE, "x0", "top"]
    return boxes.join(required.select(*keys), keys, "left_anti").join(allowed.select(*keys), keys, "left_anti")


def off_target_on_rows(rows: DataFrame) -> DataFrame:
    """U3 of rows (doc_id, page_no, boxes, required, allowed), arrays with x0 and top: boxes meet on their row only, so that none moves.

    A box without a place is neither required nor allowed.
    """
    meets = lambda others: f"coalesce(exists({others}, o -> o.x0 = b.x0 AND o.top = b.top), false)"
    off = F.expr(f"filter(boxes, b -> NOT {meets('required')} AND NOT {meets('allowed')})")
    return rows.select("doc_id", "page_no", F.inline(off))
