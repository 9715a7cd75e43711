"""Differences: their class, place and owner, and the marks of math.

Differences are (doc_id, diff_id, expected_start, expected_end, actual_start, actual_end,
expected, actual, ...); blocks and pages are half-open ranges of the document stream.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.operators.mathspans import ordered_matching

#: Bucket of positions for interval joins.
BUCKET = 256
#: Cells of marks whose lone differences are ignored.
AMBIGUOUS = "'\"`,;:.*?0 7 8"


def _doc():
    return Window.partitionBy("doc_id")


def mismatch_class(expected: Column, actual: Column, tag: Column) -> Column:
    """F16: severity: insertions and deletions 3; one word a side of equal length with at most two differing cells 1, else 2; equal word counts 2; structural 4."""
    e, a = F.split(expected, " "), F.split(actual, " ")
    cells = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    differing = F.size(F.filter(F.arrays_zip(cells(expected).alias("x"), cells(actual).alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"])))
    single = (F.size(e) == 1) & (F.size(a) == 1)
    return (
        F.when(tag.isin("insert", "delete"), 3).when(single & (F.length(expected) == F.length(actual)) & (differing <= 2), 1).when(single, 2)
        .when(F.size(e) == F.size(a), 2).otherwise(4)
    )


def difference_category(tag: Column, expected: Column, actual: Column, status: Column, payload: Column, math: Column, numeric: Column) -> Column:
    """the category of a difference by its cells and by what is known of the block that owns it.

    In order of precedence: only blanks differ; only spacing differs; the block is under review, or
    excluded (null where no block owns the place); expected cells inside a recognized math
    record; a number sign inserted beside prose, where neither math nor a numeric rule
    (``numeric``) accounts for it; a switch, or in a block with math one of its cells; math; else literary.
    """
    bare = lambda c: F.translate(c, " ", "")
    owned = status.isNotNull()
    beside_prose = (tag == "insert") & (expected == "") & owned & ~math & ~numeric & F.contains(actual, F.lit("#"))
    both = F.concat(expected, F.lit("\n"), actual)
    switch = both.rlike("_%|_:") | (math & both.rlike("[_%:]"))
    return (
        F.when((bare(expected) == "") & (bare(actual) == ""), "layout_only").when(bare(expected) == bare(actual), "spacing_only")
        .when(status == "REVIEW", "review").when(status == "EXCLUDED", "excluded").when(payload & (expected != ""), "math_payload")
        .when(F.coalesce(beside_prose, F.lit(False)), "numeric_sign_guard").when(switch, "switch").when(math, "math").otherwise("literary")
    )


def location_label(l0: Column, w0: Column, l1: Column, w1: Column) -> Column:
    """words as a place: one word, one line, or two lines."""
    return (
        F.when((l0 == l1) & (w0 == w1), F.format_string("line %d, word %d", l0, w0)).when(l0 == l1, F.format_string("line %d, words %d-%d", l0, w0, w1))
        .otherwise(F.format_string("line %d, word %d to line %d, word %d", l0, w0, l1, w1))
    )


def unspaced_equals(word: Column) -> Column:
    """the suggested spacing of a comparison sign inside a word, null if there is none."""
    return F.when(word.rlike("[^=<>]=[^=<>]"), F.regexp_replace(word, "([^=<> ])=([^=<> ])", "$1 = $2"))


def ignorable(expected: Column, actual: Column) -> Column:
    """One or two ambiguous marks on both sides, one word each, or an unresolved escape on the expected side."""
    marks = lambda c: F.length(c).between(1, 2) & (F.translate(c, AMBIGUOUS, "") == "") & (F.btrim(c) != "") & ~F.btrim(c).contains(" ")
    return (marks(expected) & marks(actual)) | expected.rlike("(?i)\\\\X[0-9A-F]{4,}")


def apply_allowlist(diffs: DataFrame, allowed: DataFrame) -> DataFrame:
    """P10: drop differences that an entry (expected, actual) allows, exactly or in the one word in which the entry's texts differ."""
    e, a = F.split("expected", " "), F.split("actual", " ")
    zipped = F.filter(F.arrays_zip(e.alias("x"), a.alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"]))
    entries = allowed.withColumn("d", F.when(F.size(e) == F.size(a), zipped))
    words = entries.where("size(d) = 1").select(F.col("d")[0]["x"].alias("expected"), F.col("d")[0]["y"].alias("actual"))
    both = allowed.select("expected", "actual").unionByName(words).distinct()
    return diffs.join(both, ["expected", "actual"], "left_anti")


def locate_block(offsets: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block that owns each offset (doc_id, at), or null at separators: an as-of window, no range join."""
    starts = blocks.select("doc_id", F.col("start").alias("at"), F.struct("start", "end", "seq").alias("b"), F.lit(0).alias("o"), F.lit(None).cast("long").alias("id"))
    points = offsets.select("doc_id", "at", F.lit(None).cast(starts.schema["b"].dataType).alias("b"), F.lit(1).alias("o"), F.col("id").cast("long"))
    rows = starts.unionByName(points).withColumn("b", F.last("b", ignorenulls=True).over(_doc().orderBy("at", "o")))
    return rows.where("o = 1").select("doc_id", "id", "at", F.when(F.col("at") < F.col("b.end"), F.col("b.seq")).alias("seq"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of half-open ranges (start, end) and (r0, r1) that meet, by an equi-join on buckets; each pair once.

    A zero-width range meets the range it stands in.
    """
    b = lambda lo, hi: F.explode(F.expr(f"sequence(cast({lo} div {BUCKET} AS bigint), cast(greatest({hi} - 1, {lo}) div {BUCKET} AS bigint))"))
    x = left.withColumn("bucket", b("start", "end"))
    y = right.withColumn("bucket", b("r0", "r1"))
    met = x.join(y, [*keys, "bucket"]).where("start < r1 AND (r0 < end OR (start = end AND r0 <= start))")
    return met.where(f"bucket = cast(greatest(start, r0) div {BUCKET} AS bigint)").drop("bucket")


def split_to_pages(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Document spans (doc_id, id, start, end) as page-local ranges; pages are (doc_id, page_no, r0, r1)."""
    met = overlapping(spans, pages, ["doc_id"])
    return met.select("doc_id", "id", "page_no", (F.greatest("start", "r0") - F.col("r0")).alias("p0"), (F.least("end", "r1") - F.col("r0")).alias("p1"))


def project_span(spans: DataFrame, opcodes: DataFrame) -> DataFrame:
    """Expected spans to actual ranges through opcodes (e0, e1, a0, a1): least start and greatest end of what overlaps."""
    ops = opcodes.select("doc_id", "region", F.col("e0").alias("r0"), F.col("e1").alias("r1"), "a0", "a1", "tag")
    met = overlapping(spans, ops, ["doc_id", "region"])
    inside = lambda edge: F.when(F.col("tag") == "equal", F.col("a0") + edge - F.col("r0"))
    lo = F.coalesce(inside(F.greatest("start", "r0")), F.col("a0"))
    hi = F.coalesce(inside(F.least("end", "r1")), F.col("a1"))
    return met.groupBy("doc_id", "region", "id").agg(F.min(lo).alias("a0"), F.max(hi).alias("a1"))


def group_consecutive(diffs: DataFrame) -> DataFrame:
    """Consecutive differences of one (page_no, family); punctuation stands alone."""
    own = _doc().orderBy("expected_start")
    new = (~F.lag("page_no").over(own).eqNullSafe(F.col("page_no"))) | (~F.lag("family").over(own).eqNullSafe(F.col("family"))) | (F.col("family") == "punctuation")
    rows = diffs.withColumn("group_no", F.sum(new.cast("int")).over(own))
    return rows.groupBy("doc_id", "group_no").agg(F.first("page_no").alias("page_no"), F.first("family").alias("family"), F.count("*").alias("n"), F.min("expected_start").alias("first"), F.max("expected_start").alias("last"))


def collapse_transpositions(diffs: DataFrame) -> DataFrame:
    """An insertion next to a deletion in one block, starts within 1, is one substitution; a row is used once.

    Pairs form chains of neighbours; within a chain the odd places open a pair.
    """
    own = Window.partitionBy("doc_id", "page_no").orderBy("expected_start", "diff_id")
    pairs = F.array_sort(F.array(F.col("operation"), F.lead("operation").over(own))) == F.array(F.lit("delete"), F.lit("insert"))
    joins = F.coalesce(pairs & (F.lead("block").over(own) == F.col("block")) & (F.abs(F.lead("expected_start").over(own) - F.col("expected_start")) <= 1), F.lit(False))
    rows = diffs.withColumn("joins", joins)
    rows = rows.withColumn("chain", F.sum((~F.coalesce(F.lag("joins").over(own), F.lit(False))).cast("int")).over(own))
    place = F.row_number().over(Window.partitionBy("doc_id", "page_no", "chain").orderBy("expected_start", "diff_id"))
    rows = rows.withColumn("place", place)
    opens = F.col("joins") & (F.col("place") % 2 == 1)
    rows = rows.withColumn("opens", opens)
    used = F.coalesce(F.lag("opens").over(own), F.lit(False))
    rows = rows.withColumn("used", used).where("NOT used")
    return rows.select("doc_id", "page_no", "diff_id", "expected_start", F.when(F.col("opens"), "substitute").otherwise(F.col("operation")).alias("operation"))


def pair_quotes(words: DataFrame) -> DataFrame:
    """Words (doc_id, pos, word) that open a single quote, with the first word from there on that closes one."""
    ahead = _doc().orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    closing = F.min(F.when(F.col("word").rlike("'$"), F.col("pos"))).over(ahead)
    return words.withColumn("closing", closing).where("word LIKE '\\'%' OR word LIKE ',\\'%'").select("doc_id", "pos", "word", "closing")


def pair_math_spans(records: DataFrame, spans: DataFrame) -> DataFrame:
    """Records and actual spans of a page in order: by ordinal where counts agree, else the largest ordered matching of equal texts.

    Returns (doc_id, page_no, record, span); unpaired spans have a null record.  For texts that are
    read already; ``mathspans.math_verdicts`` pairs records with spans of a cell stream.
    """

    def counted(side: DataFrame, name: str) -> DataFrame:
        page = Window.partitionBy("doc_id", "page_no")
        return side.select("doc_id", "page_no", F.col("seq").alias(name), F.col("text").alias(f"t_{name}"), F.row_number().over(page.orderBy("seq")).alias("o"), F.count("*").over(page).alias(f"n_{name}"))

    r, s = counted(records, "record"), counted(spans, "span")
    sizes = r.groupBy("doc_id", "page_no").agg(F.count("*").alias("n_record"))
    s = s.join(sizes, ["doc_id", "page_no"], "left")
    r = r.drop("n_record")
    even = s.where("n_span = n_record").join(r, ["doc_id", "page_no", "o"]).select("doc_id", "page_no", "record", "span")
    odd = s.where("n_record IS NULL OR n_span <> n_record")

    def ordered(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("record"), b.sort_values("span")
        found = dict.fromkeys(b["span"], None)
        same = a["t_record"].to_numpy(object)[:, None] == b["t_span"].to_numpy(object)[None, :]
        found.update((b["span"].iloc[j], a["record"].iloc[i]) for i, j in ordered_matching(same))
        if not len(b):
            return pd.DataFrame({"doc_id": [], "page_no": [], "record": [], "span": []})
        return pd.DataFrame({"doc_id": b["doc_id"].iloc[0], "page_no": b["page_no"].iloc[0], "record": pd.array(list(found.values()), "Int32"), "span": list(found)})

    keys = ["doc_id", "page_no"]
    rest = r.join(odd.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).cogroup(odd.groupBy(*keys)).applyInPandas(ordered, "doc_id long, page_no int, record int, span int")
    return even.unionByName(rest)


def switch_pairs(blocks: DataFrame, opening: str = "_%", closing: str = "_:") -> DataFrame:
    """Opening and closing switches of each block against its number of math records."""
    quoted = lambda x: "".join(f"[{c}]" for c in x)
    o, c = F.regexp_count("text", F.lit(quoted(opening))), F.regexp_count("text", F.lit(quoted(closing)))
    rows = blocks.select("doc_id", "seq", "records", o.alias("openings"), c.alias("closings"))
    return rows.withColumn("ok", (F.col("openings") == F.col("records")) & (F.col("closings") == F.col("records")))


def switch_problems(switches: DataFrame) -> DataFrame:
    """Two openings in a row, a closing without opening, an opening at the end; switches are (doc_id, pos, kind)."""
    own = _doc().orderBy("pos")
    before, after = F.lag("kind").over(own), F.lead("kind").over(own)
    problem = (
        F.when((F.col("kind") == "open") & (before == "open"), "nested_open").when((F.col("kind") == "close") & ~before.eqNullSafe(F.lit("open")), "close_without_open")
        .when((F.col("kind") == "open") & after.isNull(), "unclosed")
    )
    return switches.withColumn("problem", problem).where("problem IS NOT NULL").select("doc_id", "pos", "problem")


def letter_group(text: Column) -> Column:
    """a letter in brackets, nested and applied to any depth, as struct (kind, depth, cells).

    Each level is a bracket of three kinds, with or without a letter applied to it; the innermost
    holds one letter; the closing brackets mirror the opening ones, so no stack is needed.  Kind is
    ``application`` where the whole begins with a letter, ``group`` where it begins with a bracket, else
    ``none`` without cells.  A letter inside touches both brackets and an applied one a bracket, so none
    takes an indicator here.
    """
    shape = r"^((?:[A-Za-z]?[(\[{])+)([A-Za-z])([)\]}]+)$"
    opening = F.regexp_replace(F.regexp_extract(text, shape, 1), "[A-Za-z]", "")
    closing = F.regexp_extract(text, shape, 3)
    ok = (opening != "") & (F.translate(F.reverse(opening), "([{", ")]}") == closing)
    cells = text
    for sign, cell in ((r"\[", "@\\("), (r"\]", "@)"), (r"\{", ".\\("), (r"\}", ".)")):
        cells = F.regexp_replace(cells, sign, cell)
    cells = F.lower(F.regexp_replace(cells, "([A-Z])", ",$1"))
    kind = F.when(ok & text.rlike("^[A-Za-z]"), "application").when(ok, "group").otherwise("none")
    return F.struct(kind.alias("kind"), F.when(ok, F.length(opening)).alias("depth"), F.when(ok, cells).alias("cells"))


def letter_indicator(contact: Column, left: Column, right: Column, enclosed_list: Column, comparison: Column, modified: Column) -> Column:
    """whether a single mathematical letter takes an indicator, from what it touches; null is for review.

    ``contact`` is the side of a grouping sign, both, or outside; ``left`` and ``right`` are the
    neighbours beyond it.  Items of enclosed lists, letters beside a comparison or between both
    signs, and letters at a sign with a script take none; else one that spaces or punctuation stand around does.
    """
    known = lambda c: c.isin("space", "punctuation", "letter", "operation", "group")
    free = lambda c: c.isin("space", "punctuation")
    return (
        F.when(~contact.isin("both", "left", "right", "outside"), F.lit(None)).when(enclosed_list | comparison | (contact == "both"), False)
        .when(contact.isin("left", "right") & modified, False).when(known(left) & known(right), free(left) & free(right))
    )
