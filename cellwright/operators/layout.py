"""Pages, lines, paragraphs and blocks, and the layout problems found in them.

Lines are (doc_id, page_no, line_no, raw_line); blocks (doc_id, page_no, block_no, seq, text).
Every operator is windows and aggregates keyed by document or page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwright.functions.braille import UNICODE_CELLS, braille_int

#: Share of a document's pages (or blocks) beyond which a problem is systemic; strictly more.
SYSTEMIC = 0.3


def _doc():
    return Window.partitionBy("doc_id")
#: Style names and the block types they stand for.
STYLE_TYPES = {
    "heading 1": "heading1", "heading 2": "heading2", "heading 3": "heading3", "heading 4": "heading4", "heading 5": "heading5", "heading 6": "heading6",
    "normal": "body", "body text": "body", "list bullet": "list_bullet", "list number": "list_number", "caption": "caption", "subtitle": "subtitle", "title": "title",
}


def page_lines(pages: DataFrame) -> DataFrame:
    """Lines of (doc_id, page_no, page_text), blank ones kept; one trailing newline makes no line."""
    text = F.regexp_replace("page_text", r"\r?\n\z", "")
    rows = pages.select("doc_id", "page_no", F.posexplode(F.split(text, "\r?\n")).alias("i", "raw_line"))
    return rows.select("doc_id", "page_no", (F.col("i") + 1).alias("line_no"), "raw_line")


def repaginate_by_header(lines: DataFrame, header: str = ",,PAGE ") -> DataFrame:
    """S3: a header line opens a page; right-hand ``#...`` footers and form feeds are removed."""
    order = _doc().orderBy("seq")
    page = F.sum(F.col("raw_line").contains(header).cast("int")).over(order)
    clean = F.regexp_replace(F.regexp_replace("raw_line", "\f", ""), " {3,}#[A-Za-z0-9]+ *$", "")
    out = lines.withColumns({"page_no": page, "raw_line": clean})
    place = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("seq"))
    return out.withColumn("line_no", place)


def paragraphs_to_blocks(paras: DataFrame) -> DataFrame:
    """(doc_id, seq, text, break_before, break_after) to pages and blocks; empty paragraphs stay as type empty.

    A break before counts only on a paragraph with text.
    """
    order = _doc().orderBy("seq")
    opens = F.when(F.trim("text") != "", F.col("break_before").cast("int")).otherwise(0)
    closed = F.coalesce(F.lag(F.col("break_after").cast("int")).over(order), F.lit(0))
    out = paras.withColumn("page_no", (1 + F.sum(opens + closed).over(order)).cast("int"))
    place = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("seq"))
    return out.select("doc_id", "page_no", place.alias("block_no"), "seq", F.when(F.trim("text") == "", "empty").otherwise("body").alias("block_type"), "text")


def partition_page_markers(blocks: DataFrame) -> DataFrame:
    """``=== PAGE n ===`` rows open pages; a number that cannot be read is the count of pages so far plus 1."""
    order = _doc().orderBy("seq")
    marker = F.col("text").rlike("^=== PAGE .* ===$")
    out = blocks.withColumns({"is_marker": marker, "ordinal": F.sum(marker.cast("int")).over(order)})
    number = F.regexp_extract("text", "^=== PAGE (.*) ===$", 1)
    read = F.when(marker & number.rlike("^[0-9]{1,9}$"), number).cast("int")
    out = out.withColumn("read", F.coalesce(read, F.when(marker, F.col("ordinal"))))
    out = out.withColumn("marked_page", F.coalesce(F.last("read", ignorenulls=True).over(order), F.lit(1)))
    return out.where("NOT is_marker").select("doc_id", "marked_page", "seq", "text")


def block_type(style: Column) -> Column:
    """Block type of a style name in any case: exact names, then parts of names, else unknown; a heading of no level 1 or 2 in its name is heading3."""
    exact = F.create_map(*(F.lit(x) for pair in STYLE_TYPES.items() for x in pair))
    low = F.lower(style)
    return F.coalesce(
        F.try_element_at(exact, low),
        F.when(low.contains("heading 1"), "heading1").when(low.contains("heading 2"), "heading2").when(low.contains("heading"), "heading3")
        .when(low.contains("bullet"), "list_bullet").when(low.contains("number"), "list_number"),
        F.lit("unknown"),
    )


def block_type_from_font(size: Column, bold: Column, text: Column) -> Column:
    """Struct (block_type, text): by size and weight of the trimmed text, list markers stripped from it."""
    line = F.regexp_replace(text, r"^\s+|\s+$", "")
    kind = (
        F.when(size >= 16, "heading1").when(size >= 13, "heading2").when(bold & (size >= 11), "heading3")
        .when(line.rlike("^[•▪*-]"), "list_bullet").when(line.rlike(r"^[0-9]+[.)]\s+"), "list_number").otherwise("body")
    )
    marker = F.when(kind == "list_bullet", r"^[•▪*-]\s*").when(kind == "list_number", r"^[0-9]+[.)]\s*")
    return F.struct(kind.alias("block_type"), F.when(marker.isNull(), line).otherwise(F.regexp_replace(line, marker, "")).alias("text"))


def is_page_number(line: Column) -> Column:
    """A line that is only a page number (a lone word of a-j counts as one too)."""
    bare = F.trim(line)
    return F.lower(bare).rlike("^#?[a-j0-9]+$") | bare.rlike(f"^⠼[{UNICODE_CELLS[1]}-{UNICODE_CELLS[63]}]+$")


def strip_furniture(lines: DataFrame, banner: str = "^TRANSCRIBED ") -> DataFrame:
    """Drop a banner at the start of the stream, page header rows and page-number rows at the foot."""
    first = F.row_number().over(_doc().orderBy("seq")) == 1
    foot = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy(F.col("seq").desc())) == 1
    furniture = (first & F.col("raw_line").rlike(banner)) | F.col("raw_line").contains(",,PAGE ") | (foot & is_page_number(F.col("raw_line")))
    return lines.withColumn("furniture", furniture).where("NOT furniture").drop("furniture")


def page_issues(lines: DataFrame, length: int) -> DataFrame:
    """Empty pages, and pages of another length than ``length``."""
    facts = lines.groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.max((F.trim("raw_line") != "").cast("int")).alias("filled"))
    found = F.array_compact(F.array(F.when(F.col("filled") == 0, "empty_page"), F.when(F.col("n") != length, "page_length")))
    return facts.select("doc_id", "page_no", F.explode(found).alias("issue_type"), F.col("n").alias("line_count"))


def line_width_issues(lines: DataFrame, width: int) -> DataFrame:
    """Lines wider than ``width``."""
    return lines.where(F.length("raw_line") > width).select("doc_id", "page_no", "line_no", F.lit("line_width").alias("issue_type"), F.length("raw_line").alias("width"))


def page_number_issues(lines: DataFrame, width: int, footer_line: int) -> DataFrame:
    """The right-most token of the footer line as page number: undecodable, missing or off the right margin."""
    foot = lines.where(F.col("line_no") == footer_line)
    token = F.element_at(F.regexp_extract_all("raw_line", F.lit("[^ ]+"), F.lit(0)), -1)
    foot = foot.withColumns({"token": F.when(F.trim("raw_line") != "", token), "margin": F.lit(width) - F.length(F.rtrim("raw_line"))})
    number = braille_int(F.col("token"))
    issue = (
        F.when(F.col("token").isNull(), "page_number_missing").when(F.col("token").rlike("^#") & (number < 0), "page_number_undecodable")
        .when(number < 0, "page_number_missing").when(F.col("margin") > 3, "page_number_alignment")
    )
    out = foot.select("doc_id", "page_no", "token", number.alias("number"), issue.alias("issue_type"))
    tier = F.when(F.col("issue_type") == "page_number_undecodable", "high_confidence").otherwise("needs_review")
    return out.where("issue_type IS NOT NULL").withColumn("tier", tier)


def normalize_stream(lines: DataFrame) -> DataFrame:
    """Hyphen variants unified, blanks collapsed, page-number rows and empty rows dropped."""
    text = F.trim(F.regexp_replace(F.regexp_replace("raw_line", "[‐‑‒–—−]", "-"), "[ \t ]+", " "))
    return lines.withColumn("line", text).where((F.col("line") != "") & ~is_page_number(F.col("line"))).drop("raw_line")


def frequency_tables(lines: DataFrame) -> DataFrame:
    """A1: how often each width of a non-empty line and each page length occurs in a document: (doc_id, kind, v, n, first), first being where it is seen first."""
    widths = lines.where(F.trim("raw_line") != "").select("doc_id", F.lit("width").alias("kind"), F.length("raw_line").alias("v"), F.col("seq").alias("at"))
    pages = lines.groupBy("doc_id", "page_no").agg(F.count("*").cast("int").alias("v"))
    lengths = pages.select("doc_id", F.lit("length").alias("kind"), "v", F.col("page_no").alias("at"))
    return widths.unionByName(lengths).groupBy("doc_id", "kind", "v").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def calibrate(lines: DataFrame) -> DataFrame:
    """A1: modal width of non-empty lines and modal page length of each document; ties go to the first seen."""
    best = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy(F.col("n").desc(), "first"))
    modes = frequency_tables(lines).withColumn("best", best).where("best = 1")
    return modes.groupBy("doc_id").agg(*(F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{name}") for k in ("width", "length") for c, name in (("v", "mode"), ("n", "count"))))


def systemic_patterns(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """A2: issue types on strictly more than 30 % of a document's pages: (doc_id, issue_type, pages, total)."""
    hit = issues.groupBy("doc_id", "issue_type").agg(F.count_distinct("page_no").alias("pages"))
    total = pages.groupBy("doc_id").agg(F.count_distinct("page_no").alias("total"))
    return hit.join(total, "doc_id").where(F.col("pages") > SYSTEMIC * F.col("total"))


def with_suppressed(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """A2: issues with a flag on those of a systemic type; none is deleted."""
    flags = systemic_patterns(issues, pages).select("doc_id", "issue_type", F.lit(True).alias("suppressed"))
    return issues.join(flags, ["doc_id", "issue_type"], "left").fillna({"suppressed": False})


def segment_paragraphs(lines: DataFrame) -> DataFrame:
    """A blank line, a first indent of 2, 4 or 6 cells or a leading number sign starts a paragraph."""
    page = Window.partitionBy("doc_id", "page_no").orderBy("line_no")
    indent = F.length("raw_line") - F.length(F.ltrim("raw_line"))
    blank = F.trim("raw_line") == ""
    rows = lines.withColumns({"blank": blank, "indent": indent})
    new = F.coalesce(F.lag("blank").over(page), F.lit(True)) | F.col("indent").isin(2, 4, 6) | F.col("raw_line").startswith("#")
    return rows.withColumn("para_no", F.sum((new & ~F.col("blank")).cast("int")).over(page))


def paragraph_layout(lines: DataFrame) -> DataFrame:
    """Text, blank lines before, first and run-over indents, centred, place and first line of each paragraph."""
    rows = segment_paragraphs(lines)
    before = F.sum(F.col("blank").cast("int")).over(Window.partitionBy("doc_id", "page_no").orderBy("line_no"))
    rows = rows.withColumn("blanks", before).where("NOT blank AND para_no > 0")
    place = F.row_number().over(Window.partitionBy("doc_id", "page_no", "para_no").orderBy("line_no"))
    rows = rows.withColumn("place", place)
    facts = rows.groupBy("doc_id", "page_no", "para_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("raw_line").alias("t")))), lambda s: s["t"]), " ").alias("text"),
        F.min("line_no").alias("start_line"), F.min("blanks").alias("blanks"),
        F.max(F.when(F.col("place") == 1, F.col("indent"))).alias("first_indent"),
        F.max(F.when(F.col("place") == 2, F.col("indent"))).alias("runover_indent"),
        F.max(F.when(F.col("place") == 1, F.length(F.trim("raw_line")))).alias("width"),
    )
    page = Window.partitionBy("doc_id", "page_no").orderBy("para_no")
    gap = F.col("blanks") - F.coalesce(F.lag("blanks").over(page), F.lit(0))
    centred = (F.col("first_indent") > 6) & (F.abs(F.col("first_indent") - (40 - F.col("width")) / 2) <= 4)
    return facts.select(
        "doc_id", "page_no", "para_no", "text", gap.alias("blank_before"), "first_indent", "runover_indent",
        centred.alias("centred"), (F.col("para_no") == 1).alias("first_on_page"), "start_line",
    )


def page_gaps(numbers: DataFrame) -> DataFrame:
    """Pages whose number is not the previous numbered page's plus one; pages without a number are skipped."""
    rows = numbers.where("number >= 0").withColumn("previous", F.lag("number").over(_doc().orderBy("page_no")))
    return rows.where("previous IS NOT NULL AND number <> previous + 1").select("doc_id", "page_no", "previous", "number")


def monotone_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors (doc_id, i, j) in order of i whose j exceeds every j before."""
    before = _doc().orderBy("i", "j").rowsBetween(Window.unboundedPreceding, -1)
    return anchors.withColumn("top", F.max("j").over(before)).where("top IS NULL OR j > top").drop("top")


def word_coordinates(lines: DataFrame) -> DataFrame:
    """Words with their physical line over counted lines, and their place in it."""
    counted = (F.trim("raw_line") != "") & ~is_page_number(F.col("raw_line"))
    rows = lines.withColumn("counted", counted)
    rows = rows.withColumn("physical_line", F.sum(F.col("counted").cast("int")).over(Window.partitionBy("doc_id").orderBy("seq"))).where("counted")
    return rows.select("doc_id", "page_no", F.col("physical_line").cast("int"), F.posexplode(F.split(F.trim("raw_line"), " +")).alias("i", "word")).select(
        "doc_id", "page_no", "physical_line", (F.col("i") + 1).alias("word_no"), "word"
    )


def collapse_patterns(diffs: DataFrame, blocks: DataFrame) -> DataFrame:
    """A3: a review-tier type on more than 30 % of a document's blocks becomes one pattern row."""
    total = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    hit = diffs.where("tier = 'needs_review'").groupBy("doc_id", "issue_type").agg(F.count_distinct("page_no", "block_no").alias("hits"))
    patterns = hit.join(total, "doc_id").where(F.col("hits") > SYSTEMIC * F.col("blocks")).select("doc_id", "issue_type", "hits")
    tier = F.lit("needs_review").alias("tier")
    rest = diffs.withColumn("hits", F.lit(1).cast("long")).join(patterns.select("doc_id", "issue_type", tier), ["doc_id", "issue_type", "tier"], "left_anti")
    one = patterns.select("doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("block_no"), "issue_type", F.lit("pattern").alias("tier"), "hits")
    return rest.select(one.columns).unionByName(one)


def heading_collapse(layouts: DataFrame) -> DataFrame:
    """A4: modal (indent, centred) of each heading level, and pairs of levels that share it."""
    counts = layouts.where("level LIKE 'heading%'").groupBy("doc_id", "level", "first_indent", "centred").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    best = F.row_number().over(Window.partitionBy("doc_id", "level").orderBy(F.col("n").desc(), "first"))
    modes = counts.withColumn("best", best).where("best = 1").select("doc_id", "level", "first_indent", "centred")
    other = modes.withColumnRenamed("level", "other_level")
    return modes.join(other, ["doc_id", "first_indent", "centred"]).where("level < other_level").select("doc_id", "level", "other_level", "first_indent", "centred")


#: Blank lines that headings want before them, and the indents of paragraphs and lists in blanks.
FORMATS = {"heading1": 2, "heading2": 1, "heading3": 1, "paragraph": (2, 0), "list_starts": (0, 2), "list_runovers": (2, 4)}


def format_check(layouts: DataFrame, formats: dict = FORMATS) -> DataFrame:
    """one verdict for each block that is laid out otherwise than its type wants.

    Headings, but for the first block of a page, want blank lines before them; a first-level one
    that lacks just one is for review.  Paragraphs want their first and run-over indents, a first
    indent off by one alone is for review; list items want one of the allowed starts and
    run-overs.  A block of one line counts as running over to the margin.
    """
    first, over = F.col("first_indent"), F.coalesce("runover_indent", F.lit(0))
    kind, blanks = F.col("block_type"), F.col("blank_before")
    verdict = lambda issue, tier: F.struct(F.lit(issue).alias("issue_type"), tier.alias("tier"))
    high = F.lit("high_confidence")
    spacing = lambda level, tier: F.when((kind == level) & ~F.col("first_on_page") & (blanks < formats[level]), verdict("heading_spacing_error", tier))
    want, margin = formats["paragraph"]
    paragraph = kind.isin("body", "paragraph") & ((first != want) | (over != margin))
    minor = F.when((F.abs(first - want) <= 1) & (over == margin), "needs_review").otherwise("high_confidence")
    items = kind.startswith("list") & ~(first.isin(*formats["list_starts"]) & over.isin(*formats["list_runovers"]))
    found = F.coalesce(
        spacing("heading1", F.when(blanks < formats["heading1"] - 1, high).otherwise("needs_review")), spacing("heading2", high), spacing("heading3", high),
        F.when(paragraph, verdict("paragraph_indentation_error", minor)), F.when(items, verdict("list_indentation_error", high)),
    )
    return layouts.withColumn("found", found).where("found IS NOT NULL").select("doc_id", "page_no", "para_no", "block_type", "found.issue_type", "found.tier")


def apply_format_allowlist(diffs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Drop differences whose (block_type, indents, centred) layout is allowed."""
    return diffs.join(allowed, ["block_type", "first_indent", "runover_indent", "centred"], "left_anti")
