"""Registered queries of the layout family and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.functions.braille import braille_int
from cellwright.operators import layout as L
from cellwright.sources.testdata import layout_lines, source_blocks, sql, styled_lines

WIDTH, LENGTH = 44, 10
NUM = "CASE WHEN regexp_matches(b, '^(?:[a-j]{1,9}|[0-9]{1,9})$') THEN CAST(translate(b, 'abcdefghij', '1234567890') AS INT) ELSE -1 END"
PAGE_NUMBER = "regexp_matches(lower(trim({0})), '^#?[a-j0-9]+$')"


def systemic_layout_problems(spark, d):
    lines = layout_lines(spark, d)
    issues = L.line_width_issues(lines, WIDTH).select("doc_id", "page_no", "issue_type").unionByName(L.page_issues(lines, LENGTH).select("doc_id", "page_no", "issue_type"))
    return L.systemic_patterns(issues, lines)


ISSUES = f"""issues AS (SELECT doc_id, page_no, 'line_width' AS issue_type FROM lines WHERE length(raw_line) > {WIDTH}
    UNION ALL SELECT doc_id, page_no, 'page_length' FROM lines GROUP BY doc_id, page_no HAVING count(*) <> {LENGTH})"""
TOTALS = "totals AS (SELECT doc_id, count(DISTINCT page_no) AS total FROM lines GROUP BY doc_id)"


def page_texts(spark, d):
    lines = styled_lines(spark, d)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw_line"))), lambda s: s["raw_line"]), "\n")
    return lines.groupBy("doc_id", "page_no").agg(F.concat(joined, F.lit("\n")).alias("page_text"))


def paragraphs(spark, d):
    rows = source_blocks(spark, d)
    return rows.select("doc_id", "seq", F.expr("CASE WHEN (doc_id + seq) % 9 = 0 THEN '' ELSE text END").alias("text"), F.expr("(doc_id + seq) % 6 = 0 OR (doc_id + seq) % 9 = 0").alias("break_before"), F.expr("(doc_id * 3 + seq) % 7 = 0").alias("break_after"))


def marked_blocks(spark, d):
    mark = "CASE WHEN (doc_id + seq) % 6 = 0 THEN concat('=== PAGE ', CASE WHEN seq % 4 = 0 THEN 'x' ELSE cast(seq AS string) END, ' ===') ELSE text END"
    return source_blocks(spark, d).withColumn("text", F.expr(mark))


STYLES = "CASE (doc_id + seq) % 8 WHEN 0 THEN 'Title' WHEN 1 THEN 'Heading 2' WHEN 2 THEN 'List Bullet' WHEN 3 THEN 'My number list' WHEN 4 THEN 'Figure caption' WHEN 5 THEN 'BODY text' WHEN 6 THEN 'Chapter Heading' ELSE 'heading 5' END"


def style_types(spark, d):
    return source_blocks(spark, d).select("doc_id", "seq", L.block_type(F.expr(STYLES)).alias("block_type"))


FONT = ("10 + (doc_id + seq) % 10", "(doc_id * 3 + seq) % 4 = 0", "CASE (doc_id + seq) % 3 WHEN 0 THEN '- ' WHEN 1 THEN '12. ' ELSE '' END || text")


def font_types(spark, d):
    out = L.block_type_from_font(*(F.expr(x) for x in FONT))
    return source_blocks(spark, d).select("doc_id", "seq", out.alias("o")).select("doc_id", "seq", "o.block_type", "o.text")


NUMBERS = "CASE WHEN (doc_id + page_no) % 5 = 0 THEN -1 WHEN (doc_id + page_no) % 7 = 0 THEN page_no + 3 ELSE page_no END"


def numbered_pages(spark, d):
    return layout_lines(spark, d).select("doc_id", "page_no").distinct().withColumn("number", F.expr(NUMBERS))


def anchors(spark, d):
    return layout_lines(spark, d).select("doc_id", F.col("seq").alias("i"), F.expr("(seq * 7 + doc_id) % 101 + seq").alias("j"))


REVIEW = "CASE WHEN length(text) > 400 THEN 'long_block' WHEN text LIKE '%.' THEN 'ends_with_stop' END"


def block_diffs(spark, d):
    rows = source_blocks(spark, d).withColumn("issue_type", F.expr(REVIEW)).where("issue_type IS NOT NULL")
    return rows.select("doc_id", "page_no", "block_no", "issue_type", F.expr("CASE WHEN issue_type = 'long_block' THEN 'high_confidence' ELSE 'needs_review' END").alias("tier"))


LEVELS = "CASE (doc_id + seq) % 7 WHEN 0 THEN 'heading1' WHEN 1 THEN 'heading2' WHEN 2 THEN 'heading3' ELSE 'body' END"


def heading_layouts(spark, d):
    return source_blocks(spark, d).select("doc_id", "seq", F.expr(LEVELS).alias("level"), F.expr("length(text) % 3").alias("first_indent"), F.expr("length(text) % 2 = 0").alias("centred"))


PARA = """para AS (SELECT *, CASE WHEN trim(raw_line) = '' THEN 1 ELSE 0 END AS blank, length(raw_line) - length(ltrim(raw_line)) AS indent FROM styled),
    flagged AS (SELECT *, CASE WHEN blank = 0 AND (coalesce(lag(blank) OVER w, 1) = 1 OR indent IN (2, 4, 6) OR raw_line LIKE '#%') THEN 1 ELSE 0 END AS new FROM para WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no)),
    segmented AS (SELECT *, sum(new) OVER w AS para_no, sum(blank) OVER w AS blanks FROM flagged WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line_no))"""
FACTS = (
    PARA
    + """, placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, para_no ORDER BY line_no) AS place FROM segmented WHERE blank = 0 AND para_no > 0),
    facts AS (SELECT doc_id, page_no, para_no, string_agg(trim(raw_line), ' ' ORDER BY line_no) AS text, min(line_no) AS start_line, min(blanks) AS blanks,
    max(CASE WHEN place = 1 THEN indent END) AS first_indent, max(CASE WHEN place = 2 THEN indent END) AS runover_indent, max(CASE WHEN place = 1 THEN length(trim(raw_line)) END) AS width
    FROM placed GROUP BY doc_id, page_no, para_no),
    layouts AS (SELECT doc_id, page_no, para_no, text, blanks - coalesce(lag(blanks) OVER (PARTITION BY doc_id, page_no ORDER BY para_no), 0) AS blank_before, first_indent, runover_indent,
    first_indent > 6 AND abs(first_indent - (40 - width) / 2) <= 4 AS centred, para_no = 1 AS first_on_page, start_line FROM facts)"""
)
TYPES = "CASE (doc_id + para_no) % 5 WHEN 0 THEN 'heading1' WHEN 1 THEN 'body' WHEN 2 THEN 'list_bullet' WHEN 3 THEN 'heading3' ELSE 'heading2' END"


def typed_layouts(spark, d):
    return L.paragraph_layout(styled_lines(spark, d)).withColumn("block_type", F.expr(TYPES))


def allowed(spark):
    return spark.createDataFrame([("body", 2, 0, False), ("heading1", 0, 0, False)], "block_type string, first_indent int, runover_indent int, centred boolean")


QUERIES = {
    "systemic_layout_problems": systemic_layout_problems,
    "s2_page_lines": lambda s, d: L.page_lines(page_texts(s, d)),
    "s3_repaginate_by_header": lambda s, d: L.repaginate_by_header(styled_lines(s, d)),
    "s4_paragraphs_to_blocks": lambda s, d: L.paragraphs_to_blocks(paragraphs(s, d)),
    "s7_partition_page_markers": lambda s, d: L.partition_page_markers(marked_blocks(s, d)),
    "p1_block_type": style_types,
    "p2_block_type_from_font": font_types,
    "p3_is_page_number": lambda s, d: styled_lines(s, d).where(L.is_page_number(F.col("raw_line"))).select("doc_id", "seq", "raw_line"),
    "p4_strip_furniture": lambda s, d: L.strip_furniture(styled_lines(s, d)).select("doc_id", "seq"),
    "p6_page_issues": lambda s, d: L.page_issues(layout_lines(s, d), LENGTH),
    "p7_line_width_issues": lambda s, d: L.line_width_issues(layout_lines(s, d), WIDTH),
    "p8_page_number_issues": lambda s, d: L.page_number_issues(styled_lines(s, d), WIDTH, LENGTH),
    "p11_format_allowlist": lambda s, d: L.apply_format_allowlist(typed_layouts(s, d), allowed(s)).select("doc_id", "page_no", "para_no", "block_type", "first_indent", "runover_indent", "centred"),
    "p14_normalize_stream": lambda s, d: L.normalize_stream(styled_lines(s, d)).select("doc_id", "seq", "line"),
    "a1_calibrate": lambda s, d: L.calibrate(layout_lines(s, d)),
    "a1_frequency_tables": lambda s, d: L.frequency_tables(layout_lines(s, d)),
    "a2_suppressed_issues": lambda s, d: L.with_suppressed(L.line_width_issues(layout_lines(s, d), WIDTH).select("doc_id", "page_no", "line_no", "issue_type"), layout_lines(s, d)),
    "a3_collapse_patterns": lambda s, d: L.collapse_patterns(block_diffs(s, d), source_blocks(s, d)),
    "a4_heading_collapse": lambda s, d: L.heading_collapse(heading_layouts(s, d)),
    "a16_paragraph_layout": lambda s, d: L.paragraph_layout(styled_lines(s, d)),
    "w1_page_gaps": lambda s, d: L.page_gaps(numbered_pages(s, d)),
    "w2_monotone_anchors": lambda s, d: L.monotone_anchors(anchors(s, d)),
    "w3_segment_paragraphs": lambda s, d: L.segment_paragraphs(styled_lines(s, d)).select("doc_id", "seq", "para_no"),
    "w4_word_coordinates": lambda s, d: L.word_coordinates(styled_lines(s, d)),
    "f5_braille_int": lambda s, d: styled_lines(s, d).select("doc_id", "seq", braille_int(F.element_at(F.split("raw_line", " "), -1)).alias("number")),
    "f19_format_check": lambda s, d: L.format_check(typed_layouts(s, d)),
}

ORACLE_SQL = {
    "systemic_layout_problems": sql("lines", f", {ISSUES}, {TOTALS} SELECT doc_id, issue_type, pages, total FROM (SELECT doc_id, issue_type, count(DISTINCT page_no) AS pages FROM issues GROUP BY ALL) JOIN totals USING (doc_id) WHERE pages > 0.3 * total"),
    "s2_page_lines": sql("lines styled", "SELECT doc_id, page_no, line_no, raw_line FROM styled"),
    "s3_repaginate_by_header": sql("lines styled", ", p AS (SELECT doc_id, seq, raw_line, sum(CASE WHEN contains(raw_line, ',,PAGE ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS page_no FROM styled) SELECT doc_id, page_no, seq, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS line_no, regexp_replace(raw_line, ' {3,}#[A-Za-z0-9]+ *$', '') AS raw_line FROM p"),
    "s4_paragraphs_to_blocks": sql("blocks", """, p AS (SELECT doc_id, seq, CASE WHEN (doc_id + seq) % 9 = 0 THEN '' ELSE text END AS text, CASE WHEN (doc_id + seq) % 6 = 0 OR (doc_id + seq) % 9 = 0 THEN 1 ELSE 0 END AS bb, CASE WHEN (doc_id * 3 + seq) % 7 = 0 THEN 1 ELSE 0 END AS ba FROM blocks),
        q AS (SELECT *, 1 + sum(CASE WHEN trim(text) <> '' THEN bb ELSE 0 END + c) OVER (PARTITION BY doc_id ORDER BY seq) AS page_no FROM (SELECT *, coalesce(lag(ba) OVER (PARTITION BY doc_id ORDER BY seq), 0) AS c FROM p))
        SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS block_no, seq, CASE WHEN trim(text) = '' THEN 'empty' ELSE 'body' END AS block_type, text FROM q"""),
    "s7_partition_page_markers": sql("blocks", """, m AS (SELECT doc_id, seq, (doc_id + seq) % 6 = 0 OR regexp_matches(text, '^=== PAGE .* ===$') AS mk, text, CASE WHEN seq % 4 = 0 THEN NULL ELSE seq END AS n FROM blocks),
        r AS (SELECT *, CASE WHEN mk THEN coalesce(n, sum(CASE WHEN mk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq)) END AS p FROM m)
        SELECT doc_id, marked_page, seq, text FROM (SELECT *, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq), 1) AS marked_page FROM r) WHERE NOT mk"""),
    "p1_block_type": sql("blocks", "SELECT doc_id, seq, CASE (doc_id + seq) % 8 WHEN 0 THEN 'title' WHEN 1 THEN 'heading2' WHEN 2 THEN 'list_bullet' WHEN 3 THEN 'list_number' WHEN 4 THEN 'unknown' WHEN 5 THEN 'body' WHEN 6 THEN 'heading3' ELSE 'heading5' END AS block_type FROM blocks"),
    "p2_block_type_from_font": sql("blocks", f""", t AS (SELECT doc_id, seq, {FONT[0]} AS size, {FONT[1]} AS bold, regexp_replace({FONT[2]}, '^\\s+|\\s+$', '', 'g') AS text FROM blocks),
        k AS (SELECT *, CASE WHEN size >= 16 THEN 'heading1' WHEN size >= 13 THEN 'heading2' WHEN bold AND size >= 11 THEN 'heading3' WHEN regexp_matches(text, '^[•▪*-]') THEN 'list_bullet' WHEN regexp_matches(text, '^[0-9]+[.)]\\s+') THEN 'list_number' ELSE 'body' END AS block_type FROM t)
        SELECT doc_id, seq, block_type, CASE block_type WHEN 'list_bullet' THEN regexp_replace(text, '^[•▪*-]\\s*', '') WHEN 'list_number' THEN regexp_replace(text, '^[0-9]+[.)]\\s*', '') ELSE text END AS text FROM k"""),
    "p3_is_page_number": sql("lines styled", f"SELECT doc_id, seq, raw_line FROM styled WHERE {PAGE_NUMBER.format('raw_line')}"),
    "p4_strip_furniture": sql("lines styled", f"SELECT doc_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq DESC) AS f, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS b FROM styled) WHERE NOT (contains(raw_line, ',,PAGE ') OR (f = 1 AND {PAGE_NUMBER.format('raw_line')}) OR (b = 1 AND raw_line LIKE 'TRANSCRIBED %'))"),
    "p6_page_issues": sql("lines", "SELECT doc_id, page_no, 'page_length' AS issue_type, count(*) AS line_count FROM lines GROUP BY doc_id, page_no HAVING count(*) <> 10"),
    "p7_line_width_issues": sql("lines", "SELECT doc_id, page_no, line_no, 'line_width' AS issue_type, length(raw_line) AS width FROM lines WHERE length(raw_line) > 44"),
    "p8_page_number_issues": sql("lines styled", f""", t AS (SELECT doc_id, page_no, CASE WHEN trim(raw_line) <> '' THEN regexp_extract_all(raw_line, '[^ ]+')[-1] END AS token, 44 - length(rtrim(raw_line)) AS margin FROM styled WHERE line_no = 10),
        n AS (SELECT *, regexp_replace(lower(token), '^#', '') AS b FROM t), v AS (SELECT *, {NUM} AS number FROM n),
        i AS (SELECT doc_id, page_no, token, number, CASE WHEN token IS NULL THEN 'page_number_missing' WHEN token LIKE '#%' AND number < 0 THEN 'page_number_undecodable' WHEN number < 0 THEN 'page_number_missing' WHEN margin > 3 THEN 'page_number_alignment' END AS issue_type FROM v)
        SELECT *, CASE WHEN issue_type = 'page_number_undecodable' THEN 'high_confidence' ELSE 'needs_review' END AS tier FROM i WHERE issue_type IS NOT NULL"""),
    "p11_format_allowlist": sql("lines styled", f", {FACTS}, t AS (SELECT *, {TYPES} AS block_type FROM layouts) SELECT doc_id, page_no, para_no, block_type, first_indent, runover_indent, centred FROM t WHERE NOT coalesce((block_type = 'body' AND first_indent = 2 AND runover_indent = 0 AND NOT centred) OR (block_type = 'heading1' AND first_indent = 0 AND runover_indent = 0 AND NOT centred), false)"),
    "p14_normalize_stream": sql("lines styled", f", n AS (SELECT doc_id, seq, trim(regexp_replace(regexp_replace(raw_line, '[‐‑‒–—−]', '-', 'g'), '[ \\t\u00a0]+', ' ', 'g')) AS line FROM styled) SELECT * FROM n WHERE line <> '' AND NOT {PAGE_NUMBER.format('line')}"),
    "a1_frequency_tables": sql("lines", "SELECT doc_id, 'width' AS kind, CAST(length(raw_line) AS INT) AS v, count(*) AS n, min(seq) AS first FROM lines WHERE trim(raw_line) <> '' GROUP BY ALL UNION ALL SELECT doc_id, 'length', CAST(c AS INT), count(*), min(page_no) FROM (SELECT doc_id, page_no, count(*) AS c FROM lines GROUP BY ALL) GROUP BY doc_id, c"),
    "a1_calibrate": sql("lines", """, v AS (SELECT doc_id, 'width' AS kind, length(raw_line) AS v, seq AS o FROM lines UNION ALL SELECT doc_id, 'length', count(*), page_no FROM lines GROUP BY doc_id, page_no),
        c AS (SELECT doc_id, kind, v, count(*) AS n, min(o) AS f FROM v GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n DESC, f) AS r FROM c)
        SELECT doc_id, max(v) FILTER (kind = 'width') AS width_mode, max(n) FILTER (kind = 'width') AS width_count, max(v) FILTER (kind = 'length') AS length_mode, max(n) FILTER (kind = 'length') AS length_count FROM b WHERE r = 1 GROUP BY doc_id"""),
    "a2_suppressed_issues": sql("lines", f", {TOTALS}, i AS (SELECT doc_id, page_no, line_no, 'line_width' AS issue_type FROM lines WHERE length(raw_line) > 44), s AS (SELECT doc_id, count(DISTINCT page_no) AS p FROM i GROUP BY doc_id) SELECT i.*, s.p > 0.3 * t.total AS suppressed FROM i JOIN s USING (doc_id) JOIN totals t USING (doc_id)"),
    "a3_collapse_patterns": sql("blocks", f""", d AS (SELECT doc_id, page_no, block_no, {REVIEW} AS issue_type FROM blocks), e AS (SELECT *, CASE WHEN issue_type = 'long_block' THEN 'high_confidence' ELSE 'needs_review' END AS tier FROM d WHERE issue_type IS NOT NULL),
        t AS (SELECT doc_id, count(*) AS n FROM blocks GROUP BY doc_id),
        p AS (SELECT doc_id, issue_type, count(*) AS hits FROM e JOIN t USING (doc_id) WHERE tier = 'needs_review' GROUP BY doc_id, issue_type, n HAVING count(*) > 0.3 * n)
        SELECT doc_id, page_no, block_no, issue_type, tier, 1 AS hits FROM e WHERE tier <> 'needs_review' OR NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = e.doc_id AND p.issue_type = e.issue_type)
        UNION ALL SELECT doc_id, 0, 0, issue_type, 'pattern', hits FROM p"""),
    "a4_heading_collapse": sql("blocks", f""", l AS (SELECT doc_id, seq, {LEVELS} AS level, length(text) % 3 AS first_indent, length(text) % 2 = 0 AS centred FROM blocks),
        c AS (SELECT doc_id, level, first_indent, centred, row_number() OVER (PARTITION BY doc_id, level ORDER BY count(*) DESC, min(seq)) AS r FROM l WHERE level LIKE 'heading%' GROUP BY doc_id, level, first_indent, centred), m AS (SELECT * FROM c WHERE r = 1)
        SELECT a.doc_id, a.level, b.level AS other_level, a.first_indent, a.centred FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.first_indent = b.first_indent AND a.centred = b.centred AND a.level < b.level"""),
    "a16_paragraph_layout": sql("lines styled", f", {FACTS} SELECT * FROM layouts"),
    "w1_page_gaps": sql("lines", f", n AS (SELECT DISTINCT doc_id, page_no, {NUMBERS} AS number FROM lines), p AS (SELECT *, lag(number) OVER (PARTITION BY doc_id ORDER BY page_no) AS previous FROM n WHERE number >= 0) SELECT doc_id, page_no, previous, number FROM p WHERE number <> previous + 1"),
    "w2_monotone_anchors": sql("lines", ", a AS (SELECT doc_id, seq AS i, (seq * 7 + doc_id) % 101 + seq AS j FROM lines) SELECT doc_id, i, j FROM (SELECT *, max(j) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM a) WHERE t IS NULL OR j > t"),
    "w3_segment_paragraphs": sql("lines styled", f", {PARA} SELECT doc_id, seq, para_no FROM segmented"),
    "w4_word_coordinates": sql("lines styled", f""", c AS (SELECT *, trim(raw_line) <> '' AND NOT {PAGE_NUMBER.format('raw_line')} AS ok FROM styled), p AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS physical_line FROM c),
        w AS (SELECT doc_id, page_no, physical_line, string_split_regex(trim(raw_line), ' +') AS ws FROM p WHERE ok) SELECT doc_id, page_no, physical_line, i AS word_no, ws[i] AS word FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM w)"""),
    "f5_braille_int": sql("lines styled", f", n AS (SELECT doc_id, seq, regexp_replace(lower(string_split(raw_line, ' ')[-1]), '^#', '') AS b FROM styled) SELECT doc_id, seq, {NUM} AS number FROM n"),
    "f19_format_check": sql("lines styled", f""", {FACTS}, t AS (SELECT *, {TYPES} AS block_type, coalesce(runover_indent, 0) AS ro FROM layouts),
        v AS (SELECT *, CASE WHEN block_type LIKE 'heading%' THEN NOT first_on_page AND blank_before < CASE block_type WHEN 'heading1' THEN 2 ELSE 1 END
            WHEN block_type = 'body' THEN first_indent <> 2 OR ro <> 0 ELSE first_indent NOT IN (0, 2) OR ro NOT IN (2, 4) END AS bad FROM t)
        SELECT doc_id, page_no, para_no, block_type, CASE WHEN block_type LIKE 'heading%' THEN 'heading_spacing_error' WHEN block_type = 'body' THEN 'paragraph_indentation_error' ELSE 'list_indentation_error' END AS issue_type,
        CASE WHEN (block_type = 'heading1' AND blank_before = 1) OR (block_type = 'body' AND abs(first_indent - 2) <= 1 AND ro = 0) THEN 'needs_review' ELSE 'high_confidence' END AS tier FROM v WHERE bad"""),
}
