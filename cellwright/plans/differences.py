"""Registered queries of the difference family and their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellwright.operators import differences as D
from cellwright.sources.testdata import layout_lines, manifest_in_place, source_blocks, sql

OTHER = "CASE (doc_id + seq) % 6 WHEN 1 THEN replace(raw_line, ' ', '  ') WHEN 2 THEN replace(raw_line, 'e', 'a') WHEN 3 THEN replace(raw_line, 'e', '') WHEN 5 THEN concat('x ', raw_line) ELSE raw_line END"
TAG = "CASE (doc_id + seq) % 6 WHEN 1 THEN 'insert' WHEN 3 THEN 'delete' ELSE 'replace' END"
STATUS = "CASE doc_id % 4 WHEN 0 THEN 'REVIEW' WHEN 1 THEN 'EXCLUDED' ELSE 'PASS' END"
LONE = ("CASE seq % 5 WHEN 0 THEN ',' WHEN 1 THEN '?!' WHEN 2 THEN concat('a ', chr(92), 'x28ab') WHEN 3 THEN right(raw_line, 1) ELSE raw_line END", "CASE seq % 4 WHEN 0 THEN '8' WHEN 1 THEN '' WHEN 2 THEN ';`' ELSE right(raw_line, 2) END")
ALLOW = [("the end", "tha end"), ("and", "ond"), ("of the", "of th")]
WORD = "CASE seq % 5 WHEN 0 THEN 'the' WHEN 1 THEN 'and' WHEN 2 THEN 'of the' WHEN 3 THEN 'the end' ELSE 'other' END"
WORD2 = "CASE seq % 7 WHEN 0 THEN 'tha' WHEN 1 THEN 'ond' WHEN 2 THEN 'of th' WHEN 3 THEN 'tha end' ELSE 'th' END"


def lines(s, d, **columns):
    return layout_lines(s, d).select("doc_id", F.col("seq").cast("long").alias("seq"), "raw_line").select("doc_id", "seq", *(F.expr(e).alias(c) for c, e in columns.items()))


#: Letter groups of a line's first two characters, and the neighbours of a letter from its length.
LETTERS = """CASE length(raw_line) % 9 WHEN 0 THEN concat(substr(raw_line, 1, 1), '(', substr(raw_line, 2, 1), ')') WHEN 1 THEN concat('([{', substr(raw_line, 2, 1), '}])') WHEN 2 THEN concat('((((((', substr(raw_line, 2, 1), '))))))')
    WHEN 3 THEN concat('[', substr(raw_line, 1, 1), '(', substr(raw_line, 2, 1), ')]') WHEN 4 THEN concat(substr(raw_line, 1, 1), '(', substr(raw_line, 1, 1), '{(', substr(raw_line, 2, 1), ')})') WHEN 5 THEN '(a]' WHEN 6 THEN 'f()' WHEN 7 THEN substr(raw_line, 1, 1) ELSE raw_line END"""
_KIND = "CASE length(raw_line) % {} WHEN 0 THEN 'space' WHEN 1 THEN 'punctuation' WHEN 2 THEN 'letter' WHEN 3 THEN 'operation' WHEN 4 THEN 'word' ELSE 'group' END"
SITES = {
    "contact": "CASE length(raw_line) % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'left' WHEN 2 THEN 'right' WHEN 3 THEN 'outside' ELSE 'near' END", "l": _KIND.format(6), "r": _KIND.format(7),
    "listed": "length(raw_line) % 8 = 0", "compared": "length(raw_line) % 9 = 0", "scripted": "length(raw_line) % 11 = 0",
}
#: A difference beside the last word of a line, and facts of the line: math from its digits, a numeric rule from its brackets.
_LAST = "substr(raw_line, length(raw_line) - 2, 3)"
CHANGE = {
    "t": "CASE length(raw_line) % 7 WHEN 0 THEN 'insert' ELSE 'replace' END",
    "e": f"CASE length(raw_line) % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN concat('_%', {_LAST}) ELSE {_LAST} END",
    "a": f"CASE length(raw_line) % 7 WHEN 0 THEN CASE WHEN length(raw_line) % 2 = 0 THEN '#ab' ELSE 'x' END WHEN 1 THEN '   ' WHEN 3 THEN replace({_LAST}, 'e', ' e') WHEN 4 THEN concat({_LAST}, ':') ELSE concat('q', {_LAST}) END",
    "st": "CASE length(raw_line) % 11 WHEN 0 THEN 'REVIEW' WHEN 1 THEN 'EXCLUDED' WHEN 2 THEN NULL ELSE 'PASS' END",
    "pay": "{match}(raw_line, '[0-9]') AND length(raw_line) % 3 = 0",
    "m": "{match}(raw_line, '[0-9]')",
    "num": "raw_line LIKE '%(%'",
}


def changed(s, d):
    return lines(s, d, **{k: v.format(match="rlike") for k, v in CHANGE.items()}).where("e <> a")


def muts(s, d):
    return manifest_in_place(s, d).withColumn("diff_id", F.col("mutation_id")).withColumn("block", F.col("line_no"))


def block_ranges(s, d):
    own = Window.partitionBy("doc_id").orderBy("seq")
    end = F.sum(F.length("text") + 1).over(own).cast("long") - 1
    return source_blocks(s, d).select("doc_id", "page_no", "seq", "text", (end - F.length("text")).alias("start"), end.alias("end"))


BR = "br AS (SELECT doc_id, page_no, seq, sum(length(text) + 1) OVER w - 1 - length(text) AS start, sum(length(text) + 1) OVER w - 1 AS \"end\" FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY seq))"


def offsets(s, d):
    return manifest_in_place(s, d).select("doc_id", F.col("expected_start").alias("at"), F.col("expected_start").alias("id"))


def pages_of(s, d):
    return block_ranges(s, d).groupBy("doc_id", "page_no").agg(F.min("start").alias("r0"), (F.max("end") + 1).alias("r1"))


def spans(s, d):
    return block_ranges(s, d).select("doc_id", F.col("seq").alias("id"), F.expr("start + (doc_id % 5)").alias("start"), F.expr("end + (doc_id + seq) % 40").alias("end")).where("start <= end")


def opcodes(s, d):
    rows = block_ranges(s, d)
    return rows.select("doc_id", F.lit(0).alias("region"), F.col("start").alias("e0"), (F.col("end") + 1).alias("e1"), (F.col("start") + F.col("seq")).alias("a0"), (F.col("end") + 1 + F.col("seq")).alias("a1"), F.expr("CASE WHEN (doc_id + seq) % 4 = 0 THEN 'replace' ELSE 'equal' END").alias("tag"))


def words(s, d):
    rows = layout_lines(s, d).select("doc_id", "seq", F.posexplode(F.split("raw_line", " ")).alias("i", "w"))
    return rows.select("doc_id", F.expr("seq * 5 + i").alias("pos"), F.expr("CASE WHEN (doc_id + seq * 5 + i) % 17 = 0 THEN concat(',\\'', w) WHEN (doc_id + seq * 5 + i) % 17 = 4 THEN concat(w, '\\'') ELSE w END").alias("word"))


QUERIES = {
    "f14_letter_group": lambda s, d: lines(s, d, x=LETTERS).select("doc_id", "seq", D.letter_group(F.col("x")).alias("g")).select("doc_id", "seq", "g.*"),
    "f14_letter_indicator": lambda s, d: lines(s, d, **SITES).select("doc_id", "seq", D.letter_indicator(*(F.col(c) for c in SITES)).alias("required")),
    "f16_mismatch_class": lambda s, d: lines(s, d, e="raw_line", a=OTHER, t=TAG).where("e <> a").select("doc_id", "seq", D.mismatch_class(F.col("e"), F.col("a"), F.col("t")).alias("severity")),
    "f17_difference_category": lambda s, d: changed(s, d).select("doc_id", "seq", D.difference_category(*(F.col(c) for c in ("t", "e", "a", "st", "pay", "m", "num"))).alias("category")),
    "f18_location_label": lambda s, d: lines(s, d, l0="seq", w0="seq % 5", l1="seq + doc_id % 2", w1="seq % 5 + doc_id % 3").select("doc_id", "seq", D.location_label(*(F.col(c) for c in ("l0", "w0", "l1", "w1"))).alias("label")),
    "f20_unspaced_equals": lambda s, d: lines(s, d, x="CASE seq % 4 WHEN 0 THEN concat('a', seq, '=b') WHEN 1 THEN 'x==y' WHEN 2 THEN 'p = q' ELSE raw_line END").select("doc_id", "seq", D.unspaced_equals(F.col("x")).alias("suggestion")),
    "p9_ignorable": lambda s, d: lines(s, d, e=LONE[0], a=LONE[1]).select("doc_id", "seq", D.ignorable(F.col("e"), F.col("a")).alias("ignored")),
    "p10_allowlist": lambda s, d: D.apply_allowlist(lines(s, d, expected=WORD, actual=WORD2), s.createDataFrame(ALLOW, "expected string, actual string")).select("doc_id", "seq", "expected", "actual"),
    "j15_locate_block": lambda s, d: D.locate_block(offsets(s, d), block_ranges(s, d)),
    "j16_split_to_pages": lambda s, d: D.split_to_pages(spans(s, d), pages_of(s, d)),
    "j17_project_span": lambda s, d: D.project_span(spans(s, d).withColumn("region", F.lit(0)), opcodes(s, d)),
    "w8_group_consecutive": lambda s, d: D.group_consecutive(muts(s, d)),
    "w9_collapse_transpositions": lambda s, d: D.collapse_transpositions(muts(s, d).withColumn("operation", F.expr("CASE WHEN expected_start % 2 = 0 THEN 'insert' ELSE 'delete' END")).withColumn("expected_start", F.expr("expected_start div 20"))),
    "w17_pair_quotes": lambda s, d: D.pair_quotes(words(s, d)),
    "a18_switch_pairs": lambda s, d: D.switch_pairs(lines(s, d, text="concat(CASE WHEN seq % 3 = 0 THEN '_% a _:' ELSE '' END, raw_line, CASE WHEN seq % 4 = 0 THEN '_% b' ELSE '' END)", records="seq % 2")),
    "a19_switch_problems": lambda s, d: D.switch_problems(lines(s, d, pos="seq", kind="CASE WHEN (doc_id * 5 + seq * 3) % 7 IN (0, 1, 4) THEN 'open' WHEN (doc_id * 5 + seq * 3) % 7 IN (2, 5) THEN 'close' END").where("kind IS NOT NULL")),
}

SEV = "CASE WHEN t IN ('insert', 'delete') THEN 3 WHEN len(se) = 1 AND len(sa) = 1 AND length(e) = length(a) AND (SELECT count(*) FROM range(1, length(e) + 1) r(i) WHERE substr(e, i, 1) <> substr(a, i, 1)) <= 2 THEN 1 WHEN len(se) = 1 AND len(sa) = 1 THEN 2 WHEN len(se) = len(sa) THEN 2 ELSE 4 END"
OV = """x AS (SELECT s.doc_id, id, page_no, greatest(start, r0) - r0 AS p0, least("end", r1) - r0 AS p1 FROM sp s JOIN pg p ON s.doc_id = p.doc_id AND start < r1 AND (r0 < "end" OR (start = "end" AND r0 <= start)))"""
SP = "sp AS (SELECT * FROM (SELECT doc_id, seq AS id, start + doc_id % 5 AS start, \"end\" + (doc_id + seq) % 40 AS \"end\" FROM br) WHERE start <= \"end\")"

ORACLE_SQL = {
    "f14_letter_group": sql("lines", f""", p AS (SELECT doc_id, seq, {LETTERS} AS x, length(raw_line) % 9 AS k, substr(raw_line, 1, 1) AS a, substr(raw_line, 2, 1) AS b FROM lines),
        q AS (SELECT *, regexp_matches(a, '[A-Za-z]') AS la, regexp_matches(b, '[A-Za-z]') AS lb FROM p), c AS (SELECT *, CASE WHEN regexp_matches(a, '[A-Z]') THEN ',' ELSE '' END || lower(a) AS ca, CASE WHEN regexp_matches(b, '[A-Z]') THEN ',' ELSE '' END || lower(b) AS cb FROM q)
        SELECT doc_id, seq, CASE WHEN (k = 0 AND la AND lb) OR (k = 4 AND la AND lb) THEN 'application' WHEN (k IN (1, 2) AND lb) OR (k = 3 AND la AND lb) THEN 'group' ELSE 'none' END AS kind,
        CASE WHEN k = 0 AND la AND lb THEN 1 WHEN k = 1 AND lb THEN 3 WHEN k = 2 AND lb THEN 6 WHEN k = 3 AND la AND lb THEN 2 WHEN k = 4 AND la AND lb THEN 3 END AS depth,
        CASE WHEN k = 0 AND la AND lb THEN ca || '(' || cb || ')' WHEN k = 1 AND lb THEN '(@(.(' || cb || '.)@))' WHEN k = 2 AND lb THEN '((((((' || cb || '))))))' WHEN k = 3 AND la AND lb THEN '@(' || ca || '(' || cb || ')@)' WHEN k = 4 AND la AND lb THEN ca || '(' || ca || '.(' || '(' || cb || ').))' END AS cells FROM c"""),
    "f14_letter_indicator": sql("lines", f""", p AS (SELECT doc_id, seq, {", ".join(f"{v} AS {k}" for k, v in SITES.items())} FROM lines)
        SELECT doc_id, seq, CASE WHEN contact = 'near' THEN NULL WHEN listed OR compared OR contact = 'both' OR (contact IN ('left', 'right') AND scripted) THEN false WHEN l = 'word' OR r = 'word' THEN NULL
        ELSE l IN ('space', 'punctuation') AND r IN ('space', 'punctuation') END AS required FROM p"""),
    "f16_mismatch_class": sql("lines", f", p AS (SELECT doc_id, seq, raw_line AS e, {OTHER} AS a, {TAG} AS t FROM lines), q AS (SELECT *, string_split(e, ' ') AS se, string_split(a, ' ') AS sa FROM p WHERE e <> a) SELECT doc_id, seq, {SEV} AS severity FROM q"),
    "f17_difference_category": sql("lines", f""", p AS (SELECT doc_id, seq, {", ".join(f"{v.format(match='regexp_matches')} AS {k}" for k, v in CHANGE.items())} FROM lines) SELECT doc_id, seq, CASE WHEN trim(e || a) = '' THEN 'layout_only' WHEN replace(e, ' ', '') = replace(a, ' ', '') THEN 'spacing_only' WHEN st = 'REVIEW' THEN 'review' WHEN st = 'EXCLUDED' THEN 'excluded'
        WHEN pay AND length(e) > 0 THEN 'math_payload' WHEN t = 'insert' AND e = '' AND st IS NOT NULL AND NOT m AND NOT num AND contains(a, '#') THEN 'numeric_sign_guard'
        WHEN contains(e, '_%') OR contains(e, '_:') OR contains(a, '_%') OR contains(a, '_:') OR (m AND regexp_matches(e || a, '[_%:]')) THEN 'switch' WHEN m THEN 'math' ELSE 'literary' END AS category FROM p WHERE e <> a"""),
    "f18_location_label": sql("lines", ", p AS (SELECT doc_id, seq, seq AS l0, seq % 5 AS w0, seq + doc_id % 2 AS l1, seq % 5 + doc_id % 3 AS w1 FROM lines) SELECT doc_id, seq, CASE WHEN l0 = l1 AND w0 = w1 THEN printf('line %d, word %d', l0, w0) WHEN l0 = l1 THEN printf('line %d, words %d-%d', l0, w0, w1) ELSE printf('line %d, word %d to line %d, word %d', l0, w0, l1, w1) END AS label FROM p"),
    "f20_unspaced_equals": sql("lines", ", p AS (SELECT doc_id, seq, CASE seq % 4 WHEN 0 THEN concat('a', seq, '=b') WHEN 1 THEN 'x==y' WHEN 2 THEN 'p = q' ELSE raw_line END AS x FROM lines) SELECT doc_id, seq, CASE WHEN regexp_matches(x, '[^=<>]=[^=<>]') THEN regexp_replace(x, '([^=<> ])=([^=<> ])', '\\1 = \\2', 'g') END AS suggestion FROM p"),
    "p9_ignorable": sql("lines", f", p AS (SELECT doc_id, seq, {LONE[0]} AS e, {LONE[1]} AS a FROM lines) SELECT doc_id, seq, (regexp_matches(e, '^[''\"`,;:.*?078 ]{{1,2}}$') AND e NOT LIKE '% %' AND regexp_matches(a, '^[''\"`,;:.*?078 ]{{1,2}}$') AND trim(a) <> '' AND trim(e) <> '') OR regexp_matches(e, '\\\\[Xx][0-9A-Fa-f]{{4,}}') AS ignored FROM p"),
    "p10_allowlist": sql("lines", f", p AS (SELECT doc_id, seq, {WORD} AS expected, {WORD2} AS actual FROM lines) SELECT * FROM p WHERE (expected, actual) NOT IN (('the end', 'tha end'), ('and', 'ond'), ('of the', 'of th'), ('the', 'tha'), ('the', 'th'))"),
    "j15_locate_block": sql("lines blocks cells muts", f", {BR} SELECT m.doc_id, expected_start AS id, expected_start AS \"at\", seq FROM muts m LEFT JOIN br ON br.doc_id = m.doc_id AND expected_start >= start AND expected_start < \"end\""),
    "j16_split_to_pages": sql("blocks", f", {BR}, {SP}, pg AS (SELECT doc_id, page_no, min(start) AS r0, max(\"end\") + 1 AS r1 FROM br GROUP BY ALL), {OV} SELECT * FROM x"),
    "j17_project_span": sql("blocks", f""", {BR}, {SP}, o AS (SELECT doc_id, start AS r0, "end" + 1 AS r1, start + seq AS a0, "end" + 1 + seq AS a1, CASE WHEN (doc_id + seq) % 4 = 0 THEN 'replace' ELSE 'equal' END AS tag FROM br),
        x AS (SELECT s.doc_id, id, CASE WHEN tag = 'equal' THEN a0 + greatest(start, r0) - r0 ELSE a0 END AS lo, CASE WHEN tag = 'equal' THEN a0 + least("end", r1) - r0 ELSE a1 END AS hi FROM sp s JOIN o ON s.doc_id = o.doc_id AND start < r1 AND (r0 < "end" OR (start = "end" AND r0 <= start)))
        SELECT doc_id, 0 AS region, id, min(lo) AS a0, max(hi) AS a1 FROM x GROUP BY doc_id, id"""),
    "w8_group_consecutive": sql("lines cells muts", ", f AS (SELECT *, CASE WHEN lag(page_no) OVER w IS DISTINCT FROM page_no OR lag(family) OVER w IS DISTINCT FROM family OR family = 'punctuation' THEN 1 ELSE 0 END AS new FROM muts WINDOW w AS (PARTITION BY doc_id ORDER BY expected_start)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY expected_start) AS group_no FROM f) SELECT doc_id, group_no, min(page_no) AS page_no, min(family) AS family, count(*) AS n, min(expected_start) AS first, max(expected_start) AS last FROM g GROUP BY doc_id, group_no"),
    "w9_collapse_transpositions": sql("lines cells muts", """, d AS (SELECT doc_id, page_no, line_no AS block, mutation_id AS diff_id, CASE WHEN expected_start % 2 = 0 THEN 'insert' ELSE 'delete' END AS operation, expected_start // 20 AS expected_start FROM muts),
        j AS (SELECT *, coalesce(operation <> lead(operation) OVER w AND block = lead(block) OVER w AND abs(lead(expected_start) OVER w - expected_start) <= 1, false) AS joins FROM d WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY expected_start, diff_id)),
        c AS (SELECT *, sum(CASE WHEN l THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY expected_start, diff_id) AS chain FROM (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id, page_no ORDER BY expected_start, diff_id), false) AS l FROM j)),
        p AS (SELECT *, joins AND row_number() OVER (PARTITION BY doc_id, page_no, chain ORDER BY expected_start, diff_id) % 2 = 1 AS opens FROM c), u AS (SELECT *, coalesce(lag(opens) OVER (PARTITION BY doc_id, page_no ORDER BY expected_start, diff_id), false) AS used FROM p)
        SELECT doc_id, page_no, diff_id, expected_start, CASE WHEN opens THEN 'substitute' ELSE operation END AS operation FROM u WHERE NOT used"""),
    "w17_pair_quotes": sql("lines", ", w AS (SELECT doc_id, seq * 5 + i - 1 AS pos, ws[i] AS w FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM (SELECT doc_id, seq, string_split(raw_line, ' ') AS ws FROM lines))), q AS (SELECT doc_id, pos, CASE WHEN (doc_id + pos) % 17 = 0 THEN ',''' || w WHEN (doc_id + pos) % 17 = 4 THEN w || '''' ELSE w END AS word FROM w), c AS (SELECT *, min(CASE WHEN word LIKE '%''' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS closing FROM q) SELECT doc_id, pos, word, closing FROM c WHERE word LIKE '''%' OR word LIKE ',''%'"),
    "a18_switch_pairs": sql("lines", ", t AS (SELECT doc_id, seq, concat(CASE WHEN seq % 3 = 0 THEN '_% a _:' ELSE '' END, raw_line, CASE WHEN seq % 4 = 0 THEN '_% b' ELSE '' END) AS text, seq % 2 AS records FROM lines), c AS (SELECT doc_id, seq, records, len(regexp_extract_all(text, '_%')) AS openings, len(regexp_extract_all(text, '_:')) AS closings FROM t) SELECT *, openings = records AND closings = records AS ok FROM c"),
    "a19_switch_problems": sql("lines", ", k AS (SELECT doc_id, seq AS pos, CASE WHEN (doc_id * 5 + seq * 3) % 7 IN (0, 1, 4) THEN 'open' WHEN (doc_id * 5 + seq * 3) % 7 IN (2, 5) THEN 'close' END AS kind FROM lines), p AS (SELECT *, lag(kind) OVER w AS b, lead(kind) OVER w AS a FROM k WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), q AS (SELECT doc_id, pos, CASE WHEN kind = 'open' AND b = 'open' THEN 'nested_open' WHEN kind = 'close' AND b IS DISTINCT FROM 'open' THEN 'close_without_open' WHEN kind = 'open' AND a IS NULL THEN 'unclosed' END AS problem FROM p) SELECT * FROM q WHERE problem IS NOT NULL"),
}
