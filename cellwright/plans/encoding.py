"""Registered queries of the encoding family and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwright.functions import braille as B
from cellwright.functions import encoding as E
from cellwright.operators import streams as S
from cellwright.sources.testdata import expected_cells, layout_lines, source_blocks, sql

CELLS = B.ASCII_CELLS.replace("'", "''")
UP = f"translate({{0}}, '{B.LOWER}', '{B.UPPER}')"
CHARS = "list_filter(string_split({0}, ''), lambda x: x <> '')"
MASK = f"nullif(instr('{CELLS}', {UP.format('x')}), 0) - 1"


def text(column, name="out"):
    return lambda s, d: layout_lines(s, d).select("doc_id", "seq", column(F.col("raw_line")).alias(name))


def masks(s, d):
    return layout_lines(s, d).select("doc_id", "seq", F.filter(B.to_masks(F.col("raw_line")), lambda m: m.isNotNull()).alias("m"))


SIGNS = "concat(raw_line, ' @[', chr(92), ']^`{|}~_')"
ALIAS = f"instr('{CELLS}', translate(translate(x, '{B.SECOND_HALF}', '{B.FIRST_HALF}'), '{B.LOWER}', '{B.UPPER}'))"


def dialect(name):
    return lambda s, d: layout_lines(s, d).select("doc_id", "seq", F.filter(B.to_masks(F.expr(SIGNS), name), lambda m: m.isNotNull()).alias("m"))


def dialect_sql(name):
    seven = f"CASE WHEN regexp_matches(x, '{B.DOT_SEVEN[name]}') THEN 64 ELSE 0 END"
    return sql("lines", f" SELECT doc_id, seq, list_filter(list_transform({CHARS.format(SIGNS)}, lambda x: nullif({ALIAS}, 0) - 1 + {seven}), lambda y: y IS NOT NULL) AS m FROM lines")


MASKS = f"m AS (SELECT doc_id, seq, list_filter(list_transform({CHARS.format('raw_line')}, lambda x: {MASK}), lambda x: x IS NOT NULL) AS m FROM lines)"


def scope(profile):
    return lambda s, d: source_blocks(s, d).select("doc_id", "seq", E.scope_check(F.col("text"), profile).alias("c")).select("doc_id", "seq", "c.*")


def scope_sql(profile):
    one, two = (f"regexp_extract(text, '{x}')" for x in ("(?:^|[^A-Za-z0-9])-", "-(?:[^A-Za-z0-9]|$)"))
    near = f"least(CASE WHEN {one} <> '' THEN instr(text, {one}) + length({one}) - 2 ELSE {1 << 30} END, CASE WHEN {two} <> '' THEN instr(text, {two}) - 1 ELSE {1 << 30} END)"
    stray = near if profile == "case4" else str(1 << 30)
    inside = E.SCOPES[profile].replace("'", "''")
    return sql("blocks", f", a AS (SELECT *, least(length(regexp_extract(text, '^{inside}*', 0)), {stray}) AS o FROM blocks) SELECT doc_id, seq, o >= length(text) AS ok, CASE WHEN o < length(text) THEN o END AS \"offset\", CASE WHEN o < length(text) THEN unicode(substr(text, o + 1, 1)) END AS codepoint FROM a")


MATH = "concat(CASE WHEN seq % 3 = 0 THEN '-' ELSE '' END, doc_id % 50, CASE seq % 4 WHEN 0 THEN ' + ' WHEN 1 THEN '-' WHEN 2 THEN ' × ' ELSE ' ÷ ' END, CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '12' END, CASE WHEN seq % 5 = 0 THEN ' = -7' WHEN seq % 5 = 1 THEN '=y' WHEN seq % 5 = 2 THEN ' == 1' ELSE '' END)"
NUMBERY = "concat(doc_id, ' ', 100 + seq % 900, ' ', doc_id % 10, '-', CASE seq % 4 WHEN 0 THEN 'a ' WHEN 1 THEN 'yr ' WHEN 2 THEN 'CD ' ELSE 'ab ' END, raw_line, '  ', seq % 10, '-?')"
MARKED = "CASE seq % 4 WHEN 0 THEN concat(raw_line, '[[*ts*]]x+1[[*te*]]', seq) WHEN 1 THEN concat('[[*ts*]]', raw_line) WHEN 2 THEN concat('[[*ts*]]a[[*ts*]]', raw_line, '[[*te*]]') ELSE raw_line END"
SCRIPT = "concat('– 3', CASE seq % 4 WHEN 0 THEN '^{12}' WHEN 1 THEN '_{i} = − 4' WHEN 2 THEN '∑ x' ELSE ' [Figure 1]' END, ' ', raw_line)"
PAYLOAD = "CASE seq % 3 WHEN 0 THEN concat('  ', raw_line, ' ') WHEN 1 THEN '' ELSE raw_line END"
NAMES = "CASE seq % 6 WHEN 0 THEN 'Case 3' WHEN 1 THEN 'numbers' WHEN 2 THEN 'CASE-1' WHEN 3 THEN 'case4' WHEN 4 THEN 'unknown one' ELSE 'Phase  1' END"


def derived(expression, column, name="out"):
    return lambda s, d: layout_lines(s, d).select("doc_id", "seq", column(F.expr(expression)).alias(name))


def linear(s, d):
    rows = layout_lines(s, d).withColumn("x", F.expr(MATH))
    return rows.select("doc_id", "seq", E.is_linear_expr(F.col("x")).alias("ok"), E.linear_tokens(F.col("x")).alias("tokens"))


def linear_cells(s, d):
    return linear(s, d).where("ok").select("doc_id", "seq", E.encode_linear(F.col("tokens")).alias("cells"))


LINEAR_CTE = f"x AS (SELECT doc_id, seq, {MATH} AS x FROM lines), t AS (SELECT doc_id, seq, regexp_matches(x, '{E.LINEAR}') AND NOT regexp_matches(x, '^ *[a-z] *$') AS ok, regexp_extract_all(x, '[0-9]+|[a-z]|[-+×÷=]') AS tokens FROM x)"


def encoded(s, d):
    rows = layout_lines(s, d).select("doc_id", "seq", F.posexplode(E.encode_uncontracted(F.expr(NUMBERY))).alias("i", "e"))
    return rows.select("doc_id", "seq", "i", "e.cell", "e.offset")


ENCODED = f"""c AS (SELECT doc_id, seq, o, regexp_extract(substr(x, 1, o + 1), '[A-Za-z]*$') AS before, regexp_extract(substr(x, o + 2), '^[A-Za-z]*') AS after, substr(x, o + 1, 1) AS c, CASE WHEN o > 0 THEN substr(x, o, 1) END AS p FROM (SELECT *, unnest(generate_series(0, length(x) - 1)) AS o FROM (SELECT doc_id, seq, {NUMBERY} AS x FROM lines))),
    e AS (SELECT doc_id, seq, o, CASE WHEN regexp_matches(before || after, '^[A-Z]{{2,}}$') AND regexp_matches(c, '[A-Z]') THEN CASE WHEN length(before) = 1 THEN ',,' ELSE '' END WHEN regexp_matches(c, '[A-Z]') THEN ',' WHEN regexp_matches(c, '[0-9]') AND NOT coalesce(regexp_matches(p, '[0-9.,]'), false) THEN '#' WHEN regexp_matches(c, '[a-j]') AND coalesce(regexp_matches(p, '[0-9]'), false) THEN ';' ELSE '' END
    || translate(translate(c, '{B.LOWER}', '{B.UPPER}'), '1234567890.,;:!?', '{B.DIGIT_LETTERS.upper()}412368') AS s FROM c)"""


def capitals(s, d):
    rows = layout_lines(s, d).select("doc_id", "seq", F.posexplode(E.capital_sites(F.expr(NUMBERY))).alias("i", "w"))
    return rows.select("doc_id", "seq", "i", "w.*")


def control_cells(s, d):
    return expected_cells(s, d).withColumn("mask", F.expr("CASE WHEN pos % 13 = 0 THEN 24 WHEN pos % 13 = 1 THEN CASE WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 4 = 1 THEN 54 WHEN doc_id % 4 = 2 THEN 4 ELSE 9 END ELSE mask END"))


CONTROL = "k AS (SELECT doc_id, pos, page_no, CASE WHEN pos % 13 = 0 THEN 24 WHEN pos % 13 = 1 THEN CASE WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 4 = 1 THEN 54 WHEN doc_id % 4 = 2 THEN 4 ELSE 9 END ELSE mask END AS mask FROM cells)"
MATHS = "(doc_id + seq * 3) % 4"


def math_blocks(s, d):
    return source_blocks(s, d).select("doc_id", "page_no", "seq", F.expr(f"CASE WHEN {MATHS} IN (0, 1) THEN 1 ELSE 0 END").alias("starts"), F.expr(f"CASE WHEN {MATHS} IN (1, 2) THEN 1 ELSE 0 END").alias("ends"))


def payload(fn, *parts):
    return lambda s, d: layout_lines(s, d).select("doc_id", "seq", fn(F.expr(parts[0])).alias("o")).select("doc_id", "seq", "o.*")


QUERIES = {
    "f1_unicode_round_trip": lambda s, d: layout_lines(s, d).select("doc_id", "seq", B.ascii_to_unicode(F.col("raw_line")).alias("cells"), B.unicode_to_ascii(B.ascii_to_unicode(F.col("raw_line"))).alias("back")),
    "f2_to_masks": masks,
    "f2_to_masks_liblouis": dialect("liblouis"),
    "f2_to_masks_liblouis_math": dialect("liblouis_math"),
    "f3_masks_to_text": lambda s, d: masks(s, d).select("doc_id", "seq", B.masks_to_unicode(F.col("m")).alias("cells"), B.masks_to_ascii(F.col("m")).alias("printed")),
    "f4_dot_notation": lambda s, d: expected_cells(s, d).where("mask IS NOT NULL").groupBy("mask").count().select("mask", B.dot_notation(F.col("mask")).alias("dots"), F.col("count").alias("n")),
    "f4_codepoints": text(B.codepoints),
    "f6_encode_uncontracted": encoded,
    "f7_mark_numeric_spaces": derived(NUMBERY, E.mark_numeric_spaces),
    "f8_normalize_punctuation": derived(NUMBERY, E.normalize_punctuation),
    "f9_split_marked": payload(E.split_marked, MARKED),
    "f10_linear_expr": linear,
    "f11_encode_linear": linear_cells,
    "f12_wrap_switch": derived(PAYLOAD, E.wrap_switch),
    "f13_normalize_math": payload(E.normalize_math, SCRIPT),
    "f15_capital_sites": capitals,
    "p5_scope_phase1": scope("phase1"),
    "p5_scope_case1": scope("case1"),
    "p5_scope_case2": scope("case2"),
    "p5_scope_case3": scope("case3"),
    "p5_scope_case4": scope("case4"),
    "p12_construct_status": derived(SCRIPT, E.construct_status, "status"),
    "p13_resolve_profile": derived(NAMES, E.resolve_profile, "profile"),
    "w6_stream_offsets": lambda s, d: S.stream_offsets(layout_lines(s, d)),
    "w13_group_math_blocks": lambda s, d: S.group_math_blocks(math_blocks(s, d)),
    "w15_strip_control_pairs": lambda s, d: S.strip_control_pairs(control_cells(s, d)).select("doc_id", "pos", "raw_pos", "mask"),
}

ORACLE_SQL = {
    "f1_unicode_round_trip": sql("lines", f"SELECT doc_id, seq, translate({UP.format('raw_line')}, '{CELLS}', '{B.UNICODE_CELLS}') AS cells, translate(translate({UP.format('raw_line')}, '{CELLS}', '{B.UNICODE_CELLS}'), '{B.UNICODE_CELLS}', '{CELLS}') AS back FROM lines"),
    "f2_to_masks": sql("lines", f", {MASKS} SELECT * FROM m"),
    "f2_to_masks_liblouis": dialect_sql("liblouis"),
    "f2_to_masks_liblouis_math": dialect_sql("liblouis_math"),
    "f3_masks_to_text": sql("lines", f", {MASKS} SELECT doc_id, seq, array_to_string(list_transform(m, lambda x: chr(CAST(10240 + x AS INT))), '') AS cells, array_to_string(list_transform(m, lambda x: substr('{CELLS}', x + 1, 1)), '') AS printed FROM m"),
    "f4_dot_notation": sql("lines cells", "SELECT mask, CASE WHEN mask = 0 THEN '0' ELSE array_to_string(list_filter(generate_series(1, 8), lambda x: (mask >> (x - 1)) & 1 = 1), '') END AS dots, count(*) AS n FROM cells WHERE mask IS NOT NULL GROUP BY mask"),
    "f4_codepoints": sql("lines", f"SELECT doc_id, seq, array_to_string(list_transform({CHARS.format('raw_line')}, lambda x: 'U+' || printf('%04X', unicode(x))), ' ') AS out FROM lines"),
    "f6_encode_uncontracted": sql("lines", f", {ENCODED} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id, seq ORDER BY o, k) - 1 AS i, substr(s, k, 1) AS cell, o AS \"offset\" FROM (SELECT *, unnest(generate_series(1, length(s))) AS k FROM e)"),
    # RE2 has no look-ahead: each replacement consumes its right neighbour, so runs are replaced twice
    "f7_mark_numeric_spaces": sql("lines", f", x AS (SELECT doc_id, seq, {NUMBERY} AS x FROM lines), g AS (SELECT doc_id, seq, regexp_replace(regexp_replace(x, '([0-9]) ([0-9]{{3}})($|[^0-9])', '\\1\ue001\\2\\3', 'g'), '([0-9]) ([0-9]{{3}})($|[^0-9])', '\\1\ue001\\2\\3', 'g') AS x FROM x) SELECT doc_id, seq, regexp_replace(x, '([0-9])-([a-zA-Z]|[yY][rR]|[A-Z]{{2,}})($|[^a-zA-Z])', '\\1-\ue002\\2\\3', 'g') AS out FROM g"),
    "f8_normalize_punctuation": sql("lines", f"SELECT doc_id, seq, regexp_replace(regexp_replace({NUMBERY}, '([.;:!?]) +', '\\1 ', 'g'), '([0-9]-[.,;:!]?)[?]', '\\1\ue002?', 'g') AS out FROM lines"),
    "f9_split_marked": sql("lines", f", x AS (SELECT doc_id, seq, {MARKED} AS x FROM lines), p AS (SELECT *, string_split_regex(x, '\\[\\[\\*t[se]\\*\\]\\]') AS s, regexp_matches(array_to_string(regexp_extract_all(x, '\\[\\[\\*(t[se])\\*\\]\\]', 1), ''), '^(?:tste)*$') AS ok FROM x) SELECT doc_id, seq, ok, CASE WHEN ok THEN list_filter(s, lambda y, i: i % 2 = 1) END AS plain, CASE WHEN ok THEN list_filter(s, lambda y, i: i % 2 = 0) END AS marked FROM p"),
    "f10_linear_expr": sql("lines", f", {LINEAR_CTE} SELECT * FROM t"),
    "f11_encode_linear": sql("lines", f""", {LINEAR_CTE}, u AS (SELECT doc_id, seq, i, tokens[i] AS t, CASE WHEN i > 1 THEN tokens[i - 1] END AS b, CASE WHEN i > 2 THEN tokens[i - 2] END AS e FROM (SELECT *, unnest(generate_series(1, len(tokens))) AS i FROM t WHERE ok))
        SELECT doc_id, seq, string_agg(CASE WHEN regexp_matches(t, '^[0-9]') THEN CASE WHEN b IS NULL OR b = '=' OR (b = '-' AND (e IS NULL OR e = '=')) THEN '#' ELSE '' END || t WHEN regexp_matches(t, '^[a-z]$') THEN upper(t) WHEN t = '×' THEN '*' WHEN t = '÷' THEN '/' WHEN t = '=' THEN ' .K ' ELSE t END, '' ORDER BY i) AS cells FROM u GROUP BY doc_id, seq"""),
    "f12_wrap_switch": sql("lines", f", x AS (SELECT doc_id, seq, {PAYLOAD} AS x FROM lines) SELECT doc_id, seq, CASE WHEN trim(x) = '' THEN x ELSE '_% ' || trim(x) || ' _:' END AS out FROM x"),
    "f13_normalize_math": sql("lines", f""", x AS (SELECT doc_id, seq, {SCRIPT} AS x FROM lines), s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(x, '[‐‑‒–—−]', '-', 'g'), '\\^\\{{([^}}]*)\\}}', '^\\1', 'g'), '_\\{{([^}}]*)\\}}', '_\\1', 'g') AS s FROM x)
        SELECT doc_id, seq, regexp_replace(s, '(^|[=(]) *- +', '\\1-', 'g') AS text, [len(regexp_extract_all(x, '[‐‑‒–—−]')), len(regexp_extract_all(x, '[\\^_]\\{{[^}}]*\\}}')), len(regexp_extract_all(s, '(^|[=(]) *- +'))] AS changes FROM s"""),
    "f15_capital_sites": sql("lines", f""", {ENCODED}, k AS (SELECT c.doc_id, c.seq, c.o, c.before || c.after AS word, s, coalesce(sum(length(s)) OVER (PARTITION BY c.doc_id, c.seq ORDER BY c.o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, length(c.before) = 1 AS first FROM c JOIN e USING (doc_id, seq, o)),
        w AS (SELECT *, CASE WHEN regexp_matches(word, '^[A-Z][a-z]*$') THEN 'initial' WHEN regexp_matches(word, '^[A-Z]+$') THEN 'all' ELSE 'mixed' END AS state FROM k WHERE first AND regexp_matches(word, '[A-Z]'))
        SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id, seq ORDER BY o) - 1 AS i, word, state, o AS source_start, CASE WHEN state = 'initial' THEN CAST(place AS INT) END AS expected_start, CASE WHEN state = 'initial' THEN substr(s, 2, 1) END AS following FROM w"""),
    "p5_scope_phase1": scope_sql("phase1"),
    "p5_scope_case1": scope_sql("case1"),
    "p5_scope_case2": scope_sql("case2"),
    "p5_scope_case3": scope_sql("case3"),
    "p5_scope_case4": scope_sql("case4"),
    "p12_construct_status": sql("lines", f", x AS (SELECT doc_id, seq, {SCRIPT} AS x FROM lines) SELECT doc_id, seq, CASE WHEN regexp_matches(lower(x), '\\[figure|figure placeholder') THEN 'EXCLUDED' WHEN regexp_matches(regexp_replace(x, '[_^][0-9a-z]', '', 'g'), '[_^{{}}\\\\]|[∫∑√]') THEN 'REVIEW' ELSE 'PASS' END AS status FROM x"),
    "p13_resolve_profile": sql("lines", "SELECT doc_id, seq, CASE seq % 6 WHEN 0 THEN 'case3' WHEN 1 THEN 'case3' WHEN 2 THEN 'case1' WHEN 3 THEN 'case4' WHEN 4 THEN NULL ELSE 'phase1' END AS profile FROM lines"),
    "w6_stream_offsets": sql("lines", ", p AS (SELECT doc_id, page_no, sum(length(raw_line) + 1) - 1 AS cells FROM lines GROUP BY ALL), q AS (SELECT *, coalesce(sum(cells + 1) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS po FROM p) SELECT l.doc_id, l.page_no, line_no, po + coalesce(sum(length(raw_line) + 1) OVER (PARTITION BY l.doc_id, l.page_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_offset, po AS page_offset FROM lines l JOIN q USING (doc_id, page_no)"),
    "w13_group_math_blocks": sql("blocks", f""", m AS (SELECT doc_id, page_no, seq, CASE WHEN {MATHS} IN (0, 1) THEN 1 ELSE 0 END AS starts, CASE WHEN {MATHS} IN (1, 2) THEN 1 ELSE 0 END AS ends FROM blocks),
        r AS (SELECT *, sum(starts - ends) OVER w AS s FROM m WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY seq)), b AS (SELECT *, s - least(0, min(s) OVER w) AS balance FROM r WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY seq)),
        g AS (SELECT *, coalesce(lag(balance) OVER w, 0) AS prev FROM b WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY seq))
        SELECT doc_id, page_no, seq, sum(CASE WHEN prev = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS group_no, balance, CASE WHEN prev + starts - ends < 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM g"""),
    "w15_strip_control_pairs": sql("lines cells", f", {CONTROL}, p AS (SELECT *, lead(mask) OVER w AS n, lag(mask) OVER w AS b FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, pos AS raw_pos, mask FROM p WHERE NOT coalesce(mask = 24 AND n IN (2, 54, 4), false) AND NOT coalesce(b = 24 AND mask IN (2, 54, 4), false)"),
}
