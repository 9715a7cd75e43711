"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

from cellwright.llm import mixing, quality, secrets

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def quality_sql() -> str:
    """op1: the counts, then the estimates step by step, one relation each."""
    q = quality
    p, names = len(q.FEATURES), ", ".join(q.FEATURES)
    parts = [
        f"d AS (SELECT doc_id, lang, source, text, {WORDS} AS w FROM documents)",
        """win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)))""",
        "rep AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM win WHERE k > 1) GROUP BY doc_id)",
        """counted AS (SELECT d.doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id))""",
        "stats AS (SELECT *, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM counted)",
        """feat AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, coalesce('=' || lang, '-') AS gl, coalesce('=' || lang, '-') || chr(10) || coalesce('=' || source, '-') AS gs,
        ln(CAST(greatest(word_chars, 1) AS DOUBLE) / greatest(n_words, 1)) AS f1, sqrt(n_symbols / greatest(word_chars, 1)) AS f2, sqrt(n_dup_lines / greatest(n_lines, 1)) AS f3, sqrt(n_repeat_words / greatest(n_words, 1)) AS f4 FROM stats)""",
        f"""named AS (SELECT gs, CASE WHEN k >= {q.MIN_ROWS} THEN '1' || gs WHEN sum(CASE WHEN k < {q.MIN_ROWS} THEN k ELSE 0 END) OVER (PARTITION BY gl) >= {q.MIN_ROWS} THEN '2' || gl ELSE '3' END AS g, k FROM (SELECT gs, gl, count(*) AS k FROM feat GROUP BY ALL))""",
        f"grouped AS (SELECT feat.*, CASE WHEN g <> '3' OR total >= {q.MIN_ROWS} THEN g END AS grp FROM feat JOIN (SELECT *, sum(k) OVER (PARTITION BY g) AS total FROM named) USING (gs))",
        f"used AS (SELECT grp, doc_id, {names} FROM grouped WHERE grp IS NOT NULL)",
    ]

    def medians(name: str, source: str, prefix: str) -> str:
        each = " UNION ALL ".join(f"SELECT grp, '{f}' AS f, floor({f} * 200) AS b FROM {source}" for f in q.FEATURES)
        picks = ", ".join(f"max(CASE WHEN f = '{f}' THEN b / 200.0 END) AS {prefix}_{f}" for f in q.FEATURES)
        return f"""{name} AS (SELECT grp, {picks} FROM (SELECT grp, f, CAST(min(b) AS DOUBLE) AS b FROM (SELECT grp, f, b, sum(count(*)) OVER (PARTITION BY grp, f ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY grp, f) AS total
            FROM ({each}) GROUP BY grp, f, b) WHERE 2 * upto >= total GROUP BY grp, f) GROUP BY grp)"""

    parts.append(medians("centre", "used", "c"))
    parts.append("around AS (SELECT grp, " + ", ".join(f"abs({f} - c_{f}) AS {f}" for f in q.FEATURES) + " FROM used JOIN centre USING (grp))")
    parts.append(medians("spread", "around", "d"))
    parts.append("e0 AS (SELECT * FROM centre JOIN spread USING (grp))")
    distance = q.start_distance_sql()
    for step in range(q.STEPS):
        parts.append(f"p{step} AS (SELECT u.*, {', '.join(f'c_{f}' for f in q.FEATURES)}, {q.bin_sql(distance)} AS bin FROM used u JOIN e{step} USING (grp))")
        parts.append(f"h{step} AS (SELECT grp, min(bin) AS cut FROM (SELECT grp, bin, sum(count(*)) OVER (PARTITION BY grp ORDER BY bin) AS upto, sum(count(*)) OVER (PARTITION BY grp) AS total FROM p{step} GROUP BY grp, bin) WHERE upto >= {q.SUPPORT} * total GROUP BY grp)")
        sums = ", ".join(f"{e} AS {c}" for c, e in q.moment_sql().items())
        parts.append(f"s{step}_0 AS (SELECT * FROM centre JOIN (SELECT grp, {sums} FROM p{step} JOIN h{step} USING (grp) WHERE bin <= cut GROUP BY grp) USING (grp))")
        for n, layer in enumerate(q.estimate_sql()):
            parts.append(f"s{step}_{n + 1} AS (SELECT *, {', '.join(f'{e} AS {c}' for c, e in layer.items())} FROM s{step}_{n})")
        parts.append(f"e{step + 1} AS (SELECT * FROM s{step}_{len(q.estimate_sql())})")
        distance = q.distance_sql()
    assert p == 4
    return (
        "WITH " + ", ".join(parts) + f""" SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND NOT outlier AS kept, distance
        FROM (SELECT g.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed, coalesce({q.verdict_sql()}, false) AS outlier, {distance} AS distance FROM grouped g LEFT JOIN e{q.STEPS} USING (grp))"""
    )


def mixing_sql() -> str:
    """op8: targets by water-filling, keys from the id's MD5 value, prefix sums with gap filling."""
    m = mixing
    passes = ["i0 AS (SELECT *, rest - before AS gap, false AS more FROM placed WHERE bucket = stop)"]
    order = "PARTITION BY source ORDER BY rank DESC, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    for k in range(m.FILLS):
        passes.append(f"j{k} AS (SELECT *, coalesce(NOT more AND size <= gap AND sum(CASE WHEN NOT more AND size <= gap THEN size END) OVER ({order}) <= gap, false) AS now FROM i{k})")
        passes.append(f"i{k + 1} AS (SELECT * EXCLUDE (more, now, gap), more OR now AS more, gap - sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM j{k})")
    return f"""WITH sized AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) AS name, len({WORDS}) AS size, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols FROM documents),
        keyed AS (SELECT doc_id, source, size, pow((CAST('0x' || substr(md5(name), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE, 1 / greatest({m.LEAST_WEIGHT}, 1.0 - CAST(symbols AS DOUBLE) / greatest(size, 1))) AS rank FROM sized),
        src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM keyed GROUP BY source),
        wt AS (SELECT *, CAST([{', '.join(map(str, m.WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(m.WEIGHTS)}] AS DOUBLE) AS w, {m.MAX_EPOCHS} * source_size::DOUBLE AS cap, {m.BUDGET_SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM src),
        lv AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
        tg AS (SELECT source, source_size, n, CASE WHEN cap <= level * w THEN cap ELSE least(cap, w * max(CASE WHEN cap > level * w THEN level END) OVER ()) END AS target FROM lv),
        pl AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs, ceil(n / {m.BUCKET}) AS buckets FROM tg),
        bk AS (SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest, floor((1 - rank) * buckets) AS bucket FROM keyed k JOIN pl ON k.source IS NOT DISTINCT FROM pl.source),
        su AS (SELECT source, bucket, sum(size) AS s, any_value(rest) AS rest, sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM bk GROUP BY source, bucket),
        en AS (SELECT source, min(bucket) AS stop, arg_min(upto - s, bucket) AS before FROM su WHERE upto > rest GROUP BY source),
        placed AS (SELECT bk.*, stop, before FROM bk LEFT JOIN en ON bk.source IS NOT DISTINCT FROM en.source), {', '.join(passes)},
        alls AS (SELECT doc_id, size, source_size, target, epochs, more FROM i{m.FILLS} UNION ALL SELECT doc_id, size, source_size, target, epochs, CASE WHEN stop IS NULL THEN rest > 0 ELSE bucket < stop END FROM placed WHERE stop IS NULL OR bucket <> stop)
        SELECT doc_id, size, source_size, target, size * (epochs + CASE WHEN more THEN 1 ELSE 0 END) AS taken FROM alls"""


def secrets_sql() -> str:
    """op10: every rule over every text, positions from the lengths of matches and of what lies between."""
    parts = []
    for n, rule in enumerate(secrets.RULES):
        quoted = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT r, {n} AS kind, '{rule.kind}' AS name, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n, length(v[i]) AS size, {rule.least} AS least "
            f"FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT r, regexp_extract_all(text, {quoted}) AS m, regexp_extract_all(text, {quoted}, {rule.group}) AS v, string_split_regex(text, {quoted}) AS g FROM d WHERE regexp_matches(text, {quoted})))"
        )
    counts = ", ".join(f"count(*) FILTER (kind = {n}) AS n_{secrets.RULES[n].kind}" for n in range(secrets.BASE))
    joined = "coalesce(string_agg(name || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, kind){}, '')"
    return (
        "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE size >= least) "
        f"SELECT doc_id, {counts}, sha256({joined.format(f' FILTER (kind < {secrets.BASE})')}) AS base_sha256, {joined.format('')} AS spans FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id"
    )


def audit_sql() -> str:
    """op11: every mask against every order, step by step."""
    return f"""WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
    orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
        WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
    d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
    low AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
    masked AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > m THEN 'E' ELSE '' END AS mask FROM d JOIN low USING (t)),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    counts AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masked LEFT JOIN l USING (doc_id) GROUP BY ALL),
    steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS k FROM orders),
    facts AS (SELECT part, o, k, substr(o, k, 1) AS f, n, good, toxic, mask, contains(mask, substr(o, k, 1)) AS fails, translate(mask, substr(o, 1, k - 1), '') = mask AS reached,
        translate(mask, substr(o, 1, k), '') = mask AS stays FROM counts, steps),
    summed AS (SELECT part, o, k, f, coalesce(sum(n) FILTER (stays), 0) AS kept, coalesce(sum(n) FILTER (fails AND reached), 0) AS removed, coalesce(sum(n) FILTER (fails AND NOT reached), 0) AS redundant,
        coalesce(sum(n) FILTER (mask = f), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND reached), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND reached), 0) AS toxic_lost FROM facts GROUP BY ALL)
    SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
        CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM summed"""
