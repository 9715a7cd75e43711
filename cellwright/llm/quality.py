"""Quality rules: robust multivariate outliers per language and source, in DataFrame functions only.

Every document gets a vector of transformed text statistics.  Within each language and
source the location and scatter of these vectors are estimated by minimum covariance
determinant: start from coordinate medians and deviations, then concentration steps that
keep the share ``support`` of rows nearest by Mahalanobis distance and estimate anew.
Documents beyond a chi-square quantile (``TAIL``) are rejected, whichever statistics or
combination of them puts them there.

Order statistics come from histograms with a fixed number of bins a group, so the result
does not depend on partitioning and no group is ever gathered; the scatter has a floor
(``SCALE_FLOOR``) so constant statistics stay invertible.

Defined results: null text counts as empty; null language or source form their own groups;
groups below ``MIN_ROWS`` rows are pooled by language, then altogether; what even that pool
leaves too small is judged by the estimate of all documents of its language, or if those are
too few, of the whole table, so that every document has a distance.  Tied and repeated rows
count as often as they occur.  Very long texts are counted whole: windows that share a hash cut
short by the bits of their position are told apart by a second hash.  An empty table gives an
empty result.  Of the input only doc_id, text, lang, source and columns asked for by name are
read, so other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwright.llm.common import shared_checkpoint, words_of

FEATURES = ("f1", "f2", "f3", "f4")
#: Added to each statistic's standard deviation (as variances), so that constant ones stay invertible.
SCALE_FLOOR = (0.08, 0.03, 0.15, 0.15)
SUPPORT = 0.75
STEPS = 4
MIN_ROWS = 50
#: Chi-square tail probability beyond which a document is an outlier: of 10^8 normal documents one.
TAIL = 1e-8
#: Groups are joined to their estimates through this many salts, as one group may hold most rows.
SALTS = 16


def _repeats(places: str, hashed: str) -> str:
    """SQL of those window places whose hash occurs more than once, in order.

    Each hash carries its place in its ``__b`` low bits, so that sorting brings equal ones together.
    """
    digest = hashed.format("__w[cast(i AS int)], __w[cast(i AS int) + 1], __w[cast(i AS int) + 2]")
    packed = f"sort_array(transform({places}, i -> shiftleft(shiftrightunsigned({digest}, __b), __b) | cast(i AS bigint)))"
    same = "shiftrightunsigned(x ^ coalesce(get(s, i {} 1), ~x), __b) = 0"
    marked = f"transform(filter(s, (x, i) -> {same.format('-')} OR {same.format('+')}), x -> x & (shiftleft(1L, __b) - 1L))"
    return f"CASE WHEN n_words >= 3 THEN sort_array(element_at(transform(array({packed}), s -> {marked}), 1)) END"


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"__w": words_of(F.col(text)), "__l": lines})
    out = out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            # bits that hold any window position of this text
            "__b": F.when(F.size("__w") > 3, F.ceil(F.log2(F.size("__w").cast("double")))).otherwise(1).cast("int"),
        }
    )
    # windows that are repeats by one hash, and of those the ones that are by another hash too
    out = out.withColumn("__p", F.expr(_repeats("sequence(0, cast(n_words - 3 AS int))", "xxhash64({})")))
    out = out.withColumn("__p", F.expr(_repeats("__p", "xxhash64('again', {})")))
    covered = F.expr(
        "aggregate(transform(__p, (p, i) -> least(3L, coalesce(get(__p, i + 1), p + 3L) - p)), 0L, (a, x) -> a + x)"
    )
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__w", "__l", "__b", "__p")


def with_features(stats: DataFrame) -> DataFrame:
    """Add the transformed statistics: word length, symbols, repeated lines, repeated windows."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "f1": F.log(chars / words),
            "f2": F.sqrt(F.col("n_symbols") / chars),
            "f3": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            "f4": F.sqrt(F.col("n_repeat_words") / words),
        }
    )


def chi_square_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-square distribution for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, dof // 2):
        term *= half / k
        total += term
    return math.exp(-half) * total


def chi_square_quantile(tail: float, dof: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, dof) > tail else (low, mid)
    return low


def consistency(support: float, dof: int) -> float:
    """Factor that makes the scatter of the nearest ``support`` share unbiased for normal data."""
    return support / (1 - chi_square_tail(chi_square_quantile(1 - support, dof), dof + 2))


# The formulas below are SQL text over plain functions, so the oracle can state the same ones.


def start_distance_sql() -> str:
    return " + ".join(f"(({f} - c_{f}) / (1.4826 * d_{f} + {floor})) * (({f} - c_{f}) / (1.4826 * d_{f} + {floor}))" for f, floor in zip(FEATURES, SCALE_FLOOR, strict=True))


def distance_sql() -> str:
    """Squared Mahalanobis distance from the centre m_* and the whitening matrix w_*_*."""
    rows = []
    for i in range(len(FEATURES)):
        part = " + ".join(f"w_{i}_{j} * ({FEATURES[j]} - m_{j})" for j in range(i + 1))
        rows.append(f"({part}) * ({part})")
    return " + ".join(rows)


def bin_sql(distance: str) -> str:
    """Histogram bin of a squared distance: 64 bins for each factor of e."""
    return f"cast(floor(64 * ln(1 + {distance})) AS bigint)"


def moment_sql() -> dict[str, str]:
    """Sums that the estimates are made of, about the groups' median."""
    out = {"n": "cast(count(*) AS double)"}
    for i, f in enumerate(FEATURES):
        out[f"s_{i}"] = f"sum({f} - c_{f})"
        for j, g in enumerate(FEATURES[: i + 1]):
            out[f"q_{i}_{j}"] = f"sum(({f} - c_{f}) * ({g} - c_{g}))"
    return out


def estimate_sql() -> list[dict[str, str]]:
    """Layers of columns that turn the sums into centre and whitening matrix (inverse Cholesky factor)."""
    p = len(FEATURES)
    factor = consistency(SUPPORT, p)
    cov = {
        f"v_{i}_{j}": f"{factor!r} * (q_{i}_{j} / n - (s_{i} / n) * (s_{j} / n))" + (f" + {SCALE_FLOOR[i] ** 2!r}" if i == j else "")
        for i in range(p)
        for j in range(i + 1)
    }
    layers = [{f"m_{i}": f"c_{f} + s_{i} / n" for i, f in enumerate(FEATURES)} | cov]
    for i in range(p):  # Cholesky, row by row
        for j in range(i + 1):
            inner = "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
            layers.append({f"l_{i}_{j}": f"sqrt(greatest(v_{i}_{i}{inner}, 1e-12))" if i == j else f"(v_{i}_{j}{inner}) / l_{j}_{j}"})
    for i in range(p):  # its inverse by forward substitution
        for j in range(i + 1):
            if i == j:
                layers.append({f"w_{i}_{i}": f"1 / l_{i}_{i}"})
            else:
                inner = " + ".join(f"l_{i}_{k} * w_{k}_{j}" for k in range(j, i))
                layers.append({f"w_{i}_{j}": f"-({inner}) / l_{i}_{i}"})
    return layers


def verdict_sql() -> str:
    """True where a document is an outlier."""
    return f"({distance_sql()}) > {chi_square_quantile(TAIL, len(FEATURES))!r}"


def _nearest_share(rows: DataFrame) -> DataFrame:
    """(grp, cut): the histogram bin up to which the nearest ``SUPPORT`` share of a group lies."""
    counts = rows.groupBy("grp", "bin").agg(F.count("*").alias("k"))
    order = Window.partitionBy("grp").orderBy("bin")
    counts = counts.withColumns({"upto": F.sum("k").over(order), "all": F.sum("k").over(Window.partitionBy("grp"))})
    return counts.where(F.col("upto") >= SUPPORT * F.col("all")).groupBy("grp").agg(F.min("bin").alias("cut"))


def _medians(rows: DataFrame, prefix: str) -> DataFrame:
    """Lower medians of the statistics in each group, to a two-hundredth, one column each."""
    pairs = ", ".join(f"'{f}', {f}" for f in FEATURES)
    long = rows.select("grp", F.expr(f"stack({len(FEATURES)}, {pairs}) AS (f, x)"))
    counts = long.groupBy("grp", "f", F.floor(F.col("x") * 200).alias("b")).agg(F.count("*").alias("k"))
    order = Window.partitionBy("grp", "f").orderBy("b")
    counts = counts.withColumns({"upto": F.sum("k").over(order), "all": F.sum("k").over(Window.partitionBy("grp", "f"))})
    low = counts.where(2 * F.col("upto") >= F.col("all")).groupBy("grp", "f").agg(F.min("b").alias("b"))
    return low.groupBy("grp").agg(*(F.max(F.when(F.col("f") == f, F.col("b") / 200.0)).alias(f"{prefix}_{f}") for f in FEATURES))


def _with_groups(rows: DataFrame) -> DataFrame:
    """Add grp, by whose estimate a row is judged, and fits, the groups whose estimates it is part of.

    grp is the language and source, or a pool of what is too small, or else the language ("4")
    or the table ("5"), which are estimated from all their documents.
    """
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source"))
    rows = rows.withColumns({"g_ls": F.concat(lang, F.lit("\n"), source), "g_l": lang})
    sizes = rows.groupBy("g_ls", "g_l").agg(F.count("*").alias("k_ls"))
    small = F.when(F.col("k_ls") < MIN_ROWS, F.col("k_ls")).otherwise(0)
    language = Window.partitionBy("g_l")
    sizes = sizes.withColumns({"k_l": F.sum(small).over(language), "k_lang": F.sum("k_ls").over(language)})
    own = F.when(F.col("k_ls") >= MIN_ROWS, F.concat(F.lit("1"), "g_ls")).when(F.col("k_l") >= MIN_ROWS, F.concat(F.lit("2"), "g_l")).otherwise("3")
    sizes = sizes.select("g_ls", "g_l", own.alias("own"), "k_ls", F.when(F.col("k_lang") >= MIN_ROWS, F.concat(F.lit("4"), "g_l")).otherwise("5").alias("wide"))
    pooled = F.col("own") == "3"
    pool = sizes.groupBy(F.lit(1).alias("one")).agg(
        F.coalesce(F.sum(F.when(pooled, F.col("k_ls"))), F.lit(0)).alias("k_all"), F.coalesce(F.bool_or(pooled & (F.col("wide") == "5")), F.lit(False)).alias("table")
    )
    sizes = sizes.withColumn("one", F.lit(1)).join(F.broadcast(pool), "one")
    short = pooled & (F.col("k_all") < MIN_ROWS)
    sizes = sizes.withColumn("back", F.when(short, F.col("wide")))
    lends = F.when(F.max("back").over(language).startswith("4"), F.concat(F.lit("4"), "g_l"))
    whole = F.when(F.col("table") & (F.col("k_all") < MIN_ROWS), F.lit("5"))
    fits = F.array_compact(F.array(F.when(~short, F.col("own")), lends, whole))
    sizes = sizes.select("g_ls", F.coalesce("back", "own").alias("grp"), fits.alias("fits"))
    return _salted_join(rows, sizes, "g_ls").drop("g_ls", "g_l")


def _salted_join(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Join per-group values to rows; each value is repeated for ``SALTS`` salts as one group may be most rows."""
    small = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", *FEATURES), F.lit(SALTS)).cast("int")).join(small, [key, "__salt"], "left").drop("__salt")


def outlier_verdicts(rows: DataFrame) -> DataFrame:
    """Add ``outlier`` and ``distance`` to rows of doc_id, lang, source and the features."""
    rows = shared_checkpoint(_with_groups(rows))
    used = rows.select(F.explode("fits").alias("grp"), "doc_id", *FEATURES)
    centre = shared_checkpoint(_medians(used, "c"))
    around = _salted_join(used, centre, "grp")
    spread = _medians(around.select("grp", *(F.abs(F.col(f) - F.col(f"c_{f}")).alias(f) for f in FEATURES)), "d")
    estimate = shared_checkpoint(centre.join(spread, "grp"))
    distance = start_distance_sql()
    for _ in range(STEPS):
        placed = _salted_join(used, estimate, "grp").withColumn("bin", F.expr(bin_sql(distance)))
        nearest = _salted_join(placed, _nearest_share(placed), "grp").where("bin <= cut")
        sums = nearest.groupBy("grp").agg(*(F.expr(e).alias(c) for c, e in moment_sql().items()))
        step = centre.join(sums, "grp")
        for layer in estimate_sql():
            step = step.withColumns({c: F.expr(e) for c, e in layer.items()})
        kept = [c for c in step.columns if c[:2] in ("c_", "m_", "w_")]
        estimate = shared_checkpoint(step.select("grp", *kept))
        distance = distance_sql()
    judged = _salted_join(rows, estimate, "grp")
    return judged.select(
        *(c for c in rows.columns if c not in ("grp", "fits")),
        F.coalesce(F.expr(verdict_sql()), F.lit(False)).alias("outlier"),
        F.expr(distance).alias("distance"),
    )


def quality_rules(docs: DataFrame, *keep: str) -> DataFrame:
    """Statistics and verdict of every document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, distance (squared) and the columns named in ``keep``.  See the module docstring for
    edge cases.
    """
    stats = with_features(with_statistics(docs.select("doc_id", "text", "lang", "source", *keep))).drop("text")
    judged = outlier_verdicts(stats)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~F.col("outlier")).alias("kept"), "distance", *keep,
    )
