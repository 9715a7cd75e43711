"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is read once to derive a Boolean query over trigrams that any
match must contain: literals between open-ended parts give strings, alternatives give
disjunctions, concatenation gives conjunctions.  The index holds one posting (trigram,
document) for every trigram that some rule asks for, over lower-cased text; postings are
brought together for each document, the queries are evaluated on them, and only candidates
are scanned with the regular expression.  Rules without a mandatory trigram, such as long
runs of hexadecimal digits, scan every text.

Spans are leftmost and non-overlapping for each rule, matches whose value is too short are
dropped, and positions are code points with an exclusive end.

Texts stay where they are: only the candidates' keys move, to all executors while they are at
most ``BROADCAST_ROWS``, beyond it by a join.  Positions come from running sums of the lengths
of matches and of what lies between, and every pattern reads a text in about linear time, so
very long texts are scanned whole.

Defined results: null text is empty and has no spans; repeated rows are scanned one by one;
rows without doc_id are scanned too; columns other than doc_id and text are not looked at,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re._constants as ops
import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwright.llm.common import prefix_sums, shared_checkpoint

#: Up to so many candidates are sent to all executors.
BROADCAST_ROWS = 1_000_000
#: Sets of alternatives larger than this end a literal.
MOST_STRINGS = 16


@dataclass(frozen=True)
class Rule:
    """A pattern in syntax common to Java and RE2; ``group`` holds the value of ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Base rules first; the order is the order of kinds at equal starts.
RULES = (
    Rule(
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        "[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", "(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    # a scheme has 31 characters at most, so that long runs are read once
    Rule("login", "[a-z][a-z0-9+.-]{0,30}://[^ \t\n/:@]+:[^ \t\n/@]{3,}@"),
)
BASE = 3


# Boolean queries: ("all",) holds always, ("and", parts) and ("or", parts) combine, ("tri", t) asks for a trigram.


def _of_strings(strings: frozenset[str]) -> tuple:
    """The query of a text that contains one of the strings."""
    parts = []
    for s in sorted(strings):
        if len(s) < 3:
            return ("all",)
        parts.append(("and", tuple(sorted({("tri", s[i : i + 3]) for i in range(len(s) - 2)}))))
    return ("or", tuple(parts)) if len(parts) > 1 else parts[0]


def _both(one: tuple, other: tuple) -> tuple:
    if one == ("all",):
        return other
    return one if other == ("all",) else ("and", (one, other))


def _exact(item: tuple) -> frozenset[str] | None:
    """The lower-cased strings that an element of the parsed pattern matches, if they are few."""
    op, value = item
    if op is ops.LITERAL:
        return frozenset([chr(value).lower()])
    if op is ops.IN:
        out: set[str] = set()
        for kind, what in value:
            if kind is ops.LITERAL:
                out.add(chr(what).lower())
            elif kind is ops.RANGE and what[1] - what[0] < MOST_STRINGS:
                out |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
            else:
                return None
        return frozenset(out) if len(out) <= 8 else None
    if op is ops.SUBPATTERN:
        return _sequence_exact(value[-1])
    if op is ops.BRANCH:
        parts = [_sequence_exact(x) for x in value[1]]
        return None if None in parts else frozenset().union(*parts)
    if op is ops.MAX_REPEAT and value[1] == value[0] <= 8 or op is ops.MAX_REPEAT and value[:2] == (0, 1):
        inner = _sequence_exact(value[2])
        if inner is not None:
            times = [inner] * value[1]
            strings = {"".join(x) for x in itertools.product(*times)} if len(inner) ** max(1, value[1]) <= MOST_STRINGS else None
            if strings is not None:
                return frozenset(strings | ({""} if value[0] == 0 else set()))
    return None


def _sequence_exact(items) -> frozenset[str] | None:
    strings = frozenset([""])
    for item in items:
        more = _exact(item)
        if more is None or len(strings) * len(more) > MOST_STRINGS:
            return None
        strings = frozenset(a + b for a in strings for b in more)
    return strings


def _query(items) -> tuple:
    """Trigram query of a sequence of parsed elements."""
    found: tuple = ("all",)
    strings = frozenset([""])
    for item in items:
        more = _exact(item)
        grown = frozenset(a + b for a in strings for b in more) if more is not None else None
        optional = item[0] is ops.MAX_REPEAT and item[1][0] == 0
        if grown is not None and len(grown) <= MOST_STRINGS and not (optional and min(map(len, strings)) >= 3):
            strings = grown
            continue
        found = _both(found, _of_strings(strings))
        strings = more if more is not None and not optional else frozenset([""])
        if more is None:
            op, value = item
            if op is ops.SUBPATTERN:
                found = _both(found, _query(value[-1]))
            elif op is ops.BRANCH:
                parts = [_query(x) for x in value[1]]
                if ("all",) not in parts:
                    found = _both(found, ("or", tuple(parts)))
            elif op is ops.MAX_REPEAT and value[0] >= 1:
                found = _both(found, _query(value[2]))
    return _both(found, _of_strings(strings))


def trigram_query(pattern: str) -> tuple:
    """The Boolean trigram query that every text with a match of the pattern satisfies."""
    return _query(regex_parser.parse(pattern))


def trigrams_of(query: tuple) -> set[str]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(trigrams_of(x) for x in query[1])) if len(query) > 1 else set()


def holds(query: tuple, present: str) -> str:
    """SQL that evaluates a query on an array of the trigrams present."""
    if query[0] == "tri":
        return f"array_contains({present}, '{query[1].replace(chr(39), chr(92) + chr(39))}')"
    if query == ("all",):
        return "true"
    return "(" + f" {query[0].upper()} ".join(holds(x, present) for x in query[1]) + ")"


def with_row_key(docs: DataFrame) -> DataFrame:
    """Add __row, by which postings name a document; equal rows share it."""
    return docs.withColumn("__row", F.xxhash64("doc_id", "text"))


def postings(keyed: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, __row) over the trigrams that the rules ask for."""
    wanted = sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))
    array = F.array(*(F.lit(t) for t in wanted))
    found = F.transform(F.array(F.lower("text")), lambda low: F.filter(array, lambda t: F.contains(low, t)))[0]
    return keyed.select("__row", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(__row, __rules): the rules whose queries a document's postings satisfy."""
    met = index.groupBy("__row").agg(F.collect_set("trigram").alias("present"))  # bounded by the rules' trigrams
    queries = [(n, trigram_query(r.pattern)) for n, r in enumerate(rules)]
    tests = [F.when(F.expr(holds(q, "present")), F.lit(n)) for n, q in queries if q != ("all",)]
    return met.select("__row", F.array_compact(F.array(*tests)).alias("__rules")).where(F.size("__rules") > 0)


def rule_spans(number: int, rule: Rule, text: str = "text") -> Column:
    """Array of (start, kind number, end) of one rule's matches in a text."""
    quoted = "'" + rule.pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    lengths = "transform({}, x -> length(x))"
    found = lengths.format(f"regexp_extract_all({text}, {quoted}, 0)")
    between = lengths.format(f"split({text}, {quoted}, -1)")
    ends = prefix_sums("zip_with(p.m, slice(p.g, 1, size(p.m)), (m, g) -> m + g)")
    values = "p.m" if rule.group == 0 else "p.v"
    size = f", 'v', {lengths.format(f'regexp_extract_all({text}, {quoted}, {rule.group})')}" if rule.group else ""
    spans = (
        f"filter(transform({ends}, (e, i) -> named_struct('start', e - p.m[i], 'kind', {number}, 'end', e, 'size', {values}[i])), "
        f"s -> s.size >= {rule.least})"
    )
    return F.expr(f"element_at(transform(array(named_struct('m', {found}, 'g', {between}{size})), p -> {spans}), 1)")


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add __spans: all spans of the rules, ordered by start and kind."""
    keyed = with_row_key(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    found = shared_checkpoint(candidates(postings(keyed, rules), rules))
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    joined = keyed.join(found, "__row", "left")
    parts = []
    for n, rule in enumerate(rules):
        listed = F.array_contains("__rules", n) if trigram_query(rule.pattern) != ("all",) else F.col("text").rlike(rule.pattern)
        parts.append(F.when(listed, rule_spans(n, rule)))
    empty = "cast(array() AS array<struct<start:int,kind:int,end:int,size:int>>)"
    joined = joined.withColumn("__spans", F.array_sort(F.concat(*(F.coalesce(p, F.expr(empty)) for p in parts))))
    return joined.drop("__row", "__rules")


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 of the base spans, and spans of all rules."""
    found = secret_spans(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    counts = [F.size(F.expr(f"filter(__spans, s -> s.kind = {n})")).cast("long").alias(f"n_{RULES[n].kind}") for n in range(BASE)]
    base = F.filter("__spans", lambda s: s["kind"] < BASE)
    return found.select("doc_id", *counts, F.sha2(_joined(base, RULES).cast("binary"), 256).alias("base_sha256"), _joined(F.col("__spans"), RULES).alias("spans"))
