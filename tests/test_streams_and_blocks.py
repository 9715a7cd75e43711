"""Words of whole documents, blocks on lines, letter groups and coverage, on hand-made cases and against brute force."""

import random
from difflib import SequenceMatcher
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwright.operators import alignment as A
from cellwright.operators import differences, validation


def words(spark, docs):
    return spark.createDataFrame([(d, k, w) for d, text in docs.items() for k, w in enumerate(text.split())], "doc_id long, pos int, word string").repartition(3)


def test_word_streams_with_moved_words(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(1500)]
    moved = base[:200] + base[240:600] + ["new", "words"] + base[600:900] + base[200:240] + base[900:]
    moved[50], moved[1200:1203] = "other", ["x"]
    docs = {1: (" ".join(base), " ".join(moved)), 2: ("a b c d", "a x d"), 3: ("only here", ""), 4: ("", "only there"), 5: ("a a a a b", "a a b"), 6: ("p q r s t", "p q r s t")}
    found = A.align_word_streams(words(spark, {k: v[0] for k, v in docs.items()}), words(spark, {k: v[1] for k, v in docs.items()})).orderBy("doc_id", "n").collect()
    ops = {k: [(r.tag, r.e0, r.e1, r.a0, r.a1) for r in found if r.doc_id == k] for k in docs}
    for k, (e, a) in docs.items():
        e, a = e.split(), a.split()
        assert all(x[0] == "equal" and e[x[1] : x[2]] == a[x[3] : x[4]] or x[0] != "equal" for x in ops[k])
        assert [i for x in ops[k] for i in range(x[1], x[2])] == list(range(len(e))) and [j for x in ops[k] for j in range(x[3], x[4])] == list(range(len(a)))
        assert all((x[0] == "equal") != (y[0] == "equal") for x, y in zip(ops[k], ops[k][1:], strict=False))
        best = sum(m.size for m in SequenceMatcher(None, e, a, False).get_matching_blocks())
        assert sum(x[2] - x[1] for x in ops[k] if x[0] == "equal") >= best
    assert ops[2] == [("equal", 0, 1, 0, 1), ("replace", 1, 3, 1, 2), ("equal", 3, 4, 2, 3)]
    assert ops[3] == [("delete", 0, 2, 0, 0)] and ops[4] == [("insert", 0, 0, 0, 2)] and ops[6] == [("equal", 0, 5, 0, 5)]
    assert ("delete", 200, 240, 200, 200) in ops[1] and any(x[0] == "insert" and x[4] - x[3] == 40 for x in ops[1])


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(7)), st.lists(st.integers(1, 4), min_size=7, max_size=7))
def test_chain_is_the_heaviest(order, sizes):
    starts = np.concatenate([[0], np.cumsum([sizes[k] for k in order])])
    j0 = {k: int(starts[n]) for n, k in enumerate(order)}
    i0 = np.concatenate([[0], np.cumsum(sizes)])
    runs = [(int(i0[k]), int(i0[k]) + sizes[k] - 1, j0[k], j0[k] + sizes[k] - 1) for k in range(7)]
    weight = lambda chain: sum(r[1] - r[0] + 1 for r in chain)
    best = 0
    for keep in product((0, 1), repeat=7):
        chain = [r for r, k in zip(runs, keep, strict=True) if k]
        if all(x[3] < y[2] for x, y in zip(chain, chain[1:], strict=False)):
            best = max(best, weight(chain))
    found = A.heaviest_chain(runs)
    assert weight(found) == best and all(x[1] < y[0] and x[3] < y[2] for x, y in zip(found, found[1:], strict=False))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_blocks_on_lines_against_all_ways():
    rng = random.Random(5)
    for _ in range(60):
        lines = ["".join(rng.choice("ab c") for _ in range(rng.randrange(7))) for _ in range(rng.randrange(1, 6))]
        blocks = ["".join(rng.choice("ab c") for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 4))]
        costs = A.segment_costs(blocks[0], lines)
        assert all(costs[i, j] == levenshtein(blocks[0], " ".join(lines[i : j + 1])) for i in range(len(lines)) for j in range(i, len(lines)))
        ways = [w for w in product(range(1, len(lines) + 1), repeat=len(blocks)) if sum(w) <= len(lines)]

        def total(widths):
            at, score = 0, 0.0
            for block, width in zip(blocks, widths, strict=True):
                segment = " ".join(lines[at : at + width])
                score += len(block) - levenshtein(block, segment) - 0.05 * width - 0.75 * abs(len(block) - len(segment))
                at += width
            return score

        found = A.block_lines(blocks, lines)
        if not ways:
            assert found == []
            continue
        widths = tuple(last - first + 1 for _, first, last in found)
        assert widths == min(w for w in ways if total(w) >= max(map(total, ways)) - 1e-6)


def test_repeated_blocks_keep_their_place(spark):
    """Repeated blocks with one error: the error stays in its block."""
    cases = [
        (["hello world", "hello world"], ["hello world", "hallo world"], 1), (["hello world"] * 3, ["hello world", "heklo world", "hello world"], 1),
        (["hello world", "hello world"], ["hello world", "hexllo world"], 1), (["hello world", "hello world"], ["hello world", "helo world"], 1), (["hello world"] * 2, ["jello world", "hello world"], 0),
        (["unique alpha", "hello world", "hello world", "unique omega"], ["unique alpha", "hello world", "hello", "worle", "unique omega"], 2), (["xhello y", "zhello q"], ["xhello y", "zheklo q"], 1),
    ]
    schema = "doc_id long, region int, n int, text string"
    sides = [spark.createDataFrame([(d, 1, n, t) for d, case in enumerate(cases) for n, t in enumerate(case[k])], schema) for k in (0, 1)]
    placed = A.place_blocks(*sides).cache()
    ops = A.align_bounded(placed.select("doc_id", (F.col("block")).cast("long").alias("region"), "text", "other")).where("tag <> 'equal'").collect()
    for d, (blocks, _, wrong) in enumerate(cases):
        assert placed.where(F.col("doc_id") == d).count() == len(blocks)
        assert {r.region for r in ops if r.doc_id == d} == {wrong} and sum(max(r.e1 - r.e0, r.a1 - r.a0) for r in ops if r.doc_id == d) == 1


def nested(rng, depth):
    if not depth:
        return rng.choice("abX"), 0
    inner, d = nested(rng, depth - 1)
    o, c = rng.choice(["()", "[]", "{}"])
    return rng.choice(["", "", "f", "G"]) + o + inner + c, d + 1


def test_letter_groups_of_any_depth(spark):
    rng = random.Random(1)
    good = [nested(rng, d) for d in [*range(1, 12)] * 6]
    bad = ["x", "", "()", "(a]", "((a)", "(ab)", "(a)b", "f(x)(y)", "(1)", "( a)", "f g(x)", "([a)]", None]
    rows = [(t, "application" if t[0].isalpha() else "group", d) for t, d in good] + [(t, "none", None) for t in bad]
    found = spark.createDataFrame(rows, "x string, kind string, depth int").select("*", differences.letter_group(F.col("x")).alias("g")).collect()
    assert all((r.g.kind, r.g.depth) == (r.kind, r.depth) for r in found)
    cells = {r.x: r.g.cells for r in found}
    by_hand = {"(": "(", ")": ")", "[": "@(", "]": "@)", "{": ".(", "}": ".)"}
    assert all(cells[t] == "".join(by_hand.get(c, "," * c.isupper() + c.lower()) for c in t) for t, _ in good)


def test_coverage_counts_whole_spans(spark):
    runs = spark.createDataFrame([(1, 0, 5), (1, 6, 12), (1, 20, 30)], "doc_id long, e0 long, e1 long")
    spans = spark.createDataFrame([(1, "a", 0, 5), (1, "a", 4, 7), (1, "a", 6, 12), (1, "b", 13, 14), (1, "b", 25, 30), (2, "a", 0, 1)], "doc_id long, kind string, start long, end long")
    found = {(r.doc_id, r.kind): (r.total, r.aligned, r.unresolved) for r in validation.coverage(spans, runs).collect()}
    assert found == {(1, "a"): (3, 2, 1), (1, "b"): (2, 1, 1), (2, "a"): (1, 0, 1)}
