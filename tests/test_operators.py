"""Small hand-made cases of operators, and properties that no oracle states."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwright.functions import braille, encoding
from cellwright.operators import alignment, corpus, differences, evaluation, layout, streams
from cellwright.sources import files


def lines(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, seq int, raw_line string")


def test_systemic_is_strictly_more_than_thirty_percent(spark):
    pages = spark.createDataFrame([(1, p) for p in range(10)] + [(2, p) for p in range(10)], "doc_id long, page_no int")
    issues = spark.createDataFrame([(1, p, "w") for p in range(3)] + [(2, p, "w") for p in range(4)], "doc_id long, page_no int, issue_type string")
    assert [r.doc_id for r in layout.systemic_patterns(issues, pages).collect()] == [2]
    assert {(r.doc_id, r.suppressed) for r in layout.with_suppressed(issues, pages).collect()} == {(1, False), (2, True)}


def test_calibration_tie_goes_to_the_first(spark):
    rows = [(1, 1, i + 1, i, "x" * w) for i, w in enumerate([5, 7, 7, 5])]
    assert layout.calibrate(lines(spark, rows)).first().width_mode == 5


def test_blank_lines_are_counted(spark):
    rows = [(1, 1, 1, 0, "one"), (1, 1, 2, 1, ""), (1, 1, 3, 2, "  two"), (1, 1, 4, 3, "more")]
    found = layout.paragraph_layout(lines(spark, rows)).orderBy("para_no").collect()
    assert [(r.text, r.blank_before, r.first_indent, r.runover_indent) for r in found] == [("one", 0, 0, None), ("two more", 1, 2, 0)]


def test_braille_numbers(spark):
    df = spark.createDataFrame([("#be",), ("25",), ("#xy",), ("",)], "x string")
    assert [r[0] for r in df.select(braille.braille_int(F.col("x"))).collect()] == [25, 25, -1, -1]


def test_encoder_uses_numeric_mode_and_grade_sign(spark):
    df = spark.createDataFrame([("3,5a B.",)], "x string")
    cells = df.select(encoding.encode_uncontracted(F.col("x")).alias("e")).first().e
    assert "".join(c.cell for c in cells) == "#C1E;A ,B4"
    assert [c.offset for c in cells] == [0, 0, 1, 2, 3, 3, 4, 5, 5, 6]


def test_linear_cells(spark):
    df = spark.createDataFrame([("-3 + x = 12",)], "x string")
    out = df.select(encoding.is_linear_expr(F.col("x")).alias("ok"), encoding.encode_linear(encoding.linear_tokens(F.col("x"))).alias("c")).first()
    assert out.ok and out.c == "-#3+X .K #12"


@pytest.mark.parametrize(
    ("expected", "actual", "ops"),
    [
        ("abcdefghij", "abcdefghij", [("equal", 0, 10, 0, 10)]),
        ("abcdefghij", "zabcdfghij", [("insert", 0, 0, 0, 1), ("equal", 0, 4, 1, 5), ("delete", 4, 5, 5, 5), ("equal", 5, 10, 5, 10)]),
        ("abcd", "acbd", [("equal", 0, 1, 0, 1), ("replace", 1, 3, 1, 3), ("equal", 3, 4, 3, 4)]),
        ("aab", "aaab", [("insert", 0, 0, 0, 1), ("equal", 0, 3, 1, 4)]),
        ("address", "adddress", [("equal", 0, 1, 0, 1), ("insert", 1, 1, 1, 2), ("equal", 1, 7, 2, 8)]),
        ("braille", "braile", [("equal", 0, 5, 0, 5), ("delete", 5, 6, 5, 5), ("equal", 6, 7, 5, 6)]),
        ("xxxyab", "xxzab", [("delete", 0, 1, 0, 0), ("equal", 1, 3, 0, 2), ("replace", 3, 4, 2, 3), ("equal", 4, 6, 3, 5)]),
        ("hello hello", "hello ehllo", [("equal", 0, 6, 0, 6), ("replace", 6, 8, 6, 8), ("equal", 8, 11, 8, 11)]),
        ("u a$qqu", "u $aaqqu", [("equal", 0, 2, 0, 2), ("replace", 2, 4, 2, 4), ("insert", 4, 4, 4, 5), ("equal", 4, 7, 5, 8)]),
        ("", "ab", [("insert", 0, 0, 0, 2)]),
        ("ab", "", [("delete", 0, 2, 0, 0)]),
    ],
)
def test_bounded_alignment(expected, actual, ops):
    assert alignment.edit_opcodes(expected, actual) == ops


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_bounded_alignment_rebuilds_both_sides_at_least_cost(a, b):
    ops = alignment.edit_opcodes(a, b)
    assert "".join(a[o[1] : o[2]] for o in ops) == a and "".join(b[o[3] : o[4]] for o in ops) == b
    cost = 0
    for tag, e0, e1, a0, a1 in ops:
        if tag == "replace":  # a swap is a replaced pair and costs one
            k = 0
            while k < e1 - e0:
                swap = k + 1 < e1 - e0 and a[e0 + k : e0 + k + 2] == b[a0 + k : a0 + k + 2][::-1]
                cost, k = cost + 1, k + 1 + swap
        elif tag != "equal":
            cost += max(e1 - e0, a1 - a0)
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    assert cost == d[-1][-1]


def test_reflow_keeps_words_and_width(spark):
    df = spark.createDataFrame([(1, 0, "aa bbb cccc d " + "x" * 9 + " e"), (1, 1, ""), (2, 0, "short")], "doc_id long, seq int, text string")
    found = corpus.reflow(df, 6, 2).orderBy("doc_id", "page_no", "line_no").collect()
    assert [r.raw_line for r in found] == ["aa bbb", "cccc d", "xxxxxx", "xxx e", "", "short"]
    assert [(r.page_no, r.line_no) for r in found] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (1, 1)]


def test_reflow_breaks_pages_where_a_block_says(spark):
    df = spark.createDataFrame([(1, 0, "a b", True), (1, 1, "c d e f g", False), (1, 2, "h", True), (1, 3, "i", False)], "doc_id long, seq int, text string, break_after boolean")
    found = corpus.reflow(df, 3, 2).orderBy("page_no", "line_no").collect()
    assert [(r.page_no, r.line_no, r.raw_line) for r in found] == [(1, 1, "a b"), (2, 1, "c d"), (2, 2, "e f"), (3, 1, "g"), (3, 2, "h"), (4, 1, "i")]


def test_page_regions_follow_a_split_page(spark):
    exp = spark.createDataFrame([(1, 1, "alpha beta gamma delta"), (1, 2, "one two three four")], "doc_id long, page_no int, text string")
    act = spark.createDataFrame([(1, 1, "alpha beta gamma delta"), (1, 2, "one two three four")], "doc_id long, page_no int, text string")
    assert sorted(tuple(r)[1:] for r in alignment.match_page_regions(exp, act).collect()) == [(1, 1, 1, 1), (2, 2, 2, 2)]


def test_page_regions_join_a_page_that_was_split(spark):
    exp = spark.createDataFrame([(1, 1, "alpha beta gamma delta epsilon zeta eta theta"), (1, 2, "one two three four five six seven eight nine")], "doc_id long, page_no int, text string")
    act = spark.createDataFrame([(1, 1, "alpha beta gamma delta"), (1, 2, "epsilon zeta eta theta"), (1, 3, "one two three four five six seven eight nine")], "doc_id long, page_no int, text string")
    assert sorted(tuple(r)[1:] for r in alignment.match_page_regions(exp, act, band=0.5).collect()) == [(1, 1, 1, 2), (2, 2, 3, 3)]


def test_page_regions_keep_order_and_whole_documents(spark):
    schema = "doc_id long, page_no int, text string"
    exp = spark.createDataFrame([(1, 1, "a b c d e f g h"), (2, 1, "only here"), (2, 2, "too")] + [(4, 1, "one page " * 9)], schema)
    act = spark.createDataFrame([(1, 1, "a b c d"), (1, 2, "e f g h"), (3, 1, "only there")] + [(4, p, "one page") for p in range(1, 10)], schema)
    found = {tuple(r) for r in alignment.match_page_regions(exp, act, band=0.6).collect()}
    assert found == {(1, 1, 1, 1, 2), (2, 1, 2, None, None), (3, None, None, 1, 1), (4, 1, 1, 1, 9)}
    pair = spark.createDataFrame([("ab cd ab ab", "ab cd ab ab"), ("one two three", "three two one")], "a string, b string")
    assert [r[0] for r in pair.select(alignment.matching_characters("a", "b")).collect()] == [11, 7]


def test_blocks_get_their_lines(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "x" * 20), (1, 1, 1, "y" * 10)], "doc_id long, region int, n int, text string")
    rows = spark.createDataFrame([(1, 1, i, "z" * 10) for i in range(3)], "doc_id long, region int, n int, text string")
    found = alignment.assign_blocks_to_lines(blocks, rows).orderBy("block").collect()
    assert [(r.block, r.first_line, r.last_line) for r in found] == [(0, 0, 1), (1, 2, 2)]


def test_heading_anchors_are_one_to_one(spark):
    exp = spark.createDataFrame([(1, 0, "Chapter one"), (1, 1, "Chapter two"), (1, 2, "Lost heading")], "doc_id long, seq int, text string")
    act = spark.createDataFrame([(1, 0, "Chapter one."), (1, 1, "Chapter twos")], "doc_id long, seq int, text string")
    assert [(r.i, r.j) for r in alignment.heading_anchors(exp, act).orderBy("i").collect()] == [(0, 0), (1, 1), (2, None)]


def test_slices_of_unlike_counts_pair_by_matching_runs(spark):
    exp = spark.createDataFrame([(1, i, t) for i, t in enumerate(["A", "x", "y", "x", "z", "B", "p", "q"])], "doc_id long, seq int, text string")
    act = spark.createDataFrame([(1, i, t) for i, t in enumerate(["A", "y", "x", "z", "B", "p", "r"])], "doc_id long, seq int, text string")
    found = {(r.i, r.j): r.same_text for r in alignment.pair_slices(exp, act, spark.createDataFrame([(1, 0, 0), (1, 5, 4)], "doc_id long, i int, j int")).collect()}
    assert found == {(0, 0): True, (2, 1): True, (3, 2): True, (4, 3): True, (5, 4): True, (6, 5): True, (7, 6): False}


def test_capital_words_and_dialects(spark):
    df = spark.createDataFrame([("NASA Ab cD 3A",)], "x string")
    out = df.select(encoding.encode_uncontracted(F.col("x")).alias("e"), encoding.capital_sites(F.col("x")).alias("s"), encoding.encode_capital_passage(F.lit("ab C")).alias("p")).first()
    assert "".join(c.cell for c in out.e) == ",,NASA ,AB C,D #C,A" and out.p == ",,,AB C,'"
    assert [(w.word, w.state, w.source_start, w.expected_start, w.following) for w in out.s] == [("NASA", "all", 0, None, None), ("Ab", "initial", 5, 7, "A"), ("cD", "mixed", 8, None, None), ("A", "initial", 12, 17, "A")]
    masks = spark.createDataFrame([("aA@`[{",)], "x string").select(*(braille.to_masks(F.col("x"), d).alias(d) for d in braille.DOT_SEVEN)).first()
    assert masks.duxbury == [1, 1, 8, None, 42, None] and masks.liblouis == [1, 65, 72, 8, 106, 42] and masks.liblouis_math == [1, 65, 8, 8, 42, 42]


def test_words_align_with_merged_changes(spark):
    df = spark.createDataFrame([(1, 0, "a b c d", "a x d")], "doc_id long, region long, text string, other string")
    assert [(r.tag, r.e0, r.e1, r.a0, r.a1) for r in alignment.align_words(df).orderBy("n").collect()] == [("equal", 0, 1, 0, 1), ("replace", 1, 3, 1, 2), ("equal", 3, 4, 2, 3)]
    assert SequenceMatcher(None, "ab", "ab").ratio() == 1


def test_long_regions_are_aligned_in_bounded_steps(spark):
    text = " ".join(f"word{i}" for i in range(600))
    others = [text.replace("word77 ", "word77  "), text.replace("word77 ", "wordxx "), "z" + text.replace("word300 ", ""), text[:2500] + "q" * 3000 + text[2500:]]
    df = spark.createDataFrame([(1, n, text, other) for n, other in enumerate(others)] + [(1, 4, "a" * 3000, "b" * 2999)], "doc_id long, region long, text string, other string")
    for rows in (alignment.align_cells(df).orderBy("region", "n").collect(), alignment.align_bounded(df).orderBy("region", "n").collect()):
        ops = [[(r.tag, r.e1 - r.e0, r.a1 - r.a0) for r in rows if r.region == n] for n in range(5)]
        n = len(text)
        at = text.index("word77 ")
        assert sorted(ops[0]) == sorted([("equal", at + 7, at + 7), ("insert", 0, 1), ("equal", n - at - 7, n - at - 7)]) or ops[0][1] == ("insert", 0, 1)
        assert ops[1] == [("equal", at + 4, at + 4), ("replace", 2, 2), ("equal", n - at - 6, n - at - 6)]
        assert sum(e for t, e, _ in ops[2] if t == "delete") == 8 and ops[2][0] == ("insert", 0, 1) and {t for t, *_ in ops[2]} == {"insert", "equal", "delete"}
        assert sum(a for t, _, a in ops[3] if t == "insert") == 3000 and {t for t, *_ in ops[3]} == {"equal", "insert"}
        assert sum(max(e, a) for _, e, a in ops[4]) == 3000
        for n, other in enumerate(others):
            mine = [r for r in rows if r.region == n]
            assert "".join(text[r.e0 : r.e1] for r in mine) == text and "".join(other[r.a0 : r.a1] for r in mine) == other
            assert all(text[r.e0 : r.e1] == other[r.a0 : r.a1] for r in mine if r.tag == "equal")


def test_page_boundaries_look_at_both_sides(spark):
    schema = "doc_id long, page_no int, start int, tail string, head string"
    stream = spark.createDataFrame([(1, "one two three four five six"), (2, "x" * 100 + " tail")], "doc_id long, text string")
    starts = spark.createDataFrame([(1, 2, 10, "one two three", "four five six"), (2, 2, 30, "xx", "tail")], schema)
    found = {r.doc_id: (r["at"], r.cost) for r in alignment.page_boundaries(stream, starts).collect()}
    assert found == {1: (13, 0), 2: (100, None)}


def test_blocks_may_take_many_lines(spark):
    blocks = spark.createDataFrame([(1, 1, 0, "x" * 10), (1, 1, 1, "y" * 79), (1, 1, 2, "w" * 10)], "doc_id long, region int, n int, text string")
    rows = spark.createDataFrame([(1, 1, i, "z" * 10) for i in range(10)], "doc_id long, region int, n int, text string")
    found = alignment.assign_blocks_to_lines(blocks, rows).orderBy("block").collect()
    assert [(r.block, r.first_line, r.last_line) for r in found][:2] == [(0, 0, 0), (1, 1, 7)]


def test_candidates_meet_by_start_or_by_box(spark):
    muts = spark.createDataFrame([(1, 1, "A", "insert", 5, 6, [(2, 3)]), (1, 1, "B", "insert", 90, 91, [(4, 4)])], "doc_id long, page_no int, mut_id string, operation string, start long, end long, boxes array<struct<line:int,cell:int>>")
    finds = spark.createDataFrame([(1, 1, "F", "insert", 7, 8, [(9, 9)]), (1, 1, "G", "insert", 40, 41, [(4, 4)]), (1, 1, "H", "delete", 5, 6, [(2, 3)])], "doc_id long, page_no int, find_id string, operation string, start long, end long, boxes array<struct<line:int,cell:int>>")
    found = {(r.mut_id, r.find_id): r.score for r in evaluation.match_candidates(muts, finds).collect()}
    assert found == {("A", "F"): 0, ("B", "G"): 5}  # 4 for equal boxes, 1 for a shared one


def test_paired_records_match_in_order_at_most_once(spark):
    """J13 against the longest ordered matching of texts, where counts differ."""
    rng = random.Random(1)
    recs, acts = [], []
    for page in range(12):
        texts = [rng.choice("abc") for _ in range(6)]
        kept = [t for t in texts if rng.random() < 0.7] if page % 3 else texts
        recs += [(1, page, i, t) for i, t in enumerate(texts)]
        acts += [(1, page, i, t) for i, t in enumerate(kept)]
    schema = "doc_id long, page_no int, seq int, text string"
    found = differences.pair_math_spans(spark.createDataFrame(recs, schema), spark.createDataFrame(acts, schema)).collect()
    for page in range(12):
        a, b = ([r[3] for r in rows if r[1] == page] for rows in (recs, acts))
        pairs = sorted((r.record, r.span) for r in found if r.page_no == page and r.record is not None and r.span is not None)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (a[i] == b[j]))
        assert len(pairs) == (len(a) if len(a) == len(b) else best[-1][-1])


def test_assignment_is_one_to_one_and_flags_ties(spark):
    muts = spark.createDataFrame([(1, 1, m, s) for m, s in (("A", 5), ("B", 6), ("C", 90))], "doc_id long, page_no int, mut_id string, start long")
    cands = spark.createDataFrame([(1, 1, "A", "F", 5, 9), (1, 1, "B", "F", 6, 9), (1, 1, "B", "G", 6, 1), (1, 1, "B", "H", 6, 1)], "doc_id long, page_no int, mut_id string, find_id string, start long, score long")
    found = {r.mut_id: (r.find_id, r.state) for r in evaluation.assign_findings(muts, cands).collect()}
    assert found == {"A": ("F", "DETECTED"), "B": (None, "AMBIGUOUS"), "C": (None, "MISSED")}


def test_control_pairs_and_math_balance(spark):
    cells = spark.createDataFrame([(1, i, m) for i, m in enumerate([24, 2, 5, 24, 9, 24, 54])], "doc_id long, pos long, mask int")
    assert [(r.raw_pos, r.mask) for r in streams.strip_control_pairs(cells).orderBy("pos").collect()] == [(2, 5), (3, 24), (4, 9)]
    blocks = spark.createDataFrame([(1, 1, i, s, e) for i, (s, e) in enumerate([(0, 1), (1, 0), (0, 0), (0, 1), (0, 0)])], "doc_id long, page_no int, seq int, starts int, ends int")
    found = streams.group_math_blocks(blocks).orderBy("seq").collect()
    assert [(r.group_no, r.status) for r in found] == [(1, "REVIEW"), (2, "PASS"), (2, "PASS"), (2, "PASS"), (3, "PASS")]


def test_interval_join_has_no_nested_loop(spark):
    a = spark.createDataFrame([(1, 1, 0, 600), (1, 2, 300, 300)], "doc_id long, id int, start long, end long")
    b = spark.createDataFrame([(1, 1, 0, 256), (1, 2, 256, 512), (1, 3, 512, 900)], "doc_id long, page_no int, r0 long, r1 long")
    out = differences.split_to_pages(a, b)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(tuple(r)[1:] for r in out.collect()) == [(1, 1, 0, 256), (1, 2, 0, 256), (1, 3, 0, 88), (2, 2, 44, 44)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.brf").write_bytes(b"one\ntwo\fthree\f\n")
    assert [r.page_text for r in files.read_brf(spark, str(tmp_path / "in")).orderBy("page_no").collect()] == ["one\ntwo", "three"]
    muts = spark.createDataFrame([(1, "M1", "letter", "insert", 3, [], [5], [(1, 2, 3)])], "doc_id long, mutation_id string, family string, operation string, expected_start long, expected_cells array<int>, actual_cells array<int>, locations array<struct<page:int,line:int,cell:int>>")
    files.write_csv(muts, muts.columns, str(tmp_path / "csv"))
    assert files.read_manifest(spark, str(tmp_path / "csv")).collect() == muts.collect()
    files.write_findings(muts, str(tmp_path / "findings"))
    assert spark.read.json(str(tmp_path / "findings")).count() == 1
    cells = spark.createDataFrame([(1, 1, 1, 1, 1), (1, 1, 2, 1, 3), (1, 2, 1, 1, 0)], "doc_id long, page_no int, line_no int, col_no int, mask int")
    assert files.cells_to_brf(cells).first().text == "A\nB\f "
