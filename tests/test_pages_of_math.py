"""Math spans and anchors on the page's row: the same as from cells and regions as rows, and the matcher the same as difflib's."""

import random
from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from cellwright.operators import alignment as A
from cellwright.operators import mathspans as M
from cellwright.plans import mathspans as plans


def rows(df):
    return sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def test_spans_on_the_row_are_those_of_cells(spark):
    rng = random.Random(5)
    texts = [None, "", "_%", "_:", "_%_:", "__%%_:_"] + ["".join(rng.choice(["_%", "_:", "_", "%", ":", " a", "é"]) for _ in range(rng.randrange(14))) for _ in range(60)]
    made = [(d, 1, t, sorted(k for k, c in enumerate(t or "") if c == " " and rng.random() < 0.5)) for d, t in enumerate(texts)]
    pages = spark.createDataFrame(made, "doc_id long, page_no int, actual string, breaks array<int>")
    assert rows(M.switch_spans_of_pages(pages.drop("breaks"))) == rows(M.switch_spans(M.page_cells(pages.drop("breaks"))))
    with_breaks = sorted(repr((d, *x)) for d, _, t, b in made for x in M.page_spans(t or "", frozenset(b)))
    theirs = M.switch_spans(M.page_cells(pages)).select("doc_id", "start", "end", "reason").collect()
    assert with_breaks == sorted(repr((r.doc_id, r.start, r.end, r.reason)) for r in theirs)


def test_pages_align_as_their_regions_do(spark, tmp_path):
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["ab", "c", "Def", "gh1", "é", "2", "xyz", "q,"]) for _ in range(n))
    texts = [words(rng.randrange(260)) for _ in range(12)] + ["", None, "a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = plans.gathered(spark, str(tmp_path)).cache()
    ours = plans.QUERIES["j12_operator_anchors"](spark, str(tmp_path))
    assert rows(ours) == rows(M.align_operator_anchors(M.comparison_regions(pages))) and ours.count() > 20
    assert {"Join", "Window"}.isdisjoint(ours._jdf.queryExecution().executedPlan().toString().replace("(", " ").split())
    for name in ("j12_operator_anchors", "j13_switch_spans", "j13_pair_math_spans"):
        plan = plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan and "posexplode" not in plan, name


@settings(max_examples=400, deadline=None)
@given(st.text("ab c", max_size=40), st.text("ab c", max_size=40))
def test_matcher_is_difflib(a, b):
    assert A.matching_opcodes(a, b) == SequenceMatcher(None, a, b, False).get_opcodes()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.sampled_from("abc")), max_size=12), st.integers(0, 2), st.integers(0, 2))
def test_blank_paths_keep_words_and_common_blanks(parts, x, y):
    a, b = ("".join(" " * p[k] + p[2] for p in parts) + " " * (x, y)[k] for k in (0, 1))
    ops = A.blank_only_opcodes(a, b)
    assert "".join(a[e0:e1] for _, e0, e1, _, _ in ops) == a and "".join(b[a0:a1] for _, _, _, a0, a1 in ops) == b
    assert all(a[e0:e1] == b[a0:a1] if tag == "equal" else not (a[e0:e1] + b[a0:a1]).strip(" ") for tag, e0, e1, a0, a1 in ops)
    assert sum(e1 - e0 + a1 - a0 for tag, e0, e1, a0, a1 in ops if tag != "equal") == sum(abs(p[0] - p[1]) for p in parts) + abs(x - y)
