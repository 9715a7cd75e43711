"""Alignment from bits and on rows: the results of whole tables and of joins."""

import random

from cellwright.operators import alignment as A
from cellwright.plans import alignment as P
from tests.test_pages_in_place import moves, rows, table


def edited(rng, cells, text):
    out = list(text)
    for _ in range(rng.randrange(1, 14)):
        kind, at = rng.randrange(4), rng.randrange(len(out) + 1)
        if kind == 0:
            out.insert(at, rng.choice(cells))
        elif kind == 1:
            del out[at : at + 1]
        elif kind == 2:
            out[at : at + 1] = rng.choice(cells)
        else:
            out[at : at + 2] = out[at : at + 2][::-1]
    return "".join(out)


def test_bits_give_the_paths_of_the_whole_table(monkeypatch):
    rng, pairs = random.Random(5), [("", ""), ("", "ab"), ("ab", ""), ("aaa", "bb"), ("é😀é", "😀éé")]
    for _ in range(600):
        cells = rng.choice(["ab", "abc", "abcdefgh", "aé😀 "])
        text = "".join(rng.choice(cells) for _ in range(rng.randrange(60)))
        pairs.append((text, edited(rng, cells, text) if rng.random() < 0.7 else "".join(rng.choice(cells) for _ in range(rng.randrange(60)))))
    ours = A._bit_paths(pairs)
    for k, ((x, y), ops) in enumerate(zip(pairs, ours, strict=True)):
        band = A._Band(*(A._codes(t)[None, ::-1].astype("int32") for t in (x, y)), -len(x), len(x) + len(y) + 1)
        if not (x and y):
            assert ops == A._merged([("delete", 0, len(x), 0, 0), ("insert", len(x), len(x), 0, len(y))]), k
            continue
        costs = A._remaining_costs(band)
        steps, i, j, taken = A._steps(band, costs), len(x), len(y), []
        while i and j:
            taken.append(int(steps[0, i - 1, j - i + len(x)]))
            i, j = i - A.TAKES[taken[-1]][0], j - A.TAKES[taken[-1]][1]
        assert ops == A._opcodes(bytes(taken + [A.DELETE] * i + [A.INSERT] * j)), (x, y)
    monkeypatch.setattr(A, "BITS_HELD", 1)  # each pair alone
    assert A._bit_paths(pairs) == ours


def test_pages_of_shorter_cells_need_no_table_of_costs(monkeypatch):
    monkeypatch.delattr(A, "_remaining_costs")
    page = "one two three four five " * 14
    ops = A.edit_opcodes(page, page.replace(" ", "  ").replace("e", "a"))
    assert ops[-1][2::2] == (len(page), len(page) + 70) and sum(op[0] == "insert" for op in ops) == 70


def test_both_sides_of_a_page_are_made_on_its_row(spark, tmp_path):
    sf = table(spark, tmp_path)
    ours = P.page_pairs(spark, sf)
    assert not moves(ours)
    text = lambda column: P.pages(spark, sf, column).withColumnRenamed("page_no", "region")
    joined = text("raw_line").join(text("other").withColumnRenamed("text", "other"), ["doc_id", "region"])
    assert rows(ours) == rows(joined.withColumn("region", joined["region"].cast("long")))


def test_costs_of_all_runs_of_lines_are_edit_distances():
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, before = [i], row
            for j, b in enumerate(y, 1):
                row.append(min(before[j - 1] + (a != b), before[j] + 1, row[-1] + 1))
        return row[-1]

    rng = random.Random(3)
    for _ in range(60):
        cells = rng.choice(["ab", "abc ", "é😀a "])
        lines = ["".join(rng.choice(cells) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 6))]
        starts = A._from_each_line(lines)
        for block in ("", lines[0], " ".join(lines), "".join(rng.choice(cells) for _ in range(12))):
            costs = A.segment_costs(block, starts)
            assert all(costs[i, j] == (distance(block, " ".join(lines[i : j + 1])) if i <= j else float("inf")) for i in range(len(lines)) for j in range(len(lines)))


def test_blocks_and_lines_of_a_page_are_listed_on_its_row(spark, tmp_path):
    sf = table(spark, tmp_path)
    ours = P.QUERIES["j9_place_blocks"](spark, sf)
    assert not moves(ours)
    theirs = A.place_blocks(P.numbered_blocks(spark, sf), P.numbered_lines(spark, sf)).drop("text", "other")
    assert ours.dtypes == theirs.dtypes and rows(ours) == rows(theirs)
