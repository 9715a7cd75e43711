"""Alignment of expected with actual: anchors, slices, cells, pages and words.

Identical regions stay in native plans; the others go through Arrow one region at a time.  Long
regions are split at unique n-grams, and what is still long at the middle of a cheapest path,
so every region is aligned in bounded steps, whatever its length.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from os.path import commonprefix
from typing import NamedTuple

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells a side beyond which a region is split before it is aligned.
MOST_CELLS = 2048
#: Costs that are computed at once, unless one pair alone has more.
COSTS_HELD = 1 << 20
#: Diagonals on either side of the first band of costs, and the places that the band of one pair may have.
REACH, BAND_CELLS = 16, 1 << 24
TOO_MUCH = 1 << 28
#: Bits that stand side by side in one number where the costs of shorter pairs are found, unless one pair alone has more.
BITS_HELD = 1 << 13
#: Equal cells that a path passes at once.
LOOKED_AHEAD = 32
#: Cells of the unique texts at which longer regions are split.
ANCHOR_CELLS = 8
#: Comparison positions that one row of a packed index map holds.
INDEX_BLOCK = 64
BLANKS = re.compile(" *")
OPCODES = "doc_id long, region long, n int, tag string, e0 int, e1 int, a0 int, a1 int"


def _doc():
    return Window.partitionBy("doc_id")


def unique_anchors(exp: DataFrame, act: DataFrame) -> DataFrame:
    """(doc_id, i, j) of texts that occur once on each side."""

    def once(side: DataFrame, name: str) -> DataFrame:
        keyed = side.withColumn("h", F.xxhash64("text"))
        n = F.count("*").over(Window.partitionBy("doc_id", "h", "text"))
        return keyed.withColumn("n", n).where("n = 1").select("doc_id", "h", "text", F.col("seq").alias(name))

    return once(exp, "i").join(once(act, "j"), ["doc_id", "h", "text"]).select("doc_id", "i", "j")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Matching ratio of two short texts; below ``least`` an upper bound of it may stand instead."""

    def ratio(x: str, y: str, bound: float) -> float:
        matcher = SequenceMatcher(None, x, y, False)
        most = matcher.quick_ratio()
        return most if most < bound else matcher.ratio()

    return pd.Series([ratio(x, y, bound) for x, y, bound in zip(a, b, least, strict=True)])


def heading_anchors(exp: DataFrame, act: DataFrame, least: float = 0.85) -> DataFrame:
    """Greedy one-to-one pairs of headings by ratio, and unmatched ones with a null partner.

    Candidates are a document's headings of about equal length: 2·min/(a+b) bounds the ratio, so
    lengths differ by less than a factor, and an equi-join on bands of the length's logarithm,
    neighbours included, meets all of them.
    """
    factor = math.log((2 - least) / least)
    band = F.floor(F.log(F.greatest(F.length("text"), F.lit(1)).cast("double")) / factor)
    a = exp.select("doc_id", F.col("seq").alias("i"), F.col("text").alias("ta"), band.alias("band"))
    b = act.select("doc_id", F.col("seq").alias("j"), F.col("text").alias("tb"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    bound = 2 * F.least(F.length("ta"), F.length("tb")) / (F.length("ta") + F.length("tb"))
    pairs = a.join(b, ["doc_id", "band"]).where(bound >= least).select("doc_id", "i", "j", "ta", "tb")
    scored = pairs.withColumn("ratio", similarity("ta", "tb", F.lit(least))).where(F.col("ratio") >= least).select("doc_id", "i", "j", "ratio")

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, out = set(), set(), []
        for r in rows.sort_values(["ratio", "i", "j"], ascending=[False, True, True]).itertuples():
            if r.i not in left and r.j not in right:
                left.add(r.i)
                right.add(r.j)
                out.append((r.doc_id, r.i, r.j, r.ratio))
        return pd.DataFrame(out, columns=["doc_id", "i", "j", "ratio"])

    matched = scored.groupBy("doc_id").applyInPandas(greedy, "doc_id long, i int, j int, ratio double")
    return exp.select("doc_id", F.col("seq").alias("i")).join(matched, ["doc_id", "i"], "left")


def _sliced(side: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """Blocks of one side with their slice between anchors, place in it and its number of blocks."""
    marked = side.withColumnRenamed("seq", key).join(anchors.select("doc_id", key, F.col("i").alias("anchor")).distinct(), ["doc_id", key], "left")
    out = marked.withColumn("slice", F.coalesce(F.last("anchor", ignorenulls=True).over(_doc().orderBy(key)), F.lit(-1)))
    one = Window.partitionBy("doc_id", "slice")
    return out.select("doc_id", "slice", key, F.col("text").alias(f"t{key}"), F.row_number().over(one.orderBy(key)).alias("place"), F.count("*").over(one).alias(f"n{key}"))


def pair_between_anchors(exp: DataFrame, act: DataFrame, anchors: DataFrame) -> DataFrame:
    """J3, its native part: pairs (doc_id, i, j) at one place of the slices between anchors, where counts agree or texts do."""
    pairs = _sliced(exp, anchors, "i").join(_sliced(act, anchors, "j"), ["doc_id", "slice", "place"]).where("ni = nj OR ti = tj")
    return pairs.select("doc_id", "i", "j", (F.col("ti") == F.col("tj")).alias("same_text"))


def pair_slices(exp: DataFrame, act: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pairs (doc_id, i, j) in the slices between anchors: by place where counts agree, else the blocks of longest matching runs of texts.

    Only slices of unlike counts leave the native plan, as two arrays of text hashes each.
    """
    a, b = _sliced(exp, anchors, "i"), _sliced(act, anchors, "j")
    even = a.join(b, ["doc_id", "slice", "place"]).where("ni = nj").select("doc_id", "i", "j", (F.col("ti") == F.col("tj")).alias("same_text"))
    listed = lambda side, key: side.groupBy("doc_id", "slice").agg(F.array_sort(F.collect_list(F.struct(key, F.xxhash64(f"t{key}").alias("h")))).alias(f"l{key}"))
    uneven = listed(a, "i").join(listed(b, "j"), ["doc_id", "slice"]).where("size(li) <> size(lj)")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                x, y = list(r.li), list(r.lj)
                for block in SequenceMatcher(None, [v["h"] for v in x], [v["h"] for v in y], False).get_matching_blocks():
                    out += [(r.doc_id, x[block.a + k]["i"], y[block.b + k]["j"], True) for k in range(block.size)]
            yield pd.DataFrame(out, columns=["doc_id", "i", "j", "same_text"])

    return even.unionByName(uneven.select("doc_id", "li", "lj").mapInPandas(run, even.schema))


def merge_runs(tagged: DataFrame, keys: list[str], pos: str = "pos", tag: str = "tag") -> DataFrame:
    """Runs of adjacent positions with one tag: (keys, tag, first, last)."""
    place = F.row_number().over(Window.partitionBy(*keys, tag).orderBy(pos))
    runs = tagged.withColumn("island", F.col(pos) - place)
    return runs.groupBy(*keys, tag, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last")).drop("island")


def merge_opcodes(opcodes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """W7 of opcodes that follow each other without a gap: neighbours of one tag become one, numbered from 0."""
    own = Window.partitionBy(*keys).orderBy(*order)
    rows = opcodes.withColumn("group", F.sum((~F.lag("tag").over(own).eqNullSafe(F.col("tag"))).cast("int")).over(own) - 1)
    return rows.groupBy(*keys, F.col("group").cast("int").alias("n")).agg(F.first("tag").alias("tag"), *(f(c).alias(c) for f, c in ((F.min, "e0"), (F.max, "e1"), (F.min, "a0"), (F.max, "a1"))))


def align_equal_width(exp: DataFrame, act: DataFrame) -> DataFrame:
    """Positional compare of regions (doc_id, region, pos, mask): runs of equal and replace."""
    both = exp.join(act.withColumnRenamed("mask", "other"), ["doc_id", "region", "pos"])
    tagged = both.withColumn("tag", F.when(F.col("mask").eqNullSafe(F.col("other")), "equal").otherwise("replace"))
    return merge_runs(tagged, ["doc_id", "region"])


def align_equal_texts(pairs: DataFrame) -> DataFrame:
    """J4 of regions (doc_id, region, text, other) of equal width: the same runs, found on each row, so that no cell moves."""
    cells = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    rows = pairs.where("text <> ''").select("doc_id", "region", F.zip_with(cells("text"), cells("other"), lambda x, y: x == y).alias("same"))
    rows = rows.withColumn("firsts", F.expr("filter(sequence(0, size(same) - 1), k -> k = 0 OR same[k] <> same[k - 1])"))
    rows = rows.withColumn("lasts", F.expr("concat(transform(slice(firsts, 2, size(firsts)), k -> k - 1), array(size(same) - 1))"))
    runs = rows.select("doc_id", "region", "same", F.explode(F.arrays_zip("firsts", "lasts")).alias("r"))
    tag = F.when(F.expr("same[r.firsts]"), "equal").otherwise("replace")
    return runs.select("doc_id", "region", tag.alias("tag"), F.col("r.firsts").alias("first"), F.col("r.lasts").alias("last"))


def _gaps(text: str) -> Column:
    """Blanks before each non-blank cell of a text, and after the last one."""
    return F.transform(F.split(text, "[^ ]"), F.length)


def align_blank_only(exp: DataFrame, act: DataFrame) -> DataFrame:
    """Regions with the same non-blank text: at each gap the common blanks, then the surplus deleted or inserted."""
    return blank_only_gaps(exp.join(act.withColumnRenamed("text", "other"), ["doc_id", "region"]))


def blank_only_gaps(pairs: DataFrame) -> DataFrame:
    """J5 of regions (doc_id, region, text, other) with both sides on one row."""
    rows = pairs.where(F.translate("text", " ", "") == F.translate("other", " ", ""))
    gaps = rows.select("doc_id", "region", F.posexplode(F.arrays_zip(_gaps("text").alias("be"), _gaps("other").alias("ba"))).alias("rank", "g"))
    gaps = gaps.select("doc_id", "region", "rank", "g.be", "g.ba").where("be + ba > 0")
    zero = F.lit(0)
    return gaps.select("doc_id", "region", "rank", F.least("be", "ba").alias("equal"), F.greatest(F.col("be") - F.col("ba"), zero).alias("deleted"), F.greatest(F.col("ba") - F.col("be"), zero).alias("inserted"))


def alignment_path(pairs: DataFrame) -> DataFrame:
    """Which way a region (doc_id, region, text, other) takes: identical, blank_only or matching."""
    bare = lambda c: F.translate(c, " ", "")
    path = F.when(F.col("text") == F.col("other"), "identical").when(bare("text") == bare("other"), "blank_only").otherwise("matching")
    return pairs.withColumn("path", path)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def _cost_rows(a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the edit costs of all prefixes, adjacent swaps at one, row by row of ``a``.

    Rows are kept less their column number, so that insertions are a running minimum.
    """
    ramp = np.arange(len(b) + 1, dtype=np.int64)
    before, row = None, np.zeros_like(ramp)
    yield ramp
    for i, cell in enumerate(a.tolist()):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] - (b == cell), row[1:] + 1)
        if i and len(b) > 1:
            swap = np.flatnonzero((b[1:] == a[i - 1]) & (b[:-1] == cell))
            if len(swap):
                new[swap + 2] = np.minimum(new[swap + 2], before[swap] - 1)
        before, row = row, np.minimum.accumulate(new)
        yield row + ramp


#: Steps of a path: cells of the expected and of the actual side that each takes, and its tag.
EQUAL, SWAP, SUBSTITUTE, DELETE, INSERT = range(5)
TAKES = ((1, 1), (2, 2), (1, 1), (1, 0), (0, 1))
SAME_TAG = re.compile(b"(\x00+)|([\x01\x02]+)|(\x03+)|(\x04+)")
TAGS = ("equal", "replace", "delete", "insert")


class _Band(NamedTuple):
    """Reversed pairs side by side, seen within a band of diagonals, so that what remains is a prefix.

    A place is (p, w): p cells of the first side remain and p + low + w of the second.
    """

    a: np.ndarray
    b: np.ndarray
    low: int
    width: int

    def beside(self, values: np.ndarray, back: int = 0) -> np.ndarray:
        """Of each place with p from 1 the value of the second side's last remaining cell, or of one ``back`` before it."""
        n, pad = self.a.shape[1], max(0, -self.low) + 1
        over = max(0, n + self.low + self.width - values.shape[1])
        wide = np.pad(values, ((0, 0), (pad, over)), constant_values=-3)
        first = pad + self.low - back
        return sliding_window_view(wide, self.width, axis=1)[:, first : first + n]


def _batches(pairs: list[tuple[str, str]], reach: int) -> Iterator[tuple[list[int], _Band]]:
    """Pairs of about one size together, with ``reach`` diagonals on either side of those between their ends."""
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    while order:
        chunk: list[int] = []
        n = m = low = high = 0
        while order:
            x, y = pairs[order[-1]]
            grown = max(n, len(x)), max(m, len(y)), min(low, len(y) - len(x)), max(high, len(y) - len(x))
            if chunk and (len(chunk) + 1) * (grown[0] + 1) * (grown[3] - grown[2] + 2 * reach + 1) > COSTS_HELD:
                break
            (n, m, low, high), _ = grown, chunk.append(order.pop())
        a, b = np.full((len(chunk), n), -1, np.int32), np.full((len(chunk), m), -2, np.int32)  # padding equals nothing
        for row, k in enumerate(chunk):
            x, y = pairs[k]
            a[row, : len(x)], b[row, : len(y)] = _codes(x)[::-1], _codes(y)[::-1]
        low, high = max(low - reach, -n), min(high + reach, m)
        yield chunk, _Band(a, b, low, high - low + 1)


def _remaining_costs(band: _Band) -> np.ndarray:
    """Edit costs of what remains at the places of a band, adjacent swaps at one; a way out of the band costs too much."""
    a, low, width = band.a, band.low, band.width
    k, n = a.shape
    costs = np.full((k, n + 1, width), TOO_MUCH, np.int32)
    same = band.beside(band.b) == a[:, :, None]
    ramp = np.arange(width, dtype=np.int32)
    costs[:, 0, -low:] = ramp[: width + low]
    if n > 1:
        crossed = (band.beside(band.b, 1)[:, 1:] == a[:, 1:, None]) & (band.beside(band.b)[:, 1:] == a[:, :-1, None])
    for p in range(1, n + 1):
        before, new = costs[:, p - 1], costs[:, p]
        np.add(before, ~same[:, p - 1], out=new, casting="unsafe")
        np.minimum(new[:, :-1], before[:, 1:] + 1, out=new[:, :-1])
        if p > 1:
            np.minimum(new, np.where(crossed[:, p - 2], costs[:, p - 2] + 1, TOO_MUCH), out=new)
        if p + low <= 0:  # nothing remains of the second side here, and less than nothing before
            new[:, : -low - p] = TOO_MUCH
            if -low - p < width:
                new[:, -low - p] = p
        new -= ramp  # insertions are a running minimum
        np.minimum.accumulate(new, axis=1, out=new)
        new += ramp
    return costs


def _run_lengths(side: np.ndarray) -> np.ndarray:
    """For each cell of reversed texts how many equal ones go on from it."""
    out = np.ones_like(side)
    for i in range(1, side.shape[1]):
        out[:, i] += np.where(side[:, i] == side[:, i - 1], out[:, i - 1], 0)
    return out


def _steps(band: _Band, costs: np.ndarray) -> np.ndarray:
    """The step to take at each place of a band with cells on both sides, for all places at once.

    Of the steps that a cheapest path can take the first of this order counts: an insertion in front of an
    equal cell of its run; a deletion in front of a run that is left one cell longer than its counterpart
    and is followed by a substitution, which it then stands apart from; an equal cell; a swap; a
    substitution; a deletion; an insertion.
    """
    a, low, width = band.a, band.low, band.width
    here, diagonal = costs[:, 1:], costs[:, :-1]
    same = a[:, :, None] == band.beside(band.b)
    deletes, inserts = np.zeros(here.shape, bool), np.zeros(here.shape, bool)
    deletes[:, :, :-1] = here[:, :, :-1] == diagonal[:, :, 1:] + 1
    inserts[:, :, 1:] = here[:, :, 1:] == here[:, :, :-1] + 1
    steps = np.where(deletes, DELETE, INSERT).astype(np.uint8)
    steps[here == diagonal + 1] = SUBSTITUTE
    if a.shape[1] > 1:
        crossed = (a[:, 1:, None] == band.beside(band.b, 1)[:, 1:]) & (a[:, :-1, None] == band.beside(band.b)[:, 1:])
        steps[:, 1:][crossed & (here[:, 1:] == costs[:, :-2] + 1)] = SWAP
    steps[same & (here == diagonal)] = EQUAL
    run_a, run_b = _run_lengths(a), band.beside(_run_lengths(band.b))
    row, i, w = np.nonzero(same & deletes & (run_a[:, :, None] == run_b + 1))
    after_a = i + 1 - run_a[row, i]  # what remains behind both runs, one diagonal on
    after_b, w = i + 1 + low + w - run_b[row, i, w], w + 1
    apart = (after_a > 0) & (after_b > 0) & (w < width)
    w = np.minimum(w, width - 1)
    apart &= costs[row, after_a, w] == costs[row, after_a - 1, w] + 1
    steps[row[apart], i[apart], w[apart] - 1] = DELETE
    steps[same & inserts & (run_b > 1)] = INSERT
    return steps


def _opcodes(taken: bytes) -> list[tuple[str, int, int, int, int]]:
    """Merged opcodes of a path's steps."""
    out, e, a = [], 0, 0
    for run in SAME_TAG.finditer(taken):
        tag = TAGS[run.lastindex - 1]
        size = run.end() - run.start() + (run[0].count(SWAP) if tag == "replace" else 0)  # a swap takes two cells
        e1, a1 = e + size * (tag != "insert"), a + size * (tag != "delete")
        out.append((tag, e, e1, a, a1))
        e, a = e1, a1
    return out


def single_edit(expected: str, actual: str) -> list[tuple[str, int, int, int, int]] | None:
    """The opcodes where one edit turns one text into the other, else null; found without costs.

    An inserted cell goes to the front of its run, a deleted one comes as late as it can.
    """
    n, m = len(expected), len(actual)
    low, high = 0, min(n, m)
    if abs(n - m) > 1:
        return None
    while low < high:  # the common prefix
        middle = (low + high + 1) // 2
        low, high = (middle, high) if expected[low:middle] == actual[low:middle] else (low, middle - 1)
    p, step = low, None
    if n == m:
        if p == n or expected[p + 1 :] == actual[p + 1 :]:
            step = ("replace", p, min(p + 1, n), p, min(p + 1, m))
        elif expected[p : p + 2] == actual[p : p + 2][::-1] and expected[p + 2 :] == actual[p + 2 :]:
            step = ("replace", p, p + 2, p, p + 2)
    elif n < m and expected[p:] == actual[p + 1 :]:
        p = len(expected[:p].rstrip(actual[p]))
        step = ("insert", p, p, p, p + 1)
    elif n > m and expected[p + 1 :] == actual[p:]:
        step = ("delete", p, p + 1, p, p)
    return step and _merged([("equal", 0, step[1], 0, step[3]), step, ("equal", step[2], n, step[4], m)])


class _Deltas(NamedTuple):
    """What the costs of reversed pairs side by side are beside their neighbours, a number for each cell of the first sides.

    Its bits are the places of the second sides, those of a pair ``stride`` after those of the pair before.
    ``free``: as at one cell less of both sides; ``deletes``, ``inserts``: one more than at one cell less of the first or of
    the second side.  ``plain`` has a byte a place: equal cells before which no insertion or deletion can come.
    """

    stride: int
    width: int
    free: list[int]
    deletes: list[int]
    inserts: list[int]
    plain: bytes

    def has(self, bits: list[int], p: int, pair: int, q: int) -> int:
        return bits[p] >> pair * self.stride + q & 1


def _side_by_side(pairs: list[tuple[str, str]]) -> Iterator[list[int]]:
    """Pairs of about one size together."""
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][1]), len(pairs[k][0])))
    while order:
        most = len(pairs[order[-1]][1]) + 8
        take = max(1, BITS_HELD // most)
        yield order[-take:]
        del order[-take:]


def _deltas(a: list[str], b: list[str]) -> _Deltas:
    """The differences of all edit costs of reversed pairs, adjacent swaps at one: Hyyro's bit-parallel recurrences, all pairs at once."""
    n, stride = max(map(len, a)), max(map(len, b)) // 8 * 8 + 8  # a bit at least stays free, where carries end
    first, second = np.full((len(a), n), -1, np.int32), np.full((len(b), stride), -2, np.int32)  # padding equals nothing
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        first[k, : len(x)], second[k, : len(y)] = _codes(x), _codes(y)
    number = lambda bits: int.from_bytes(np.packbits(bits, axis=None, bitorder="little").tobytes(), "little")
    equal = np.packbits(first.T[:, :, None] == second[None], axis=-1, bitorder="little").tobytes()
    every, lowest, again = np.ones(second.shape, bool), np.zeros(second.shape, bool), np.zeros(second.shape, bool)
    every[:, -1], lowest[:, 0] = False, True
    again[:, 1:] = second[:, 1:] == second[:, :-1]
    every, lowest, again, row = number(every), number(lowest), number(again), len(a) * stride // 8
    up, down, free, before = every, 0, 0, 0
    kept: tuple[list[int], ...] = ([], [], [])
    plain = bytearray()
    for at in range(0, n * row, row):
        same = int.from_bytes(equal[at : at + row], "little")
        free = (((free ^ every) & same) << 1 & before | ((same & up) + up ^ up) | same | down) & every
        more, less, before = down | every & ~(free | up), (free & up) << 1 & every, same
        beside = (more << 1 | lowest) & every
        up, down = less | every & ~(free | beside), beside & free
        for bits, now in zip(kept, (free, more, up), strict=True):
            bits.append(now)
        plain += (same & ~(more | up & again)).to_bytes(row, "little")
    return _Deltas(stride, 8 * row, *kept, np.unpackbits(np.frombuffer(plain, np.uint8), bitorder="little").tobytes())


def _bit_step(bits: _Deltas, a: str, b: str, pair: int, p: int, q: int) -> int:
    """The step of ``_steps`` where cell p of a reversed side and cell q of the other come first, unless the cells are plainly equal."""
    deletes, inserts = bits.has(bits.deletes, p, pair, q), bits.has(bits.inserts, p, pair, q)
    if a[p] == b[q]:
        if inserts and q and b[q] == b[q - 1]:
            return INSERT
        after_a, after_b = len(a[: p + 1].rstrip(a[p])), len(b[: q + 1].rstrip(b[q]))
        apart = deletes and p - after_a == q - after_b + 1 and after_a and after_b and not bits.has(bits.free, after_a - 1, pair, after_b - 1)
        return DELETE if apart else EQUAL
    free = bits.has(bits.free, p, pair, q)
    if p and q and a[p] == b[q - 1] and a[p - 1] == b[q] and free != bits.has(bits.free, p - 1, pair, q - 1):
        return SWAP
    return (DELETE if deletes else INSERT) if free else SUBSTITUTE


def _bit_paths(pairs: list[tuple[str, str]]) -> list[list[tuple[str, int, int, int, int]]]:
    """``edit_paths`` of pairs of at most ``MOST_CELLS``: the steps of the whole table, from a bit a place for each way to it."""
    out: list[list] = [[] for _ in pairs]
    for chunk in _side_by_side(pairs):
        a, b = ([pairs[k][side][::-1] for k in chunk] for side in (0, 1))
        bits = _deltas(a, b)
        before = -bits.width - 1  # the place at one cell less of both sides
        for pair, (k, x, y) in enumerate(zip(chunk, a, b, strict=True)):
            i, j, taken = len(x), len(y), bytearray()
            while i and j:
                at, most = (i - 1) * bits.width + pair * bits.stride + j - 1, min(i, j, LOOKED_AHEAD)
                end = at + most * before
                run = bits.plain[at : end if end >= 0 else None : before].find(0)
                if run:
                    run = most if run < 0 else run
                    taken += bytes(run)
                    i, j = i - run, j - run
                    continue
                step = _bit_step(bits, x, y, pair, i - 1, j - 1)
                taken.append(step)
                i, j = i - TAKES[step][0], j - TAKES[step][1]
            out[k] = _opcodes(bytes(taken) + bytes([DELETE]) * i + bytes([INSERT]) * j)
    return out


def edit_paths(pairs: list[tuple[str, str]]) -> list[list[tuple[str, int, int, int, int]]]:
    """J7 of many pairs: minimum edits with adjacent swaps at one, as merged opcodes; a swap is a replaced pair.

    Pairs that one edit parts need no costs.  Others of up to ``MOST_CELLS`` take theirs from bits.  Longer ones are costed
    together, by size, in a band of diagonals: a path of no more edits than the band reaches cannot leave it, so its costs
    and steps are those of the whole table; pairs with more edits go on in a band of four times the reach.
    Pairs whose band grows beyond ``BAND_CELLS`` are split.
    """
    out = [single_edit(*pair) for pair in pairs]
    short = [k for k, ops in enumerate(out) if ops is None and max(map(len, pairs[k])) <= MOST_CELLS]
    for k, ops in zip(short, _bit_paths([pairs[k] for k in short]), strict=True):
        out[k] = ops
    rest, reach = [k for k, ops in enumerate(out) if ops is None], REACH
    while rest:
        fits = lambda x, y: (len(x) + 1) * (abs(len(x) - len(y)) + 2 * reach + 1) <= BAND_CELLS or max(len(x), len(y)) <= MOST_CELLS  # noqa: B023, E731
        for k in rest:
            if not fits(*pairs[k]):
                out[k] = split_opcodes(*pairs[k])
        rest, again = [k for k in rest if out[k] is None], []
        for chunk, band in _batches([pairs[k] for k in rest], reach):
            costs = _remaining_costs(band)
            steps = _steps(band, costs)
            for row, k in enumerate(chunk):
                x, y = pairs[rest[k]]
                i, j = len(x), len(y)
                if costs[row, i, j - i - band.low] > reach and reach < max(i, j):
                    again.append(rest[k])
                    continue
                table, taken = steps[row].tobytes(), bytearray()
                while i and j:
                    step = table[(i - 1) * band.width + j - i - band.low]
                    taken.append(step)
                    i, j = i - TAKES[step][0], j - TAKES[step][1]
                out[rest[k]] = _opcodes(bytes(taken) + bytes([DELETE]) * i + bytes([INSERT]) * j)
        rest, reach = again, reach * 4
    return out


def edit_opcodes(expected: str, actual: str) -> list[tuple[str, int, int, int, int]]:
    """J7 of one pair."""
    return edit_paths([(expected, actual)])[0]


def halved(expected: str, actual: str) -> tuple[int, int]:
    """A place that a cheapest path passes, at the middle of the longer side, from two rows of costs."""
    if len(actual) > len(expected):
        j, i = halved(actual, expected)
        return i, j
    i = len(expected) // 2
    for down in _cost_rows(_codes(expected[:i]), _codes(actual)):
        pass
    for up in _cost_rows(_codes(expected[i:])[::-1], _codes(actual)[::-1]):
        pass
    return i, int(np.argmin(down + up[::-1]))


def _merged(ops) -> list[tuple[str, int, int, int, int]]:
    out: list[tuple] = []
    for op in ops:
        if op[1] == op[2] and op[3] == op[4]:
            continue
        if out and out[-1][0] == op[0]:
            out[-1] = (op[0], out[-1][1], op[2], out[-1][3], op[4])
        else:
            out.append(tuple(op))
    return out


def blank_only_opcodes(expected: str, actual: str) -> list[tuple[str, int, int, int, int]]:
    """J5 of one region: at each gap the common blanks, then the surplus."""
    ops, e, a = [], 0, 0
    beyond = lambda text, at: BLANKS.match(text, at).end()
    until = lambda text, at: text.find(" ", at) % (len(text) + 1)
    while e < len(expected) or a < len(actual):
        e1, a1 = beyond(expected, e), beyond(actual, a)
        both = min(e1 - e, a1 - a)
        ops += [("equal", e, e + both, a, a + both), ("delete", e + both, e1, a + both, a + both), ("insert", e1, e1, a + both, a1)]
        word = max(min(until(expected, e1) - e1, until(actual, a1) - a1), 1)
        if e1 < len(expected):
            ops.append(("equal", e1, e1 + word, a1, a1 + word))
        e, a = e1 + word, a1 + word
    return _merged(ops)


def _split_points(expected: str, actual: str) -> list[tuple[int, int]]:
    """Places of the cell n-grams that occur once on each side: the longest chain in order on both."""

    def once(text: str) -> dict[str, int]:
        at: dict[str, int] = {}
        for k in range(len(text) - ANCHOR_CELLS + 1):
            gram = text[k : k + ANCHOR_CELLS]
            at[gram] = -1 if gram in at else k
        return {gram: k for gram, k in at.items() if k >= 0}

    theirs = once(actual)
    found = [(i, theirs[gram]) for gram, i in once(expected).items() if gram in theirs]
    found.sort()
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(found):
        k = bisect_left(tops, j)
        before.append(ends[k - 1] if k else -1)
        tops[k:k + 1], ends[k:k + 1] = [j], [n]
    chain, n = [], ends[-1] if ends else -1
    while n >= 0:
        chain.append(found[n])
        n = before[n]
    return chain[::-1]


def longest_match(x: str, y: str) -> tuple[int, int, int]:
    """(i, j, k): the longest text that both hold, where it first stands in x and then in y; all 0 without one.

    The common beginning and end bound its length from below, which is often all of it; beyond that the length is
    searched by what pieces of one length both have.
    """
    if not x or not y:
        return 0, 0, 0
    pieces = lambda text, k: (text[i : i + k] for i in range(len(text) - k + 1))
    least, most = max(len(commonprefix([x, y])), len(commonprefix([x[::-1], y[::-1]]))), min(len(x), len(y)) + 1  # there is one, there is none
    step = 1
    while least + 1 < most:
        k = min(least + step, (least + most) // 2) if most <= min(len(x), len(y)) else min(least + step, most - 1)
        if set(pieces(y, k)).isdisjoint(pieces(x, k)):
            most = k
        else:
            least = k
        step *= 2
    if not least:
        return 0, 0, 0
    known = set(pieces(y, least))
    i = next(i for i, piece in enumerate(pieces(x, least)) if piece in known)
    return i, y.index(x[i : i + least]), least


def matching_opcodes(expected: str, actual: str) -> list[tuple[str, int, int, int, int]]:
    """By longest matching blocks, as ``difflib`` finds them without junk."""
    blocks, parts = [], [(0, len(expected), 0, len(actual))]
    while parts:
        e, i, a, j = parts.pop()
        p, q, k = longest_match(expected[e:i], actual[a:j])
        if k:
            blocks.append((e + p, a + q, k))
            parts += [(e, e + p, a, a + q), (e + p + k, i, a + q + k, j)]
    ops, e, a = [], 0, 0
    for p, q, k in [*sorted(blocks), (len(expected), len(actual), 0)]:
        tag = "replace" if e < p and a < q else "delete" if e < p else "insert"
        ops += [(tag, e, p, a, q), ("equal", p, p + k, q, q + k)]
        e, a = p + k, q + k
    return _merged(ops)


def split_opcodes(expected: str, actual: str, align=edit_opcodes) -> list[tuple[str, int, int, int, int]]:
    """Opcodes of a region of any size: beyond ``MOST_CELLS`` split at unique n-grams, then in halves of a cheapest path."""
    ops: list[tuple] = []

    def piece(e: int, i: int, a: int, j: int) -> None:
        if max(i - e, j - a) <= MOST_CELLS:
            ops.extend((tag, e + e0, e + e1, a + a0, a + a1) for tag, e0, e1, a0, a1 in align(expected[e:i], actual[a:j]))
            return
        x, y = halved(expected[e:i], actual[a:j])
        piece(e, e + x, a, a + y)
        piece(e + x, i, a + y, j)

    e = a = 0
    for i, j in _split_points(expected, actual) if max(len(expected), len(actual)) > MOST_CELLS else []:
        end = i + ANCHOR_CELLS, j + ANCHOR_CELLS
        if i >= e and j >= a:
            piece(e, i, a, j)
            ops.append(("equal", i, end[0], j, end[1]))
        elif i - e == j - a:  # goes on from the anchor before
            ops.append(("equal", e, end[0], a, end[1]))
        else:
            continue
        e, a = end
    piece(e, len(expected), a, len(actual))
    return _merged(ops)


def positional_opcodes(expected: str, actual: str) -> list[tuple[str, int, int, int, int]]:
    """J4 of one region of equal width: runs of equal and of replaced cells."""
    return _merged([("equal" if x == y else "replace", k, k + 1, k, k + 1) for k, (x, y) in enumerate(zip(expected, actual, strict=True))])


def region_opcodes(path: str, expected: str, actual: str) -> list[tuple[str, int, int, int, int]]:
    """Opcodes of one region by its way: cell by cell, J5, J6's matching blocks, or J7's minimum edits."""
    if path == "positional":
        return positional_opcodes(expected, actual)
    if path == "blank_only":
        return blank_only_opcodes(expected, actual)
    return split_opcodes(expected, actual, matching_opcodes) if path == "matching" else edit_opcodes(expected, actual)


def regions_opcodes(regions: list[tuple[str, str, str]]) -> list[list[tuple[str, int, int, int, int]]]:
    """Opcodes of many regions (path, expected, actual); those by minimum edits are aligned side by side."""
    edited = list({(x, y) for path, x, y in regions if path == "edits"})
    known = dict(zip(edited, edit_paths(edited), strict=True))
    return [(path == "edits" and known.get((x, y))) or region_opcodes(path, x, y) for path, x, y in regions]


def joined_opcodes(regions: list[tuple[str, str, str, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Opcodes of regions (path, expected, actual, e0, a0) that follow each other, in one list: neighbours of one tag become one."""
    changed = iter(regions_opcodes([r[:3] for r in regions if r[1] != r[2]]))
    ops = (((tag, e + e0, e + e1, a + a0, a + a1) for tag, e0, e1, a0, a1 in next(changed)) if x != y else [("equal", e, e + len(x), a, a + len(y))] for _, x, y, e, a in regions)
    return _merged(op for each in ops for op in each)


def identical_opcodes(pairs: DataFrame) -> DataFrame:
    """One equal run for each region whose sides are the same; empty ones have none."""
    return pairs.where("text = other AND text <> ''").select(
        "doc_id", "region", F.lit(0).alias("n"), F.lit("equal").alias("tag"), F.lit(0).alias("e0"), F.length("text").alias("e1"), F.lit(0).alias("a0"), F.length("other").alias("a1")
    )


def align_bounded(pairs: DataFrame) -> DataFrame:
    """Opcodes of regions (doc_id, region, text, other) by minimum edits, or by their column path (J6); identical ones never leave the native plan."""
    pairs = pairs if "path" in pairs.columns else pairs.withColumn("path", F.lit("edits"))

    def run(batches):
        for batch in batches:
            found = regions_opcodes(list(zip(batch["path"], batch["text"], batch["other"], strict=True)))
            sizes = [len(ops) for ops in found]
            out = pd.DataFrame([op for ops in found for op in ops], columns=["tag", "e0", "e1", "a0", "a1"])
            keys = {c: np.repeat(batch[c].to_numpy(), sizes) for c in ("doc_id", "region")}
            yield out.assign(n=[n for size in sizes for n in range(size)], **keys)[["doc_id", "region", "n", *out.columns]]

    changed = pairs.where("text <> other").select("doc_id", "region", "text", "other", "path").mapInPandas(run, OPCODES)
    return identical_opcodes(pairs).unionByName(changed)


def align_cells(pairs: DataFrame) -> DataFrame:
    """Opcodes of all regions by the way that each takes."""
    return align_bounded(alignment_path(pairs))


@F.pandas_udf(T.IntegerType())
def matching_characters(a: pd.Series, b: pd.Series) -> pd.Series:
    """Characters in the matching blocks of two texts."""
    return pd.Series([sum(m.size for m in SequenceMatcher(None, x, y, False).get_matching_blocks()) for x, y in zip(a, b, strict=True)], dtype="int32")


def _spans(pages: DataFrame, side: str, most: int) -> DataFrame:
    """Runs of 1 to ``most`` consecutive pages: first, width, joined text and share of the document before."""
    own = _doc().orderBy("page_no")
    size = F.sum(F.length("text")).over(_doc())
    before = F.coalesce(F.sum(F.length("text")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / size
    texts = F.collect_list("text").over(own.rowsBetween(0, most - 1))
    rows = pages.select("doc_id", F.col("page_no").alias(f"{side}0"), before.alias(f"{side}at"), texts.alias("ts"), F.max("page_no").over(_doc()).alias(f"{side}last"))
    rows = rows.withColumn(f"{side}w", F.explode(F.sequence(F.lit(1), F.size("ts"))))
    return rows.withColumn(f"{side}t", F.array_join(F.expr(f"slice(ts, 1, {side}w)"), " ")).drop("ts")


def _stable_documents(exp: DataFrame, act: DataFrame) -> DataFrame:
    """Documents with as many pages on both sides, each page of about the same size."""
    b = act.select("doc_id", "page_no", F.length("text").alias("m"))
    both = exp.select("doc_id", "page_no", F.length("text").alias("n")).join(b, ["doc_id", "page_no"], "full")
    near = F.coalesce(F.abs(F.col("n") - F.col("m")) <= F.greatest(F.lit(20.0), F.col("n") / 4), F.lit(False))
    return both.groupBy("doc_id").agg(F.bool_and(near).alias("near")).where("near").select("doc_id")


def match_page_regions(exp: DataFrame, act: DataFrame, band: float = 0.12, most: int = 3) -> DataFrame:
    """Monotone pairing of runs of 1-3 pages a side, by best sum of matches less half the edits and a width penalty.

    Documents whose page counts agree and whose pages differ in size by at most a quarter (or
    20 cells) pair page by page.  For the others candidates come from an equi-join on bands of
    the cumulative share and are scored in parallel by their matching blocks; only
    the path is picked document by document, over one short row a candidate.  A document
    without a path is one region, with nulls for a side that it is not on.
    """
    stable = _stable_documents(exp, act)
    paired = exp.join(stable, "doc_id").select("doc_id", *(F.col("page_no").alias(c) for c in ("e_first", "e_last", "a_first", "a_last")))
    exp, act = exp.join(stable, "doc_id", "left_anti"), act.join(stable, "doc_id", "left_anti")
    a, b = _spans(exp, "e", most), _spans(act, "a", most)
    a = a.withColumn("band", F.floor(F.col("eat") / band))
    b = b.withColumn("band", F.explode(F.array(*(F.floor(F.col("aat") / band) + k for k in (-1, 0, 1)))))
    pairs = a.join(b, ["doc_id", "band"]).where(F.abs(F.col("eat") - F.col("aat")) <= band)
    pairs = pairs.withColumn("match", matching_characters("et", "at"))
    match = F.col("match")
    score = match - 0.5 * (F.length("et") + F.length("at") - 2 * match) - 5 * (F.col("ew") + F.col("aw") - 2)
    cands = pairs.select("doc_id", "e0", "ew", "elast", "a0", "aw", "alast", score.alias("score"))

    def pick(whole: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(1, 1): (0.0, None)}
        for r in rows.sort_values(["e0", "a0", "ew", "aw"]).itertuples():
            start = best.get((r.e0, r.a0))
            if start is not None:
                end, total = (r.e0 + r.ew, r.a0 + r.aw), start[0] + r.score
                if end not in best or total > best[end][0]:
                    best[end] = (total, (r.e0, r.a0))
        columns = ["doc_id", "e_first", "e_last", "a_first", "a_last"]
        fallback = tuple(None if pd.isna(x) else int(x) for x in whole[columns].iloc[0])
        at, out = (int(rows["elast"].iloc[0]) + 1, int(rows["alast"].iloc[0]) + 1) if len(rows) else None, []
        while at in best and best[at][1] is not None:
            before = best[at][1]
            out.append((rows["doc_id"].iloc[0], before[0], at[0] - 1, before[1], at[1] - 1))
            at = before
        return pd.DataFrame(out[::-1] or [fallback], columns=columns, dtype=object)

    extent = lambda side, c: side.groupBy("doc_id").agg(F.min("page_no").alias(f"{c}_first"), F.max("page_no").alias(f"{c}_last"))
    whole = extent(exp, "e").join(extent(act, "a"), "doc_id", "full")
    schema = "doc_id long, e_first int, e_last int, a_first int, a_last int"
    return paired.unionByName(whole.groupBy("doc_id").cogroup(cands.groupBy("doc_id")).applyInPandas(pick, schema))


def assign_blocks_to_lines(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Consecutive lines for each block of a region, at least one, by smallest sum of length differences.

    ``blocks`` and ``lines`` are (doc_id, region, n, text), n from 0; a region is one page.
    """
    b = blocks.groupBy("doc_id", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.length("text").alias("s")))), lambda x: x["s"]).alias("b"))
    l = lines.groupBy("doc_id", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.length("text").alias("s")))), lambda x: x["s"]).alias("l"))

    def fit(sizes: list[int], rows: list[int]) -> list[tuple[int, int, int]]:
        best = {0: (0.0, [])}
        for k, size in enumerate(sizes):
            nxt: dict[int, tuple[float, list]] = {}
            for at, (total, path) in best.items():
                widest = len(rows) - (len(sizes) - 1 - k)  # every later block gets a line
                for end in range(at + 1, widest + 1):
                    cost = total + abs(sum(rows[at:end]) + end - at - 1 - size) + 0.01 * (end - at)
                    if end not in nxt or cost < nxt[end][0]:
                        nxt[end] = (cost, [*path, (k, at, end - 1)])
            best = nxt
        return min(best.values(), key=lambda x: x[0])[1] if best else []

    def run(batches):
        for batch in batches:
            out = [(r.doc_id, r.region, *x) for r in batch.itertuples() for x in fit(list(r.b), list(r.l))]
            yield pd.DataFrame(out, columns=["doc_id", "region", "block", "first_line", "last_line"])

    return b.join(l, ["doc_id", "region"]).mapInPandas(run, "doc_id long, region int, block int, first_line int, last_line int")


class _Starts(NamedTuple):
    """What follows from each line on, one after another in the bits of a number: places of each character, and where lines end."""

    at: dict[str, int]
    every: int
    lowest: int
    size: int
    first: np.ndarray
    reach: np.ndarray


def _from_each_line(lines: list[str]) -> _Starts:
    text, ends = " ".join(lines), np.cumsum([len(x) + 1 for x in lines]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = len(text) - starts + 1  # a bit stays free behind each, where carries end
    first = np.cumsum(sizes) - sizes
    places: dict[str, int] = {}
    for k, cell in enumerate(text):
        places[cell] = places.get(cell, 0) | 1 << k
    shifts = list(zip(starts.tolist(), first.tolist(), strict=True))
    at = {cell: sum(bits >> start << low for start, low in shifts) for cell, bits in places.items()}
    every = sum(((1 << size - 1) - 1) << low for size, low in zip(sizes.tolist(), first.tolist(), strict=True))
    lowest = sum(1 << low for size, low in zip(sizes.tolist(), first.tolist(), strict=True)) & every
    return _Starts(at, every, lowest, int(sizes.sum()), first, ends[None, :] - starts[:, None])


def segment_costs(block: str, lines: list[str] | _Starts) -> np.ndarray:
    """Edit costs of a block against all runs of consecutive lines joined by blanks: [first, last], infinite where last is before first.

    One table for each block, by Myers' bit-parallel recurrences: from every line on, its last row holds the costs of all
    prefixes of what follows.
    """
    starts = lines if isinstance(lines, _Starts) else _from_each_line(lines)
    every, lowest, up, down = starts.every, starts.lowest, starts.every, 0
    for cell in block:
        same = starts.at.get(cell, 0)
        free = ((same & up) + up ^ up) | same | down
        beside, less = ((down | every & ~(free | up)) << 1 | lowest) & every, (free & up) << 1 & every
        up, down = less | every & ~(free | beside), beside & free
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(starts.size // 8 + 1, "little"), np.uint8), count=starts.size, bitorder="little").astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(bits(up) - bits(down))])
    costs = len(block) + sums[starts.first[:, None] + np.maximum(starts.reach, 0)] - sums[starts.first][:, None]
    return np.where(starts.reach >= 0, costs, np.inf)


def block_lines(blocks: list[str], lines: list[str]) -> list[tuple[int, int, int]]:
    """J9 of one region: (block, first line, last line) of best total score; none with fewer lines than blocks.

    A block's score on a run of lines is its length less its edit cost, a twentieth for each line and
    three quarters for each cell of difference in length; among equal totals earlier blocks are
    shorter.  Lines behind the last block's may stay without one.
    """
    n, m = len(blocks), len(lines)
    if not n or m < n:
        return []
    ends = np.cumsum([len(x) + 1 for x in lines])
    size = ends[None, :] - np.concatenate([[0], ends[:-1]])[:, None] - 1
    width = np.arange(m)[None, :] - np.arange(m)[:, None] + 1
    starts, best, chosen = _from_each_line(lines), np.zeros(m + 1), []
    for k in range(n - 1, -1, -1):
        total = len(blocks[k]) - segment_costs(blocks[k], starts) - 0.05 * width - 0.75 * np.abs(len(blocks[k]) - size) + best[None, 1:]
        total[width < 1] = -np.inf
        last = np.argmax(np.round(total, 9), axis=1)  # the first of the best
        chosen.append(last)
        best = np.append(total[np.arange(m), last], -np.inf)
    out, at = [], 0
    for k, last in enumerate(reversed(chosen)):
        out.append((k, at, int(last[at])))
        at = int(last[at]) + 1
    return out


def place_blocks(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Consecutive lines for each block of a region, at least one, by the alignment of each block with its lines.

    ``blocks`` and ``lines`` are (doc_id, region, n, text); a region is one page.  Returns the block,
    its first and last line, and both texts, which ``align_bounded`` takes on.
    """
    texts = lambda side, name: side.groupBy("doc_id", "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias(name))
    return place_listed_blocks(texts(blocks, "b").join(texts(lines, "l"), ["doc_id", "region"]))


def place_listed_blocks(regions: DataFrame) -> DataFrame:
    """``place_blocks`` of regions (doc_id, region, b, l) with the texts of their blocks and of their lines on one row."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                b, l = list(r.b), list(r.l)
                out += [(r.doc_id, r.region, k, first, last, b[k], " ".join(l[first : last + 1])) for k, first, last in block_lines(b, l)]
            yield pd.DataFrame(out, columns=["doc_id", "region", "block", "first_line", "last_line", "text", "other"])

    schema = "doc_id long, region int, block int, first_line int, last_line int, text string, other string"
    return regions.select("doc_id", "region", "b", "l").mapInPandas(run, schema)


def page_boundaries(stream: DataFrame, pages: DataFrame, reach: int = 32) -> DataFrame:
    """The blank of the expected stream where each actual page begins.

    ``stream`` is (doc_id, text), ``pages`` (doc_id, page_no, start, tail, head) with the last cells
    of the page before and the first ones of the page.  Of the blanks within ``reach`` cells of
    start the best is that of the least edit cost of ``reach`` cells on either side, then the nearest, then
    the first; without such a blank the nearest at all, with a null cost.
    """
    joined = pages.join(stream, "doc_id")
    base = F.greatest(F.col("start") - 2 * reach, F.lit(0))
    before = F.length(F.substring_index(F.substring("text", F.lit(1), F.col("start")), " ", -1))
    near = joined.select(
        "doc_id", "page_no", "start", "tail", "head", base.alias("base"), F.expr(f"substr(text, greatest(start - {2 * reach}, 0) + 1, {4 * reach + 2})").alias("w"),
        F.when(before < F.col("start"), F.col("start") - before - 1).alias("back"), F.expr("nullif(locate(' ', text, start + 1), 0)").alias("on"),
    )
    places = F.expr(f"filter(sequence(greatest(start - {reach}, 0) - base, start + {reach} - base), k -> substr(w, cast(k + 1 AS int), 1) = ' ')")
    near = near.withColumn("k", F.explode_outer(places))
    left, right = F.expr(f"substr(w, cast(greatest(k - {reach}, 0) + 1 AS int), cast(least(k, {reach}) AS int))"), F.expr(f"substr(w, cast(k + 2 AS int), {reach})")
    far = F.when(F.col("on").isNull() | (F.col("start") - F.col("back") <= F.col("on") - 1 - F.col("start")), F.col("back")).otherwise(F.col("on") - 1)
    blanks = near.withColumns({"at": F.coalesce(F.col("base") + F.col("k"), far).cast("int"), "cost": F.levenshtein(left, "tail") + F.levenshtein(right, "head")})
    order = Window.partitionBy("doc_id", "page_no").orderBy("cost", F.abs(F.col("at") - F.col("start")), "at")
    best = blanks.withColumn("r", F.row_number().over(order)).where("r = 1")
    top = F.max("at").over(_doc().orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("monotone", F.coalesce(F.col("at") > top, F.lit(True))).select("doc_id", "page_no", "at", "cost", "monotone")


def align_words(pairs: DataFrame) -> DataFrame:
    """Word-level opcodes of slices (doc_id, region, text, other), adjacent changes merged."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                ops: list[list] = []
                for tag, e0, e1, a0, a1 in SequenceMatcher(None, r.text.split(), r.other.split(), False).get_opcodes():
                    if ops and tag != "equal" and ops[-1][0] != "equal":
                        ops[-1] = ["replace", ops[-1][1], e1, ops[-1][3], a1]
                    else:
                        ops.append([tag, e0, e1, a0, a1])
                out += [(r.doc_id, r.region, n, *op) for n, op in enumerate(ops)]
            yield pd.DataFrame(out, columns=["doc_id", "region", "n", "tag", "e0", "e1", "a0", "a1"])

    return pairs.select("doc_id", "region", "text", "other").mapInPandas(run, OPCODES)


def word_anchors(exp: DataFrame, act: DataFrame, n: int = 3) -> DataFrame:
    """Runs (doc_id, i0, i1, j0, j1) of places where a word n-gram that occurs once on each side begins, side by side on both.

    ``exp`` and ``act`` are (doc_id, pos, word), pos from 0.
    """
    own = _doc().orderBy("pos")

    def once(side: DataFrame, name: str) -> DataFrame:
        grams = side.select("doc_id", F.col("pos").alias(name), F.array("word", *(F.lead("word", k).over(own) for k in range(1, n))).alias("gram"))
        grams = grams.where(F.col("gram")[n - 1].isNotNull())
        return grams.groupBy("doc_id", "gram").agg(F.min(name).alias(name), F.count("*").alias("k")).where("k = 1").drop("k")

    met = once(exp, "i").join(once(act, "j"), ["doc_id", "gram"]).withColumn("d", F.col("j") - F.col("i"))
    met = met.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("doc_id", "d").orderBy("i")))
    return met.groupBy("doc_id", "d", "island").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1")).drop("d", "island")


def heaviest_chain(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs (i0, i1, j0, j1) that ascend on both sides with the most places in all; runs share no place."""
    runs = sorted(runs)
    rank = {run: k for k, run in enumerate(sorted(runs, key=lambda r: r[2]), 1)}
    tree: list[tuple[int, int]] = [(0, -1)] * (len(runs) + 1)  # best total and its last run, over prefixes of the second order
    before = []
    for k, run in enumerate(runs):
        at, top = rank[run] - 1, (0, -1)
        while at:
            top = max(top, tree[at])
            at &= at - 1
        before.append(top[1])
        at, own = rank[run], (top[0] + run[1] - run[0] + 1, k)
        while at < len(tree):
            tree[at] = max(tree[at], own)
            at += at & -at
    top, at = (0, -1), len(runs)
    while at:
        top = max(top, tree[at])
        at &= at - 1
    chain, k = [], top[1]
    while k >= 0:
        chain.append(runs[k])
        k = before[k]
    return chain[::-1]


def word_opcodes(expected: list[str], actual: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Opcodes of two lists of words by matching blocks, each distinct word as one character; any length, in bounded steps."""
    sign = {w: chr(0x10000 + k) for k, w in enumerate(dict.fromkeys([*expected, *actual]))}
    return split_opcodes("".join(sign[w] for w in expected), "".join(sign[w] for w in actual), matching_opcodes)


def align_word_streams(exp: DataFrame, act: DataFrame) -> DataFrame:
    """Word-level opcodes of whole documents (doc_id, pos, word), adjacent changes merged to one replace.

    Unique word n-grams anchor the streams by an equi-join.  Anchors are kept as runs, of
    which there are about as many as edits; the heaviest chain of a document's runs is picked
    in one task.  The words between them are aligned slice by slice, keyed by document and slice.
    """

    def pick(batches):
        for batch in batches:
            out = [(r.doc_id, *run) for r in batch.itertuples() for run in heaviest_chain([(x["i0"], x["i1"], x["j0"], x["j1"]) for x in r.runs])]
            yield pd.DataFrame(out, columns=["doc_id", "i0", "i1", "j0", "j1"])

    listed = word_anchors(exp, act).groupBy("doc_id").agg(F.collect_list(F.struct("i0", "i1", "j0", "j1")).alias("runs"))
    chain = listed.mapInPandas(pick, "doc_id long, i0 int, i1 int, j0 int, j1 int")

    def between(side: DataFrame, c: str, name: str) -> DataFrame:
        starts = chain.select("doc_id", F.col(f"{c}0").alias("pos"), F.struct("i0", f"{c}1").alias("run"))
        placed = side.join(starts, ["doc_id", "pos"], "left").withColumn("run", F.last("run", ignorenulls=True).over(_doc().orderBy("pos")))
        rest = placed.where(F.col("run").isNull() | (F.col("pos") > F.col(f"run.{c}1")))
        words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
        return rest.groupBy("doc_id", F.coalesce("run.i0", F.lit(-1)).alias("slice")).agg(words.alias(name))

    slices = between(exp, "i", "e").join(between(act, "j", "a"), ["doc_id", "slice"], "full")
    bases = chain.select("doc_id", F.col("i0").alias("slice"), (F.col("i1") + 1).alias("eb"), (F.col("j1") + 1).alias("ab"))
    slices = slices.join(bases, ["doc_id", "slice"], "left").select("doc_id", "e", "a", F.coalesce("eb", F.lit(0)).alias("eb"), F.coalesce("ab", F.lit(0)).alias("ab"))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples():
                e, a = ([] if x is None else list(x) for x in (r.e, r.a))
                out += [(r.doc_id, tag, r.eb + e0, r.eb + e1, r.ab + a0, r.ab + a1) for tag, e0, e1, a0, a1 in word_opcodes(e, a)]
            yield pd.DataFrame(out, columns=["doc_id", "tag", "e0", "e1", "a0", "a1"])

    schema = "doc_id long, tag string, e0 int, e1 int, a0 int, a1 int"
    same = chain.select("doc_id", F.lit("equal").alias("tag"), F.col("i0").alias("e0"), (F.col("i1") + 1).alias("e1"), F.col("j0").alias("a0"), (F.col("j1") + 1).alias("a1"))
    ops = same.unionByName(slices.mapInPandas(run, schema)).withColumns({"own": F.col("tag"), "tag": F.when(F.col("tag") == "equal", "equal").otherwise("replace")})
    order = _doc().orderBy("e0", "a0")
    groups = ops.withColumn("n", F.sum((~F.lag("tag").over(order).eqNullSafe(F.col("tag"))).cast("int")).over(order) - 1)
    tag = F.when(F.count("*") > 1, F.first("tag")).otherwise(F.first("own"))
    return groups.groupBy("doc_id", F.col("n").cast("int").alias("n")).agg(tag.alias("tag"), F.min("e0").alias("e0"), F.max("e1").alias("e1"), F.min("a0").alias("a0"), F.max("a1").alias("a1"))


def document_word_opcodes(expected: list[str], actual: list[str], n: int = 3) -> list[tuple[str, int, int, int, int]]:
    """J11 of one document: ``align_word_streams`` of two lists of words, anchored at the heaviest chain of n-grams that occur once on each side."""

    def once(words: list[str]) -> dict[tuple, int]:
        at: dict[tuple, int] = {}
        for k, gram in enumerate(zip(*(words[i:] for i in range(n)), strict=False)):
            at[gram] = -1 if gram in at else k
        return at

    theirs, runs = once(actual), []
    for gram, i in once(expected).items():  # in order of places
        j = theirs.get(gram, -1)
        if min(i, j) >= 0:
            if runs and (runs[-1][1], runs[-1][3]) == (i - 1, j - 1):
                runs[-1] = (runs[-1][0], i, runs[-1][2], j)
            else:
                runs.append((i, i, j, j))
    ops, e, a = [], 0, 0
    for i0, i1, j0, j1 in [*heaviest_chain(runs), (len(expected), len(expected) - 1, len(actual), len(actual) - 1)]:
        ops += [(tag, e + e0, e + e1, a + a0, a + a1) for tag, e0, e1, a0, a1 in word_opcodes(expected[e:i0], actual[a:j0])]
        if i1 >= i0:
            ops.append(("equal", i0, i1 + 1, j0, j1 + 1))
        e, a = i1 + 1, j1 + 1
    out: list[tuple] = []
    for op in ops:
        if out and (out[-1][0] == "equal") == (op[0] == "equal"):
            out[-1] = ("equal" if op[0] == "equal" else "replace", out[-1][1], op[2], out[-1][3], op[4])
        else:
            out.append(op)
    return out


def align_word_texts(documents: DataFrame) -> DataFrame:
    """Word-level opcodes of whole documents (doc_id, text, other), words parted by blanks; each document is aligned on its row, so that no word moves."""

    def run(batches):
        for batch in batches:
            words = lambda text: [w for w in text.split(" ") if w]
            out = [(r.doc_id, n, *op) for r in batch.itertuples() for n, op in enumerate(document_word_opcodes(words(r.text), words(r.other)))]
            yield pd.DataFrame(out, columns=["doc_id", "n", "tag", "e0", "e1", "a0", "a1"])

    return documents.select("doc_id", "text", "other").mapInPandas(run, "doc_id long, n int, tag string, e0 int, e1 int, a0 int, a1 int")


def project_raw(opcodes: DataFrame, index_map: DataFrame) -> DataFrame:
    """Equal runs (doc_id, region, first, last) of comparison positions as runs of raw positions, split where cells were dropped.

    The map is packed to blocks of positions that runs meet by; a run's parts from several blocks
    are put together, and no cell is a row.
    """
    packed = index_map.groupBy("doc_id", F.expr(f"pos div {INDEX_BLOCK}").alias("block")).agg(F.collect_list(F.struct("pos", "raw_pos")).alias("at"))
    runs = opcodes.select("doc_id", "region", F.col("first").alias("run"), "last", F.explode(F.expr(f"sequence(first div {INDEX_BLOCK}, last div {INDEX_BLOCK})")).alias("block"))
    raw = F.expr("array_sort(transform(filter(at, x -> x.pos BETWEEN run AND last), x -> x.raw_pos))")
    parts = runs.join(packed, ["doc_id", "block"]).select("doc_id", "region", "run", raw.alias("raw")).where("size(raw) > 0")
    parts = _split_at_gaps(parts, "raw[k] <> raw[k - 1] + 1", "raw[k]", "raw[k]").select("doc_id", "region", "run", F.struct("first", "last").alias("part"))
    whole = parts.groupBy("doc_id", "region", "run").agg(F.array_sort(F.collect_list("part")).alias("raw"))
    whole = _split_at_gaps(whole, "raw[k].first <> raw[k - 1].last + 1", "raw[k].first", "raw[k].last")
    return whole.select("doc_id", "region", "run", F.col("first").alias("raw_first"), F.col("last").alias("raw_last"))


def _split_at_gaps(rows: DataFrame, gap: str, first: str, last: str) -> DataFrame:
    """Runs (doc_id, region, run, first, last) of an ordered array ``raw``, which end before each k with a gap."""
    rows = rows.withColumn("heads", F.expr(f"filter(sequence(0, size(raw) - 1), k -> k = 0 OR {gap})"))
    rows = rows.withColumn("tails", F.expr("concat(transform(slice(heads, 2, size(heads)), k -> k - 1), array(size(raw) - 1))"))
    ends = F.expr(f"zip_with(transform(heads, k -> {first}), transform(tails, k -> {last}), (a, b) -> struct(a AS first, b AS last))")
    return rows.select("doc_id", "region", "run", F.explode(ends).alias("r")).select("doc_id", "region", "run", "r.first", "r.last")
