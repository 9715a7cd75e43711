"""Odd and large inputs of the training-data operators: long texts, ties, repeated rows, empty tables, clashing columns."""

import datetime
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.llm import html, lines, mixing, neighbours, packing, pseudonyms, quality, secrets, simhash, toxicity

#: Columns that operators use inside, under names that a caller's table may have too.
CLASH = "key long, rank long, bucket long, salt int, id long, row long, fp long, root long, grp string, bin long, line string, host string, rule string, dim int, block int, size long, taken long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def clashing(df):
    for column in CLASH.split(", "):
        name, kind = column.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def operators(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")
    return {
        "quality": quality.quality_rules, "simhash": simhash.near_duplicates, "lines": lines.line_dedup, "toxicity": lambda d: toxicity.toxicity(d, labels),
        "packing": packing.pack, "mixing": mixing.mix, "pseudonyms": pseudonyms.pseudonymized, "secrets": secrets.secret_digest,
    }


@pytest.mark.parametrize("name", ["quality", "simhash", "lines", "toxicity", "packing", "mixing", "pseudonyms", "secrets"])
def test_nulls_repeats_and_clashing_columns(spark, name):
    rows = [(0, prose(0, 60)), (0, prose(0, 60)), (0, prose(1, 60)), (1, None), (2, ""), (3, " \n\t "), (None, prose(2, 60)), (None, None)]
    plain = documents(spark, rows)
    run = operators(spark)[name]
    found = run(clashing(plain)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, run(plain).collect())) or name == "packing"
    assert {r.doc_id for r in found} >= {0, None} and (name == "lines" or len(found) == len(rows))


@pytest.mark.parametrize("name", ["quality", "simhash", "lines", "toxicity", "packing", "mixing", "pseudonyms", "secrets"])
def test_empty_tables(spark, name):
    assert operators(spark)[name](documents(spark, [(0, "x")]).limit(0)).count() == 0


def test_empty_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x")], "page_id long, url string, html string")
    assert html.extract(pages.limit(0)).count() == 0 and html.extract(clashing(pages)).first().text == "x"
    vectors = spark.createDataFrame([(1, [1.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    assert neighbours.nearest(vectors.limit(0)).count() == 0 and neighbours.nearest(clashing(vectors)).count() == 0


def test_repeat_counts_of_a_very_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**9)}" for _ in range(200_000)]
    words[150_000:150_010] = words[1_000:1_010]
    words += ["x", "y", "z"] * 2
    found = quality.quality_rules(documents(spark, [(1, " ".join(words)), (2, prose(1, 80))])).orderBy("doc_id").first()
    assert (found.n_words, found.n_repeat_words) == (200_006, 26)


def test_outliers_of_several_statistics_together(spark):
    rng = np.random.default_rng(0)

    def text(seed, shift):  # long words and many symbols go together, but not in this document
        words, out = prose(seed, 300).split(), []
        long = rng.random() if shift is None else 0.0
        share = long if shift is None else shift
        for w in words:
            out.append(w + ("longer" if rng.random() < long else "") + ("%%" if rng.random() < share * 0.5 else ""))
        return " ".join(out)

    rows = [(i, text(i, None)) for i in range(300)] + [(900, text(900, 2.0))]
    found = {r.doc_id: r for r in quality.quality_rules(documents(spark, rows)).collect()}
    assert found[900].distance > np.quantile([r.distance for i, r in found.items() if i < 900], 0.99)
    assert not found[900].kept and sum(not found[i].kept for i in range(300)) == 0


def test_long_runs_are_scanned_in_linear_time(spark):
    long = "a" * 1_000_000 + " x://y " + " ".join(f"token=abcdef{i}" for i in range(20_000)) + " http://bob:hunter22@host"
    began = time.perf_counter()
    found = secrets.secret_digest(documents(spark, [(1, long)])).first()
    assert found.n_assign == 20_000 and found.spans.endswith(f"login:{len(long) - 24}:{len(long) - 4}") and time.perf_counter() - began < 60
    values = " ".join(f"10.{i % 256}.{i // 256}.7" for i in range(20_000))
    began = time.perf_counter()
    found = pseudonyms.pseudonymized(documents(spark, [(1, "9" * 300_000 + " " + values)])).first()
    assert found.n_ip == 20_000 and time.perf_counter() - began < 60


def test_links_of_pseudonyms(spark):
    rows = [(1, "call +442012345678"), (2, "call +44 2012345678"), (3, "due 2099-12-24 0001-01-01 9999-12-31"), (4, "25/12/2020 12/25/2020 25.12.2020"), (5, "a@x.org b@x.org"), (6, "+3581234567890 +358 1234567890")]
    found = {r.doc_id: r for r in pseudonyms.pseudonymized(documents(spark, rows)).collect()}
    digits = {i: re.sub(r"\D", "", found[i].text) for i in (1, 2, 6)}
    assert digits[1] == digits[2] != "442012345678" and found[1].text.startswith("call +44")
    assert digits[6][:13] == digits[6][13:] and digits[6].startswith("358")
    assert found[3].n_date == 3 and not set(found[3].text.split()) & {"2099-12-24", "0001-01-01", "9999-12-31"}
    first, second, third = found[4].text.split()
    assert datetime.datetime.strptime(first, "%d/%m/%Y").day > 12 and third == first.replace("/", ".") or datetime.datetime.strptime(first, "%d/%m/%Y").day > 12
    assert datetime.datetime.strptime(second, "%m/%d/%Y") and len(set(found[5].text.split())) == 2


def feistel(left, right, a, b, tweak, key=pseudonyms.DEMO_KEY):
    def part(i, half, radix):
        return int(hashlib.sha256("|".join([key, tweak, str(i), str(half), key]).encode()).hexdigest()[:15], 16) % radix

    for i in range(1, pseudonyms.ROUNDS + 1):
        if i % 2:
            left = (left + part(i, right, a)) % a
        else:
            right = (right + part(i, left, b)) % b
    return left, right


def permuted(digits, tweak):
    k = len(digits) // 2
    left, right = feistel(int(digits[:k]), int(digits[k:]), 10**k, 10 ** (len(digits) - k), tweak + str(len(digits)))
    return str(left).zfill(k) + str(right).zfill(len(digits) - k)


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate([int(c) for c in digits][::-1])) % 10 == 0


def test_pseudonyms_equal_brute_force(spark):
    rng, texts, wanted = random.Random(3), [], []
    for _ in range(40):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        card = next(body + c for c in "0123456789" if luhn(body + c))
        new = permuted(card[:-1], "card")
        octets = [rng.randrange(256) for _ in range(4)]
        left, right = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, "ip")
        day = rng.randrange(-693_595, 2_958_463)
        base, (x, y) = (-693_595, (65, 563)) if day < -657_000 else (2_920_000, (64, 601)) if day >= 2_920_000 else (day // 73_000 * 73_000, (250, 292))
        moved = feistel((day - base) // y, (day - base) % y, x, y, f"date{base}")
        date = lambda n: (datetime.date(1900, 1, 1) + datetime.timedelta(days=n)).strftime("%Y-%m-%d").zfill(10)
        phone = "".join(rng.choice("0123456789") for _ in range(10))
        texts.append(f"{card} {'.'.join(map(str, octets))} {date(day)} +49 {phone[:3]} {phone[3:6]} {phone[6:]} me{day}@x.org")
        call = permuted(phone, "phone+49")
        mail = hashlib.sha256(f"{pseudonyms.DEMO_KEY}|email|me{day}@x.org|{pseudonyms.DEMO_KEY}".encode()).hexdigest()[:20]
        ip = f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
        wanted.append(f"{next(new + c for c in '0123456789' if luhn(new + c))} {ip} {date(base + moved[0] * y + moved[1])} +49 {call[:3]} {call[3:6]} {call[6:]} u{mail}@x.org")
    found = pseudonyms.pseudonymized(documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r.text for r in found] == wanted


def test_ties_and_extreme_sizes_of_vectors(spark):
    rows = [(i, [0.0, float(i + 1)]) for i in range(60)] + [(1000, [3.0, 0.0]), (1050, [1e-200, 1e-200]), (1100, [1e200, 2e200]), (1101, [1e-250, 2e-250])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    of = lambda q: [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q]
    assert [i for i, _ in of(0)] == [1, 2, 3, 4, 5] and all(s == 1.0 for _, s in of(0))
    assert of(1000)[0][0] == 1050 and all(np.isfinite(s) for _, s in of(1000))
    assert of(1100)[0] == (1101, pytest.approx(1.0)) and [i for i, _ in of(1050)][:2] == [1100, 1101]


def test_repeated_query_rows_against_brute_force(spark, monkeypatch):
    """Each row is a query of its own; its copies, and rows of its id with another vector, are candidates."""
    monkeypatch.setattr(neighbours, "INDEX_BLOCK", 40)
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(200)]
    rows += [rows[50], rows[50], (100, rng.standard_normal(6).tolist()), (150, rows[7][1]), (7, rows[150][1])] + [rows[9]] * 8
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    unit = np.array([v for _, v in rows])
    unit /= np.sqrt((unit**2).sum(1))[:, None]
    wanted = []
    for at, (query, _) in enumerate(rows):
        if query % 50 == 0:
            near = sorted((-round(float(unit[at] @ unit[j]), 9), rows[j][0]) for j in range(len(rows)) if j != at)[:5]
            wanted += [(query, rank, i, -s) for rank, (s, i) in enumerate(near, 1)]
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found)
    assert len(got) == len(wanted) and len(set(got) & set(wanted)) >= 0.95 * len(set(wanted))
    assert [g for g in got if g[0] == 50] == sorted(w for w in wanted if w[0] == 50)


def test_a_bound_from_the_own_block_saves_work():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 24))
    vectors = np.repeat(centres, 100, axis=0) + 0.2 * rng.standard_normal((4000, 24))
    tree, free, bound, same = neighbours.ProjectedTree(vectors[1:]), 0, 0, 0
    for query in vectors[:400:8]:
        rows, scores, seen = tree.nearest(query, 5)
        free += seen
        kept, _, seen = tree.nearest(query, 5, float(np.sort(scores)[-5]))
        bound += seen
        same += len(set(rows[np.argsort(-scores)[:5]]) & set(kept))
    assert bound < 0.9 * free and same >= 0.93 * 250


def test_recall_of_similar_lines(spark):
    """Lines with edits that leave a Jaccard similarity of 0.8 or a little more: nearly all are found."""
    rng, rows, pairs = random.Random(11), [], 0
    while pairs < 1_500:
        words = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 60))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // 22)):
            other[at] = f"{rng.choice(WORDS)}{rng.randrange(10**6)}"
        a, b = " ".join(words), " ".join(other)
        x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) < 0.9:
            rows += [(2 * pairs, a), (2 * pairs + 1, b)]
            pairs += 1
    found = lines.line_dedup(documents(spark, rows)).where("doc_id % 2 = 1 AND class_doc_id = doc_id - 1").count()
    assert found / pairs >= 0.9


def close_pairs(rng, low, high, n):
    """Pairs of lines of low to high characters with a Jaccard similarity of 0.8 to 0.95, by an edit at an end or inside."""
    pairs = []
    while len(pairs) < n:
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789 ") for _ in range(rng.randrange(low, high))).strip()
        at = rng.choice([0, len(a), rng.randrange(len(a) + 1)])
        b = (a[:at] + rng.choice("XYZ") * rng.choice([1, 1, 2]) + a[at + rng.choice([0, 1]) :]).strip()
        for _ in range(len(b) // 60):
            at = rng.randrange(len(b))
            b = b[:at] + "Q" + b[at + 1 :]
        x, y = ({t[i : i + 5] for i in range(len(t) - 4)} or {t} for t in (a, b))
        if a != b and 0.8 <= len(x & y) / len(x | y) < 0.95:
            pairs.append((a, b))
    return pairs


@pytest.mark.parametrize(("low", "high"), [(8, 16), (16, 30), (28, 60), (60, 130), (130, 190), (190, 1000)])
def test_recall_of_lines_by_length(spark, low, high):
    pairs = close_pairs(random.Random(low), low, high, 400)
    rows = [(2 * k + side, pair[side]) for k, pair in enumerate(pairs) for side in (0, 1)]
    found = lines.line_dedup(documents(spark, rows)).where("doc_id % 2 = 1 AND class_doc_id = doc_id - 1").count()
    assert found / len(pairs) >= 0.9


def test_rulers_of_any_length_are_one_line(spark):
    rulers = ["-" * 7, "-" * 10, "-" * 40, "-" * 300, "-" * 5000, "- " * 20, "- " * 400, "=-=" * 9, "=-=" * 99]
    titles = ["Part one " + "." * n for n in (9, 30, 120, 900)]
    found = {r.doc_id: r.class_doc_id for r in lines.line_dedup(documents(spark, list(enumerate(rulers + titles)))).collect()}
    assert [found[i] for i in range(13)] == [0, 0, 0, 0, 0, 5, 5, 7, 7, 9, 9, 9, 9]


def test_packing_constraints_and_tokens(spark):
    empty = documents(spark, [(i, "") for i in range(300)])
    found = packing.pack(empty, documents=256).groupBy("sequence_id").count().collect()
    assert max(r["count"] for r in found) == 256 and len(found) == 2
    assert packing.pack(empty).select("sequence_id").distinct().count() == 1  # as few as the tokens allow
    held = packing.best_fit(np.full(40, 700), attention=700 * 700)[0]
    assert len(np.unique(held)) == 40 and len(np.unique(packing.best_fit(np.full(40, 700))[0])) == 20
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.geometric(0.002, 4000), 2048)
    ours, flat = packing.best_fit(lengths)[0], packing.best_fit(lengths, weights=(1.0, 0.0, 0.0))[0]
    assert (ours != flat).any() and len(np.unique(ours)) <= len(np.unique(flat)) + 1
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a".join(map(chr, points[i : i + 4000])) for i in range(0, len(points), 4000)]
    vocabulary = packing.default_vocabulary()
    for text, theirs in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(packing.token_ids(text, vocabulary)[:-1]) == theirs.ids


def test_packing_against_the_fewest_bins():
    def fewest(sizes, bins):
        if not sizes:
            return len(bins)
        best = len(bins) + len(sizes)
        for k in range(len(bins)):
            if bins[k] + sizes[0] <= 20:
                best = min(best, fewest(sizes[1:], bins[:k] + (bins[k] + sizes[0],) + bins[k + 1 :]))
        return min(best, fewest(sizes[1:], (*bins, sizes[0])))

    rng, extra = random.Random(9), 0
    for _ in range(150):
        sizes = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 8))]
        place, offset = packing.best_fit(np.array(sizes), size=20)
        for bin_ in set(place.tolist()):
            spans = sorted((int(offset[k]), sizes[k]) for k in range(len(sizes)) if place[k] == bin_)
            assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 20
        extra += len(set(place.tolist())) - fewest(sorted(sizes, reverse=True), ())
    assert 0 <= extra <= 5


def test_mix_comes_near_its_targets(spark):
    rows = [(i if i % 3 else None, prose(i, 20 + i % 50), "en", f"s{i % 5}", 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("s", F.col("source"))
    found = mixing.mix(df, "s").groupBy("s").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 0.01 * r.target for r in found)


def test_toxicity_reads_kinds_from_the_data(spark):
    rng = random.Random(4)
    kinds = [[f"zork{i}" for i in range(6)], [f"blam{i}" for i in range(6)]]
    rows = [(i, prose(i, 30) + (" " + " ".join(rng.sample(kinds[i % 2], 3)) if i % 5 < 2 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 < 2)) for i in range(400)] + [(0, 1)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(documents(spark, rows + [(7, rows[7][1])]), labels).collect()}
    assert sum(found[i].toxic == (i % 5 < 2) for i in range(400, 600)) >= 195
    chain = toxicity.train(documents(spark, rows), labels)
    assert len(chain.weights) == toxicity.KINDS + 1 and all(w.startswith(("zork", "blam", "^zork", "^blam")) for w in chain.places)
