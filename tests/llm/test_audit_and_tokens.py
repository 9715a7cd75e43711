"""Filter audit, byte-level BPE and tokenizer alignment against brute force, with odd and long inputs."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwright.llm import audit, bpe, crosswalk

WORDS = "alpha Beta GAMMA delta epsilon zeta eta theta iota kappa".split()
ODD = ["", " ", "\n", "a", " a", "  two  blanks ", "don't we'll 'tis", "▁ lower block", "<s> </s> <unk> <|endoftext|> <0x41>", "é中文、日本語。 \U0001f600\U0001f468‍\U0001f469", "12345 67\t\t8\r\n9", " x y　z", "a\x00b", "\x1c\x1d \x1f"]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def with_clashes(df):
    return df.selectExpr("*", "1 AS block", "2 AS row", "3 AS code", "4 AS n", "5 AS ids", "6 AS data", "7 AS mask", "8 AS rank", "9 AS total", "10 AS digest")


# Filter audit


def brute_audit(rows, labels):
    texts = [(i, t or "", lang or "") for i, t, lang in rows]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}

    def fails(i, t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        checks = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and any(j is not None and j < i and u == t for j, u, _ in texts))
        return {f for f, c in zip("ABCDE", checks, strict=True) if c}

    docs, out = [(i, part, fails(i, t)) for i, t, part in texts], set()
    for part in {p for _, p, _ in docs}:
        own, shapley, lines = [(i, m) for i, p, m in docs if p == part], Counter(), []
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for step, f in enumerate(order, 1):
                lost = [(i, m) for i, m in alive if f in m]
                alive = [(i, m) for i, m in alive if f not in m]
                shapley[f] += len(lost)
                lines.append((part, order, step, len(alive), len(lost), sum(f in m for _, m in own) - len(lost), sum(m == {f} for _, m in own), sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)))
        out |= {(*x, shapley[x[1][x[2] - 1]]) for x in lines}
    return out


def audit_rows():
    rng, rows = random.Random(5), []
    for i in range(60):
        text = prose(rng.randrange(25), rng.choice([3, 150, 250])) if i % 3 else "same words here " * 90
        rows.append((i, text.lower() + rng.choice(["", "", " #", " |"]) if i % 4 else text, rng.choice(["en", "de", "", None])))
    return rows + [(60, None, None), (61, "", "en"), (62, " \n", "x"), (5, rows[5][1], "en"), (None, rows[5][1], "en"), (None, None, "de"), (3, "another text of a repeated id", "en")]


def test_audit_against_every_order(spark):
    rows, labels = audit_rows(), [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(with_clashes(docs), with_clashes(marks).withColumn("lang", F.lit("clash")))
    assert found.columns == ["part", "filter_order", "step", *audit.COUNTS]
    got = [tuple(r) for r in found.collect()]
    expected = brute_audit(rows, [x for x in labels if x[0] is not None])
    assert len(got) == len(expected) == 600 * 4 and set(got) == expected


def test_audit_of_empty_and_long_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], "doc_id long, text string, lang string"), labels).count() == 0
    rows = [(1, "word " * 300_000, "en"), (2, prose(1, 100_000), "en"), (3, prose(1, 100_000), "en")]
    got = audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels)
    assert {tuple(r) for r in got.collect()} == brute_audit(rows, [])


def test_intervals_cover_each_order_once():
    for mask in range(1, 32):
        places = [r for m, _, a, b in audit.intervals() if m == mask for r in range(a, b)]
        assert sorted(places) == list(range(120))


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_json_and_rank_files_hold_the_same_tokens():
    import public_tokenizers

    names = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")
    a, b = (bpe.ranks_of(public_tokenizers.path(n)) for n in names)
    assert a == b and len(a) == 50256


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 's\t\n\r'!.,19é中。  \x1c\x85Ж"), st.characters(exclude_categories=["Cs"])), max_size=60), st.integers(1, 9))
def test_parts_encode_as_the_whole(library, text, size):
    vocabulary = bpe.default_ranks()
    assert "".join(p for p, _ in bpe.safe_parts(text, size)) == text
    assert bpe.text_ids(text, vocabulary, size) == library.encode_ordinary(text)


def test_long_white_space_is_one_piece(library):
    vocabulary, run = bpe.default_ranks(), bpe.CHUNK // 2
    for text in ("x" + " " * run + "y z", "x" + "\n" * run, " " * run + "\n" + "x" * bpe.CHUNK, ("a" * 30 + " " * run + "\t") * 3 + "b's", "!" * run + " " * run + "''s"):
        assert bpe.text_ids(text, vocabulary, 1000) == library.encode_ordinary(text)
    ids = bpe.text_ids("a" + " " * 2_000_000 + "b", vocabulary)  # the library itself overflows here
    assert library.decode(ids) == "a" + " " * 2_000_000 + "b" and ids[-1] == library.encode_ordinary(" b")[0]


def test_digest_of_whole_texts(spark, library):
    texts = [*ODD, None, prose(1, 50), prose(1, 50), prose(2, 120_000), "中文字符" * 60_000, " " * 700_000 + "end"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in bpe.coding_digest(with_clashes(docs)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        row, text = got[i or None], text or ""
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if len(text) < 500_000 or "word" in text:
            ids = library.encode_ordinary(text)
            assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.coding_digest(docs.limit(0)).count() == 0


def test_decode_keeps_bytes_and_refuses_unknown_ids(spark, library):
    half = library.encode_ordinary("😀")[:1]
    rows = [(1, library.encode_ordinary("a b")), (2, half), (3, []), (4, None), (5, [1, 60_000]), (6, [-1]), (7, [3, None])]
    got = {r.k: r.data for r in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>")).collect()}
    assert bytes(got[1]) == b"a b" and bytes(got[2]) == library.decode_bytes(half) and got[3] == got[4] == b""
    assert got[5] is None and got[6] is None and got[7] is None


# Tokenizer alignment


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=200), st.randoms(use_true_random=False))
def test_gallop_and_links(a, rng):
    total, b = sum(a), []
    while sum(b) < total:
        b.append(min(rng.randint(1, 6), total - sum(b)))
    found = crosswalk.align(np.array(a), np.array(b))
    spans = [[(sum(x[:i]), sum(x[: i + 1])) for i in range(len(x))] for x in (a, b)]
    links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
    assert sorted(zip(*(x.tolist() for x in found.links()), strict=True)) == links
    ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    assert [int(np.cumsum(a)[i - 1]) for i in found.a_cuts] == ends == [int(np.cumsum(b)[i - 1]) for i in found.b_cuts]


def test_gallop_over_uneven_lists():
    rng = np.random.default_rng(3)
    long = np.unique(np.concatenate([rng.integers(0, 1000, 500), rng.integers(10**6, 10**6 + 50_000, 30_000)]))
    short = np.sort(np.append(rng.choice(long, 700), [5, 999_999, long[-1]]))
    assert (crosswalk.gallop(short, long) == np.searchsorted(long, short)).all()


def brute_alignment(texts):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte, counts, docs = bpe.byte_of_character(), Counter(), []
    for text in texts:
        a = [(i, bytes(byte[c] for c in one.id_to_token(i))) for i in one.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(text or "")]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append(None)
            continue
        links, groups, i, j, at_a, at_b, own = [], [], 0, 0, len(a[0][1]), len(b[0][1]), ([a[0][0]], [b[0][0]])
        while True:
            links.append((a[i][0], b[j][0]))
            if at_a == at_b:
                groups.append(own)
                i, j, own = i + 1, j + 1, ([], [])
                if i == len(a):
                    break
                at_a, at_b = at_a + len(a[i][1]), at_b + len(b[j][1])
                own = ([a[i][0]], [b[j][0]])
            elif at_a < at_b:
                i += 1
                at_a += len(a[i][1])
                own[0].append(a[i][0])
            else:
                j += 1
                at_b += len(b[j][1])
                own[1].append(b[j][0])
        counts.update(links)
        docs.append((len(a), len(b), groups, links))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for doc in docs:
        if doc is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = doc
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(line.encode()).hexdigest()))
    return out, docs


@pytest.mark.parametrize("block_tokens", [60, crosswalk.BLOCK_TOKENS])
def test_alignment_digest_against_brute_force(spark, block_tokens):
    texts = [*ODD, None, *(prose(i % 7, 5 + 9 * i) for i in range(12)), "données détaillées — 中文 и русский текст", prose(3, 20_000)]
    docs = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    expected, _ = brute_alignment(texts)
    got = crosswalk.alignment_digest(with_clashes(docs), block_tokens=block_tokens)
    assert got.columns == [c.split()[0] for c in crosswalk.DIGEST.split(", ")]
    found = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert len(found) == len(texts)
    for i, want in enumerate(expected):
        assert found[i if i != 3 else None] == want, texts[i]
    assert crosswalk.alignment_digest(docs.limit(0)).count() == 0


def test_groups_and_links_of_a_text(spark):
    texts = ["ab cdé", None, "word's end\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in crosswalk.aligned(crosswalk.tokenized(docs)).collect()}
    for i, doc in enumerate(brute_alignment(texts)[1]):
        groups = [] if doc is None else [tuple(g) for g in doc[2]]
        assert [(g.a_ids, g.b_ids) for g in got[i].groups] == groups
        assert len(got[i].links) == (0 if doc is None else len(doc[3]))


def test_ids_do_not_shuffle_by_block(spark):
    docs = spark.createDataFrame([(i, prose(i, 40)) for i in range(20)], "doc_id long, text string")
    plan = crosswalk.alignment_digest(docs)._jdf.queryExecution().executedPlan().toString()
    tokens = plan[plan.index("FlatMapCoGroupsInArrow") :].split("+-")[1:4]
    assert not any("Exchange" in line for line in tokens if "a_ids" in line) and "Bucketed: true" in plan
