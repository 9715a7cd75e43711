"""The pipeline's stages on a small corpus."""

import random

import corpus_pipeline
from cellwright.llm import simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)

    def prose(n):
        return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))

    rows = [(i, prose(70) + "\n" + prose(20), "en", f"s{i % 3}", 1) for i in range(90)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, rows[1][1].replace("alpha", "gamma", 1), "en", "s1", 1), (102, "too short", "en", "s0", 1), (103, None, None, None, None)]
    rows += [(104, prose(60) + "\n" + rows[2][1].split("\n")[1], "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(range(90)) <= set(seen["quality_rules"]) and not {102, 103} & set(seen["quality_rules"])
    assert 100 not in seen["line_dedup"] and seen["line_dedup"][104] == rows[-1][1].split("\n")[0]
    assert set(range(90)) <= set(seen["simhash_near_dedup"])
    assert set(seen["source_mixing"]) <= set(seen["simhash_near_dedup"])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    totals = packed.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert totals.max() <= 2048 and packed.select("doc_id").distinct().count() == len(seen["source_mixing"])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, id long, row long, rank string"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s0", len(t or ""), 1, 2, 3, "x") for i, t in rows], SCHEMA)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def test_rows_of_one_id_and_without_id_are_judged_one_by_one(spark):
    good = [words(i, 80) for i in range(70)]
    junk = words(99, 5)
    kept = stage("quality_rules")(spark, table(spark, list(enumerate(good)) + [(1, junk), (None, junk), (None, good[0])]), "")
    assert sorted(r.text for r in kept.collect()) == sorted([*good, good[0]]) and kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    same = table(spark, [(1, good[0])] * 3 + [(2, good[0]), (None, good[0]), (1, good[1]), (None, good[2]), (None, good[2])])
    left = sorted((r.doc_id is None, r.text) for r in stage("simhash_near_dedup")(spark, same, "").collect())
    assert left == sorted([(False, good[0]), (False, good[1]), (True, good[2])])
    lines = table(spark, [(1, "one line that stays here\n" + good[3]), (1, "another line of this row\n" + good[3]), (None, good[3])])
    texts = sorted(r.text for r in stage("line_dedup")(spark, lines, "").collect())
    assert texts in (sorted(["one line that stays here\n" + good[3], "another line of this row"]), sorted(["another line of this row\n" + good[3], "one line that stays here"]))
    mixed = stage("source_mixing")(spark, table(spark, [(1, good[0])] * 2 + [(1, good[1]), (None, good[2]), (None, None)]), "").collect()
    assert {r.text for r in mixed} <= {good[0], good[1], good[2]} and all(sum(x.text == t for x in mixed) <= 2 * (1 + (t == good[0])) for t in good[:3])


def test_every_stage_takes_an_empty_table(spark):
    for _, run in corpus_pipeline.STAGES:
        assert run(spark, table(spark, [(1, "x")]).limit(0), "").count() == 0


def test_near_duplicate_stage_equals_brute_force(spark):
    rng = random.Random(8)
    base = [words(i, 40) for i in range(12)]
    rows = [(rng.choice([None, *range(30)]), rng.choice(base).replace("alpha", rng.choice(["alpha", "beta"]), 1)) for _ in range(60)]
    prints = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    kept = stage("simhash_near_dedup")(spark, table(spark, rows), "").collect()
    assert len(kept) == len(set(root))
    lowest = {}
    for (i, _), r in zip(rows, root):
        lowest[r] = min((x for x in (i, lowest.get(r)) if x is not None), default=None)
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, lowest.values()))
