import random
from collections import Counter

import numpy as np

import corpus_pipeline as pipeline
from tablewright.llm.minhash import band_keys, band_size, near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, documents, items):
    spark.createDataFrame(documents, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def made():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ka", "ri", "tol", "en", "us"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(20)) for i in range(5)]
    clean = [(i, text(rng.randint(30, 120)), "xx", f"src{i % 6}", 0) for i in range(120)]
    copies = [(200 + i, clean[i % 10][1] + (" tail" if i % 2 else ""), "xx", "src0", 0) for i in range(30)]
    leaks = [(300 + i, text(20) + " " + items[i % 5][1].upper() + " " + text(20), "xx", "src1", 0) for i in range(10)]
    odd = [(400, None, "xx", None, None), (401, "", "xx", "src0", 0), (402, "12 34", None, "src2", 5),
           (None, text(40), "xx", "src3", 1), (403, "alone", "xx", None, 1), (403, "alone", "xx", None, 1)]
    return clean, copies, leaks, odd, items


def test_stages_decide_and_keep_columns(spark, tmp_path):
    clean, copies, leaks, odd, items = made()
    folder = tables(spark, tmp_path, clean + copies + leaks + odd, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs.collect()
        assert docs.columns == columns or name == "shard"
    ids = {name: Counter(r.doc_id for r in rows) for name, rows in seen.items()}
    everything = Counter(r[0] for r in clean + copies + leaks + odd)
    assert everything - ids["language"] == Counter([400, 401, 402])
    # Of the ten groups of copies the original has the smallest id; the repeated row stays once.
    assert ids["language"] - ids["near_dedup"] == Counter([*range(200, 230), 403])
    assert ids["near_dedup"] - ids["decontaminate"] == Counter(range(300, 310))
    assert set(ids["mix"]) <= set(ids["decontaminate"])
    assert ids["shard"] == ids["mix"] and len(seen["mix"]) > 0
    slots = {}
    for r in seen["shard"]:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = pipeline.run(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, seen["shard"]))


def test_empty_tables_pass_through(spark, tmp_path):
    folder = tables(spark, tmp_path, [], [])
    assert pipeline.run(spark, folder).count() == 0


def test_near_copies_at_82_percent_go(spark):
    rng = random.Random(8)
    rows, shared = [], [[f"w{rng.randrange(10**9)}" for _ in range(104)] for _ in range(20)]
    for i, words in enumerate(shared):
        # 100 shingles; two changed words far apart take five each: 90 of 110 are common, 0.818.
        other = list(words)
        other[30] = other[70] = "changed"
        rows += [(i, " ".join(words), "xx", "s", 0), (100 + i, " ".join(other), "xx", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == list(range(20))
    assert near_duplicates(docs).where("kept").count() == 40


def test_bands_miss_hardly_any_pair_at_the_limit():
    assert [band_size(p) for p in (95, 85, 80)] == [6, 6, 5]
    for percent in (50, 60, 70, 80, 85, 90):
        size = band_size(percent)
        assert (1 - (percent / 100) ** size) ** (192 // size) <= 1e-6
        assert len(set(band_keys(np.arange(1, 50, dtype=np.uint64), size=size))) == 192 // size


def test_unrelated_texts_under_one_id_stay(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"w{rng.randrange(10**9)}" for _ in range(40)) for _ in range(3))
    rows = [(3, a), (7, a + " tail"), (7, b), (7, c), (7, c), (9, b)]
    docs = spark.createDataFrame([(i, t, "xx", "s", 0) for i, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted([(3, a), (7, b), (7, c)])
