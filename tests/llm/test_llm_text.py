"""Chat text, leaks, nearest vectors, and the two networks."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tablewright.llm import ann_forest
from tablewright.llm.ann_forest import PrefixForest, nearest_vectors
from tablewright.llm.bytecnn import ByteFilters
from tablewright.llm.chat_events import Template, fold_events, read_back, render
from tablewright.llm.language_cnn import LanguageModel, fit_language_model, least_share, predict_languages
from tablewright.llm.quality_cnn import fit_quality_model, score_quality
from tablewright.llm.spaced_seeds import MASKS, SHORT, SUBSTITUTIONS, WINDOW, benchmark_overlaps

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string, turns int"


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 0, "message", 10, "system", "Be brief.", 0), (1, 1, "message", 11, "user", "Hi", 0), (1, 2, "delta", 11, None, " there", 0),
        (1, 3, "message", 12, "assistant", "", 0), (1, 4, "delta", 12, None, "Wro", 0), (1, 5, "delta", 12, None, "ng", 0),
        (1, 6, "regenerate", 12, None, None, 0), (1, 7, "delta", 12, None, "Right", 0), (1, 9, "edit", 11, None, "Hello", 0),
        (1, 10, "message", 13, "user", "gone", 0), (1, 11, "delete", 13, None, None, 0), (1, 8, "delta", 12, None, ".", 0),
        (2, 0, "delta", 1, "tool", "x", 0), (2, 0, "delta", 1, "tool", "x", 0), (None, 0, "message", 1, None, None, 0),
    ]
    random.Random(2).shuffle(log)
    got = fold_events(spark.createDataFrame(log, EVENTS).repartition(4)).collect()
    assert sorted((r.conv_id or 0, r.place, r.role, r.text) for r in got) == [
        (0, 0, "", ""), (1, 0, "system", "Be brief."), (1, 1, "user", "Hello"), (1, 3, "assistant", "Right."), (2, 0, "tool", "xx")]
    assert fold_events(spark.createDataFrame([], EVENTS)).count() == 0


@pytest.mark.parametrize("template", [Template(), Template("<s>[INST]", "[/INST]", "</s>", ("assistant", "tool"))])
def test_rendered_text_reads_back(spark, template):
    rng = random.Random(3)
    atoms = ["<|turn|>", "<|text|>", "<|end|>", "<s>[INST]", "[/INST]", "</s>", "\\", "<", "|", "$0", "é\n", "日", "a b", ""]
    said = {c: [(rng.choice(["user", "assistant", "tool", "a<|text|>\n"]), "".join(rng.choices(atoms, k=rng.randint(0, 9))))
                for _ in range(rng.randint(1, 7))] for c in range(60)}
    log = [(c, i, "message", i, role, text, 0) for c, turns in said.items() for i, (role, text) in enumerate(turns)]
    rows = read_back(render(fold_events(spark.createDataFrame(log, EVENTS)), template), template).collect()
    assert len(rows) == len(said)
    for r in rows:
        assert [(t.role, t.text) for t in r.turns] == said[r.conv_id]
        assert r.loss_text == "".join(text for role, text in said[r.conv_id] if role in template.loss_roles)
        covered = "".join(r.formatted[s.start : s.start + s.length] for s in r.loss)
        data = r.formatted.encode()
        assert covered.encode() == b"".join(data[s.byte_start : s.byte_start + s.byte_length] for s in r.loss)
        assert r.formatted.count(template.turn) == len(said[r.conv_id])


def test_marks_are_checked():
    with pytest.raises(ValueError):
        Template(turn="\\x")
    assert hashlib.sha256(b"").hexdigest()


def test_masks_lose_no_admissible_window():
    for spots in itertools.combinations(range(WINDOW), SUBSTITUTIONS):
        assert any(
            not any(at + place in spots for at in mask) for mask in MASKS for place in range(WINDOW - mask[-1])
        ), spots


def brute_leaks(documents, items):
    words = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    named = {}
    for item, text in items:
        key = tuple(words(text))
        named[key] = min(item, named.get(key, item))
    out = {}
    for doc, text in documents:
        d = words(text)
        for b, item in named.items():
            if 0 < len(b) < WINDOW:
                # A short item stands as it is; a very short one is the whole document.
                at = [s for s in range(len(d) - len(b) + 1) if tuple(d[s : s + len(b)]) == b and (len(b) >= SHORT or len(d) == len(b))]
                if at:
                    out[doc, item] = (min(at), max(at) + len(b), len(b))
                continue
            same = {
                (s, i): sum(d[s + j] == b[i + j] for j in range(WINDOW))
                for s in range(len(d) - WINDOW + 1) for i in range(len(b) - WINDOW + 1)
            }
            good = {k: v for k, v in same.items() if v >= WINDOW - SUBSTITUTIONS}
            if good:
                out[doc, item] = (min(s for s, _ in good), max(s for s, _ in good) + WINDOW, max(good.values()))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3)))
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 30)))) for i in range(12)]
    items += [(90, items[3][1].upper() + "!!"), (91, None), (92, ""), (93, "the " * 20), (94, "What is, the capital of Norway today?")]
    items += [(95, "only four words here"), (96, "one"), (97, "a b a b a")]
    documents = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 30))]
        part = items[rng.randrange(12)][1].split()
        for _ in range(rng.randint(0, 4)):
            part[rng.randrange(len(part))] = word()
        documents.append((i, "... " * (i % 3) + " ".join(text + part[rng.randint(0, 6):]).title() + ",\n" + word()))
    documents += [(100, None), (101, ""), (102, "the " * 50), (103, items[2][1].replace(" ", " -- "))]
    documents += [(104, "So: what is the capital of Norway today, what is the capital of Norway today?"), (105, "ONLY four words, here"),
                  (106, "there are only four words here"), (107, "One!"), (108, "one one"), (109, "a b a b a b a"), (110, "what is the capital of Norway")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in documents], "doc_id long, text string, item_id int")
    got = benchmark_overlaps(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.first_word, r.end_word, r.same_words) for r in got} == brute_leaks(documents, items)
    assert len(got) > 20


def test_leaks_in_blocks_and_in_empty_tables(spark, monkeypatch):
    schema, bench = "doc_id long, text string", "item_id long, text string"
    long = " ".join(f"w{i}" for i in range(20))
    documents = spark.createDataFrame([(1, long), (None, long), (None, long)], schema)
    items = spark.createDataFrame([(i, f"{long} {i}") for i in range(9)], bench)
    whole = sorted(map(str, benchmark_overlaps(documents, items).collect()))
    monkeypatch.setattr("tablewright.llm.spaced_seeds.BLOCK_SEEDS", 100)
    assert sorted(map(str, benchmark_overlaps(documents, items).collect())) == whole and len(whole) == 18
    assert benchmark_overlaps(documents, spark.createDataFrame([], bench)).count() == 0
    assert benchmark_overlaps(spark.createDataFrame([], schema), items).count() == 0


def test_words_are_split_once_and_blocks_are_not_held_together(spark, monkeypatch):
    """A second split of each text, a struct for each seed, or the seeds of all blocks at once fill an executor."""
    text = " ".join(f"w{i}" for i in range(20))
    documents = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{text} {i}") for i in range(9)], "item_id long, text string")
    plan = lambda: benchmark_overlaps(documents, items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan().count("split(") == 1 and "inline(" not in plan() and "Join" in plan()
    monkeypatch.setattr("tablewright.llm.spaced_seeds.BLOCK_SEEDS", 100)
    assert "Join" not in plan()


def test_nearest_vectors_recall_ties_and_odd_rows(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((30, 16))
    data = [(i, (centres[i % 30] + 0.4 * rng.standard_normal(16)).astype(np.float32).tolist(), i) for i in range(900)]
    data += [(2000 + i, data[50][1], 0) for i in range(12)]
    odd = [(50, None, 1), (100, [0.0] * 16, 1), (151, [float("nan")] * 16, 1), (152, [float("inf")] * 16, 1), (None, data[3][1], 1),
           (153, [None] * 16, 1), (5000, [1.0, 2.0], 1), (0, data[0][1], 9)]
    frame = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in nearest_vectors(frame, F.col("vec_id") % 50 == 0, candidates=300, shard=256, block=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.array([d[0] for d in data])
    vectors = np.array([d[1] for d in data], np.float64)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cosines = (vectors * vectors[q]).sum(axis=1) / np.sqrt((vectors**2).sum(axis=1) * (vectors[q] ** 2).sum())
        order = [k for k in np.lexsort((ids, -np.round(cosines, 12))) if k != q][:5]
        mine = got[int(ids[q])]
        hits += len({int(ids[k]) for k in order} & {v for v, _ in mine})
        total += 5
        assert [s for _, s in mine] == sorted((s for _, s in mine), reverse=True) and len(mine) == 5
        for v, s in mine:
            assert abs(s - cosines[np.flatnonzero(ids == v)[0]]) < 1e-12
    assert hits / total >= 0.9 and 5000 not in got
    assert [v for v, _ in got[50]] == [2000, 2001, 2002, 2003, 2004]
    assert [v for v, _ in got[2000]] == [50, 2001, 2002, 2003, 2004]
    few = nearest_vectors(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>"), F.lit(True))
    assert few.count() == 2
    assert nearest_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_grouped_vectors_are_found_in_the_sorted_trees_alone(spark, monkeypatch):
    """Six near vectors in each of 300 groups, and one group of 300 that share most strings, over several ranges."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((301, 32))
    group = np.array([i % 300 for i in range(1800)] + [300] * 300)
    vectors = (centres[group] + np.where(group == 300, 0.002, 0.3)[:, None] * rng.standard_normal((2100, 32))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    real, seen = ann_forest._not_done, []

    def watched(points, runs, found, k):
        left = real(points, runs, found, k)
        pairs = runs.select("point", F.explode("keys")).distinct().count()
        seen.append((points.count(), left.count(), pairs))
        return left

    monkeypatch.setattr(ann_forest, "_not_done", watched)
    kept = {}
    for range_rows in (1 << 17, 4000):
        got = nearest_vectors(frame, F.col("vec_id") % 20 == 0, candidates=576, range_rows=range_rows).collect()
        kept[range_rows] = sorted((r.query_id, r.rank, r.vec_id) for r in got)
    whole = vectors.astype(np.float64)
    whole /= np.sqrt((whole**2).sum(axis=1, keepdims=True))
    hits = sum(len({v for q, _, v in kept[4000] if q == i} & set(np.argsort(-(whole @ whole[i]))[1:6].tolist())) for i in range(0, 2100, 20))
    assert len(kept[4000]) == 5 * 105 and hits >= 0.9 * 5 * 105
    for points, left, pairs in seen:
        # All but the large group are done, and what they opened is a small part of the rows.
        assert points == 105 and left <= 25 and pairs < 0.25 * points * 2100
    # Where ranges end changes nothing: their edges have the neighbouring rows.
    assert kept[4000] == kept[1 << 17]


def test_the_depth_follows_from_the_cosine():
    assert ann_forest.sufficient_depth(-1.0, 48, 48) == 0 and ann_forest.sufficient_depth(1.0, 48, 48) == 48
    depths = [ann_forest.sufficient_depth(c, 48, 48) for c in (0.0, 0.3, 0.6, 0.9, 0.99)]
    assert depths == sorted(depths)
    for c, d in zip((0.0, 0.3, 0.6, 0.9), depths):
        shared = 1 - np.arccos(c) / np.pi
        assert (1 - shared**d) ** 48 <= ann_forest.MISS < (1 - shared ** (d + 1)) ** 48


def test_the_ascent_opens_the_longest_sufficient_prefix():
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((500, 8))
    forest = PrefixForest(vectors, trees=4, bits=12)
    few, many = list(forest.candidates(vectors[:5], 1)), list(forest.candidates(vectors[:5], 400))
    assert all(i in rows for i, rows in enumerate(few)) and all(set(a) <= set(b) for a, b in zip(few, many))
    assert all(len(rows) == 500 for rows in forest.candidates(vectors[:2], 10**6))


def test_windows_cover_every_byte():
    filters = ByteFilters.create({2: 3, 4: 2}, stride=8, seed=1)
    rng = random.Random(1)
    texts = [bytes(rng.randrange(1, 256) for _ in range(n)) for n in (0, 1, 7, 8, 9, 16, 17, 40, 100)]
    features, counts = filters.windows(texts, batch_bytes=64)
    row = 0
    for text, n in zip(texts, counts):
        for k in range(n):
            padded = text.ljust(-(-max(len(text), 1) // 8) * 8, b"\0") + b"\0" * 20
            first = 0
            for w in filters.weights:
                scores = np.array([sum(w[j, padded[p + j]] for j in range(len(w))) for p in range(8 * k, 8 * k + (16 if len(text) > 8 else 8))])
                assert np.allclose(features[row, first : first + w.shape[2]], np.maximum(scores.max(axis=0), 0), atol=1e-5)
                first += w.shape[2]
            row += 1
    assert row == len(features)


def language_rows(n=240):
    rng = random.Random(9)
    stems = {"xx": ["kra", "zul", "mok", "vit"], "yy": ["elia", "ona", "iu", "sea"], "zz": ["ßag", "üb", "äch", "ung"]}
    return [(i, " ".join("".join(rng.choices(stems[lang], k=2)) for _ in range(rng.randint(3, 200))), lang)
            for i in range(n) for lang in [rng.choice(list(stems))]]


def test_languages(spark):
    rows = language_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_language_model(frame.where("doc_id % 4 <> 2"))
    odd = [(1000, None, "xx"), (1001, "", None), (1002, "123 !?", "xx"), (1003, "kra " * 100_000, None), (1003, "kra " * 100_000, None)]
    told = predict_languages(spark.createDataFrame(rows + odd, "doc_id long, text string, score string"), model).collect()
    by_id = {r.doc_id: r for r in told}
    held = [r for r in rows if r[0] % 4 == 2]
    assert sum(by_id[i].lang_pred == lang for i, _, lang in held) >= 0.95 * len(held)
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "xx"]
    assert len(told) == len(rows) + 5 and all(0 <= r.score <= 1 for r in told)


def test_without_labels_nothing_is_told(spark):
    empty = spark.createDataFrame([(1, "abc", None), (2, None, "xx")], "doc_id long, text string, lang string")
    model = fit_language_model(empty)
    assert model is None
    assert [(r.lang_pred, r.score) for r in predict_languages(empty, model).collect()] == [("und", 0.0)] * 2
    none = spark.createDataFrame([], "doc_id long, text string, quality int")
    assert [r.score for r in score_quality(empty, fit_quality_model(none, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, "abc", 1), (2, "abd", 1), (3, None, 0)], "doc_id long, text string, quality int")
    assert all(r.predicted == 1 for r in score_quality(empty, fit_quality_model(one, one)).collect())


def test_quality(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 300))]
        rows.append((i, " ".join(words if good else [w + rng.choice(["$$$", "%%%"]) for w in words]), int(good)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = fit_quality_model(frame, frame.where("doc_id % 3 <> 1"))
    got = score_quality(spark.createDataFrame(rows + [(900, None, 1), (901, "", 1)], "doc_id long, text string, score int"), model).collect()
    by_id = {r.doc_id: r for r in got}
    held = [r for r in rows if r[0] % 3 == 1]
    assert sum(by_id[i].predicted == quality for i, _, quality in held) >= 0.95 * len(held)
    assert by_id[900].score == by_id[901].score and all(r.predicted == (r.score >= 0.5) for r in got)


def test_numbers_are_no_letters(spark):
    rows = [(1, "½ ²"), (2, "Ⅷ"), (3, "③ 12"), (4, "é"), (5, None), (6, "")]
    model = LanguageModel(ByteFilters.create({2: 4}, 128, 1), np.zeros((4, 1), np.float32), np.zeros(1, np.float32), ["xx"])
    told = predict_languages(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert {r.doc_id: r.lang_pred for r in told.collect()} == {1: "und", 2: "und", 3: "und", 4: "xx", 5: "und", 6: "und"}


@pytest.mark.parametrize("number", [2, 4, 8])
def test_foreign_texts_lie_below_the_limit(spark, number):
    """The limit follows from labelled rows, so it acts with any number of languages and spares theirs."""
    rng = random.Random(number)
    alphabets = ["aeinrst ", "oumkl p", "bdefgh y", "ctvwxz i", "jqsdfu o", "mnbvca e", "plokij u", "hgfdst a"][:number]
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60))
    labelled = spark.createDataFrame([(i, text(alphabets[i % number]), f"l{i % number}") for i in range(800)], "doc_id long, text string, lang string")
    model = fit_language_model(labelled, max_documents=400)
    limit = least_share(labelled, model, max_documents=400, calibration=300)
    told = predict_languages(labelled, model).toPandas()
    assert 1 / number < limit < 1 and (told["score"] >= limit).mean() >= 0.99
    mixed = spark.createDataFrame([(i, " ".join(text(a) for a in alphabets)) for i in range(10)], "doc_id long, text string")
    assert (predict_languages(mixed, model).toPandas()["score"] < limit).mean() >= 0.9


def test_the_limit_follows_from_all_labelled_rows(spark):
    """The lowest scores lie behind the first thousands of hashes, where a bounded number of rows does not reach."""
    rows = spark.range(6000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'xx' AS lang")
    rows = rows.withColumn("draw", F.xxhash64("doc_id", "text"))
    scored = rows.withColumn("seen", F.struct(F.lit("xx").alias("lang_pred"), (0.9 - 0.4 * F.percent_rank().over(Window.orderBy("draw"))).alias("score")))
    model = LanguageModel(ByteFilters.create({2: 4}, 128, 1), np.zeros((4, 1), np.float32), np.zeros(1, np.float32), ["xx"])
    draws = sorted((r.draw, r.seen.score) for r in scored.select("draw", "seen").collect())
    model.learned = draws[999][0]
    rest = sorted(score for _, score in draws[1000:])
    assert abs(least_share(scored, model, told="seen") - 0.9 * rest[5]) < 1e-9
    assert least_share(scored.where("false"), model, told="seen") == 0.0
