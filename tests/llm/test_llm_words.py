"""Spelling variants, periodic runs and packing, against brute force; the word encoder against whole texts."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import spelling_variants, word_runs
from tablewright.llm.binary_packing import binary_lengths, pack_by_powers, write_buckets
from tablewright.llm.queries import QUERIES
from tablewright.llm.token_records import encoder, read_records, write_records

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, word string, runs string, part int"
ODD = [
    (1, None, "x", None, 1), (None, "again again again again again again", None, "y", None), (2, "", "a", "b", 2),
    (3, " \t\x0b\x0c\r\n ", None, None, 0), (4, "a b " * 5, "", "", 0), (4, "a b " * 5, "", "", 0), (5, "straße été× \x1ca b 日本", "", "", 0),
]


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def variants_by_brute_force(counts: dict[str, int]) -> set[tuple]:
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "aé×"])
def test_variants_of_random_words(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9))): int(3 * 2 ** rng.randint(0, 9)) for _ in range(300)}
    words["a" * 3000] = 5
    words["a" * 3001] = 50
    rows = [(w, n, "x") for w, n in words.items()]
    # Repeated, short and null rows, and a column under a name that the operator uses.
    rows += [(rows[0][0], 1, "x"), ("ab", 900, "x"), (None, 5, "x"), ("aaaaa", None, "x"), ("abababab", 0, "x")]
    words[rows[0][0]] += 1
    got = spelling_variants.variant_groups(spark.createDataFrame(rows, "word string, n long, form string").repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    listed = [tuple(r) for r in got.collect()]
    assert len(listed) == len(set(listed)) and set(listed) == variants_by_brute_force(words)


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert spelling_variants.variant_groups(spelling_variants.count_words(empty)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants.variant_groups(spark.createDataFrame([], "word string, n long"), factor=1)


def test_word_counts_with_slips(spark):
    rng = random.Random(9)
    letters = "abcXYZéÀ÷ß"
    rows = [(i % 40, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(30)) + "_Hello9World", "", "", 0) for i in range(200)]
    want: Counter = Counter()
    for doc_id, text, *_ in rows + ODD:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 2}
    got = spelling_variants.count_words(spark.createDataFrame(rows + ODD, DOCS), least_count=2, slips=7)
    assert dict(map(tuple, got.collect())) == want


def runs_by_brute_force(w: list) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - start
            if n >= max(6, 4 * q) and not any(all(w[start + k] == w[start + k + d] for k in range(n - d)) for d in range(1, q)):
                found.append((start, n, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng: random.Random) -> list[str]:
    words: list[str] = []
    for _ in range(rng.randint(0, 6)):
        unit = [f"w{rng.randint(0, rng.choice([1, 2, 5, 40]))}" for _ in range(rng.randint(1, 12))]
        words += (unit * rng.randint(1, 9))[: rng.randint(1, 90)]
    return words


def test_runs_against_brute_force(spark):
    rng = random.Random(4)
    docs = {i: random_words(rng) for i in range(400)}
    gaps = [" ", "\n", "\t ", "\x0b", " \x0c\r"]
    rows = [(i, rng.choice(["", " "]) + "".join(w + rng.choice(gaps) for w in words), "", "", 0) for i, words in docs.items()]
    got = word_runs.word_runs(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(got) == len(docs)
    for row in got:
        words = docs[row.doc_id]
        runs = runs_by_brute_force(words)
        assert (row.n_words, [tuple(r) for r in row.runs]) == (len(words), runs)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert row.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_odd_rows(spark):
    got = word_runs.word_runs(spark.createDataFrame(ODD, DOCS)).collect()
    told = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got)
    assert told == Counter({
        (1, 0, (), ""): 1, (None, 6, ((0, 6, 1),), "again"): 1, (2, 0, (), ""): 1, (3, 0, (), ""): 1,
        (4, 10, ((0, 10, 2),), "a b"): 2, (5, 4, (), "straße été× \x1ca b 日本"): 1,
    })
    assert word_runs.word_runs(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("period", [1, 2, 777, 60_000])
def test_runs_of_a_very_long_text(period):
    words = np.arange(300_000) % period
    words[:100] = np.arange(100) + period
    found = word_runs._runs_of(words, np.zeros(len(words), np.int64))
    first = 100 if period > 100 else 100
    assert [(s, n, q) for s, n, q in found] == [(first, len(words) - first, period)]


def test_query_of_runs(spark):
    """The registered query against the rules of its repeats, on the given table."""
    folder = "/root/testdata/sf0.001"
    want = {}
    for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        words = (row.text or "").encode().split()
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = runs_by_brute_force(words) if n < 3000 else None
        if runs is None:
            continue
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        want[row.doc_id] = (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
        )
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_word_runs"](spark, folder).collect()}
    assert sum(r[0] > 0 for r in want.values()) > 3
    assert {i: got[i] for i in want} == want


def test_binary_lengths():
    assert binary_lengths(0, 8) == [] and binary_lengths(8, 8) == [8] and binary_lengths(23, 8) == [8, 8, 4, 2, 1]


def test_packing_restores_every_document(spark, tmp_path):
    rng = random.Random(2)
    rows = [(100 + i, " ".join(rng.choice(["one", "Zwei", "trois", "né", "9"]) for _ in range(rng.randint(0, 400))), "", "", 0) for i in range(60)] + ODD
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    packed = pack_by_powers(docs, BPE, end_id=1, longest=64)
    pieces = packed.collect()
    assert sorted(p.sequence_id for p in pieces) == list(range(len(pieces))) and {p.offset for p in pieces} == {0}
    by_number = sorted(pieces, key=lambda p: p.sequence_id)
    assert [p.length for p in by_number] == sorted(p.length for p in pieces)
    assert {p.length for p in pieces} <= {1 << b for b in range(7)}
    tokenizer = Tokenizer.from_file(BPE)
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t, *_ in rows)
    got: Counter = Counter()
    for doc_id in {p.doc_id for p in pieces}:
        own = [p for p in pieces if p.doc_id == doc_id]
        copies = sum(p.start == 0 for p in own)
        ids: dict[int, tuple] = {p.start: struct.unpack(f"<{p.length}I", p.ids) for p in own}
        whole = tuple(x for start in sorted(ids) for x in ids[start])
        assert len(whole) == own[0].doc_tokens and all(len(ids[p.start]) == p.length for p in own)
        got[(doc_id, whole)] += copies
    assert got == want
    write_buckets(packed, f"{tmp_path}/buckets")
    assert spark.read.parquet(f"{tmp_path}/buckets").count() == len(pieces)
    assert pack_by_powers(spark.createDataFrame([], DOCS), BPE, end_id=1).count() == 0
    assert pack_by_powers(spark.createDataFrame([(1, None)], "doc_id long, text string"), BPE, end_id=None).count() == 0
    with pytest.raises(ValueError):
        pack_by_powers(docs, BPE, end_id=1, longest=100)


def test_query_of_packing(spark):
    folder = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(BPE)
    pieces = QUERIES["op13_binary_packing"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    covered = {i: [] for i in texts}
    for p in pieces:
        covered[p.doc_id].append(p)
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(covered[doc_id], key=lambda p: p.start):
            part = ids[at : at + p.length]
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += p.length
        assert at == len(ids)


def test_word_encoder_on_random_texts():
    rng = random.Random(3)
    every = [chr(c) for c in range(1, 0x250)] + list("  \n\n\t'sdtmre  ") * 8 + ["中", " ", "’", "😀"]
    own, tokenizer = encoder(BPE), Tokenizer.from_file(BPE)
    for _ in range(30):
        pool = every if rng.random() < 0.5 else every[31:126]
        texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(200)]
        got = [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)]
        assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_word_encoder_begins_anew(monkeypatch):
    from tablewright.llm import token_records

    monkeypatch.setattr(token_records, "REMEMBERED", 20)
    own = token_records.WordEncoder(BPE)
    texts = [f"word{i % 7} again{i} and the rest" for i in range(60)]
    whole = own._whole(texts)
    assert [own.encode([t])[0] for t in texts] == whole


def test_one_reading_task_for_each_file(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = write_records(docs, BPE, end_id=2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert manifest.count() == 4
    tasks = read_records(manifest).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4 and sum(r["count"] for r in tasks) == 3000
