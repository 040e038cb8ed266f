import itertools
import random

import numpy as np
import pytest

from tablewright.llm.components import components
from tablewright.llm.minhash import BANDS, band_keys, near_duplicates, shingle_hashes


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {i: " " for i in range(9, 14)}
    ).split(" ")


def brute_sets(text, width=5):
    words = [w for w in words_of(text) if w]
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(rows, percent=85):
    sets = [brute_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return {rows[i][0]: (len(sets[i]), min(groups[root(i)])) for i in range(len(rows))}


def planted(seed=4):
    """A star of near copies around one text, chains, exact copies, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts = []
    base = [word() for _ in range(160)]
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(120)]
    for step in range(12):
        texts.append(" ".join(chain))
        chain[step * 10] = word()
    shared = [word() for _ in range(50)]
    for _ in range(25):
        own = [word() for _ in range(rng.randint(5, 60))]
        texts.append(" ".join(own + shared + own[::-1]))
    for _ in range(40):
        texts.append("\t".join(word() for _ in range(rng.randint(1, 90))))
    texts += ["One two\x0bthree", "one TWO\n three", "É a b c d e", "é a b c d e", "", "  \n", None, texts[0], texts[0], texts[60]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


def test_against_brute_force(spark):
    rows = planted()
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(rows)


def test_empty_null_repeated_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept string, component_id int")
    assert near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (None, "a b c d e f", "y"), (2, None, None), (3, "", None)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in found) == [
        (False, 1, 2, 1, True), (False, 1, 2, 1, True), (False, 2, 0, 2, True), (False, 3, 0, 3, True), (True, 0, 2, None, True)]


def test_long_texts_are_cut_without_a_trace():
    rng = random.Random(1)
    text = " ".join(rng.choice(["the", "of", "River", "a"]) + str(rng.randrange(50)) for _ in range(5000)).encode()
    assert np.array_equal(shingle_hashes(text), shingle_hashes(text, piece=777))
    assert np.array_equal(shingle_hashes(b"one two"), shingle_hashes(b"ONE\n two ", piece=2))
    assert len(shingle_hashes(b" \n")) == 0


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(200):
        common, rest = rng.integers(0, 1 << 63, 340, np.uint64), rng.integers(0, 1 << 63, 60, np.uint64)
        met += bool((band_keys(np.concatenate([common, rest[:30]])) == band_keys(np.concatenate([common, rest[30:]]))).any())
    assert met == 200 and len(band_keys(common)) == BANDS


@pytest.mark.parametrize("links, want", [
    ([], {}),
    ([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}),
    ([(7, n) for n in range(10, 40)] + [(7, 7), (None, 7)], {7: 7, **{n: 7 for n in range(10, 40)}}),
])
def test_components(spark, links, want):
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == want
