"""Spelling variants: words one inserted, deleted or replaced code point apart, found by pivotal grams.

Every word is looked at as its bigrams, ordered from rare to common over the whole vocabulary. Its *prefix* are the
rarest ones; out of those, dynamic programming picks two *pivots* that share no code point and are rarest together. An
edit behind the first pivot leaves it and all before it as it is; any other one leaves the second pivot and all behind
it. So one pivot stands in the near word too, as far from the same end, and it is in that word's prefix (or, seen from
the other word, the other way round). That is the position limit. To keep the lists of frequent bigrams short, the part
that holds the edit is halved, and the half without the edit is compared as well: probe and index meet by

* the word up to the pivot and on to the middle of the rest (the edit is in the second half of the rest),
* the word up to the pivot, and the second half of the rest (the edit is in its first half),
* and the same two from the other end, for the second pivot.

The near word may be longer or shorter by one, so its middle is one of two. The edit distance confirms each candidate.

Why the prefix below is long enough: let the pivot be the first, second or third bigram of its word by (rarity,
position). One edit makes at most two new bigrams, so at most four stand before it in the near word: it is among the
first five there, and among the first three if it is rarer than the third one. And of two near words, the one whose
third bigram is not the more common one finds the other.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.batches import importable, pieces, stored

#: Shorter words have no two disjoint bigrams among any three, with one to spare for a deletion.
LEAST_LENGTH = 5
#: Bigrams share this many counters. The order of bigrams is a matter of cost only, so two in one counter do no harm.
COUNTERS = 1 << 16
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000
_SIGNED = 1 << 63

_LETTER_BYTES = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)}
#: From Latin-1 to letters with A-Z in lower case, and spaces.
_FOLD = bytes((b + 32 if b < 0x5B else b) if b in _LETTER_BYTES else 32 for b in range(256))


def _words_of(text: str | None) -> list[bytes]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case, as UTF-8."""
    return (text or "").encode("latin-1", "replace").translate(_FOLD).decode("latin-1").encode().split()


def _with_slips(own: Counter, doc_id: int, slips: int) -> None:
    start = zlib.crc32(f"{doc_id}:".encode())
    slipped = [w for w in own if not zlib.crc32(w, start) % slips]
    moved = [(w, own.pop(w)) for w in slipped]
    for word, n in moved:
        plain = word.decode()
        at = zlib.crc32(word, start) % len(plain)
        own[(plain[:at] + plain[at + 1 :]).encode()] += n


def _count(batches: Iterator[pa.RecordBatch], slips: int | None) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in pieces(batches, "text"):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            # A first cut by bytes: only fewer than LEAST_LENGTH of them are surely too few code points.
            own = Counter([w for w in _words_of(text) if len(w) >= LEAST_LENGTH])
            if slips and doc_id is not None:
                _with_slips(own, doc_id, slips)
            counts.update(own)
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
    if counts:
        yield out()


def count_words(documents: DataFrame, least_count: int = 3, slips: int | None = None) -> DataFrame:
    """(word, n): the words of ``LEAST_LENGTH`` code points and more that occur ``least_count`` times in all texts.

    A word is a longest run of A-Z, a-z and U+00C0 to U+00FF in ``text``, with A-Z in lower case. Null and empty texts
    have none. ``slips`` plants misspellings for tests of recall: where it divides the crc32 of ``doc_id:word``, the
    code point at that number modulo the length is left out. Rows without id take no slips; repeated rows count again;
    other columns are ignored. Tasks add up their words before the shuffle.
    """
    importable(documents.sparkSession)
    rows = documents.select("doc_id", "text")
    counted = rows.mapInArrow(lambda b: _count(b, slips), "word string, n long").where(F.length("word") >= LEAST_LENGTH)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _slot(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) & (COUNTERS - 1)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(COUNTERS, np.int64)
    slots: dict[str, int] = {}
    for batch in batches:
        seen: Counter = Counter()
        for word in batch.column("word").to_pylist():
            seen.update(map(str.__add__, word, word[1:]))
        for gram, n in seen.items():
            slot = slots.get(gram)
            if slot is None:
                if len(slots) > 1_000_000:
                    slots.clear()
                slot = slots[gram] = _slot(gram)
            totals[slot] += n
    used = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], ["slot", "n"])


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often bigrams occur in the vocabulary, in ``COUNTERS`` counters: all that the driver sees of the words."""
    importable(words.sparkSession)
    found = words.select("word").mapInArrow(_gram_counts, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    totals = np.zeros(COUNTERS, np.int64)
    for row in found.collect():
        totals[row.slot] = row.n
    return totals


def rarest_disjoint(places: list[int], weights: list[int], k: int = 2) -> list[int]:
    """The ``k`` bigrams (by their index in ``places``, which ascends) that overlap nowhere and weigh least together.

    best[j][i] is the least weight of j disjoint ones among the first i, and the choice that has it.
    """
    none = (math.inf, ())
    best = [[(0, ())] * (len(places) + 1)] + [[none] * (len(places) + 1) for _ in range(k)]
    for j in range(1, k + 1):
        for i in range(1, len(places) + 1):
            clear = i - 1
            while clear and places[clear - 1] > places[i - 1] - 2:
                clear -= 1
            weight, chosen = best[j - 1][clear]
            best[j][i] = min(best[j][i - 1], (weight + weights[i - 1], (*chosen, i - 1)))
    return list(best[k][-1][1])


def signature(word: str, rank) -> list[tuple[int, int]]:
    """The bigrams to index, as (position, 1 or 2 if it is the first or second pivot). ``rank`` gives (count, bigram)."""
    ranked = sorted((rank(word[i : i + 2]), i) for i in range(len(word) - 1))
    weight = {i: r[0] for r, i in ranked[:3]}
    prefix = sorted(weight)
    pivots = [prefix[c] for c in rarest_disjoint(prefix, [weight[i] for i in prefix])]
    tied = [i for r, i in ranked[3:5] if r == ranked[2][0]]
    return [(i, pivots.index(i) + 1 if i in pivots else 0) for i in [*prefix, *tied]]


def _behind(word: str, at: int, rest: int) -> list[tuple[int, str]]:
    """What stays of a word with a bigram at ``at`` if the edit is among the ``rest`` code points behind it."""
    half = rest // 2
    keys = [(0, word[: at + 2 + half])]
    if half:
        keys.append((1, f"{word[: at + 2]}\0{word[len(word) - (rest - half) :]}"))
    return keys


def _before(word: str, at: int, head: int) -> list[tuple[int, str]]:
    """What stays of a word with a bigram at ``at`` if the edit is among the ``head`` code points before it."""
    half = head // 2
    keys = [(2, word[at - half :])]
    if half:
        keys.append((3, f"{word[: head - half]}\0{word[at:]}"))
    return keys


def probe_keys(word: str, at: int, pivot: int) -> list[tuple[int, str]]:
    return _behind(word, at, len(word) - at - 2) if pivot == 1 else _before(word, at, at)


def index_keys(word: str, at: int) -> set[tuple[int, str]]:
    """The keys by which near words of the same length, one more or one less may ask for this one."""
    rest = len(word) - at - 2
    behind = [k for r in range(max(0, rest - 1), rest + 2) for k in _behind(word, at, r)]
    return {*behind, *(k for h in range(max(0, at - 1), at + 2) for k in _before(word, at, h))}


def _index(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    ranks: dict[str, tuple[int, str]] = {}

    def rank(gram: str) -> tuple[int, str]:
        got = ranks.get(gram)
        if got is None:
            if len(ranks) > 1_000_000:
                ranks.clear()
            got = ranks[gram] = (int(counts[_slot(gram)]), gram)
        return got

    for batch in pieces(batches, "word", 1 << 18):
        keys, probes, owners = [], [], []
        words = batch.column("word").to_pylist()
        for owner, word in enumerate(words):
            before = len(keys)
            for at, pivot in signature(word, rank):
                asked = probe_keys(word, at, pivot) if pivot else ()
                # What a word asks for is among its own keys: one row serves both.
                for kind, part in index_keys(word, at):
                    keys.append(xxhash.xxh64_intdigest(part.encode("utf-8", "surrogatepass"), kind) - _SIGNED)
                    probes.append((kind, part) in asked)
            owners.extend([owner] * (len(keys) - before))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(probes, pa.bool_()), *(batch.column(c).take(pa.array(owners, pa.int64())) for c in ("word", "n"))],
            ["key", "probe", "word", "n"],
        )


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of ``words`` (word, n) one edit apart once, in no fixed order of its two ends.

    Words are distinct and of at least ``LEAST_LENGTH`` code points.
    """
    importable(words.sparkSession)
    counts = gram_counts(words)
    index = stored(words.select("word", "n").mapInArrow(lambda b: _index(b, counts), "key long, probe boolean, word string, n long"), "grams")
    probe = index.where("probe").select("key", F.col("word").alias("p_word"), F.col("n").alias("p_n"))
    met = probe.join(index.drop("probe"), "key").where("p_word <> word")
    near = met.where(F.levenshtein("p_word", "word", 1) == 1)
    swapped = F.col("p_word") > F.col("word")
    return near.select(
        F.when(swapped, F.col("word")).otherwise(F.col("p_word")).alias("a"), F.when(swapped, F.col("n")).otherwise(F.col("p_n")).alias("n_a"),
        F.when(swapped, F.col("p_word")).otherwise(F.col("word")).alias("b"), F.when(swapped, F.col("p_n")).otherwise(F.col("n")).alias("n_b"),
    ).distinct()


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) for (word, form): forms followed to their last one, by doubling the way each round.

    Counts at least double with each step, so no way is longer than the binary logarithm of the largest count ``most``.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max(1, math.ceil(math.log2(max(2, most.bit_length()))))):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return now


def variant_groups(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n): the form it is a spelling of.

    The form is the near word of largest n (ties: the smallest in code-point order) if that n is at least ``factor``
    times the word's own; otherwise null. The root is found by following forms to the last; a word without form is its
    own. Rows that repeat a word are added up; rows with a null word or n, with n below 1, or with fewer than
    ``LEAST_LENGTH`` code points are left out. An empty table gives an empty one. Other columns are ignored.
    """
    if factor < 2:
        raise ValueError("a factor below 2 could let forms run in circles or on without end")
    fit = words.where((F.length("word") >= LEAST_LENGTH) & (F.col("n") > 0))
    words = stored(fit.groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    pairs = stored(near_words(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("own"), F.col("b").alias("near"), F.col("n_b").alias("n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("n_b").alias("own"), F.col("a").alias("near"), F.col("n_a").alias("n"))
    )
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), "near")).alias("best"), F.max("own").alias("own"))
    large = -F.col("best.minus") >= factor * F.col("own")
    best = best.select("word", "n_near", F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.minus")).alias("form_n"))
    best = stored(best, "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    roots = _roots(best.where("form IS NOT NULL"), most)
    return words.join(best, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
