"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A passage counts as leaked where ``WINDOW`` words of a document stand against as many words of a benchmark item with at
most ``SUBSTITUTIONS`` of them different. A seed is a fixed mask that hashes some places of a window and ignores the
others; the masks below are such that every admissible window holds a place where one of them sees no substitution, so
joining seed hashes finds every leak, and the windows around a hit are then compared word by word.

Items of fewer words than a window allow no substitution: one of ``SHORT`` words and more leaks where all its words stand
in a row (found by the hash of its first ``SHORT`` words), a still shorter one in a document of just these words.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.batches import stored

WINDOW, SUBSTITUTIONS = 13, 2
#: Fewer words than these are too common in any text to be looked for inside of it.
SHORT = 5
#: Places that a mask compares. Found by search; a test checks all pairs of substitutions.
MASKS = ((0, 1, 3, 8, 10, 11), (0, 1, 3, 4, 5, 7))
#: Seeds of the benchmark that are broadcast at once; larger benchmarks are worked through in blocks.
BLOCK_SEEDS = 1 << 20


def _word_codes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; splitting leaves an empty word at either end, which goes."""
    codes = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda word: F.xxhash64(word))
    return F.array_remove(codes, F.xxhash64(F.lit("")))


_SHORTEST = min(mask[-1] + 1 for mask in MASKS)


def _seed_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each place and mask: (*keep, codes, place, span, key).

    One number stands for a place and a mask, so what is made for each seed are plain numbers and no structs. Short rows
    have no sequence; a filter on their size would be pushed below ``codes``, which then is worked out twice.
    """
    masks = len(MASKS)
    numbers = F.sequence(F.lit(0), (F.size("codes") - F.lit(_SHORTEST)) * F.lit(masks) + F.lit(masks - 1))
    numbered = rows.select(*keep, "codes", F.explode(F.when(F.size("codes") >= WINDOW, numbers)).alias("number"))
    mask = F.col("number") % F.lit(masks)
    placed = numbered.withColumn("mask", mask).withColumn("place", ((F.col("number") - mask) / F.lit(masks)).cast("int"))

    def of_mask(value) -> Column:
        """``value(number, places)`` of the row's own mask."""
        chosen = value(masks - 1, MASKS[-1])
        for i in range(masks - 1):
            chosen = F.when(F.col("mask") == i, value(i, MASKS[i])).otherwise(chosen)
        return chosen

    fitting = placed.withColumn("span", of_mask(lambda i, at: F.lit(at[-1] + 1))).where(F.col("place") + F.col("span") <= F.size("codes"))
    key = of_mask(lambda i, at: F.xxhash64(F.lit(i), *[F.get("codes", F.col("place") + F.lit(a)) for a in at]))
    return fitting.select(*keep, "codes", "place", "span", key.alias("key"))


def benchmark_overlaps(documents: DataFrame, items: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keys, item_id, first_word, end_word, same_words) for every document and item that overlap.

    ``documents`` has ``keys`` and ``text``, ``items`` has ``item_id`` and ``text``; other columns are ignored. Items with
    equal words are one item, named by the smallest id. ``first_word`` to ``end_word`` (exclusive) are the word places of
    the document between the first and the last window that agrees, ``same_words`` the most equal words in one window.
    Items of fewer than ``WINDOW`` words count where all their words stand in a row; items of fewer than ``SHORT`` words
    only where they are the whole document. Texts without words overlap with nothing. Documents that repeat all keys
    are reported together. Keys may be null.

    Documents are read once per block of items; no text is shuffled, only what was found. A block of seeds has a fixed
    largest size, so its broadcast does not grow with either table; several blocks are worked through one after the other.
    """
    known = items.select(F.col("item_id").cast("long").alias("item_id"), _word_codes(F.col("text")).alias("codes"))
    known = stored(known.where(F.size("codes") > 0).groupBy("codes").agg(F.min("item_id").alias("item_id")), "items")
    words, shortest = known.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0)), F.coalesce(F.min(F.size("codes")), F.lit(WINDOW))).first()
    blocks = max(1, -(-words * len(MASKS) // BLOCK_SEEDS))
    known = known.withColumn("block", F.pmod(F.xxhash64("codes"), F.lit(blocks)))
    texts = documents.select(*keys, _word_codes(F.col("text")).alias("codes"))
    parts = [known.where(F.col("block") == block) for block in range(blocks)]
    long = F.size("codes") >= WINDOW
    jobs = [partial(_overlaps, texts, part.where(long), keys) for part in parts]
    if shortest < WINDOW:
        jobs += [partial(_short_overlaps, texts, part.where(~long), keys) for part in parts]
    # In one query all blocks would be held at once by every executor.
    found = [job() if blocks == 1 else stored(job(), "found") for job in jobs]
    return reduce(DataFrame.unionByName, found)


def _short_overlaps(texts: DataFrame, items: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The same columns for items of fewer than ``WINDOW`` words."""
    def begins(codes: Column, place: Column) -> Column:
        return F.xxhash64(*[F.get(codes, place + F.lit(at)) for at in range(SHORT)])

    own = items.select("item_id", F.col("codes").alias("item_codes"))
    seeds = own.where(F.size("item_codes") >= SHORT).withColumn("key", begins(F.col("item_codes"), F.lit(0)))
    places = F.when(F.size("codes") >= SHORT, F.sequence(F.lit(0), F.size("codes") - F.lit(SHORT)))
    placed = texts.select(*keys, "codes", F.explode(places).alias("place"))
    hits = placed.withColumn("key", begins(F.col("codes"), F.col("place"))).join(F.broadcast(seeds), "key")
    inside = hits.where(F.slice("codes", F.col("place") + 1, F.size("item_codes")) == F.col("item_codes"))
    tiny = own.where(F.size("item_codes") < SHORT).withColumn("key", F.xxhash64("item_codes"))
    alone = texts.where(F.size("codes").between(1, SHORT - 1)).withColumn("key", F.xxhash64("codes")).join(F.broadcast(tiny), "key")
    equal = alone.where(F.col("codes") == F.col("item_codes")).withColumn("place", F.lit(0))
    wanted = [*keys, "item_id", "place", F.size("item_codes").alias("n")]
    return inside.select(*wanted).unionByName(equal.select(*wanted)).groupBy(*keys, "item_id").agg(
        F.min("place").alias("first_word"), F.max(F.col("place") + F.col("n")).alias("end_word"), F.max("n").alias("same_words")
    )


def _overlaps(texts: DataFrame, items: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    own = items.select("item_id", F.col("codes").alias("item_codes"))
    seeds = _seed_rows(items, "item_id").select("key", F.col("item_id"), F.col("place").alias("item_place"))
    hits = _seed_rows(texts, *keys).join(F.broadcast(seeds), "key").join(F.broadcast(own), "item_id")
    shift = F.col("place") - F.col("item_place")
    low = F.greatest(F.lit(0), shift, F.col("place") + F.col("span") - F.lit(WINDOW))
    high = F.least(
        F.col("place"), F.size("codes") - F.lit(WINDOW), F.size("item_codes") - F.lit(WINDOW) + shift
    )
    windows = hits.withColumn("shift", shift).withColumn("low", low).withColumn("high", high).where("low <= high").select(
        *keys, "item_id", "codes", "item_codes", "shift", F.explode(F.sequence("low", "high")).alias("at")
    )
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(WINDOW - 1)), F.lit(0),
        lambda n, i: n + F.when(F.get("codes", F.col("at") + i) == F.get("item_codes", F.col("at") + i - F.col("shift")), 1).otherwise(0),
    )
    agreed = windows.select(*keys, "item_id", "at", same.alias("same")).where(F.col("same") >= WINDOW - SUBSTITUTIONS)
    return agreed.groupBy(*keys, "item_id").agg(
        F.min("at").alias("first_word"), (F.max("at") + WINDOW).alias("end_word"), F.max("same").alias("same_words")
    )
