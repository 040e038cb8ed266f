"""Near-duplicates by min-max hashing.

A document's set holds the hashes of its distinct word shingles. Under each of 96 permutations both the smallest and the
largest hash are kept, so 192 values cost 96 evaluations. At a limit of 0.85 six of them (three permutations) make a band,
32 bands in all; a lower limit has shorter bands and more of them (``band_size``). Two sets that agree to the limit share
no band with a chance of about 3e-7, at 0.85 and at 0.8.

Candidates of a band are never paired with each other. Documents with equal sets become one node first. Then every
bucket names one hub, the member that shares most buckets, and its other members are compared with the hub on full sets.
Most buckets are one component after that. What is left in several components is compared block by block inside a task
that returns only links which join something. So no link between members of a bucket is lost, and the rows that move
grow with the number of members, not of pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.batches import importable, pieces, stored, utf8_values
from tablewright.llm.components import components

PERMUTATIONS, BAND_VALUES = 96, 6
BANDS = 2 * PERMUTATIONS // BAND_VALUES
#: The chance at most with which two sets at the limit may share no band.
MISS = 1e-6
#: Shingles that the members of a hub, or the two blocks of a bucket, may bring into one verification task.
HUB_SHINGLES, BLOCK_SHINGLES = 1 << 17, 1 << 19

_SEED = np.random.default_rng(20240607)
_BYTE_CODES = _SEED.integers(0, 1 << 64, 256, np.uint64)
_BASE = int(_SEED.integers(0, 1 << 62)) * 2 + 1
_MULTIPLY = _SEED.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 1 << 64, PERMUTATIONS, np.uint64)
_BAND_MULTIPLY = _SEED.integers(0, 1 << 63, BAND_VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _hashes_of(words: list[bytes], width: int) -> np.ndarray:
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.flatnonzero(flat == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    up, down = _POWERS.upto(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[flat] * up[:-1], out=sums[1:])
    first, last = starts[: len(words) - width + 1], ends[width - 1 :]
    return _mix((sums[last] - sums[first]) * down[first])


def shingle_hashes(text: bytes | None, width: int = 5, piece: int = 4 << 20) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a UTF-8 text; A-Z is lower-cased.

    Fewer words than ``width`` make one shingle, no words none. Long texts are worked through in overlapping pieces.
    """
    if not text:
        return np.empty(0, np.uint64)
    if len(text) <= piece:
        words = text.lower().split()
        return np.unique(_hashes_of(words, min(width, len(words)))) if words else np.empty(0, np.uint64)
    found, carry, at = [], [], 0
    while at < len(text):
        cut = _SPACE.search(text, min(at + piece, len(text)))
        stop = cut.end() if cut else len(text)
        carry = carry[-(width - 1) :] + text[at:stop].lower().split()
        at = stop
        if len(carry) >= width:
            found.append(np.unique(_hashes_of(carry, width)))
    if not found:
        return np.unique(_hashes_of(carry, len(carry))) if carry else np.empty(0, np.uint64)
    return np.unique(np.concatenate(found))


def band_size(percent: int) -> int:
    """Values in a band: as many, up to ``BAND_VALUES``, as miss a pair at the limit with a chance below ``MISS``."""
    for size in range(BAND_VALUES, 1, -1):
        if (1 - (percent / 100) ** size) ** (2 * PERMUTATIONS // size) <= MISS:
            return size
    return 1


def band_keys(hashes: np.ndarray, block: int = 4096, size: int = BAND_VALUES) -> np.ndarray:
    """One 64-bit key per band of ``size`` values from the minima and maxima of all permutations."""
    bands = 2 * PERMUTATIONS // size
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(hashes), block):
        permuted = _MULTIPLY[:, None] * hashes[None, at : at + block] + _ADD[:, None]
        np.minimum(low, permuted.min(axis=1), out=low)
        np.maximum(high, permuted.max(axis=1), out=high)
    values = np.stack([low, high], axis=1).reshape(-1)[: bands * size].reshape(bands, size)
    keys = (_mix(values) * _BAND_MULTIPLY[:size]).sum(axis=1, dtype=np.uint64)
    return _mix(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        sizes, digests, bands = [], [], []
        for text in utf8_values(batch.column("text")):
            hashes = shingle_hashes(text, width)
            sizes.append(len(hashes))
            digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
            bands.append(band_keys(hashes, size=size) if len(hashes) else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
             pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "digest", "bands"],
        )


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = int((a[at] == b).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections, from 0/1 matrices over the shingles that occur on both sides."""
    vocabulary = np.intersect1d(np.concatenate(left), np.concatenate(right))
    counts = np.zeros((len(left), len(right)))
    for at in range(0, len(vocabulary), columns):
        part = vocabulary[at : at + columns]

        def matrix(sets):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, hashes in enumerate(sets):
                own = hashes[np.searchsorted(hashes, part[0]) : np.searchsorted(hashes, part[-1], "right")]
                own = own[np.isin(own, part, assume_unique=True)]
                m[i, np.searchsorted(part, own)] = 1
            return m

        counts += matrix(left) @ matrix(right).T
    return counts


class _Forest:
    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def _verify(frame: pd.DataFrame, width: int, percent: int) -> pd.DataFrame:
    """Links of one task. Side 0 meets side 1; a task without side 1 compares its rows with each other."""
    ids = frame["doc_id"].tolist()
    sets = [shingle_hashes(t.encode() if isinstance(t, str) else None, width) for t in frame["text"]]
    sides = frame["side"].to_numpy()
    forest, links = _Forest(), []
    for i, root in enumerate(frame["root"].tolist()):
        forest.join(ids[i], ("component", root))
    left = [i for i in np.flatnonzero(sides == 0) if len(sets[i])]
    right = [i for i in np.flatnonzero(sides == 1) if len(sets[i])]
    alone = not (sides == 1).any()
    right = left if alone else right
    if not left or not right:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    if len(left) == 1 and not alone:
        pairs = [(left[0], j) for j in right if _similar(sets[left[0]], sets[j], percent)]
    else:
        common = _common_counts([sets[i] for i in left], [sets[j] for j in right])
        total = np.array([len(sets[i]) for i in left])[:, None] + np.array([len(sets[j]) for j in right])[None, :]
        found = np.argwhere(100 * common >= percent * (total - common))
        pairs = [(left[x], right[y]) for x, y in found if not alone or x < y]
    for i, j in pairs:
        if forest.join(ids[i], ids[j]):
            links.append((ids[i], ids[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _links(tasks: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Compare inside tasks (task, part, side, doc_id, root); texts are joined to them by id."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _verify(frame, width, percent)

    return tasks.join(texts.hint("merge"), "doc_id").groupBy("task", "part").applyInPandas(run, "a long, b long")


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``documents`` (doc_id, text).

    Documents with 100 * intersection >= percent * union of their shingle sets are linked; the component id is the
    smallest id reachable. Texts without words (null, empty, blank) are linked with nothing. A row without id stays
    alone, without component, and is kept. Rows that repeat an id are each placed by their own text. Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    importable(spark)
    size = band_size(percent)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(
        texts.mapInArrow(
            lambda batches: _signatures(batches, width, size),
            "doc_id long, n_shingles long, digest binary, bands array<long>",
        ),
        "signatures",
    )
    known = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    copies = stored(
        known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "copies",
    )
    # Of equal sets the smallest id is the node; the others follow it.
    followed = known.join(copies, "digest", "left").where("first IS NULL OR first = doc_id")
    nodes = stored(followed.select("doc_id", "n_shingles", "bands").distinct(), "nodes")
    rows = stored(_buckets(nodes), "buckets")
    hubs = stored(_hubs(rows, 2 * PERMUTATIONS // size), "hubs")
    edges = stored(
        rows.join(hubs, "key")
        .where("doc_id <> hub")
        .where(100 * F.least("n_shingles", "hub_shingles") >= percent * F.greatest("n_shingles", "hub_shingles"))
        .select("hub", "doc_id", F.pmod(F.xxhash64("doc_id"), "parts").alias("part"))
        .distinct(),
        "edges",
    )
    tasks = edges.select(F.col("hub").alias("task"), "part", F.lit(1).alias("side"), "doc_id", F.col("doc_id").alias("root"))
    heads = edges.select(F.col("hub").alias("task"), "part").distinct()
    tasks = tasks.unionByName(heads.select("task", "part", F.lit(0).alias("side"), F.col("task").alias("doc_id"), F.col("task").alias("root")))
    # Texts meet ids in a merge join at every size: neither side has a bound, and the cost stays in proportion.
    needed = stored(texts.join(rows.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    links = stored(_links(tasks, needed, width, percent), "links")
    roots = components(links)
    rest = stored(_rest(rows, roots), "rest")
    if rest.limit(1).count():
        more = stored(_links(_blocks(rest), needed, width, percent), "links")
        roots = components(links.unionByName(more))
    rows_of = signed.select("doc_id", "n_shingles", "digest")
    linked = (
        rows_of.where("doc_id IS NOT NULL AND digest IS NOT NULL")
        .join(copies, "digest", "left")
        .withColumn("node", F.coalesce("first", "doc_id"))
        .join(roots, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    )
    alone = rows_of.where("doc_id IS NULL OR digest IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    return linked.unionByName(alone).withColumn("kept", kept)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(key, doc_id, n_shingles, size) for buckets of two members or more."""
    rows = nodes.select(F.explode("bands").alias("key"), "doc_id", "n_shingles")
    sizes = stored(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    return rows.join(sizes.hint("merge"), "key")


def _hubs(rows: DataFrame, bands: int) -> DataFrame:
    """(key, hub, hub_shingles, parts): the member that shares most buckets, and how many tasks its members need."""
    degrees = rows.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    best = F.max_by(F.struct("doc_id", "n_shingles", "degree"), F.struct("degree", -F.col("doc_id"))).alias("best")
    ranked = rows.join(stored(degrees, "degrees"), "doc_id").groupBy("key").agg(best)
    weight = F.col("best.degree") * (F.col("best.n_shingles") + 256) / F.lit(bands * HUB_SHINGLES)
    return ranked.select(
        "key", F.col("best.doc_id").alias("hub"), F.col("best.n_shingles").alias("hub_shingles"),
        F.ceil(weight).cast("long").alias("parts"),
    )


def _rest(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that are still in several components, once for each set of members.

    Members that a component shares are all kept: any of them may link to the others. Pairs were compared with their
    hub already.
    """
    rooted = rows.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "root", F.coalesce("root", "doc_id")
    )
    rooted = stored(rooted, "rooted")
    mixed = (
        rooted.where("size > 2").groupBy("key").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.max("size").alias("size"),
            F.bit_xor(F.xxhash64("doc_id")).alias("members"), F.sum(F.col("n_shingles") + 256).alias("weight"),
        )
        .where("low <> high")
        .groupBy("members", "size").agg(F.min("key").alias("key"), F.max("weight").alias("weight"))
        .select("key", F.ceil(F.col("weight") * 2 / F.lit(BLOCK_SHINGLES)).cast("long").alias("parts"))
    )
    return rooted.join(stored(mixed, "mixed"), "key").select("key", "doc_id", "root", "parts")


def _blocks(rest: DataFrame) -> DataFrame:
    """Deal the members of a bucket to blocks; every two blocks meet in one task, and each block meets itself."""
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("doc_id"), "parts"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return other.select(
        F.col("key").alias("task"), (low * F.col("parts") + high).alias("part"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "doc_id", "root",
    )
