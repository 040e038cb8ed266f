"""The centres from which MLlib's k-means would begin, for several numbers of clusters in the same passes.

MLlib's parallel start (two steps, seeds of its own) reads all rows seven times for each k. Its draws depend on the piece
of a row and on its place there, not on k, so one pass serves all k. Draws and choices are those of MLlib.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewright.session import importable

#: Fixed by MLlib: steps, and rounds among the candidates.
STEPS, LOCAL_ROUNDS = 2, 30
_M32, _M64 = (1 << 32) - 1, (1 << 64) - 1


def _murmur(data: bytes, seed: int) -> int:
    """MurmurHash3 of whole words."""
    h = seed
    for at in range(0, len(data), 4):
        k = int.from_bytes(data[at : at + 4], "little") * 0xCC9E2D51 & _M32
        k = ((k << 15 | k >> 17) & _M32) * 0x1B873593 & _M32
        h ^= k
        h = ((h << 13 | h >> 19) & _M32) * 5 + 0xE6546B64 & _M32
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & _M32
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M32
    return h ^ h >> 16


def _hashed_seed(seed: int) -> int:
    """The state with which Spark's generator begins."""
    data = (seed & _M64).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _moved(state):
    state = state ^ (state << 21) & _M64
    state = state ^ state >> 35
    return state ^ (state << 4) & _M64


@lru_cache(maxsize=64)
def _jump(power: int) -> np.ndarray:
    """Tables that move a state by 2**power: one of 256 entries for each byte, as moving is linear over bits."""
    if power == 0:
        bits = [_moved(1 << i) for i in range(64)]
    else:
        half = _jump(power - 1)
        bits = [int(_jumped(_jumped(np.array([1 << i], np.uint64), half), half)[0]) for i in range(64)]
    table = np.zeros((8, 256), np.uint64)
    for byte in range(8):
        for i in range(8):
            table[byte, 1 << i : 2 << i] = table[byte, : 1 << i] ^ np.uint64(bits[8 * byte + i])
    return table


def _jumped(states: np.ndarray, table: np.ndarray) -> np.ndarray:
    places = states.view(np.uint8).reshape(-1, 8)  # low byte first
    out = table[0][places[:, 0]]
    for byte in range(1, 8):
        out ^= table[byte][places[:, byte]]
    return out


class Draws:
    """Spark's generator for one piece: the same doubles in the same order, many at a time."""

    _BLOCK = 15

    def __init__(self, seed: int):
        states = np.array([_moved(_hashed_seed(seed))], np.uint64)
        for power in range(self._BLOCK):
            states = np.concatenate([states, _jumped(states, _jump(power))])
        self._states, self._used = states, 0

    def take(self, n: int) -> np.ndarray:
        found = []
        need = 2 * n
        while need:
            if self._used == len(self._states):
                self._states, self._used = _jumped(self._states, _jump(self._BLOCK)), 0
            found.append(self._states[self._used : self._used + need])
            self._used += len(found[-1])
            need -= len(found[-1])
        states = np.concatenate(found) if found else np.zeros(0, np.uint64)
        high = states[0::2] & np.uint64((1 << 26) - 1)
        low = states[1::2] & np.uint64((1 << 27) - 1)
        return ((high << np.uint64(27)) + low).astype(np.float64) * 2.0**-53


def xorshift_int(seed: int) -> int:
    """The first whole number of Spark's generator."""
    drawn = _moved(_hashed_seed(seed)) & _M32
    return drawn - (1 << 32) if drawn >> 31 else drawn


def xorshift_doubles(seed: int) -> Iterator[float]:
    """The same doubles as :class:`Draws`, one by one, where few are needed."""
    state = _hashed_seed(seed)
    while True:
        high = state = _moved(state)
        state = _moved(state)
        yield (((high & (1 << 26) - 1) << 27) + (state & (1 << 27) - 1)) * 2.0**-53


class JavaRandom:
    """java.util.Random, where few draws are needed."""

    def __init__(self, seed: int):
        self._state = (seed ^ 0x5DEECE66D) & (1 << 48) - 1

    def _next(self, bits: int) -> int:
        self._state = (self._state * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        return self._state >> (48 - bits)

    def double(self) -> float:
        return ((self._next(26) << 27) + self._next(27)) * 2.0**-53

    def long(self) -> int:
        high, low = self._next(32), self._next(32)
        return ((high << 32) + (low - (1 << 32) if low >> 31 else low)) & _M64

    def below(self, bound: int) -> int:
        bits = self._next(31)
        if bound & -bound == bound:
            return bound * bits >> 31
        while bits - bits % bound + bound - 1 >= 1 << 31:
            bits = self._next(31)
        return bits % bound


def _squares(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = rows - centre
    return np.einsum("ij,ij->i", apart, apart)


def _picked(points: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """``k`` centres from weighted candidates: k-means++, then rounds until no candidate changes its centre."""
    random = JavaRandom(0)

    def drawn(masses) -> int:
        target, sum_, at = random.double() * sum(masses), 0.0, 0
        while at < len(masses) and sum_ < target:
            sum_ += masses[at]
            at += 1
        return max(at - 1, 0)

    centres = [points[drawn(weights.tolist())]]
    costs = _squares(points, centres[0])
    for _ in range(1, k):
        centres.append(points[drawn((costs * weights).tolist())])
        costs = np.minimum(costs, _squares(points, centres[-1]))
    centres, before = np.array(centres), None
    for _ in range(LOCAL_ROUNDS):
        nearest = np.stack([_squares(points, c) for c in centres]).argmin(axis=0)
        counts, sums = np.zeros(k), np.zeros_like(centres)
        np.add.at(counts, nearest, weights)
        np.add.at(sums, nearest, points * weights[:, None])
        moved = before is None or bool((nearest != before).any())
        for c in range(k):
            centres[c] = sums[c] / counts[c] if counts[c] else points[random.below(len(points))]
        before = nearest
        if not moved:
            break
    return centres


def parallel_starts(
    values: DataFrame, scaled: Callable[[pa.RecordBatch], np.ndarray], tried: Sequence[int], seed: int, tasks: int
) -> dict[int, np.ndarray]:
    """The first centres for each k in ``tried``. ``values`` are persisted numbers, whose partitions are the pieces that the
    draws follow; ``scaled`` standardizes a batch of them. A k with too few different candidates gets just these, as in MLlib.
    """
    spark = values.sparkSession
    names = values.columns
    importable(spark)
    draw = xorshift_int(seed)
    first = values._jdf.toJavaRDD().takeSample(False, 1, draw)[0]
    row = pa.RecordBatch.from_pydict({n: [first.getDouble(i)] for i, n in enumerate(names)})
    start = scaled(row)[0]
    placed = values.select(*names, F.spark_partition_id().alias("piece")).coalesce(tasks)

    def told(work: Callable[[np.ndarray, int, dict], Iterator[pa.RecordBatch] | None], end: Callable[[dict], Iterator[pa.RecordBatch]], schema: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict = {}
            for batch in batches:
                pieces = batch.column("piece").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(pieces)]
                for low, high in zip(edges, edges[1:]):
                    if high > low:
                        yield from work(scaled(batch.slice(low, high - low)), int(pieces[low]), kept) or ()
            yield from end(kept)

        return placed.mapInArrow(run, schema).collect()

    centres = {k: [start] for k in tried}
    for step in range(STEPS):
        sets = {k: np.array(c) for k, c in centres.items()}
        costs = _costs(sets)

        def add(rows, piece, kept, costs=costs):
            for k, c in costs(rows).items():
                kept[k] = kept.get(k, 0.0) + float(c.sum())

        def sums(kept):
            yield pa.RecordBatch.from_pydict({"k": pa.array(list(kept), pa.int32()), "cost": pa.array(list(kept.values()), pa.float64())})

        whole = dict.fromkeys(tried, 0.0)
        for r in told(add, sums, "k int, cost double"):
            whole[r["k"]] += r["cost"]

        def choose(rows, piece, kept, costs=costs, whole=whole, step=step):
            if piece not in kept:
                kept[piece] = Draws(draw ^ step << 16 ^ piece), 0
            source, place = kept[piece]
            chance = source.take(len(rows))
            kept[piece] = source, place + len(rows)
            for k, c in costs(rows).items():
                hit = np.flatnonzero(chance < 2.0 * c * k / whole[k]) if whole[k] > 0 else []
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(hit), pa.int32()), pa.array([piece] * len(hit), pa.int32()), pa.array(hit + place, pa.int64()),
                         pa.array([v.tobytes() for v in rows[hit]], pa.binary())], ["k", "piece", "place", "point"])

        found = told(choose, lambda kept: iter(()), "k int, piece int, place bigint, point binary")
        for r in sorted(found, key=lambda r: (r["piece"], r["place"])):
            centres[r["k"]].append(np.frombuffer(r["point"]))
    different = {k: np.array(list({tuple(c): None for c in np.array(found).tolist()})) for k, found in centres.items()}
    many = {k: c for k, c in different.items() if len(c) > k}

    def count(rows, piece, kept):
        for k, c in many.items():
            best, near = np.zeros(len(rows), np.int64), _squares(rows, c[0])
            for i in range(1, len(c)):
                apart = _squares(rows, c[i])
                closer = apart < near
                best[closer], near = i, np.minimum(near, apart)
            kept[k] = kept.get(k, 0) + np.bincount(best, minlength=len(c))

    def counts(kept):
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(kept), pa.int32()), "n": pa.array([v.tobytes() for v in kept.values()], pa.binary())})

    weights = {k: np.zeros(len(c)) for k, c in many.items()}
    if many:
        for r in told(count, counts, "k int, n binary"):
            weights[r["k"]] += np.frombuffer(r["n"], np.int64)
    return {k: _picked(c, weights[k], k) if k in many else c for k, c in different.items()}


def _costs(sets: dict[int, np.ndarray]) -> Callable[[np.ndarray], dict[int, np.ndarray]]:
    """Squared distances to the nearest centre of each set. A centre that several sets share is measured once."""
    points: dict[tuple, list[int]] = {}
    for k, centres in sets.items():
        for c in centres:
            points.setdefault(tuple(c.tolist()), []).append(k)

    def costs(rows: np.ndarray) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for point, users in points.items():
            apart = _squares(rows, np.array(point))
            for k in users:
                out[k] = np.minimum(out[k], apart) if k in out else apart
        return out

    return costs
