"""MLlib's random forests for several targets of one table, grown together in numpy.

Thresholds, bags of rows, feature subsets and splits are those of MLlib's RandomForestRegressor with the same seed, so its
results are the same; what differs is that all targets share their passes, and that counts of a piece are added up in arrays.
Bags are drawn by MLlib itself (:func:`_bagged`), by piece and place of a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from tablewright.operators.starts import JavaRandom, xorshift_doubles, xorshift_int
from tablewright.session import importable

#: Fixed by MLlib: bins of a column, rows from which they are found, and bytes of sums in a pass.
BINS, SAMPLE, GROUP_BYTES = 32, 10_000, 256 << 20
_EPSILON = 2.0**-52
_INVALID = -np.finfo(np.float64).max
#: Tasks of a pass for each core.
_TASKS = 3
#: Rows that cross from MLlib's bags as one object, and rows that are added up at once.
_TOGETHER, _BLOCK = 8, 1 << 13


@dataclass
class Node:
    """A node by its number in the tree (root 1, children 2i and 2i + 1)."""

    stats: np.ndarray | None = None
    impurity: float = 0.0
    gain: float = _INVALID
    column: int = -1
    split: int = -1
    children: bool = False


@dataclass
class Forest:
    """Trees of one target. ``features`` are the columns it may use."""

    target: int
    features: list[int]
    trees: list[dict[int, Node]]
    stack: list[tuple[int, int]] = field(default_factory=list)
    random: JavaRandom | None = None

    def importances(self) -> np.ndarray:
        total = np.zeros(len(self.features))
        for tree in self.trees:
            own = np.zeros(len(self.features))
            for node in tree.values():
                if node.children:
                    own[self.features.index(node.column)] += node.gain * node.stats[0]
            if own.sum() != 0:
                total += own / own.sum()
        return total / total.sum() if total.sum() != 0 else total


def _impurity(stats: np.ndarray) -> float:
    count, total, squares = stats
    return (squares - total * total / count) / count if count else 0.0


def _prediction(stats: np.ndarray) -> float:
    return stats[1] / stats[0] if stats[0] else 0.0


def _thresholds(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """MLlib's thresholds of a column from its sampled values; ``expected`` is the number that the sample should have."""
    held = values[values != 0.0]
    if not len(held):
        return np.zeros(0)
    points, counts = np.unique(held, return_counts=True)
    weights = dict(zip(points.tolist(), counts.astype(float).tolist()))
    if expected - len(held) > _EPSILON * len(held) * 100:
        weights[0.0] = expected - len(held)
    points = sorted(weights)
    if len(points) - 1 <= most:
        return np.array([(a + b) / 2.0 for a, b in zip(points, points[1:])])
    stride = expected / (most + 1)
    found, current, target = [], weights[points[0]], stride
    for a, b in zip(points, points[1:]):
        before, current = current, current + weights[b]
        if abs(before - target) < abs(current - target):
            found.append((a + b) / 2.0)
            target += stride
    return np.array(found)


def _sampled(rows: DataFrame, count: int, wanted: int, seed: int) -> tuple[np.ndarray, float]:
    """The rows that MLlib takes for thresholds, drawn by Spark's own sampling, and how many it expects."""
    if wanted >= count:
        picked, expected = rows, float(count)
    else:
        fraction = wanted / count
        java = rows._jdf.toJavaRDD().sample(False, fraction, xorshift_int(seed))
        session = rows.sparkSession
        picked, expected = DataFrame(session._jsparkSession.createDataFrame(java, rows._jdf.schema()), session), fraction * count
    return np.array([tuple(r) for r in picked.collect()], np.float64).reshape(-1, len(rows.columns)), expected


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _bagged(rows: DataFrame, thresholds: list[np.ndarray], targets: list[int], trees: int, seed: int) -> DataFrame:
    """Blocks of rows: ``bins`` of every column, values ``y`` of the targets, and ``counts`` of every tree, column by column.

    How often a tree takes a row is drawn by MLlib, whose generator runs through a piece, tree by tree of row by row. So a few
    rows with as many draws for each are one row with all their draws. Java objects come of it, which cross to numpy as Java
    writes them: the packed rows, then one int for each row and tree.
    """
    spark = rows.sparkSession
    names, width = rows.columns, len(rows.columns) + 8 * len(targets) + 1

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, width), np.uint8)

        def together(rows: np.ndarray) -> pa.RecordBatch:
            n = len(rows) // _TOGETHER
            offsets = pa.py_buffer((np.arange(n + 1) * width * _TOGETHER).astype(np.int32).tobytes())
            return pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(rows.tobytes())])], ["rows"])

        for batch in batches:
            values = _matrix(batch, names)
            out = np.zeros((batch.num_rows, width), np.uint8)
            for i, (v, cuts) in enumerate(zip(values, thresholds)):
                out[:, i] = np.searchsorted(cuts, v)
            out[:, len(names) : -1] = np.column_stack([values[t] for t in targets]).astype("<f8").view(np.uint8)
            out[:, -1] = 1
            rest = np.concatenate([rest, out])
            whole = len(rest) - len(rest) % _TOGETHER
            yield together(rest[:whole])
            rest = rest[whole:]
        if len(rest):  # filled up behind the last row of a piece
            yield together(np.concatenate([rest, np.zeros((_TOGETHER - len(rest), width), np.uint8)]))

    java = spark.sparkContext._jvm
    encoders = java.org.apache.spark.sql.Encoders
    plain = getattr(rows.mapInArrow(packed, "rows binary")._jdf, "as")(encoders.BINARY()).toJavaRDD().rdd()
    bagging = java.org.apache.spark.ml.tree.impl.BaggedPoint
    no_weights = getattr(bagging, "convertToBaggedRDD$default$5")()
    bagged = bagging.convertToBaggedRDD(plain, 1.0, trees * _TOGETHER, trees > 1, no_weights, seed)
    kind = encoders.javaSerialization(java.java.lang.Class.forName("org.apache.spark.ml.tree.impl.BaggedPoint"))
    written = DataFrame(spark._jsparkSession.createDataset(bagged, kind).toDF(), spark).toDF("point")
    before_row = b"[B\xac\xf3\x17\xf8\x06\x08\x54\xe0\x02\x00\x00xp" + (width * _TOGETHER).to_bytes(4, "big")
    before_counts = b"[IM\xba`&v\xea\xb2\xa5\x02\x00\x00xp" + (trees * _TOGETHER).to_bytes(4, "big")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, n = batch.column("point"), batch.num_rows
            if not n:
                continue
            first = points[0].as_py()
            start = first.index(before_row) + len(before_row)
            drawn = first.index(before_counts, start + width * _TOGETHER) + len(before_counts)
            offset = np.frombuffer(points.buffers()[1], np.int32)[points.offset : points.offset + n + 1]
            data = np.frombuffer(points.buffers()[2], np.uint8)
            size = np.diff(offset)
            if (size == size[0]).all():
                table = data[offset[0] : offset[-1]].reshape(n, -1)
            else:  # what Java leaves unused behind a record may differ
                table = data[offset[:-1, None] + np.arange(drawn + 4 * trees * _TOGETHER)]
            packs = max(1, _BLOCK // _TOGETHER)
            for low in range(0, n, packs):
                some = table[low : low + packs]
                own = np.ascontiguousarray(some[:, start : start + width * _TOGETHER]).reshape(-1, width)
                counts = np.ascontiguousarray(some[:, drawn : drawn + 4 * trees * _TOGETHER]).view(">i4").reshape(-1, trees)
                real = own[:, -1] == 1
                own, counts = own[real], counts[real].astype(np.uint8)
                y = np.ascontiguousarray(own[:, len(names) : -1]).view("<f8")
                cells = [np.ascontiguousarray(v.T).tobytes() for v in (own[:, : len(names)], y, counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(own)], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], ["n", "bins", "y", "counts"])

    return written.mapInArrow(blocks, "n int, bins binary, y binary, counts binary")


def _subset(features: int, picked: int, random: JavaRandom) -> list[int]:
    """A reservoir of feature places, as MLlib draws it."""
    reservoir = list(range(picked))
    draws = xorshift_doubles(random.long())
    for at in range(picked, features):
        place = int(next(draws) * (at + 1))
        if place < picked:
            reservoir[place] = at
    return reservoir


def _in_map_order(keys: Sequence[int]) -> list[int]:
    """Small whole numbers in the order in which a Scala map gives them: MLlib draws feature subsets in that order."""
    if len(keys) <= 4:
        return sorted(keys, key=lambda k: (k % 16, k))

    def improved(k: int) -> int:
        h = (k + ~(k << 9)) & 0xFFFFFFFF
        h ^= h >> 14
        h = (h + (h << 4)) & 0xFFFFFFFF
        return h ^ h >> 10

    def ordered(pairs, shift):
        slots: dict[int, list] = {}
        for h, k in pairs:
            slots.setdefault(h >> shift & 31, []).append((h, k))
        alone = [slots[s][0][1] for s in sorted(slots) if len(slots[s]) == 1]
        return alone + [k for s in sorted(slots) if len(slots[s]) > 1 for k in ordered(slots[s], shift + 5)]

    return ordered([(improved(k), k) for k in keys], 0)


def _chosen_nodes(forest: Forest, bins: list[int], picked: int) -> dict[int, dict[int, list[int]]]:
    """The nodes of the next pass by tree, each with its feature columns, as far as their sums fit MLlib's limit."""
    group: dict[int, dict[int, list[int]]] = {}
    used = 0
    while forest.stack:
        tree, number = forest.stack[0]
        places = range(len(forest.features))
        if picked != len(forest.features):
            places = _subset(len(forest.features), picked, forest.random)
        columns = [forest.features[p] for p in places]
        size = 8 * 3 * sum(bins[c] for c in columns)
        if used and used + size > GROUP_BYTES:
            break
        forest.stack.pop(0)
        group.setdefault(tree, {})[number] = columns
        used += size
    return group


class _Walk:
    """A tree as arrays: where a row of bins stands after as many steps as the tree is deep so far."""

    def __init__(self, tree: dict[int, Node]):
        self.steps = max(i.bit_length() for i in tree) - 1
        size = 2 << self.steps
        self.column, self.split = np.zeros(size, np.intp), np.full(size, 255, np.uint8)
        self.inner = np.zeros(size, bool)
        for i, node in tree.items():
            if node.children:
                self.column[i], self.split[i], self.inner[i] = node.column, node.split, True
        #: A row in a leaf stays there.
        self.child = np.where(self.inner, 2 * np.arange(size), np.arange(size))

    def __call__(self, flat: np.ndarray, n: int, places: np.ndarray) -> np.ndarray:
        at = np.ones(n, np.intp)
        for _ in range(self.steps):
            right = flat.take(self.column.take(at) * n + places) > self.split.take(at)
            at = self.child.take(at) + right
        return at


def _best(sums: np.ndarray, cuts: list[int], impurity: float | None) -> tuple[float, int, int, np.ndarray, np.ndarray, np.ndarray]:
    """``(gain, slot, split, left, right, whole)`` of the best split of a node from its sums (slot, bin, statistic)."""
    summed = sums.cumsum(axis=1)
    whole = summed[0, -1]
    if impurity is None:
        impurity = _impurity(whole)
    best = (_INVALID, -1, -1, np.zeros(3), np.zeros(3), whole)
    with np.errstate(all="ignore"):
        for slot, n in enumerate(cuts):
            if not n:
                continue
            left = summed[slot, :n]
            right = summed[slot, n] - left
            both = left[:, 0] + right[:, 0]
            spread = [np.where(s[:, 0] > 0, (s[:, 2] - s[:, 1] * s[:, 1] / s[:, 0]) / s[:, 0], 0.0) for s in (left, right)]
            gain = impurity - left[:, 0] / both * spread[0] - right[:, 0] / both * spread[1]
            gain = np.where((left[:, 0] < 1) | (right[:, 0] < 1) | (gain < 0), _INVALID, gain)
            at = int(gain.argmax())
            if best[1] < 0 or gain[at] > best[0]:
                best = (float(gain[at]), slot, at, left[at].copy(), right[at].copy(), whole)
    return best


def _pass(blocks: DataFrame, forests: list[Forest], groups: list[dict], thresholds: list[np.ndarray], trees: int) -> list:
    """One pass over the rows: the best split of each chosen node. Sums of a tree meet in one task."""
    walks = {(i, t): _Walk(f.trees[t]) for i, f in enumerate(forests) for t in groups[i]}
    slots = max(len(columns) for g in groups for nodes in g.values() for columns in nodes.values())
    places: dict = {}
    for key, walk in walks.items():
        nodes = groups[key[0]][key[1]]
        slot_of, columns_of = np.full(len(walk.column), -1, np.intp), np.zeros((slots, len(nodes)), np.intp)
        for j, (number, columns) in enumerate(nodes.items()):
            slot_of[number] = j
            columns_of[:, j] = columns
        places[key] = slot_of, columns_of
    impurities = {key: [None if number == 1 else forests[key[0]].trees[key[1]][number].impurity for number in groups[key[0]][key[1]]] for key in walks}
    width, cuts = len(thresholds), [len(t) for t in thresholds]
    # A sample larger than expected gives a threshold more than were asked for.
    most = max(cuts) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {key: np.zeros((slots, len(c[0]), most, 3)) for key, (_, c) in places.items()}
        for batch in batches:
            for r in range(batch.num_rows):
                n = batch.column("n")[r].as_py()
                bins = np.frombuffer(batch.column("bins")[r].as_buffer(), np.uint8).reshape(width, n)
                y = np.frombuffer(batch.column("y")[r].as_buffer(), np.float64).reshape(-1, n)
                counts = np.frombuffer(batch.column("counts")[r].as_buffer(), np.uint8).reshape(trees, n)
                for t in range(trees):
                    users = [i for i in range(len(forests)) if (i, t) in places]
                    if not users:
                        continue
                    rows = np.flatnonzero(counts[t])
                    if not len(rows):
                        continue
                    weight, own = counts[t].take(rows).astype(np.float64), bins.take(rows, axis=1)
                    for i in users:
                        _add(total[i, t], walks[i, t], *places[i, t], own, weight, y[i].take(rows))
        part = TaskContext.get().partitionId()
        keys = list(total)
        for low in range(0, len(keys), 16):
            some = keys[low : low + 16]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in some], pa.int32()), pa.array([k[1] for k in some], pa.int32()), pa.array([part] * len(some), pa.int32()),
                 pa.array([total[k].tobytes() for k in some], pa.binary())], ["forest", "tree", "part", "sums"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for r in range(batch.num_rows):
                key = batch.column("forest")[r].as_py(), batch.column("tree")[r].as_py()
                part = np.frombuffer(batch.column("sums")[r].as_buffer(), np.float64).reshape(slots, -1, most, 3)
                total[key] = total[key] + part if key in total else part
        rows = []
        for (i, t), whole in total.items():
            for j, columns in enumerate(groups[i][t].values()):
                gain, slot, split, *stats = _best(whole[:, j], [cuts[c] for c in columns], impurities[i, t][j])
                rows.append((i, t, j, slot, split, gain, np.concatenate(stats).tolist()))
        kinds = [pa.int32()] * 5 + [pa.float64(), pa.list_(pa.float64())]
        names = ["forest", "tree", "node", "slot", "split", "gain", "stats"]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names)

    tasks = _TASKS * blocks.sparkSession.sparkContext.defaultParallelism
    added = blocks.coalesce(tasks).mapInArrow(sums, "forest int, tree int, part int, sums binary")
    met = added.repartition(min(tasks, len(walks)), "forest", "tree").sortWithinPartitions("forest", "tree", "part")
    return met.mapInArrow(best, "forest int, tree int, node int, slot int, split int, gain double, stats array<double>").collect()


def _add(total, walk, slot_of, columns_of, bins, weight, y) -> None:
    """Adds rows of a tree to the sums (slot, node, bin, statistic) of the nodes in which they stand."""
    n = len(weight)
    flat, places = bins.reshape(-1), np.arange(n)
    node = slot_of.take(walk(flat, n, places))
    inside = np.flatnonzero(node >= 0)
    if len(inside) < n:
        node, places, weight, y = node.take(inside), places.take(inside), weight.take(inside), y.take(inside)
    first = weight * y
    second = first * y
    most = total.shape[2]
    starts = node * most
    for slot, columns in enumerate(columns_of):
        key = starts + flat.take((columns * n).take(node) + places)
        for which, values in enumerate((weight, first, second)):
            total[slot, :, :, which] += np.bincount(key, values, minlength=most * len(columns)).reshape(-1, most)


def _grown(forest: Forest, group: dict, found: dict, depth: int) -> None:
    """Puts the best splits into the trees, and the children that may be split further before the other open nodes."""
    for tree in _in_map_order(list(group)):
        nodes = forest.trees[tree]
        for j, (number, columns) in enumerate(group[tree].items()):
            r, node, level = found[tree, j], nodes[number], number.bit_length() - 1
            left, right, whole = np.array(r["stats"]).reshape(3, 3)
            if number == 1:
                node.stats, node.impurity = whole, _impurity(whole)
            node.gain = r["gain"]
            if r["gain"] <= 0 or level == depth:
                continue
            node.children, node.column, node.split = True, columns[r["slot"]], r["split"]
            for child, stats in ((2 * number, left), (2 * number + 1, right)):
                nodes[child] = Node(stats, _impurity(stats))
                if level + 1 < depth and not abs(nodes[child].impurity) < _EPSILON:
                    forest.stack.insert(0, (tree, child))


def _pruned(tree: dict[int, Node], number: int = 1) -> None:
    """Leaves of one parent that predict the same become one leaf."""
    node = tree[number]
    if not node.children:
        return
    left, right = 2 * number, 2 * number + 1
    _pruned(tree, left)
    _pruned(tree, right)
    if not tree[left].children and not tree[right].children and _prediction(tree[left].stats) == _prediction(tree[right].stats):
        node.children = False
        del tree[left], tree[right]


def grown_forests(
    rows: DataFrame, count: int, targets: Sequence[int], trees: int, depth: int, seed: int
) -> tuple[list[Forest], list[np.ndarray]]:
    """A forest for each of the ``targets`` (places of columns) from the ``count`` rows, and the thresholds of all columns.

    The partitions of ``rows`` are the pieces that the draws follow, so they must come in a fixed order.
    """
    importable(rows.sparkSession)
    most = min(BINS, count)
    sample, expected = _sampled(rows, count, max(most * most, SAMPLE), seed)
    thresholds = [_thresholds(v, expected, most - 1) for v in sample.T]
    forests = []
    for target in targets:
        features = [c for c in range(len(rows.columns)) if c != target]
        roots = [(t, 1) for t in reversed(range(trees))]
        forests.append(Forest(target, features, [{1: Node()} for _ in range(trees)], roots, JavaRandom(seed)))
    features = len(rows.columns) - 1
    picked = features if trees == 1 else max(1, -(-features // 3))
    bins = [len(t) + 1 for t in thresholds]
    blocks = _bagged(rows, thresholds, list(targets), trees, seed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while any(f.stack for f in forests):
            groups = [_chosen_nodes(f, bins, picked) for f in forests]
            found: list[dict] = [{} for _ in forests]
            for r in _pass(blocks, forests, groups, thresholds, trees):
                found[r["forest"]][r["tree"], r["node"]] = r
            for forest, group, own in zip(forests, groups, found):
                _grown(forest, group, own, depth)
    finally:
        blocks.unpersist()
    for forest in forests:
        for tree in forest.trees:
            _pruned(tree)
    return forests, thresholds


def predictions(rows: DataFrame, forests: list[Forest], thresholds: list[np.ndarray]) -> DataFrame:
    """``label0, prediction0, label1, ...``: the value of each forest's target and what the forest says."""
    names = rows.columns
    walks = []
    for forest in forests:
        own = []
        for tree in forest.trees:
            walk = _Walk(tree)
            says = np.zeros(len(walk.column))
            for number, node in tree.items():
                says[number] = _prediction(node.stats)
            own.append((walk, says))
        walks.append(own)
    targets = [f.target for f in forests]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, n = _matrix(batch, names), batch.num_rows
            flat = np.concatenate([np.searchsorted(cuts, v).astype(np.uint8) for v, cuts in zip(values, thresholds)])
            places, out = np.arange(n), []
            for target, own in zip(targets, walks):
                total = np.zeros(n)
                for walk, says in own:
                    total += says.take(walk(flat, n, places))
                out += [pa.array(values[target]), pa.array(total / len(own))]
            yield pa.RecordBatch.from_arrays(out, [f"{kind}{i}" for i in range(len(targets)) for kind in ("label", "prediction")])

    importable(rows.sparkSession)
    return rows.mapInArrow(told, ", ".join(f"label{i} double, prediction{i} double" for i in range(len(targets))))
