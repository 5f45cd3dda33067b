"""Random forests grown by histograms, the same for any layout of the rows.

Features are cut into at most ``bins`` ranges, and a tree grows a level at a time: tasks add up, for each open node,
the weight and the sum of labels in every bin of every feature, the sums of all tasks meet by node, and the best
split of each comes back. A tree's bootstrap weight of a row follows from the row's content and the tree's number, and sums are
those of whole numbers. So neither the order of rows nor partitions nor retries change a forest, and equal rows have equal weights.

What comes to the driver is the node table: at most ``trees * 2 ** (depth + 1)`` rows of (tree, node, feature, threshold,
left, right, value, weight). It is the model; it can be stored, read and scored without anything else.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlapse.plans.stage import stage

#: Rows that choose the bins: those whose content has the smallest hash.
SAMPLE = 20_000
#: Rows of a training file, and the least number of files.
ROWS, FILES = 1_000_000, 32
#: Bytes of sums that a task holds at a time.
HELD = 64 << 20
#: Nodes of a tree whose sums meet in one group.
NODES = 16
#: Hashes are numbers below this prime; labels are whole numbers of so many bits.
PRIME, LABEL_BITS = (1 << 31) - 1, 26
#: A split must lower the squared error by more than rounding does.
NOISE = 1 + 1e-12

NODE_SCHEMA = "tree int, node int, feature string, threshold double, left int, right int, value double, weight long"


def weight_steps() -> list[int]:
    """Hashes from which a row counts once, twice and so on: a Poisson distribution of mean 1."""
    steps, total, term = [], 0.0, math.exp(-1)
    for k in range(1, 9):
        total += term
        steps.append(int(total * PRIME))
        term /= k
    return steps


def factors(tree: int, seed: int) -> tuple[int, int]:
    """A tree's hash of a row's key is ``(a * key + b) % PRIME``."""
    name = hashlib.md5(f"{seed}|{tree}".encode()).hexdigest()
    return 1 + int(name[:7], 16), int(name[7:14], 16)


def row_key(features: Sequence[str], label: str) -> Column:
    """A number below the prime from a row's content."""
    fixed = [F.floor(F.col(c).cast("double") * 65536).cast("long").cast("string") for c in (label, *features)]
    name = F.md5(F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in fixed]))
    return F.conv(F.substring(name, 1, 15), 16, 10).cast("long") % PRIME


def cuts_of(sample: np.ndarray, bins: int) -> list[np.ndarray]:
    """Ascending upper ends of the bins of each column; what is above the last is one more bin."""
    found = []
    for column in sample.T:
        values = np.sort(column[~np.isnan(column)])
        different = np.unique(values)
        if len(different) > bins:
            found.append(np.unique(values[[k * len(values) // bins for k in range(1, bins)]]))
        else:
            found.append(different[:-1])
    return found


def binned(rows: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers; a missing number is in the last bin."""
    return np.column_stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)]).astype(np.uint8)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Grown:
    """Trees as far as they have grown: per tree and node a split, and the sums of the rows in it. The root is node 1."""

    def __init__(self, trees: int, depth: int):
        size = 2 << depth
        self.feature = np.full((trees, size), -1, dtype=np.int16)
        self.cut = np.zeros((trees, size), dtype=np.int16)
        self.n = np.zeros((trees, size), dtype=np.int64)
        self.s = np.zeros((trees, size), dtype=np.int64)

    def place(self, tree: int, rows: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that reach a level, and their nodes there."""
        at, node = np.arange(len(rows)), np.ones(len(rows), dtype=np.int64)
        for _ in range(level):
            feature = self.feature[tree, node]
            open_ = feature >= 0
            at, node, feature = at[open_], node[open_], feature[open_]
            node = 2 * node + (rows[at, feature] > self.cut[tree, node])
        return at, node


def node_sums(rows: np.ndarray, label: np.ndarray, key: np.ndarray, grown: Grown, level: int, bins: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Tree, node, and weight and label sum of every feature and bin, for the nodes of a level that have rows."""
    width, first = rows.shape[1], 1 << level
    steps = np.array(weight_steps())
    places = rows.astype(np.int64) + bins * np.arange(width)
    # So many nodes' sums are held at a time.
    batch = max(1, HELD // (16 * width * bins))
    for tree in range(len(grown.feature)):
        a, b = factors(tree, seed)
        weight = np.searchsorted(steps, (key * a + b) % PRIME, side="right")
        drawn = np.flatnonzero(weight)
        at, node = grown.place(tree, rows[drawn], level)
        at = drawn[at]
        for low in range(first, 2 * first, batch):
            here = (node >= low) & (node < low + batch)
            if not here.any():
                continue
            mine, local = at[here], node[here] - low
            index = (local[:, None] * (width * bins) + places[mine]).ravel()
            size = int(local.max() + 1) * width * bins
            n = np.bincount(index, np.repeat(weight[mine], width), size)
            s = np.bincount(index, np.repeat(weight[mine] * label[mine], width), size)
            both = np.stack((n, s)).astype(np.int64).reshape(2, -1, width * bins)
            for k in np.unique(local):
                yield tree, int(low + k), both[:, k]


def best_split(n: np.ndarray, s: np.ndarray, bins: int) -> tuple[int, int, int, int, int, int]:
    """A node's weight and sum, and the feature, bin, weight and sum of its lower part; feature -1 if no split is worth it."""
    n, s = n.reshape(-1, bins), s.reshape(-1, bins)
    total_n, total_s = int(n[0].sum()), int(s[0].sum())
    low_n, low_s = n.cumsum(axis=1), s.cumsum(axis=1)
    high_n, high_s = (total_n - low_n).astype(float), (total_s - low_s).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        good = low_s.astype(float) * low_s / low_n + high_s * high_s / high_n
    good = np.where((low_n > 0) & (high_n > 0), good, -np.inf)
    feature, cut = np.unravel_index(int(np.argmax(good)), good.shape)
    if not good[feature, cut] > float(total_s) * total_s / total_n * NOISE:
        return total_n, total_s, -1, 0, 0, 0
    return total_n, total_s, int(feature), int(cut), int(low_n[feature, cut]), int(low_s[feature, cut])


@dataclass(frozen=True)
class Forest:
    """A fitted forest: arrays by tree and node number, children of node k are 2k and 2k + 1."""

    features: tuple[str, ...]
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    weight: np.ndarray

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Mean of the trees' values; a missing number is above every threshold."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.ones(len(rows), dtype=np.int64)
            for _ in range(int(np.log2(len(value))) - 1):
                split = feature[node]
                inner = split >= 0
                below = rows[every, np.maximum(split, 0)] <= threshold[node]
                node = np.where(inner, 2 * node + ~below, node)
            total += value[node]
        return total / len(self.value)

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        return df.withColumn(output, self.of_column(_inputs(self.features)))

    def of_column(self, inputs: Column) -> Column:
        """Prediction from an array of numbers, in Arrow batches."""
        width = len(self.features)

        @F.arrow_udf("double")
        def score(rows: pa.Array) -> pa.Array:
            return pa.array(self.of(_matrix(rows, width)))

        return score(inputs)

    def rows(self) -> list[tuple]:
        """The node table."""
        found = []
        for tree, node in np.argwhere(self.weight > 0).tolist():
            split = int(self.feature[tree, node])
            inner = split >= 0
            found.append((
                tree, node, self.features[split] if inner else None, float(self.threshold[tree, node]) if inner else None,
                2 * node if inner else None, 2 * node + 1 if inner else None, float(self.value[tree, node]), int(self.weight[tree, node]),
            ))
        return found

    def nodes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), NODE_SCHEMA)

    @staticmethod
    def from_nodes(nodes: DataFrame, features: Sequence[str]) -> Forest:
        rows = nodes.collect()
        trees, size = 1 + max(r.tree for r in rows), 1 << int(max(r.node for r in rows)).bit_length()
        made = Forest(tuple(features), np.full((trees, size), -1), *(np.zeros((trees, size)) for _ in range(2)), np.zeros((trees, size), dtype=np.int64))
        for r in rows:
            made.value[r.tree, r.node], made.weight[r.tree, r.node] = r.value, r.weight
            if r.feature is not None:
                made.feature[r.tree, r.node], made.threshold[r.tree, r.node] = features.index(r.feature), r.threshold
        return made


def _inputs(features: Sequence[str]) -> Column:
    """Numbers of a row; a missing one isn't a number."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def fit_forest(
    train: DataFrame, features: Sequence[str], label: str, *, trees: int = 200, depth: int = 8, bins: int = 32, seed: int = 42
) -> Forest:
    """Least-squares regression trees on bootstrap samples, all features open to every split.

    A row without a label is left out. Labels are rounded to ``LABEL_BITS`` bits of the largest.
    """
    width = len(features)
    known = train.where(F.col(label).isNotNull()).select(*dict.fromkeys([*features, label]))
    facts = known.agg(F.max(F.abs(F.col(label).cast("double"))).alias("most"), F.count(F.lit(1)).alias("n")).first()
    if not facts["n"]:
        raise ValueError("There are no rows to fit a forest on")
    if not math.isfinite(facts["most"]):
        raise ValueError("A label is not a number")
    scale = 2.0 ** (LABEL_BITS - math.ceil(math.log2(facts["most"]))) if facts["most"] else 1.0
    keyed = known.select(
        _inputs(features).alias("x"),
        F.floor(F.col(label).cast("double") * F.lit(scale) + 0.5).cast("long").alias("y"),
        row_key(features, label).alias("key"),
    )
    sample = keyed.orderBy("key").limit(SAMPLE) if facts["n"] > SAMPLE else keyed
    cuts = cuts_of(np.array([r.x for r in sample.select("x").collect()]), bins)

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = binned(_matrix(batch.column("x"), width), cuts)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([packed.cast(pa.binary()), batch.column("y"), batch.column("key")], names=["x", "y", "key"])

    files = max(FILES, math.ceil(facts["n"] / ROWS))
    rows = stage(keyed.mapInArrow(to_bins, "x binary, y long, key long").repartition(files), "binned-rows")
    grown = Grown(trees, depth)
    for level in range(depth + 1):
        _grow(rows, grown, level, depth, bins, width, seed)
        if not (grown.feature[:, 1 << level : 2 << level] >= 0).any():
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(grown.n > 0, grown.s / grown.n / scale, 0.0)
    threshold = np.zeros(value.shape)
    for f, cut in enumerate(cuts):
        mine = grown.feature == f
        threshold[mine] = cut[grown.cut[mine]]
    return Forest(tuple(features), grown.feature, threshold, value, grown.n)


def _grow(rows: DataFrame, grown: Grown, level: int, depth: int, bins: int, width: int, seed: int) -> None:
    """Split the nodes of a level; those of the last only get their sums."""
    if level == depth:
        return

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.frombuffer(b"".join(x.as_py() for x in b.column("x")), dtype=np.uint8), b.column("y").to_numpy(), b.column("key").to_numpy()) for b in batches]
        if not parts:
            return
        x, y, key = (np.concatenate(p) for p in zip(*parts))
        found = []
        for tree, node, both in node_sums(x.reshape(-1, width), y, key, grown, level, bins, seed):
            found.append((tree, node, both.tobytes()))
            if len(found) * 16 * width * bins >= HELD:
                yield batch_of(found)
                found = []
        if found:
            yield batch_of(found)

    def batch_of(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        tree, node, data = zip(*found)
        return pa.RecordBatch.from_arrays(
            [pa.array(tree, pa.int32()), pa.array(node, pa.int32()), pa.array([k // NODES for k in node], pa.int32()), pa.array(data, pa.binary())],
            names=["tree", "node", "part", "sums"],
        )

    def choose(group: pa.Table) -> pa.Table:
        nodes = group["node"].to_numpy()
        totals: dict[int, np.ndarray] = {}
        for node, data in zip(nodes.tolist(), group["sums"]):
            sums = np.frombuffer(data.as_py(), dtype=np.int64).reshape(2, -1)
            totals[node] = totals[node] + sums if node in totals else sums
        found = [(group["tree"][0].as_py(), node, *best_split(n, s, bins)) for node, (n, s) in totals.items()]
        return pa.table({c: pa.array(v) for c, v in zip(("tree", "node", "n", "s", "feature", "cut", "low_n", "low_s"), zip(*found))})

    made = rows.mapInArrow(sums, "tree int, node int, part int, sums binary")
    best = made.groupBy("tree", "part").applyInArrow(choose, "tree long, node long, n long, s long, feature long, cut long, low_n long, low_s long")
    for r in best.collect():
        grown.n[r.tree, r.node], grown.s[r.tree, r.node] = r.n, r.s
        if r.feature >= 0:
            grown.feature[r.tree, r.node], grown.cut[r.tree, r.node] = r.feature, r.cut
            for child, n, s in ((2 * r.node, r.low_n, r.low_s), (2 * r.node + 1, r.n - r.low_n, r.s - r.low_s)):
                grown.n[r.tree, child], grown.s[r.tree, child] = n, s
