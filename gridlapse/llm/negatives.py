"""Hard negatives: rows of another label that score a little below an anchor's positives.

A score is the integer inner product of two vectors. Anchors are dealt into groups and all rows into
slices; each pair of a group and a slice is one unit of work of bounded size, so neither side is ever
whole in a task. A group's anchors are joined to a minimum spanning tree. For a child at distance d of its
parent and a candidate of norm r, the scores differ by d * r at most, so the parent's score, or the
bounds known for it, give bounds of the child's. Only candidates whose bounds overlap the child's
window are scored again; the others keep their bounds, which go on to the child's children.

The first pass finds each anchor's positives: a window is what may still be among the best of its label.
The second pass finds the negatives: a window is what the positives' scores allow. Each unit returns as
many rows per anchor as are asked for, and a window over the units keeps the best.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part,
nor do those whose vector is too long for exact scores (2**28.5 after scaling). A shorter vector counts
as one with zeros at its end. Rows that repeat an id are rows of their own; equal anchors give equal
results, once each. Without anchors, positives or rows in the window there are no results. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlapse.llm.common import stage

#: Rows of a slice, anchors of a group, and candidates of a slice that are looked at in one step.
SLICE, GROUP, STEP = 4096, 2048, 512
#: Share of a level's candidates from which all are scored by one product of matrices.
DENSE = 0.2
SCALE = 256
#: Largest squared norm of a vector: scores times the window's factors stay within 64 bits.
LONGEST = 2.0**57


@dataclass(frozen=True)
class Rule:
    """``positives`` best rows of the anchor's label, ``negatives`` for each, with scores from ``low`` to ``high`` percent of its own."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as the rows of a matrix, shorter ones with zeros at their end."""
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.zeros((len(size), int(size.max(initial=0))), dtype=np.int64)
    found[np.arange(found.shape[1]) < size[:, None]] = values
    return found


def _widened(vectors: np.ndarray, width: int) -> np.ndarray:
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def spanning_tree(vectors: np.ndarray) -> np.ndarray:
    """The parent of each row in a minimum spanning tree of Euclidean distances; the first row is its own."""
    real = vectors.astype(np.float64)
    squares = np.einsum("ij,ij->i", real, real)
    parent = np.zeros(len(real), dtype=np.int64)
    nearest = np.full(len(real), np.inf)
    nearest[0] = -np.inf
    outside = np.ones(len(real), dtype=bool)
    for _ in range(len(real)):
        new = int(np.argmin(np.where(outside, nearest, np.inf)))
        outside[new] = False
        far = np.maximum(squares + squares[new] - 2 * (real @ real[new]), 0)
        closer = outside & (far < nearest)
        nearest[closer] = far[closer]
        parent[closer] = new
    return parent


def levels(parent: np.ndarray) -> list[np.ndarray]:
    """Rows by their number of steps to the root."""
    found = [np.flatnonzero(parent == np.arange(len(parent)))]
    left = np.setdiff1d(np.arange(len(parent)), found[0])
    while len(left):
        under = np.isin(parent[left], found[-1])
        found.append(left[under])
        left = left[~under]
    return found


class Tree:
    """A group's anchors with their spanning tree, which scores candidates within windows."""

    def __init__(self, vectors: np.ndarray, parent: np.ndarray):
        self.vectors, self.parent = vectors, parent
        self.levels = levels(parent)
        edges = (vectors - vectors[parent]).astype(np.float64)
        self.edge = np.sqrt(np.einsum("ij,ij->i", edges, edges))
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors.astype(np.float64), vectors.astype(np.float64)))
        self.place = np.zeros(len(vectors), dtype=np.int64)
        for level in self.levels:
            self.place[level] = np.arange(len(level))
        self.rescored = 0

    def scores(
        self, candidates: np.ndarray, window: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, candidate and exact score of all pairs that ``window`` cannot rule out.

        ``window`` gets anchors and the lower and upper bounds of their scores, a row per anchor, and
        tells which pairs may lie inside; it is asked again with the exact scores of those.
        """
        norm = np.sqrt(np.einsum("ij,ij->i", candidates.astype(np.float64), candidates.astype(np.float64)))
        # Sums of whole numbers below 2**53 are exact as doubles.
        exact = self.norm.max() * norm.max() < 2.0**52
        kind = np.float64 if exact else np.int64
        ours, theirs = self.vectors.astype(kind), candidates.astype(kind)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = high = np.empty((0, len(candidates)))
        for depth, level in enumerate(self.levels):
            if depth:
                above = self.place[self.parent[level]]
                slack = self.edge[level, None] * (norm * (1 + 1e-9)) + 1e-12 * self.norm[level, None] * norm + 1
                low, high = low[above] - slack, high[above] + slack
            else:
                low = np.full((len(level), len(candidates)), -np.inf)
                high = -low
            row, at = np.nonzero(window(level, low, high))
            self.rescored += len(row)
            if len(row) > DENSE * low.size:
                score = (ours[level] @ theirs.T)[row, at]
            else:
                score = np.einsum("ij,ij->i", ours[level[row]], theirs[at])
            low[row, at] = high[row, at] = score
            inside = window(level, low, high)[row, at]
            found.append((level[row[inside]], at[inside], score[inside].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found))


def first(key: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores of each key, equal ones by smaller id; in the order of keys."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    start = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))) if len(key) else order
    rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    return order[rank < n]


def _sides(rows: pa.Table, anchors: pa.Table) -> tuple[np.ndarray, Tree]:
    theirs, ours = matrix(rows["vector"]), matrix(anchors["vector"])
    width = max(theirs.shape[1], ours.shape[1])
    return _widened(theirs, width), Tree(_widened(ours, width), anchors["parent"].to_numpy())


def best_of_slice(rows: pa.Table, anchors: pa.Table, n: int) -> pa.Table:
    """The ``n`` best other rows of a slice for each anchor of a group."""
    vectors, tree = _sides(rows, anchors)
    ids, rids, own = rows["vec_id"].to_numpy(), rows["rid"].to_numpy(), anchors["rid"].to_numpy()
    kept = [np.empty(0, dtype=np.int64)] * 3  # anchor, row, score
    floor = np.full(len(own), -np.inf)
    for at in range(0, len(vectors), STEP):

        def window(level: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            least = floor[level]
            if low.shape[1] > n:  # one more than asked for, as the anchor itself may be among them
                least = np.maximum(least, np.partition(low, low.shape[1] - n - 1, axis=1)[:, -n - 1])
            return high >= least[:, None]

        anchor, row, score = tree.scores(vectors[at : at + STEP], window)
        other = rids[row + at] != own[anchor]
        now = [anchor[other], row[other] + at, score[other]]
        kept = [np.concatenate(x) for x in zip(kept, now)]
        best = first(kept[0], kept[2], ids[kept[1]], n)
        kept = [x[best] for x in kept]
        count = np.bincount(kept[0], minlength=len(own))
        last = np.cumsum(count) - 1
        floor[count == n] = kept[2][last[count == n]]
    anchor, row, score = kept
    return pa.table({"rid": own[anchor], "positive_id": ids[row], "positive_row": rids[row], "positive_score": score})


def negatives_of_slice(rows: pa.Table, anchors: pa.Table, rule: Rule) -> pa.Table:
    """For each positive of each anchor the best rows of a slice that have another label and a score in its window."""
    vectors, tree = _sides(rows, anchors)
    ids, labels, label = (x.to_numpy() for x in (rows["vec_id"], rows["label"], anchors["label"]))
    scores = matrix(anchors["scores"])
    count = np.diff(anchors["scores"].combine_chunks().offsets.to_numpy())
    inside = np.arange(scores.shape[1]) < count[:, None]
    low = np.where(inside, -(-rule.low * scores // 100), np.iinfo(np.int64).max)
    high = np.where(inside, rule.high * scores // 100, np.iinfo(np.int64).min)
    some = low <= high  # none below a negative score
    lowest = np.where(some, low, np.inf).min(axis=1, initial=np.inf)
    highest = np.where(some, high, -np.inf).max(axis=1, initial=-np.inf)
    kept = [np.empty(0, dtype=np.int64)] * 3  # anchor and positive, row, score
    for at in range(0, len(vectors), STEP):
        theirs = labels[at : at + STEP]

        def window(level: np.ndarray, under: np.ndarray, over: np.ndarray) -> np.ndarray:
            return (over >= lowest[level, None]) & (under <= highest[level, None]) & (theirs != label[level, None])

        anchor, row, score = tree.scores(vectors[at : at + STEP], window)
        now = []
        for k in range(scores.shape[1]):
            fits = (score >= low[anchor, k]) & (score <= high[anchor, k])
            now.append((anchor[fits] * scores.shape[1] + k, row[fits] + at, score[fits]))
        if now:
            kept = [np.concatenate(x) for x in zip(kept, *now)]
            best = first(kept[0], kept[2], ids[kept[1]], rule.negatives)
            kept = [x[best] for x in kept]
    anchor, which = np.divmod(kept[0], max(1, scores.shape[1]))
    own = anchors["rid"].to_numpy()
    return pa.table({"rid": own[anchor], "which": which, "negative_id": ids[kept[1]], "negative_score": kept[2]})


def scaled(vectors: DataFrame, *, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """Rows that take part: ``vec_id``, ``label`` and the scaled, rounded-down ``vector``."""
    real = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    squares = F.aggregate("real", F.lit(0.0), lambda total, x: total + x * x)
    kept = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False)))
    named = kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), real.alias("real"))
    return named.where(squares < LONGEST).select("vec_id", "label", F.col("real").cast("array<int>").alias("vector"))


def _dealt(n: Column, each: int) -> Column:
    """A row's part, of as many as ``n`` rows need."""
    return F.pmod(F.xxhash64("rid"), F.greatest(F.ceil(n / each), F.lit(1)))


def _all_parts(n: Column, each: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / each), F.lit(1)).cast("long") - 1))


def with_tree(anchors: DataFrame, *by: str) -> DataFrame:
    """``anchors`` with ``parent``, the number of an anchor's parent among those of its group, in the order of ``rid``."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("rid")
        return group.append_column("parent", pa.array(spanning_tree(matrix(group["vector"]))))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.groupBy(*by).applyInArrow(run, f"{fields}, parent long")


def positives(rows: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """Per anchor ``rid`` and list ``best``: score, id and row of its ``n`` best other rows of its label, best first."""
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    wanted = anchors.groupBy(F.col("label").alias("of_label")).agg(F.count(F.lit(1)).alias("n_anchors"))
    sizes = stage(sizes.join(wanted, F.col("label") == F.col("of_label")).select("of_label", "n_rows", "n_anchors"), "label-sizes")
    here = F.col("label") == F.col("of_label")
    mine = anchors.join(sizes, here).select("rid", "label", "vector", "n_rows", _dealt(F.col("n_anchors"), GROUP).alias("of_group"))
    mine = stage(with_tree(mine, "label", "of_group"), "anchors-by-label")
    mine = mine.select("rid", "label", "vector", "parent", "of_group", _all_parts(F.col("n_rows"), SLICE).alias("slice"))
    theirs = rows.join(sizes, here).select(
        "rid", "label", "vec_id", "vector", _dealt(F.col("n_rows"), SLICE).alias("slice"), _all_parts(F.col("n_anchors"), GROUP).alias("of_group")
    )
    key = ("label", "of_group", "slice")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({name: pa.array([], pa.int64()) for name in ("rid", "positive_id", "positive_row", "positive_score")})
        return best_of_slice(left, right.sort_by("rid"), n)

    found = theirs.groupBy(*key).cogroup(mine.groupBy(*key)).applyInArrow(run, "rid long, positive_id long, positive_row long, positive_score long")
    order = Window.partitionBy("rid").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    entry = F.struct("rank", F.col("positive_score").alias("score"), F.col("positive_id").alias("id"))
    return found.groupBy("rid").agg(F.array_sort(F.collect_list(entry)).alias("best"))


def mine(vectors: DataFrame, anchors: Callable[[Column], Column], rule: Rule = Rule()) -> DataFrame:
    """Per anchor, positive and rank: ids and scores of hard negatives.

    ``vectors`` has rows as :func:`scaled` gives them; ``anchors`` tells from ``vec_id`` whether a row is an anchor.
    """
    rows = stage(vectors.withColumn("rid", F.monotonically_increasing_id()), "scaled-vectors")
    own = rows.where(anchors(F.col("vec_id")))
    best = stage(positives(rows, own, rule.positives), "positives")
    n_rows, n_anchors = F.lit(rows.count()), F.lit(best.count())
    listed = own.join(best.withColumnRenamed("rid", "of_rid"), F.col("rid") == F.col("of_rid")).select(
        "rid", "label", "vector", F.col("best.score").alias("scores"), _dealt(n_anchors, GROUP).alias("of_group")
    )
    listed = stage(with_tree(listed, "of_group"), "anchors-by-group").select("*", _all_parts(n_rows, SLICE).alias("slice"))
    dealt = rows.select("vec_id", "label", "vector", _dealt(n_rows, SLICE).alias("slice"), _all_parts(n_anchors, GROUP).alias("of_group"))
    key = ("of_group", "slice")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({name: pa.array([], pa.int64()) for name in ("rid", "which", "negative_id", "negative_score")})
        return negatives_of_slice(left, right.sort_by("rid"), rule)

    found = dealt.groupBy(*key).cogroup(listed.groupBy(*key)).applyInArrow(run, "rid long, which long, negative_id long, negative_score long")
    order = Window.partitionBy("rid", "which").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rule.negatives)
    named = own.select(F.col("rid").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    named = named.join(best, F.col("anchor_row") == F.col("rid")).drop("rid")
    positive = F.element_at("best", (F.col("which") + 1).cast("int"))
    return found.join(named, F.col("rid") == F.col("anchor_row")).select(
        "anchor_id",
        positive["id"].alias("positive_id"),
        "rank",
        "negative_id",
        positive["score"].alias("positive_score"),
        "negative_score",
    )
