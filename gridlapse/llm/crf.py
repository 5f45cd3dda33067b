"""Quality classifier: a linear-chain conditional random field labels each line good or bad.

A line is described by binned shares of its characters and words, and by the bins of the lines before
and after it. The field's marginals, by the forward-backward recursion over all lines of a document, are
averaged by line length, and a logistic curve of that mean gives the document's score.

Labels are per document. Lines of good documents count as good; in bad documents the lines' own labels
are unknown, so training alternates between fitting the field and labelling the lines of bad documents
by their marginals, at least the worst one as bad. Training uses a bounded sample: of each label, at most
``sample`` labelled documents, those whose id has the smallest digest, and of the sampled lines at most
``lines``. Their line features come to the driver, where the field is fitted; scoring goes over all
documents in the tasks. The text is the only input of a score.

Defined results: a null or empty text is one empty line; label rows with null id or label don't count, and
of several labels for an id the lowest does; with no labelled rows, or of one label only, every score is
the share of good ones, 0.5 without any. Null ids stay, rows that repeat an id are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlapse.llm.common import stage, utf8, utf8_lists

SAMPLE = 2000
LINES = 200_000
BINS = 8
ROUNDS = 3
STEPS = 120
PENALTY = 1e-3
#: Bytes of text whose lines are worked on together.
CHUNK = 2 << 20

# Character classes, one table column each.
_CLASSES = ("upper", "lower", "digit", "space", "stop", "quote", "other", "beyond")
_ASCII = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "digit": "0123456789",
    "space": " \t\r\x0b\x0c",
    "stop": ".,;:?",
    "quote": "'\"()-",
}
FEATURES = (*_CLASSES, "length", "word_length", "different_words", "commonest_word", "same_line", "word_ends")


def _class_table() -> np.ndarray:
    table = np.full(256, _CLASSES.index("other"), dtype=np.uint8)
    for name, characters in _ASCII.items():
        table[[ord(c) for c in characters]] = _CLASSES.index(name)
    table[128:] = _CLASSES.index("beyond")
    return table


CLASS_OF = _class_table()


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature values, one row per line, and the lines' lengths in bytes."""
    lines = text.split(b"\n")
    length = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    values = np.zeros((len(lines), len(FEATURES)))
    codes = CLASS_OF[np.frombuffer(text, dtype=np.uint8)]
    line_of = np.repeat(np.arange(len(lines)), length + 1)[:-1]  # each line's break belongs to it
    counts = np.bincount(line_of * len(_CLASSES) + codes, minlength=len(lines) * len(_CLASSES)).reshape(-1, len(_CLASSES))
    # The breaks were counted as "other" characters.
    counts[:-1, _CLASSES.index("other")] -= 1
    values[:, : len(_CLASSES)] = counts / np.maximum(length, 1)[:, None]
    repeats = Counter(lines)
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            different = Counter(words)
            stems = sum(w[-1:].isalnum() or w[-1] >= 128 for w in words)
            values[i, len(_CLASSES) :] = (
                np.log2(1 + len(line)),
                len(line) / n,
                len(different) / n,
                (max(different.values()) - 1) / n,
                repeats[line] - 1 if len(line) > 3 else 0,
                stems / n,
            )
    return values, length


@dataclass
class Model:
    cuts: np.ndarray  # feature by bin
    weights: np.ndarray  # for being bad: line before, line, line after; feature; bin
    edge: np.ndarray  # for being bad: no line before, none after
    bias: float
    moves: np.ndarray  # label by next label, 0 good and 1 bad
    curve: tuple[float, float]  # slope and offset of the score

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, values.T)], axis=1)


def _neighbours(bins: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the lines before and after each line, and whether there is none."""
    n = len(bins)
    first = np.zeros(n, dtype=bool)
    last = np.zeros(n, dtype=bool)
    first[starts] = True
    last[starts + sizes - 1] = True
    before = np.maximum(np.arange(n) - 1, 0)
    after = np.minimum(np.arange(n) + 1, n - 1)
    return before, after, first, last


def _emissions(model: Model, bins: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Score of each line for being bad rather than good, from its own and its neighbours' bins."""
    before, after, first, last = _neighbours(bins, starts, sizes)
    columns = np.arange(bins.shape[1])
    own = [model.weights[k][columns, bins].sum(axis=1) for k in range(3)]
    score = model.bias + own[1]
    score += np.where(first, model.edge[0], own[0][before])
    return score + np.where(last, model.edge[1], own[2][after])


def marginals(
    score: np.ndarray, moves: np.ndarray, starts: np.ndarray, sizes: np.ndarray, weight: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each line to be bad, and the expected moves between labels; all documents step by step together.

    With ``weight``, a move counts as much as the line it leads to.
    """
    order = np.argsort(-sizes, kind="stable")
    at, length = starts[order], sizes[order]
    n = len(score)
    local = np.zeros((n, 2))
    local[:, 1] = score
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    for step in range(int(length[0])):
        rows = at[: int((length > step).sum())] + step
        if step == 0:
            forward[rows] = local[rows]
        else:
            both = forward[rows - 1][:, :, None] + moves[None]
            forward[rows] = local[rows] + np.logaddexp(both[:, 0], both[:, 1])
            forward[rows] -= forward[rows].max(axis=1, keepdims=True)
    for step in range(int(length[0]) - 1, 0, -1):
        rows = at[: int((length > step).sum())] + step
        both = (backward[rows] + local[rows])[:, None, :] + moves[None]
        backward[rows - 1] = np.logaddexp(both[:, :, 0], both[:, :, 1])
        backward[rows - 1] -= backward[rows - 1].max(axis=1, keepdims=True)
    total = forward + backward
    total -= total.max(axis=1, keepdims=True)
    chance = np.exp(total)
    bad = chance[:, 1] / chance.sum(axis=1)
    inner = np.ones(n, dtype=bool)
    inner[starts] = False
    rows = np.flatnonzero(inner)
    pairs = forward[rows - 1][:, :, None] + moves[None] + (local[rows] + backward[rows])[:, None, :]
    pairs = np.exp(pairs - pairs.max(axis=(1, 2), keepdims=True))
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return bad, pairs.sum(axis=0) if weight is None else np.tensordot(weight[rows], pairs, axes=1)


def _badness(model: Model, values: np.ndarray, length: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' chances to be bad, per document."""
    bad, _ = marginals(_emissions(model, model.bins(values), starts, sizes), model.moves, starts, sizes)
    weight = length + 1.0
    return np.add.reduceat(bad * weight, starts) / np.add.reduceat(weight, starts)


def _curve(model_curve: tuple[float, float], badness: np.ndarray) -> np.ndarray:
    slope, offset = model_curve
    x = np.log(badness + 1e-4) - np.log(1 - badness + 1e-4)
    return 1 / (1 + np.exp(np.clip(slope * x + offset, -30, 30)))


def fit(documents: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, good_share: float | None = None) -> Model:
    """Fit the field and the curve to documents given as line features and lengths, and their labels.

    The field weighs both labels alike. The curve's score is a chance among documents of which
    ``good_share`` are good; if it isn't given, that is the sample's share.
    """
    sizes = np.array([len(length) for _, length in documents])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    values = np.concatenate([v for v, _ in documents])
    length = np.concatenate([n for _, n in documents])
    document_of = np.repeat(np.arange(len(sizes)), sizes)
    cuts = np.quantile(values, np.arange(1, BINS) / BINS, axis=0).T
    features = values.shape[1]
    model = Model(cuts, np.zeros((3, features, BINS)), np.zeros(2), 0.0, np.zeros((2, 2)), (1.0, 0.0))
    bins = model.bins(values)
    before, after, first, last = _neighbours(bins, starts, sizes)
    flat = bins + np.arange(features) * BINS
    inner = np.flatnonzero(~first)
    target = np.repeat(~good, sizes).astype(float)
    # Each label counts as much as the other, whatever the sample's shares.
    weight_of = np.where(good, 0.5 / max(1, good.sum()), 0.5 / max(1, (~good).sum()))
    line_weight = weight_of[document_of] * len(good) / sizes[document_of] ** 0.5
    scale = line_weight.sum()
    for _ in range(ROUNDS):
        hard = target > 0.5
        state = [np.zeros_like(x) for x in (model.weights, model.edge, np.zeros(1), model.moves)]
        speed = [np.zeros_like(x) for x in state]
        for step in range(1, STEPS + 1):
            bad, expected = marginals(_emissions(model, bins, starts, sizes), model.moves, starts, sizes, line_weight)
            error = (bad - target) * line_weight
            grad = np.zeros_like(model.weights)
            for k, (rows, kept) in enumerate(((before, ~first), (np.arange(len(bad)), np.ones(len(bad), bool)), (after, ~last))):
                shown = flat[rows[kept]]
                sums = np.bincount(shown.ravel(), np.repeat(error[kept], features), minlength=features * BINS)
                grad[k] = sums.reshape(features, BINS)
            edge = np.array([error[first].sum(), error[last].sum()])
            # Moves: expected from the field's pairs against the labels given, weighted like the lines.
            given = np.zeros((2, 2))
            w = line_weight[inner]
            for a in (0, 1):
                for b in (0, 1):
                    given[a, b] = (w * (hard[inner - 1] == a) * (hard[inner] == b)).sum()
            grads = [
                grad / scale + PENALTY * model.weights,
                edge / scale + PENALTY * model.edge,
                np.array([error.sum() / scale]),
                (expected - given) / scale + PENALTY * model.moves,
            ]
            now = [model.weights, model.edge, np.array([model.bias]), model.moves]
            rate = 0.2 * (1 - step / (STEPS + 1)) + 0.01
            for i, (x, g) in enumerate(zip(now, grads)):
                state[i] = 0.9 * state[i] + 0.1 * g
                speed[i] = 0.99 * speed[i] + 0.01 * g * g
                x -= rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(speed[i] / (1 - 0.99**step)) + 1e-8)
            model.bias = float(now[2][0])
        bad, _ = marginals(_emissions(model, bins, starts, sizes), model.moves, starts, sizes)
        worst = np.zeros(len(bad), dtype=bool)
        by_document = np.lexsort((-bad, document_of))
        worst[by_document[starts]] = True
        target = np.where(np.repeat(good, sizes), 0.0, (bad > 0.5) | worst).astype(float)
    badness = _badness(model, values, length, starts, sizes)
    x = np.log(badness + 1e-4) - np.log(1 - badness + 1e-4)
    share = good.mean() if good_share is None else good_share
    weight_of = np.where(good, share / max(1, good.sum()), (1 - share) / max(1, (~good).sum()))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton's method for the two numbers, with a light penalty
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))  # chance to be bad
        g = np.array([(weight_of * (p - ~good) * x).sum() + 1e-3 * slope, (weight_of * (p - ~good)).sum()])
        h = weight_of * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, g)
        slope, offset = slope - move[0], offset - move[1]
        if np.abs(move).max() < 1e-6:
            break
    model.curve = (float(slope), float(offset))
    return model


def _chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text) + 1000
        if size >= CHUNK:
            yield some
            some, size = [], 0
    if some:
        yield some


def scores(texts: Iterable[bytes], model: Model) -> np.ndarray:
    found = [np.empty(0)]
    for chunk in _chunks(texts):
        some = [line_features(t) for t in chunk]
        sizes = np.array([len(length) for _, length in some])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        badness = _badness(model, np.concatenate([v for v, _ in some]), np.concatenate([n for _, n in some]), starts, sizes)
        found.append(_curve(model.curve, badness))
    return np.concatenate(found)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample: int = SAMPLE,
    lines: int = LINES,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> Model | float:
    """The fitted model, or the constant score if there aren't labels of both kinds.

    It is fitted on at most ``sample`` documents of each label, chosen by a hash of their ids, and ``lines`` of
    their lines. Both bounds hold before features are made: of rows that repeat an id one is taken, and documents are taken in the
    order of another hash until the lines are used up.
    """
    labelled = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(doc_id)))
    labelled = labelled.groupBy(F.col(doc_id).cast("long").alias("_id")).agg(F.min(label).alias("_label"))
    labelled = stage(labelled, "quality-labels")
    counts = {row[0]: row[1] for row in labelled.groupBy("_label").count().collect()}
    order = F.md5(F.col("_id").cast("string"))
    chosen = None
    for value in (0, 1):
        some = labelled.where(F.col("_label") == value).orderBy(order, "_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"))
    texts = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_label")
    # One row of each id, and as many ids as the lines allow; the last document may be cut. At most twice ``sample`` rows come back.
    known = texts.select("doc_id", F.xxhash64("text").alias("hash"), (F.regexp_count("text", F.lit("\n")) + 1).alias("n"))
    known = known.groupBy("doc_id").agg(F.min(F.struct("hash", "n")).alias("one")).select("doc_id", "one.hash", "one.n").collect()
    wanted, left = [], lines
    for row in sorted(known, key=lambda r: (r["doc_id"] * 2654435761) % (1 << 32)):
        if left > 0:
            wanted.append((row["doc_id"], row["hash"], min(row["n"], left)))
            left -= row["n"]
    taken = F.broadcast(docs.sparkSession.createDataFrame(wanted, "_id long, _hash long, _lines int"))
    texts = texts.join(taken, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in utf8_lists(batches, "text"):
            found = [line_features(b"\n".join(t.split(b"\n", n)[:n])) for t, n in zip(bodies, batch.column("_lines").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("_label").cast(pa.int32()),
                    pa.array([v.astype("<f4").tobytes() for v, _ in found], pa.binary()),
                    pa.array([n.astype("<i8").tobytes() for _, n in found], pa.binary()),
                ],
                names=["doc_id", "label", "features", "lengths"],
            )

    described_rows = texts.select("doc_id", "text", "_label", "_lines").mapInArrow(described, "doc_id long, label int, features binary, lengths binary")
    rows = {r[0]: r for r in described_rows.dropDuplicates(["doc_id"]).collect()}
    kept = []
    for doc in (w[0] for w in wanted):
        row = rows[doc]
        length = np.frombuffer(row[3], dtype="<i8")
        kept.append((np.frombuffer(row[2], dtype="<f4").reshape(len(length), -1).astype(float), length, row[1]))
    good = np.array([k[2] == 1 for k in kept], dtype=bool)
    if good.all() or not good.any():
        return float(good.mean()) if len(good) else 0.5
    return fit([(v, n) for v, n, _ in kept], good, counts.get(1, 0) / sum(counts.values()))


def score(
    docs: DataFrame, model: Model | float, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7
) -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``score`` and ``predicted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in utf8_lists(batches, "text"):
            found = scores(texts, model) if isinstance(model, Model) else np.full(batch.num_rows, model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = kept.mapInArrow(run, "doc_id long, score double")
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def keep_good(docs: DataFrame, model: Model | float, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The documents that score at least ``threshold``, in their own columns and one pass."""
    names = docs.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(place))
            found = scores(texts, model) if isinstance(model, Model) else np.full(batch.num_rows, model)
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, docs.schema)
