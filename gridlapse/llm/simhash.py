"""SimHash near duplicates: bit-count cells find pairs that may be near, exact distances decide.

A fingerprint is cut into segments and mapped to the number of ones in each. The Manhattan distance
of two such vectors is a lower bound of the fingerprints' Hamming distance, so a pair within
``max_bits`` has vectors within ``max_bits``, and in one of ``parts`` parts of the segments
within ``max_bits // parts``. Each part is a grid whose cells are the vectors themselves. A fingerprint
is put into every cell that is at most half that distance, rounded up, from its own; two vectors within
it share a cell that lies between them. Fingerprints meet in cells, pairs pass the bound over all segments, and
the rest is compared exactly.

Equal fingerprints are one from the start. A cell's fingerprints are dealt into blocks by their hash,
so that no task holds more than two blocks of a cell, and a pair of blocks gives at most as many links
as it has fingerprints: those of a spanning forest, which keeps every connection without all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlapse.llm.common import split_listed, stage, text_of, utf8_lists
from gridlapse.llm.graph import components

SEED = 42
BITS = 64
#: Fingerprints of one cell that are compared in one step.
BLOCK = 2048
#: Hashes whose bits are counted in one step.
STEP = 1 << 15
SMALL = 24


def shingle_hashes(text: bytes, words_each: int) -> np.ndarray:
    """64-bit hashes of a text's word shingles, in their order; a text of fewer words is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words_each, len(words))
    count = len(words) - k + 1
    ends = ends[k - 1 :].tolist()
    starts = starts[:count].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), dtype="<u8", count=count)


def fingerprint_of(text: bytes, words_each: int, repeats: bool = True) -> int:
    """64-bit SimHash of a text's word shingles; ``repeats`` counts each as often as it comes, else once."""
    hashes = shingle_hashes(text, words_each)
    if not len(hashes):
        return 0
    if not repeats:
        hashes = np.unique(hashes)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), STEP):
        bits = np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    set_bits = np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little")
    return int(set_bits.view("<u8")[0])


@dataclass(frozen=True)
class Rule:
    """When two documents are near: fingerprints of ``words``-word shingles within ``max_bits``.

    ``parts`` and ``width`` shape the grid. With ``check_words``, fingerprints of shingles of that many
    words must be within ``check_bits`` too, for a search that is wider than one fingerprint can decide.
    """

    words: int = 4
    repeats: bool = True
    max_bits: int = 4
    parts: int = 2
    width: int = 2
    check_words: int | None = None
    check_bits: int = 0

    @property
    def columns(self) -> tuple[str, ...]:
        return ("fp",) if self.check_words is None else ("fp", "check")


def fingerprints(docs: DataFrame, rule: Rule, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``hash`` of the text, and its fingerprints as signed longs. A null or wordless text has 0."""
    names = ["doc_id", "hash", *rule.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in utf8_lists(batches, "text"):
            found = np.empty((len(rule.columns), batch.num_rows), dtype=np.uint64)
            for i, text in enumerate(texts):
                found[0, i] = fingerprint_of(text, rule.words, rule.repeats)
                if rule.check_words is not None:
                    found[1, i] = fingerprint_of(text, rule.check_words)
            columns = [pa.array(f) for f in found.view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *columns], names=names)

    kept = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("hash"), F.col(text).cast("string").alias("text")
    )
    return kept.mapInArrow(run, ", ".join(f"{n} long" for n in names))


class Grid:
    """Cells of fingerprints in the space of segment bit counts, which is cut into parts."""

    def __init__(self, rule: Rule):
        if BITS % rule.width:
            raise ValueError("the segment width must divide 64")
        self.rule, self.segments = rule, BITS // rule.width
        self.reach = (rule.max_bits // rule.parts + 1) // 2  # steps from a vector to its cells
        cuts = [self.segments * k // rule.parts for k in range(rule.parts + 1)]
        self.parts = list(zip(cuts, cuts[1:]))

    def counts(self, fps: np.ndarray) -> np.ndarray:
        """Bit counts, one row per fingerprint and one column per segment."""
        shifts = np.arange(self.segments, dtype=np.uint64) * np.uint64(self.rule.width)
        parts = (fps.view(np.uint64)[:, None] >> shifts[None, :]) & np.uint64((1 << self.rule.width) - 1)
        return np.bitwise_count(parts).astype(np.int8)

    def steps(self, segments: int) -> list[tuple[tuple[int, int], ...]]:
        """All moves of at most ``reach`` steps within a part: (segment, change) pairs."""
        moves: set[tuple[tuple[int, int], ...]] = {()}
        for _ in range(self.reach):
            longer = set()
            for move in moves:
                for segment in range(segments):
                    for change in (-1, 1):
                        total = dict(move)
                        total[segment] = total.get(segment, 0) + change
                        longer.add(tuple(sorted((s, c) for s, c in total.items() if c)))
            moves |= longer
        return sorted(moves)

    def cells(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell of every fingerprint; a cell is its part and its counts as one number."""
        counts = self.counts(fps).astype(np.int64)
        rows, cells = [], []
        for side, (begin, end) in enumerate(self.parts):
            weights = np.array([(self.rule.width + 1) ** s for s in range(end - begin)], dtype=np.int64)
            own = counts[:, begin:end]
            number = own @ weights
            for move in self.steps(end - begin):
                fits = np.ones(len(fps), dtype=bool)
                for segment, change in move:
                    fits &= (own[:, segment] + change >= 0) & (own[:, segment] + change <= self.rule.width)
                at = np.flatnonzero(fits)
                rows.append(at)
                cells.append((number[at] + sum(int(weights[s]) * c for s, c in move)) * self.rule.parts + side)
        return np.concatenate(rows), np.concatenate(cells)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows of ``a`` and ``b`` that are near: first the bound from the bit counts, then exact distances."""
        kept = np.flatnonzero(np.abs(self.counts(a[:, 0]) - self.counts(b[:, 0])).sum(axis=1) <= self.rule.max_bits)
        return kept[self.exact(a[kept], b[kept])]

    def exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        far = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64))
        good = far[..., 0] <= self.rule.max_bits
        return good if self.rule.check_words is None else good & (far[..., 1] <= self.rule.check_bits)


def forest(grid: Grid, left: np.ndarray, right: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the links of a spanning forest of the near pairs, within ``left`` or between both."""
    both = left if right is None else np.concatenate((left, right))
    label = np.arange(len(both))
    us, vs = [], []
    for i in range(len(left)):
        others = np.arange(i + 1, len(left)) if right is None else np.arange(len(left), len(both))
        others = others[label[others] != label[i]]
        for j in others[grid.exact(both[others], both[i : i + 1])]:
            if label[j] != label[i]:
                us.append(i)
                vs.append(int(j))
                label[label == label[j]] = label[i]
    return np.array(us, dtype=np.int64), np.array(vs, dtype=np.int64)


def links(distinct: DataFrame, rule: Rule, *, block: int = BLOCK) -> DataFrame:
    """Links between different fingerprints that connect all that are near.

    ``distinct`` has one row per combination of the rule's columns; a link has each of them twice, with
    the suffixes ``_u`` and ``_v``.
    """
    grid, payload = Grid(rule), rule.columns
    ends = [f"{c}_{end}" for end in "uv" for c in payload]
    schema = ", ".join(f"{c} long" for c in ends)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in payload]
            for at in range(0, batch.num_rows, 4096):
                rows, cells = grid.cells(columns[0][at : at + 4096])
                arrays = [pa.array(cells), *(pa.array(c[at : at + 4096][rows]) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=["cell", *payload])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("cell", "lo", "hi", "second", *payload)
        rest = np.empty((0, len(columns)), dtype=np.int64)
        for batch in batches:
            now = np.concatenate((rest, np.stack([batch.column(c).to_numpy() for c in columns], axis=1)))
            last = np.flatnonzero(_new_group(now))[-1]  # the last group may go on in the next batch
            rest = now[last:]
            yield _linked(grid, now[:last], ends)
        yield _linked(grid, rest, ends)

    cells = distinct.select(*payload).mapInArrow(to_cells, ", ".join(f"{c} long" for c in ("cell", *payload)))
    full = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    full = stage(full.select(F.col("cell").alias("full"), F.ceil(F.col("n") / block).alias("blocks")), "full-cells")
    dealt = cells.join(full, F.col("cell") == F.col("full"), "left").select(
        "cell", *payload, F.coalesce("blocks", F.lit(1)).cast("long").alias("blocks")
    )
    own = F.pmod(F.xxhash64(*payload), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meets = dealt.select("cell", *payload, own.alias("own"), other.alias("other")).select(
        "cell",
        F.least("own", "other").alias("lo"),
        F.greatest("own", "other").alias("hi"),
        (F.col("own") > F.col("other")).cast("long").alias("second"),
        *payload,
    )
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_cells = meets.repartition(parts, "cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "second", *payload)
    return sorted_cells.mapInArrow(compare, schema).distinct()


def _new_group(rows: np.ndarray) -> np.ndarray:
    """Whether a row's cell and blocks differ from those of the row before."""
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return first


def _linked(grid: Grid, rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Links of whole groups: all pairs at once for groups of equal small size, a forest for each other one."""
    prints = np.ascontiguousarray(rows[:, 4:])
    start = np.flatnonzero(_new_group(rows))
    size = np.diff(np.append(start, len(rows)))
    alone = rows[start, 1] == rows[start, 2]  # one block with itself
    us, vs = [prints[:0]], [prints[:0]]
    for n in np.unique(size[alone & (size > 1) & (size <= SMALL)]):
        at = start[alone & (size == n)]
        for i, j in combinations(range(int(n)), 2):
            u, v = prints[at + i], prints[at + j]
            kept = grid.near(u, v)
            us.append(u[kept])
            vs.append(v[kept])
    for k in np.flatnonzero((size > 1) & ~(alone & (size <= SMALL))):
        group = prints[start[k] : start[k] + size[k]]
        cut = size[k] if alone[k] else size[k] - int(rows[start[k] : start[k] + size[k], 3].sum())
        u, v = forest(grid, group[:cut], None if alone[k] else group[cut:])
        us.append(group[u])
        vs.append(group[v])
    both = np.concatenate((np.concatenate(us), np.concatenate(vs)), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[:, c]) for c in range(both.shape[1])], names=names)


def near_duplicates(
    docs: DataFrame, rule: Rule = Rule(), *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """``doc_id``, ``hash`` of the text, fingerprints, ``group`` and ``component_id``.

    ``component_id`` is the smallest id of the documents that a row is connected to, ``group`` names the
    same component. Rows that repeat an id are kept, each with its own fingerprint. A null id counts as
    no id: its row has the component of its fingerprint, which is null if no id reaches it. Null and empty texts have
    fingerprint 0; texts are read whole, whatever their length; without documents there are no rows. Further columns are left out.
    """
    own = stage(fingerprints(docs, rule, doc_id=doc_id, text=text), "fingerprints")
    columns = rule.columns
    node = F.col("fp") if len(columns) == 1 else F.xxhash64(*columns)
    own = own.withColumn("node", node)
    distinct = own.groupBy("node", *columns).agg(F.min("doc_id").alias("first_id"))
    distinct = stage(distinct, "distinct-fingerprints")
    found = links(distinct, rule, block=block)
    for end in "uv":
        names = [f"{c}_{end}" for c in columns]
        found = found.withColumn(end, F.col(names[0]) if len(names) == 1 else F.xxhash64(*names))
    root = components(found.select("u", "v")).withColumnRenamed("node", "linked")
    rooted = distinct.join(root, F.col("node") == F.col("linked"), "left").select(
        "node", "first_id", F.coalesce("root", "node").alias("group")
    )
    lowest = rooted.groupBy("group").agg(F.min("first_id").alias("component_id"))
    named = stage(rooted.join(lowest, "group").select(F.col("node").alias("named"), "group", "component_id").distinct(), "components")
    return own.join(named, F.col("node") == F.col("named"), "left").select("doc_id", "hash", *columns, "group", "component_id")


def keep_one(docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of ``found``, in the columns of ``docs``.

    The one with the smallest id stays, among equal ids the one with the smallest text hash, and of
    equal rows one. Null ids are larger than any other. Only what goes, and the kept rows that come
    more than once, are listed and joined with the documents, of which those that surely aren't listed stay where they are.
    """
    found = stage(found.select("doc_id", "hash", "group"), "grouped")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("hash").alias("hash"))
    first = found.groupBy("group").agg(F.min(place).alias("first"))
    first = stage(first.select(F.col("group").alias("of_group"), F.col("first.id").alias("first_id"), F.col("first.hash").alias("first_hash")), "firsts")
    marked = found.join(first, F.col("group") == F.col("of_group")).withColumn(
        "first", F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))
    )
    listed = marked.groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).agg(
        F.max("first").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    listed = listed.where("not _first or _rows > 1")
    other = stage(listed.select("_id", "_hash"), "gone-or-repeated")
    repeated = stage(listed.where("_first").select("_id", "_hash"), "repeated")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(doc_id).cast("long").alias("own_id"), F.xxhash64(text_of(text)).alias("own_hash"))
    same = F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_hash") == F.col("_hash"))
    may, others = split_listed(keyed, F.xxhash64("own_id", "own_hash"), other, F.xxhash64("_id", "_hash"))
    once = others.unionByName(may.join(other, same, "left_anti"))
    again = may.join(repeated, same, "left_semi").dropDuplicates(["own_id", "own_hash"])
    return once.unionByName(again).select("row.*")
