"""Near copies by exact Jaccard similarity of word shingles, added to groups that are already known.

Two texts whose sets of shingles have a Jaccard similarity of at least ``LEAST`` share one of the first
``n - ceil(LEAST * n) + 1`` shingles of either, in any order of all shingles. The order is by hash, but
frequent shingles come last, so that a common line or passage brings no pairs together. Of a long text
only the first ``KEYS`` are taken, if at most a quarter of its shingles, or of its ``LOW`` smallest, are frequent:
then two thirds of the others are shared, and a pair is missed with a chance of 3 ** -24.

Texts that share a key are a cell, and a cell is dealt into blocks, so that no task holds more than two blocks. Pairs in
a block are not written out and compared. A text has a *parity map*: bit k tells whether an odd
number of its shingles fall on k. Maps of two texts differ in at most as many bits as the sets in
shingles, so more bits than a similarity of ``LEAST`` allows rule a pair out for certain. What is left is compared
by whole sets of shingles, in two rounds:

1. Each block by itself gives the links of a spanning forest of its groups, fewer than it has texts. Those that are
   near join groups. A family of near copies is nearly one group after it.
2. In cells that still have several groups, texts outside the cell's largest group meet those in it and each other,
   and every pair that the maps cannot rule out is compared. So no pair of different groups stays unseen.

Defined results: null and empty texts, and texts without words, have no shingles and join nothing. Texts of fewer
words than a shingle have one. Repeated rows are one text. Without documents there are no rows; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlapse.llm.common import split_listed, stage, text_of, utf8_lists
from gridlapse.llm.graph import components
from gridlapse.llm.simhash import shingle_hashes

#: The similarity that makes two texts near, as a fraction.
LEAST = (4, 5)
WORDS = 5
KEYS, LOW = 24, 64
#: A shingle is frequent if it is among the smallest of more texts than this, and of more than one in ``ONE_IN``.
FREQUENT, ONE_IN = 50, 10_000
#: Bits of a parity map for each shingle, rounded up to a power of two, and the most that a map has.
MAP_BITS, MOST_BITS = 4, 1 << 15
#: Texts of a block, and of a batch of whole sets.
BLOCK, ROWS = 1024, 500


def shingles(text: bytes, words_each: int = WORDS) -> np.ndarray:
    """The different shingles' hashes, ascending."""
    return np.unique(shingle_hashes(text, words_each))


def prefix(n: int) -> int:
    """So many first shingles of ``n`` hold one that a near text has, too."""
    over, under = LEAST
    return n + -(over * n) // under + 1 if n else 0


def near_sets(a: np.ndarray, b: np.ndarray) -> bool:
    over, under = LEAST
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * under >= over * (len(a) + len(b) - shared)


def keys_of(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles under which a text is looked for; ``frequent`` is sorted."""
    often = np.isin(found, frequent, assume_unique=True) if len(frequent) else np.zeros(len(found), dtype=bool)
    need = prefix(len(found))
    if 4 * int(often.sum()) <= len(found):
        need = min(need, KEYS)
    return np.concatenate((found[~often], found[often]))[:need]


def keys_of_low(low: np.ndarray, size: int, frequent: np.ndarray) -> np.ndarray | None:
    """The same from the ``LOW`` smallest shingles of ``size``; None if they are too few to tell."""
    if size == len(low):
        return keys_of(low, frequent)
    often = np.isin(low, frequent, assume_unique=True) if len(frequent) else np.zeros(len(low), dtype=bool)
    return low[~often][: min(prefix(size), KEYS)] if 4 * int(often.sum()) <= len(low) else None


def parity_map(found: np.ndarray) -> bytes:
    bits = min(MOST_BITS, 1 << max(6, (MAP_BITS * len(found) - 1).bit_length()))
    flips = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


class Cell:
    """Texts that share a key, by size: which pairs their sizes and parity maps cannot rule out."""

    def __init__(self, sizes: np.ndarray, maps: list[bytes]):
        self.sizes = sizes
        self.width = np.fromiter(map(len, maps), dtype=np.int64, count=len(maps))
        self.place = np.zeros(len(maps), dtype=np.int64)
        self.folded: dict[tuple[int, int], np.ndarray] = {}
        for width in np.unique(self.width):
            at = np.flatnonzero(self.width == width)
            self.place[at] = np.arange(len(at))
            joined = b"".join(maps[i] for i in at)
            self.folded[int(width), int(width)] = np.frombuffer(joined, dtype=np.uint64).reshape(len(at), -1)

    def maps(self, width: int, to: int) -> np.ndarray:
        """Maps of one width, folded to a smaller one."""
        if (width, to) not in self.folded:
            whole = self.folded[width, width]
            self.folded[width, to] = np.bitwise_xor.reduce(whole.reshape(len(whole), width // to, -1), axis=1)
        return self.folded[width, to]

    def like(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that may be near the text ``i``."""
        over, under = LEAST
        small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
        others = others[small * under >= large * over]
        kept = [others[:0]]
        for width in np.unique(self.width[others]):
            at = others[self.width[others] == width]
            to = int(min(width, self.width[i]))
            own = self.maps(int(self.width[i]), to)[self.place[i]]
            apart = np.bitwise_count(self.maps(int(width), to)[self.place[at]] ^ own).sum(axis=1, dtype=np.int64)
            kept.append(at[apart * (under + over) <= (under - over) * (self.sizes[at] + self.sizes[i])])
        return np.concatenate(kept)


def forest(cell: Cell, groups: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that may be near, of which no more than join all groups that such pairs join."""
    label, found = groups.copy(), []
    for i in range(len(label)):
        for j in cell.like(i, np.flatnonzero(label != label[i])):
            if label[j] != label[i]:
                found.append((i, int(j)))
                label[label == label[j]] = label[i]
    return found


def all_pairs(cell: Cell, groups: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """All pairs of different groups that may be near, among ``left`` or between both."""
    found = []
    for k, i in enumerate(left):
        others = left[k + 1 :] if right is None else right
        found += [(int(i), int(j)) for j in cell.like(int(i), others[groups[others] != groups[i]])]
    return found


def _sketched(texts: DataFrame) -> DataFrame:
    """``hash``, number of different shingles, the smallest of them and the parity map, for each text that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in utf8_lists(batches, "text"):
            sizes, low, maps = [], [], []
            for body in bodies:
                found = shingles(body)
                sizes.append(len(found))
                low.append(found[:LOW].view(np.int64).copy())  # not a view that keeps them all
                maps.append(parity_map(found))
            arrays = [batch.column("hash"), pa.array(sizes, pa.int64()), pa.array(low, pa.list_(pa.int64())), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["hash", "size", "low", "map"])

    return texts.mapInArrow(run, "hash long, size long, low array<long>, map binary").where("size > 0")


def _keyed_low(sketches: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``hash``, ``size`` and ``keys``, which are null if the smallest shingles are too few to tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("low"), batch.column("size").to_pylist())
            keys = [keys_of_low(low.values.to_numpy().view(np.uint64), size, frequent) for low, size in rows]
            listed = [None if k is None else k.view(np.int64) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column("hash"), batch.column("size"), pa.array(listed, pa.list_(pa.int64()))], names=["hash", "size", "keys"]
            )

    return sketches.select("hash", "size", "low").mapInArrow(run, "hash long, size long, keys array<long>")


def _keyed(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """The same from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in utf8_lists(batches, "text"):
            sizes, keys = [], []
            for body in bodies:
                found = shingles(body)
                sizes.append(len(found))
                keys.append(keys_of(found, frequent).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["hash", "size", "keys"],
            )

    return texts.mapInArrow(run, "hash long, size long, keys array<long>")


#: What brings texts together: a key, and the blocks that meet; ``kind`` 0 is largest group and others, 1 others and others.
MEETING = ("key", "kind", "lo", "hi")


def _meetings(rows: DataFrame, pairs: Callable[[Cell, np.ndarray, pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """Links ``a``, ``b`` that ``pairs`` finds among the rows of each meeting."""
    columns = [*MEETING, "second", "hash", "size", "group", "map"]

    def linked(cell: pa.Table) -> Iterator[tuple[int, int]]:
        hashes = cell["hash"].to_numpy()
        found = pairs(Cell(cell["size"].to_numpy(), cell["map"].to_pylist()), cell["group"].to_numpy(), cell)
        return ((min(hashes[i], hashes[j]), max(hashes[i], hashes[j])) for i, j in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now]).combine_chunks()
            starts = _starts(now)
            yield _links(linked(now.slice(a, b - a)) for a, b in zip(starts, starts[1:]))
            rest = now.slice(starts[-1])  # the last meeting may go on in the next batch
        if rest is not None:
            yield _links([linked(rest)])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*columns).repartition(parts, *MEETING).sortWithinPartitions(*MEETING, "size", "hash")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _starts(rows: pa.Table) -> np.ndarray:
    keys = np.stack([rows[c].to_numpy() for c in MEETING], axis=1)
    return np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))


def _links(found: Iterator) -> pa.RecordBatch:
    pairs = np.array([pair for links in found for pair in links], dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _alone(rows: DataFrame) -> DataFrame:
    """Round 1: links within each block."""

    def pairs(cell: Cell, groups: np.ndarray, rows: pa.Table) -> list[tuple[int, int]]:
        return forest(cell, groups) if len(groups) > 1 else []

    block = F.pmod(F.xxhash64("hash"), F.ceil(F.col("n") / BLOCK)).cast("long")
    zero = F.lit(0).cast("long")
    return _meetings(rows.select("*", zero.alias("kind"), block.alias("lo"), block.alias("hi"), zero.alias("second")), pairs)


def _across(rows: DataFrame) -> DataFrame:
    """Round 2: all pairs of different groups, but for those that are ruled out."""

    def pairs(cell: Cell, groups: np.ndarray, rows: pa.Table) -> list[tuple[int, int]]:
        second = rows["second"].to_numpy() == 1
        if rows["kind"][0].as_py() == 1 and rows["lo"][0].as_py() == rows["hi"][0].as_py():
            return all_pairs(cell, groups, np.arange(len(groups)), None)
        return all_pairs(cell, groups, np.flatnonzero(second), np.flatnonzero(~second))

    def blocks(n: str) -> Column:
        return F.ceil(F.col(n) / BLOCK).cast("long")

    largest = F.col("group") == F.col("top")
    inner, outer = blocks("n_top"), F.greatest(blocks("n_other"), F.lit(1))
    own = F.pmod(F.xxhash64("hash"), F.when(largest, inner).otherwise(outer))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def meeting(kind: Column, lo: Column, hi: Column, second: Column) -> Column:
        return F.struct(kind.alias("kind"), lo.alias("lo"), hi.alias("hi"), second.alias("second"))

    all_outer, all_inner = F.sequence(zero, outer - 1), F.sequence(zero, inner - 1)
    with_others = F.transform(all_outer, lambda other: meeting(zero, own, other, zero))
    with_largest = F.transform(all_inner, lambda other: meeting(zero, other, own, one))
    among = F.transform(all_outer, lambda other: meeting(one, F.least(own, other), F.greatest(own, other), (own > other).cast("long")))
    met = F.when(largest, with_others).otherwise(F.concat(with_largest, among))
    return _meetings(rows.withColumn("met", F.explode(met)).select("key", "hash", "size", "group", "map", "met.*"), pairs)


def _listed(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts whose hash is in ``wanted``; no others are moved, but for some."""
    may, _ = split_listed(texts, F.col("hash"), wanted, F.col("wanted"))
    return may.join(wanted, F.col("hash") == F.col("wanted"), "left_semi")


def _sets(texts: DataFrame) -> DataFrame:
    """Whole sets by ``hash``; few rows at a time, as those of long texts are large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bodies in utf8_lists(batches, "text"):
            for at in range(0, batch.num_rows, ROWS):
                found = [shingles(body).tobytes() for body in islice(bodies, ROWS)]
                yield pa.RecordBatch.from_arrays([batch.column("hash").slice(at, ROWS), pa.array(found, pa.binary())], names=["hash", "set"])

    return texts.mapInArrow(run, "hash long, set binary").dropDuplicates(["hash"])


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c) for c in ("set_a", "set_b"))
            near = [near_sets(*(np.frombuffer(x.as_py(), dtype=np.uint64) for x in both)) for both in zip(*columns)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose whole sets are near."""
    pairs = stage(pairs, "candidates")
    wanted = stage(pairs.select(F.explode(F.array("a", "b")).alias("wanted")).distinct(), "candidate-texts")
    sets = stage(_sets(_listed(texts, wanted)), "shingle-sets")
    whole = pairs
    for end in "ab":
        whole = whole.join(sets.select(F.col("hash").alias(end), F.col("set").alias(f"set_{end}")), end)
    return _verified(whole.select("a", "b", "set_a", "set_b"))


def _joined(groups: DataFrame, near: DataFrame) -> DataFrame:
    """``groups`` (hash, group) after the near pairs have joined them."""
    for end, name in (("a", "u"), ("b", "v")):
        near = near.join(groups.select(F.col("hash").alias(end), F.col("group").alias(name)), end)
    root = components(stage(near.select("u", "v").distinct(), "group-links"))
    root = stage(root.select(F.col("node").alias("of_group"), "root"), "joined-groups")
    joined = groups.join(root, F.col("group") == F.col("of_group"), "left")
    return stage(joined.select("hash", F.coalesce("root", "group").alias("group")), "text-groups")


def _open_cells(cells: DataFrame, groups: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows of cells that have texts of several groups, with the size of the cell and of its largest group."""
    placed = cells.join(groups.withColumnRenamed("hash", "of_hash"), F.col("hash") == F.col("of_hash")).select("key", "hash", "group")
    several = placed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    several = stage(several.select(F.col("key").alias("open")), "open-keys")
    placed = stage(placed.join(several, F.col("key") == F.col("open"), "left_semi"), "open-cells")
    by_group = placed.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"))
    top = by_group.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "group")).alias("top"))
    top = stage(top.select(F.col("key").alias("of_key"), "n", F.col("top.group").alias("top"), F.col("top.n").alias("n_top")), "cell-sizes")
    sized = placed.join(top.withColumn("n_other", F.col("n") - F.col("n_top")), F.col("key") == F.col("of_key")).drop("of_key")
    maps = sketches.select(F.col("hash").alias("of_hash"), "size", "map")
    return sized.join(maps, F.col("hash") == F.col("of_hash")).drop("of_hash")


def near_groups(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """``hash`` and ``group``: the groups of ``groups``, joined where they hold near texts.

    ``texts`` has ``hash`` and ``text``, ``groups`` one row per hash. Frequent shingles come to the driver, and go to
    every task: one in 10,000 texts at least has each among its 64 smallest, so there are at most 640,000, or 5 MB.
    """
    sketches = stage(_sketched(texts).dropDuplicates(["hash"]), "shingle-sketches")
    counted = sketches.select(F.explode("low").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    bound = max(FREQUENT, groups.count() // ONE_IN)
    often = np.array([r.key for r in counted.where(F.col("n") > bound).select("key").collect()], dtype=np.int64)
    often = np.sort(often.view(np.uint64))
    keyed = stage(_keyed_low(sketches, often), "keys-of-smallest")
    rest = stage(keyed.where("keys is null").select(F.col("hash").alias("wanted")), "texts-of-frequent")
    rest = _keyed(_listed(texts, rest), often).dropDuplicates(["hash"])
    every = keyed.where("keys is not null").unionByName(rest)
    cells = every.select(F.explode("keys").alias("key"), "hash")
    shared = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("shared"))
    cells = stage(cells.join(shared, F.col("key") == F.col("shared"), "left_semi"), "cells")
    for links in (_alone, _across):
        groups = _joined(groups, _near(links(_open_cells(cells, groups, sketches)), texts))
    return groups


def join_near(docs: DataFrame, found: DataFrame, *, text: str = "text") -> DataFrame:
    """``found``, rows of :func:`gridlapse.llm.simhash.near_duplicates`, with groups joined that hold near texts."""
    found = stage(found, "groups")
    texts = docs.select(F.xxhash64(text_of(text)).alias("hash"), F.col(text).cast("string").alias("text"))
    groups = found.groupBy("hash").agg(F.min("group").alias("group"))
    joined = near_groups(texts, stage(groups, "text-groups"))
    by_text = found.groupBy("hash").agg(F.min("component_id").alias("low"))
    rooted = stage(by_text.join(joined.withColumnRenamed("hash", "of_hash"), F.col("hash") == F.col("of_hash")).drop("of_hash"), "rooted")
    lowest = stage(rooted.groupBy("group").agg(F.min("low").alias("lowest")).withColumnRenamed("group", "root"), "lowest-ids")
    named = rooted.join(lowest, F.col("group") == F.col("root")).select(F.col("hash").alias("of_hash"), "root", "lowest")
    columns = [F.col({"component_id": "lowest", "group": "root"}.get(c, c)).alias(c) for c in found.columns]
    return found.join(stage(named, "named-texts"), F.col("hash") == F.col("of_hash")).select(columns)
