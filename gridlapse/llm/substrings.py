"""Removal of long repeated byte strings, in documents of any length and number.

A window is a string of ``length`` bytes; every byte of a window that also starts elsewhere is removed.
This takes the place of prefix doubling. Doubling sorts pairs of ranks of every position, log2(400) times: 870
million positions for half a gigabyte, 14 GB of pairs a round. Here no rank is made from two ranks. Spark brings
equal strings together by 64-bit names at growing lengths, positions whose string is unique drop out, and
names at the full length decide, always together with the name of the round before. The rounds share the work of neighbouring windows:

1. Every window is owned by the position of its smallest 32-byte hash, which equal windows have at the
   same place. About one position in 185 owns windows; the pair is its 32 bytes and its *context*, the
   bytes of all windows that it owns. A unique 32-byte string drops out. If all positions that share it
   have one context, all their windows repeat, and they are decided.
2. Where contexts differ, those that come twice are decided too. For the others, one of each, windows
   are taken in blocks of 32 by their distance to the owner: equal windows are in equal blocks. The
   pair is the owner's 32 bytes and the block's core, 369 bytes that all its windows contain. Unique
   cores drop out; blocks that are equal as a whole are decided.
3. What is left, the blocks at the ends of shared passages, is ranked window by window: the pair is
   the owner's 32 bytes and the window's 400.

Texts are read three times and shuffled, packed, twice: to get the contexts of round 2, and to cut the
documents. Rows that repeat an id with the same text are documents of their own, which repeat each
other. Without documents there are no rows; further columns are left out. A null text is the empty one; texts shorter than a window stay whole; null ids stay null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache as once

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlapse.llm.common import stage, text_of
from gridlapse.plans.stage import fresh_path

LENGTH = 400
GRAM = 32
BLOCK = 32
#: Windows of a document that are worked on together; a longer document is taken in parts.
SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POSITION_BITS = 28


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


@once
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of the base and of its inverse modulo 2**64."""
    numbers = np.frombuffer(hashlib.shake_128(b"byte numbers").digest(2048), dtype="<u8").astype(np.uint64)
    return numbers, _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


class Names:
    """Names of a text's substrings: equal strings of equal length have equal names."""

    def __init__(self, text: np.ndarray):
        size = max(16, int(len(text)).bit_length())
        numbers, self.power, inverse = _tables(1 << size)
        self.sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum(numbers[text] * inverse[: len(text)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.power[start])


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, from running minima to both sides within blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def owners(text: np.ndarray, names: Names, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, and place of every owner of a text's windows."""
    places = np.arange(len(text) - gram + 1)
    grams = names.of(places, places + gram)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    # The leftmost of equal smallest hashes; which one that is depends on the window's bytes alone.
    packed = (grams & ~low) | places.astype(np.uint64)
    own = (_window_minimum(packed, length - gram + 1) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return first, np.diff(np.append(first, len(own))), own[first]


def contexts(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, Names, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part of a text: its start, names, and per owner first window, windows, place, key and context name."""
    text = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, len(text) - length + 1, SEGMENT):
        part = text[at : at + SEGMENT + length - 1]
        names = Names(part)
        first, count, place = owners(part, names, length, gram)
        key = names.of(place, place + gram)
        name = names.of(first, first + count - 1 + length)
        shape = (place - first).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) ^ count.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        yield at, names, first, count, place, key.view(np.int64), _mixed(name ^ shape).view(np.int64)


def blocks(data: bytes, place: int, count: int, length: int = LENGTH, size: int = BLOCK) -> list[tuple[int, int, int, int, int]]:
    """Blocks of a context: number, lowest and highest distance of its windows to the owner, names of core and whole.

    ``place`` is the owner's place in the context, which is also the largest distance.
    """
    names = Names(np.frombuffer(data, dtype=np.uint8))
    lowest = place - count + 1
    number = np.arange(lowest // size, place // size + 1)
    low, high = np.maximum(number * size, lowest), np.minimum(number * size + size - 1, place)
    core = names.of(place - number * size, place - number * size - size + 1 + length)
    whole = names.of(place - high, place - low + length)
    return list(zip(number.tolist(), low.tolist(), high.tolist(), core.view(np.int64).tolist(), whole.view(np.int64).tolist()))


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = text_of(text)
    return docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(body).alias("hash"),
        F.col(doc_id).cast("long").alias("doc_id"),
        body.alias("text"),
    )


def _owned(identified: DataFrame, length: int) -> DataFrame:
    """Key and context of every owner of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            keys, names, rows = [], [], []
            for i in range(batch.num_rows):
                for _, _, _, count, _, key, name in contexts(texts[i].as_py(), length):
                    keys.append(key)
                    names.append(name)
                    rows.append(np.full(len(count), i))
            if keys:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(at), batch.column("hash").take(at), pa.array(np.concatenate(keys)), pa.array(np.concatenate(names))],
                    names=["id", "hash", "key", "context"],
                )

    return identified.select("id", "hash", "text").mapInArrow(run, "id long, hash long, key long, context long")


def _packed(identified: DataFrame) -> DataFrame:
    """Documents with the text compressed, to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [packer.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hash"), batch.column("doc_id"), pa.array(packed, pa.binary())],
                names=["id", "hash", "doc_id", "packed"],
            )

    return identified.mapInArrow(run, "id long, hash long, doc_id long, packed binary")


def _stage_packed(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _context_bytes(packed: DataFrame, listed: DataFrame, length: int) -> DataFrame:
    """The bytes of each listed context, from the document that stands for it."""
    schema = "id long, hash long, key long, context long, copies long, place int, count int, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [c.split()[0] for c in schema.split(", ")]
        types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=columns)

        for batch in batches:
            rows: list[tuple] = []
            for document, hashed, data, wanted in zip(*(batch.column(c) for c in ("id", "hash", "packed", "wanted"))):
                text = zstandard.decompress(data.as_py())
                left = {w["context"]: w["copies"] for w in wanted.as_py()}
                for at, _, first, count, place, key, name in contexts(text, length):
                    for k in np.flatnonzero(np.isin(name, np.fromiter(left, dtype=np.int64, count=len(left)))):
                        copies = left.pop(int(name[k]), None)
                        if copies is not None:
                            a, b = at + int(first[k]), at + int(first[k] + count[k]) - 1 + length
                            rows.append((document.as_py(), hashed.as_py(), int(key[k]), int(name[k]), copies, int(place[k] - first[k]), int(count[k]), text[a:b]))
                if len(rows) >= 4096:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    wanted = listed.groupBy("id", "hash").agg(F.collect_list(F.struct("context", "copies")).alias("wanted"))
    wanted = wanted.select(F.col("id").alias("of_id"), F.col("hash").alias("of_hash"), "wanted")
    # Equal rows are one document here.
    joined = packed.drop("doc_id").join(wanted, (F.col("id") == F.col("of_id")) & (F.col("hash") == F.col("of_hash")))
    return joined.select("id", "hash", "packed", "wanted").mapInArrow(run, schema).dropDuplicates(["key", "context"])


def _blocks(found: DataFrame, length: int) -> DataFrame:
    schema = "key long, context long, number int, low int, high int, core long, whole long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [c.split()[0] for c in schema.split(", ")]
        types = [pa.int64()] * 2 + [pa.int32()] * 3 + [pa.int64()] * 2
        for batch in batches:
            rows = [
                (key, context, *block)
                for key, context, place, count, data in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "place", "count", "bytes")))
                for block in blocks(data, place, count, length)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=columns)

    return found.select("key", "context", "place", "count", "bytes").mapInArrow(run, schema)


def _windows(found: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Names of the windows of the wanted blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names, out = [], [], []
            for key, context, place, data, ranges in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "place", "bytes", "ranges"))):
                all_names = Names(np.frombuffer(data, dtype=np.uint8))
                distance = np.concatenate([np.arange(r["low"], r["high"] + 1) for r in ranges])
                names.append(all_names.of(place - distance, place - distance + length).view(np.int64))
                keys.append(np.stack((np.full(len(distance), key), np.full(len(distance), context), distance)))
            if keys:
                out = np.concatenate(keys, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0]), pa.array(out[1]), pa.array(out[2].astype(np.int32)), pa.array(np.concatenate(names))],
                    names=["key", "context", "distance", "name"],
                )

    ranges = wanted.groupBy(F.col("key").alias("of_key"), F.col("context").alias("of_context")).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    joined = found.join(ranges, (F.col("key") == F.col("of_key")) & (F.col("context") == F.col("of_context")))
    return joined.select("key", "context", "place", "bytes", "ranges").mapInArrow(run, "key long, context long, distance int, name long")


def _coming_again(rows: DataFrame, *by: str) -> DataFrame:
    """Pairs that more than one row has; written first, so that a join with them can split hot ones."""
    again = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return stage(again.select(*[F.col(c).alias(f"again_{c}") for c in by]), "pairs-again")


def _matches(rows: DataFrame, again: DataFrame, *by: str, how: str = "left_semi") -> DataFrame:
    test = None
    for c in by:
        same = F.col(c) == F.col(f"again_{c}")
        test = same if test is None else test & same
    return rows.join(again, test, how)


def repeated_windows(identified: DataFrame, packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Repeated windows per document: ``id``, ``hash``, ``context``, and the range ``low`` to ``high`` of distances to the owner.

    A range of -1 to -1 is all windows of the context, wherever it is in the document.
    """
    owned = stage(_owned(identified, length), "owned")
    keys = owned.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), (F.min("context") < F.max("context")).alias("mixed"))
    keys = stage(keys.where("rows > 1").select(F.col("key").alias("again"), "mixed"), "keys-again")
    again = stage(owned.join(keys, F.col("key") == F.col("again")).select("id", "hash", "key", "context", "mixed"), "owned-again")
    listed = again.where("mixed").groupBy("key", "context").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "hash")).alias("one")
    )
    listed = stage(listed.select("key", "context", "copies", "one.id", "one.hash"), "contexts")
    copied = listed.where("copies > 1").select(F.col("key").alias("again_key"), F.col("context").alias("again_context"))
    whole = again.where("not mixed").unionByName(_matches(again.where("mixed"), copied, "key", "context"))
    whole = whole.select("id", "hash", "context", F.lit(-1).alias("low"), F.lit(-1).alias("high")).distinct()

    found = _stage_packed(_context_bytes(packed, listed, length), "context-bytes")
    cut = stage(_blocks(found, length), "blocks")
    cut = stage(_matches(cut, _coming_again(cut, "key", "number", "core"), "key", "number", "core"), "blocks-again")
    equal = _coming_again(cut, "key", "low", "high", "whole")
    decided = _matches(cut, equal, "key", "low", "high", "whole")
    left = stage(_matches(cut, equal, "key", "low", "high", "whole", how="left_anti"), "blocks-left")
    # Blocks that share a core with one that is left are compared too, one of each equal ones.
    near = left.select(F.col("key").alias("again_key"), F.col("number").alias("again_number"), F.col("core").alias("again_core")).distinct()
    others = _matches(decided, near, "key", "number", "core").groupBy("key", "low", "high", "whole").agg(F.min("context").alias("context"))
    wanted = left.select("key", "context", "low", "high").unionByName(others.select("key", "context", "low", "high"))
    windows = stage(_windows(found, wanted, length), "windows")
    single = _matches(windows, _coming_again(windows, "key", "name"), "key", "name")
    ranges = decided.select("key", "context", "low", "high").unionByName(
        single.select("key", "context", F.col("distance").alias("low"), F.col("distance").alias("high"))
    )
    alone = listed.where("copies = 1").select(F.col("key").alias("again_key"), F.col("context").alias("again_context"), "id", "hash")
    part = _matches(ranges, alone, "key", "context", how="inner").select("id", "hash", "context", "low", "high")
    return whole.unionByName(part)


def covered(data: bytes, ranges: dict[int, list[tuple[int, int]]], length: int) -> np.ndarray:
    """Whether each byte lies in a repeated window."""
    edges = np.zeros(len(data) + 1, dtype=np.int64)
    known = np.fromiter(ranges, dtype=np.int64, count=len(ranges))
    for at, _, first, count, place, _, name in contexts(data, length):
        for k in np.flatnonzero(np.isin(name, known)):
            for low, high in ranges[int(name[k])]:
                a, b = (first[k], first[k] + count[k] - 1) if low < 0 else (place[k] - high, place[k] - low)
                edges[at + a] += 1
                edges[at + b + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_bytes``, the removed ``spans`` (start and end) and ``kept``, the remaining bytes."""
    identified = _identified(docs, doc_id, text)
    packed = _packed(identified)
    repeats = repeated_windows(identified, packed, length)
    listed = repeats.groupBy(F.col("id").alias("of_id"), F.col("hash").alias("of_hash")).agg(
        F.collect_list(F.struct("context", "low", "high")).alias("ranges")
    )
    listed = stage(listed, "ranges")
    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for data, ranges in zip(batch.column("packed"), batch.column("ranges")):
                body = zstandard.decompress(data.as_py())
                sizes.append(len(body))
                if not ranges.is_valid:
                    spans.append([])
                    kept.append(body)
                    continue
                by_context: dict[int, list[tuple[int, int]]] = {}
                for r in ranges.as_py():
                    by_context.setdefault(r["context"], []).append((r["low"], r["high"]))
                gone = covered(body, by_context, length)
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
                kept.append(np.frombuffer(body, dtype=np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    joined = packed.join(listed, (F.col("id") == F.col("of_id")) & (F.col("hash") == F.col("of_hash")), "left")
    return joined.select("doc_id", "packed", "ranges").mapInArrow(run, schema)
