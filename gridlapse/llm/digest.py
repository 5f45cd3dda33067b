"""Document fingerprints: hashed byte triplets counted in buckets, each bucket's quartile, and the length.

A window of ten bytes slides over the text; two triplets of bytes that stand apart in it are hashed into
256 buckets. Bytes that stand apart tell texts of one language from each other better than neighbours do. A bucket's code says which quarter of all buckets its count falls into, so
the digest doesn't depend on the length, which has a field of its own on a logarithmic scale, as have
the ratios of the quartiles. Two digests are compared by a score of bounded size: steps between bucket
codes, opposite quarters counting double, and steps between the header's fields.

Digest: 2 hexadecimal digits length, 1 digit each for two quartile ratios, 128 digits bucket codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlapse.llm.common import stage, text_of

BUCKETS = 256
#: Score at which two digests count as not alike at all: twice what random codes give.
BOUND = 832
_POWERS = np.array([64, 16, 4, 1], dtype=np.uint8)
_STEPS = np.array([0, 1, 2, 6])


def _tables() -> np.ndarray:
    """Random bytes for each byte value, one table for each triplet and place."""
    rows = [hashlib.shake_128(f"triplet {triplet} place {place}".encode()).digest(256) for triplet in range(2) for place in range(3)]
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(2, 3, 256)


TABLES = _tables()
PLACES = ((0, 4, 9), (0, 3, 7))
WINDOW = 10
STEP = 1 << 20


def triplet_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit; texts below the window are padded with zero bytes, the empty one has none."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    if not data:
        return counts
    codes = np.frombuffer(data.ljust(WINDOW, b"\0"), dtype=np.uint8)
    for at in range(0, len(codes) - WINDOW + 1, STEP):
        some = codes[at : at + STEP + WINDOW - 1]
        n = len(some) - WINDOW + 1
        for tables, places in zip(TABLES, PLACES):
            hashed = tables[0][some[:n]] ^ tables[1][some[places[1] : places[1] + n]] ^ tables[2][some[places[2] : places[2] + n]]
            counts += np.bincount(hashed, minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    counts = triplet_counts(data)
    q1, q2, q3 = np.sort(counts)[[63, 127, 191]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, int(8 * np.log2(len(data) + 1)))
    ratios = [min(15, int(16 * q / q3)) if q3 else 0 for q in (q1, q2)]
    packed = (codes.reshape(-1, 4) * _POWERS).sum(axis=1, dtype=np.uint8)
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{packed.tobytes().hex()}"


def _codes(fingerprint: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(fingerprint[4:]), dtype=np.uint8)
    return ((packed[:, None] // _POWERS) & 3).ravel().astype(np.int8)


def difference(a: str, b: str) -> int:
    """Score from 0, for equal digests, to ``BOUND``."""
    if a == b:
        return 0
    score = int(_STEPS[np.abs(_codes(a) - _codes(b))].sum())
    score += abs(int(a[:2], 16) - int(b[:2], 16)) + abs(int(a[2], 16) - int(b[2], 16)) + abs(int(a[3], 16) - int(b[3], 16))
    return min(score, BOUND)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every document; a null text is the empty one. Without documents there are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([digest(t) for t in texts], pa.string())], names=["doc_id", "fingerprint"])

    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return kept.mapInArrow(run, "doc_id long, fingerprint string")


def in_sequence(
    docs: DataFrame,
    each: Callable[[Iterator[tuple[int | None, str, str, int]]], Iterator[pa.RecordBatch]],
    schema: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Give ``each`` the documents of a range in descending id order as (id, text, next document's text, copies).

    Ids equal or null are ordered by the text's hash, descending; null is below any id. Equal rows come once, with their
    number: all but the last of them have themselves as the next document, so ``each`` gets them as two.
    Ranges are cut at quantiles of the ids, and an id with more different texts than a range has rows is cut by their hash. The
    next document of a range's last one is the first of the next range, so that document is sent
    to both; after the last range comes the first. Only the ranges' bounds and first rows come to the
    driver, two numbers each per range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(1 << 63)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(lowest)).alias("place"),
        F.xxhash64(text_of(text)).alias("hash"),
        text_of(text).alias("text"),
    )
    ranges = 3 * parts
    keys = rows.groupBy("place", "hash").agg(F.count(F.lit(1)).alias("copies"))
    repeated = stage(keys.where("copies > 1").select(F.col("place").alias("_place"), F.col("hash").alias("_hash"), "copies"), "equal-rows")
    if repeated.isEmpty():
        once = rows.withColumn("copies", F.lit(1).cast("long"))
    else:
        same = (F.col("place") == F.col("_place")) & (F.col("hash") == F.col("_hash"))
        alone = rows.join(repeated, same, "left_anti").withColumn("copies", F.lit(1).cast("long"))
        again = rows.join(repeated, same).drop("_place", "_hash").dropDuplicates(["place", "hash"])
        once = alone.unionByName(again)
    quantiles = [i / ranges for i in range(1, ranges)]
    facts = rows.agg(F.percentile_approx("place", quantiles, 100 * ranges).alias("cuts"), F.count(F.lit(1)).alias("n")).first()
    highest = (1 << 63) - 1
    cuts = {(c, highest) for c in facts["cuts"] or []}
    # An id with more texts than a range has rows; there are fewer of them than ranges.
    each_range = max(1000, -(-facts["n"] // ranges))
    for place, texts in rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > each_range).collect():
        pieces = -(-texts // each_range)
        cuts |= {(place, lowest + (k * (1 << 64)) // pieces) for k in range(pieces)}
    bounds = F.array(*[F.struct(F.lit(p).alias("place"), F.lit(h).alias("hash")) for p, h in sorted(cuts)])
    bounds = bounds.cast("array<struct<place:bigint,hash:bigint>>")
    at = F.struct("place", "hash")
    number = F.size(F.filter(bounds, lambda c: c < at))
    firsts = sorted(((r[0], r[1]["place"], r[1]["hash"]) for r in rows.groupBy(number.alias("range")).agg(F.max(at)).collect()), reverse=True)
    # The range before, in descending order, gets a copy of a range's first document.
    copies = [(place, hashed, firsts[k - 1][0]) for k, (_, place, hashed) in enumerate(firsts)]
    also = spark.createDataFrame(copies, "first_place long, first_hash long, before int")
    dealt = once.withColumn("range", number).join(
        F.broadcast(also), (F.col("place") == F.col("first_place")) & (F.col("hash") == F.col("first_hash")), "left"
    )
    own = F.struct(F.col("range"), F.lit(False).alias("copied"))
    copied = F.struct(F.col("before").alias("range"), F.lit(True).alias("copied"))
    dealt = dealt.select(
        "doc_id", "place", "hash", "text", "copies", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copied))).alias("to")
    ).select("doc_id", "place", "hash", "text", "copies", "to.range", "to.copied")
    ordered = dealt.repartition(parts, "range").sortWithinPartitions("range", "copied", F.col("place").desc(), F.col("hash").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(_with_next(batches))

    return ordered.select("range", "copied", "doc_id", "text", "copies").mapInArrow(run, schema)


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str, int]]:
    waiting = None
    for batch in batches:
        texts = batch.column("text")
        for i, (part, copied, document, copies) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("range", "copied", "doc_id", "copies")))):
            text = texts[i].as_py()
            if waiting is not None:
                yield waiting[1], waiting[2], text, 1
            if copies > 1 and not copied:
                yield document, text, text, copies - 1
            waiting = None if copied else (part, document, text)
    if waiting is not None:
        raise ValueError("a range has no next document")


def compare_edited(docs: DataFrame, *, share: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every document and of its edited text, and how alike they are.

    The edit replaces the last ``1/share`` of the code points, rounded down, by the first as many of the
    next document in descending id order, or all of it if it is shorter. A single document is its own
    next one. Null texts are empty; without documents there are no rows. Further columns are left out.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, copies long"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def each(documents: Iterator[tuple[int | None, str, str, int]]) -> Iterator[pa.RecordBatch]:
        rows, known = [], None
        for document, body, following, copies in documents:
            own = known[1] if known and known[0] == body else digest(body.encode())
            other = digest(following.encode())
            known = (following, other)
            cut = len(body) // share
            edited = (body[: len(body) - cut] + following[:cut]).encode()
            changed = digest(edited)
            rows.append((document, len(body), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, other), copies))
            if len(rows) == 1000:
                yield packed(rows)
                rows = []
        if rows:
            yield packed(rows)

    found = in_sequence(docs, each, schema, doc_id=doc_id, text=text)
    # A row for each copy, in two steps, so that no array is long.
    found = found.withColumn("_run", F.explode(F.expr("sequence(0L, (copies - 1) div 100000)")))
    left = F.least(F.lit(100_000), F.col("copies") - F.col("_run") * 100_000).cast("int")
    return found.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), left))).drop("_copy", "_run", "copies")
