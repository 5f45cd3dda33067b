"""Benchmark decontamination: short test items inside documents of any length, with DataFrame functions only.

An item is in a document if at least ``threshold`` of its different word shingles are. A signature of the
whole document would be useless, as a long document's holds next to nothing of one short passage. Instead
items are put in partitions by size, from a power of two to the next, and an item's signature is its
smallest shingle hashes, in a number that depends on its partition: one more than its members may miss.
So a document that holds the item has at least one of them, and no item is missed. Documents only
show the shingles whose hash isn't above the largest in any signature. What meets is verified exactly,
with the words themselves.

All is keyed by the text's digest: copies of a document are candidates once, whatever their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlapse.llm.common import split_listed, stage, text_of

# Fixed value: a word is a run of ASCII letters and digits and of characters beyond ASCII.
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def _places(words: Column, size: int) -> Column:
    """Start of every shingle."""
    last = F.size(words) - size
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def shingles(words: Column, size: int) -> Column:
    return F.transform(_places(words, size), lambda i: F.array_join(F.slice(words, i + 1, size), " "))


def shingle_hashes(hashes: Column, size: int) -> Column:
    """A hash of every shingle, from an array of its words' hashes."""
    return F.transform(_places(hashes, size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))



def items_of(benchmark: DataFrame, *, item_id: str, text: str, size: int, threshold: float) -> DataFrame:
    """Different items: their shingles, how many a document must hold, and the signature."""
    worded = benchmark.select(words_of(text_of(text)).alias("words"))
    cut = worded.select(
        F.array_sort(F.array_distinct(shingles(F.col("words"), size))).alias("shingles"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    keyed = cut.where(F.size("shingles") > 0).select(
        F.md5(F.array_join("shingles", "|")).alias("item_key"),
        "shingles",
        F.array_sort(F.array_distinct(shingle_hashes(F.col("hashes"), size))).alias("hashes"),
    )
    count = F.size("shingles")
    largest = F.pow(F.lit(2.0), F.floor(F.log2(count)) + 1) - 1  # of the item's partition
    missed = largest - F.ceil(F.round(largest * threshold, 6))
    return keyed.dropDuplicates(["item_key"]).select(
        "item_key",
        "shingles",
        F.ceil(F.round(count * threshold, 6)).cast("int").alias("needed"),
        F.slice("hashes", 1, (missed + 1).cast("int")).alias("signature"),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    threshold: float = 0.8,
    size: int = 5,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``text_key`` (MD5 of the text), ``item_key``, ``shared`` and ``item_shingles`` for each text with an item.

    Words are lower-cased; shingles have ``size`` words. Items with fewer words have no shingles and are
    in no document; null texts are empty. Items with the same shingles are one.
    """
    items = stage(items_of(benchmark, item_id=item_id, text=item_text, size=size, threshold=threshold), "items")
    signature = items.select("item_key", F.explode("signature").alias("hash"))
    highest = signature.agg(F.max("hash")).first()[0]  # the largest hash of any signature
    hashed = docs.select(
        F.md5(text_of(text)).alias("text_key"),
        F.transform(words_of(text_of(text)), lambda w: F.xxhash64(w)).alias("hashes"),
    )
    shown = hashed.select("text_key", F.explode(shingle_hashes(F.col("hashes"), size)).alias("shown"))
    shown = shown.where(F.col("shown") <= F.lit(highest))
    met = shown.join(signature, F.col("shown") == F.col("hash")).select("text_key", "item_key").distinct()
    met = stage(met.withColumnRenamed("text_key", "met_key"), "item-candidates")
    texts = docs.select(F.md5(text_of(text)).alias("text_key"), text_of(text).alias("_text"))
    pairs = texts.join(met, F.col("text_key") == F.col("met_key")).select("text_key", "item_key", "_text")
    worded = pairs.select("text_key", "item_key", words_of(F.col("_text")).alias("words"))
    cut = worded.select("text_key", F.col("item_key").alias("met_item"), shingles(F.col("words"), size).alias("held"))
    verified = cut.join(items, F.col("met_item") == F.col("item_key")).select(
        "text_key",
        "item_key",
        "needed",
        F.size(F.array_intersect("shingles", "held")).alias("shared"),
        F.size("shingles").alias("item_shingles"),
    )
    return verified.where("shared >= needed").select("text_key", "item_key", "shared", "item_shingles").distinct()


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    threshold: float = 0.8,
    size: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id``, ``item_id``, ``shared``, ``item_shingles``, ``containment``: a row for each item in a document.

    Ids may be null and stay so. Rows that repeat a document's or an item's id and text give one pair.
    """
    found = contamination(docs, benchmark, threshold=threshold, size=size, text=text, item_id=item_id, item_text=item_text)
    found = stage(found, "contaminated").withColumnRenamed("text_key", "found_key")
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(text_of(text)).alias("text_key"))
    ids = benchmark.select(
        F.col(item_id).cast("long").alias("item_id"),
        F.md5(F.array_join(F.array_sort(F.array_distinct(shingles(words_of(text_of(item_text)), size))), "|")).alias("named_key"),
    )
    return (
        named.join(found, F.col("text_key") == F.col("found_key"))
        .join(ids, F.col("item_key") == F.col("named_key"))
        .select(
            "doc_id",
            "item_id",
            F.col("shared").cast("long").alias("shared"),
            F.col("item_shingles").cast("long").alias("item_shingles"),
            (F.col("shared") / F.col("item_shingles")).alias("containment"),
        )
        .distinct()
    )


def without_items(docs: DataFrame, found: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents whose text holds no item, in their own columns.

    Documents that surely hold none stay where they are, the others are joined with the digests of those that do.
    """
    gone = stage(found.select(F.unhex("text_key").alias("gone")).distinct(), "with-items")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.unhex(F.md5(text_of(text))).alias("own"))
    may, others = split_listed(keyed, F.col("own"), gone, F.col("gone"))
    return others.unionByName(may.join(gone, F.col("own") == F.col("gone"), "left_anti")).select("row.*")
