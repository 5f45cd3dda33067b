"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a target in words. Documents get a hash-random key; a source is sorted by it in
ranges of the key, running word counts are added up from the ranges' totals, and the source is cut at
exactly its budget: whole epochs first, then the documents in key order until the words are used up.

The ranges are equal parts of the key's values, for n rows about as many as a range has rows: n to the
power 0.5. So a source with a third of all rows is sorted by many tasks, and so are its running totals,
which need one row per range; nothing is sampled. The targets need one row per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlapse.llm.common import WORD, stage, text_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
KEY_BITS = 52


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source.

    Weights repeat over the sources in code point order, null last. A target is its source's share of
    all words, at most ``max_epochs`` times the source's size; what is above goes to the others by
    weight until none is above. Sources reach that bound in the order of size over weight. With ``level`` the words per
    unit of weight that are left once the sources before have theirs, the highest level is the final one.
    A source without words has target 0.
    """
    listed = sources.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"),
        ),
    )
    bound = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    levels = (
        listed.withColumn("bound", bound)
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("bound_before", F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn(
            "level", (F.col("total") - F.col("bound_before")) / (F.col("weights") - F.col("weight_before"))
        )
        # Levels rise as long as sources reach their bound and fall after that.
        .withColumn("final", F.max("level").over(whole))
        .withColumn("any_open", F.max((F.col("ratio") > F.col("level")).cast("int")).over(whole))
    )
    target = F.when(F.col("any_open") == 0, F.col("bound")).otherwise(
        F.least("bound", F.col("final") * F.col("weight"))
    )
    return levels.select("source", "source_size", "n_rows", target.alias("target"))


def row_key(doc_id: str, text: str, source: str) -> Column:
    """Names a row by its id, source and text: 32 hexadecimal digits; only equal rows share it."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in (doc_id, source)]
    return F.md5(F.concat_ws("|", *parts, F.md5(text_of(text))))


def sized(docs: DataFrame, seed: int = 0, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: id, source, size, row key, and a hash-random key of 52 bits from it."""
    named = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        word_count(text).alias("size"),
        row_key(doc_id, text, source).alias("row_key"),
    )
    return named.withColumn("key", random_key("row_key", seed))


def random_key(row_key: str, seed: int) -> Column:
    """A hash-random number of ``KEY_BITS`` bits from a row's key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), row_key)), 1, 13), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
    seed: int = 0,
    **columns: str,
) -> DataFrame:
    """One row per document: what its source gets and the words taken from it.

    ``epochs`` times the whole document is taken, and ``extra`` words more; ``taken`` is the sum. The
    taken words of a source add up to its target, rounded down. Null texts have size 0; a very long text is one
    document like others, and without documents there are no rows. Equal rows share
    a key; which of them is cut doesn't matter. A rerun, on other partitions too, gives the same rows.
    """
    rows = stage(sized(docs, seed, **columns), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    goal = stage(targets(sources, weights, max_epochs), "targets")
    goal = goal.withColumn("parts", F.ceil(F.sqrt("n_rows"))).select(
        F.col("source").alias("goal_source"), "source_size", "target", "parts"
    )
    placed = rows.join(goal, F.col("source").eqNullSafe(F.col("goal_source")), "left").withColumn(
        "part", F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * F.col("parts"))
    )
    totals = placed.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("source").alias("in_source"),
        F.col("part").alias("in_part"),
        F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_start"),
    )
    within = Window.partitionBy("source", "part").orderBy("key", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    started = placed.withColumn("in_range", F.coalesce(F.sum("size").over(within), F.lit(0)))
    totals = stage(totals, "range-starts")
    started = started.join(
        totals, F.col("source").eqNullSafe(F.col("in_source")) & (F.col("part") == F.col("in_part"))
    ).withColumn("start", F.col("part_start") + F.col("in_range"))
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    started = started.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    extra = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("start"))).cast("long")
    return started.select(
        "doc_id",
        "source",
        "size",
        "key",
        "row_key",
        "source_size",
        "target",
        "epochs",
        extra.alias("extra"),
        (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"),
    )


def first_words(text: str, count: Column) -> Column:
    """The text up to the end of its ``count``-th word, with its own white space."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    return F.array_join(F.slice(pieces, 1, F.greatest(count, F.lit(0)).cast("int")), "")


def mixed_documents(
    docs: DataFrame, mixed: DataFrame, *, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each epoch of a document, and one for its extra words.

    A document whose extra words are all of it is one more whole row; one that the budget cuts ends
    after the last word taken. Rows that the mix takes nothing from are gone, and so are rows
    without words. Without documents there are no rows.

    Texts aren't shuffled. What a source takes follows from its number of epochs and from the key where its budget
    ends: documents below that key are taken once more, and only equal rows that share it meet.
    """
    place = F.struct("key", "row_key")
    ends = mixed.groupBy(F.col("source").alias("of_source")).agg(
        F.max("epochs").alias("epochs"), F.max(F.when(F.col("extra") > 0, place)).alias("end")
    )
    ends = stage(ends, "source-ends")
    shared = mixed.groupBy(F.col("row_key").alias("of_key")).agg(F.sum("taken").alias("words"))
    ends = ends.join(shared, F.col("end.row_key") == F.col("of_key"), "left").drop("of_key")
    ends = stage(ends, "source-cuts")

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(
        row,
        F.col(text).alias("body"),
        word_count(text).alias("size"),
        F.col(source).cast("string").alias("own_source"),
        row_key(doc_id, text, source).alias("own_key"),
    ).where("size > 0")
    keyed = keyed.join(ends, F.col("own_source").eqNullSafe(F.col("of_source")))
    own = F.struct(random_key("own_key", seed).alias("key"), F.col("own_key").alias("row_key"))
    keyed = keyed.withColumn("own", own).withColumn("at_end", F.coalesce(F.col("own") == F.col("end"), F.lit(False)))
    copies = F.col("epochs") + F.coalesce(F.col("own") < F.col("end"), F.lit(False)).cast("long")
    # Every row of a text of many copies is below the end, above it, or one of those that share what is left there.
    below = keyed.where("not at_end").withColumn("words", copies * F.col("size"))
    last = keyed.where("at_end").dropDuplicates(["own_key"])
    taken = below.select("row", "body", "size", "words").unionByName(last.select("row", "body", "size", "words"))
    whole = F.floor(F.col("words") / F.col("size"))
    cut = (F.col("words") - whole * F.col("size")).cast("int")
    pieces = F.concat(F.array_repeat(F.lit(-1), whole.cast("int")), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<int>")))
    spread = taken.select("row", "body", F.explode(pieces).alias("cut"))
    kept = F.when(F.col("cut") < 0, F.col("body")).otherwise(first_words("body", F.col("cut")))
    return spread.select(*[kept.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
