"""Left join of a fact table with a lookup that is unique per key, safe for hot keys.

A hash join sends all rows of a key to one task, so a key with a third of the facts decides the
run time of the whole join. Here the facts' key frequencies are counted first (map-side combined,
key columns only). A key above the threshold gets ``ceil(rows / threshold)`` salts: its facts are
spread over them, and its single lookup row is repeated once per salt.

Sizes: with ``hot_share = s`` at most ``1/s`` keys can be hot and at most ``2/s`` lookup copies are
made, until a share of the table is more than ``MAX_SALT_ROWS``; from then on at most one key for each
that many rows. A table of 10**12 rows has 50,000 hot keys at most, a few megabytes: that bound is
what makes the broadcast of the hot list safe.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_SHARE = 1.0 / 2000.0
MIN_HOT_ROWS = 1_000_000
#: No salt gets more rows than this, however large the table.
MAX_SALT_ROWS = 20_000_000

#: A lookup of at most this many rows is small enough for every task to have a copy.
SMALL_ROWS = 500_000

_ROWS = "_key_rows"
_SALTS = "_salts"
_MEMBER_SALTS = "_member_salts"
_SALT = "_salt"
_KIND = "_kind"


def small_lookup(lookup: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """The lookup, marked for broadcast if it has few rows.

    Rows are counted: Spark's own estimate of a join is the product of its inputs and that of an aggregate is its input,
    so that a lookup of some thousand rows looks too large and all the facts are shuffled for it.
    """
    return F.broadcast(lookup) if lookup.limit(max_rows + 1).count() <= max_rows else lookup


def key_counts(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key; also the cheapest way to get the distinct keys."""
    return facts.groupBy(*keys).agg(F.count(F.lit(1)).alias(_ROWS))


def counted_keys(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of ``counts``.

    The filter is always true. It keeps the count from being pruned away, so that this and every
    other use of ``counts`` is the same shuffle, which Spark then runs once and reuses.
    """
    return counts.where(F.col(_ROWS) > 0).select(*keys)


def hot_keys(
    counts: DataFrame,
    keys: Sequence[str],
    hot_share: float = HOT_SHARE,
    min_hot_rows: int = MIN_HOT_ROWS,
    max_salt_rows: int = MAX_SALT_ROWS,
    total: Column | None = None,
) -> DataFrame:
    """Keys holding more than the threshold, with their number of salts.

    At most ``1/hot_share`` rows, or rows over ``max_salt_rows`` if that is more. ``total`` is the number of all rows if
    ``counts`` are of some only.
    """
    total = counts.agg(F.sum(_ROWS)).scalar() if total is None else total
    share = F.greatest(F.lit(float(min_hot_rows)), total * F.lit(hot_share))
    threshold = F.least(share, F.lit(float(max_salt_rows)))
    return counts.where(F.col(_ROWS) > threshold).select(
        *keys, F.ceil(F.col(_ROWS) / threshold).cast("int").alias(_SALTS)
    )


def _tag(df: DataFrame, hot: DataFrame, keys: Sequence[str], salts: str = _SALTS, how: str = "left") -> DataFrame:
    renamed = hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.col(_SALTS).alias(salts))
    tests = [df[k].eqNullSafe(renamed[f"_hot_{k}"]) for k in keys]
    joined = df.join(F.broadcast(renamed), reduce(lambda a, b: a & b, tests), how)
    return joined.drop(*[f"_hot_{k}" for k in keys])


def _salt_of_row(df: DataFrame, salts: Column) -> Column:
    """Salt below ``salts`` from the row's content and its input partition.

    Both stay the same when a lost task is run again, so no row can move between two attempts; a
    random number or a row position would not. The partition number spreads rows that are exact
    copies of each other as widely as the input files hold them.
    """
    hashable = [
        F.col(field.name) for field in df.schema.fields if not isinstance(field.dataType, T.MapType)
    ]
    return F.pmod(F.xxhash64(F.spark_partition_id(), *hashable), salts.cast("long"))


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    *,
    null_safe: bool = False,
    counts: DataFrame | None = None,
    hot_share: float | None = HOT_SHARE,
    min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """``facts`` left join ``lookup`` on ``keys``; ``lookup`` has at most one row per key.

    ``counts`` may pass in the result of :func:`key_counts` when the caller needs it anyway;
    ``hot_share=None`` leaves skew to adaptive execution.
    """
    keys = list(keys)
    added = [name for name in lookup.columns if name not in keys]
    if hot_share is None:
        left, right, salted = facts, lookup, False
    else:
        if counts is None:
            counts = key_counts(facts, keys)
        hot = hot_keys(counts, keys, hot_share, min_hot_rows)
        left = _tag(facts, hot, keys)
        left = left.withColumn(
            _SALT,
            F.when(F.col(_SALTS).isNull(), F.lit(0))
            .otherwise(_salt_of_row(facts, F.col(_SALTS)))
            .cast("int"),
        )
        right = _tag(lookup, hot, keys)
        right = right.withColumn(
            _SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1))
        )
        salted = True
    renamed = right.select(
        *[F.col(k).alias(f"_look_{k}") for k in keys],
        *([F.col(_SALT).alias("_look_salt")] if salted else []),
        *added,
    )
    tests = [
        left[k].eqNullSafe(renamed[f"_look_{k}"]) if null_safe else left[k] == renamed[f"_look_{k}"]
        for k in keys
    ]
    if salted:
        tests.append(left[_SALT] == renamed["_look_salt"])
    joined = left.join(renamed, reduce(lambda a, b: a & b, tests), "left")
    return joined.select(*facts.columns, *added)


def nested_lookup_join(
    facts: DataFrame,
    groups: DataFrame,
    group_keys: Sequence[str],
    members: DataFrame,
    member_keys: Sequence[str],
    *,
    hot_share: float | None = HOT_SHARE,
    min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """``facts`` left join ``groups`` and ``members``, both unique per key; members have the groups' key and more.

    Joins would shuffle the facts twice, by the group's key and by the member's. Here the three are put together and dealt
    by the group's key, sorted so that a lookup row comes before its facts, and each fact takes the values of the lookup
    rows last seen in its group and for its member: one shuffle and one sort. A hot group gets salts, which its members are
    dealt over; only a member that is hot itself has rows and copies in several of them. A hot member belongs to a hot
    group, so members are counted in these only.
    """
    by = [key for key in group_keys if key in member_keys]
    within = [key for key in member_keys if key not in by]
    added = [[c for c in lookup.columns if c not in keys] for lookup, keys in ((groups, group_keys), (members, member_keys))]
    if hot_share is None:
        joined = lookup_join(facts, members, member_keys, hot_share=None)
        joined = lookup_join(joined, groups, group_keys, hot_share=None)
        return joined.select(*facts.columns, *added[0], *added[1])

    counts = key_counts(facts, by)
    total = counts.agg(F.sum(_ROWS)).scalar()
    hot = hot_keys(counts, by, hot_share, min_hot_rows, total=total)
    in_hot_groups = _tag(facts, hot, by, how="inner")
    hot_members = hot_keys(key_counts(in_hot_groups, member_keys), member_keys, hot_share, min_hot_rows, total=total)

    salts, member_salts = F.col(_SALTS), F.coalesce(F.col(_MEMBER_SALTS), F.lit(1))
    first = F.pmod(F.xxhash64(*within), salts.cast("long"))

    def tagged(df: DataFrame) -> DataFrame:
        return _tag(_tag(df, hot, by), hot_members, member_keys, _MEMBER_SALTS)

    own = F.pmod(first + _salt_of_row(facts, member_salts), salts.cast("long"))
    left = tagged(facts).withColumn(_SALT, F.when(salts.isNull(), F.lit(0)).otherwise(own).cast("int"))
    places = F.transform(F.sequence(F.lit(0), member_salts - 1), lambda k: F.pmod(first + k, salts.cast("long")).cast("int"))
    right = tagged(members.dropna(subset=list(member_keys)))
    right = right.withColumn(_SALT, F.explode(F.when(salts.isNull(), F.array(F.lit(0))).otherwise(places)))
    copies = _tag(groups.dropna(subset=list(group_keys)), hot, by)
    copies = copies.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(1)) - 1)))
    rows = left.select(*facts.columns, _SALT, F.lit(2).alias(_KIND))
    rows = rows.unionByName(right.select(*member_keys, *added[1], _SALT, F.lit(1).alias(_KIND)), allowMissingColumns=True)
    rows = rows.unionByName(copies.select(*group_keys, *added[0], _SALT, F.lit(0).alias(_KIND)), allowMissingColumns=True)

    others = [key for key in group_keys if key not in by]
    in_group = Window.partitionBy(*by, _SALT, *others).orderBy(*within, _KIND).rowsBetween(Window.unboundedPreceding, 0)
    in_member = Window.partitionBy(*by, _SALT, *within).orderBy(_KIND).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.repartition(*by, _SALT)
    for columns, window in ((added[0], in_group), (added[1], in_member)):
        rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in columns})
    types = dict(facts.dtypes)
    own_columns = [F.col(c).cast(types[c]).alias(c) for c in facts.columns]
    return rows.where(F.col(_KIND) == 2).select(*own_columns, *added[0], *added[1])
