"""Secret scan: fixed patterns, and character Markov models that tell random strings from identifiers.

Only DataFrame functions. One pass over the texts finds the fixed patterns' spans and every long token;
what it keeps is narrow and is written once. The models are first-order: the chance of a character after
the one before it, for random strings from the values that the fixed patterns found in all documents,
for ordinary identifiers from the shorter tokens of all documents. Pairs of characters are added up before they
are shuffled. A token whose mean log
likelihood ratio per character is high enough is a span of kind ``markov``, unless it overlaps a span of
a fixed pattern. The models come to the driver as one number for each pair of characters.

Positions are code points. Columns may be null: a null text is the empty one, a null id stays null.
Rows that repeat an id are scanned each on their own; further columns are left out. Texts are scanned whole, whatever
their length, and without documents there are no rows.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlapse.llm.common import stage, text_of

# The base patterns, in the order of their kinds, with the least length that counts.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # runs are taken whole, so the length of 20 can stand in the pattern
HEX = r"[0-9a-f]{24,}"

METHOD = "markov"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{6,19}(?![A-Za-z0-9+/_=-])"
#: Fewer different characters than this are a ruler or a number, not a random string.
DIFFERENT = 8
FIRST, LAST = ord("+"), ord("z")
WIDTH = LAST - FIRST + 1
ALPHABET = 65
#: Share of the uniform distribution in each model.
UNIFORM_RANDOM, UNIFORM_ORDINARY = 0.5, 0.05
#: Pairs that the second character's own share counts for.
BACKING = 5
#: Mean ratio from which a token counts as random: above 0, as a few samples leave ordinary words near it.
THRESHOLD = 0.25
#: Matches of a text whose places are added up one after the other; the sums of such runs are added up in turn.
RUN = 256

SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str, value_group: int = 0) -> Column:
    """All matches, leftmost first without overlap, with their places: what stands between adds up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("found"), values.alias("value"))
    whole = F.filter(parts, lambda p: p["found"].isNotNull())  # not the text after the last match
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def add(so_far: Column, part: Column) -> Column:
        begin = so_far["at"] + F.length(part["gap"])
        end = begin + F.length(part["found"])
        span = F.struct(begin.alias("start"), end.alias("end"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(so_far["spans"], F.array(span)).alias("spans"))

    # Appending to an array copies it, so places are counted within runs, and then the runs'.
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / RUN).cast("int")),
        lambda k: F.aggregate(F.slice(whole, k * RUN + 1, RUN), nothing, add),
    )
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        runs,
        first,
        lambda so_far, run: F.struct((so_far["at"] + run["at"]).alias("at"), F.concat(so_far["starts"], F.array(so_far["at"])).alias("starts")),
        lambda so_far: so_far["starts"],
    )

    def moved(run: Column, by: Column) -> Column:
        return F.transform(
            run["spans"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value"))
        )

    return F.when(text.rlike(pattern), F.flatten(F.zip_with(runs, starts, moved))).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the spans of each fixed pattern and all long tokens."""
    body = F.col("_text")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("_text")).select(
        "doc_id",
        F.filter(matches(body, ASSIGN, 2), lambda s: F.length(s["value"]) >= ASSIGN_VALUE).alias("assign"),
        matches(body, ACCESS).alias("access"),
        matches(body, HEX).alias("hex"),
        matches(body, TOKEN).alias("token"),
    )


def _pairs(strings: DataFrame, label: int) -> DataFrame:
    """Counts of each pair of neighbouring characters in the column ``value``."""
    places = F.sequence(F.lit(1), F.length("value") - 1)
    pairs = F.transform(places, lambda i: F.col("value").substr(i, F.lit(2)))
    exploded = strings.where(F.length("value") > 1).select(F.explode(pairs).alias("pair"))
    return exploded.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit(label))


def train(docs: DataFrame, spans: DataFrame, *, text: str = "text") -> list[float]:
    """Log likelihood ratio, random to ordinary, for each pair of characters, ``WIDTH`` by ``WIDTH``.

    Random strings: the values of all base spans. Ordinary ones: the shorter tokens of all documents.
    Without samples all ratios are 0.
    """
    values = F.explode(F.transform(F.concat("assign", "access", "hex"), lambda s: s["value"]))
    random = spans.select(values.alias("value"))
    ordinary = docs.select(F.explode(F.regexp_extract_all(text_of(text), F.lit(IDENTIFIER), F.lit(0))).alias("value"))
    counts: list[dict] = [defaultdict(int), defaultdict(int)]
    totals: list[dict] = [defaultdict(int), defaultdict(int)]
    inside = F.col("pair").rlike("^[A-Za-z0-9+/_.=-]{2}$")
    for pair, n, label in _pairs(random, 0).unionByName(_pairs(ordinary, 1)).where(inside).collect():
        counts[label][pair] += n
        totals[label][pair[0]] += n
    if not counts[0] or not counts[1]:
        return [0.0] * (WIDTH * WIDTH)

    alone: list[dict] = [defaultdict(int), defaultdict(int)]
    for label in (0, 1):
        for pair, n in counts[label].items():
            alone[label][pair[1]] += n
    sums = [sum(seen.values()) for seen in alone]

    def chance(label: int, uniform: float, pair: str) -> float:
        # Rare first characters lean on how common the second one is at all.
        common = alone[label][pair[1]] / sums[label]
        seen = (counts[label][pair] + BACKING * common) / (totals[label][pair[0]] + BACKING)
        return uniform / ALPHABET + (1 - uniform) * seen

    return [
        round(math.log(chance(0, UNIFORM_RANDOM, pair) / chance(1, UNIFORM_ORDINARY, pair)), 3)
        for pair in (chr(FIRST + i) + chr(FIRST + j) for i in range(WIDTH) for j in range(WIDTH))
    ]


def ratio(value: Column, model: list[float]) -> Column:
    """Mean log likelihood ratio of a token's pairs of characters."""
    weights = F.from_json(F.lit(json.dumps(model)), "array<double>")

    def code(at: Column) -> Column:
        return F.ascii(value.substr(at, F.lit(1))) - F.lit(FIRST)

    def add(total: Column, at: Column) -> Column:
        return total + F.element_at(weights, (code(at) * WIDTH + code(at + 1) + 1).cast("int"))

    places = F.sequence(F.lit(1), F.length(value) - 1)
    return F.aggregate(places, F.lit(0.0), add) / (F.length(value) - 1)


def scan(docs: DataFrame, *, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id`` and the spans of each kind: ``assign``, ``access``, ``hex``, ``markov``."""
    spans = stage(base_spans(docs, doc_id=doc_id, text=text), "key-spans")
    model = train(docs, spans, text=text)
    base = F.concat("assign", "access", "hex")

    def apart(token: Column) -> Column:
        return ~F.exists(base, lambda s: (s["start"] < token["end"]) & (token["start"] < s["end"]))

    def varied(value: Column) -> Column:
        return F.size(F.array_distinct(F.split(value, ""))) >= DIFFERENT

    # What a token is by itself is asked first; few are left to compare with the base spans.
    random = F.filter(F.filter("token", lambda s: varied(s["value"]) & (ratio(s["value"], model) >= threshold)), apart)
    return spans.select("doc_id", *KINDS, random.alias(METHOD))


def listed(*kinds: str) -> Column:
    """Spans of the given kinds as ``kind:start:end``, by start, then in the order given."""

    def ordered(order: int, kind: str) -> Column:
        return F.transform(
            kind,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")
            ),
        )

    all_spans = F.concat(*[ordered(order, kind) for order, kind in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(all_spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
