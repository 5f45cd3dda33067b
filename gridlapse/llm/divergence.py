"""How far sources of one language diverge in their terms, counted by digests of the terms.

Tasks count the terms of their documents and write, for each language, source and term, occurrences and
documents, with a 64-bit digest beside the term. What is shuffled to be added up is the digests and numbers alone. The terms
themselves are read for two purposes. For digests that are frequent enough to matter, the smallest and the largest
term are found; where they differ, terms share the digest, and its rows are split by term and added up again. And
kept results get their term back from the smallest string of their digest.

Divergence from a group with shares ``p`` to one with shares ``q`` is the sum over kept terms of
``(p - q)**2 div (p + q)``. Shares are whole numbers, all arithmetic is exact. Most terms of a language are absent
from a small group and have one share there, so that a pair's sum is put together from
each group's numbers of terms by count, and only terms that both groups have are joined.

Defined results: null texts, languages and sources are empty ones, which are a language or source like others. A document
without terms makes its group occur. Rows that repeat an id are documents of their own. Texts of any
length are counted in pieces. Without documents there are no rows; further columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlapse.llm.common import stage, text_of, utf8_lists

#: Documents of its language that a kept term is in.
DOCUMENTS = 10
#: Terms of a group that are listed.
TOP = 10
#: Shares are of this whole; so many occurrences are added to each term's.
WHOLE, ADDED = 1_000_000_000, 2
#: Terms that a task holds before it writes its counts, and bytes of a text that are cut into words at a time.
HELD, PIECE = 400_000, 1 << 20
DIGEST_BITS = 64
#: Lower-cases A-Z and turns every ASCII byte that isn't a letter into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

GROUP = ("lang", "source")
TERM = ("lang", "digest", "own")


def words(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms, piece by piece."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            # A piece ends before an ASCII byte that isn't a letter.
            while end < len(text) and (text[end] >= 128 or chr(text[end]).isalpha()):
                end += 1
        yield text[at:end].translate(FOLD).split()
        at = end


def digests_of(terms: list[bytes], bits: int) -> np.ndarray:
    """The first ``bits`` bits of each term's hash, as signed 64-bit numbers."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, terms), dtype=np.uint64, count=len(terms))
    return (hashes >> np.uint64(64 - bits)).view(np.int64)


def strings(terms: list[bytes]) -> pa.Array:
    return pa.array(terms, pa.binary()).cast(pa.string())


COUNTS = "kind int, lang string, source string, digest long, n long, docs long, term string"


def counted(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", bits: int = DIGEST_BITS) -> DataFrame:
    """Three kinds of rows. 0: a group that occurs. 1 and 2: a group's term with its counts so far, 2 for one group
    of each term, so that those rows have every term once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COUNTS.split(", ")]
        occurrences: dict[tuple, Counter] = {}
        documents: dict[tuple, Counter] = {}

        def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
            nothing = {"kind": pa.repeat(pa.scalar(0, pa.int32()), size)}
            for name in names[1:]:
                nothing[name] = pa.nulls(size, pa.int64() if name in ("digest", "n", "docs") else pa.string())
            return pa.RecordBatch.from_pydict(nothing | columns)

        def made() -> Iterator[pa.RecordBatch]:
            every = list(set().union(*documents.values()))
            digests = digests_of(every, bits)
            known = dict(zip(every, digests.tolist()))
            left = set(every)
            for group, terms in documents.items():
                size, listed = len(terms), list(terms)
                named = {c: pa.repeat(pa.scalar(v, pa.string()), size + 1) for c, v in zip(GROUP, group)}
                yield rows(1, **{c: v[:1] for c, v in named.items()})
                kind = np.fromiter(map(left.__contains__, listed), dtype=np.int32, count=size) + 1
                left.difference_update(listed)
                found = np.fromiter(map(known.__getitem__, listed), dtype=np.int64, count=size)
                n = np.fromiter(map(occurrences[group].__getitem__, listed), dtype=np.int64, count=size)
                docs = np.fromiter(terms.values(), dtype=np.int64, count=size)
                columns = {"kind": pa.array(kind, pa.int32()), "digest": pa.array(found), "n": pa.array(n), "docs": pa.array(docs), "term": strings(listed)}
                yield rows(size, **{c: v[:size] for c, v in named.items()}, **columns)
            occurrences.clear()
            documents.clear()

        for batch, texts in utf8_lists(batches, "text"):
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            for group, body in zip(groups, texts):
                n = occurrences.setdefault(group, Counter())
                seen: set[bytes] = set()
                for piece in words(body):
                    n.update(piece)
                    seen.update(piece)
                documents.setdefault(group, Counter()).update(seen)
            if sum(map(len, documents.values())) >= HELD:
                yield from made()
        if documents:
            yield from made()

    kept = docs.select(text_of(text).alias("text"), text_of(lang).alias("lang"), text_of(source).alias("source"))
    return kept.mapInArrow(run, COUNTS)


def _named(df: DataFrame, suffix: str, *columns: str) -> DataFrame:
    """``df`` with the given columns renamed, so that a join has no column twice."""
    return df.withColumnsRenamed({c: f"{c}_{suffix}" for c in columns})


def _same(suffix: str, *columns: str) -> Column:
    test = F.lit(True)
    for c in columns:
        test &= F.col(c) == F.col(f"{c}_{suffix}")
    return test


def term_counts(parts: DataFrame, documents: int = DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Occurrences of each kept term in each group, and the kept terms of each language with their ``term``.

    A term is named by ``digest`` and ``own``, which is empty unless terms share the digest.
    """
    counts = parts.where("kind > 0")
    sums = [F.sum("n").cast("decimal(38,0)").alias("n"), F.sum("docs").alias("docs")]
    plain = stage(counts.groupBy(*GROUP, "digest").agg(*sums), "digest-counts")
    frequent = plain.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= documents)
    frequent = stage(frequent.select("lang", "digest"), "frequent-digests")
    wanted = _named(frequent.select("digest").distinct(), "w", "digest")
    ends = parts.where("kind = 2").join(wanted, _same("w", "digest"), "left_semi")
    ends = stage(ends.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")), "digest-strings")
    shared = _named(stage(ends.where("low < high").select("digest"), "shared-digests"), "x", "digest")

    alone = plain.join(shared, _same("x", "digest"), "left_anti").withColumn("own", F.lit(""))
    split = counts.join(shared, _same("x", "digest"), "left_semi").withColumn("own", F.col("term"))
    split = split.groupBy(*GROUP, "digest", "own").agg(*sums)
    every = alone.unionByName(split)
    kept = every.groupBy(*TERM).agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= documents)
    kept = kept.join(_named(ends, "s", "digest", "low", "high"), _same("s", "digest"))
    kept = kept.select(*TERM, "lang_n", F.when(F.col("own") == "", F.col("low_s")).otherwise(F.col("own")).alias("term"))
    kept = stage(kept, "kept-terms")
    cells = every.join(_named(kept.select(*TERM), "k", *TERM), _same("k", *TERM), "left_semi")
    return stage(cells.select(*GROUP, "digest", "own", "n"), "term-counts"), kept


def share(n: Column, total: Column, terms: Column) -> Column:
    """A term's share in a group with ``total`` occurrences of ``terms`` terms."""
    return _div(F.lit(WHOLE) * (n + ADDED), total + 2 * terms).cast("long") + 1


def _div(a: Column, b: Column) -> Column:
    """The quotient of whole numbers, rounded down; neither is negative."""
    return F.call_function("div", a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))


def far(p: Column, q: Column) -> Column:
    # Shares are at most a billion and one, so their differences' squares are below 2**63.
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, *, documents: int = DOCUMENTS, top: int = TOP, bits: int = DIGEST_BITS, **columns: str) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` for every group that occurs.

    Part ``pair`` has the group's divergence from each other source of its language, part ``term`` the ``top`` terms whose
    share in the group is above that in the language. Terms need ``documents`` documents of the language. ``bits`` sets the size
    of a digest; results don't depend on it.
    """
    parts = stage(counted(docs, bits=bits, **columns), "counted-terms")
    cells, kept = term_counts(parts, documents)
    langs = kept.groupBy(F.col("lang").alias("lang_v")).agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    sizes = cells.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    groups = (
        parts.where("kind = 0").select(*GROUP).distinct()
        .join(langs, _same("v", "lang"), "left")
        .join(_named(sizes, "z", *GROUP), _same("z", *GROUP), "left")
    )
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("terms", "lang_total", "total", "held")]
    groups = groups.select(*GROUP, *zero)
    # The share of a term that isn't there; without kept terms there is none.
    absent = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.greatest("terms", F.lit(1))))
    groups = stage(groups.withColumn("absent", absent), "groups")
    shares = cells.join(_named(groups, "g", *GROUP), _same("g", *GROUP)).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    shares = stage(shares.select(*TERM, "source", "n", "p"), "shares")
    return _terms(shares, kept, langs, top).unionByName(_pairs(shares, groups))


def _ranked(values: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return values.select(*GROUP, F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(shares: DataFrame, kept: DataFrame, langs: DataFrame, top: int) -> DataFrame:
    """The listed terms of every group. Only they, and those that tie with the last of them, get their text."""
    whole = kept.join(langs, _same("v", "lang")).withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")))
    both = shares.join(_named(whole.select(*TERM, "q"), "k", *TERM), _same("k", *TERM)).where("p > q")
    both = both.withColumn("value", far(F.col("p"), F.col("q")))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    best = both.withColumn("place", F.rank().over(order)).where(F.col("place") <= top).select(*GROUP, "digest", "own", "value")
    texts = _named(kept.select(*TERM, F.col("term").alias("item")), "t", *TERM)
    return _ranked(best.join(texts, _same("t", *TERM)), "term").where(F.col("rank") <= top)


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Every group's divergence from each other one of its language."""
    mine = groups.select(*GROUP, "terms", "held", "absent")
    theirs = _named(mine.drop("terms"), "o", *GROUP, "held", "absent")
    pairs = mine.join(theirs, _same("o", "lang") & (F.col("source") != F.col("source_o")))

    # Terms of the group alone, by number of terms with a share: as if the other had none of them.
    by_share = shares.groupBy(*GROUP, "p").agg(F.count(F.lit(1)).alias("n_terms"))
    others = _named(groups.select(*GROUP, "absent"), "o", *GROUP, "absent")
    against = by_share.join(others, _same("o", "lang") & (F.col("source") != F.col("source_o")))
    against = against.groupBy(*GROUP, "source_o").agg(F.sum(F.col("n_terms") * far(F.col("p"), F.col("absent_o"))).alias("alone"))

    # Terms of both: what they add to, or take from, the sum over either group's own and over none's.
    know = _named(groups.select(*GROUP, "absent"), "g", *GROUP)
    known = shares.join(know, _same("g", *GROUP)).select(*TERM, "source", "p", "absent")
    right = _named(known, "o", *TERM, "source", "p", "absent")
    met = known.join(right, _same("o", *TERM) & (F.col("source") < F.col("source_o")))
    p, q, a, b = F.col("p"), F.col("p_o"), F.col("absent"), F.col("absent_o")
    more = far(p, q) - far(p, b) - far(a, q) + far(a, b)
    met = met.groupBy(*GROUP, "source_o").agg(F.sum(more).alias("more"))
    met = met.unionByName(met.select("lang", F.col("source_o").alias("source"), F.col("source").alias("source_o"), "more"))

    pair = (*GROUP, "source_o")
    back = against.select("lang", F.col("source_o").alias("source"), F.col("source").alias("source_o"), F.col("alone").alias("back"))
    found = (
        pairs.join(_named(against, "a", *pair), _same("a", *pair), "left")
        .join(_named(back, "b", *pair), F.expr("lang = lang_b and source = source_b and source_o = source_o_b"), "left")
        .join(_named(met, "m", *pair), F.expr("lang = lang_m and source = source_m and source_o = source_o_m"), "left")
    )
    sums = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("alone", "back", "more")), F.lit(0))
    rest = (F.col("terms") - F.col("held") - F.col("held_o")) * far(F.col("absent"), F.col("absent_o"))
    value = F.when(F.col("terms") > 0, sums + rest).otherwise(F.lit(0)).cast("long")
    return _ranked(found.select(*GROUP, F.col("source_o").alias("item"), value.alias("value")), "pair")
