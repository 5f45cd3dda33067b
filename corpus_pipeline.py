"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

quality classifier, SimHash near duplicates, benchmark decontamination, mixing, token-id records

Defined results, for every stage: null texts and texts without words are empty ones; null sources are a source, null ids come
before others. Texts are taken whole, whatever their length. Rows that repeat an id are documents of their own; further columns
stay, but for the last stage. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlapse.llm import crf, decontaminate, mixing, overlap, records, simhash
from gridlapse.llm.common import table
from gridlapse.plans.stage import fresh_path

#: The tokenizer of the last stage, and the id that ends a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Near copies: four fifths of the fingerprint's bits over five-word shingles agree. Such fingerprints are
#: too far apart to be searched for, so those of the different words are, of which few bits differ.
NEAR = simhash.Rule(words=1, repeats=False, max_bits=8, parts=3, width=1, check_words=5, check_bits=12)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the classifier doesn't reject; null and empty texts score like an empty line."""
    return crf.keep_good(docs, crf.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id; texts without words are one group."""
    return simhash.keep_one(docs, overlap.join_near(docs, simhash.near_duplicates(docs, NEAR)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: four fifths of its five-word shingles. Items of fewer words are in none."""
    return decontaminate.without_items(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row per epoch of a document, one cut text at each source's budget.

    Texts without words have no part in a mix.
    """
    return mixing.mixed_documents(docs, mixing.mix(docs))


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes all rows' token ids as records in ascending id order and reads them back, one row each."""
    import public_tokenizers

    return records.read_records(records.write_records(docs, public_tokenizers.path(TOKENIZER), end_id=END_ID))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", mix),
    ("token records", token_records),
]

#: The learned model, the fingerprints and the tokenizer are beyond SQL; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; rows as :func:`gridlapse.llm.records.read_records` gives them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
