"""One query per operator of this subpackage, over whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlapse.llm import chats, crf, decontaminate, digest, divergence, keyscan, licenses, mixing, negatives, records, simhash, substrings, warc
from gridlapse.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.archive(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op1_warc_revisits"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM h WHERE payload_bytes >= 100 GROUP BY 1)
SELECT h.page_id, h.payload_bytes, h.payload_digest,
       CASE WHEN f.first_id <> h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> h.page_id THEN f.first_id END AS refers_to
FROM h LEFT JOIN f ON h.payload_digest = f.payload_digest AND h.payload_bytes >= 100"""


@query
def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: Targets and the cut of the mix, from a table ``docs`` with doc_id, text, source.
MIX_CTES = r"""
sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(source, '-'), md5(coalesce(text, '')))) AS row_key FROM docs),
keyed AS (SELECT *, CAST('0x' || substr(md5('0|' || row_key), 1, 13) AS BIGINT) AS key FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
weighted AS (SELECT *, (CAST([5.0, 2.0, 1.0] AS DOUBLE[]))[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
  source_size * CAST(3.0 AS DOUBLE) AS bound FROM sources),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(bound) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighted WINDOW w AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, CASE WHEN max(CAST(bound / weight > level AS INTEGER)) OVER () = 0 THEN bound
  ELSE least(bound, max(level) OVER () * weight) END AS target FROM levels),
started AS (SELECT k.*, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, row_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source),
mixed AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs,
  CASE WHEN source_size > 0 THEN least(size, greatest(0, budget % source_size - start)) ELSE 0 END AS extra FROM started)"""

SQL["op7_mix_sources"] = f"""WITH docs AS (SELECT * FROM documents),{MIX_CTES}
SELECT doc_id, size, source_size, target, CAST(epochs * size + extra AS BIGINT) AS taken FROM mixed"""


#: The tokenizer of the token-id query and its end id.
TOKENIZER, END_ID = "word_bpe_49k.json", 2


@query
def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return records.read_records(records.write_records(docs, public_tokenizers.path(TOKENIZER), end_id=END_ID))


@query
def op6_quartile_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.compare_edited(table(spark, sf_dir, "documents"))


@query
def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keyscan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in keyscan.KINDS],
        F.sha2(keyscan.listed(*keyscan.KINDS).cast("binary"), 256).alias("base_sha256"),
        keyscan.listed(*keyscan.KINDS, keyscan.METHOD).alias("spans"),
    )


@query
def op9_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Items held by the texts of a table ``docs``.
ITEM_CTES = r"""
doc_words AS (SELECT md5(coalesce(text, '')) AS text_key, any_value(regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM docs GROUP BY 1),
doc_places AS (SELECT text_key, w, unnest(generate_series(1, len(w) - 4)) AS i FROM doc_words WHERE len(w) >= 5),
doc_shingles AS (SELECT DISTINCT text_key, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM doc_places),
item_words AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_places AS (SELECT item_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM item_words WHERE len(w) >= 5),
item_shingles AS (SELECT DISTINCT item_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS s FROM item_places),
item_sizes AS (SELECT item_id, count(*) AS item_shingles FROM item_shingles GROUP BY 1),
held AS (SELECT text_key, item_id, count(*) AS shared FROM doc_shingles JOIN item_shingles USING (s) GROUP BY 1, 2),
contaminated AS (SELECT * FROM held JOIN item_sizes USING (item_id) WHERE shared >= ceil(round(item_shingles * 0.8, 6)))"""

SQL["op9_benchmark_items"] = f"""WITH docs AS (SELECT * FROM documents),{ITEM_CTES}
SELECT DISTINCT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM contaminated JOIN documents ON md5(coalesce(text, '')) = text_key"""


@query
def op10_license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return crf.score(docs, crf.train(docs, table(spark, sf_dir, "labels")))


@query
def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Every so many vectors are anchors; every so many have a wrong label.
ANCHORS, WRONG, LABELS = 50, 7, 10


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.scaled(table(spark, sf_dir, "embeddings"))
    wrong = F.pmod("vec_id", F.lit(WRONG)) == 0
    rows = rows.withColumn("label", F.when(wrong, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
    return negatives.mine(rows, lambda vec_id: F.pmod(vec_id, F.lit(ANCHORS)) == 0)


SQL["op11_hard_negatives"] = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.rid AS other, b.vec_id, a.label = b.label AS same,
  CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
p AS (SELECT rid, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id, other) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.rid, p.other ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3"""


#: A conversation whose texts hold the template's own control strings.
TRAP = """
SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text
FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"""


@query
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.sql(TRAP))
    message = ("turn", "copy", "reply")
    found = chats.render(chats.fold(chats.log_of(turns), message=message), message=message)
    formatted, read = F.col("formatted"), F.col("turns")
    said = F.transform(read, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = found.withColumn("turns", chats.parse(formatted)).withColumn("loss", chats.under_mask(formatted, F.col("loss_spans")))
    return masked.select(
        "conv_id",
        F.size(read).cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length(formatted).cast("long").alias("formatted_chars"),
    )


_ESCAPED = (
    r"regexp_replace({0}, '([<\[])(\\*)(<SYS>>|</SYS>>|<ROLE>>|</ROLE>>|<TEXT>>|INST\]|/INST\]|s>|/s>)', '\1\2\\\3', 'g')"
)
SQL["op12_chat_format"] = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, length({_ESCAPED.format('text')}) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
  ELSE 29 + length({_ESCAPED.format('role')}) END AS piece FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(piece) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op13_source_divergence"] = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
seen AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM cells JOIN sizes USING (lang)),
whole AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY 1, 2) JOIN sizes USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10"""
