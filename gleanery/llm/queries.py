"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import read_table, read_texts


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.mixing import mix

    mixed = mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from gleanery.llm.sentencepiece_codec import encode_documents, load

    model = load(public_tokenizers.path("piece_bpe_32k.model"))
    docs = read_texts(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = encode_documents(docs, model, decoded="decoded")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.line_dedup import drop_common_lines

    kept = drop_common_lines(read_texts(spark, sf_dir).select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.fingerprints import edit_likeness

    return edit_likeness(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.quality import held_out, score_documents, train

    docs = read_texts(spark, sf_dir).select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.simhash import simhash_components

    found = simhash_components(read_texts(spark, sf_dir), k=3, limit=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from gleanery.llm.token_files import token_digests

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    return token_digests(read_table(spark, sf_dir, "documents"), definition, end_id=2)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.sharding import shard

    text = F.coalesce("text", F.lit(""))
    rows = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.suffix_dedup import cut_repeats

    found = cut_repeats(read_table(spark, sf_dir, "documents"), 50, digest_only=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.media import text_media

    found = text_media(read_texts(spark, sf_dir))
    return found.withColumn("feature", F.lower(F.hex("feature")))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.decontaminate import decontaminate

    found = decontaminate(read_texts(spark, sf_dir).select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"), n=10)
    items = F.col("items")
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gleanery.llm.hard_negatives import mine

    relabelled = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label")
    return mine(read_table(spark, sf_dir, "embeddings").select("vec_id", relabelled, "embedding"), anchor="vec_id % 50 = 0")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from gleanery.llm.alignment import align
    from gleanery.llm.sentencepiece_codec import load

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    return align(read_texts(spark, sf_dir).select("doc_id", "text"), definition, load(public_tokenizers.path("piece_bpe_32k.model")), digest=True)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_sentencepiece, op3_line_dedup, op4_fingerprints, op5_quality, op6_simhash, op7_token_ids, op8_sharding, op9_suffix_dedup, op10_media_columns, op11_decontamination, op12_hard_negatives, op13_alignment)}

ORACLES = {
    "op12_hard_negatives": r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, own, id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> p.own AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 3
""",
    "op11_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), i AS (
  SELECT item, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS place FROM b WHERE len(words) > 0
), p AS (
  SELECT DISTINCT item, least(len(words), 10) AS size, array_to_string(words[place : place + 9], ' ') AS phrase FROM i
), s AS (
  SELECT DISTINCT size FROM p
), w AS (
  SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS place FROM d JOIN s ON len(words) >= size
), o AS (
  SELECT w.doc_id, w.place, w.size, p.item FROM w JOIN p ON w.size = p.size AND array_to_string(w.words[w.place : w.place + w.size - 1], ' ') = p.phrase
), h AS (
  SELECT doc_id, count(DISTINCT hit)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(place, place + size)) AS hit FROM o) GROUP BY doc_id
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
""",
    "op3_line_dedup": r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
""",
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS spot FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s
), w AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3 AS most FROM r
), l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(most) OVER o, 0)::BIGINT)::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0::DOUBLE)) AS level
  FROM w WINDOW o AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), m AS (
  SELECT level FROM l WHERE most >= level * weight ORDER BY most / weight, place LIMIT 1
), t AS (
  SELECT source, source_size, least(most::DOUBLE, (SELECT level FROM m) * weight) AS target FROM l
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(size::VARCHAR) * 10 + substr(size::VARCHAR, 1, 1)::INT, spot, doc_id) AS place FROM d
), c AS (
  SELECT n.*, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size END AS rate,
    ('0x' || substr(md5('0:' || coalesce(n.source, chr(0) || 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target, ((floor(place * rate + u) - floor((place - 1) * rate + u))::BIGINT * size)::BIGINT AS taken FROM c
""",
}
