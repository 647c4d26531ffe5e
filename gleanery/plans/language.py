"""Registered queries about words: dictionary segmentation and stems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import stem, text
from gleanery.functions.segment import Segmenter
from gleanery.operators import lexical
from gleanery.plans.catalog import ANALYSED, COSINE, EMBEDDED, HAN_DOCUMENTS, NEAREST, PLAIN_CHUNKS_SQL, TOP, asked, bm25_sql, han_documents, query, shown, table
from gleanery.sources.shared import stored
from gleanery.sql import register

# ---------------------------------------------------------------- a lexicon's words

# The lexicon: runs of two to four Han characters that the corpus has three times or more.
# Edges of a run's word graph, backwards: the best way from each place on, then the words forwards.
SEGMENTED_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, source, {ANALYSED} AS toks FROM {HAN_DOCUMENTS}),
e AS (SELECT doc_id, source, unnest(list_transform(toks, lambda x: regexp_extract_all(x, '\p{{Han}}+|[^\p{{Han}}]+'))) AS parts, generate_subscripts(toks, 1) AS place FROM t),
p AS (SELECT doc_id, source, place, unnest(parts) AS part, generate_subscripts(parts, 1) AS inner_place FROM e),
r AS (SELECT part AS run, count(*) AS n FROM p WHERE regexp_matches(part, '^\p{{Han}}+$') GROUP BY part),
l AS (SELECT run AS word, n FROM r WHERE length(run) BETWEEN 2 AND 4 AND n >= 3),
total AS (SELECT sum(n)::DOUBLE AS n FROM l),
x AS (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM r),
y AS (SELECT run, i, unnest(range(1, 5)) AS k FROM x),
g AS (SELECT y.run, y.i, y.k, round(1000000 * ln(coalesce(l.n, 1) / total.n))::BIGINT AS w FROM y CROSS JOIN total LEFT JOIN l ON l.word = substr(y.run, y.i, y.k) WHERE y.i + y.k - 1 <= length(y.run) AND (l.n IS NOT NULL OR y.k = 1)),
h AS (SELECT run, i, list({{'w': w, 'k': k}}) AS edges FROM g GROUP BY run, i),
b AS (
  SELECT run, length(run) + 1 AS i, [{{'s': 0::BIGINT, 'k': 0::BIGINT}}] AS best FROM r
  UNION ALL
  SELECT b.run, b.i - 1, list_prepend(list_sort(list_transform(h.edges, lambda d: {{'s': d.w + b.best[d.k].s, 'k': d.k::BIGINT}}), 'DESC')[1], b.best) FROM b JOIN h ON h.run = b.run AND h.i = b.i - 1
),
f AS (
  SELECT run, best, 1::BIGINT AS spot, []::VARCHAR[] AS words FROM b WHERE i = 1
  UNION ALL
  SELECT run, best, spot + best[spot].k, list_append(words, substr(run, spot, best[spot].k)) FROM f WHERE spot <= length(run)
),
w AS (SELECT run, words FROM f WHERE spot = length(run) + 1),
z AS (SELECT p.doc_id, p.source, string_agg(coalesce(array_to_string(w.words, ' '), p.part), ' ' ORDER BY p.place, p.inner_place) AS text FROM p LEFT JOIN w ON w.run = p.part GROUP BY ALL),
cut AS (SELECT d.doc_id, d.source, coalesce(z.text, '') AS text FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id)
"""


def han_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, runs: the tokens of each text, whose runs of Han characters are whole; stored, as the lexicon and the words are both made of them."""
    return stored(han_documents(spark, sf_dir).select("doc_id", "source", text.whole_runs(F.col("text")).alias("runs")), "runs")


def corpus_lexicon(docs: DataFrame) -> DataFrame:
    counted = docs.select(F.explode("runs").alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    runs = counted.select("n", F.explode(F.regexp_extract_all("t", F.lit(f"({text.HAN}+)"), F.lit(1))).alias("word"))
    return runs.where(F.length("word").between(2, 4)).groupBy("word").agg(F.sum("n").alias("count")).where("count >= 3")


@query(SEGMENTED_SQL + "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS n_words, sha256(text) AS words_sha256 FROM cut")
def segmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut into the words of a lexicon that is made from the corpus."""
    docs = han_runs(spark, sf_dir)
    words = Segmenter.of(corpus_lexicon(docs)).of_runs(F.col("runs"))
    return docs.select("doc_id", words.alias("words")).select("doc_id", F.size("words").cast("long").alias("n_words"), F.sha2(F.array_join("words", " "), 256).alias("words_sha256"))


CUT_TERMS = lexical.Terms(any=("们有", "有", "上"))


@query(bm25_sql(CUT_TERMS, corpus=f"({SEGMENTED_SQL} SELECT * FROM cut)", analysed="string_split(text, ' ')") + TOP)
def segmented_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the lexicon are searched, and found only where texts are cut to them."""
    docs = han_runs(spark, sf_dir)
    segmenter = Segmenter.of(corpus_lexicon(docs))
    counts = lexical.count_once(docs, CUT_TERMS, ["doc_id", "source"], text="runs", analyse=segmenter.of_runs)
    return shown(lexical.top(lexical.bm25(docs, CUT_TERMS, counts=counts), 50))


# ---------------------------------------------------------------- stems


def _stem_sql(source: str) -> str:
    """CTEs up to stems (term, stem) of the terms in source: vowels and consonants as 0 and 1, then step by step."""
    shape = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({x}, '0', '1'), '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g'), '[aeiouy]', '0', 'g'), '[^0]', '1', 'g')"
    m = lambda x: f"len(regexp_extract_all({shape(x)}, '01'))"
    cut = lambda n: f"left(w, length(w) - {n})"
    vowel = lambda x: f"contains({shape(x)}, '0')"
    short = lambda x: f"(ends_with({shape(x)}, '101') AND right({x}, 1) NOT IN ('w', 'x', 'y'))"
    ends = lambda s: f"(ends_with(w, '{s}') AND length(w) > {len(s)})"
    double = lambda x: f"(right({x}, 1) = substr({x}, length({x}) - 1, 1) AND length({x}) > 1 AND ends_with({shape(x)}, '1') AND right({x}, 1) NOT IN ('l', 's', 'z'))"
    undone = lambda n: f"CASE WHEN right({cut(n)}, 2) IN ('at', 'bl', 'iz') THEN {cut(n)} || 'e' WHEN {double(cut(n))} THEN {cut(n + 1)} WHEN {m(cut(n))} = 1 AND {short(cut(n))} THEN {cut(n)} || 'e' ELSE {cut(n)} END"
    rules = lambda table: "CASE " + " ".join(f"WHEN {ends(s)} THEN CASE WHEN {m(cut(len(s)))} > 0 THEN {cut(len(s))} || '{to}' ELSE w END" for s, to in sorted(table.items(), key=lambda x: -len(x[0]))) + " ELSE w END"
    steps = [
        f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {cut(2)} WHEN ends_with(w, 'ss') THEN w WHEN {ends('s')} THEN {cut(1)} ELSE w END",
        f"CASE WHEN {ends('eed')} THEN CASE WHEN {m(cut(3))} > 0 THEN {cut(1)} ELSE w END WHEN {ends('ed')} THEN CASE WHEN {vowel(cut(2))} THEN {undone(2)} ELSE w END WHEN {ends('ing')} THEN CASE WHEN {vowel(cut(3))} THEN {undone(3)} ELSE w END ELSE w END",
        f"CASE WHEN {ends('y')} AND {vowel(cut(1))} THEN {cut(1)} || 'i' ELSE w END",
        rules(stem.STEP_2),
        rules(stem.STEP_3),
        "CASE " + " ".join(f"WHEN ends_with(w, '{s}') THEN CASE WHEN {m(cut(len(s)))} > 1" + (f" AND right({cut(3)}, 1) IN ('s', 't')" if s == "ion" else "") + f" THEN {cut(len(s))} ELSE w END" for s in sorted(stem.STEP_4, key=lambda s: -len(s))) + " ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND ({m(cut(1))} > 1 OR ({m(cut(1))} = 1 AND NOT {short(cut(1))})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {m(cut(1))} > 1 THEN {cut(1)} ELSE w END",
    ]
    parts = ["k0 AS (SELECT term, term AS w FROM (SELECT DISTINCT term FROM " + source + ") WHERE strlen(term) BETWEEN 3 AND 64)"]
    parts += [f"k{i + 1} AS MATERIALIZED (SELECT term, {step} AS w FROM k{i})" for i, step in enumerate(steps)]
    return ", ".join(parts) + f", stems AS (SELECT a.term, coalesce(k.w, a.term) AS stem FROM (SELECT DISTINCT term FROM {source}) a LEFT JOIN k{len(steps)} k ON k.term = a.term)"


WORDS_SQL = f"WITH a AS (SELECT unnest({ANALYSED}) AS term FROM documents), " + _stem_sql("a")


@query(WORDS_SQL + " SELECT stem, count(*) AS words, min(term) AS first FROM stems GROUP BY stem")
def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the corpus by stem."""
    words = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term")).distinct()
    found = words.select("term", stem.stemmed(F.array("term"))[0].alias("stem"))
    return found.groupBy("stem").agg(F.count("*").alias("words"), F.min("term").alias("first"))


# As private_search, every token by its stem, those of the questions too.
@query(rf"""
WITH t AS (SELECT DISTINCT conv_id % 10 AS query_id, conv_id || '-' || turn || '-' || role || '-' || left(md5(coalesce(text, '')), 8) AS turn_id, {ANALYSED} AS toks FROM conversations)
, w0 AS (SELECT DISTINCT item_id % 10 AS query_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\w\s]', ' ', 'g')), '\s+'), lambda x: strlen(x) > 2)) AS term FROM benchmark)
, u AS (SELECT query_id, turn_id, len(toks)::DOUBLE AS len, unnest(toks) AS term FROM t)
, a AS (SELECT term FROM u UNION SELECT term FROM w0), {_stem_sql("a")}
, w AS (SELECT DISTINCT query_id, stem AS term FROM w0 JOIN stems USING (term))
, g AS (SELECT query_id, count(*)::DOUBLE AS n, avg(len(toks)) AS avgdl FROM t GROUP BY query_id)
, p AS (SELECT query_id, turn_id, len, w.term, count(*)::DOUBLE AS f FROM u JOIN stems ON stems.term = u.term JOIN w USING (query_id) WHERE w.term = stems.stem GROUP BY ALL)
, d AS (SELECT query_id, term, count(*)::DOUBLE AS d FROM p GROUP BY ALL)
, m AS (SELECT query_id, turn_id, round((CASE WHEN ln((n - d + 0.5::DOUBLE) / (d + 0.5::DOUBLE)) > 0 THEN ln((n - d + 0.5::DOUBLE) / (d + 0.5::DOUBLE)) ELSE 0.000001::DOUBLE END) * (f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avgdl))), 9)::DECIMAL(18, 9) AS part FROM p JOIN d USING (query_id, term) JOIN g USING (query_id))
, h AS (SELECT query_id, turn_id, sum(part) AS raw FROM m GROUP BY ALL)
SELECT query_id, turn_id, round(raw::DOUBLE, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, turn_id) - 1 AS rank FROM h) WHERE rank < 30
""")
def private_search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn_id = F.concat_ws("-", "conv_id", "turn", "role", F.left(F.md5(F.coalesce("text", F.lit(""))), F.lit(8)))
    haystacks = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("query_id"), turn_id.alias("turn_id"), "text").distinct()
    words = lexical.query_words(asked(spark, sf_dir)).select((F.col("query_id") % 10).alias("query_id"), stem.stemmed(F.array("term"))[0].alias("term")).distinct()
    found = lexical.search_private(words, haystacks, 30, key="turn_id", analyse=stem.stemmed_tokens)
    return found.select("query_id", "turn_id", F.round(F.col("raw_score").cast("double"), 6).alias("score"), "rank")


# ---------------------------------------------------------------- through spark.sql


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    register(spark)
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(f"gleanery_{name}")


@query(PLAIN_CHUNKS_SQL)
def sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "documents")
    return spark.sql("SELECT doc_id, c.* FROM gleanery_documents, LATERAL chunks(text, 'a.txt', 300) c")


@query(f"SELECT doc_id, len({ANALYSED}) AS n_tokens, sha256(array_to_string({ANALYSED}, ' ')) AS tokens_sha256 FROM documents")
def sql_analyse(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "documents")
    return spark.sql("SELECT doc_id, CAST(size(ts) AS BIGINT) AS n_tokens, sha2(array_join(ts, ' '), 256) AS tokens_sha256 FROM (SELECT doc_id, analyse(text) AS ts FROM gleanery_documents)")


@query(NEAREST.format(rows=COSINE))
def sql_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "embeddings")
    return spark.sql("""
        WITH q AS (SELECT min_by(embedding, vec_id) AS e FROM gleanery_embeddings), v AS (SELECT vec_id, label, embedding, (SELECT e FROM q) AS e FROM gleanery_embeddings), s AS (SELECT vec_id, label, cosine_score(embedding, e) AS raw FROM v)
        SELECT vec_id, label, round(raw, 6) AS score FROM s ORDER BY raw DESC, vec_id LIMIT 20
    """)


@query("WITH e AS " + EMBEDDED.replace("ROWS", "(SELECT item_id AS k, text FROM benchmark)") + " SELECT k AS item_id, list_transform(embedding, lambda x: round(x::DOUBLE, 5)) AS embedding FROM e")
def sql_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "benchmark")
    return spark.sql("SELECT item_id, transform(embed_text(text), x -> round(double(x), 5)) AS embedding FROM gleanery_benchmark")
