"""What only larger tables show."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.functions import render, segment
from gleanery.functions import text as T
from gleanery.operators import index, lexical, retrieve, vector
from gleanery.plans import catalog


def same_as_sql(spark, folder, name, **tables):
    """Whether a query over tables gives its SQL's rows."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cursor = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    return want and sorted(repr(tuple(r[n] for n in names)) for r in catalog.QUERIES[name](spark, str(folder)).collect()) == want


@pytest.mark.parametrize("first", [99_980, 1_234_567, 20_000_000_000])
def test_long_question_numbers(spark, tmp_path, first):
    """Numbers of more than four digits stay whole."""
    ids = spark.range(first, first + 40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert same_as_sql(spark, tmp_path, "session_keys", documents=ids)


@pytest.mark.parametrize("step", [16, 41])
def test_scores_halfway_between_two_prints(spark, tmp_path, step):
    """0.37245 is a double below its decimal: 37.24, not 37.25."""
    docs = [(i, "a", "theast " * max(0, i % 5 - 2) + "x " * (i * step % 97)) for i in range(60)]
    assert same_as_sql(spark, tmp_path, "csv_rows", documents=spark.createDataFrame(docs, "doc_id long, source string, text string"))


@pytest.mark.parametrize("name", ["csv_rows", "text_rows", "markdown_rows", "json_rows"])
def test_copies_on_both_sides_of_the_cut(spark, tmp_path, name):
    """Of 45 equal texts that begin within the first 20, those with the least ids as shown; their places are those among all."""
    docs = [(i, f"s{i % 2}", "worthless" + " x" * (9 if i % 2 else i + 10)) for i in range(90)] + [(i, "t", "y z") for i in range(90, 300)]
    docs += [(300 + i, "u", "blehe blehe" + " x" * i) for i in range(8)]
    assert same_as_sql(spark, tmp_path, name, documents=spark.createDataFrame(docs, "doc_id long, source string, text string"))


def test_percentages_are_printed_as_elsewhere(spark):
    """All scores of six digits that end in a five, and those halfway between whole percents."""
    scores = spark.range(100_000).select(((F.col("id") * 10 + 5) / 1e6).alias("s")).union(spark.range(100).select((F.col("id") + 0.5) / 100))
    rows = scores.select("s", render.percent(F.col("s")).alias("whole"), render.percent(F.col("s"), 2).alias("two")).collect()
    assert len(rows) == 100_100
    assert not [r for r in rows if (r["whole"], r["two"]) != tuple(f"{r['s'] * 100:.{n}f}" for n in (0, 2))]


CLOSE = [("passage about worthless nation and theast w295 w347", "passage about worthless nation and theast w136 w89"), ("passage about worthless nation and theast w188 w178 w255 w385 w252 w76", "passage about worthless nation and theast w35 w170 w15")]


@pytest.mark.parametrize("empty", [[], [None, "", "-- !"]])
def test_passages_of_nearly_equal_likeness(spark, tmp_path, empty):
    """Cosines less than 1e-9 apart are tied, and the smaller id comes first though the other is nearer; texts without tokens stand where the SQL has them."""
    docs = [(i * 2 + j, pair[1 - j]) for i, pair in enumerate(CLOSE) for j in (0, 1)]
    docs += [(100 + i, f"blehe v{i}") for i in range(70)] + [(200 + i, t) for i, t in enumerate(empty)]
    near = vector.embed(spark.createDataFrame(docs, "doc_id long, text string"))
    query = retrieve.embed_query(f"A passage about {catalog.SEARCHED}.", vector.hash_embedder(64))
    cosines = {r["doc_id"]: r["c"] for r in near.select("doc_id", vector.cosine(F.col("embedding"), query).alias("c")).collect()}
    assert all(0 < cosines[i + 1] - cosines[i] < 1e-9 for i in (0, 2))
    assert same_as_sql(spark, tmp_path, "passage_search", documents=spark.createDataFrame([(i, "s", t) for i, t in docs], "doc_id long, source string, text string"))


def test_sums_that_differ_by_their_rounding_are_one_score(spark):
    """1/66 + 1/99 = 1/72 + 1/88, but not in doubles: rows at such places go by key."""
    place = {5: 38, 38: 5, 11: 27, 27: 11}
    corpus = spark.createDataFrame([(39 - i, "dog" + " x" * i) for i in range(40)] + [(i, "y") for i in range(40, 90)], "doc_id long, text string")
    vectors = spark.createDataFrame([(39 - i, [1.0, 0.01 * (place.get(i, i) + 1)]) for i in range(40)], "vec_id long, embedding array<double>")
    found = retrieve.hybrid_search(corpus, vectors, "dog", F.array(F.lit(1.0), F.lit(0.0)), 40, strategy="or").collect()
    tied = [r["doc_id"] for r in found if r["doc_id"] in (39 - i for i in place)]
    assert tied == [1, 12, 28, 34]


def test_many_texts_embedded_together(monkeypatch):
    """What hash_embedding gives for each alone, also when digests are forgotten."""
    texts = ["", "the The THE cat", "我在 home 我", "é 1 2 3", *[f"w{i} w{i % 7} x" for i in range(200)]]
    monkeypatch.setattr(vector, "KNOWN", 50)
    for dim in (4, 20, 64):
        some = vector.hash_embedder(dim)
        got = np.concatenate([some(texts[i : i + 30]) for i in range(0, len(texts), 30)])
        assert (got == np.stack([vector.hash_embedding(t, dim) for t in texts])).all()


def test_blocks_of_queries_are_scored_in_parts(spark, monkeypatch):
    """Ties included, whatever the size of the parts; no score table of a whole block is made."""
    data = np.random.default_rng(3).integers(-1, 2, (400, 3))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>").coalesce(1)
    whole = sorted(map(tuple, vector.nearest_batch(rows, rows, 5).select("query_id", "vec_id", "rank").collect()))
    assert vector.AT_ONCE * vector.BLOCK * 8 <= 4 << 20
    monkeypatch.setattr(vector, "AT_ONCE", 7)
    assert sorted(map(tuple, vector.nearest_batch(rows, rows, 5).select("query_id", "vec_id", "rank").collect())) == whole
    norm = np.linalg.norm(data, axis=1, keepdims=True)
    unit = data / np.where(norm > 0, norm, 1)
    score = np.round(unit @ unit.T, 9)
    assert whole == sorted((i, int(k), r) for i in range(400) for r, k in enumerate(np.lexsort((np.arange(400), -score[i]))[:5]))


def test_words_cut_in_parts(monkeypatch):
    """Tokens are cut a bounded number at a time, and what tasks get has no lexicon of strings."""
    cutter = segment.Segmenter({"们有": (5, "n"), "有上": (3, "n"), "中地": (2, "n")})
    column = pa.array([["们有上", "abc"], [], ["中地们有", "x有上y"] * 20, None, ["们"]], pa.list_(pa.string()))
    whole = cutter.lists(column).to_pylist()
    seen = []
    inner = segment.Segmenter._lists
    monkeypatch.setattr(segment.Segmenter, "_lists", lambda self, part, *rest: (seen.append(len(part.flatten())), inner(self, part, *rest))[1])
    monkeypatch.setattr(segment, "TOKENS", 10)
    known = {}
    assert cutter.lists(column, known=known).to_pylist() == cutter.lists(column, known=known).to_pylist() == whole
    assert len(seen) > 2 and max(seen) <= 42


def test_texts_are_cut_once(spark):
    """With columns to keep, rows and scores are those of two passes, filters and all strategies too, and each text is cut once."""
    rows = [(i, f"s{i % 3}", " ".join(["dog"] * (i % 4) + ["cat"] * (i % 3 > 1) + ["x"] * (i % 7))) for i in range(60)] + [(60, "s0", None)]
    corpus = spark.createDataFrame(rows, "doc_id long, source string, text string")
    cuts = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        cuts.add(1)
        return (text or "").split()

    for strategy, where in (("or", None), ("and", F.col("source") != "s1"), ("pos-must", None), ("or", F.col("source") == "none")):
        want = lexical.search(corpus, "dog cat", 9, strategy=strategy, where=where, analyse=cut).drop("text").collect()
        cuts.value = 0
        assert lexical.search(corpus, "dog cat", 9, strategy=strategy, where=where, analyse=cut, keep=["doc_id", "source"]).collect() == want
        assert cuts.value == 61
    assert lexical.search(corpus.limit(0), "dog", keep=["doc_id"]).count() == 0


def test_han_and_marks_as_before(spark):
    """Folding and lower case come before runs are cut; the tokens are the same."""
    texts = ["", None, "Çédille ÀB", "我在Été有上A", "有", "x有1上上 SS", "〇一々ÀÉ", "𠀀𠀁有é"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    marked = F.translate(T.segmented(F.coalesce("text", F.lit(""))), T.MARKED, T.BARE)
    before = F.array_remove(F.split(F.lower(marked), T.NOT_TOKEN), "")
    assert all(a == b for a, b in rows.select(T.tokens(F.col("text")), before).collect())


def test_files_of_an_index_are_small():
    """A task of a build sorts the postings of so much text, however large the corpus."""
    assert index.PART_BYTES <= 32 << 20


def test_known_vectors_are_made_once(spark, sf_dir):
    """Reading the result of ingest_changes embeds nothing."""
    found = catalog.QUERIES["ingest_changes"](spark, sf_dir)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
