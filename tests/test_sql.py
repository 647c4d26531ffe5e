"""The functions that SQL gets, against those that plans use."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.functions.segment import Segmenter
from gleanery.operators import chunking, vector
from gleanery.sql import register

TEXTS = ["# Title\n\nThe café was running late. " + "More words follow here. " * 40, "搜索引擎 is 'quoted' \\ ß x", "", None, "plain " * 200]


@pytest.fixture(scope="module")
def docs(spark):
    def embedder(texts):
        if any("quoted" in t for t in texts):
            raise ValueError
        return vector.hash_embedder(4)(texts)

    register(spark, embedder, segmenter=Segmenter({"搜索": (5, "n"), "引擎": (5, "n"), "搜索引擎": (1, "n")}))
    rows = spark.createDataFrame([(i, t, "a.txt" if i % 2 else "b.md") for i, t in enumerate(TEXTS)], "doc_id long, text string, path string")
    rows.createOrReplaceTempView("sql_docs")
    return rows


def test_chunks(spark, docs):
    got = spark.sql("SELECT doc_id, c.* FROM sql_docs, LATERAL chunks(text, path, 300) c ORDER BY doc_id, seq")
    assert got.collect() == chunking.chunk(docs, ["doc_id"], path="path").orderBy("doc_id", "seq").collect()


def test_analysis(spark, docs):
    got = spark.sql("SELECT analyse(text) AS ts, token_estimate(text) AS n, short_id(sha2(text, 256)) AS id, stems(analyse(text)) AS st, segment(analyse('搜索引擎')) AS none FROM sql_docs ORDER BY doc_id").collect()
    want = docs.orderBy("doc_id").select(text.tokens(F.col("text")).alias("ts"), text.token_estimate(F.col("text")).alias("n"), text.short_id(F.sha2("text", 256)).alias("id")).collect()
    assert [(r["ts"], r["n"], r["id"]) for r in got] == [tuple(r) for r in want]
    assert "run" in got[0]["st"] and "cafe" in got[0]["st"] and got[3]["st"] == []
    assert spark.sql("SELECT segment(array('搜索引擎', 'x')) AS ws, segment_finer(array('搜索引擎')) AS fs").first().asDict() == {"ws": ["搜索", "引擎", "x"], "fs": ["搜索", "引擎"]}


def test_vectors(spark, docs):
    got = spark.sql("SELECT doc_id, embed_text(text) AS e FROM sql_docs ORDER BY doc_id").collect()
    assert [r["e"] is None for r in got] == [False, True, False, False, False]
    assert np.allclose(got[0]["e"], vector.hash_embedding(TEXTS[0], 4))
    scores = spark.sql("SELECT cosine_score(array(1F, 2F), array(2F, 1F)) AS a, cosine_score(array(0F, 0F), array(2F, 1F)) AS b, cosine_score(array(float('nan'), 0F), array(2F, 1F)) AS c").first()
    assert tuple(scores) == (pytest.approx(0.8), 0.0, 0.0)


def test_folders(spark, docs, tmp_path):
    (tmp_path / "x.md").write_text("x")
    assert spark.read.format("folder").option("path", str(tmp_path)).load().first()["path"] == "x.md"
