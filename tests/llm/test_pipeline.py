import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import queries, quality
from gleanery.llm.line_dedup import line_key


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2]
    assert len(corpus_pipeline.STAGES) == 5


def test_run(spark, sf_dir):
    first, second = (sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert first == second and len(first) > 50


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


#: Columns that operators add or use inside.
CLASHING = ("score", "n_lines", "n_dropped", "size", "source_size", "target", "copies", "taken", "row", "ids", "key", "u1", "shard")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls in all columns, empty and very long texts, ties, repeated rows and clashing names, and their labels."""
    folder = tmp_path_factory.mktemp("odd")
    good = lambda i: " ".join(f"river{(i * 7 + j) % 97} stone{(i + j * j) % 89} walks{j % 83}" for j in range(12))
    rows = [(i, f"common line\n{good(i)}", "en", None if i % 9 == 0 else f"s{i % 3}", 5) for i in range(40)]
    rows += [(100 + i, f"!!$$ ##{i} " * 30, None, "s0", 5) for i in range(20)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, good(300) + " end", "en", "s1", None), (202, good(300) + " end", "en", "s1", None), (None, good(301), "en", "s2", 1), (None, None, None, None, None), (203, "river stone walks " * 60_000, "en", "s0", 7), (204, good(5), "en", "s1", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHING]).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 40, 2)] + [(100 + i, 0, 0) for i in range(16)] + [(None, 1, 0), (200, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_documents(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, own = docs.columns, {(r["doc_id"], *[r[c] for c in CLASHING]) for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, odd).cache()
        assert docs.columns == columns, name
        seen[name] = docs.collect()
        assert {(r["doc_id"], *[r[c] for c in CLASHING]) for r in seen[name]} <= own, name
        assert sorted(map(repr, stage(spark, before.repartition(7), odd).collect())) == sorted(map(repr, seen[name])), name
    # the classifier: what its own scores say, text and columns as they were
    whole = spark.read.parquet(f"{odd}/documents.parquet").collect()
    model = quality.train(spark.read.parquet(f"{odd}/documents.parquet"), spark.read.parquet(f"{odd}/labels.parquet"))
    kept = [r for r in whole if quality.score(model, [(r["text"] or "").encode()])[0] >= 0.5]
    assert sorted(map(repr, seen["quality classifier"])) == sorted(map(repr, kept))
    assert {r["doc_id"] for r in kept} >= set(range(40)) and not {r["doc_id"] for r in kept} & set(range(100, 116))
    # lines: the common one goes, n_chars follows
    lines = {}
    for r in kept:
        for k in {line_key(x) for x in (r["text"] or "").encode().split(b"\n")}:
            lines[k] = lines.get(k, 0) + 1
    cut = [(str(r["doc_id"]), b"\n".join(x for x in (r["text"] or "").encode().split(b"\n") if not line_key(x) or lines[line_key(x)] < 10).decode()) for r in kept]
    assert sorted((str(r["doc_id"]), r["text"]) for r in seen["line dedup"]) == sorted(cut)
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line dedup"]) and lines[b"common line"] >= 40
    # one of each group: 5 and 204 have one text now, 202 comes twice
    ids = [r["doc_id"] for r in seen["SimHash near-dedup"]]
    assert 5 in ids and 204 not in ids and ids.count(202) == (202 in {r["doc_id"] for r in kept})
    # the mix takes rows whole
    assert {repr(r) for r in seen["mixing sources"]} <= {repr(r) for r in seen["SimHash near-dedup"]}
    ran = corpus_pipeline.run(spark, odd)
    assert sorted((str(r["doc_id"]), r["n_tokens"] > 0) for r in ran.collect()) == sorted((str(r["doc_id"]), bool(r["text"])) for r in seen["mixing sources"])


def test_no_documents(spark, odd, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() == 0


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_hard_negatives"])
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr([r[n] for n in names]) for r in got.collect()) == sorted(repr(list(r)) for r in cursor.fetchall())
