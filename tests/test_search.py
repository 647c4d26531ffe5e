import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.functions import text, words
from gleanery.operators import changes, collection, evaluate, fusion, ingest, lexical, retrieve, vector
from gleanery.operators import index as module
from gleanery.operators.index import Index

TEXTS = ["the quick brown fox", "the lazy dog sleeps", "quick quick dog", "a café near the fox den", "nothing here at all", "dog dog dog fox"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS, 1)), "doc_id long, text string").cache()


def fts5(match, weight=None):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(content, tokenize='unicode61')")
    con.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", list(enumerate(TEXTS, 1)))
    score = f"-bm25(t, {weight})" if weight else "-rank"
    return {r: s for r, s in con.execute(f"SELECT rowid, {score} FROM t WHERE t MATCH ?", (match,))}


@pytest.mark.parametrize(
    ("match", "terms", "weight"),
    [
        ("quick OR fox", lexical.Terms(any=("quick", "fox")), None),
        ("quick OR quick OR dog", lexical.Terms(any=("quick", "quick", "dog")), None),
        ("the OR dog", lexical.Terms(any=("the", "dog")), None),
        ("cafe", lexical.Terms(any=("café",)), None),
        ("dog AND (quick OR fox)", lexical.Terms(any=("quick", "fox"), all=("dog",)), None),
        ('"do"* AND "qu"*', lexical.Terms(all=("do", "qu"), prefix=True), 1.5),
    ],
)
def test_bm25_is_that_of_the_full_text_index(corpus, match, terms, weight):
    want = fts5(match, weight)
    got = {r["doc_id"]: r["raw_score"] for r in lexical.bm25(corpus, terms, weight=weight or 1.0).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_restriction_keeps_statistics(corpus):
    terms = lexical.Terms(any=("dog",))
    whole = {r["doc_id"]: r["score"] for r in lexical.bm25(corpus, terms).collect()}
    some = {r["doc_id"]: r["score"] for r in lexical.bm25(corpus, terms, where=F.col("doc_id") > 2).collect()}
    assert some == {k: v for k, v in whole.items() if k > 2}


@pytest.mark.parametrize("strategy", [*lexical.STRATEGIES, "df", ""])
def test_strategies(corpus, strategy):
    found = lexical.search(corpus, "quick dog", 3, strategy=strategy).collect()
    assert found and all(0 <= r["score"] <= 1 for r in found)


def test_empty_query(corpus):
    assert lexical.search(corpus, "", 5).count() == 0


def test_query_terms():
    assert words.or_terms("The quick é a fox the 字 AND") == ["The", "quick", "fox", "AND"] or "字" in words.or_terms("字")
    assert "字" in words.or_terms("字") and words.tagged_terms("字") == ([], [])
    assert len(words.STOP_WORDS) > 150 and len(words.or_terms("word " * 300)) == 256
    tagger = words.tagger(words.read_lexicon(["nation n", "run v", "", "a b c"]))
    nouns, others = words.must_terms(" ".join(["Nation"] * 300 + ["run"] * 100), tagger)
    assert (len(nouns), len(others)) == (192, 64)
    assert words.must_terms("nation", words.tag) == ([], ["nation"])


def test_lexicon_table(spark):
    rows = spark.createDataFrame([("Fox", "n"), ("quick", "adj"), ("unasked", "n")], "word string, pos string")
    tagger = lexical.lexicon_tagger(rows, "the quick fox jumps")
    assert tagger("the quick fox jumps") == [("the", "det"), ("quick", "adj"), ("fox", "n"), ("jumps", "x")]
    assert lexical.lexicon_tagger(rows, "")("") == []


def test_han_text_is_cut_on_both_sides(spark):
    texts = ["搜索引擎", "全文搜索 engine", "引擎abc搜", "无关的字", "搜 索", "plain words"]
    corpus = spark.createDataFrame([*enumerate(texts, 1)], "doc_id long, text string")
    found = lambda q, **o: {r["doc_id"] for r in lexical.search(corpus, q, 9, **o).collect()}
    assert found("搜索") == {1, 2} and found("搜索引擎") == {1, 2, 3} and found("搜") == {3, 5}
    assert found("engine") == {2} and found("abc") == {3}
    assert found("搜索引擎", strategy="pos-must", tagger=words.tagger({"搜索": "n", "引擎": "n"})) == {1}
    assert found("搜索", strategy="and") == {1, 2}
    whole = corpus.select(text.whole_runs(F.col("text")).alias("ts")).first()["ts"]
    assert whole == ["搜索引擎"] and words.cut("搜索引擎") == ["搜索", "索引", "引擎"]
    # another segmentation, on both sides
    own = {"analyse": text.whole_runs, "cutter": lambda w: [w], "tagger": words.tagger(words.LEXICON, lambda w: [w])}
    assert found("搜索引擎", **own) == {1} and found("搜索", **own) == set() and found("全文搜索", **own) == {2}
    for query in ("搜索引擎", "x字y naïve 搜索"):
        assert corpus.limit(1).select(text.tokens(F.lit(query)).alias("ts")).first()["ts"] == [w.lower() for w in words.words(query)]


@pytest.mark.parametrize("strategy", lexical.STRATEGIES)
@pytest.mark.parametrize("query", ["quick dog", "the fox near", "qu do", "absent"])
def test_index_gives_what_the_scan_gives(spark, corpus, tmp_path_factory, strategy, query):
    index = Index(str(tmp_path_factory.mktemp("index"))).write(corpus)
    for where in (None, F.col("doc_id") > 2):
        scan, stored = (sorted(map(repr, retrieve.keyword_search(corpus, query, 4, strategy=strategy, where=where, index=i).withColumn("score", F.round("score", 9)).drop("raw_score").collect())) for i in (None, index))
        assert scan == stored


def test_index_of_nothing(spark, corpus, tmp_path):
    index = Index(str(tmp_path / "none")).write(corpus.limit(0))
    assert retrieve.keyword_search(corpus.limit(0), "quick dog", index=index).count() == 0


def test_a_frequent_term_has_several_files(spark, tmp_path, monkeypatch):
    """It is dealt over as many files as its share of the corpus asks for, and found whole; folders are bounded."""
    monkeypatch.setattr(module, "PART_BYTES", 1000)
    monkeypatch.setattr(module, "MOST_RANGES", 5)
    corpus = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common w"), F.col("id").cast("string")).alias("text"))
    index = Index(str(tmp_path / "many")).write(corpus)
    assert index.bm25(spark, lexical.Terms(any=("common",))).count() == 1000
    (segment,) = index.version(spark)["segments"]
    blocks = spark.read.parquet(f"{index.path}/segments/{segment['name']}/blocks")
    assert blocks.where("term = 'common'").select(F.input_file_name()).distinct().count() > 4
    assert blocks.select("range").distinct().count() <= 6


def scored(rows):
    return [(r["doc_id"], round(r["raw_score"], 9)) for r in rows.collect()]


def random_corpus(spark, n, seed):
    rng = np.random.default_rng(seed)
    words_ = [f"t{i}" for i in range(60)]
    p = 1 / np.arange(1, 61) ** 1.1
    texts = [" ".join(rng.choice(words_, int(rng.integers(0, 2 ** rng.integers(1, 8))), p=p / p.sum())) for _ in range(n)]
    return spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "doc_id long, text string")


def test_best_rows_are_those_of_the_full_scoring(spark, tmp_path, monkeypatch):
    """Blocks are left out without a change of the result; rare terms beside frequent ones leave out most."""
    monkeypatch.setattr(module, "BLOCK", 8)
    corpus = random_corpus(spark, 1500, 1)
    index = Index(str(tmp_path / "top")).write(corpus)
    rng = np.random.default_rng(2)
    shares = []
    for k in range(12):
        terms = lexical.Terms(any=tuple(f"t{i}" for i in rng.integers(0, 60, 1 + k % 4)))
        limit = int(rng.integers(1, 30))
        assert scored(index.top(spark, terms, limit)) == scored(lexical.top(index.bm25(spark, terms), limit))
        if k % 4 == 1:
            read, whole = index.blocks_read(spark, terms, 3)
            shares.append(read / whole)
    assert scored(index.top(spark, terms, 9)) == scored(lexical.top(lexical.bm25(corpus, terms), 9))
    assert min(shares) < 0.3
    assert index.top(spark, lexical.Terms(any=("absent",)), 3).count() == 0


def test_updated_index_is_a_fresh_one(spark, tmp_path, monkeypatch):
    """Deleted, changed and new rows, several times over and merged, against an index built at once."""
    monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(module, "MOST_SEGMENTS", 2)
    rows = {r["doc_id"]: r["text"] for r in random_corpus(spark, 300, 3).collect()}
    table = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string")
    index = Index(str(tmp_path / "kept")).write(table(rows))
    rng = np.random.default_rng(4)
    for step in range(3):
        gone = rng.choice(list(rows), 30, replace=False).tolist()
        added = {int(i): f"t{i % 7} t3 fresh{step}" for i in [*gone[:10], 1000 + step, 2000 + step]}
        rows = {i: t for i, t in rows.items() if i not in gone} | added
        index.update(spark.createDataFrame([(i,) for i in gone], "doc_id long"), table(added))
        fresh = Index(str(tmp_path / f"fresh{step}")).write(table(rows))
        assert index.statistics(spark).first() == fresh.statistics(spark).first()
        for terms in (lexical.Terms(any=("t3", "t5")), lexical.Terms(any=("t1",), all=("t3",)), lexical.Terms(all=("fresh", "t"), prefix=True), lexical.Terms(any=(f"fresh{step}", "fresh0"))):
            assert scored(index.bm25(spark, terms).orderBy("doc_id")) == scored(fresh.bm25(spark, terms).orderBy("doc_id"))
            assert scored(index.top(spark, terms, 7)) == scored(fresh.top(spark, terms, 7))
    assert len(index.version(spark)["segments"]) <= 2
    index.merge(spark)
    (only,) = index.version(spark)["segments"]
    assert not only["deletes"] and only["rows"] == len(rows)
    assert scored(index.top(spark, lexical.Terms(any=("t3", "t5")), 7)) == scored(fresh.top(spark, lexical.Terms(any=("t3", "t5")), 7))
    assert len(index.vacuum(spark, 1)) > 2 and index.vacuum(spark, 1) == []
    assert scored(index.top(spark, lexical.Terms(any=("t3", "t5")), 7)) == scored(fresh.top(spark, lexical.Terms(any=("t3", "t5")), 7))
    index.update(spark.createDataFrame([(i,) for i in rows], "doc_id long"), None)
    assert index.top(spark, lexical.Terms(any=("t3",)), 7).count() == 0 and index.version(spark)["rows"] == 0


def test_a_prefix_reads_its_range_of_terms(spark, tmp_path, monkeypatch):
    """The files read for a prefix don't grow with the other terms."""
    monkeypatch.setattr(module, "PART_BYTES", 20_000)
    read = []
    for others in (2000, 8000):
        corpus = spark.range(others).select(F.col("id").alias("doc_id"), F.concat(F.lit("b"), F.sha2(F.col("id").cast("string"), 256), F.lit(" "), F.when(F.col("id") < 50, F.concat(F.lit("apple"), F.col("id").cast("string"))).otherwise("zebra")).alias("text"))
        index = Index(str(tmp_path / f"p{others}")).write(corpus)
        terms = lexical.Terms(all=("apple",), prefix=True)
        assert index.bm25(spark, terms).count() == 50
        (segment,) = index.version(spark)["segments"]
        folders = index.folders(spark, terms, segment["name"])
        blocks = spark.read.parquet(f"{index.path}/segments/{segment['name']}/blocks")
        read.append(blocks.where(F.col("range").isin(folders)).select(F.input_file_name()).distinct().count())
        assert len(folders) < 0.2 * blocks.select("range").distinct().count()
    assert read[1] <= read[0] + 1


def test_batch_equals_single(spark, corpus):
    index = lexical.postings(corpus)
    some = lexical.postings(corpus, terms=spark.createDataFrame([("quick",), ("zebra",)], "term string"))
    assert sorted(map(repr, some.collect())) == sorted(map(repr, index.where("term = 'quick'").collect()))
    asked = lexical.rare_terms(spark.createDataFrame([(7, "quick dog zebra")], "query_id long, query string"), index)
    assert {r["term"]: r["df"] for r in asked.collect()} == {"quick": 2, "dog": 3, "zebra": 0}
    got = {r["doc_id"]: float(r["raw_score"]) for r in lexical.search_batch(asked, index, lexical.statistics(corpus)).collect()}
    want = {r["doc_id"]: r["raw_score"] for r in lexical.bm25(corpus, lexical.Terms(any=("quick", "dog", "zebra"))).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_fusion_goldens(spark):
    def run(lists, weights=()):
        rows = [(i, k, r) for i, keys in enumerate(lists) for r, k in enumerate(keys)]
        return {r["doc_id"]: round(r["score"], 6) for r in fusion.fuse(spark.createDataFrame(rows, "list_id int, doc_id long, rank int"), weights).collect()}

    assert run([[1, 2, 3], [3, 1, 4]]) == {1: 1.0, 3: 0.995549, 2: 0.454240, 4: 0.449790}
    assert run([[1], [2], [3]]) == {1: 1.0, 2: 1.0, 3: 0.801980}
    assert run([[1, 2], [3, 1]], (1, 1)) == {1: 1.0, 3: 0.804550, 2: 0.437808}
    assert (fusion.overfetch(5), fusion.overfetch(0), fusion.overfetch(500)) == (15, 1000, 1000)


def test_payload_prefers_a_snippet(spark):
    lists = spark.createDataFrame([(0, 1, 0, "", "a"), (1, 1, 0, "text", "b"), (0, 2, 1, "own", "c"), (1, 2, 1, "other", "d")], "list_id int, doc_id long, rank int, snippet string, title string")
    got = fusion.with_payload(fusion.fuse(lists), lists, ["snippet", "title"], "snippet").collect()
    assert {r["doc_id"]: (r["snippet"], r["title"]) for r in got} == {1: ("text", "b"), 2: ("own", "c")}


def test_hash_embedding():
    a, b = vector.hash_embedding("Hello 世界"), vector.hash_embedding("hello 世 界")
    assert (a == b).all() and math.isclose(float((a * a).sum()), 1, rel_tol=1e-5)
    assert not vector.hash_embedding("...").any()


def test_nearest_batch_is_nearest(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(6)]) for i in range(40)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["score"] for r in vector.nearest_batch(v.where("vec_id = 3"), v, 5).collect()}
    want = {r["vec_id"]: r["score"] for r in vector.nearest(v, F.array(*[F.lit(x) for x in rows[3][1]]), 5).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_query_groups_do_not_matter(spark, monkeypatch):
    rows = [(i, [float((i * 5 + j * j) % 13 - 6) for j in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    near = lambda: sorted(map(repr, vector.nearest_batch(v, v, 3).drop("score").collect()))
    one = near()
    monkeypatch.setattr(vector, "GROUP_BYTES", 1000)
    assert near() == one and len(one) == 180


def test_changes(spark):
    kind = "collection string, path string, mtime long, hash string"
    files = spark.createDataFrame([("c", "same", 1, "a"), ("c", "touched", 2, "b"), ("c", "changed", 2, "x"), ("c", "new", 1, "n"), ("c", "zero", 5, "z")], kind)
    old = spark.createDataFrame([("c", "same", 1, "other"), ("c", "touched", 1, "b"), ("c", "changed", 1, "c"), ("c", "gone", 1, "g"), ("c", "zero", 0, "z")], kind)
    found = changes.diff(files, old)
    assert {r["path"]: r["action"] for r in found.collect()} == {"same": "unchanged", "touched": "touched", "changed": "changed", "new": "new", "gone": "deleted", "zero": "touched"}
    log = [(r["path"], r["operation"]) for r in changes.change_log(found).orderBy("path", "step").collect()]
    assert log == [("changed", "DELETE"), ("changed", "INSERT"), ("gone", "DELETE"), ("new", "INSERT"), ("touched", "UPDATE"), ("zero", "UPDATE")]
    after = {r["path"]: (r["mtime"], r["hash"], r["note"]) for r in changes.apply_to_catalog(old.withColumn("note", F.lit("kept")), files).collect()}
    # of equal times, the catalog's hash stays
    assert after == {"same": (1, "other", "kept"), "touched": (2, "b", "kept"), "changed": (2, "x", "kept"), "new": (1, "n", None), "zero": (5, "z", "kept")}


def test_upsert_and_ignore(spark):
    kind = "k string, v int, t int"
    table = spark.createDataFrame([("a", 1, 0), ("b", 2, 0), (None, 3, 0)], kind)
    rows = spark.createDataFrame([("a", 5, 1), ("a", 4, 2), ("c", 7, 1), ("c", 9, 1), (None, 8, 1)], kind)
    got = sorted(map(repr, map(tuple, changes.upsert(table, rows, ["k"], ["t"]).collect())))
    assert got == sorted(map(repr, [("a", 4, 2, "UPDATE"), ("b", 2, 0, None), (None, 8, 1, "UPDATE"), ("c", 9, 1, "INSERT")]))
    assert [tuple(r) for r in changes.insert_or_ignore(table, rows, ["k"], ["t"]).collect()] == [("c", 7, 1)]


def test_collections(spark):
    empty = spark.createDataFrame([], collection.COLLECTIONS)
    docs = spark.createDataFrame([(1, "notes"), (2, "notes"), (3, "@sys")], "doc_id long, collection string")
    known = collection.add(collection.add(empty, "notes", "/data/notes", exists=lambda _: True), "other", "/tmp", "*.md", ["x"])
    for name, path, error in (("", "/tmp", ValueError), ("@me", "/tmp", ValueError), ("new", "tmp", ValueError), ("new", "/no/such/folder", FileNotFoundError), ("notes", "/tmp", collection.Duplicate)):
        with pytest.raises(error):
            collection.add(known, name, path)
    assert {(r["name"], r["glob"], r["documents"]) for r in collection.listing(known, docs).collect()} == {("notes", "**/*.{md,txt}", 2), ("other", "*.md", 0), ("@sys", None, 1)}
    for old, new, error in (("gone", "x", LookupError), ("notes", "other", collection.Duplicate), ("notes", "@x", ValueError), ("notes", "", ValueError)):
        with pytest.raises(error):
            collection.rename(known, docs, old, new)
    renamed, moved, log = collection.rename(known, docs, "notes", "moved")
    assert {r["name"] for r in renamed.collect()} == {"moved", "other"} and moved.where("collection = 'moved'").count() == log.count() == 2
    chunks = docs.select("doc_id", F.col("doc_id").alias("chunk_id"))
    with pytest.raises(LookupError):
        collection.remove(known, docs, chunks, chunks, "gone")
    left = collection.remove(known, docs, chunks, chunks.select("chunk_id"), "notes")
    assert [x.count() for x in left] == [1, 1, 1, 1, 4]


def test_ingest_touches_only_changes(spark):
    seen = []

    def lines(rows):
        return rows.select("doc_id", F.posexplode(F.split("body", "\n", -1)).alias("seq", "content"))

    kind = "collection string, path string, mtime long, hash string, body string"
    first = spark.createDataFrame([("c", p, 1, f"h{p}", f"{p} one\n{p} two") for p in ("same", "touched", "changed", "gone")], kind)
    nothing = ingest.Tables(*[spark.createDataFrame([], k) for k in ("doc_id string, " + kind, "doc_id string, seq int, content string", "doc_id string, seq int, embedding array<float>")])
    tables, log, failures = ingest.ingest(first, nothing, dim=8, chunker=lines)
    assert [x.count() for x in (*tables, log, failures)] == [4, 8, 8, 4, 0]
    frozen = ingest.Tables(*[spark.createDataFrame(x.collect(), x.schema) for x in tables])
    # a vector that an earlier run failed to write
    frozen = frozen._replace(vectors=frozen.vectors.join(frozen.documents.where("path = 'same'").select("doc_id", F.lit(1).alias("seq")), ["doc_id", "seq"], "left_anti"))
    second = spark.createDataFrame([("c", "same", 1, "other", "unread"), ("c", "touched", 2, "htouched", "touched one\ntouched two"), ("c", "changed", 2, "x", "new text"), ("c", "new", 2, "n", "a\nb\nc")], kind)
    after, log, _ = ingest.ingest(second, frozen, embedder=lambda texts: (seen.extend(texts), vector.hash_embedder(8)(texts))[1], dim=8, chunker=lines)
    chunks = after.chunks.join(after.documents.select("doc_id", "path"), "doc_id").groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in chunks} == {"same": 2, "touched": 2, "changed": 1, "new": 3}
    assert after.vectors.count() == 8 and after.vectors.select("doc_id", "seq").distinct().count() == 8
    assert sorted((r["path"], r["mtime"]) for r in after.documents.collect()) == [("changed", 2), ("new", 2), ("same", 1), ("touched", 2)]
    assert sorted((r["path"], r["operation"]) for r in log.collect()) == [("changed", "DELETE"), ("changed", "INSERT"), ("gone", "DELETE"), ("new", "INSERT"), ("touched", "UPDATE")]


def test_paths_end_alike(spark):
    hits = spark.createDataFrame([(1, "docs://c/A.md", 0), (1, "c/sub/b.md", 1), (1, "c/sub/b.md", 2), (1, "xb.md", 3)], "query_id long, path string, rank int")
    expected = spark.createDataFrame([(1, "./a.md"), (1, "sub/b.md"), (1, "gone.md"), (2, None)], "query_id long, path string")
    got = {r["query_id"]: r for r in evaluate.path_metrics(hits, expected).collect()}
    assert (got[1]["hits"], got[1]["mrr"], round(got[1]["recall_at_5"], 6), got[2]["hits"]) == (2, 1.0, 0.666667, 0)


def test_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "z", 0)], "query_id long, key string, rank int")
    expected = spark.createDataFrame([(1, "b"), (1, "c"), (1, "q"), (2, "a"), (3, None)], "query_id long, key string")
    got = {r["query_id"]: r for r in evaluate.metrics(hits, expected, "key").collect()}
    assert round(got[1]["recall_at_5"], 6) == 0.666667 and got[1]["mrr"] == 0.5 and got[1]["hits"] == 2
    assert math.isclose(got[1]["ndcg"], (1 / math.log2(3) + 1 / 2) / (1 + 1 / math.log2(3) + 1 / 2))
    assert got[2]["mrr"] == 0 and got[3]["recall_at_5"] == 0 and got[3]["ndcg"] == 0


def test_hits_drop_orphans(spark):
    found = spark.createDataFrame([(1, 0.9, 0), (2, 0.8, 1), (3, 0.7, 2)], "chunk_id long, score double, rank int")
    chunks = spark.createDataFrame([(1, 10, "a", 4), (2, 99, "b", 5), (3, 10, "c", 6)], "chunk_id long, doc_id long, content string, position int")
    docs = spark.createDataFrame([(10, "abcdefghij", "n", "n/x.md", "X")], "doc_id long, doc_hash string, collection string, path string, title string")
    got = retrieve.hits(found, chunks, docs).orderBy("rank").collect()
    assert [(r["chunk_id"], r["doc_id"], r["line"], r["rank"]) for r in got] == [(1, "abcdefgh", 4, 0), (3, "abcdefgh", 6, 2)]


def test_relevant_sessions(spark):
    turns = spark.createDataFrame([(1, False), (1, True), (2, False)], "conv_id long, has_answer boolean")
    assert [r["conv_id"] for r in evaluate.relevant_sessions(turns).collect()] == [1]


def test_passages_fall_back(spark, corpus):
    vectors = vector.embed(corpus, dim=16).select(F.col("doc_id").alias("vec_id"), "embedding")
    embedder = vector.hash_embedder(16)

    def broken(_):
        raise OSError("no service")

    plain, made = retrieve.passage_search(corpus, vectors, "quick dog", broken, embedder, limit=3)
    assert not made and plain.count() == 3
    wanted = retrieve.hybrid_search(corpus, vectors, "quick dog", retrieve.embed_query("quick dog", embedder), limit=3)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, wanted.collect()))
    assert retrieve.passage_search(corpus, vectors, "quick dog", lambda q: q + " lazy", embedder)[1]


def test_backends_side_by_side(spark):
    """Four searches judged in one plan, each query to its own limit, as each alone."""
    rng = np.random.default_rng(8)
    kind = "query_id long, path string, rank int"
    lists = [spark.createDataFrame([(q, f"d{d}", r) for q in range(3) for r, d in enumerate(rng.permutation(120)[:90].tolist())], kind) for _ in range(3)]
    queries = spark.createDataFrame([(0, 1), (1, 0), (2, 20)], "query_id long, k int")
    asked = queries.select("query_id", evaluate.limits(queries).alias("most"))
    assert sorted(r["most"] for r in asked.collect()) == [10, 30, 60]
    hits = evaluate.backends(*lists, asked, key="path").cache()
    assert {(r["backend"], r["query_id"]): r["count"] for r in hits.groupBy("backend", "query_id").count().collect()} == {(b, q): m for b in ("keyword", "vector", "hybrid", "hyde") for q, m in ((0, 10), (1, 30), (2, 60))}
    pair = lists[0].withColumn("list_id", F.lit(0)).unionByName(lists[2].withColumn("list_id", F.lit(1))).where("query_id = 0 AND rank < 30")
    want = [r["path"] for r in fusion.fuse(pair, key="path").orderBy(F.round("score", 9).desc(), "path").limit(10).collect()]
    assert [r["path"] for r in hits.where("backend = 'hyde' AND query_id = 0").orderBy("rank").collect()] == want
    expected = spark.createDataFrame([(q, f"d{d}") for q in range(3) for d in range(4)], "query_id long, path string")
    got = {r["backend"]: r for r in evaluate.compare(hits, expected, ("keyword", "vector", "hybrid", "hyde", "none")).collect()}
    for b in ("keyword", "hyde"):
        alone = evaluate.means(evaluate.path_metrics(hits.where(F.col("backend") == b), expected).withColumn("one", F.lit(1)), ["one"], ["recall_at_10", "mrr"]).first()
        assert (got[b]["queries"], round(got[b]["recall_at_10"], 9), round(got[b]["mrr"], 9)) == (3, round(alone["recall_at_10"], 9), round(alone["mrr"], 9))
    assert (got["none"]["queries"], got["none"]["mrr"]) == (3, 0.0)


def test_statistics_come_with_the_postings(spark, corpus):
    terms = spark.createDataFrame([("quick",), ("fox",)], "term string")
    found = lexical.postings(corpus, terms=terms, every=True)
    assert lexical.statistics_of(found).first() == lexical.statistics(corpus).first()
    assert {r["term"] for r in found.collect()} == {"quick", "fox", lexical.EVERY}


def test_collections_by_any_scheme(spark, tmp_path):
    empty = spark.createDataFrame([], collection.COLLECTIONS)
    assert collection.add(empty, "here", f"file://{tmp_path}").count() == 1
    with pytest.raises(FileNotFoundError):
        collection.add(empty, "here", f"file://{tmp_path}/none")
