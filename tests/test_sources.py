import json
import os
import time

import numpy as np
from pyspark.sql import functions as F

from gleanery.functions import render, text
from gleanery.operators import catalog, ingest, lexical, vector
from gleanery.operators.index import Index
from gleanery.sources import files, folder
from gleanery.streaming.watch import changes_in_windows, watch


def test_globs():
    assert files.expand("**/*.{md,txt}") == ["**/*.md", "**/*.txt"]
    assert files.expand("a{ x , y }b{c,d}") == ["axb{c,d}", "ayb{c,d}"]
    assert files.expand("*.md") == ["*.md"]


def test_scan_and_watch(spark, tmp_path):
    for name, body in (("a.md", "# A\n"), ("sub/b.txt", "b"), ("sub/c.go", "c"), ("node_modules/d.md", "d"), ("e.tmp.md", "e")):
        os.makedirs(tmp_path / "docs" / os.path.dirname(name), exist_ok=True)
        (tmp_path / "docs" / name).write_text(body)
    listing = lambda: files.scan(spark, str(tmp_path / "docs"), "notes", ignore=["node_modules", "*.tmp.md"]).select("collection", "path", "mtime", "hash")
    assert sorted(r["path"] for r in listing().collect()) == ["a.md", "sub/b.txt"]

    state = {"catalog": spark.createDataFrame([("notes", "gone.md", 1, "x")], "collection string, path string, mtime long, hash string"), "log": []}

    def write(catalog, log, batch):
        rows = [tuple(r) for r in catalog.collect()]
        state["log"] += [(r["path"], r["operation"]) for r in log.collect()]
        state["catalog"] = spark.createDataFrame(rows, catalog.schema)

    query = watch(spark, listing, lambda: state["catalog"], write, str(tmp_path / "check"), once=True)
    query.awaitTermination(60)
    query.stop()
    assert sorted(r["path"] for r in state["catalog"].collect()) == ["a.md", "sub/b.txt"]
    assert {("a.md", "INSERT"), ("sub/b.txt", "INSERT"), ("gone.md", "DELETE")} <= set(state["log"])


def test_watched_files_are_ingested(spark, tmp_path):
    """Two looks at a folder: all files are cut and embedded, then the changed one only."""
    watched = tmp_path / "docs"
    watched.mkdir()
    (watched / "a.md").write_text("# A\nfirst text")
    (watched / "b.txt").write_text("second text")
    listing = lambda: files.scan(spark, str(watched), "notes").select("collection", "path", "mtime", "hash", "body")
    kinds = ("doc_id string, collection string, path string, mtime long, hash string, body string", "doc_id string, seq int, content string, position int, token_count int", "doc_id string, seq int, embedding array<float>")
    state = {"tables": ingest.Tables(*[spark.createDataFrame([], k) for k in kinds]), "log": []}

    def write(tables, log, batch):
        frozen = [(x.collect(), x.schema) for x in (*tables, log)]
        state["tables"] = ingest.Tables(*[spark.createDataFrame(rows, kind) for rows, kind in frozen[:3]])
        state["log"].append(sorted((r["path"], r["operation"]) for r in frozen[3][0]))

    for look in range(2):
        query = watch(spark, listing, lambda: state["tables"], write, str(tmp_path / f"check{look}"), once=True, apply=lambda found, tables: ingest.ingest(found, tables, dim=8)[:2])
        query.awaitTermination(60)
        query.stop()
        (watched / "b.txt").write_text("second text, changed")
        os.utime(watched / "b.txt", (2_000_000_000, 2_000_000_000))
    assert [x.count() for x in state["tables"]] == [2, 2, 2]
    assert {r["content"] for r in state["tables"].chunks.collect()} == {"# A\nfirst text", "second text, changed"}
    assert state["log"] == [[("a.md", "INSERT"), ("b.txt", "INSERT")], [("b.txt", "DELETE"), ("b.txt", "INSERT")]]


def test_windows_as_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = changes_in_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_datasets(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"question": "q", "question_type": "t", "haystack_sessions": [[{"role": "user", "content": "hi", "has_answer": True}], []]}]))
    turns = files.question_turns(files.questions(spark, str(tmp_path / "q.json"))).collect()
    assert [(r["session"], r["text"], r["has_answer"]) for r in turns] == [(0, "hi", True)]
    (tmp_path / "b.json").write_text(json.dumps({"collection": "c", "queries": [{"id": "1", "query": "x", "type": "t", "expected_files": ["a.md"]}]}))
    assert files.bench_queries(spark, str(tmp_path / "b.json")).first()["k"] == 10


def test_settings():
    got = files.settings({"chunk_size": 200, "llm_api_key": "file"}, "LLM_API_KEY=dot\n", {"LLM_API_KEY": "env", "CHUNK_SIZE": "9"})
    assert (got.chunk_size, got.llm_api_key) == (200, "env")
    assert files.settings({"llm_api_key": "file"}, "LLM_API_KEY=dot", {}).llm_api_key == "dot"


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(text.title(F.lit("a\n  # Title  \nb"), F.lit("x/y.md"))) == "Title"
    assert get(text.title(F.lit("## no\ntext"), F.lit("x/name.md"))) == "name"
    assert get(text.eta(F.lit(0.5))) == "<1s" and get(text.eta(F.lit(3725))) == "1h2m" and get(text.eta(F.lit(7200))) == "2h"
    assert get(text.tokens(F.lit("École, CAFÉ straße!"))) == ["ecole", "cafe", "straße"]
    assert get(text.safe(F.lit("a-b café"), folded=False)) == "a b caf "
    assert get(text.path_matches(F.lit("docs://Docs/a.md"), F.lit("./a.MD"))) is True
    assert get(text.session_key(F.lit("q0001_s042.md")))["session"] == 41
    assert get(text.line_slice(F.lit("a\nb\nc"), 2, 1)) == "b" and get(text.line_slice(F.lit("a\nb\nc"), 9, 2)) == "a\nb"


def test_get_and_ids(spark):
    docs = spark.createDataFrame([("ab1", "c", "x.md", "l1\nl2"), ("ab2", "c", "y.md", "z" * 600)], "doc_hash string, collection string, path string, body string")
    assert catalog.get(docs, "c/x.md", 2, 1).first()["body"] == "l2"
    assert catalog.get(docs, "#ab2").first()["body"] == "z" * 500 + "..."
    assert catalog.one_by_short_id(docs, "ab1")["path"] == "x.md"
    for bad in ("ab", "zz", "a%"):
        try:
            catalog.one_by_short_id(docs, bad)
            raise AssertionError
        except LookupError:
            pass
    assert catalog.by_ids(docs, [], "path").count() == 0


def test_render(spark):
    hits = spark.createDataFrame([("p.md", 3, "abcd", "", "", 0.5, "s\n", 0)], "path string, line int, doc_id string, title string, collection string, score double, snippet string, rank int")
    assert render.document(render.markdown_rows(hits), "markdown").startswith("### 1. p.md\n- **Path**: `p.md`\n- **Score**: 50%\n")
    assert "collection" not in render.json_rows(hits).first()["json"]
    assert render.csv_rows(hits).first()["score"] == "50.00"
    assert render.document(render.text_rows(hits.limit(0)), "text") == render.NOTHING


KINDS = ("doc_id string, collection string, path string, mtime long, hash string, body string", "doc_id string, seq int, content string, position int, token_count int", "doc_id string, seq int, embedding array<float>")


def frozen(spark, tables):
    return ingest.Tables(*[spark.createDataFrame(x.collect(), x.schema) for x in tables])


def test_only_files_of_another_time_are_read(spark, tmp_path):
    """Of 1,000 files one changes, one is touched, one is new and one goes: three bodies are read."""
    root, seen = tmp_path / "docs", tmp_path / "seen"
    seen.mkdir()
    for i in range(1000):
        (root / f"d{i % 20}").mkdir(parents=True, exist_ok=True)
        (root / f"d{i % 20}" / f"{i}.md").write_text(f"# {i}\ntext {i}")
        os.utime(root / f"d{i % 20}" / f"{i}.md", (1000, 1000))
    (root / "skipped").mkdir()
    (root / "skipped" / "x.md").write_text("x")

    def read(base, path):
        (seen / path.replace("/", "_")).touch()
        return folder.read_bytes(base, path)

    def look(tables, **options):
        found = folder.listing(spark, str(root), "notes", ignore=["skipped"])
        return ingest.ingest(found, tables, dim=8, read=lambda rows: folder.contents(rows, str(root), read), **options)

    tables, log, failures = look(ingest.Tables(*[spark.createDataFrame([], k) for k in KINDS]))
    tables = frozen(spark, tables)
    assert [x.count() for x in (*tables, log, failures)] == [1000, 1000, 1000, 1000, 0] and len(list(seen.iterdir())) == 1000
    for f in seen.iterdir():
        f.unlink()
    (root / "d7" / "7.md").write_text("changed")
    os.utime(root / "d8" / "8.md", (2000, 2000))
    (root / "d9" / "new.md").write_bytes(b"not \xff utf-8")
    (root / "d3" / "3.md").unlink()
    tables, log, failures = look(tables)
    assert sorted((r["path"], r["operation"]) for r in log.collect()) == [("d3/3.md", "DELETE"), ("d7/7.md", "DELETE"), ("d7/7.md", "INSERT"), ("d8/8.md", "UPDATE"), ("d9/new.md", "INSERT")]
    assert sorted(f.name for f in seen.iterdir()) == ["d7_7.md", "d8_8.md", "d9_new.md"]
    assert tables.documents.where("path = 'd9/new.md'").first()["body"] == "not � utf-8" and failures.count() == 0


def test_failures_leave_the_rest(spark, tmp_path):
    """A file that can't be read, a folder that can't be listed and a text that can't be embedded; the next run has them."""
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    for name in ("a.md", "b.md", "sub/c.md"):
        (root / name).write_text(f"text of {name}")

    def read(base, path):
        if path == "b.md" and not (tmp_path / "well").exists():
            raise OSError("no such luck")
        return folder.read_bytes(base, path)

    def embedder(texts):
        if any("sub/c" in t for t in texts) and not (tmp_path / "well").exists():
            raise RuntimeError("service")
        return vector.hash_embedder(8)(texts)

    index = Index(str(tmp_path / "index"), key="chunk")
    reader = lambda rows: folder.contents(rows, str(root), read)
    found = folder.listing(spark, str(root), "notes")
    first = ingest.ingest(found, ingest.Tables(*[spark.createDataFrame([], k) for k in KINDS]), embedder=embedder, dim=8, read=reader, index=index)
    tables = frozen(spark, first.tables)
    assert [x.count() for x in tables] == [2, 2, 1]
    failed = sorted(map(tuple, first.failures.select("stage", "path", "error").collect()), key=repr)
    assert failed == [("embed", None, "RuntimeError: service"), ("read", "b.md", "OSError: no such luck")]
    assert index.search(spark, lexical.Terms(any=("sub",))).count() == 1 and index.version(spark)["rows"] == 2
    # nothing has changed, yet what failed is tried again
    (tmp_path / "well").touch()
    again = ingest.ingest(found, tables, embedder=embedder, dim=8, read=reader, index=index)
    assert [x.count() for x in (*again.tables, again.log, again.failures)] == [3, 3, 3, 1, 0] and index.version(spark)["rows"] == 3
    # what lies below a folder that wasn't listed isn't deleted
    hidden = found.where("path NOT LIKE 'sub/%'").unionByName(spark.createDataFrame([("notes", "sub", None, None, "denied")], found.schema))
    third = ingest.ingest(hidden, frozen(spark, again.tables), dim=8, read=reader)
    assert third.tables.documents.count() == 3 and third.log.count() == 0 and [r["stage"] for r in third.failures.collect()] == ["list"]


def test_embedding_isolates_failures(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id int, text string").repartition(2)

    def embedder(texts):
        if "t7" in texts:
            raise ValueError("bad text")
        return vector.hash_embedder(4)(texts)

    got = vector.embed(rows, embedder, 4, error="why").collect()
    assert [r["id"] for r in got if r["embedding"] is None] == [7] and {r["why"] for r in got} == {None, "ValueError: bad text"}
    assert vector.embed(rows, embedder, 4).where("embedding IS NOT NULL").count() == 19
    assert vector.one_by_one(lambda t: np.zeros((9, 2)), ["a"])[0][1].startswith("ValueError")


def test_listing_as_a_stream(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("a")
    looks = []
    query = folder.listings(spark, str(root), "notes", seconds=0.5).writeStream.foreachBatch(lambda rows, n: looks.append(sorted(r["path"] for r in rows.collect()))).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    began = time.time()
    while (not looks or looks[-1] != ["b.md"]) and time.time() - began < 60:
        if looks and (root / "a.md").exists():
            (root / "a.md").rename(root / "b.md")
        time.sleep(0.2)
    query.stop()
    assert looks[0] == ["a.md"] and looks[-1] == ["b.md"]
