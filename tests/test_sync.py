"""Keyed state over a folder, and progress without scans of its own."""

import hashlib
import os
import time

from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.operators import ingest, vector
from gleanery.sources import folder
from gleanery.streaming.progress import Progress, counted, duration
from gleanery.streaming.sync import sync_files


def test_failures_are_tried_again_and_lost_files_deleted(spark, tmp_path):
    root, tries = tmp_path / "docs", tmp_path / "tries"
    root.mkdir()
    tries.mkdir()
    for name in ("a.md", "bad.md", "known.md", "gone.md"):
        (root / name).write_text(name)
        os.utime(root / name, (1000, 1000))
    (root / "gone.md").unlink()

    def work(collection, path):
        n = len(list(tries.glob(f"{path}.*")))
        (tries / f"{path}.{n}").touch()
        if path == "bad.md" and n < 2:
            raise OSError(f"try {n}")
        raw = folder.read_bytes(str(root), path)
        return raw.decode(), hashlib.sha256(raw).hexdigest()

    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    catalog = spark.createDataFrame([("notes", "known.md", 1000, digest("known.md")), ("notes", "gone.md", 1000, "x")], "collection string, path string, mtime long, hash string")
    seen = []
    actions = sync_files(folder.listings(spark, str(root), "notes", seconds=0.5), work, pause=0.5, patience=6, catalog=catalog)
    query = actions.writeStream.foreachBatch(lambda rows, n: seen.extend((r["path"], r["action"], r["failures"]) for r in rows.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    try:
        began, stage = time.time(), 0
        while time.time() - began < 120 and not ({("a.md", "changed", 0), ("known.md", "deleted", 0), ("gone.md", "deleted", 0)} <= set(seen)):
            assert query.exception() is None
            if stage == 0 and ("bad.md", "new", 0) in seen:
                stage = 1
                (root / "a.md").write_text("changed")
                (root / "known.md").unlink()
            time.sleep(0.3)
    finally:
        query.stop()
    assert [x for x in seen if x[0] == "bad.md"] == [("bad.md", "failed", 1), ("bad.md", "failed", 2), ("bad.md", "new", 0)]
    assert [x for x in seen if x[0] == "a.md"] == [("a.md", "new", 0), ("a.md", "changed", 0)]
    # what the catalog knew isn't read until it changes
    assert [x for x in seen if x[0] == "known.md"] == [("known.md", "deleted", 0)] and not list(tries.glob("known.md.*"))
    assert [x for x in seen if x[0] == "gone.md"] == [("gone.md", "deleted", 0)]
    assert len(list(tries.glob("a.md.*"))) == 2


def test_actions_bring_the_tables_up_to_date(spark):
    """The last action on a file counts, a batch that comes again changes nothing, failures leave what is there."""
    kind = "collection string, path string, action string, mtime long, hash string, body string, error string"
    kinds = ("doc_id string, collection string, path string, mtime long, hash string, body string", "doc_id string, seq int, content string, position int, token_count int", "doc_id string, seq int, embedding array<float>")
    frozen = lambda tables: ingest.Tables(*[spark.createDataFrame(x.collect(), x.schema) for x in tables])
    tables = ingest.Tables(*[spark.createDataFrame([], k) for k in kinds])
    batches = [
        [("c", "a", "new", 1, "h1", "one", None), ("c", "a", "changed", 2, "h2", "two", None), ("c", "b", "new", 1, "hb", "b", None), ("c", "bad", "failed", 1, None, None, "denied"), ("c", "never", "deleted", None, None, None, None)],
        [("c", "a", "touched", 5, "h2", None, None), ("c", "b", "failed", 3, None, None, "locked")],
        [("c", "b", "deleted", None, None, None, None)],
    ]
    logs = [["INSERT a", "INSERT b"], ["UPDATE a"], ["DELETE b"]]
    for rows, log in zip(batches, logs, strict=True):
        done = ingest.apply_actions(spark.createDataFrame(rows, kind), tables, dim=4)
        assert sorted(f"{r['operation']} {r['path']}" for r in done.log.collect()) == log
        assert sorted(r["error"] for r in done.failures.collect()) == sorted(r[6] for r in rows if r[6])
        tables = frozen(done.tables)
        again = ingest.apply_actions(spark.createDataFrame(rows, kind), tables, dim=4)
        assert [sorted(map(repr, x.collect())) for x in again.tables] == [sorted(map(repr, x.collect())) for x in tables]
    assert [(r["path"], r["mtime"], r["body"]) for r in tables.documents.collect()] == [("a", 5, "two")]
    assert [tables.chunks.count(), tables.vectors.count()] == [1, 1]


def test_progress_of_a_stream(spark, tmp_path):
    """Rows and vectors are counted as they are stored; the texts are read once."""
    rows = spark.range(200).select(F.col("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    progress = Progress(total=250)
    spark.streams.addListener(progress)

    def embedder(texts):
        if "text 13" in texts:
            raise ValueError("13")
        return vector.hash_embedder(4)(texts)

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = counted(vector.embed(stream, embedder, 4)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert progress.eta == "calculating..."
    query.awaitTermination(120)
    began = time.time()
    while progress.rows < 200 and time.time() - began < 20:
        time.sleep(0.2)
    spark.streams.removeListener(progress)
    assert (progress.rows, progress.embedded, progress.pending) == (200, 199, 51) and progress.batches >= 4
    assert progress.eta != "calculating..."
    read = sum(p["numInputRows"] for p in query.recentProgress)
    assert read == 200


def test_durations_are_those_of_the_column(spark):
    times = [0.2, 1.0, 59.9, 60.0, 61.5, 3599.0, 3600.0, 3725.0, 7200.0, 90061.0]
    got = [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t double").orderBy("i").select(text.eta(F.col("t")).alias("x")).collect()]
    assert got == [duration(t) for t in times]
