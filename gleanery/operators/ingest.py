"""Changed files brought into the tables: only new and changed documents are read, cut, embedded and stored."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import document_id
from gleanery.operators import changes, chunking, vector
from gleanery.operators.index import Index
from gleanery.sources.shared import stored


class Tables(NamedTuple):
    """documents: doc_id, collection, path, mtime, hash, body. chunks: doc_id, seq, content. vectors: doc_id, seq, embedding."""

    documents: DataFrame
    chunks: DataFrame
    vectors: DataFrame


class Ingested(NamedTuple):
    """The tables after the changes, the change log, and what failed: stage (list, read, embed), collection, path, doc_id, seq, error."""

    tables: Tables
    log: DataFrame
    failures: DataFrame


Chunker = Callable[[DataFrame], DataFrame]
#: Takes the rows to look at and gives them back with body, hash and error, as sources.folder.contents does.
Reader = Callable[[DataFrame], DataFrame]


def cut(documents: DataFrame) -> DataFrame:
    """The chunks of documents (doc_id, path, body)."""
    return chunking.chunk(documents, ["doc_id"], text="body", path="path")


def chunk_key(doc_id: str = "doc_id", seq: str = "seq") -> F.Column:
    """The key of a chunk in an index: its document and number."""
    return F.concat(F.col(doc_id).cast("string"), F.lit(":"), F.col(seq).cast("string"))


def _given(files: DataFrame) -> Reader:
    """Contents that the listing brought along."""
    def read(wanted: DataFrame) -> DataFrame:
        own = files.select(*changes.NAME, "body", "hash").alias("g")
        return wanted.alias("w").join(own, changes._same_keys("w", "g", changes.NAME)).select("w.*", "g.body", "g.hash", F.lit(None).cast("string").alias("error"))

    return read


def ingest(files: DataFrame, tables: Tables, embedder: vector.Embedder | None = None, dim: int = 64, chunker: Chunker = cut, read: Reader | None = None, attempts: int = 1, index: Index | None = None) -> Ingested:
    """The tables after files (collection, path, mtime), the change log and the failures.

    With read, contents are read of files whose time differs from the catalog's, and of
    no others; without, files has body and hash. A deleted document takes its chunks
    and vectors along; a changed one is deleted and inserted, under the id of its new
    content; a touched one only has its time stored. Chunks that have no vector, from an
    earlier run that failed, are embedded again. A file that can't be read and a text
    that can't be embedded (after some attempts) are failures; everything else is
    stored, and the next run tries them again, as their document or vector is missing.
    An index over chunk_key and content gets the same changes.

    What changed, its contents, the new chunks and the new vectors are each worked out
    once and stored; the tables given back are the old ones without and with them.
    """
    catalog = tables.documents.select(*changes.NAME, "mtime", "hash", "doc_id")
    look = stored(changes.to_look_at(files.select(*changes.NAME, "mtime", *(["error"] if "error" in files.columns and read else [])), catalog), "changes")
    wanted = look.where("look <> 'deleted'")
    found = changes.settled((read or _given(files))(wanted))
    found = stored(found.withColumn("body", F.when(F.col("action").isin("new", "changed"), F.col("body"))), "contents")
    gone = look.where("look = 'deleted'").withColumn("hash", F.lit(None).cast("string")).withColumn("action", F.lit("deleted"))
    done = _applied(found, gone, tables, embedder, dim, chunker, attempts, index)
    if "error" not in files.columns or not read:
        return done
    unlisted = files.where("error IS NOT NULL").select(F.lit("list").alias("stage"), *changes.NAME, _null("string").alias("doc_id"), _null("int").alias("seq"), "error")
    return done._replace(failures=done.failures.unionByName(unlisted))


def apply_actions(actions: DataFrame, tables: Tables, embedder: vector.Embedder | None = None, dim: int = 64, chunker: Chunker = cut, attempts: int = 1, index: Index | None = None) -> Ingested:
    """As ingest, of actions that keyed state has settled (streaming.sync.sync_files): collection, path, action, mtime, hash, body, error.

    Of several actions on one file, as a slow batch may bring, the last by time counts;
    applying a batch again changes nothing.
    """
    newest = changes._one_of_each(actions.where("action <> 'failed'"), changes.NAME, [F.col("mtime").desc_nulls_first()])
    failed = actions.where("action = 'failed'")
    known = tables.documents.select(*changes.NAME, F.col("mtime").alias("old_mtime"), F.col("hash").alias("old_hash"), F.col("doc_id").alias("old_doc_id"))
    kinds = ["collection", "path", "action", "mtime", "hash", "body", "error"]
    both = newest.select(*kinds).unionByName(failed.select(*kinds)).alias("a").join(known.alias("k"), changes._same_keys("a", "k", changes.NAME), "left")
    found = both.select("a.*", "k.old_mtime", "k.old_hash", "k.old_doc_id")
    # what the tables hold decides between new and changed; the same content again is a touch
    there, same = F.col("old_doc_id").isNotNull(), F.col("hash").eqNullSafe(F.col("old_hash"))
    action = F.when(~F.col("action").isin("new", "changed"), F.col("action")).when(there & same, "touched").when(there, "changed").otherwise("new")
    found = stored(found.withColumn("action", action).where((F.col("action") != "deleted") | there).where((F.col("action") != "touched") | there), "actions")
    return _applied(found.where("action <> 'deleted'"), found.where("action = 'deleted'"), tables, embedder, dim, chunker, attempts, index)


def _null(kind: str) -> F.Column:
    return F.lit(None).cast(kind)


def _applied(found: DataFrame, gone: DataFrame, tables: Tables, embedder: vector.Embedder | None, dim: int, chunker: Chunker, attempts: int, index: Index | None) -> Ingested:
    """The tables after settled rows, both stored already: found (new, changed, touched, failed) with contents, gone (deleted)."""
    columns = [*changes.NAME, "action", "mtime", "hash", "old_mtime", "old_hash", "old_doc_id"]
    actions = stored(found.select(*columns).unionByName(gone.select(*columns)), "actions")
    replaced = actions.where("action IN ('changed', 'deleted')").select(F.col("old_doc_id").alias("doc_id"))

    own = tables.documents.columns
    times = actions.where("action <> 'failed' AND action <> 'new'").select(F.col("old_doc_id").alias("doc_id"), "action", F.col("mtime").alias("__mtime"))
    kept = tables.documents.join(times, "doc_id", "left").where("action IS NULL OR action = 'touched'").withColumn("mtime", F.coalesce("__mtime", "mtime"))
    fresh = found.where("action IN ('new', 'changed')").withColumn("doc_id", document_id(F.col("collection"), F.col("path"), F.col("hash"))).select(*own)

    made = stored(chunker(fresh).select(*tables.chunks.columns), "chunks")
    chunks = tables.chunks.join(replaced, "doc_id", "left_anti")
    bare = chunks.join(tables.vectors.select("doc_id", "seq"), ["doc_id", "seq"], "left_anti")
    texts = made.select("doc_id", "seq", "content").unionByName(bare.select("doc_id", "seq", "content"))
    embedded = stored(vector.embed(texts, embedder, dim, text="content", error="error", attempts=attempts).select("doc_id", "seq", "embedding", "error"), "vectors")
    vectors = tables.vectors.join(replaced, "doc_id", "left_anti").unionByName(embedded.where("error IS NULL").select("doc_id", "seq", "embedding"))
    after = Tables(kept.select(*own).unionByName(fresh), chunks.unionByName(made), vectors)

    failed = found.where("action = 'failed'").select(F.lit("read").alias("stage"), *changes.NAME, _null("string").alias("doc_id"), _null("int").alias("seq"), "error")
    failed = failed.unionByName(embedded.where("error IS NOT NULL").select(F.lit("embed").alias("stage"), *[_null("string").alias(n) for n in changes.NAME], F.col("doc_id").cast("string").alias("doc_id"), F.col("seq").cast("int").alias("seq"), "error"))
    if index is not None:
        lost = tables.chunks.join(replaced, "doc_id", "left_semi").select(chunk_key().alias(index.key))
        index.update(lost, made.select(chunk_key().alias(index.key), F.col("content").alias("text")))
    log = changes.change_log(actions.where("action <> 'failed'").withColumnsRenamed({"mtime": "new_mtime", "hash": "new_hash"}))
    return Ingested(after, log, failed)
