"""Lookups in the document tables and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import eta, line_slice, preview


def by_short_id(documents: DataFrame, prefix: str | Column, column: str = "doc_hash") -> DataFrame:
    """Rows whose id starts with prefix, as a plain string."""
    return documents.where(F.startswith(column, prefix if isinstance(prefix, Column) else F.lit(prefix)))


def one_by_short_id(documents: DataFrame, prefix: str, column: str = "doc_hash") -> dict:
    found = by_short_id(documents, prefix, column).limit(2).collect()
    if len(found) != 1:
        raise LookupError(f"{prefix!r} is {'ambiguous' if found else 'not found'}")
    return found[0].asDict()


def by_ids(rows: DataFrame, ids: list | DataFrame, key: str) -> DataFrame:
    """Rows of the ids: a list in place, a table by a semi join; no ids: no rows."""
    return rows.join(ids.select(key), key, "left_semi") if isinstance(ids, DataFrame) else rows.where(F.col(key).isin(ids)) if ids else rows.where("false")


def chunks_of(chunks: DataFrame, doc_id: int) -> DataFrame:
    return chunks.where(F.col("doc_id") == doc_id).orderBy("seq")


def get(documents: DataFrame, reference: str, first: int = 0, lines: int = 0, full: bool = False, body: str = "body") -> DataFrame:
    """The document of `#id` or `collection/path`: lines from first on, or a preview."""
    if reference.startswith("#"):
        rows = by_short_id(documents, reference[1:])
    else:
        collection, _, path = reference.partition("/")
        rows = documents.where((F.col("collection") == collection) & (F.col("path") == path))
    text = line_slice(F.col(body), first, lines) if first or lines else F.col(body)
    return rows.withColumn(body, preview(text, full=full))


def collection_counts(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """name, documents: also of collections without any, and of those only documents name whose names start with @."""
    listed = collections.select(F.col("name")).join(documents.select(F.col("collection").alias("name"), F.lit(1).alias("one")), "name", "left").groupBy("name").agg(F.count("one").alias("documents"))
    own = documents.where(F.startswith("collection", F.lit("@"))).groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("documents"))
    return listed.unionByName(own.join(collections.select("name"), "name", "left_anti"))


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """collection, chunks: only of collections with any."""
    return documents.select("doc_id", "collection").join(chunks.select("doc_id"), "doc_id").groupBy("collection").agg(F.count("*").alias("chunks"))


def status(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: documents, chunks, embedded, pending."""
    n = lambda rows, name: rows.agg(F.count("*").alias(name)).select(name).scalar()
    counts = documents.agg(F.count("*").alias("documents")).select("documents", n(chunks, "c").alias("chunks"), n(vectors, "v").alias("embedded"))
    return counts.select("*", F.greatest(F.col("chunks") - F.col("embedded"), F.lit(0)).cast("long").alias("pending"))


def remaining(pending: Column, embedded: Column, before: Column, elapsed_seconds: Column) -> Column:
    """Time left at the present pace, as text."""
    pace = (embedded - before) / elapsed_seconds
    return F.when((pace > 0) & (elapsed_seconds > 0), eta(pending / pace)).otherwise("calculating...")
