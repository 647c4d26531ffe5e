"""Change detection between files and catalog, changes applied to tables, and the change log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What names a file; a null collection or path is a name like any other.
NAME = ("collection", "path")


def _side_by_side(files: DataFrame, catalog: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Rows of files (f) and catalog (c) of the same name, and whether either is there."""
    joined = files.withColumn("__file", F.lit(True)).alias("f").join(catalog.withColumn("__known", F.lit(True)).alias("c"), _same_keys("f", "c", NAME), "full_outer")
    return joined, F.col("f.__file").isNotNull(), F.col("c.__known").isNotNull()


def _named(there: Column) -> list[Column]:
    return [F.when(there, F.col(f"f.{n}")).otherwise(F.col(f"c.{n}")).alias(n) for n in NAME]


def _compared(files: DataFrame, catalog: DataFrame) -> tuple[DataFrame, Column]:
    """Rows side by side with the action that takes the catalog to the files, and whether a file is there."""
    joined, there, known = _side_by_side(files, catalog)
    action = (
        F.when(~known, "new").when(~there, "deleted").when(F.col("f.mtime").eqNullSafe(F.col("c.mtime")), "unchanged")
        .when(F.col("f.hash").eqNullSafe(F.col("c.hash")), "touched").otherwise("changed")
    )
    return joined.withColumn("action", action), there


def diff(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """collection, path, action of every file or catalog row.

    Both have collection, path, mtime (seconds), hash. Actions: new, changed,
    deleted, touched (same content, other time: the time is to be stored) and
    unchanged. Equal times are trusted; hashes decide only where they differ.
    """
    found, there = _compared(files, catalog)
    return found.select(*_named(there), "action", F.col("c.mtime").alias("old_mtime"), F.col("f.mtime").alias("new_mtime"), F.col("c.hash").alias("old_hash"), F.col("f.hash").alias("new_hash"))


def to_look_at(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """collection, path, look, mtime, and old_* of the catalog's columns: what the times alone leave open.

    look is new or open (the time differs: only the content tells a changed file from a
    touched one) or deleted; files of equal times leave here, before anything is read.
    listing has collection, path, mtime, and perhaps error: what lies below a folder
    that couldn't be listed isn't taken for deleted.
    """
    unlisted = listing.where(F.col("error").isNotNull()).select("collection", F.col("path").alias("folder")) if "error" in listing.columns else None
    files = listing if unlisted is None else listing.where(F.col("error").isNull())
    joined, there, known = _side_by_side(files.select(*NAME, "mtime"), catalog)
    look = F.when(~known, "new").when(~there, "deleted").when(~F.col("f.mtime").eqNullSafe(F.col("c.mtime")), "open")
    found = joined.withColumn("look", look).where("look IS NOT NULL")
    found = found.select(*_named(there), "look", F.col("f.mtime").alias("mtime"), *[F.col(f"c.{c}").alias(f"old_{c}") for c in catalog.columns if c not in NAME])
    if unlisted is None:
        return found
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hidden = found.where("look = 'deleted'").select(*NAME, F.explode(above).alias("folder")).join(unlisted, ["collection", "folder"], "left_semi").select(*NAME).distinct()
    return found.alias("l").join(hidden.alias("h"), _same_keys("l", "h", NAME), "left_anti")


def settled(read: DataFrame) -> DataFrame:
    """What to_look_at gave, with its contents read (hash, error; null where deleted), and the action: new, changed, touched, deleted or failed."""
    action = (
        F.when(F.col("look") == "deleted", "deleted").when(F.col("error").isNotNull(), "failed").when(F.col("look") == "new", "new")
        .when(F.col("hash").eqNullSafe(F.col("old_hash")), "touched").otherwise("changed")
    )
    return read.withColumn("action", action)


def change_log(changes: DataFrame) -> DataFrame:
    """One INSERT, UPDATE or DELETE entry with a JSON payload per stored change; a changed file is a DELETE and an INSERT."""
    steps = F.when(F.col("action") == "new", F.array(F.lit("INSERT"))).when(F.col("action") == "deleted", F.array(F.lit("DELETE"))).when(F.col("action") == "touched", F.array(F.lit("UPDATE"))).when(F.col("action") == "changed", F.array(F.lit("DELETE"), F.lit("INSERT"))).otherwise(F.array().cast("array<string>"))
    rows = changes.select("*", F.posexplode(steps).alias("step", "operation"))
    # null fields are left out of the JSON, so each operation shows what it needs
    deleted, updated = F.col("operation") == "DELETE", F.col("operation") == "UPDATE"
    payload = F.struct("collection", "path", F.when(~updated, F.when(deleted, F.col("old_hash")).otherwise(F.col("new_hash"))).alias("hash"), F.when(updated, F.col("new_mtime")).alias("file_mod_time"))
    return rows.select("collection", "path", "step", "operation", F.to_json(payload).alias("data_json"))


def apply_to_catalog(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """The catalog after the changes: deleted rows gone, new and changed ones as the files are, times of touched ones stored.

    Unchanged rows stay as they are, also where a file of equal time has another
    hash. Columns that only the catalog has are null in new rows and kept in others.
    """
    found = _compared(files, catalog)[0].where("action <> 'deleted'")

    def value(c: str) -> Column:
        if c not in files.columns:
            return F.col(f"c.{c}").alias(c)
        from_file = F.col("action").isin("new", "changed", *(["touched"] if c == "mtime" else []))
        return F.when(from_file, F.col(f"f.{c}")).otherwise(F.col(f"c.{c}")).alias(c)

    return found.select(*[value(c) for c in catalog.columns])


def _one_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of rows with the same keys, the first in order; what is left open, the values of all columns decide."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *[F.col(c) for c in rows.columns if c not in keys]))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def _same_keys(a: str, b: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """rows replace those of the same keys (unique in table), others are added; operation tells INSERT from UPDATE.

    Of incoming rows with the same keys the last by `order` counts (greatest first
    where that leaves a choice). A null key is a key like any other. Rows that
    nothing replaces have a null operation.
    """
    last = _one_of_each(rows, keys, [F.col(c).desc_nulls_last() for c in [*order, *[c for c in rows.columns if c not in keys and c not in order]]])
    joined = table.withColumn("__old", F.lit(True)).alias("t").join(last.withColumn("__new", F.lit(True)).alias("r"), _same_keys("t", "r", keys), "full_outer")
    new = F.col("r.__new").isNotNull()
    operation = F.when(new & F.col("t.__old").isNotNull(), "UPDATE").when(new, "INSERT")
    return joined.select(*[F.when(new, F.col(f"r.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in table.columns], operation.alias("operation"))


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The rows whose keys the table hasn't; of rows with the same keys, the first by `order`, then by the other columns."""
    first = _one_of_each(rows, keys, [F.col(c) for c in order])
    return first.alias("r").join(table.select(*keys).alias("t"), _same_keys("r", "t", keys), "left_anti")


def delete_keys(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table without the rows whose keys stand in gone; a null key is a key like any other."""
    return table.alias("t").join(gone.select(*keys).alias("r"), _same_keys("t", "r", keys), "left_anti")


def delete_documents(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """documents, chunks and vectors without the documents in gone (doc_id), and the log of it."""
    left_chunks = chunks.join(gone, "doc_id", "left_anti")
    lost = chunks.join(gone, "doc_id", "left_semi")
    left_vectors = vectors.join(lost.select("chunk_id"), "chunk_id", "left_anti")
    log = lost.select(F.lit("chunk").alias("kind"), F.col("chunk_id").cast("string").alias("id"), F.lit("DELETE").alias("operation")).union(documents.join(gone, "doc_id", "left_semi").select(F.lit("document"), F.col("doc_id").cast("string"), F.lit("DELETE")))
    return documents.join(gone, "doc_id", "left_anti"), left_chunks, left_vectors, log


def missing_embeddings(documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents with a chunk that has no vector; collections whose names start with @ are left out."""
    bare = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti").select("doc_id").distinct()
    return documents.where(~F.startswith("collection", F.lit("@"))).join(bare, "doc_id", "left_semi")
