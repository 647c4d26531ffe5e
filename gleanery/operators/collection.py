"""Collections: named folders with a file pattern; adding, listing, renaming and removing them, with the rules for names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.catalog import collection_counts
from gleanery.operators.changes import delete_documents
from gleanery.sources.folder import DEFAULT_GLOB
from gleanery.sources.folder import exists as is_there

#: A table of collections.
COLLECTIONS = "name string, path string, glob string, ignore array<string>"


class Duplicate(ValueError):
    """A collection of that name is there already."""


def _known(collections: DataFrame, name: str) -> bool:
    return not collections.where(F.col("name") == name).isEmpty()


def _own_name(name: str) -> None:
    if not name:
        raise ValueError("a collection needs a name")
    if name.startswith("@"):
        raise ValueError("names that start with @ are the system's")


def add(collections: DataFrame, name: str, path: str, glob: str = "", ignore: Sequence[str] = (), exists: Callable[[str], bool] | None = None) -> DataFrame:
    """collections with one more; a bad name, a path that isn't absolute or isn't there (in Spark's file systems), and a known name are refused."""
    _own_name(name)
    if not (path.startswith("/") or "://" in path):
        raise ValueError("the path must be absolute")
    if not (exists(path) if exists else is_there(collections.sparkSession, path)):
        raise FileNotFoundError(path)
    if _known(collections, name):
        raise Duplicate(name)
    row = collections.sparkSession.createDataFrame([(name, path, glob or DEFAULT_GLOB, list(ignore) or None)], COLLECTIONS)
    return collections.unionByName(row, allowMissingColumns=True)


def listing(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """name, path, glob, ignore, documents: the collections and, without a path, those of the system that documents name."""
    return collection_counts(collections, documents).join(collections, "name", "left").select("name", "path", "glob", "ignore", "documents")


def renamed(column: str | Column, old: str, new: str) -> Column:
    own = F.col(column) if isinstance(column, str) else column
    return F.when(own == old, new).otherwise(own)


def rename(collections: DataFrame, documents: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """collections and documents under the new name, and an UPDATE entry for each document; vectors and chunks follow their documents."""
    _own_name(new)
    if not _known(collections, old):
        raise LookupError(old)
    if old != new and _known(collections, new):
        raise Duplicate(new)
    log = documents.where(F.col("collection") == old).select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.lit("UPDATE").alias("operation"))
    return collections.withColumn("name", renamed("name", old, new)), documents.withColumn("collection", renamed("collection", old, new)), log


def remove(collections: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """collections, documents, chunks and vectors without a collection, and the log of what went."""
    _own_name(name)
    if not _known(collections, name):
        raise LookupError(name)
    gone = documents.where(F.col("collection") == name).select("doc_id")
    return collections.where(F.col("name") != name), *delete_documents(documents, chunks, vectors, gone)
