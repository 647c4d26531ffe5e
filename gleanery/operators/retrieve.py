"""The searches that users call: keyword, vector, hybrid, and hybrid over a made-up passage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import words as W
from gleanery.operators import fusion, lexical, vector
from gleanery.operators.index import Index

#: Put before a query, not before documents, when a query is embedded.
QUERY_PREFIX = ""


def keyword_search(corpus: DataFrame, query: str, limit: int = 0, min_score: float = 0.0, strategy: str = "pos-or", where: Column | None = None, index: Index | None = None, **options) -> DataFrame:
    """By a scan of the corpus, or over its stored index; both give the same rows."""
    return lexical.search(corpus, query, limit if limit > 0 else fusion.DEFAULT_LIMIT, min_score, strategy, where, index=index, **options)


def vector_search(vectors: DataFrame, query: Column, limit: int = 0, min_score: float = 0.0, where: Column | None = None, **names: str) -> DataFrame:
    """A min_score of 0 means the default."""
    return vector.nearest(vectors, query, limit if limit > 0 else fusion.DEFAULT_LIMIT, where, min_score or fusion.VECTOR_MIN_SCORE, **names)


def hits(found: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Result rows of found (chunk_id, score, rank): with the chunk's text and line and its document's names.

    chunks: chunk_id, doc_id, content, position. documents: doc_id, doc_hash,
    collection, path, title. Chunks without a document are left out; ranks stay. The
    few found rows are the small side of both joins.
    """
    own = found.select("chunk_id", "score", "rank").join(chunks.select("chunk_id", "doc_id", "content", "position"), "chunk_id")
    named = own.join(documents.select("doc_id", "doc_hash", "collection", "path", "title"), "doc_id")
    return named.select("chunk_id", F.left("doc_hash", F.lit(8)).alias("doc_id"), F.col("doc_id").alias("doc_row_id"), "collection", "path", "title", "score", F.col("content").alias("snippet"), F.col("position").alias("line"), "rank")


def embed_query(text: str, embedder: vector.Embedder, prefix: str = QUERY_PREFIX) -> Column:
    return F.array(*[F.lit(float(x)) for x in embedder([prefix + text])[0]])


def hybrid_search(corpus: DataFrame, vectors: DataFrame, query: str, query_vector: Column, limit: int = 0, min_score: float = 0.0, strategy: str = "pos-or", key: str = "doc_id", vector_key: str = "vec_id", text: str = "text", index: Index | None = None, tagger: W.Tagger = W.tag, digits: int | None = None, undefined: float = 0.0) -> DataFrame:
    """key, score: both searches over-fetch, their ranks are fused, scores filtered, then limited; one job.

    digits and undefined are those of vector.nearest.
    """
    limit = limit if limit > 0 else fusion.DEFAULT_LIMIT
    fetch = fusion.overfetch(limit)
    words = lexical.search(corpus, query, fetch, 0.0, strategy, key=key, text=text, index=index, tagger=tagger).select(key, "score")
    near = vector.nearest(vectors, query_vector, fetch, key=vector_key, digits=digits, undefined=undefined).select(F.col(vector_key).alias(key), "score")
    lists = fusion.ranked(words, 0, key).unionByName(fusion.ranked(near, 1, key))
    # sums that differ by their rounding alone are one score
    fused = fusion.fuse(lists, key=key).withColumn("score", F.round("score", fusion.SCORE_DIGITS))
    return fusion.filter_and_limit(fused, min_score, limit, key)


def passage_search(corpus: DataFrame, vectors: DataFrame, query: str, passage: Callable[[str], str], embedder: vector.Embedder, **options) -> tuple[DataFrame, bool]:
    """Hybrid search whose vector side looks for a passage made up for the query; if none can be made, for the query. Tells which."""
    try:
        text, made = passage(query), True
    except Exception:  # the passage comes from outside; any failure of it means the plain search
        text, made = query, False
    return hybrid_search(corpus, vectors, query, embed_query(text, embedder), **options), made
