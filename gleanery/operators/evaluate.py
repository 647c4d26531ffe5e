"""Retrieval quality: recall, reciprocal rank and discounted gain per query, many queries at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import path_matches, session_key
from gleanery.operators import fusion


def first_places(hits: DataFrame, key: str) -> DataFrame:
    """Each key of a query once, at its best rank, ranks counted anew."""
    best = hits.groupBy("query_id", key).agg(F.min("rank").alias("rank"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", key)) - 1)


def metrics(hits: DataFrame, expected: DataFrame, key: str, ks: tuple[int, ...] = (5, 10), depth: int = 10) -> DataFrame:
    """query_id, expected, hits, recall_at_k, mrr and ndcg: every query that expected names, also without hits.

    hits: query_id, key, rank (from 0). expected: query_id, key, distinct; a null key
    stands for a query that expects nothing, whose figures are 0.
    """
    asked = expected.groupBy("query_id").agg(F.count(key).alias("expected"))
    found = hits.join(expected.where(F.col(key).isNotNull()).distinct(), ["query_id", key]).where(F.col("rank") < max(depth, *ks))
    within = lambda k: F.count_distinct(F.when(F.col("rank") < k, F.col(key)))
    gain = F.sum(F.when(F.col("rank") < depth, F.lit(1.0) / F.log2(F.col("rank") + 2.0)))
    first = F.min(F.when(F.col("rank") < depth, F.col("rank")))
    got = found.groupBy("query_id").agg(*[within(k).alias(f"in_{k}") for k in ks], within(depth).alias("hits"), gain.alias("gain"), first.alias("first"))
    # the gain if the first places were all expected ones
    n = F.least(F.col("expected"), F.lit(depth)).cast("int")
    ideal = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1.0))).otherwise(0.0)
    rows = asked.join(got, "query_id", "left")
    share = lambda c: F.when(F.col("expected") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("expected")).otherwise(0.0)
    return rows.select(
        "query_id", "expected", F.coalesce("hits", F.lit(0)).alias("hits"), *[share(f"in_{k}").alias(f"recall_at_{k}") for k in ks],
        F.coalesce(F.lit(1.0) / (F.col("first") + 1), F.lit(0.0)).alias("mrr"), F.when(n > 0, F.coalesce("gain", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
    )


def relevant_paths(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, path, rank: hits (query_id, path, rank) under the name that expected (query_id, path) has for them.

    A hit stands for an expected path that it equals or ends with after a slash,
    scheme, case and leading ./ apart. Both sides meet on the query, then on the path.
    """
    asked = expected.select("query_id", F.col("path").alias("wanted"))
    found = hits.join(asked, "query_id").where(path_matches(F.col("path"), F.col("wanted")))
    return found.groupBy("query_id", F.col("wanted").alias("path")).agg(F.min("rank").alias("rank"))


def path_metrics(hits: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (5, 10), depth: int = 10) -> DataFrame:
    """metrics() with paths as keys, hits found by relevant_paths."""
    return metrics(relevant_paths(hits, expected), expected, "path", ks, depth)


def compare(hits: DataFrame, expected: DataFrame, backends: Sequence[str], ks: tuple[int, ...] = (5, 10), depth: int = 10) -> DataFrame:
    """backend, queries and the means of recall_at_k, mrr and hits of several searches' hits (backend, query_id, path, rank).

    All searches are judged in one plan: a query of a backend is a query of its own.
    """
    own = F.struct("backend", "query_id").alias("query_id")
    asked = expected.select(F.explode(F.array(*[F.lit(b) for b in backends])).alias("backend"), "query_id", "path")
    per_query = path_metrics(hits.select(own, "path", "rank"), asked.select(own, "path"), ks, depth)
    return means(per_query.withColumn("backend", F.col("query_id.backend")), ["backend"], [*[f"recall_at_{k}" for k in ks], "mrr", "hits"])


def limits(queries: DataFrame, k: str = "k") -> Column:
    """How many hits a query is asked for: three times its k (10 where it has none), 10 at least."""
    return F.greatest(3 * F.when(F.col(k) > 0, F.col(k)).otherwise(10), F.lit(10)).cast("int")


def backends(words: DataFrame, near: DataFrame, passages: DataFrame, asked: DataFrame, key: str = "doc_id") -> DataFrame:
    """backend, query_id, key, rank: keyword, vector, hybrid, and hyde, hybrid by made-up passages, each to its query's limit.

    words, near, passages: query_id, key, rank of the three lists, down to the fused
    depth (three times a query's limit). asked: query_id, most (its limit).
    """
    lists = [x.join(asked, "query_id").where(F.col("rank") < F.least(3 * F.col("most"), F.lit(fusion.OVERFETCH_MOST))) for x in (words, near, passages)]
    single = [x.select(F.lit(name).alias("backend"), "query_id", key, "rank", "most") for name, x in zip(("keyword", "vector"), lists, strict=False)]
    tag = lambda x, name, i: x.select(F.lit(name).alias("backend"), "query_id", key, "rank", F.lit(i).alias("list_id"))
    both = None
    for name, x in (("hybrid", lists[1]), ("hyde", lists[2])):
        part = tag(lists[0], name, 0).unionByName(tag(x, name, 1))
        both = part if both is None else both.unionByName(part)
    place = F.row_number().over(Window.partitionBy("backend", "query_id").orderBy(F.round("score", 9).desc(), key)) - 1
    fused = fusion.fuse(both, key=key, per=["backend", "query_id"]).select("backend", "query_id", key, place.alias("rank")).join(asked, "query_id")
    every = single[0].unionByName(single[1]).unionByName(fused)
    return every.where(F.col("rank") < F.col("most")).drop("most")


def means(per_query: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return per_query.groupBy(*by).agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in columns])


def session_documents(turns: DataFrame) -> DataFrame:
    """conv_id, text: the turns of a session in order, as `User: ...` or `Assistant: ...` lines; blank turns are left out."""
    line = F.concat(F.when(F.col("role") == "assistant", "Assistant: ").otherwise("User: "), F.col("text"))
    kept = turns.where(F.coalesce(F.btrim("text"), F.lit("")) != "").select("conv_id", F.struct("turn", line.alias("line")).alias("t"))
    lines = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return lines.select("conv_id", F.array_join(F.transform("ts", lambda t: t["line"]), "\n").alias("text"))


def own_sessions(hits: DataFrame) -> DataFrame:
    """Hits (query_id, path, rank) among the sessions of their own question, by their file names, ranks counted anew."""
    own = hits.where(session_key(F.col("path"))["question"] == F.col("query_id"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "path")) - 1)


def relevant_sessions(turns: DataFrame) -> DataFrame:
    """conv_id of the sessions of which a turn has the answer."""
    return turns.groupBy("conv_id").agg(F.max("has_answer").alias("relevant")).where("relevant").select("conv_id")
