"""Reciprocal rank fusion of ranked lists, thresholds and limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT, FIRST_BONUS, NEXT_BONUS = 60, 0.05, 0.02
OVERFETCH_MOST, DEFAULT_LIMIT, VECTOR_MIN_SCORE = 1000, 5, 0.3
SCORE_DIGITS = 6


def ranked(rows: DataFrame, list_id: int, key: str = "doc_id", by: str = "score") -> DataFrame:
    """One ranked list as list_id, key, rank (from 0) and the other columns."""
    place = F.row_number().over(Window.orderBy(F.col(by).desc(), key))
    return rows.select("*", F.lit(list_id).alias("list_id"), (place - 1).alias("rank"))


def list_weight(list_id: Column, weights: Sequence[float] = ()) -> Column:
    """Of the first lists as given; the others weigh 2 if among the first two lists, else 1."""
    out = F.when(list_id < 2, 2.0).otherwise(1.0)
    for i, w in reversed(list(enumerate(weights))):
        out = F.when(list_id == i, float(w)).otherwise(out)
    return out


def fuse(lists: DataFrame, weights: Sequence[float] = (), key: str = "doc_id", per: Sequence[str] = ()) -> DataFrame:
    """key and fused score, 0 to 1, of rows (list_id, key, rank); `per`: columns that keep queries apart.

    A key gets weight / (61 + rank) from each place it has, and a bonus for its best
    rank once. Partial sums are taken before the shuffle by key.
    """
    share = list_weight(F.col("list_id"), weights) / (F.lit(RANK_CONSTANT + 1.0) + F.col("rank"))
    best = F.min("rank")
    bonus = F.when(best == 0, FIRST_BONUS).when(best <= 2, NEXT_BONUS).otherwise(0.0)
    summed = lists.groupBy(*per, key).agg((F.sum(share) + bonus).alias("fused"))
    top = F.max("fused").over(Window.partitionBy(*per))
    return summed.select(*per, key, F.when(top > 0, F.col("fused") / top).otherwise(F.col("fused")).alias("score"))


def with_payload(fused: DataFrame, lists: DataFrame, payload: Sequence[str], snippet: str, key: str = "doc_id") -> DataFrame:
    """The fused rows with the payload of the first list that has the key, one with a snippet before one without."""
    order = F.struct((F.coalesce(F.col(snippet), F.lit("")) == "").alias("empty"), "list_id", "rank")
    first = lists.groupBy(key).agg(F.min_by(F.struct(*payload), order).alias("__payload"))
    return fused.join(first, key).select(*fused.columns, "__payload.*")


def filter_and_limit(rows: DataFrame, min_score: float, limit: int, key: str = "doc_id") -> DataFrame:
    """Scores first, then the limit; 0 turns either off."""
    rows = rows.where(F.col("score") >= min_score) if min_score > 0 else rows
    rows = rows.orderBy(F.col("score").desc(), key)
    return rows.limit(limit) if limit > 0 else rows


def overfetch(limit: int) -> int:
    return 3 * limit if 0 < 3 * limit <= OVERFETCH_MOST else OVERFETCH_MOST
