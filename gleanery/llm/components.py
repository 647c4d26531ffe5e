"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import discard, stored


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of it and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node; a node and its smaller neighbours are tied to the smallest."""
    least = _minima(edges).withColumnRenamed("u", "w")
    joined = edges.join(least, F.col("u") == F.col("w"))
    rest = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """u, v: every node of a link that isn't its component's smallest, and the smallest.

    edges: u, v of one orderable type; loops and repeats are allowed, nulls are left
    out. Rounds end when the table stays as it was; each is written to the shared
    folder, so a lost executor costs one round, and the one before it is deleted. Minima are taken before the shuffle;
    in the join, the rows of a node with very many links are one key, which adaptive
    execution splits (spark.sql.adaptive.skewJoin, on unless turned off).
    """
    table = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    table = stored(table, "links")
    mark = _mark(table)
    for _ in range(rounds):
        if not mark[0]:
            break
        before, table = table, stored(_small_star(_large_star(table)), "links")
        discard(before)
        new = _mark(table)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return table


def _mark(table: DataFrame) -> tuple:
    return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
