"""Uniform shuffle into shards of exact sizes; DataFrame functions only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one local permutation sorts, about; at most so many blocks.
BLOCK_ROWS, MOST_BLOCKS = 20_000, 4096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Exact draw; numpy's own is limited to populations under 10^9.

    Beyond that it walks outwards from the mode by the ratio of neighbouring
    probabilities, which takes a few standard deviations of steps.
    """
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    lg = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    up = down = math.exp(lg(good, mode) + lg(bad, draws - mode) - lg(good + bad, draws))
    left, (i, j) = rng.random() - up, (mode, mode)
    while left > 0 and (i < high or j > low):
        if i < high:
            up *= (good - i) * (draws - i) / ((i + 1) * (bad - draws + i + 1))
            i += 1
            left -= up
            if left <= 0:
                return i
        if j > low:
            down *= j * (bad - draws + j) / ((good - j + 1) * (draws - j + 1))
            j -= 1
            left -= down
            if left <= 0:
                return j
    return mode


def communication_matrix(blocks: list[int], shards: list[int], seed: int = 0) -> list[list[int]]:
    """How many rows of each block go to each shard: row sums are blocks, column sums shards.

    Each row is drawn from the multivariate hypergeometric law of what is left, one
    conditional hypergeometric per entry, as a uniform permutation would fill it.
    """
    rng, left, out = np.random.default_rng(seed), list(shards), []
    for rows in blocks:
        rest, need, row = sum(left), rows, []
        for s, room in enumerate(left):
            rest -= room
            take = need if s == len(left) - 1 else hypergeometric(rng, room, rest, need)
            row.append(take)
            need -= take
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def _numbered(rows: DataFrame, group: str, bits: int, by: tuple[str, str], name: str) -> DataFrame:
    """rows with their 1-based place in group by two hashes.

    Groups that aren't large (no bits) are numbered as they are, others in two steps,
    so that no task holds one: rows are numbered within ranges of the first hash (its first bits); the rows of
    the ranges before are added. Rows and ranges meet in the dealing of the window.
    """
    if not bits:
        return rows.select("*", F.row_number().over(Window.partitionBy(group).orderBy(*by)).alias(name))
    # flipping the sign bit makes the order of ranges that of the signed hash
    part = F.shiftrightunsigned(F.col(by[0]).bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)
    rows = rows.select("*", part.alias("part"))
    within = Window.partitionBy(group, "part")
    numbered = rows.select("*", F.row_number().over(within.orderBy(*by)).alias("number"), F.count("*").over(within).alias("many"))
    ranges = numbered.where("number = 1").select(F.col(group).alias("p_group"), F.col("part").alias("p_part"), "many")
    before = F.coalesce(F.sum("many").over(Window.partitionBy("p_group").orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("p_group", "p_part", before.alias("before"))
    joined = numbered.drop("many").join(ranges, (F.col(group) == F.col("p_group")) & (F.col("part") == F.col("p_part")))
    return joined.select("*", (F.col("before") + F.col("number")).alias(name)).drop("part", "number", "p_group", "p_part", "before")


def shard(docs: DataFrame, n_shards: int = 24, seed: int = 0) -> DataFrame:
    """docs with shard (0 to n_shards - 1) and slot (gapless from 0 within the shard).

    Shard sizes differ by one row at most. Rows are hashed into blocks, the matrix
    says how many rows of a block go to each shard, a local random order deals them
    out, and a second random order within the shard gives the slots. The driver
    sees one count per block (MOST_BLOCKS at most, each numbered in ranges of about
    BLOCK_ROWS).

    Hashes cover all columns, so rows of a null or repeated key are spread and reruns
    agree; equal rows may be exchanged. Nulls are hashed as Spark does (allowed in any
    column); maps aren't hashed. Very long texts: one row each. Columns named shard
    or slot are replaced. Empty table: no rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    plain = [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind]
    total = docs.count()
    n_blocks = min(MOST_BLOCKS, max(1, math.ceil(total / BLOCK_ROWS)))
    bits = lambda groups: max(0, math.ceil(math.log2(max(1, total / groups / BLOCK_ROWS))))
    block = F.pmod(F.xxhash64(F.lit(seed), *plain), F.lit(n_blocks)).cast("int")
    counted = {r["block"]: r["n"] for r in docs.groupBy(block.alias("block")).agg(F.count("*").alias("n")).collect()}
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    names = sorted(counted)
    bounds = [(b, [int(x) for x in np.cumsum(row)]) for b, row in zip(names, communication_matrix([counted[b] for b in names], sizes, seed), strict=True)]
    matrix = spark.createDataFrame(bounds, "m_block int, bounds array<bigint>")

    rows = docs.select(F.struct("*").alias("row"), block.alias("block"), F.xxhash64(F.lit(seed + 1), *plain).alias("h1"), F.xxhash64(F.lit(seed + 2), *plain).alias("h2"))
    ranked = _numbered(rows, "block", bits(n_blocks), ("h1", "h2"), "rank")
    dealt = ranked.join(matrix, F.col("block") == F.col("m_block")).select("row", "h2", "h1", F.size(F.filter("bounds", lambda b: b < F.col("rank"))).alias("shard"))
    placed = _numbered(dealt, "shard", bits(n_shards), ("h2", "h1"), "place")
    return placed.select("row.*", "shard", (F.col("place") - 1).alias("slot"))
