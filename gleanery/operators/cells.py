"""Nearest neighbours from a part of the vectors: cells with radius, left out where the triangle inequality allows it.

Centres are fitted on a bounded sample of unit vectors; every vector is stored in the
folder of its nearest centre, and each cell keeps the distance of its farthest one. On
unit vectors the order by cosine is that by distance, so a cell whose centre is farther
from the query than the k-th neighbour found so far and its radius together holds none of
the k nearest. The result is that of comparing all vectors; a limit of cells to read gives
less work and, measured, less recall.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.operators.vector import cosine

#: Rows that centres are fitted on at most, rounds of it, cells at most, rows of a file about.
SAMPLE_ROWS, ROUNDS, MOST_CELLS, FILE_ROWS = 20_000, 8, 4096, 1_000_000
#: The cell of vectors without a direction: zero, or not finite; their score is 0 for any query.
NOWHERE = -1
SLACK = 1e-6


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which rows have a direction."""
    rows = rows.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((rows**2).sum(axis=1))
    good = (norm > 0) & (norm < np.inf)
    return np.where(good[:, None], rows, 0) / np.where(good, norm, 1)[:, None], good


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((rows**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T, 0))


def centres_of(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit vectors by rounds of assigning and averaging, from rows spread over the sample."""
    centres = sample[np.unique(np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(np.int64))]
    for _ in range(ROUNDS):
        own = np.concatenate([_distances(part, centres).argmin(axis=1) for part in np.array_split(sample, -(-len(sample) // 4096))])
        total, many = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(total, own, sample)
        centres = np.where(many[:, None] > 0, total / np.maximum(many, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Cells:
    """Where the vectors lie, and the names of their columns. All vectors have one length; null ones are left out."""

    path: str
    key: str = "vec_id"
    embedding: str = "embedding"

    def write(self, vectors: DataFrame, cells: int = 0) -> Cells:
        """Stores every vector in its cell; about the square root of their number of cells, unless told."""
        spark = vectors.sparkSession
        rows = vectors.where(F.size(self.embedding) > 0)
        n = rows.count()
        some = rows.select(F.col(self.embedding).alias("e")).sample(min(1.0, SAMPLE_ROWS / max(1, n)), seed=1).limit(SAMPLE_ROWS).toPandas()["e"]
        sample, good = _unit(np.stack(some)) if len(some) else (np.zeros((0, 1)), np.zeros(0, bool))
        cells = min(MOST_CELLS, cells or max(1, math.isqrt(n)))
        centres = centres_of(sample[good], cells) if good.any() else np.zeros((0, sample.shape[1]))
        shared = spark.sparkContext.broadcast(centres)
        names, schema = rows.columns, rows.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("distance")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 2048):
                    batch = whole.slice(start, 2048)
                    column = batch.column(self.embedding)
                    x, good = _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                    cell, distance = np.full(len(x), NOWHERE), np.zeros(len(x))
                    if good.any() and len(shared.value):
                        found = _distances(x, shared.value)
                        cell, distance = np.where(good, found.argmin(axis=1), NOWHERE), np.where(good, found.min(axis=1), 0.0)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance)], [*names, "cell", "distance"])

        slices = max(1, math.ceil(n / FILE_ROWS))
        dealt = rows.mapInArrow(run, schema).repartition(F.col("cell"), F.pmod(F.xxhash64(self.key), F.lit(slices)))
        dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows")
        stored = spark.read.schema(schema).parquet(f"{self.path}/rows").groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n"))
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)] + [(NOWHERE, [])], "cell int, centre array<double>")
        stored.join(F.broadcast(table), "cell").withColumn("kind", F.lit(rows.schema.json())).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")
        return self

    def _bounds(self, spark: SparkSession, query: np.ndarray) -> tuple[list[tuple[float, float, int, int]], str | None]:
        """Of each cell: the least distance of its rows to the query, that of its centre, the number of rows, and the cell; nearest centres first."""
        found = spark.read.parquet(f"{self.path}/cells").collect()
        unit, good = _unit(query[None, :])
        out = []
        for r in found:
            away = math.sqrt(2) if r["cell"] == NOWHERE or not good[0] else float(_distances(unit, np.array([r["centre"]]))[0, 0])
            out.append((max(0.0, away - r["radius"] - SLACK) if good[0] else 0.0, away, r["n"], r["cell"]))
        return sorted(out, key=lambda x: (x[1], x[3])), found[0]["kind"] if found else None

    def nearest(self, spark: SparkSession, query: Sequence[float], limit: int, probes: int | None = None) -> tuple[DataFrame, int, int]:
        """The limit nearest rows with their score, as vector.nearest has them; how many cells were read, and how many there are.

        probes: read so many cells at most, those of the nearest centres.
        """
        cells, kind = self._bounds(spark, np.array(query, np.float64))
        if kind is None:
            raise LookupError(f"no vectors at {self.path}")
        schema = StructType.fromJson(json.loads(kind)).add("cell", "integer")
        asked = F.array(*[F.lit(float(x)) for x in query])

        def best(some: list[int]) -> DataFrame:
            rows = spark.read.schema(schema).parquet(f"{self.path}/rows").where(F.col("cell").isin(some)).drop("cell")
            return rows.withColumn("score", cosine(F.col(self.embedding), asked)).orderBy(F.col("score").desc(), self.key).limit(limit)

        cells, there = cells[:probes], len(cells)
        first, held = [], 0
        for _, _, n, cell in cells:
            if held >= limit:
                break
            first.append(cell)
            held += n
        scores = [r["score"] for r in best(first).select("score").collect()]
        reach = math.sqrt(max(0.0, 2 - 2 * min(1.0, scores[-1]))) + SLACK if len(scores) == limit else math.inf
        wanted = [cell for least, _, _, cell in cells if cell in first or least <= reach]
        return best(wanted), len(wanted), there
