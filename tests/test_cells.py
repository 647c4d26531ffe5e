"""Neighbours from cells against neighbours from all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import vector
from gleanery.operators.cells import Cells


def table(spark, rows):
    return spark.createDataFrame([(i, v, i % 3) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)


def listed(rows):
    return [(r["vec_id"], r["label"], round(r["score"], 9)) for r in rows.collect()]


@pytest.fixture(scope="module")
def clustered(spark):
    """Forty clusters on the sphere, repeated vectors, zero and not finite ones, a null."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 12))
    rows = [(i, (centre[i % 40] + 0.15 * rng.normal(size=12)).tolist()) for i in range(1600)]
    rows += [(2000 + i, rows[5][1]) for i in range(30)] + [(3000, [0.0] * 12), (3001, [float("nan")] + [1.0] * 11), (3002, [float("inf")] + [1.0] * 11), (3003, None)]
    return rows


def test_the_same_neighbours(spark, clustered, tmp_path):
    vectors = table(spark, clustered)
    cells = Cells(str(tmp_path / "cells")).write(vectors)
    rng = np.random.default_rng(7)
    shares = []
    for k, limit in enumerate((1, 10, 40, 5, 5000)):
        query = (np.array(clustered[k * 7][1]) + 0.1 * rng.normal(size=12)).tolist()
        found, read, there = cells.nearest(spark, query, limit)
        assert listed(found) == listed(vector.nearest(vectors.where("embedding IS NOT NULL"), F.array(*[F.lit(x) for x in query]), limit))
        shares.append(read / there)
    assert min(shares) < 0.2 and shares[-1] == 1
    zero = [0.0] * 12
    assert listed(cells.nearest(spark, zero, 4)[0]) == listed(vector.nearest(vectors.where("embedding IS NOT NULL"), F.array(*[F.lit(0.0)] * 12), 4))


def test_recall_of_few_cells(spark, clustered, tmp_path):
    vectors = table(spark, clustered)
    cells = Cells(str(tmp_path / "few")).write(vectors)
    hit = asked = 0
    for i in range(0, 400, 50):
        want = {r[0] for r in listed(cells.nearest(spark, clustered[i][1], 10)[0])}
        found, read, _ = cells.nearest(spark, clustered[i][1], 10, probes=4)
        hit, asked = hit + len(want & {r[0] for r in listed(found)}), asked + len(want)
        assert read <= 4
    assert hit >= 0.9 * asked


def test_few_vectors(spark, tmp_path):
    cells = Cells(str(tmp_path / "one")).write(table(spark, [(1, [1.0, 0.0]), (2, [0.0, 0.0])]))
    assert listed(cells.nearest(spark, [1.0, 1.0], 9)[0]) == [(1, 1, 0.707106781), (2, 2, 0.0)]
    with pytest.raises(LookupError):
        Cells(str(tmp_path / "none")).write(table(spark, [])).nearest(spark, [1.0], 1)


def test_vectors_that_are_no_numbers(spark):
    rows = table(spark, [(1, [1.0, float("nan")]), (2, [1.0, 1.0]), (3, [float("inf"), 1.0]), (4, [-1.0, -1.0])])
    assert [(r["vec_id"], round(r["score"], 6)) for r in vector.nearest(rows, F.array(F.lit(1.0), F.lit(1.0)), 4).collect()] == [(2, 1.0), (1, 0.0), (3, 0.0), (4, -1.0)]
    batch = vector.nearest_batch(spark.createDataFrame([(9, [1.0, 1.0])], "vec_id long, embedding array<float>"), rows, 4).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in batch] == [(2, 1.0), (1, 0.0), (3, 0.0), (4, -1.0)]
