import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm.mixing import mix, mixture
from gleanery.llm.sharding import communication_matrix, hypergeometric, shard

KIND = "doc_id long, text string, source string, size string, shard int, row string, key string"


def rows():
    """A hot source, nulls in every column, empty and long texts, ties, repeated rows; columns with clashing names."""
    out = [(i, "w " * (i % 40 + 1), "hot" if i % 3 else f"s{i % 7}", "x", 1, "r", "k") for i in range(600)]
    return out + [(1000, None, "hot", None, None, None, None), (1001, "", None, "a", 2, "b", "c"), (None, "a b", None, "a", 2, "b", "c"), (1002, "z " * 50_000, "long", "a", 2, "b", "c"), (1003, "same", "hot", "", 0, "", ""), (1003, "same", "hot", "", 0, "", ""), (1004, "", "empty", "", 0, "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KIND).repartition(5).cache()


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Water filling, one source at a time."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, weight = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / weight > cap * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / weight for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_and_copies(docs):
    got = mix(docs).collect()
    assert len(got) == len(rows())
    size = collections.Counter()
    for d in rows():
        size[d[2]] += len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or ""))
    want, taken = targets(size), collections.Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert math.floor(rate) <= r["copies"] <= math.ceil(rate)
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        largest = max(len((d[1] or "").split()) for d in rows() if d[2] == s)
        assert abs(taken[s] - t) <= 2 * largest + 0.05 * t


def test_mixture_and_reruns(docs):
    first, second = (sorted(map(repr, mix(docs.repartition(n)).select("doc_id", "source", "copies").collect())) for n in (2, 9))
    assert first == second
    out = mixture(docs)
    assert out.columns == docs.columns
    assert out.count() == mix(docs).agg(F.sum("copies")).first()[0]


def test_columns_stay(docs):
    """Columns named like those of the mix come back as they were."""
    named = docs.select("doc_id", "text", "source", *[F.lit(f"own {c}").alias(c) for c in ("size", "source_size", "target", "copies", "taken", "row", "Row_", "n", "spot", "class", "cell")])
    out = mixture(named)
    assert out.columns == named.columns and out.count() == mixture(docs).count()
    assert {tuple(r)[3:] for r in out.collect()} == {tuple(named.first())[3:]}


def test_cells_do_not_matter(spark, monkeypatch):
    """A hot source and null ids fall into many cells, and the choice is the same."""
    from gleanery.llm import mixing

    hot = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("hot").alias("source"))
    few = sorted(map(repr, mix(hot, cap=1).select("doc_id", "copies").collect()))
    assert len(few) == 3000
    wide = sorted(map(repr, mix(hot.union(hot.limit(0))).collect()))
    monkeypatch.setattr(mixing, "CELL_ROWS", 2)
    assert sorted(map(repr, mix(hot, cap=1).select("doc_id", "copies").collect())) == few and sorted(map(repr, mix(hot).collect())) == wide
    cells = mixing._slim(hot).groupBy("key", "class", F.substring("spot", 1, 3)).count()
    assert cells.agg(F.max("count")).first()[0] < 12


def test_mix_of_nothing(docs):
    assert mix(docs.limit(0)).count() == 0 and mixture(docs.where("false")).count() == 0


def test_hypergeometric():
    rng = np.random.default_rng(1)
    small = [hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(small) - 6) < 0.15 and min(small) >= 0
    huge = [hypergeometric(rng, 10**10, 3 * 10**10, 1000) for _ in range(2000)]
    assert abs(np.mean(huge) - 250) < 1.5 and abs(np.std(huge) - math.sqrt(1000 * 0.25 * 0.75)) < 0.8


def test_matrix_sums():
    blocks, shards = [7, 0, 100, 3], [40, 40, 30]
    m = communication_matrix(blocks, shards, 3)
    assert [sum(r) for r in m] == blocks and [sum(c) for c in zip(*m, strict=True)] == shards


@pytest.mark.parametrize("n", [1, 7, 24])
def test_shards(docs, n):
    got = shard(docs, n).collect()
    assert len(got) == len(rows())
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(n)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    again = shard(docs.repartition(3), n).collect()
    assert sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in again if r["doc_id"] != 1003) == sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in got if r["doc_id"] != 1003)


@pytest.mark.parametrize(("n", "block_rows", "blocks"), [(3, 40, 4096), (5, 7, 4), (1, 10**6, 4096)])
def test_the_deal_by_hand(spark, monkeypatch, n, block_rows, blocks):
    """The rule in plain Python, over the hashes that Spark gives; a third of the rows has no id."""
    from gleanery.llm import sharding

    monkeypatch.setattr(sharding, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(sharding, "MOST_BLOCKS", blocks)
    docs = spark.range(500).select(F.when(F.col("id") % 3 > 0, F.col("id") % 200).alias("doc_id"), F.col("id").cast("string").alias("text"))
    n_blocks = min(blocks, math.ceil(500 / block_rows))
    hashed = docs.select("text", F.pmod(F.xxhash64(F.lit(4), "doc_id", "text"), F.lit(n_blocks)).alias("block"), F.xxhash64(F.lit(5), "doc_id", "text").alias("h1"), F.xxhash64(F.lit(6), "doc_id", "text").alias("h2")).collect()
    by = {b: sorted((r["h1"], r["h2"], r["text"]) for r in hashed if r["block"] == b) for b in sorted({r["block"] for r in hashed})}
    matrix = communication_matrix([len(v) for v in by.values()], [500 // n + (s < 500 % n) for s in range(n)], 4)
    shards = collections.defaultdict(list)
    for members, row in zip(by.values(), matrix, strict=True):
        rest = iter(members)
        for s, many in enumerate(row):
            shards[s] += [(h2, h1, t) for h1, h2, t in (next(rest) for _ in range(many))]
    want = sorted((t, s, i) for s, v in shards.items() for i, (_, _, t) in enumerate(sorted(v)))
    assert sorted((r["text"], r["shard"], r["slot"]) for r in shard(docs, n, 4).collect()) == want


def test_shards_are_uniform(spark):
    got = shard(spark.range(20_000).withColumnRenamed("id", "doc_id"), 10)
    table = got.groupBy("shard", F.expr("doc_id div 2000").alias("part")).count().collect()
    chi = sum((r["count"] - 200) ** 2 / 200 for r in table)
    assert len(table) == 100 and 40 < chi < 140
    assert abs(got.select(F.corr("doc_id", "slot")).first()[0]) < 0.03


def test_no_rows(docs):
    assert shard(docs.limit(0), 3).count() == 0


def test_native_plans(docs):
    for df in (mix(docs), shard(docs, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|InArrow", plan)
