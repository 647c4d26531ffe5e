"""Hard negatives by coordinate pruning over length buckets.

Vectors are dealt into buckets of similar length, the longest first. A bucket holds
its vectors and, per coordinate, a list of them sorted by that coordinate of their
unit vectors. For an anchor and the least score that still matters, a bucket is left
out if its longest vector can't reach it; else the anchor's largest coordinates are
its focus: from the angle that the score allows, each gives a range of values that a
partner can have, the ranges of the sorted lists are intersected, and what is left is
verified exactly. The least score rises as partners are found.

Buckets (in groups) and anchors (in blocks) lie in the shared folder; a task meets
one block with one group and returns the best few per anchor, which Spark merges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.common import discard, shared_folder, stored
from gleanery.llm.perfect_hash import from_bytes, to_bytes

#: Vectors in a bucket, buckets in a group at most, anchors in a block; coordinates in focus.
BUCKET_ROWS, GROUP, BLOCK_ROWS, FOCUS = 2048, 16, 512, 6
#: Angles by which ranges are widened, for rounding.
SLACK = 1e-6


def whole_vectors(rows: DataFrame, scale: float = 256) -> DataFrame:
    """id, label, v (each component scaled and rounded down), size (its squared length) of the rows that take part.

    rows has vec_id, label and embedding. A null in any, or a null or non-finite component, and a row takes no part.
    """
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ok)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), v.alias("v")).withColumn("size", length)


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of vectors; shorter ones end in zeros."""
    many = vectors.value_lengths().to_numpy()
    out = np.zeros((len(vectors), dims), np.int64)
    out[np.arange(dims) < many[:, None]] = vectors.flatten().to_numpy()
    return out


def _units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    return v / np.maximum(length, 1e-300)[:, None], length


class Bucket:
    """Vectors of similar length with a sorted list per coordinate."""

    def __init__(self, x: dict[str, np.ndarray]) -> None:
        self.ids, self.labels, self.v = x["ids"], x["labels"], x["v"].astype(np.int64)
        units, length = _units(self.v)
        self.exact = self.v.astype(np.float64)
        self.longest, self.shortest = length.max(), length.min()
        self.order = x["order"]
        # coordinate c has its values between 4c - 1 and 4c + 1, so that all lists are one
        self.lists = (np.take_along_axis(units.T, self.order, axis=1) + 4 * np.arange(units.shape[1])[:, None]).ravel()
        self.place = np.empty_like(self.order)
        np.put_along_axis(self.place, self.order, np.arange(len(self.ids), dtype=self.order.dtype)[None, :], axis=1)

    def ranges(self, units: np.ndarray, length: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor: its focus, and from where to where in their lists partners with scores from least to most can stand."""
        with np.errstate(divide="ignore", invalid="ignore"):
            low = np.nan_to_num(least / (length * np.where(least > 0, self.longest, self.shortest)), nan=-1.0, posinf=2.0, neginf=-1.0)
            high = np.nan_to_num(most / (length * np.where(most > 0, self.shortest, self.longest)), nan=1.0, posinf=1.0, neginf=-2.0)
        out_of_reach = (low > 1 + 1e-9) | (high < -1 - 1e-9)
        far, near = np.arccos(np.clip(low, -1, 1)) + SLACK, np.arccos(np.clip(high, -1, 1)) - SLACK
        focus = np.argsort(-np.abs(units), axis=1)[:, :FOCUS]
        own = np.arccos(np.clip(np.take_along_axis(units, focus, axis=1), -1, 1))
        far, near = far[:, None], np.maximum(near, 0)[:, None]
        top = np.cos(np.maximum(np.maximum(own - far, near - own), 0)) + 1e-9
        bottom = np.where(own + near > np.pi, np.cos(own + near), np.cos(np.minimum(own + far, np.pi))) - 1e-9
        a = np.searchsorted(self.lists, bottom + 4 * focus) - focus * len(self.ids)
        b = np.searchsorted(self.lists, top + 4 * focus, "right") - focus * len(self.ids)
        b[out_of_reach] = a[out_of_reach]
        return focus, a, b

    def candidates(self, focus: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rows that stand within an anchor's ranges of all its focus lists."""
        shortest = int(np.argmin(b - a))
        rows = self.order[focus[shortest], a[shortest] : b[shortest]]
        for c, x, y in zip(focus.tolist(), a.tolist(), b.tolist(), strict=True):
            if y - x < len(self.ids) and len(rows):
                at = self.place[c, rows]
                rows = rows[(at >= x) & (at < y)]
        return rows


def best(unit: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which k entries of each unit have the highest scores, smaller ids first among equals; in order."""
    order = np.lexsort((ids, -score, unit))
    first = np.flatnonzero(np.concatenate([[True], np.diff(unit[order]) != 0])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def search(buckets: Iterator[Bucket], v: np.ndarray, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, int]]:
    """The best k partners of each unit (anchor of[unit], scores from least to most): units, ids, scores; and what was compared.

    Units are sorted by anchor. same: of the anchor's label and another id, else of
    another label. Scores are exact: sums of at most 2^53 in magnitude (see mine).
    """
    units, length = _units(v)
    exact = v.astype(np.float64)
    seen = {"pairs": 0, "candidates": 0}
    some, starts, own = np.unique(of, return_index=True, return_inverse=True)
    least, most = least.astype(np.float64), most.astype(np.float64)
    held_unit, held_score, held_id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    for bucket in buckets:
        focus, a, b = bucket.ranges(units[some], length[some], np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts))
        n, shortest = len(bucket.ids), (b - a).min(axis=1)
        found_unit, found_score, found_id = [held_unit], [held_score], [held_id]
        seen["pairs"] += len(some) * n
        usable = lambda anchor, rows: (bucket.labels[rows] == labels[anchor]) & (bucket.ids[rows] != ids[anchor]) if same else bucket.labels[rows] != labels[anchor]
        for i in np.flatnonzero((shortest > 0) & (shortest * 4 <= n)).tolist():
            rows = bucket.candidates(focus[i], a[i], b[i])
            rows = rows[usable(some[i], rows)]
            seen["candidates"] += len(rows)
            scores = bucket.exact[rows] @ exact[some[i]]
            for u in range(starts[i], starts[i + 1] if i + 1 < len(starts) else len(of)):
                good = np.flatnonzero((scores >= least[u]) & (scores <= most[u]))
                found_unit.append(np.full(len(good), u))
                found_score.append(scores[good])
                found_id.append(bucket.ids[rows[good]])
        # where the ranges leave much of a bucket, anchors are verified together
        wide = np.flatnonzero(shortest * 4 > n)
        if len(wide):
            open_ = usable(some[wide][:, None], np.arange(n)[None, :])
            for j in range(focus.shape[1]):
                part = np.flatnonzero(b[wide, j] - a[wide, j] < n)
                place = bucket.place[focus[wide[part], j]]
                open_[part] &= (place >= a[wide[part], j, None]) & (place < b[wide[part], j, None])
            seen["candidates"] += int(open_.sum())
            scores = exact[some[wide]] @ bucket.exact.T
            number = np.full(len(some), -1)
            number[wide] = np.arange(len(wide))
            u = np.flatnonzero(number[own] >= 0)
            row = number[own[u]]
            good = open_[row] & (scores[row] >= least[u][:, None]) & (scores[row] <= most[u][:, None])
            many = np.flatnonzero(good.sum(axis=1) > k)
            if len(many):
                part = np.where(good[many], scores[row[many]], -np.inf)
                good[many] &= part >= np.partition(part, n - k, axis=1)[:, n - k, None]
            x, y = np.nonzero(good)
            found_unit.append(u[x])
            found_score.append(scores[row[x], y])
            found_id.append(bucket.ids[y])
        held_unit, held_score, held_id = map(np.concatenate, (found_unit, found_score, found_id))
        top = best(held_unit, held_score, held_id, k)
        held_unit, held_score, held_id = held_unit[top], held_score[top], held_id[top]
        # the k-th score of a unit that has k is the least that still matters
        full = held_unit[k - 1 :][held_unit[k - 1 :] == held_unit[: len(held_unit) - k + 1]]
        least[full] = np.maximum(least[full], held_score[k - 1 :][held_unit[k - 1 :] == held_unit[: len(held_unit) - k + 1]])
    return held_unit, held_id, held_score.astype(np.int64), seen


class Stored:
    """A folder of Parquet files below key=value folders; the rows' blobs of one value, the last ones kept."""

    def __init__(self, folder: str, key: str) -> None:
        self.system, self.base = pfs.FileSystem.from_uri(folder)
        self.key, self.now, self.held = key, -1, []

    def get(self, value: int) -> list[dict[str, np.ndarray]]:
        if value != self.now:
            path = f"{self.base}/{self.key}={value}"
            there = self.system.get_file_info(path).type == pfs.FileType.Directory
            blobs = ds.dataset(path, filesystem=self.system, format="parquet").to_table(columns=["blob"])["blob"].to_pylist() if there else []
            self.now, self.held = value, [from_bytes(x) for x in blobs]
        return self.held


def write_buckets(rows: DataFrame, dims: int, n_buckets: int, n_groups: int) -> str:
    """Writes the buckets, the longest vectors first, in group folders; returns the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        bucket = TaskContext.get().partitionId()
        for at in range(0, len(table), 2 * BUCKET_ROWS):
            part = table.slice(at, 2 * BUCKET_ROWS).combine_chunks()
            v = _matrix(part["v"].combine_chunks(), dims)
            order = np.argsort(_units(v)[0].T, axis=1, kind="stable").astype(np.uint16)
            blob = to_bytes(ids=part["id"].to_numpy(), labels=part["label"].to_numpy(), v=v.astype(np.min_scalar_type(-int(np.abs(v).max(initial=1)) - 1)), order=order)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([bucket % n_groups], pa.int32()), pa.array([blob], pa.large_binary()).cast(pa.binary())], ["bucket", "group", "blob"])

    folder = shared_folder(rows.sparkSession, "length-buckets")
    dealt = rows.repartitionByRange(n_buckets, F.col("size").desc(), "id")
    dealt.mapInArrow(run, "bucket int, group int, blob binary").write.partitionBy("group").parquet(folder)
    return folder


def write_blocks(anchors: DataFrame, dims: int, n_blocks: int, windows: bool) -> str:
    """Writes the anchors (key, id, label, v and, with windows, positive scores) in block folders; returns the folder."""
    def run(frame: pa.Table) -> pa.Table:
        frame = frame.combine_chunks()
        extra = {"scores": frame["scores"].combine_chunks().flatten().to_numpy(), "many": frame["scores"].combine_chunks().value_lengths().to_numpy()} if windows else {}
        blob = to_bytes(keys=frame["key"].to_numpy(), ids=frame["id"].to_numpy(), labels=frame["label"].to_numpy(), v=_matrix(frame["v"].combine_chunks(), dims), **extra)
        return pa.table({"block": pa.array([frame["block"][0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})

    folder = shared_folder(anchors.sparkSession, "anchor-blocks")
    blocks = anchors.withColumn("block", F.pmod("key", F.lit(n_blocks)).cast("int")).groupBy("block").applyInArrow(run, "block int, blob binary")
    blocks.write.partitionBy("block").parquet(folder)
    return folder


def partners(spark: SparkSession, blocks: str, n_blocks: int, buckets: str, n_groups: int, k: int, band: tuple[int, int] | None = None) -> DataFrame:
    """anchor_id, key, other_id, score (and window, the positive's score): the best k of each block and group, not yet merged.

    Without a band the partners are of the anchor's label; with one, of other labels, by window.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, group = Stored(blocks, "block"), Stored(buckets, "group")
        for pair in (p for batch in batches for p in batch.column(0).to_pylist()):
            for x in block.get(pair // n_groups):
                n = len(x["ids"])
                if band:
                    of, window = np.repeat(np.arange(n), x["many"]), x["scores"]
                    least, most = -(-band[0] * window // 100), band[1] * window // 100
                    of, window, least, most = (y[least <= most] for y in (of, window, least, most))
                else:
                    of, window = np.arange(n), np.zeros(n, np.int64)
                    least, most = np.full(n, -np.inf), np.full(n, np.inf)
                order = lambda y: -float((y["v"].astype(np.float64) ** 2).sum(axis=1).max(initial=0))
                if len(of):
                    unit, other, score, _ = search((Bucket(y) for y in sorted(group.get(pair % n_groups), key=order)), x["v"], x["ids"], x["labels"], of, least, most, k, band is None)
                    yield pa.RecordBatch.from_arrays([pa.array(y) for y in (x["ids"][of[unit]], x["keys"][of[unit]], window[unit], other, score)], ["anchor_id", "key", "window", "other_id", "score"])

    pairs = spark.range(0, n_blocks * n_groups, 1, min(n_blocks * n_groups, 20_000))
    return pairs.mapInArrow(run, "anchor_id bigint, key bigint, window bigint, other_id bigint, score bigint")


def _merged(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The best k of each anchor, numbered by rank from 1."""
    order = Window.partitionBy("anchor_id", "key", *by).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: str = "vec_id % 50 = 0", positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), scale: float = 256) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors has vec_id, label (whole numbers) and embedding; other columns are left.
    Vectors are scaled and rounded down to whole numbers, a score is their inner
    product. Of an anchor (a row for which the expression holds), the first
    `positives` other rows of its label are positives; of each, the first `negatives`
    rows of other labels whose score is from band[0] to band[1] percent of the
    positive's are returned. Higher scores come first, ties by smaller vec_id. No
    score is cut off: the result is that of comparing all anchors with all rows.

    A null vec_id, label, vector or component, or one that isn't finite: the row takes
    no part. Vectors of several lengths: shorter ones end in zeros; empty ones score
    0. Rows that repeat a vec_id each take part, but not as a partner of that vec_id;
    anchors that are equal in all three columns are one. A positive score of 0 takes
    negatives of 0, one below 0 none. Empty table: no rows. Scores must be whole numbers
    below 2^50 in magnitude (components below 2^21 at 64 dimensions), else ValueError.
    """
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors.select("vec_id", "label", "embedding"), scale), "whole-vectors")
    n, dims, longest = rows.agg(F.count("*"), F.max(F.size("v")), F.max("size")).first()
    if (longest or 0) >= 2**50:
        raise ValueError("scores don't fit 50 bits; use a smaller scale")
    dims = max(1, dims or 0)
    key = F.xxhash64("id", "label", "v").alias("key")
    anchors = stored(rows.withColumnRenamed("id", "vec_id").where(anchor).withColumnRenamed("vec_id", "id").select(key, "id", "label", "v").distinct(), "anchors")
    n_blocks = max(1, math.ceil(anchors.count() / BLOCK_ROWS))
    n_buckets = max(1, math.ceil(n / BUCKET_ROWS))
    n_groups = math.ceil(n_buckets / max(1, min(GROUP, n_blocks * n_buckets // (2 * spark.sparkContext.defaultParallelism))))
    buckets = write_buckets(rows, dims, n_buckets, n_groups)
    blocks = write_blocks(anchors, dims, n_blocks, windows=False)
    found = partners(spark, blocks, n_blocks, buckets, n_groups, positives)
    near = stored(_merged(found, positives).select("anchor_id", "key", F.col("other_id").alias("positive_id"), F.col("score").alias("window")), "positives")
    windows = near.groupBy("key", F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_set("window")).alias("scores"))
    blocks = write_blocks(anchors.join(windows, ["key", "id"]), dims, n_blocks, windows=True)
    found = _merged(partners(spark, blocks, n_blocks, buckets, n_groups, negatives, band), negatives, "window")
    out = near.join(found, ["anchor_id", "key", "window"])
    out = stored(out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score")), "hard-negatives")
    for used in (rows, anchors, near):
        discard(used)
    return out
