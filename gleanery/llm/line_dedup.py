"""Line dedup: a sharded minimal perfect hash over line hashes, probed by documents."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pfs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import as_bytes, discard, pieces, shared_folder, stored
from gleanery.llm.perfect_hash import build, from_bytes, probe, to_bytes

#: Lines in one shard of the index, about, and bytes of shards that a task keeps at once.
SHARD_LINES, HELD_BYTES = 500_000, 128 << 20
#: Bytes of text whose lines are probed at once.
PIECE_BYTES = 16 << 20


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased (what bytes methods do)."""
    return line.strip().lower()


def _points(key: bytes) -> int:
    return len(key) if key.isascii() else sum(b & 0xC0 != 0x80 for b in key)


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), dtype=">u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """hi, lo (the 128-bit hash of a key), docs (documents that have it).

    Each document counts once per key; a task adds up its own documents first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 8 << 20):
            keys: list[bytes] = []
            for text in as_bytes(batch.column("text")):
                keys += {k for k in map(line_key, text.split(b"\n")) if k and _points(k) >= min_chars}
            hi, lo = _hashes(keys)
            order = np.lexsort((lo, hi))
            hi, lo = hi[order], lo[order]
            first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, int)
            many = np.diff(np.append(first, len(hi)))
            yield pa.RecordBatch.from_arrays([pa.array(hi[first].view(np.int64)), pa.array(lo[first].view(np.int64)), pa.array(many.astype(np.int64))], ["hi", "lo", "n"])

    counted = docs.select("text").mapInArrow(run, "hi bigint, lo bigint, n bigint")
    return counted.groupBy("hi", "lo").agg(F.sum("n").alias("docs"))


def build_index(docs: DataFrame, least: int = 2, min_chars: int = 1) -> str:
    """Writes the index of all lines found in `least` documents or more; returns its folder.

    With 2, that is every line which any threshold could drop: a line of one document
    alone stays out, and the fingerprints tell it from the indexed ones. A shard is a
    Parquet row with a perfect hash, the fingerprints (64 bits beside the 64 that pick
    the place) and the counts, which decide when documents probe them.
    """
    spark = docs.sparkSession
    common = stored(line_counts(docs, min_chars).where(F.col("docs") >= least), "lines")
    n_shards = max(1, math.ceil(common.count() / SHARD_LINES))

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        hi, lo = (frame[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
        table = build(hi, lo)
        at = probe(table, hi, lo)
        prints, counts = np.empty(len(at), np.uint64), np.empty(len(at), np.uint32)
        prints[at], counts[at] = hi, np.minimum(frame["docs"].to_numpy(), 2**32 - 1)
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "n_shards": [n_shards], "blob": [to_bytes(prints=prints, counts=counts, **table)]})

    folder = shared_folder(spark, "line-index")
    keyed = common.withColumn("shard", F.pmod("lo", F.lit(n_shards)).cast("int"))
    keyed.groupBy("shard").applyInPandas(shard, "shard int, n_shards int, blob binary").write.parquet(folder)
    discard(common)
    return folder


class Index:
    """Reads shards from the shared folder when they are asked for and keeps some."""

    def __init__(self, folder: str) -> None:
        system, path = pfs.FileSystem.from_uri(folder)
        self.data = ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False)
        names = self.data.to_table(columns=["shard", "n_shards"])
        self.present = set(names["shard"].to_pylist())
        self.n = names["n_shards"][0].as_py() if len(names) else 1
        self.held: OrderedDict[int, dict[str, np.ndarray]] = OrderedDict()
        self.bytes = self.reads = 0
        self.upwards = True

    def shard(self, k: int) -> dict[str, np.ndarray]:
        if k not in self.held:
            self.reads += 1
            self.held[k] = from_bytes(self.data.to_table(columns=["blob"], filter=ds.field("shard") == k)["blob"][0].as_py())
            self.bytes += sum(x.nbytes for x in self.held[k].values())
            while self.bytes > HELD_BYTES and len(self.held) > 1:
                self.bytes -= sum(x.nbytes for x in self.held.popitem(last=False)[1].values())
        self.held.move_to_end(k)
        return self.held[k]

    def counts(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """In how many documents each line is found; 0 for lines that aren't indexed.

        Each distinct line is probed once, shard by shard. Every other call goes
        through the shards backwards, so that those still held come first.
        """
        out = np.zeros(len(lo), np.int64)
        order = np.lexsort((hi, lo, np.mod(lo.view(np.int64), self.n)))
        hi, lo = hi[order], lo[order]
        first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
        own_hi, own_lo, found = hi[first], lo[first], np.zeros(len(first), np.int64)
        home = np.mod(own_lo.view(np.int64), self.n)
        names, starts = np.unique(home, return_index=True)
        ends = np.append(starts[1:], len(home))
        ranges = [r for r in zip(names.tolist(), starts.tolist(), ends.tolist(), strict=True) if r[0] in self.present]
        for k, a, b in ranges if self.upwards else ranges[::-1]:
            table = self.shard(k)
            at = probe(table, own_hi[a:b], own_lo[a:b])
            known = (at >= 0) & (table["prints"][np.maximum(at, 0)] == own_hi[a:b])
            found[a:b][known] = table["counts"][at[known]]
        self.upwards = not self.upwards
        out[order] = np.repeat(found, np.diff(np.append(first, len(hi))))
        return out


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> DataFrame:
    """docs with every line dropped whose key min_docs documents or more have.

    New columns: n_lines (before), n_dropped; an input column of such a name is
    replaced. The other lines stay as they are, joined by \\n. Null or empty text:
    one empty line, whose key is too short to be dropped; the text becomes empty.
    All lines dropped: empty text. Very long texts: whole, one piece each. Repeated
    rows and copies count as documents. Empty table: no rows. Two passes over docs: one builds the index, one probes it.
    """
    folder = build_index(docs.select(F.col(text).alias("text")), min(2, min_docs), min_chars)
    rows = docs.drop("n_lines", "n_dropped")
    schema = rows.select("*", F.lit(0).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_dropped")).schema
    names, at = rows.columns, rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in pieces(batches, text, PIECE_BYTES):
            index = index or Index(folder)
            split = [t.split(b"\n") for t in as_bytes(batch.column(at))]
            sizes = np.array([len(s) for s in split])
            flat = [line for s in split for line in s]
            keys = [line_key(x) for x in flat]
            hi, lo = _hashes(keys)
            drop = (index.counts(hi, lo) >= min_docs) & np.array([bool(k) and _points(k) >= min_chars for k in keys])
            ends = np.cumsum(sizes)
            dropped = np.add.reduceat(drop, ends - sizes)
            kept = [s if not n else [x for x, gone in zip(s, drop[e - len(s) : e], strict=True) if not gone] for s, n, e in zip(split, dropped.tolist(), ends.tolist(), strict=True)]
            texts = pa.array([b"\n".join(s) for s in kept], pa.binary()).cast(pa.string())
            columns = [texts if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes.astype(np.int64)), pa.array(dropped.astype(np.int64))], [*names, "n_lines", "n_dropped"])

    return rows.mapInArrow(run, schema)

