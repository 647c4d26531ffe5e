"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.sources.shared import discard, shared_folder, spread, stored  # noqa: F401  (used from here)

#: The white space of the contracts: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\f\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, over all cores, for the operators whose tasks run Python."""
    return spread(read_table(spark, sf_dir, "documents"))


def new_names(docs: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that docs has no column of, whatever the case of letters."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for n in (f"{w}{'_' * i}" for i in range(len(taken) + 1)) if n.lower() not in taken) for w in wanted]


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of runs of other than white space; null: 0."""
    stripped = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return (F.size(F.split(stripped, "[\\x20\\x09-\\x0D]+")) - (stripped == "").cast("int")).cast("long")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about limit bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(x) for x in as_bytes(batch.column(column))], dtype=np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(start, end - start)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Parts between single spaces: the distinct ones, the number of each part, where each text's begin."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(), offsets - offsets[0]


def gather(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each row (row i: ends[i] to ends[i + 1]) one after the other, and their numbers."""
    many = ends[rows + 1] - ends[rows]
    at = np.repeat(ends[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return values[at], many


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mixer of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
