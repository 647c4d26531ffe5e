"""Exact nearest neighbours by cosine, and a deterministic embedding that needs no model."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block, of queries as of vectors; queries of a block that are scored at once; bytes of query vectors that are broadcast at once.
BLOCK, AT_ONCE, GROUP_BYTES = 2048, 256, 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, undefined: float = 0.0) -> Column:
    """undefined if either is a zero vector or has a component that is no finite number."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((norm > 0) & (norm < float("inf")), dot(a, b) / norm).otherwise(undefined)


def nearest(vectors: DataFrame, query: Column, limit: int, where: Column | None = None, min_score: float = 0.0, key: str = "vec_id", embedding: str = "embedding", digits: int | None = None, undefined: float = 0.0) -> DataFrame:
    """The limit nearest rows to one query vector among those that `where` lets through.

    One scan and a top-k; scores lower than min_score leave after the limit. With
    digits, scores are rounded to so many: rows that differ by less are tied, and go by key.
    A vector without a cosine scores `undefined`; NaN puts it first.
    """
    rows = vectors if where is None else vectors.where(where)
    score = cosine(F.col(embedding), F.col("__query"), undefined)
    found = rows.select("*", query.alias("__query")).withColumn("score", score if digits is None else F.round(score, digits)).drop("__query")
    found = found.orderBy(F.col("score").desc(), key).limit(limit)
    return found.where(F.col("score") >= min_score) if min_score > 0 else found


def _blocks(vectors: DataFrame, key: str, embedding: str, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                flat = part.column("e").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("k").cast(pa.int64()).to_numpy().tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], [f"{name}_keys", f"{name}_data"])

    rows = vectors.where(F.col(key).isNotNull() & (F.size(embedding) > 0)).select(F.col(key).alias("k"), F.col(embedding).alias("e"))
    return rows.mapInArrow(run, f"{name}_keys binary, {name}_data binary")


def _best(scores: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the limit greatest rounded scores of each row, ties by smaller key."""
    rounded = np.round(scores, 9)
    n = rounded.shape[1]
    if n > limit:
        least = np.partition(rounded, n - limit, axis=1)[:, n - limit]
        row, column = np.nonzero(rounded >= least[:, None])
    else:
        row, column = np.indices(rounded.shape).reshape(2, -1)
    order = np.lexsort((keys[column], -rounded[row, column], row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < limit
    return row[kept], column[kept]


def nearest_batch(queries: DataFrame, vectors: DataFrame, limit: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, key, score, rank: the limit nearest vectors of each query.

    Queries and vectors are packed into blocks; each pair of blocks is one matrix
    product, AT_ONCE queries at a time, that keeps the best of each query, and the best
    of these are taken per query. Queries are broadcast in groups of GROUP_BYTES at most, each of which scans
    the vectors once. All vectors have one length; rows without one are left out.
    Keys are bigints.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                # the blocks are looked at where they lie in the batch
                part = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)  # noqa: B023, E731
                ids, keys = part("q_keys", np.int64), part("v_keys", np.int64)
                q, v = (part(k, np.float64).reshape(len(n), -1) for k, n in (("q_data", ids), ("v_data", keys)))
                unit = lambda m: np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) < np.inf, m, 0) / np.where((n > 0) & (n < np.inf), n, 1)
                v = unit(v).T
                for at in range(0, len(ids), AT_ONCE):
                    scores = unit(q[at : at + AT_ONCE]) @ v
                    row, column = _best(scores, keys, limit)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + AT_ONCE][row]), pa.array(keys[column]), pa.array(scores[row, column])], ["query_id", key, "score"])

    size = queries.agg(F.sum(F.size(embedding).cast("long") * 8 + 8)).first()[0] or 0
    groups = max(1, math.ceil(size / (GROUP_BYTES // 2)))
    stored, found = _blocks(vectors, key, embedding, "v"), None
    for g in range(groups):
        own = queries if groups == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(groups)) == g)
        pairs = stored.crossJoin(F.broadcast(_blocks(own, key, embedding, "q")))
        part = pairs.mapInArrow(run, f"query_id bigint, {key} bigint, score double")
        found = part if found is None else found.unionAll(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key))
    return found.withColumn("rank", place - 1).where(F.col("rank") < limit)


#: Han characters are tokens of their own; other letters and digits run together.
TOKEN = re.compile("[⺀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-龎]|[^\\W_⺀-⿕々〇〡-〩〸-〻㐀-䶿一-鿿豈-龎]+")


#: Tokens whose digests a task keeps at most.
KNOWN = 200_000


def hash_embedding(text: str, dim: int = 64, known: dict[str, tuple[int, np.ndarray]] | None = None) -> np.ndarray:
    """Each token adds the bytes of its SHA-256, plus 1, to the group of 8 places that its first byte picks; then unit length.

    known keeps the tokens' digests from text to text.
    """
    out = np.zeros(dim)
    width = 8 if dim >= 8 else dim
    known = {} if known is None else known
    for token, many in Counter(TOKEN.findall(text)).items():
        found = known.get(token)
        if found is None:
            digest = np.frombuffer(hashlib.sha256(token.lower().encode()).digest(), np.uint8)
            found = int(digest[0]) % max(1, dim // 8) * width, digest[:width].astype(np.float64) + 1
            if len(known) < KNOWN:
                known[token] = found
        base, values = found
        out[base : base + width] += values * many
    norm = np.sqrt(np.dot(out, out))
    return (out / norm if norm > 0 else out).astype(np.float32)


Embedder = Callable[[list[str]], np.ndarray]


def hash_embedder(dim: int = 64) -> Embedder:
    """hash_embedding of many texts together: sums of whole numbers, so the order of adding doesn't matter."""
    width, groups = (8 if dim >= 8 else dim), max(1, dim // 8)
    known: dict[str, int] = {}
    place, value = np.zeros(0, np.int64), np.zeros((0, width))

    def run(texts: list[str]) -> np.ndarray:
        nonlocal place, value
        found = [Counter(TOKEN.findall(t)) for t in texts]
        if len(known) > KNOWN:
            known.clear()
            place, value = place[:0], value[:0]
        fresh = list(dict.fromkeys(t for c in found for t in c if t not in known))
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            digest = np.frombuffer(b"".join(hashlib.sha256(t.lower().encode()).digest() for t in fresh), np.uint8).reshape(-1, 32)
            grown = len(known) * 2 if len(known) > len(place) else len(place)
            if grown > len(place):
                place, value = np.resize(place, grown) if len(place) else np.zeros(grown, np.int64), np.concatenate([value, np.zeros((grown - len(value), width))])
            place[len(known) - len(fresh) : len(known)] = digest[:, 0].astype(np.int64) % groups * width
            value[len(known) - len(fresh) : len(known)] = digest[:, :width].astype(np.float64) + 1
        code = np.fromiter((known[t] for c in found for t in c), np.int64)
        many = np.fromiter((n for c in found for n in c.values()), np.float64)
        at = np.repeat(np.arange(len(texts)) * dim, [len(c) for c in found]) + place[code]
        out = np.zeros(len(texts) * dim)
        for j in range(width):
            out += np.bincount(at + j, value[code, j] * many, len(out))
        out = out.reshape(-1, dim)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32)

    return run


def one_by_one(embedder: Embedder, texts: list[str], attempts: int = 1) -> list[tuple[np.ndarray | None, str | None]]:
    """A vector or an error for each text: all together and, if that fails, each text alone, so many times."""
    def checked(some: list[str]) -> np.ndarray:
        found = np.asarray(embedder(some), np.float32)
        if found.ndim != 2 or len(found) != len(some):
            raise ValueError(f"{len(some)} texts gave an array of shape {found.shape}")
        return found

    try:
        return [(x, None) for x in checked(texts)]
    except Exception as e:  # the embedder comes from outside; whatever it raises is an error of its texts
        error = f"{type(e).__name__}: {e}"
    out: list[tuple[np.ndarray | None, str | None]] = []
    for text in texts:
        found = None
        for _ in range(attempts):
            try:
                found = checked([text])[0]
                break
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        out.append((found, None if found is not None else error))
    return out


def embed(rows: DataFrame, embedder: Embedder | None = None, dim: int = 64, text: str = "text", column: str = "embedding", batch_size: int = 8, error: str | None = None, attempts: int = 1) -> DataFrame:
    """rows with the embedding of each text, made batch_size texts at a time by any embedder (the default one takes more); null text: empty.

    A batch for which the embedder raises is tried text by text, each so many times; a
    text that fails has no embedding and, where error names a column, what was raised.
    """
    if embedder is None:
        embedder, batch_size = hash_embedder(dim), 256
    new = [column, *([error] if error else [])]
    rows = rows.drop(*new)
    names = rows.columns
    schema = rows.select("*", F.lit(None).cast("array<float>").alias(column), *([F.lit(None).cast("string").alias(error)] if error else [])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            found = [x for i in range(0, len(texts), batch_size) for x in one_by_one(embedder, texts[i : i + batch_size], attempts)]
            ends = np.concatenate([[0], np.cumsum([0 if v is None else len(v) for v, _ in found])]).astype(np.int32)
            flat = np.concatenate([v for v, _ in found if v is not None] or [np.zeros(0, np.float32)])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([v is None for v, _ in found]))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, *([pa.array([e for _, e in found], pa.string())] if error else [])], [*names, *new])

    return rows.mapInArrow(run, schema)
