"""Quality classifier: a byte-level convolutional network in numpy, trained here.

A document's bytes are embedded, LEARNED filters of WIDTH bytes run over it at
every STRIDE bytes, and each overlapping chunk keeps the largest answer of each
filter. A document's mean and largest chunk answers give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import as_bytes, pieces

EMBED, WIDTH, STRIDE, LEARNED = 8, 6, 2, 16
#: Windows in a chunk; neighbouring chunks share the bytes that windows reach over.
CHUNK = 64
#: Training takes at most so many rows of each label, lowest hash first, and of longer texts a window of so many characters.
SAMPLE_ROWS, SAMPLE_CHARS = 1000, 32_768
EPOCHS, BATCH, RATE = 10, 32, 0.01

Model = dict[str, np.ndarray]


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in a row (each text padded to hold one window), windows' starts, chunks' starts, texts' first chunks."""
    windows = np.array([max(0, -(-(len(t) - WIDTH) // STRIDE)) + 1 for t in texts])
    padded = [t + b"\0" * (int(w - 1) * STRIDE + WIDTH - len(t)) for t, w in zip(texts, windows, strict=True)]
    sizes = np.array([len(p) for p in padded])
    first = np.cumsum(windows) - windows
    within = np.arange(windows.sum()) - np.repeat(first, windows)
    starts = np.repeat(np.cumsum(sizes) - sizes, windows) + within * STRIDE
    chunks = -(-windows // CHUNK)
    top = np.cumsum(chunks) - chunks
    inner = np.arange(chunks.sum()) - np.repeat(top, chunks)
    return np.frombuffer(b"".join(padded), np.uint8), starts, np.repeat(first, chunks) + inner * CHUNK, top


def _answers(model: Model, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    tables = np.einsum("be,oef->obf", model["embed"], model["filter"].reshape(WIDTH, EMBED, LEARNED))
    out = tables[0][data[starts]] + model["bias"]
    for o in range(1, WIDTH):
        out += tables[o][data[starts + o]]
    return out


def _features(model: Model, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    data, starts, chunk, top = _layout(texts)
    answers = _answers(model, data, starts)
    best = np.maximum(np.maximum.reduceat(answers, chunk, axis=0), 0)
    many = np.diff(np.append(top, len(chunk)))
    mean = np.add.reduceat(best, top, axis=0) / many[:, None]
    return data, starts, chunk, top, many, answers, best, mean, np.maximum.reduceat(best, top, axis=0)


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    *_, mean, most = _features(model, texts)
    z = np.hstack([mean, most]) @ model["out"] + model["out_bias"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 0) -> Model:
    """Adam on the logistic loss; the two labels weigh the same in all.

    Only windows that are their chunk's largest answer carry a gradient, so the
    backward pass is short. No texts: a model that says 0.5.
    """
    rng = np.random.default_rng(seed)
    model: Model = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "filter": rng.normal(0, 0.3, (WIDTH * EMBED, LEARNED)).astype(np.float32), "bias": np.zeros(LEARNED, np.float32),
        "out": np.zeros(2 * LEARNED, np.float32), "out_bias": np.zeros(1, np.float32),
    }
    if not texts:
        return model
    model["out"] = rng.normal(0, 0.1, 2 * LEARNED).astype(np.float32)
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
    m1, m2, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            data, starts, chunk, top, many, answers, best, mean, most = _features(model, [texts[i] for i in rows])
            pooled = np.hstack([mean, most])
            p = 1 / (1 + np.exp(-np.clip(pooled @ model["out"] + model["out_bias"], -30, 30)))
            dz = ((p - labels[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grad = {"out": pooled.T @ dz, "out_bias": np.array([dz.sum()], np.float32)}
            back = dz[:, None] * model["out"][None, :]
            doc = np.repeat(np.arange(len(rows)), many)
            dbest = (back[:, :LEARNED] / many[:, None])[doc]
            is_most = best == most[doc]
            ties = np.add.reduceat(is_most, top, axis=0)
            dbest += np.where(is_most, back[:, LEARNED:][doc] / ties[doc], 0)
            dbest *= best > 0
            # of each chunk and filter, the first window with the largest answer
            sizes = np.diff(np.append(chunk, len(starts)))
            place = np.arange(len(starts), dtype=np.int32)[:, None]
            window = np.minimum.reduceat(np.where(answers == np.repeat(np.maximum.reduceat(answers, chunk, axis=0), sizes, axis=0), place, len(starts) - 1), chunk, axis=0)
            seen = data[starts[window][:, :, None] + np.arange(WIDTH)]
            inputs = model["embed"][seen].reshape(len(best), LEARNED, WIDTH * EMBED)
            grad["filter"], grad["bias"] = np.einsum("cf,cfk->kf", dbest, inputs), dbest.sum(axis=0)
            back_bytes = (dbest[:, :, None] * model["filter"].T[None]).reshape(-1, EMBED)
            grad["embed"] = np.stack([np.bincount(seen.ravel(), back_bytes[:, e], 256) for e in range(EMBED)], axis=1).astype(np.float32)
            step += 1
            for k, g in grad.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                model[k] = (model[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_texts(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The texts and labels of training, in the order of doc_id.

    They are the SAMPLE_ROWS lowest hashes of each label among rows that aren't held
    out. A text of over SAMPLE_CHARS characters is seen through a window of so many,
    at a place that a hash of its id picks. Of several labels of a document the
    larger counts, of several texts the smaller; null ids and other labels than 0
    and 1 are left out. Null text: empty.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    few = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for q in (0, 1)]
    sample = F.broadcast(few[0].union(few[1]))
    over = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    seen = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), over) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id").select("doc_id", "quality", seen.alias("text"))
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["quality"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the bounded sample of sample_texts, which comes to the driver."""
    sample = sample_texts(docs, labels)
    return fit([t.encode() for t, _ in sample], np.array([q for _, q in sample], dtype=np.float32))


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier); an input column score is replaced.

    Whole texts are read, very long ones in chunks like any other. Null text: empty,
    which has a score too. Null doc_id and repeated rows: scored like any row, equal
    texts alike. Empty table: no rows.
    """
    rows = docs.drop("score")
    names = rows.columns
    schema = rows.select("*", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 1 << 20):
            found = score(model, as_bytes(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.float64))], [*names, "score"])

    return rows.mapInArrow(run, schema)
