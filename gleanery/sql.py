"""The engine's functions for SQL: one call makes them known to a session.

    register(spark)
    spark.sql("SELECT doc_id, c.* FROM documents, LATERAL chunks(text, path, 300) c")
    spark.sql("SELECT doc_id FROM documents WHERE array_contains(analyse(text), 'word')")

Tables: chunks(text, path, size); the source `folder`. Expressions, inlined by the
optimizer: analyse, token_estimate, short_id, cosine_score, squash. Arrow functions:
embed_text, stems, and with a segmenter segment and segment_finer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from gleanery.functions import stem as stemming
from gleanery.functions import text as T
from gleanery.functions.segment import Segmenter
from gleanery.operators import chunking, vector
from gleanery.sources import folder


@udtf(returnType=chunking.CHUNK)
class Chunks:
    """The chunks of a text: plain if the path ends in .txt, else Markdown; null or empty text: none."""

    def eval(self, text: str, path: str, size: int) -> Iterator[tuple[int, str, int, int]]:
        cut = chunking.plain_chunks if (path or "").endswith(".txt") else chunking.markdown_chunks
        for seq, piece in enumerate(cut(text or "", size or 300)):
            yield seq, piece.text, piece.line, piece.tokens


def _quoted(text: str) -> str:
    """A string literal in which a backslash stands for itself."""
    return "R'" + text + "'"


def _expressions() -> dict[str, str]:
    """Temporary functions by their heads; the texts follow functions.text and operators.vector."""
    pairs = f"CASE WHEN rlike(x, {_quoted(T.HAN)}) THEN regexp_replace(x, {_quoted(T.HAN_PAIRS)}, ' $1$2$3 ') ELSE x END"
    folded = f"CASE WHEN octet_length(x) = length(x) THEN x ELSE translate({pairs}, {_quoted(T.MARKED)}, {_quoted(T.BARE)}) END"
    others = "length(regexp_replace(x, R'[\\x00-\\x7F]', ''))"
    product = "aggregate(zip_with({0}, {1}, (p, q) -> double(p) * double(q)), double(0), (s, p) -> s + p)"
    norm = f"sqrt({product.format('a', 'a')}) * sqrt({product.format('b', 'b')})"
    return {
        "analyse(t STRING) RETURNS ARRAY<STRING>": f"(SELECT array_remove(split(lower({folded}), {_quoted(T.NOT_TOKEN)}), '') FROM (SELECT coalesce(t, '') AS x))",
        "token_estimate(x STRING) RETURNS INT": f"int(floor((length(x) - {others}) / 4) + 2 * {others})",
        "short_id(x STRING) RETURNS STRING": "left(x, 8)",
        "squash(x DOUBLE) RETURNS DOUBLE": "abs(x) / (1 + abs(x))",
        "cosine_score(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": f"CASE WHEN {norm} > 0 AND {norm} < double('infinity') THEN {product.format('a', 'b')} / ({norm}) ELSE 0D END",
    }


def register(spark: SparkSession, embedder: vector.Embedder | None = None, dim: int = 64, segmenter: Segmenter | None = None, batch_size: int = 8) -> None:
    """Makes the functions known. embedder: of embed_text, of which a text that fails gives null; segmenter: of segment and segment_finer."""
    make = embedder or vector.hash_embedder(dim)

    @arrow_udf("array<float>")
    def embed_text(column: pa.Array) -> pa.Array:
        texts = [x or "" for x in column.to_pylist()]
        found = [v for i in range(0, len(texts), batch_size) for v, _ in vector.one_by_one(make, texts[i : i + batch_size])]
        ends = np.cumsum([0] + [0 if v is None else len(v) for v in found]).astype(np.int32)
        flat = np.concatenate([v for v in found if v is not None] or [np.zeros(0, np.float32)])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([v is None for v in found], pa.bool_()))

    @arrow_udf("array<string>")
    def stems(column: pa.Array) -> pa.Array:
        return stemming.stem_lists(column)

    folder.register(spark)
    spark.udtf.register("chunks", Chunks)
    spark.udf.register("embed_text", embed_text)
    spark.udf.register("stems", stems)
    for head, body in _expressions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    if segmenter is not None:
        for name, finer in (("segment", False), ("segment_finer", True)):
            spark.udf.register(name, arrow_udf(lambda column, finer=finer: segmenter.lists(column, finer), "array<string>"))
