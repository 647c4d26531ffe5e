"""A training corpus from `documents`: rejected, repeated and duplicate text goes, sources are mixed, texts encoded.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame. run() writes each result as Parquet and reads it as the docs of
the next; a table is deleted when the one after it is whole.

Every stage but the last returns the columns that docs has, as they are, also where
an operator adds one of the same name; only line dedup changes text and, with it,
n_chars. Nulls are allowed in any column: a null text is an empty one (line dedup
makes it so), a null source is a source of its own, a document
of null doc_id is as good as any other. Empty texts and ties: see the operators.
Very long texts are read whole. Of rows equal in doc_id and text one stays. An
empty table gives no rows, with the columns of the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import line_dedup, mixing, quality, sentencepiece_codec, simhash
from gleanery.llm.common import discard, new_names, read_table, read_texts, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (score of 0.5 or more)."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    # the other columns travel in one, so that none is taken for the operator's
    (row,) = new_names(docs, "row")
    others = [c for c in docs.columns if c != "text"]
    scored = quality.score_documents(docs.select(F.struct(*others).alias(row), "text"), model).where("score >= 0.5")
    return scored.select(*["text" if c == "text" else F.col(row).getField(c).alias(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every text; n_chars follows the text."""
    (row,) = new_names(docs, "row")
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    kept = line_dedup.drop_common_lines(docs.select(F.struct(*others).alias(row), "text"), min_docs=10, min_chars=1)
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return kept.select(*[own.get(c, F.col(row).getField(c).alias(c)) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near-duplicates: five words, similarity 0.8."""
    return simhash.keep_one_of_each(docs, k=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixture(docs, weights=(5, 2, 1), cap=3)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text that is left."""
    model = sentencepiece_codec.load(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = sentencepiece_codec.encode_documents(docs.select("doc_id", "source", "text"), model)
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_lines), ("SimHash near-dedup", drop_near_copies), ("mixing sources", mix_sources), ("SentencePiece encoding", encode)]

#: The classifier and the fingerprints can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_texts(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
