"""Hits as text, CSV, JSON and Markdown columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTHING = "No results found."


def percent(score: Column, digits: int = 0) -> Column:
    """Rounded by the double's exact value, ties to an even digit, as C, Go and SQL print it; format_string rounds its shortest decimal half up.

    Equal to C's for 0 and 2 digits of all scores of six decimals.
    """
    return F.call_function("format_number", score * 100, F.lit("0." + "0" * digits if digits else "0"))


def text_rows(hits: DataFrame) -> DataFrame:
    """rank, line of hits (path, line, doc_id, title, score, snippet, rank)."""
    body = F.concat(F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(" #"), F.col("doc_id")), F.lit("\nTitle: "), F.col("title"), F.lit("\nScore: "), percent(F.col("score")), F.lit("%\n\n"), F.col("snippet"), F.lit("\n"))
    return hits.select("rank", body.alias("text"))


def csv_rows(hits: DataFrame, snippet: int = 500) -> DataFrame:
    return hits.select("path", "line", "doc_id", "title", percent(F.col("score"), 2).alias("score"), F.left("snippet", F.lit(snippet)).alias("snippet"))


def json_rows(hits: DataFrame) -> DataFrame:
    """rank and one object per hit; an empty collection is left out."""
    fields = F.struct("doc_id", F.when(F.col("collection") != "", F.col("collection")).alias("collection"), "path", "title", "score", "snippet", "line")
    return hits.select("rank", F.to_json(fields).alias("json"))


def markdown_rows(hits: DataFrame) -> DataFrame:
    name = F.when(F.coalesce("title", F.lit("")) == "", F.col("path")).otherwise(F.col("title"))
    body = F.concat(F.when(F.col("rank") > 0, "---\n").otherwise(""), F.lit("### "), (F.col("rank") + 1).cast("string"), F.lit(". "), name, F.lit("\n- **Path**: `"), F.col("path"), F.lit("`\n- **Score**: "), percent(F.col("score")), F.lit("%\n- **ID**: #"), F.col("doc_id"), F.lit("\n\n```\n"), F.regexp_replace("snippet", "\n$", ""), F.lit("\n```\n"))
    return hits.select("rank", body.alias("markdown"))


def document(rows: DataFrame, column: str) -> str:
    """Rendered rows as one string; a report of few hits."""
    found = [r[column] for r in rows.orderBy("rank").collect()]
    return "\n".join(found) if found else NOTHING
