"""Directories of text files, JSON datasets, and settings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import base_name
from gleanery.sources.folder import DEFAULT_GLOB, contents, expand, glob_regex, listing

def matches(path: Column, pattern: str) -> Column:
    found = F.lit(False)
    for one in expand(pattern):
        found = found | base_name(path).rlike(glob_regex(one))
    return found


def ignored(path: Column, patterns: list[str]) -> Column:
    """The base name matches a pattern, or a folder above has exactly that name."""
    out = F.exists(F.split(path, "/"), lambda s: s.isin(patterns)) if patterns else F.lit(False)
    for p in patterns:
        out = out | base_name(path).rlike(glob_regex(p))
    return out


def scan(spark: SparkSession, root: str, collection: str, pattern: str = DEFAULT_GLOB, ignore: list[str] | None = None) -> DataFrame:
    """collection, path (below root), body, hash, mtime (seconds), file_size of all files that match and can be read.

    To read only what has changed since a catalog was stored, give folder.listing and
    folder.contents to operators.ingest.
    """
    found = contents(listing(spark, root, collection, pattern, ignore or ()).where("error IS NULL"), root)
    return found.where("error IS NULL").select("collection", "path", "body", "hash", "mtime", "file_size")


QUESTIONS = "question string, question_type string, haystack_sessions array<array<struct<role: string, content: string, has_answer: boolean>>>"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions with their sessions."""
    return spark.read.schema(QUESTIONS).json(path, multiLine=True)


def question_turns(rows: DataFrame) -> DataFrame:
    """question, session and turn numbers with role, text, has_answer."""
    sessions = rows.select("question", F.posexplode("haystack_sessions").alias("session", "turns"))
    turns = sessions.select("question", "session", F.posexplode("turns").alias("turn", "t"))
    return turns.select("question", "session", "turn", F.col("t.role").alias("role"), F.col("t.content").alias("text"), F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"))


BENCH = "collection string, queries array<struct<id: string, query: string, type: string, expected_files: array<string>, expected_in_top_k: int>>"


def bench_queries(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark file's queries, one per row; k is 10 where the file gives none."""
    rows = spark.read.schema(BENCH).json(path, multiLine=True).select("collection", F.explode("queries").alias("q"))
    return rows.select("collection", F.col("q.id").alias("query_id"), "q.query", "q.type", "q.expected_files", F.when(F.col("q.expected_in_top_k") > 0, F.col("q.expected_in_top_k")).otherwise(10).alias("k"))


@dataclass(frozen=True)
class Settings:
    """Environment over .env file over given values over these defaults; only keys come from the environment."""

    embedding_dim: int = 1024
    embedding_api_key: str = ""
    llm_api_key: str = ""
    query_prefix: str = ""
    chunk_size: int = 300
    poll_seconds: int = 60


def settings(given: Mapping[str, object] | None = None, dotenv: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    names = {f.name for f in fields(Settings)}
    found = replace(Settings(), **{k: v for k, v in (given or {}).items() if k in names})
    lines = [x.partition("=") for x in (dotenv or "").splitlines() if "=" in x and not x.lstrip().startswith("#")]
    env = {k.strip(): v.strip().strip("\"'") for k, _, v in lines} | dict(os.environ if environment is None else environment)
    return replace(found, **{k: env[k.upper()] for k in ("embedding_api_key", "llm_api_key") if env.get(k.upper())})
