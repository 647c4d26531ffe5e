"""BM25 keyword search as one scan of the corpus, and over stored postings.

Statistics (rows, average length, rows with a term) are those of the whole corpus,
whatever the restriction of the rows that are ranked. Repeated terms count each
time. A term in half of the rows or more has weight 1e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gleanery.functions import words as W
from gleanery.functions.text import tokens
from gleanery.sources.shared import stored

if TYPE_CHECKING:
    from gleanery.operators.index import Index

#: A text column as its tokens; queries must be cut alike.
Analyser = Callable[[Column], Column]
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
STRATEGIES = ("pos-or", "pos-must", "pos-weight", "or", "and")


@dataclass(frozen=True)
class Terms:
    """What a row must have: one of `any` and all of `all`; prefix: terms begin tokens."""

    any: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    prefix: bool = False
    distinct: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "any", tuple(W.fold(t).lower() for t in self.any))
        object.__setattr__(self, "all", tuple(W.fold(t).lower() for t in self.all))
        object.__setattr__(self, "distinct", tuple(dict.fromkeys(self.all + self.any)))


def terms_of(query: str, strategy: str = "pos-or", tagger: W.Tagger = W.tag, cutter: W.Cutter = W.cut) -> Terms:
    """The terms of a query; an unknown strategy searches as `or` does."""
    if strategy in ("", "pos-or"):
        return Terms(any=tuple(W.any_terms(query, tagger, cutter)))
    if strategy == "pos-must":
        must, some = W.must_terms(query, tagger, cutter)
        return Terms(any=tuple(some), all=tuple(must))
    if strategy == "and":
        return Terms(all=tuple(W.prefix_terms(query, cutter)), prefix=True)
    return Terms(any=tuple(W.or_terms(query, cutter)))


def lexicon_tagger(lexicon: DataFrame, query: str) -> W.Tagger:
    """A tagger for a query by a lexicon table (word, pos), of which only the query's words are fetched."""
    wanted = sorted({w.lower() for w, _ in W.tag(query)})
    found = lexicon.where(F.lower("word").isin(wanted)).select(F.lower("word").alias("word"), "pos").distinct().orderBy("word", "pos").collect() if wanted else []
    return W.tagger(W.LEXICON | {r["word"]: r["pos"] for r in found})


def idf(rows: Column, with_term: Column) -> Column:
    raw = F.ln((rows - with_term + 0.5) / (with_term + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def term_weight(tf: Column, length: Column, average: Column, weight: float = 1.0) -> Column:
    tf = tf * F.lit(weight)
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / average))


def squash(raw: Column) -> Column:
    return F.abs(raw) / (1 + F.abs(raw))


class Counts(NamedTuple):
    """Rows (kept columns, __length, __tf) that match, and the statistics (rows, average, df) of all."""

    rows: DataFrame
    stats: Column


def _counted(frame: DataFrame, terms: Terms, text: str, analyse: Analyser, keep: Sequence[str | Column]) -> DataFrame:
    names = frame.select(*keep).columns
    # a one-row explode keeps the optimizer from pasting the analysis into every later use of its result
    listed = frame.select(*keep, F.explode(F.array(analyse(F.col(text)))).alias("__tokens"))
    match = lambda t: (lambda x: F.startswith(x, F.lit(t))) if terms.prefix else (lambda x: x == t)
    # lambdas keep the generated method small enough to be compiled
    tf = F.array(*[F.size(F.filter("__tokens", match(t))) for t in terms.distinct])
    one = listed.select(*names, F.explode(F.array(F.struct(F.size("__tokens").cast("double").alias("length"), tf.alias("tf")))).alias("__c"))
    return one.select(*names, F.col("__c.length").alias("__length"), F.col("__c.tf").alias("__tf"))


def _statistics(terms: Terms) -> list[Column]:
    """Of counted rows: rows, average, and for each term the rows that have it."""
    return [F.count("*").cast("double").alias("rows"), F.avg("__length").alias("average"), *[F.sum((F.col("__tf")[i] > 0).cast("double")).alias(f"d{i}") for i in range(len(terms.distinct))]]


def _matching(rows: DataFrame, terms: Terms) -> DataFrame:
    tf = {t: F.col("__tf")[i] for i, t in enumerate(terms.distinct)}
    for t in dict.fromkeys(terms.all):
        rows = rows.where(tf[t] > 0)
    if terms.any:
        rows = rows.where(F.greatest(*[tf[t] for t in dict.fromkeys(terms.any)], F.lit(0)) > 0)
    return rows


def count_once(corpus: DataFrame, terms: Terms, keep: Sequence[str], text: str = "text", where: Column | None = None, analyse: Analyser = tokens) -> Counts:
    """The counts of all rows by one pass, which runs at once: where cutting the texts costs more than storing what matches.

    Rows that match are stored with the columns to keep; the statistics of all rows are
    observed on the way.
    """
    seen = Observation()
    rows = _counted(corpus, terms, text, analyse, [*keep, (F.lit(True) if where is None else where).alias("__asked")])
    rows = _matching(rows.observe(seen, *_statistics(terms)).where("__asked").drop("__asked"), terms)
    rows = stored(rows, "counts")
    got = seen.get
    value = lambda x: F.lit(x).cast("double")
    df = F.array(*[value(got[f"d{i}"]) for i in range(len(terms.distinct))])
    return Counts(rows, F.struct(value(got["rows"]).alias("rows"), value(got["average"]).alias("average"), df.alias("df")))


def bm25(corpus: DataFrame, terms: Terms, text: str = "text", weight: float = 1.0, where: Column | None = None, analyse: Analyser = tokens, counts: Counts | None = None) -> DataFrame:
    """Matching rows of corpus with raw_score and score (0 to 1).

    One pass counts each row's terms in a token array, without exploding it; the
    statistics are a scalar subquery over the same counts. Those of count_once, over the
    same corpus, terms and restriction, are taken as they are, with the columns it kept.
    """
    if not terms.distinct:
        return corpus.where("false").select("*", F.lit(0.0).alias("raw_score"), F.lit(0.0).alias("score"))
    if counts is None:
        n = len(terms.distinct)
        found = _counted(corpus, terms, text, analyse, []).agg(*_statistics(terms))
        stats = found.select(F.struct("rows", "average", F.array(*[f"d{i}" for i in range(n)]).alias("df"))).scalar()
        counts = Counts(_matching(_counted(corpus if where is None else corpus.where(where), terms, text, analyse, corpus.columns), terms), stats)
    kept = [c for c in counts.rows.columns if c not in ("__length", "__tf")]
    rows = counts.rows.select("*", counts.stats.alias("__stats"))
    score = F.lit(0.0)
    for i, t in enumerate(terms.distinct):
        times = (terms.any + terms.all).count(t)
        part = times * idf(F.col("__stats")["rows"], F.col("__stats")["df"][i]) * term_weight(F.col("__tf")[i].cast("double"), F.col("__length"), F.col("__stats")["average"], weight)
        score = score + F.when(F.col("__tf")[i] > 0, part).otherwise(0.0)
    return rows.select(*kept, score.alias("raw_score")).withColumn("score", squash(F.col("raw_score")))


def top(rows: DataFrame, limit: int, key: str = "doc_id", by: str = "raw_score") -> DataFrame:
    return rows.orderBy(F.col(by).desc(), F.col(key)).limit(limit)


def tag_boost(query: str, snippet: Column, tagger: W.Tagger = W.tag) -> Column:
    """0.05 for each noun and 0.02 for each other word with a meaning that the snippet contains, repeats counted."""
    added = F.lit(0.0)
    for token, pos in tagger(query):
        gain = 0.05 if pos in W.NOUN_TAGS else 0.02 if pos in W.CONTENT_TAGS else 0
        if gain:
            added = added + F.when(F.contains(F.lower(snippet), F.lit(token.lower())), gain).otherwise(0.0)
    return added


def search(corpus: DataFrame, query: str, limit: int = 5, min_score: float = 0.0, strategy: str = "pos-or", where: Column | None = None, key: str = "doc_id", text: str = "text", tagger: W.Tagger = W.tag, analyse: Analyser = tokens, cutter: W.Cutter = W.cut, index: Index | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """The top rows of a query; lower scores than min_score leave after the limit, so fewer may be left.

    analyse cuts texts to tokens, cutter the words of the query, tagger the query to
    tagged words: another segmentation gives all three. An index has been written with
    the same analyse.

    With an index of the corpus, only the postings of the query's terms are read, and
    of the corpus the rows that are shown (and those that `where` lets through).

    With keep (columns, the key among them, and the text for tag weights), the result
    has only these and the scores, and texts that are costly to make or cut are gone
    through once, by count_once.
    """
    terms = terms_of(query, strategy, tagger, cutter)
    counts = None if keep is None or index is not None or not terms.distinct else count_once(corpus, terms, keep, text, where, analyse)

    def scored(weight: float) -> DataFrame:
        if index is None:
            return bm25(corpus, terms, text, weight, where, analyse, counts)
        return index.bm25(corpus.sparkSession, terms, weight, None if where is None else corpus.where(where).select(key))

    found = scored(1.5 if strategy == "and" else 1.0)
    # with `and` the order is that of plain scores, the reported score has the weight
    if strategy == "and":
        order = top(scored(1.0), limit, key).select(F.col(key).alias("__key"), F.col("raw_score").alias("__plain"))
        found = found.join(order, F.col(key) == F.col("__key")).drop("__key")
    elif index is not None and where is None:
        found = index.top(corpus.sparkSession, terms, limit)
    else:
        found = top(found, limit, key)
    if index is not None:
        found = corpus.join(found, key).select(*corpus.columns, *[c for c in found.columns if c != key])
    by = "__plain" if strategy == "and" else "raw_score"
    if strategy == "pos-weight":
        found, by = found.withColumn("score", F.least(F.lit(1.0), F.col("score") + tag_boost(query, F.col(text), tagger))), "score"
    found = found.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc(), key)) - 1).drop("__plain")
    return found.where(F.col("score") >= min_score) if min_score > 0 else found


# postings


#: The term of the row that postings keep for each row of the corpus when they are asked for it.
EVERY = ""


def postings(corpus: DataFrame, key: str = "doc_id", text: str = "text", terms: DataFrame | None = None, analyse: Analyser = tokens, every: bool = False) -> DataFrame:
    """term, key, tf, length (of the row): the inverted index, or its part for some terms (term).

    Terms are counted within a task before any shuffle; those that aren't asked for
    leave before that. With every, each row of the corpus has a posting of the term
    EVERY besides, so that its statistics come from the same pass.
    """
    listed = corpus.select(F.col(key), F.explode(F.array(analyse(F.col(text)))).alias("__tokens"))
    own = F.concat("__tokens", F.array(F.lit(EVERY))) if every else F.col("__tokens")
    exploded = listed.select(key, F.size("__tokens").cast("long").alias("length"), F.explode(own).alias("term"))
    if terms is not None:
        wanted = terms.select("term").union(terms.sparkSession.range(1).select(F.lit(EVERY))) if every else terms.select("term")
        exploded = exploded.join(wanted, "term", "left_semi")
    return exploded.groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def statistics_of(index: DataFrame) -> DataFrame:
    """rows, average (length) of the corpus whose postings have EVERY."""
    return index.where(F.col("term") == EVERY).agg(F.count("*").cast("double").alias("rows"), F.avg("length").alias("average"))


def lengths(corpus: DataFrame, key: str = "doc_id", text: str = "text", analyse: Analyser = tokens) -> DataFrame:
    return corpus.select(F.col(key), F.size(analyse(F.col(text))).cast("long").alias("length"))


def statistics(corpus: DataFrame, text: str = "text", analyse: Analyser = tokens) -> DataFrame:
    """One row: rows, average (length)."""
    return corpus.select(F.size(analyse(F.col(text))).alias("length")).agg(F.count("*").cast("double").alias("rows"), F.avg("length").alias("average"))


def query_words(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct words (of over two bytes) of each query (query_id, query); without any, `test`."""
    split = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("query", "[^\\w\\s]", " ")), "\\s+"), lambda w: F.octet_length(w) > 2))
    return queries.select("query_id", F.explode(F.when(F.size(split) > 0, split).otherwise(F.array(F.lit("test")))).alias("term"))


def rare_terms(queries: DataFrame, index: DataFrame, most: int = 5) -> DataFrame:
    """query_id, term, df: each query's rarest words, terms no row has first.

    queries: query_id, query. index: postings of the words of the queries at least.
    """
    counts = index.groupBy("term").agg(F.count("*").alias("df"))
    known = query_words(queries).join(counts, "term", "left").select("query_id", "term", F.coalesce("df", F.lit(0)).alias("df"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))
    return known.withColumn("place", place).where(F.col("place") <= most).drop("place")


def search_batch(queries: DataFrame, index: DataFrame, stats: DataFrame, limit: int = 10, key: str = "doc_id") -> DataFrame:
    """query_id, key, raw_score, rank: the top rows of each query, all queries in one job.

    queries: query_id, term, df. index: term, key, tf, length. stats: rows, average.
    The two sides meet on the term; a query's rows are cut to the top ones by a window
    over its own matches.
    """
    met = index.join(queries, "term").select("*", stats.select(F.struct("rows", "average")).scalar().alias("s"))
    part = idf(F.col("s")["rows"], F.col("df").cast("double")) * term_weight(F.col("tf").cast("double"), F.col("length").cast("double"), F.col("s")["average"])
    scored = met.select("query_id", key, F.round(part, 9).cast("decimal(18,9)").alias("part")).groupBy("query_id", key).agg(F.sum("part").alias("raw_score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("raw_score").desc(), key))
    return scored.withColumn("rank", place - 1).where(F.col("rank") < limit)


def search_private(queries: DataFrame, haystacks: DataFrame, limit: int = 10, key: str = "doc_id", text: str = "text", analyse: Analyser = tokens) -> DataFrame:
    """query_id, key, raw_score, rank: each query over rows of its own, whose statistics are those of its rows alone.

    queries: query_id, term (distinct). haystacks: query_id, key, text. All queries are
    one job; postings meet the terms before any of them is shuffled by key.
    """
    listed = haystacks.select("query_id", key, F.explode(F.array(analyse(F.col(text)))).alias("ts"))
    stats = listed.groupBy("query_id").agg(F.count("*").cast("double").alias("rows"), F.avg(F.size("ts")).alias("average"))
    exploded = listed.select("query_id", key, F.size("ts").cast("double").alias("length"), F.explode("ts").alias("term"))
    met = exploded.join(queries.select("query_id", "term"), ["query_id", "term"], "left_semi").groupBy("query_id", "term", key, "length").agg(F.count("*").cast("double").alias("tf"))
    df = met.groupBy("query_id", "term").agg(F.count("*").cast("double").alias("df"))
    part = idf(F.col("rows"), F.col("df")) * term_weight(F.col("tf"), F.col("length"), F.col("average"))
    scored = met.join(df, ["query_id", "term"]).join(stats, "query_id").select("query_id", key, F.round(part, 9).cast("decimal(18,9)").alias("part")).groupBy("query_id", key).agg(F.sum("part").alias("raw_score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("raw_score").desc(), key))
    return scored.withColumn("rank", place - 1).where(F.col("rank") < limit)
