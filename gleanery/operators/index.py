"""A stored inverted index: immutable segments of posting blocks, deletions beside them, versions that name both.

A segment's postings lie in folders by range of terms. Rows are dealt into cells, by
class of length and a hash of the key, the same for all terms; a term's rows of a cell
make blocks of BLOCK at most. A block carries its greatest count and least length,
which bound the score of its rows under any statistics. Terms and beginnings of terms
lead to ranges, so other folders aren't read; a ranked search opens the blocks of the
cells in which all terms' bounds together can reach the best rows.

Changed rows are deleted and added: an update writes the keys that go, a segment of
what comes, and a version. Rows, average length and document frequencies are those of
the live rows. Segments that have become many are merged.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import tokens
from gleanery.operators import lexical
from gleanery.sources.folder import opened

#: Postings in a block; folders of a segment at most; bytes of text behind a file, about; segments from which on an update merges.
BLOCK, MOST_RANGES, PART_BYTES, MOST_SEGMENTS = 128, 2048, 16 << 20, 8
#: Rows and tokens of each from which the borders of ranges are taken; they only balance the folders.
SAMPLE_ROWS, SAMPLE_TOKENS = 500, 1000
#: Classes of length: so many for each doubling.
CLASSES = 2
#: Where the lengths of all rows are, as blocks without a term.
LENGTHS = -1

VERSION = "version int, segments array<struct<name: string, kind: string, rows: bigint, tokens: bigint, deletes: array<string>>>, rows bigint, tokens bigint"
#: Borders of ranges by segment; segments never change.
_RANGES: dict[str, list[tuple[int, str, str]]] = {}


class Deal(NamedTuple):
    """Borders between ranges, and the first part and number of parts of each; the last range is that of lengths."""

    borders: list[str]
    first: np.ndarray
    parts: np.ndarray
    slots: int

    @property
    def n(self) -> int:
        return int(self.parts.sum())


def _deal(sample: list[str], n_parts: int, rows: int) -> Deal:
    """Ranges that hold about equal shares of the sample, each with parts for its share; slots so that a cell has a block's rows or fewer."""
    n_ranges = min(MOST_RANGES, n_parts)
    terms = np.sort(np.array(sample, dtype=object))
    borders = sorted({terms[len(terms) * i // n_ranges] for i in range(1, n_ranges)}) if len(terms) else []
    at = np.searchsorted(np.array(borders, dtype=object), terms, "right") if borders else np.zeros(len(terms), np.int64)
    share = np.bincount(at, minlength=len(borders) + 1) / max(1, len(terms))
    parts = np.append(np.maximum(1, np.ceil(share * n_parts - 1e-9)), max(1, n_parts // 16)).astype(np.int64)
    return Deal(borders, np.cumsum(parts) - parts, parts, max(1, rows // (8 * BLOCK)))


def _assigned(deal: Deal, key: pa.Array, term: pa.Array, tf: np.ndarray, length: np.ndarray, spot: np.ndarray) -> pa.RecordBatch:
    borders = np.array(deal.borders, dtype=object)
    coded = term.dictionary_encode()
    of_name = np.searchsorted(borders, np.array(coded.dictionary.to_pylist(), dtype=object), "right") if len(borders) and len(coded.dictionary) else np.zeros(len(coded.dictionary), np.int64)
    code = coded.indices.fill_null(-1).to_numpy()
    place = np.where(code >= 0, np.append(of_name, 0)[code], len(deal.parts) - 1)
    part = deal.first[place] + spot % deal.parts[place]
    kind = np.floor(np.log2(length + 1.0) * CLASSES).astype(np.int32)
    columns = [pa.array(part.astype(np.int32)), pa.array(np.where(code >= 0, place, LENGTHS).astype(np.int32)), term, pa.array(kind), pa.array((spot // 7919 % deal.slots).astype(np.int32)), key, pa.array(length.astype(np.int32)), pa.array(tf.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["part", "range", "term", "class", "slot", "key", "length", "tf"])


def _counted(deal: Deal):
    """Rows of (key, tokens, spot) as one row per distinct term and one without a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                lists = batch.column("tokens")
                length = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                coded = lists.flatten().dictionary_encode()
                n = max(1, len(coded.dictionary))
                pair, tf = np.unique(np.repeat(np.arange(len(length)), length) * n + coded.indices.to_numpy(), return_counts=True)
                row = np.concatenate([pair // n, np.arange(len(length))])
                term = pa.concat_arrays([coded.dictionary.take(pa.array(pair % n)), pa.nulls(len(length), coded.dictionary.type)])
                yield _assigned(deal, batch.column("key").take(pa.array(row)), term, np.concatenate([tf, np.zeros(len(length), np.int64)]), length[row], batch.column("spot").to_numpy()[row])

    return run


def _again(deal: Deal):
    """Rows of (key, term, tf, length, spot) assigned anew."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _assigned(deal, batch.column("key"), batch.column("term"), *(batch.column(c).to_numpy().astype(np.int64) for c in ("tf", "length", "spot")))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as blocks of one range, term and cell."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        code = batch.column("term").dictionary_encode().indices.fill_null(-1).to_numpy()
        group = np.stack([batch.column("range").to_numpy(), code, batch.column("class").to_numpy(), batch.column("slot").to_numpy()])
        new = np.ones(n, bool)
        new[1:] = (group[:, 1:] != group[:, :-1]).any(axis=0)
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        start = np.flatnonzero((np.arange(n) - first) % BLOCK == 0)
        ends = pa.array(np.append(start, n).astype(np.int32))
        tf, length = batch.column("tf").to_numpy(), batch.column("length").to_numpy()
        at = pa.array(start)
        lists = [pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("key", "tf", "length")]
        columns = [batch.column("range").take(at), batch.column("term").take(at), batch.column("class").take(at), batch.column("slot").take(at), pa.array(np.diff(np.append(start, n)).astype(np.int32)), pa.array(np.maximum.reduceat(tf, start)), pa.array(np.minimum.reduceat(length, start)), *lists]
        yield pa.RecordBatch.from_arrays(columns, ["range", "term", "class", "slot", "n", "max_tf", "min_length", "keys", "tfs", "lengths"])


def _block_kind(key: str) -> str:
    """The columns of blocks of a kind of key."""
    return f"range int, term string, class int, slot int, n int, max_tf int, min_length int, keys array<{key}>, tfs array<int>, lengths array<int>"


@dataclass(frozen=True)
class Index:
    """Where an index is, the name of its key, and how it reads a corpus."""

    path: str
    key: str = "doc_id"
    text: str = "text"
    analyse: lexical.Analyser = tokens

    # versions

    def version(self, spark: SparkSession) -> dict:
        """The latest version: its segments with the deletions that hold for each, its live rows and tokens."""
        try:
            found = spark.read.schema(VERSION).parquet(f"{self.path}/versions/*").orderBy(F.desc("version")).first()
        except AnalysisException:
            found = None
        return found.asDict(recursive=True) if found else {"version": 0, "segments": [], "rows": 0, "tokens": 0}

    def _commit(self, spark: SparkSession, before: dict, segments: list[dict]) -> None:
        """Writes the next version; fails if another writer has written it."""
        live = [x for x in segments if x["rows"] > 0 or x is segments[-1]]
        row = (before["version"] + 1, live, sum(x["rows"] for x in live), sum(x["tokens"] for x in live))
        spark.createDataFrame([row], VERSION).coalesce(1).write.parquet(f"{self.path}/versions/v{row[0]:08d}")

    # writing

    def _written(self, spark: SparkSession, rows: DataFrame, run, deal: Deal) -> dict:  # noqa: ANN001
        """A segment of the dealt rows: one shuffle, one sorted run of blocks in each file."""
        name = uuid.uuid4().hex
        kind = rows.schema["key"].dataType.simpleString()
        dealt = rows.mapInArrow(run, f"part int, range int, term string, class int, slot int, key {kind}, length int, tf int")
        sorted_ = dealt.repartitionById(deal.n, F.col("part")).drop("part").sortWithinPartitions("range", "term", "class", "slot", "key")
        blocks = sorted_.mapInArrow(_packed, _block_kind(kind))
        folder = f"{self.path}/segments/{name}"
        blocks.write.option("parquet.block.size", 16 << 20).partitionBy("range").parquet(f"{folder}/blocks")
        made = spark.read.schema(_block_kind(kind)).parquet(f"{folder}/blocks")
        made.where(F.col("range") != LENGTHS).groupBy("range").agg(F.min("term").alias("first"), F.max("term").alias("last")).coalesce(1).write.parquet(f"{folder}/ranges")
        total = made.where(F.col("range") == LENGTHS).agg(F.sum("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()
        return {"name": name, "kind": kind, "rows": total[0] or 0, "tokens": total[1] or 0, "deletes": []}

    def _segment(self, corpus: DataFrame) -> dict:
        """A segment of a corpus, whose texts are cut once."""
        spark = corpus.sparkSession
        n, size = corpus.agg(F.count("*"), F.sum(F.octet_length(self.text))).first()
        cores = spark.sparkContext.defaultParallelism
        n_parts = max(1, math.ceil((size or 0) / PART_BYTES), min(cores, math.ceil((size or 0) / (1 << 20))))
        sample: list[str] = []
        if n_parts > 1:
            some = corpus.sample(min(1.0, SAMPLE_ROWS / max(1, n)), seed=1).limit(2 * SAMPLE_ROWS)
            sample = [r[0] for r in some.select(F.explode(F.slice(F.array_distinct(self.analyse(F.col(self.text))), 1, SAMPLE_TOKENS))).collect()]
        deal = _deal(sample, n_parts, n)
        rows = corpus.select(F.col(self.key).alias("key"), self.analyse(F.col(self.text)).alias("tokens"), F.pmod(F.xxhash64(self.key), F.lit(2**31)).alias("spot"))
        return self._written(spark, rows, _counted(deal), deal)

    def write(self, corpus: DataFrame) -> Index:
        """A version of one segment with the rows of corpus, in place of all that the index held."""
        self._commit(corpus.sparkSession, self.version(corpus.sparkSession), [self._segment(corpus)])
        return self

    def update(self, gone: DataFrame | None, added: DataFrame | None) -> Index:
        """Rows of the keys in gone leave, rows of added (key, text) come, in place of those that have their keys.

        The keys of added are distinct. Only what comes is cut; of what goes the keys
        are written. A reader sees the version before or the one after.
        """
        spark = (gone if gone is not None else added).sparkSession
        before = self.version(spark)
        leave = [x.select(F.col(self.key).alias("key")) for x in (gone, added) if x is not None]
        leave = leave[0].unionByName(leave[1]) if len(leave) == 2 else leave[0]
        segments = []
        for old in before["segments"]:
            name = uuid.uuid4().hex
            self._lengths(spark, [old]).join(leave, "key", "left_semi").write.parquet(f"{self.path}/deletes/{name}")
            lost = spark.read.parquet(f"{self.path}/deletes/{name}").agg(F.count("*"), F.sum("length")).first()
            segments.append({**old, "rows": old["rows"] - lost[0], "tokens": old["tokens"] - (lost[1] or 0), "deletes": [*old["deletes"], *([name] if lost[0] else [])]})
        self._commit(spark, before, [*segments, *([self._segment(added.select(self.key, self.text))] if added is not None else [])])
        if len(self.version(spark)["segments"]) > MOST_SEGMENTS:
            self.merge(spark, MOST_SEGMENTS // 2)
        return self

    def merge(self, spark: SparkSession, keep: int = 0) -> Index:
        """Makes one segment of all but the `keep` largest, without what was deleted; texts aren't needed."""
        before = self.version(spark)
        by_size = sorted(before["segments"], key=lambda x: -x["rows"])
        small = by_size[keep:]
        if not small:
            return self
        parts = max(1, math.ceil(sum(x["tokens"] for x in small) * 6 / PART_BYTES), min(spark.sparkContext.defaultParallelism, sum(x["tokens"] for x in small) * 6 >> 20))
        borders = sorted({first for x in small for _, first, _ in self._ranges(spark, x["name"])})
        sample = borders[:: max(1, len(borders) // MOST_RANGES)]
        deal = _deal(sample, parts, sum(x["rows"] for x in small))
        lengths = self._lengths(spark, small).select(F.lit(None).cast("string").alias("term"), "key", F.lit(0).alias("tf"), "length")
        rows = self._exploded(spark, small, None).select("term", "key", "tf", "length").unionByName(lengths)
        made = self._written(spark, rows.withColumn("spot", F.pmod(F.xxhash64("key"), F.lit(2**31))), _again(deal), deal)
        self._commit(spark, before, [*by_size[:keep], made])
        return self

    def vacuum(self, spark: SparkSession, versions: int = 2) -> list[str]:
        """Deletes the segments and deletions that none of the last versions names, once no reader has an older one; returns their names."""
        found = spark.read.schema(VERSION).parquet(f"{self.path}/versions/*").orderBy(F.desc("version")).limit(max(1, versions)).collect()
        used = {x["name"] for v in found for x in v["segments"]} | {d for v in found for x in v["segments"] for d in x["deletes"]}
        system, base = opened(self.path)
        gone = []
        for kind in ("segments", "deletes"):
            for folder in system.get_file_info(pfs.FileSelector(f"{base}/{kind}", allow_not_found=True)):
                if folder.base_name not in used:
                    system.delete_dir(folder.path)
                    gone.append(folder.base_name)
        return gone

    # reading

    def _ranges(self, spark: SparkSession, name: str) -> list[tuple[int, str, str]]:
        at = f"{self.path}/segments/{name}/ranges"
        if at not in _RANGES:
            _RANGES[at] = [tuple(r) for r in spark.read.schema("range int, first string, last string").parquet(at).orderBy("range").collect()]
        return _RANGES[at]

    def folders(self, spark: SparkSession, terms: lexical.Terms, name: str) -> list[int]:
        """The ranges of a segment that may hold the terms, or terms that begin with them."""
        wanted = lambda first, last: any(first <= t <= last or (terms.prefix and (t <= first and first.startswith(t) or first <= t <= last)) for t in terms.distinct)
        return [r for r, first, last in self._ranges(spark, name) if wanted(first, last)]

    def _live(self, spark: SparkSession, rows: DataFrame, segment: dict) -> DataFrame:
        """rows (key) without the segment's deleted ones."""
        for name in segment["deletes"]:
            rows = rows.join(spark.read.parquet(f"{self.path}/deletes/{name}").select("key"), "key", "left_anti")
        return rows

    def _all(self, spark: SparkSession, segment: dict) -> DataFrame:
        return spark.read.schema(_block_kind(segment["kind"])).parquet(f"{self.path}/segments/{segment['name']}/blocks")

    def _blocks(self, spark: SparkSession, segment: dict, terms: lexical.Terms | None) -> DataFrame | None:
        """The blocks of some terms: of their ranges' folders, by what the files say of their terms."""
        rows = self._all(spark, segment)
        if terms is None:
            return rows.where(F.col("range") != LENGTHS)
        ranges = self.folders(spark, terms, segment["name"])
        if not ranges:
            return None
        if not terms.prefix:
            return rows.where(F.col("range").isin(ranges) & F.col("term").isin(list(terms.distinct)))
        begins = F.lit(False)
        for t in terms.distinct:
            begins = begins | F.startswith("term", F.lit(t))
        return rows.where(F.col("range").isin(ranges) & begins)

    @staticmethod
    def _opened(blocks: DataFrame) -> DataFrame:
        return blocks.select("term", F.explode(F.arrays_zip("keys", "tfs", "lengths")).alias("x")).select("term", F.col("x.keys").alias("key"), F.col("x.tfs").cast("bigint").alias("tf"), F.col("x.lengths").cast("bigint").alias("length"))

    def _lengths(self, spark: SparkSession, segments: list[dict]) -> DataFrame:
        found = None
        for x in segments:
            rows = self._all(spark, x).where(F.col("range") == LENGTHS)
            own = self._live(spark, self._opened(rows), x).select("key", "length")
            found = own if found is None else found.unionByName(own)
        return found

    def _exploded(self, spark: SparkSession, segments: list[dict], terms: lexical.Terms | None) -> DataFrame | None:
        found = None
        for x in segments:
            blocks = self._blocks(spark, x, terms)
            if blocks is not None:
                own = self._live(spark, self._opened(blocks), x)
                found = own if found is None else found.unionByName(own)
        return found

    def postings(self, spark: SparkSession, terms: lexical.Terms | None = None) -> DataFrame:
        """term, key, tf, length of the live rows: all, or those of some terms."""
        found = self._exploded(spark, self.version(spark)["segments"], terms)
        return (_nothing(spark, "term string, key string, tf bigint, length bigint") if found is None else found).withColumnRenamed("key", self.key)

    def statistics(self, spark: SparkSession) -> DataFrame:
        """One row: rows, average (length) of the live rows."""
        now = self.version(spark)
        return spark.createDataFrame([(float(now["rows"]), now["tokens"] / now["rows"] if now["rows"] else None)], "rows double, average double")

    def bm25(self, spark: SparkSession, terms: lexical.Terms, weight: float = 1.0, among: DataFrame | None = None) -> DataFrame:
        """key, raw_score, score of the matching rows, or of those among some keys; statistics are always of all rows."""
        now = self.version(spark)
        rows = self._exploded(spark, now["segments"], terms) if terms.distinct and now["tokens"] else None
        if rows is None:
            return _nothing(spark, f"{self.key} bigint, raw_score double, score double")
        return self._scored(rows, terms, now, weight, among)

    def _scored(self, rows: DataFrame, terms: lexical.Terms, now: dict, weight: float, among: DataFrame | None = None, df: dict[str, int] | None = None) -> DataFrame:
        """Scores of postings; df: rows that have each term, where the postings aren't all."""
        match = (lambda t: F.startswith("term", F.lit(t))) if terms.prefix else (lambda t: F.col("term") == t)
        # one row per key with its counts: the terms are few, so they are columns
        counts = [F.coalesce(F.sum(F.when(match(t), F.col("tf"))), F.lit(0)).cast("double").alias(f"f{i}") for i, t in enumerate(terms.distinct)]
        rows = rows.groupBy(F.col("key").alias(self.key), "length").agg(*counts)
        if df is None:
            own = rows.agg(*[F.sum((F.col(f"f{i}") > 0).cast("double")).alias(f"d{i}") for i in range(len(terms.distinct))])
            d = own.select(F.struct(*own.columns)).scalar()
        else:
            d = F.struct(*[F.lit(float(df.get(t, 0))).alias(f"d{i}") for i, t in enumerate(terms.distinct)])
        rows = rows if among is None else rows.join(among.select(self.key), self.key, "left_semi")
        at = terms.distinct.index
        for t in dict.fromkeys(terms.all):
            rows = rows.where(F.col(f"f{at(t)}") > 0)
        if terms.any:
            rows = rows.where(F.greatest(*[F.col(f"f{at(t)}") for t in dict.fromkeys(terms.any)], F.lit(0.0)) > 0)
        rows = rows.select("*", d.alias("d"))
        score = F.lit(0.0)
        for i, t in enumerate(terms.distinct):
            part = (terms.any + terms.all).count(t) * lexical.idf(F.lit(float(now["rows"])), F.col("d")[f"d{i}"]) * lexical.term_weight(F.col(f"f{i}"), F.col("length").cast("double"), F.lit(now["tokens"] / now["rows"]), weight)
            score = score + F.when(F.col(f"f{i}") > 0, part).otherwise(0.0)
        return rows.select(self.key, score.alias("raw_score")).withColumn("score", lexical.squash(F.col("raw_score")))

    # ranked search

    def _best_cells(self, spark: SparkSession, now: dict, terms: lexical.Terms, limit: int, weight: float) -> tuple[list[tuple[dict, DataFrame, DataFrame]], dict[str, int]] | None:
        """Of each segment, the terms' blocks and the cells (class, slot) that can hold one of the best rows; and the terms' frequencies.

        The bounds alone give the frequencies and the most that a row of each cell can
        score. The cells of the highest are opened first; the limit-th score in them
        is reached by so many rows, so cells that stay below can't hold any of the best.
        """
        average = now["tokens"] / now["rows"]
        own = [(x, b) for x in now["segments"] if (b := self._blocks(spark, x, terms)) is not None]
        df: dict[str, int] = {}
        for x, blocks in own:
            for t, n in blocks.groupBy("term").agg(F.sum("n")).collect():
                df[t] = df.get(t, 0) + n
            for name in x["deletes"]:
                gone = spark.read.parquet(f"{self.path}/deletes/{name}").select("key")
                for t, n in blocks.select("term", F.explode("keys").alias("key")).join(gone, "key", "left_semi").groupBy("term").count().collect():
                    df[t] -= n
        if not df:
            return None
        raw = {t: math.log((now["rows"] - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        gain = F.create_map(*[F.lit(v) for t, g in raw.items() for v in (t, terms.any.count(t) * (g if g > 0 else lexical.LEAST_IDF))])[F.col("term")]
        most = gain * lexical.term_weight(F.col("max_tf").cast("double"), F.col("min_length").cast("double"), F.lit(average), weight)
        part = gain * lexical.term_weight(F.col("tf").cast("double"), F.col("length").cast("double"), F.lit(average), weight)
        cells = [b.groupBy("class", "slot", "term").agg(F.max(most).alias("most")).groupBy("class", "slot").agg(F.sum("most").alias("most")) for _, b in own]
        seen = None
        for (x, blocks), cell in zip(own, cells, strict=True):
            high = cell.orderBy(F.desc("most")).limit(max(16, limit)).select("class", "slot")
            rows = self._live(spark, self._opened(blocks.join(high, ["class", "slot"], "left_semi")), x)
            seen = rows if seen is None else seen.unionByName(rows)
        best = seen.groupBy("key").agg(F.sum(part).alias("part")).orderBy(F.desc("part")).limit(limit).collect()
        least = best[-1]["part"] * (1 - 1e-9) if len(best) == limit else 0.0
        return [(x, b, c.where(F.col("most") >= least).select("class", "slot")) for (x, b), c in zip(own, cells, strict=True)], df

    def blocks_read(self, spark: SparkSession, terms: lexical.Terms, limit: int, weight: float = 1.0) -> tuple[int, int]:
        """How many blocks a ranked search opens in the end, and how many the terms have."""
        found = self._best_cells(spark, self.version(spark), terms, limit, weight)
        sides = found[0] if found else []
        return sum(b.join(c, ["class", "slot"], "left_semi").count() for _, b, c in sides), sum(b.count() for _, b, _ in sides)

    def top(self, spark: SparkSession, terms: lexical.Terms, limit: int = 5, weight: float = 1.0) -> DataFrame:
        """key, raw_score, score of the best rows: those of bm25, from the blocks that can hold them."""
        now = self.version(spark)
        plain = terms.all or terms.prefix or not terms.any or limit < 1 or not now["tokens"]
        found = None if plain else self._best_cells(spark, now, terms, limit, weight)
        if found is None:
            return lexical.top(self.bm25(spark, terms, weight), limit, self.key)
        rows = None
        for x, blocks, cells in found[0]:
            own = self._live(spark, self._opened(blocks.join(cells, ["class", "slot"], "left_semi")), x)
            rows = own if rows is None else rows.unionByName(own)
        return lexical.top(self._scored(rows, terms, now, weight, df=found[1]), limit, self.key)

    def search(self, spark: SparkSession, terms: lexical.Terms, limit: int = 5) -> DataFrame:
        return self.top(spark, terms, limit)


def _nothing(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], kind)
