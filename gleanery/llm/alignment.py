"""Alignment of two tokenizers: which tokens of one cover which of the other, and how often in the whole corpus.

1. Every text is encoded once by both; the ids are stored.
2. The stored ids are aligned a first time. A link is a stretch of bytes between two
   neighbouring token ends of either side, so links are found by marking the ends.
   Each task counts its distinct pairs of ids.
3. The distinct pairs of all tasks get a minimal perfect hash, in shards. A task's
   counts become dense vectors indexed by it, FAN tasks at a time, which are summed
   as a tree, FAN vectors at a time. A shard keeps its keys beside the counts.
4. The stored ids are aligned a second time; the pairs look up their counts, and the
   key at the index tells a known pair from another.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import as_bytes, discard, gather, mix64, pieces, shared_folder, split_words, stored
from gleanery.llm.perfect_hash import build, from_bytes, probe, to_bytes
from gleanery.llm.sentencepiece_codec import ODD, SPACE, Codec
from gleanery.llm.token_files import Encoder

#: Pairs in a shard of the index, about; tasks or vectors summed at once; bytes of text encoded and of ids aligned at once; bytes of shards kept.
SHARD_PAIRS, FAN, TEXT_BYTES, IDS_BYTES, HELD_BYTES = 131_072, 16, 3 << 20, 1 << 20, 96 << 20
#: Bytes of text whose words are segmented together; distinct words whose ids a task keeps.
LEARN_BYTES, MOST_WORDS = 20 << 20, 1_000_000
#: Distinct pairs that a task counts before it joins them with those it has.
PENDING = 2_000_000
NOTHING = np.zeros(0, np.int64)


def _assembled(odd: np.ndarray, begin: np.ndarray, rows: np.ndarray, ids: np.ndarray, many: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row and how many each text has, from the ids of words (rows: the words of the plain texts) and of odd texts."""
    ends = np.concatenate([[0], np.cumsum(np.concatenate([many, [len(x) for x in others]]))]).astype(np.int64)
    counts = np.ones(len(odd), np.int64)
    counts[~odd] = np.diff(begin)
    first = np.cumsum(counts) - counts
    every = np.empty(int(counts.sum()), np.int64)
    own = np.zeros(len(every), bool)
    own[first[odd]] = True
    every[own], every[~own] = len(many) + np.arange(odd.sum()), rows
    out, sizes = gather(np.concatenate([ids, *others]), ends, every)
    total = np.concatenate([[0], np.cumsum(sizes)])
    return out, total[first + counts] - total[first]


def _known(words: pa.Array, known: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each word among those known and, after them, the new ones; and the new ones."""
    found = pc.index_in(words, value_set=known)
    new = words.filter(found.is_null())
    row = found.fill_null(-1).to_numpy().astype(np.int64)
    row[row < 0] = len(known) + np.arange(len(new))
    return row, new


class After(Encoder):
    """Byte-level ids of texts with a space before each; tokens with names of their own are text."""

    def encode_after_space(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has. Every word has a space before it, so each is encoded once."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        words, part, begin = split_words(texts.filter(pa.array(~odd)))
        if len(self.words) > MOST_WORDS:
            self.forget()
        row, new = _known(words, self.words)
        ids, many = self._spaced(new)
        self.words, self.ids, self.many = pa.concat_arrays([self.words, new]), np.concatenate([self.ids, ids]), np.concatenate([self.many, many])
        others = self._each([" " + t for t in texts.filter(pa.array(odd)).to_pylist()])
        return _assembled(odd, begin, row[part], self.ids, self.many, others)


class Remembering(Codec):
    """A codec that segments each distinct word of a task once."""

    def __init__(self, model: dict) -> None:
        super().__init__(model)
        self.forget()

    def forget(self) -> None:
        self.words, self.held_ids, self.held_many = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, texts: pa.Array) -> None:
        """Segments the words of many texts before they are encoded: the more words advance together, the better."""
        if self.spaced:
            if len(self.words) > MOST_WORDS:
                self.forget()
            odd = pc.match_substring_regex(texts, ODD)
            self._add(_known(split_words(texts.filter(pc.invert(odd)))[0], self.words)[1])

    def _add(self, new: pa.Array) -> None:
        if len(new):
            ids, many = self._segment([SPACE + w for w in new.to_pylist()])
            self.words, self.held_ids, self.held_many = pa.concat_arrays([self.words, new]), np.concatenate([self.held_ids, ids]), np.concatenate([self.held_many, many])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.spaced:
            return super().encode(texts)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        words, part, begin = split_words(texts.filter(pa.array(~odd)))
        row, new = _known(words, self.words)
        self._add(new)
        others: list[np.ndarray] = []
        if odd.any():
            ids, sizes = super().encode(texts.filter(pa.array(odd)))
            others = np.split(ids, np.cumsum(sizes)[:-1])
        return _assembled(odd, begin, row[part], self.held_ids, self.held_many, others)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, as letter to byte.

    Printable bytes stand for themselves, the others are numbered from U+0100 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Sides:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, definition: str, model: dict) -> None:
        self.a, self.b = After(definition), Remembering(model)
        letters = byte_letters()
        names: list[bytes] = [b""] * self.a.library.get_vocab_size()
        for name, i in self.a.library.get_vocab().items():
            names[i] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        self.a_bytes = pa.array(names, pa.large_binary())
        self.b_bytes = pa.array([x.replace(SPACE.encode(), b" ") for x in self.b.raw.to_pylist()], pa.large_binary())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their numbers per text, of both; none where a text isn't what its tokens' bytes say."""
        a, n_a = self.a.encode_after_space(texts)
        b, n_b = self.b.encode(texts)
        raw = [b" " + x if x else b"" for x in as_bytes(texts)]
        good = np.array([bool(x) for x in raw])
        for ids, many, names in ((a, n_a, self.a_bytes), (b, n_b, self.b_bytes)):
            taken = names.take(pa.array(ids.astype(np.int64)))
            ends = np.concatenate([[0], np.cumsum(many)])
            offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1][ends] if len(ids) else np.zeros(len(ends), np.int64)
            data = (taken.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
            good &= [data[x:y] == t for x, y, t in zip(offsets.tolist(), offsets[1:].tolist(), raw, strict=False)]
        return a[np.repeat(good, n_a)], np.where(good, n_a, 0), b[np.repeat(good, n_b)], np.where(good, n_b, 0)


def id_kind(n: int) -> np.dtype:
    return np.dtype("<u2" if n <= 65_536 else "<u4")


def encode_both(docs: DataFrame, definition: str, model: dict, text: str = "text") -> DataFrame:
    """docs without the text, with the ids of both sides as little-endian numbers (a_ids, b_ids; see id_kind)."""
    rows = docs.drop("a_ids", "b_ids")
    others = [c for c in rows.columns if c != text]
    schema = rows.select(*others, F.lit(b"").alias("a_ids"), F.lit(b"").alias("b_ids")).schema
    shared = docs.sparkSession.sparkContext.broadcast((definition, model))

    def packed(ids: np.ndarray, many: np.ndarray, names: pa.Array) -> pa.Array:
        kind = id_kind(len(names))
        data, ends = ids.astype(kind).tobytes(), (np.concatenate([[0], np.cumsum(many)]) * kind.itemsize).tolist()
        return pa.array([data[x:y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = None
        for large in pieces(batches, text, LEARN_BYTES):
            sides = sides or Sides(*shared.value)
            sides.b.learn(large.column(text).cast(pa.string()).fill_null(""))
            for batch in pieces([large], text, TEXT_BYTES):
                a, n_a, b, n_b = sides.encode(batch.column(text).cast(pa.string()).fill_null(""))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], packed(a, n_a, sides.a_bytes), packed(b, n_b, sides.b_bytes)], [*others, "a_ids", "b_ids"])

    return rows.mapInArrow(run, schema)


class Aligned:
    """Texts of a batch of stored ids, one after the other; all arrays go over the whole batch."""

    def __init__(self, batch: pa.RecordBatch, a_size: np.ndarray, b_size: np.ndarray) -> None:
        self.a, self.n_a = self._ids(batch.column("a_ids"), id_kind(len(a_size)))
        self.b, self.n_b = self._ids(batch.column("b_ids"), id_kind(len(b_size)))
        end_a, end_b = np.cumsum(a_size[self.a]), np.cumsum(b_size[self.b])
        total = int(end_a[-1]) if len(end_a) else 0
        in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        in_a[end_a], in_b[end_b] = True, True
        # a link ends at each byte where a token of either side ends
        self.cut = np.flatnonzero(in_a | in_b)
        a_ends, b_ends = in_a[self.cut], in_b[self.cut]
        self.link_a, self.link_b = self.a[np.cumsum(a_ends) - a_ends], self.b[np.cumsum(b_ends) - b_ends]
        #: whether a token is the last of its group
        self.last_a, self.last_b = in_b[end_a], in_a[end_b]
        ends = np.concatenate([[0], end_a])[np.cumsum(self.n_a)]
        self.link_ends = np.concatenate([[0], np.searchsorted(self.cut, ends, "right")])
        self.n_links = np.diff(self.link_ends)

    @staticmethod
    def _ids(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        raw = column.to_pylist()
        return np.frombuffer(b"".join(raw), kind).astype(np.int64), np.array([len(x) // kind.itemsize for x in raw], np.int64)

    def per_text(self, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])

    @property
    def pairs(self) -> np.ndarray:
        return self.link_a << 32 | self.link_b

    def groups(self, names: pa.Array, n_a: int, n_b: int) -> list[bytes]:
        """Per text `a1,a2|b1;a3|b2`; names: see _names."""
        group_a, group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        n = int(self.last_a.sum())
        before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=n))])
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n))])
        row = np.empty(len(self.a) + len(self.b), np.int64)
        row[np.arange(len(self.a)) + before_b[group_a]] = self.a + self.last_a * n_a
        row[np.arange(len(self.b)) + before_a[group_b + 1]] = 2 * n_a + self.b + self.last_b * n_b
        taken = names.take(pa.array(row))
        ends = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(row) + 1][ends].tolist() if len(row) else [0] * len(ends)
        data = (taken.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        return [data[x : max(x, y - 1)] for x, y in zip(offsets, offsets[1:], strict=False)]


def _names(n_a: int, n_b: int) -> pa.Array:
    """The ids of A with a comma and with a group's end after them, then those of B."""
    return pa.array([f"{i}{end}".encode() for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)], pa.large_binary())


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return pieces(batches, "a_ids", IDS_BYTES)


def local_pairs(encoded: DataFrame, a_size: np.ndarray, b_size: np.ndarray) -> DataFrame:
    """part (a task), home (a hash of the pair), pair (both ids), links: how often a task has each of its pairs; a task counts its own first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = [NOTHING], [NOTHING], 0
        for batch in _sized(batches):
            own = np.sort(Aligned(batch, a_size, b_size).pairs)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else NOTHING
            keys.append(own[first])
            counts.append(np.diff(np.append(first, len(own))))
            waiting += len(first)
            if waiting > PENDING:
                k, c = _counted(np.concatenate(keys), np.concatenate(counts))
                keys, counts, waiting = [k], [c], 0
        k, c = _counted(np.concatenate(keys), np.concatenate(counts))
        part = TaskContext.get().partitionId()
        for at in range(0, len(k), 500_000):
            some = slice(at, at + 500_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[some]), part, np.int32)), pa.array(_home(k[some])), pa.array(k[some]), pa.array(c[some])], ["part", "home", "pair", "links"])

    return encoded.select("a_ids", "b_ids").mapInArrow(run, "part int, home bigint, pair bigint, links bigint")


def _home(pair: np.ndarray) -> np.ndarray:
    return (mix64(pair.view(np.uint64), 33) >> np.uint64(1)).astype(np.int64)


def _hashes(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix64(pair.view(np.uint64), 31), mix64(pair.view(np.uint64), 32)


class Shards:
    """Reads shards of a folder by their number and keeps some."""

    def __init__(self, folder: str) -> None:
        self.system, self.base = pfs.FileSystem.from_uri(folder)
        self.held: OrderedDict[int, dict[str, np.ndarray]] = OrderedDict()
        self.bytes = 0

    def get(self, k: int) -> dict[str, np.ndarray]:
        if k not in self.held:
            self.held[k] = from_bytes(ds.dataset(f"{self.base}/shard={k}", filesystem=self.system, format="parquet").to_table(columns=["blob"])["blob"][0].as_py())
            self.bytes += sum(x.nbytes for x in self.held[k].values())
            while self.bytes > HELD_BYTES and len(self.held) > 1:
                self.bytes -= sum(x.nbytes for x in self.held.popitem(last=False)[1].values())
        self.held.move_to_end(k)
        return self.held[k]


def _index_of(table: dict[str, np.ndarray], pair: np.ndarray) -> np.ndarray:
    """The index of each pair, which its key there verifies; -1: unknown."""
    at = probe(table, *_hashes(pair))
    return np.where((at >= 0) & (table["keys"][np.maximum(at, 0)] == pair), at, -1)


def _delete(folder: str) -> None:
    system, path = pfs.FileSystem.from_uri(folder)
    system.delete_dir(path)


def build_counts(local: DataFrame) -> tuple[str, int, DataFrame]:
    """The folder of the index with a count per pair, its number of shards, and best: b_id, links (the highest count of a pair with that id)."""
    spark = local.sparkSession
    distinct = stored(local.select("home", "pair").distinct(), "pairs")
    n_shards = max(1, math.ceil(distinct.count() / SHARD_PAIRS))
    shard = (F.col("home") % n_shards).cast("int").alias("shard")
    hashes, index = shared_folder(spark, "pair-hashes"), shared_folder(spark, "pair-counts")

    def hashed(frame: pd.DataFrame) -> pd.DataFrame:
        pair = frame["pair"].to_numpy()
        table = build(*_hashes(pair))
        keys = np.empty(len(pair), np.int64)
        keys[probe(table, *_hashes(pair))] = pair
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "blob": [to_bytes(keys=keys, **table)]})

    distinct.select(shard, "pair").groupBy("shard").applyInPandas(hashed, "shard int, blob binary").write.partitionBy("shard").parquet(hashes)

    def dense(frame: pd.DataFrame) -> pd.DataFrame:
        k = int(frame["shard"].iloc[0])
        table = Shards(hashes).get(k)
        vector = np.zeros(len(table["keys"]), np.int64)
        np.add.at(vector, _index_of(table, frame["pair"].to_numpy()), frame["links"].to_numpy())
        return pd.DataFrame({"shard": [k], "part": [int(frame["part"].iloc[0])], "vector": [vector.tobytes()]})

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        vector = np.sum([np.frombuffer(x, np.int64) for x in frame["vector"]], axis=0)
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "part": [int(frame["part"].iloc[0])], "vector": [vector.tobytes()]})

    parts = (local.agg(F.max("part")).first()[0] or 0) + 1
    kind, up = "shard int, part int, vector binary", (F.col("part") / FAN).cast("int").alias("part")
    vectors = local.select(shard, up, "pair", "links").groupBy("shard", "part").applyInPandas(dense, kind)
    parts = math.ceil(parts / FAN)
    while parts > 1:
        vectors = vectors.select("shard", up, "vector").groupBy("shard", "part").applyInPandas(summed, kind)
        parts = math.ceil(parts / FAN)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = Shards(hashes)
        for batch in batches:
            for k, vector in zip(batch.column("shard").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                blob = to_bytes(counts=np.frombuffer(vector, np.int64), **source.get(k))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])

    vectors.mapInArrow(finished, "shard int, blob binary").write.partitionBy("shard").parquet(index)

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                table = from_bytes(blob)
                b_id = table["keys"] & 0xFFFFFFFF
                order = np.lexsort((table["counts"], b_id))
                last = np.flatnonzero(np.append(np.diff(b_id[order]) != 0, True)) if len(order) else NOTHING
                yield pa.RecordBatch.from_arrays([pa.array(b_id[order][last]), pa.array(table["counts"][order][last])], ["b_id", "links"])

    best = spark.read.schema("blob binary").parquet(index).mapInArrow(highest, "b_id bigint, links bigint").groupBy("b_id").agg(F.max("links").alias("links"))
    discard(distinct)
    _delete(hashes)
    return index, n_shards, best


def align(docs: DataFrame, definition: str, model: dict, text: str = "text", digest: bool = False) -> DataFrame:
    """How the tokens of a byte-level tokenizer (A) and of a SentencePiece model (B) cover every whole text.

    docs without the text, with n_a, n_b (tokens), n_groups (the text cut wherever a
    token of both ends), n_links (pairs of tokens that overlap), n_best (links whose
    count is the highest of their B id in the corpus), count_sum (over links; a count is how
    many links of the corpus join the same ids) and groups: `a1,a2|b1;a3|b2,b3` with
    the ids of each group or, with digest, its SHA-256 in groups_sha256. Input columns
    of these names are replaced.

    Both sides read the text after a space. Null and empty texts, and texts that their
    tokens don't spell (U+2581 reads as a space), have no tokens: zeros and an empty
    string. Very long texts: whole. Repeated rows count each time, like any others.
    Empty table: no rows. Pairs and counts cover all texts. The result is stored, the ids aren't kept.
    """
    new = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256" if digest else "groups"]
    rows = docs.drop(*(c for c in new if c != text))
    spark = docs.sparkSession
    sides = Sides(definition, model)
    a_size, b_size = (np.array([len(x) for x in names.to_pylist()], np.int64) for names in (sides.a_bytes, sides.b_bytes))
    encoded = stored(encode_both(rows, definition, model, text), "encoded")
    local = stored(local_pairs(encoded, a_size, b_size), "local-pairs")
    index, n_shards, best = build_counts(local)
    top = np.zeros(len(b_size), np.int64)  # bounded by the vocabulary
    for b_id, links in best.collect():
        top[b_id] = links
    discard(local)
    others = [c for c in encoded.columns if c not in ("n_bytes", "a_ids", "b_ids")]
    schema = encoded.select(*others, *[F.lit(0).cast("bigint").alias(c) for c in new[:-1]], F.lit("").alias(new[-1])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, names = Shards(index), _names(len(a_size), len(b_size))
        for batch in _sized(batches):
            found = Aligned(batch, a_size, b_size)
            pair, which = np.unique(found.pairs, return_inverse=True)
            home = _home(pair) % n_shards
            order = np.argsort(home, kind="stable")
            counts = np.zeros(len(pair), np.int64)
            for own in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []:
                table = shards.get(int(home[own[0]]))
                at = _index_of(table, pair[own])
                counts[own] = np.where(at >= 0, table["counts"][at], 0)
            links = counts[which]
            ends_a = np.concatenate([[0], np.cumsum(found.n_a)])
            columns = [found.n_a, found.n_b, found.per_text(found.last_a, ends_a), found.n_links, found.per_text(links == top[found.link_b], found.link_ends), found.per_text(links, found.link_ends)]
            texts = found.groups(names, len(a_size), len(b_size))
            texts = [hashlib.sha256(x).hexdigest() if x else "" for x in texts] if digest else [x.decode() for x in texts]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *[pa.array(x, pa.int64()) for x in columns], pa.array(texts, pa.string())], [*others, *new])

    out = stored(encoded.mapInArrow(run, schema), "aligned")
    discard(encoded)
    _delete(index)
    return out
