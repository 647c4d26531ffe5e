"""Benchmark decontamination: full-text indexes of document shards, searched for the phrases of test items.

A task indexes its documents in shards of SHARD_BYTES: the words of the distinct
texts are one sequence, with a mark after each text, so that no phrase reaches over.
Blocks of phrases are searched backwards in it, all phrases of a block together;
occurrences are located by sampled positions and merged into spans of words.

Phrases lie in files of the shared folder, a block per file, and are read a block at
a time, so there may be as many as one likes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pfs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import as_bytes, discard, gather, pieces, shared_folder, stored
from gleanery.llm.fm_index import AT_ONCE, FMIndex

#: Bytes of text in a shard, and phrases (with an item each) in a block, about.
SHARD_BYTES, BLOCK_ROWS = 8 << 20, 200_000
#: Bytes to bytes: A-Z lower-cased, all other ASCII but a-z and 0-9 as a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
#: Symbols below the words': the end, and the mark after a text.
MARK, OTHERS = 1, 2


class Words:
    """The words of some texts: ids in a row, the words themselves, where each text's begin, and bytes."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer((b"\n" + b"\n".join(texts) + b"\n").translate(FOLD), np.uint8)
        inside = data != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)])
        letters = data[inside]
        wide = len(letters) >= 1 << 31
        kind, size = (pa.large_binary(), np.int64) if wide else (pa.binary(), np.int32)
        coded = pa.Array.from_buffers(kind, len(self.start), [None, pa.py_buffer(ends.astype(size)), pa.py_buffer(letters)]).dictionary_encode()
        self.names, self.ids = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()
        #: where each text begins in the bytes, and its first word
        self.text = np.cumsum([1] + [len(t) + 1 for t in texts])[:-1]
        self.first = np.append(np.searchsorted(self.start, self.text), len(self.start))


def phrases(benchmark: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """phrase (words joined by spaces), item (its id as text): the windows of every item, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            found = Words(as_bytes(batch.column("text")))
            names = found.names.to_pylist()
            out, of = [], []
            for row, (a, b) in enumerate(zip(found.first.tolist(), found.first[1:].tolist(), strict=False)):
                words = [names[i] for i in found.ids[a:b].tolist()]
                own = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
                out += own
                of += [row] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column("item").take(pa.array(of, pa.int64()))], ["phrase", "item"])

    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return items.mapInArrow(run, "phrase binary, item string").distinct()


class Block:
    """Phrases as rows of word numbers, and the items of each."""

    def __init__(self, table: pa.Table) -> None:
        coded = table["phrase"].combine_chunks().dictionary_encode()
        words = [p.split(b" ") for p in coded.dictionary.to_pylist()]
        self.sizes = np.array([len(w) for w in words], np.int64)
        numbers = pa.array([w for p in words for w in p], pa.binary()).dictionary_encode()
        self.names = numbers.dictionary
        self.words = np.zeros((len(words), int(self.sizes.max(initial=0))), np.int64)
        self.words[np.arange(self.words.shape[1]) < self.sizes[:, None]] = numbers.indices.to_numpy()
        of = coded.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        ids = table["item"].combine_chunks().dictionary_encode()
        self.ids = ids.dictionary.to_pylist()
        self.items = ids.indices.fill_null(-1).to_numpy()[order].astype(np.int64)
        self.ends = np.searchsorted(of[order], np.arange(len(words) + 1))


class Blocks:
    """The blocks in a folder; one alone is kept."""

    def __init__(self, folder: str) -> None:
        system, path = pfs.FileSystem.from_uri(folder)
        self.files = [f for f in ds.dataset(path, filesystem=system, format="parquet").get_fragments() if f.count_rows()]
        self.held: Block | None = None

    def __iter__(self) -> Iterator[Block]:
        for file in self.files:
            block = self.held or Block(file.to_table(columns=["phrase", "item"]))
            self.held = block if len(self.files) == 1 else None
            yield block


class Shard:
    """An index of some texts; search() gives the words hit and each text's items."""

    def __init__(self, texts: list[bytes]) -> None:
        self.found = Words(texts)
        counts = np.diff(self.found.first)
        self.text = np.repeat(np.arange(len(texts)), counts + 1)  # of each place
        seq = np.full(len(self.text), MARK, np.int32)
        seq[np.arange(len(self.found.ids)) + np.repeat(np.arange(len(texts)), counts)] = self.found.ids + OTHERS
        self.index = FMIndex(seq, OTHERS + max(1, len(self.found.names)))

    def search(self, blocks: Blocks) -> tuple[np.ndarray, list[set[str]]]:
        change = np.zeros(len(self.found.ids) + 1, np.int64)
        items: list[set[str]] = [set() for _ in range(len(self.found.text))]
        for block in blocks:
            number = pc.index_in(block.names, value_set=self.found.names).fill_null(-1).to_numpy().astype(np.int64)
            symbols = number[block.words] + OTHERS
            symbols[np.arange(symbols.shape[1]) >= block.sizes[:, None]] = OTHERS
            known = np.flatnonzero((symbols >= OTHERS).all(axis=1))
            low, high = self.index.search(symbols[known], block.sizes[known])
            many = np.maximum(high - low, 0)
            ends = np.cumsum(many)
            for a in range(0, int(many.sum()), AT_ONCE):
                some = np.arange(a, min(a + AT_ONCE, int(ends[-1])))
                which = np.searchsorted(ends, some, "right")
                place = self.index.locate(low[which] + some - (ends[which] - many[which]))
                text, phrase = self.text[place], known[which]
                np.add.at(change, place - text, 1)
                np.add.at(change, place - text + block.sizes[phrase], -1)
                pair = np.unique(text * len(block.sizes) + phrase)
                item, each = gather(block.items, block.ends, pair % len(block.sizes))
                pair = np.repeat(pair // len(block.sizes), each) * len(block.ids) + item
                for t, i in zip(*np.divmod(np.unique(pair[item >= 0]), max(1, len(block.ids))), strict=True):
                    items[t].add(block.ids[i])
        return np.cumsum(change[:-1]) > 0, items

    def spans(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each run of hit words of a text: the text, its first and last byte there (end exclusive)."""
        new = hit.copy()
        new[1:] &= ~hit[:-1]
        first = self.found.first[:-1]
        first = first[first < len(hit)]
        new[first] |= hit[first]
        start = np.flatnonzero(new)
        stop = hit.copy()
        stop[:-1] &= ~hit[1:] | new[1:]
        last = np.flatnonzero(stop)
        text = np.searchsorted(self.found.first, start, "right") - 1
        return text, self.found.start[start] - self.found.text[text], self.found.end[last] - self.found.text[text]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", kept: str | None = None, shard_bytes: int = SHARD_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with what of every whole text stands in the benchmark (item_id, text).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
    A phrase is n consecutive words of an item, or all words of a shorter one. New
    columns, which replace input columns of their names: n_words; n_hit, words inside
    an occurrence of any phrase; items, the ids of the items with such phrases as text,
    sorted; spans, what to remove: bytes (start, end) of each run of hit words; and,
    where kept names a column, the text without these spans.

    Null text, of either table: no words. An item of null id hits words but isn't
    named. Items without words find nothing; equal items and repeated ids are all
    named, once. Very long texts: whole, a shard of their own. Copies in a shard are
    indexed once, and each row gets its result. Empty tables: no rows, or no hits.
    """
    if kept == text:
        raise ValueError("kept must name another column than the text's")
    found, folder = stored(phrases(benchmark, n), "phrases-found"), shared_folder(docs.sparkSession, "phrases")
    found.repartitionByRange(max(1, math.ceil(found.count() / block_rows)), "phrase", "item").write.parquet(folder)
    discard(found)
    new = ["n_words", "n_hit", "items", "spans", *([kept] if kept else [])]
    rows = docs.drop(*new)
    names, at = rows.columns, rows.columns.index(text)
    span = "array<struct<start:bigint,end:bigint>>"
    added = [F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast(span).alias("spans"), *([F.lit("").alias(kept)] if kept else [])]
    schema = rows.select("*", *added).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for batch in pieces(batches, text, shard_bytes):
            blocks = blocks or Blocks(folder)
            coded = batch.column(at).cast(pa.large_string()).fill_null("").dictionary_encode()
            row, texts = coded.indices.to_numpy(), as_bytes(coded.dictionary)
            shard = Shard(texts)
            hit, items = shard.search(blocks)
            of, start, end = shard.spans(hit)
            first = shard.found.first
            n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
            ends = np.searchsorted(of, np.arange(len(texts) + 1))
            pairs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            named = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
            columns = [pa.array(np.diff(first)[row]), pa.array(n_hit[row]), named.take(coded.indices), spans.take(coded.indices)]
            if kept:
                cut = []
                for t, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)):
                    borders = [0, *np.column_stack([start[a:b], end[a:b]]).ravel().tolist(), len(texts[t])]
                    cut.append(b"".join(texts[t][x:y] for x, y in zip(borders[::2], borders[1::2], strict=True)))
                columns.append(pa.array(cut, pa.binary()).cast(pa.string()).take(coded.indices))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *new])

    return rows.mapInArrow(run, schema)
