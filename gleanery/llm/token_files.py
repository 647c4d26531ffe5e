"""Token ids as binary files with keyed access through a minimal perfect hash.

A shard file holds, little-endian: MAGIC, a JSON header's size (uint32) and the
header, then the payload of raw ids (uint16 if all ids fit, else uint32), the keys
in order, the first id of each key's row, and the index: a perfect hash of the keys
with, per slot, a fingerprint and the place of the key's first row.

The manifest has a row per file with its range of keys, so a key leads to its file
(a key with very many rows, to some) and, by the file's index, to a slice of its payload.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import gather, mix64, pieces, shared_folder, split_words, stored
from gleanery.llm.perfect_hash import build, probe

MAGIC = b"IDSHARD1"
#: Bytes of text in a shard, about.
SHARD_BYTES = 64 << 20
#: Characters of a text that part the rows of a doc_id, where it has very many.
TIE_CHARS = 200
#: Distinct words that the library is given at once, as one text.
AT_ONCE = 16_384
#: Bytes of text that a task encodes at once, and distinct words whose ids it keeps for the next.
PIECE_BYTES, REMEMBERED = 6 << 20, 3_000_000
#: Texts in which a space isn't surely the start of a word: after other white space, or at either end.
ODD = "[\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200b}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}] |^ | $|^$"

MANIFEST = "part int, path string, first_key bigint, last_key bigint, n_rows bigint, n_ids bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class Encoder:
    """Ids of whole texts; each distinct word of a task is encoded by the library once.

    Byte-level BPE never merges over a space after other text, so the ids of a text
    are those of its words with the spaces before them. Many words are given to the
    library as one text, and the ids' lengths in bytes tell where each word's end.

    added: the tokens added to the vocabulary (<|endoftext|>) are found in texts, as
    the library does unless told otherwise; texts that hold one are given to it whole.
    Without, special ones are text like any other.
    """

    def __init__(self, definition: str, added: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = not added
        found = [t.content for t in self.library.get_added_tokens_decoder().values() if added]
        self.odd = "|".join([ODD, *map(re.escape, found)])
        self.size = np.zeros(self.library.get_vocab_size(), np.int64)
        for piece, i in self.library.get_vocab().items():
            self.size[i] = len(piece)
        self.forget()

    def forget(self) -> None:
        self.words, self.ids, self.many = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for at in range(0, len(texts), 1024) for x in self.library.encode_batch_fast(texts[at : at + 1024], add_special_tokens=False)]

    def _spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word with a space before it, one after the other, and their numbers."""
        sizes = pc.binary_length(words).to_numpy().astype(np.int64) + 1
        ids, many = [], []
        for at in range(0, len(words), AT_ONCE):
            part = words.slice(at, AT_ONCE)
            text = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            found = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            reached, ends = np.cumsum(self.size[found]), np.cumsum(sizes[at : at + AT_ONCE])
            last = np.searchsorted(reached, ends)
            if not (len(found) and last[-1] == len(found) - 1 and (reached[last] == ends).all()):
                raise ValueError("the tokenizer joins words over spaces; it isn't byte-level")
            ids.append(found)
            many.append(np.diff(last, prepend=-1))
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(many) if many else np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        words, part, begin = split_words(texts.filter(pa.array(~odd)))
        if len(self.words) > REMEMBERED:
            self.forget()
        known = pc.index_in(words, value_set=self.words)
        new = words.filter(known.is_null())
        ids, many = self._spaced(new)
        self.words, self.ids, self.many = pa.concat_arrays([self.words, new]), np.concatenate([self.ids, ids]), np.concatenate([self.many, many])
        row = known.fill_null(-1).to_numpy().astype(np.int64)
        row[row < 0] = len(self.words) - len(new) + np.arange(len(new))
        ids, many = self.ids, self.many
        alone = np.unique(part[begin[:-1]])
        others = self._each(words.take(pa.array(alone)).to_pylist() + texts.filter(pa.array(odd)).to_pylist())
        ends = np.concatenate([[0], np.cumsum(np.concatenate([many, [len(x) for x in others]]))]).astype(np.int64)
        rows = row[part]
        rows[begin[:-1]] = len(self.words) + np.searchsorted(alone, part[begin[:-1]])
        # whole odd texts stand where they were
        counts = np.ones(len(texts), np.int64)
        counts[~odd] = np.diff(begin)
        first = np.cumsum(counts) - counts
        everything = np.empty(int(counts.sum()), np.int64)
        own = np.zeros(len(everything), bool)
        own[first[odd]] = True
        everything[own], everything[~own] = len(self.words) + len(alone) + np.arange(odd.sum()), rows
        out, sizes = gather(np.concatenate([ids, *others]).astype(np.uint32), ends, everything)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return out, total[first + counts] - total[first]


def key_hash(keys: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix64(keys.view(np.uint64), 11) ^ null.astype(np.uint64), mix64(keys.view(np.uint64), 12) + null.astype(np.uint64)


def write_shards(docs: DataFrame, definition: str, end_id: int | None = 2, shard_bytes: int = SHARD_BYTES, added: bool = False) -> DataFrame:
    """Encodes whole texts and writes them in ascending doc_id order; returns the manifest.

    Rows are range-partitioned by doc_id and the beginning of the text; a task writes one file in the shared folder
    under a name that no other run of it has, and its manifest row names that file,
    so a task that runs again leaves a file that nothing reads. Null doc_id: first
    (first_key is null where a file has such rows). Null text: only the end id.
    Repeated doc_ids stay apart, ordered by text; very many of one go to several files. Very long texts: a
    task encodes whole texts, PIECE_BYTES of them or one at a time. added: see Encoder.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-files")
    shared = spark.sparkContext.broadcast(definition)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, keys, null, many, stream = None, [], [], [], None
        system, base = pfs.FileSystem.from_uri(folder)
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.bin"
        for batch in pieces(batches, "text", PIECE_BYTES):
            if stream is None:
                system.create_dir(base, recursive=True)
                encoder, stream = Encoder(shared.value, added), system.open_output_stream(path)
                wide = encoder.library.get_vocab_size() > 65_536 or (end_id or 0) > 65_535
                kind = np.dtype("<u4" if wide else "<u2")
            ids, sizes = encoder.encode(batch.column("text").cast(pa.string()).fill_null(""))
            if end_id is not None:
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            stream.write(ids.astype(kind).tobytes())
            null.append(batch.column("doc_id").is_null().to_numpy(zero_copy_only=False))
            keys.append(batch.column("doc_id").fill_null(0).to_numpy())
            many.append(sizes)
        if stream is None:
            return
        keys, null, many = np.concatenate(keys).astype("<i8"), np.concatenate(null), np.concatenate(many).astype("<i8")
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])]))
        hi, lo = key_hash(keys[first], null[first])
        table = build(hi, lo)
        slot = probe(table, hi, lo)
        prints, place = np.empty(len(first), "<u8"), np.empty(len(first), "<i8")
        prints[slot], place[slot] = hi, first
        sections = {"keys": keys, "null": null.astype(np.uint8), "starts": np.concatenate([[0], np.cumsum(many)]).astype("<i8"), "prints": prints, "place": place, **table}
        header = json.dumps({"ids": kind.str, "n_ids": int(many.sum()), "sections": [[k, v.dtype.str, len(v)] for k, v in sections.items()]}).encode()
        for v in sections.values():
            stream.write(np.ascontiguousarray(v).tobytes())
        stream.write(header + struct.pack("<I", len(header)) + MAGIC)
        stream.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([path]), pa.array([None if null[0] else int(keys[0])], pa.int64()), pa.array([None if null[-1] else int(keys[-1])], pa.int64()), pa.array([len(keys)]), pa.array([int(many.sum())])], [f.split()[0] for f in MANIFEST.split(", ")])

    key = F.col("doc_id").asc_nulls_first()
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, key, F.left("text", F.lit(TIE_CHARS))).sortWithinPartitions(key, "text")
    return stored(ordered.mapInArrow(run, MANIFEST).withColumn("folder", F.lit(folder)), "token-manifest")


class Shard:
    """One file, opened: ids of a key in constant time. Sections are read when first asked for."""

    def __init__(self, folder: str, path: str) -> None:
        system, _ = pfs.FileSystem.from_uri(folder)
        self.file, self.held, self.bytes_read = system.open_input_file(path), {}, 0
        size = self.file.size()
        tail = self._read(max(0, size - 4096), min(size, 4096))
        if tail[-8:] != MAGIC:
            raise ValueError(f"{path} is no id shard")
        (length,) = struct.unpack("<I", tail[-12:-8])
        header = json.loads(tail[-12 - length : -12] if length + 12 <= len(tail) else self._read(size - 12 - length, length))
        self.kind, self.n_ids = np.dtype(header["ids"]), header["n_ids"]
        self.place, at = {}, self.n_ids * self.kind.itemsize
        for name, kind, n in header["sections"]:
            self.place[name] = (at, np.dtype(kind), n)
            at += np.dtype(kind).itemsize * n

    def _read(self, at: int, size: int) -> bytes:
        self.bytes_read += size
        return self.file.read_at(size, at)

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.held:
            at, kind, n = self.place[name]
            self.held[name] = np.frombuffer(self._read(at, n * kind.itemsize), kind)
        return self.held[name]

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from first to end: a slice of the payload."""
        end = self.n_ids if end is None else end
        return np.frombuffer(self._read(first * self.kind.itemsize, (end - first) * self.kind.itemsize), self.kind)

    def rows(self, keys: np.ndarray, null: np.ndarray | None = None) -> np.ndarray:
        """The first row of each key; -1 for keys that aren't in the file."""
        hi, lo = key_hash(keys, np.zeros(len(keys), bool) if null is None else null)
        slot = probe({k: self[k] for k in ("sizes", "bits", "before")}, hi, lo)
        if not len(self["prints"]):
            return np.full(len(keys), -1)
        at = np.maximum(slot, 0)
        return np.where((slot >= 0) & (self["prints"][at] == hi), self["place"][at], -1)

    def row_ids(self, row: int) -> np.ndarray:
        return self.ids(int(self["starts"][row]), int(self["starts"][row + 1]))


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: where its ids start, how many, their crc32.

    Each file's keys are looked up through its index. A window over the manifest
    (one row per file) adds up the ids before each; a task holds one file at a time.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "folder", "path", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                shard = Shard(file["folder"], file["path"])
                keys, null, starts, ids = shard["keys"], shard["null"].astype(bool), shard["starts"], shard.ids()
                row = shard.rows(keys, null)
                if (row < 0).any() or (keys[row] != keys).any():
                    raise ValueError(f"the index of {file['path']} misses keys")
                # rows of a repeated key follow its first row
                row = row + (np.arange(len(row)) - np.maximum.accumulate(np.where(row == np.arange(len(row)), row, 0)))
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(starts[row].tolist(), starts[row + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), pa.array(starts[row] + file["base"]), pa.array(starts[row + 1] - starts[row]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(1, manifest.count()), "part").mapInArrow(run, ROWS)


def lookup(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id, ids of the rows of each key (doc_id) in keys; unknown keys give no rows.

    The driver holds the range of keys of each file (a few bytes a file), by which keys
    are dealt to files. A task then reads a file's index and, of its payload, the slices
    of its keys. A repeated doc_id gives each of its rows; a null key those of null
    doc_ids. A key asked for twice is answered once.
    """
    files = manifest.select("part", "first_key", "last_key").orderBy("part").collect()
    if not files:
        return keys.where("false").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.array().cast("array<bigint>").alias("ids"))
    # files are in the order of keys, null keys first
    least = np.iinfo(np.int64).min
    low, high = (np.array([least if r[c] is None else r[c] for r in files]) for c in ("first_key", "last_key"))
    part, nulls = np.array([r["part"] for r in files], np.int32), sum(r["first_key"] is None for r in files)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            first, end = np.where(null, 0, np.searchsorted(high, key, "left")), np.where(null, nulls, np.searchsorted(low, key, "right"))
            many = np.maximum(end - first, 0)
            row = np.repeat(np.arange(len(key)), many)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(part[first[row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]])], ["doc_id", "part"])

    def read(file: pa.Table, asked: pa.Table) -> pa.Table:
        out_keys, lists = [], []
        if len(asked) and len(file):
            shard = Shard(file["folder"][0].as_py(), file["path"][0].as_py())
            keys = asked["doc_id"].combine_chunks()
            key, null = keys.fill_null(0).to_numpy(), keys.is_null().to_numpy(zero_copy_only=False)
            for k, no, row in zip(key.tolist(), null.tolist(), shard.rows(key, null).tolist(), strict=True):
                while 0 <= row < len(shard["keys"]) and shard["keys"][row] == k and bool(shard["null"][row]) == no:
                    out_keys.append(None if no else k)
                    lists.append(shard.row_ids(row).astype(np.int64))
                    row += 1
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        return pa.table({"doc_id": pa.array(out_keys, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    asked = keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().mapInArrow(deal, "doc_id bigint, part int")
    return manifest.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(read, "doc_id bigint, ids array<bigint>")


def token_digests(docs: DataFrame, definition: str, end_id: int | None = 2) -> DataFrame:
    """Writes docs as token files, reads them back, one row per document.

    Added tokens are found in texts, as an unmodified Tokenizer does.
    Null, empty, very long texts and repeated rows: see write_shards. Only doc_id and
    text are read, so other columns may have any name. Empty table: no files, no rows.
    """
    return read_shards(write_shards(docs, definition, end_id, added=True))
