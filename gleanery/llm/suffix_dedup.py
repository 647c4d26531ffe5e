"""Suffix-array dedup: repeated byte strings by merging Burrows-Wheeler transforms.

Every window of SIZE bytes has a smallest hash among its inner K-byte strings; equal
windows have equal ones. Neighbouring windows of a document that share it form a
run, and runs are dealt out by it, so equal windows always meet in one bucket.

1. Documents send each run's hash; a bucket tells which hashes several documents have.
2. Documents send the bytes of those runs only: each distinct one once per bin of
   documents, with the least and the greatest doc_id that has it there. In a bucket,
   shards of runs get a Burrows-Wheeler transform each; the transforms are merged by
   refining an interleave: after each pass, rows of the shards stand in the order of
   two more bytes, and rows that agree so far keep a common number. At SIZE bytes
   these are the intervals of common prefixes, without sorting all suffixes. Every
   window learns the least doc_id of its interval.
3. A bin gets back these least doc_ids, once per distinct run, for the windows where
   one is smaller than its greatest. Its documents compare them with their own doc_id
   and cut the repeats out.

So a passage costs a bucket one entry per bin, however many documents have it. A
short string that very many documents have in different surroundings would bring all
these to one bucket; the runs of such a hash are sent window by window instead, dealt
out by hashes of whole windows.
Documents are shuffled once (both visits read the same exchange).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import as_bytes, gather, mix64, n_shuffle, pieces

SIZE, K = 50, 20
#: Windows in a run at most; shards whose transforms are merged; a byte that no UTF-8 text has.
MOST_WINDOWS, SHARDS, END = 200, 4, b"\xff"
#: A bucket's runs are merged in so many parts, each by itself.
PARTS = 4
#: Runs of one hash, in all documents, from which on they are sent by windows.
HOT_RUNS = 65_536
LAST = np.iinfo(np.int64).max


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each by planes of equal significance, compressed."""
    out = []
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x)
        planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes()
        data = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        out.append(b"%s %s %d %d\n" % (name.encode(), raw.dtype.str.encode(), len(raw), len(data)) + data)
    return b"".join(out)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    at, out = 0, {}
    while at < len(blob):
        line = blob.index(b"\n", at)
        name, kind, n, size = blob[at:line].split()
        kind, n, at = np.dtype(kind.decode()), int(n), line + 1
        data = pa.decompress(blob[at : at + int(size)], n * kind.itemsize, codec="zstd", asbytes=True) if int(size) else b""
        out[name.decode()] = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind)
        at += int(size)
    return out


def window_runs(texts: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run: the text, the first window's place in all bytes, the number of windows, the hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens)
    starts = ends - lens
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none, none, none.astype(np.uint64)
    k = min(K, size)
    with np.errstate(over="ignore"):
        # hash of k bytes from hashes of 1, 2, 4 ... bytes
        h, width, out, done = data.astype(np.uint64), 1, None, 0
        power = np.uint64(0x9E3779B97F4A7C15)
        while width <= k:
            if k & width:
                out, done = (h.copy(), width) if out is None else (out[: len(h) - done] * power + h[done:], done + width)
            h = h[: len(h) - width] * power + h[width:] if len(h) > width else h[:0]
            power = power * power
            width *= 2
    least = mix64(out)
    span, reach = size - k + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    least = least[: len(data) - size + 1]
    inside = np.zeros(len(least) + 1, np.int32)
    whole = np.flatnonzero(lens >= size)
    inside[starts[whole]] += 1
    np.add.at(inside, ends[whole] - size + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[starts[whole]] = True
    first = np.flatnonzero(new & valid)
    text = np.searchsorted(starts, first, "right") - 1
    # an empty text starts where the next one does; the last of equal starts is the whole one
    stop = np.minimum(np.append(first[1:], LAST), ends[text] - size + 1)
    many = stop - first
    cuts = -(-many // MOST_WINDOWS)
    if (cuts > 1).any():
        inner = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first, text, stop = np.repeat(first, cuts) + inner * MOST_WINDOWS, np.repeat(text, cuts), np.repeat(stop, cuts)
        many = np.minimum(stop - first, MOST_WINDOWS)
    return text, first, many, least[first]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h % np.uint64(buckets)).astype(np.int64)


def _split(order_by: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of sorted values: each value with its range."""
    cuts = np.flatnonzero(np.diff(order_by)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order_by)], strict=True):
        if b > a:
            yield int(order_by[a]), a, b


def _rows(keys: list[int], blobs: list[bytes], names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], list(names))


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each key from rows sorted by key."""
    now, held = None, []
    for batch in batches:
        for k, blob in zip(batch.column(key).to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if k != now and held:
                yield now, held
                held = []
            now = k
            held.append(blob)
    if held:
        yield now, held


# step 1


def _bits(n: int) -> int:
    return max(1, int(n - 1).bit_length())


def _send_hashes(buckets: int, bins: int, size: int):
    """Rows of a bucket: hashes and the bins that have them, sorted, and how many runs of a hash a bin has."""
    bin_bits = _bits(bins)
    short_bits = min(32, 64 - bin_bits - _bits(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 16 << 20):
            found = []
            for part in pieces([batch], "text", 1 << 20):
                text, _, _, h = window_runs(as_bytes(part.column("text")), size)
                b = part.column("bin").to_numpy()[text].astype(np.uint64)
                found.append((_bucket(h, buckets).astype(np.uint64) << np.uint64(short_bits) | h >> np.uint64(64 - short_bits)) << np.uint64(bin_bits) | b)
            key, many = _distinct(np.concatenate(found))
            bucket = (key >> np.uint64(short_bits + bin_bits)).astype(np.int64)
            short = (key >> np.uint64(bin_bits)) & np.uint64((1 << short_bits) - 1)
            b, many = (key & np.uint64((1 << bin_bits) - 1)).astype(np.uint32), np.minimum(many, 65_535).astype(np.uint16)
            keys, blobs = [], []
            for k, x, y in _split(bucket):
                keys.append(k)
                blobs.append(pack(h=np.diff(short[x:y], prepend=np.uint64(0)).astype(np.uint32), bin=b[x:y], many=many[x:y]))
            yield _rows(keys, blobs, ("bucket", "blob"))

    return run


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[start], np.diff(np.append(start, len(values)))


def _reply_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bin: its hashes of a bucket that stand more than once in all, and whether they are hot."""
    low = np.uint64(32)
    for bucket, blobs in _groups(batches, "bucket"):
        opened = [unpack(blob) for blob in blobs]
        key = np.concatenate([np.cumsum(x["h"], dtype=np.uint64) << low | x["bin"].astype(np.uint64) for x in opened])
        runs = np.concatenate([x["many"] for x in opened]).astype(np.int64)
        order = np.argsort(key)
        key, runs = key[order], runs[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] >> low != key[:-1] >> low]))
        total = np.repeat(np.add.reduceat(runs, start), np.diff(np.append(start, len(key))))
        key, total = key[total > 1], total[total > 1]
        by_bin, first = np.unique((key & np.uint64(0xFFFFFFFF)) << low | key >> low, return_index=True)
        hot = total[first] > HOT_RUNS
        keys, out = [], []
        for k, x, y in _split((by_bin >> low).astype(np.int64)):
            some = by_bin[x:y] & np.uint64(0xFFFFFFFF)
            keys.append(k)
            out.append(pack(bucket=np.array([bucket], np.int32), h=np.diff(some, prepend=np.uint64(0)).astype(np.uint32), hot=np.packbits(hot[x:y])))
        yield _rows(keys, out, ("bin", "blob"))


# step 2


def _send_runs(buckets: int, bins: int, size: int):
    """Rows of a part of a bucket: the distinct runs (of hot hashes, windows) of a bin, their hashes, the least and greatest order of each."""
    short_bits = min(32, 64 - _bits(bins) - _bits(buckets))

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        wanted, hot = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for blob in replies.column("blob").to_pylist():
            x = unpack(blob)
            wanted.append(np.uint64(int(x["bucket"][0]) << 32) | np.cumsum(x["h"], dtype=np.uint32).astype(np.uint64))
            hot.append(np.unpackbits(x["hot"])[: len(x["h"])].astype(bool))
        wanted, hot = np.concatenate(wanted), np.concatenate(hot)
        order = np.argsort(wanted)
        wanted, hot = wanted[order], hot[order]
        index: dict[bytes, int] = {}
        hashes: list[int] = []
        homes: list[int] = []
        windows: list[bool] = []

        def number(x: bytes, h: int, window: bool) -> int:
            i = index.setdefault(x, len(index))
            if i == len(hashes):
                home = xxhash.xxh3_64_intdigest(x) if window else h
                hashes.append(h)
                homes.append(home % buckets * PARTS + home // buckets % PARTS)
                windows.append(window)
            return i

        found_runs, found_orders = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in pieces(docs.to_batches(), "text", 1 << 20) if len(wanted) else []:
            texts = as_bytes(part.column("text"))
            text, first, many, h = window_runs(texts, size)
            key = _bucket(h, buckets).astype(np.uint64) << np.uint64(32) | h >> np.uint64(64 - short_bits)
            at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            take = np.flatnonzero(wanted[at] == key)
            data = b"".join(texts)
            runs, of = [], []
            for a, n, k, each, t in zip(first[take].tolist(), many[take].tolist(), h[take].tolist(), hot[at[take]].tolist(), text[take].tolist(), strict=True):
                found = [number(data[j : j + size], k, True) for j in range(a, a + n)] if each else [number(data[a : a + n + size - 1], k, False)]
                runs += found
                of += [t] * len(found)
            found_runs.append(np.array(runs, np.int64))
            found_orders.append(part.column("ordered").to_numpy()[np.array(of, np.int64)])
        keys, blobs = [], []
        if index:
            run_, order = np.concatenate(found_runs), np.concatenate(found_orders)
            least, most = np.full(len(index), LAST), np.full(len(index), np.iinfo(np.int64).min)
            np.minimum.at(least, run_, order)
            np.maximum.at(most, run_, order)
            strings, h, home, window = list(index), np.array(hashes, np.uint64), np.array(homes, np.int64), np.array(windows, np.uint8)
            by = np.argsort(home, kind="stable")
            for k, a, b in _split(home[by]):
                own = by[a:b]
                some = [strings[i] for i in own.tolist()]
                keys.append(k)
                blobs.append(pack(bin=docs.column("bin")[:1].to_numpy(), h=h[own], window=window[own], size=np.array([len(x) for x in some], np.uint16), bytes=np.frombuffer(b"".join(some), np.uint8), least=least[own], most=most[own]))
        return pa.Table.from_batches([_rows(keys, blobs, ("bucket", "blob"))])

    return run


def transform(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: its suffixes' places in the order of depth bytes or more, their first 8 bytes, and the two bytes before each.

    Each string with its end mark is a ring, so every place has bytes before and
    after it. Places are ranked by 8 bytes, then by twice as many each time.
    """
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    data = np.frombuffer(b"".join([s + END for s in strings]), np.uint8)
    place = np.arange(len(data))
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    ring = np.repeat(sizes, sizes)
    ahead = lambda n: base + (place - base + n) % ring
    key = data.astype(np.uint64)
    for width in (1, 2, 4):
        key = key << np.uint64(8 * width) | key[ahead(width)]
    first, width = key, 8
    while True:
        order = np.argsort(key)
        if width >= depth:
            break
        sorted_key = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]])).astype(np.uint64)
        key = rank << np.uint64(32) | rank[ahead(width)]
        width *= 2
    before = data[ahead(-2)].astype(np.uint16) << np.uint16(8) | data[ahead(-1)]
    return order, first[order], before[order]


#: Passes of the merge after which strings without a common beginning of any window leave.
LEAVE = (8, 14)


def merge(keys: list[np.ndarray], transforms: list[np.ndarray], strings: list[np.ndarray], starts: list[np.ndarray], n_strings: int, depth: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Merges the shards' rows up to depth bytes: (rows kept of each shard, interleave, interval of each row).

    The first interleave sorts the shards' first 8 bytes, which each has in order. A
    pass puts the two bytes before each row in the present interleave, then sorts
    the interleave by them, stably: rows are now in the order of two bytes more. A
    row starts an interval if its new bytes or its old interval differ from the row
    above. A string of which every window (starts) stands alone in its interval can
    repeat nothing; its ring's rows leave, and the others stay a transform.
    """
    rows, transforms = [np.arange(len(t)) for t in transforms], list(transforms)
    source = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    first = np.concatenate(keys)
    order = np.argsort(first, kind="stable")
    source, first = source[order], first[order]
    interval = np.zeros(len(source), np.int32)
    interval[1:] = np.cumsum(first[1:] != first[:-1])
    for done in range((depth - 8) // 2):
        if done in LEAVE:
            alone = np.ones(len(source), bool)
            differs = interval[1:] != interval[:-1]
            alone[1:] &= differs
            alone[:-1] &= differs
            stays = np.zeros(n_strings, bool)
            for k, own in enumerate(rows):
                mine = ~alone[source == k] & starts[k][own]
                stays[strings[k][own[mine]]] = True
            keep = np.empty(len(source), bool)
            for k, own in enumerate(rows):
                left = stays[strings[k][own]]
                keep[source == k] = left
                rows[k], transforms[k] = own[left], transforms[k][left]
            source, interval = source[keep], interval[keep]
            if not len(source):
                break
        symbols = np.empty(len(source), np.uint16)
        for k, own in enumerate(transforms):
            symbols[source == k] = own
        order = np.argsort(symbols, kind="stable")
        source, interval, sorted_symbols = source[order], interval[order], symbols[order]
        new = np.zeros(len(source), np.int32)
        new[1:] = (sorted_symbols[1:] != sorted_symbols[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(new, dtype=np.int32)
    return rows, source, interval


def _eight(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number; places near the end have fewer."""
    key = data.astype(np.uint64)
    for width in (1, 2, 4):
        ahead = np.zeros(len(key), np.uint64)
        ahead[:-width] = key[width:]
        key = key << np.uint64(8 * width) | ahead
    return key


def beginning_alike(strings: list[bytes], own: np.ndarray, size: int) -> np.ndarray:
    """Which strings have a window whose first 16 bytes begin another window too (size: 16 or more)."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    key = _eight(data)
    starts = np.cumsum(own + size - 1) - (own + size - 1)
    at = np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(own.sum())
    key = mix64(key[at]) ^ key[at + 8]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    shared = np.zeros(len(key), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    return np.logical_or.reduceat(shared, np.cumsum(own) - own)


def window_minima(strings: list[bytes], least: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of each string, the least value of any string that has it too.

    Returns the values one string after the other, and where each string's begin.
    Strings are distinct; size is even and 16 or more. Strings no window of which
    begins like another window can't share one, and aren't merged.
    """
    own = np.array([len(s) for s in strings], np.int64) - size + 1
    begin = np.cumsum(own) - own
    out = np.repeat(least, own)
    merged = np.flatnonzero(beginning_alike(strings, own, size)).astype(np.int32)
    shards = [merged[s::SHARDS] for s in range(min(SHARDS, len(merged)))]
    if not shards:
        return out, begin
    keys, transforms, string_of, offset_of, starts = [], [], [], [], []
    for which in shards:
        order, first, before = transform([strings[i] for i in which.tolist()], size)
        sizes = own[which] + size
        string_of.append(np.repeat(which, sizes)[order])
        offset_of.append((np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)[order])
        starts.append(offset_of[-1] < own[string_of[-1]])
        keys.append(first)
        transforms.append(before)
    rows, source, interval = merge(keys, transforms, string_of, starts, len(strings), size)
    if not len(source):
        return out, begin
    string, offset, valid = np.empty(len(source), np.int32), np.empty(len(source), np.int32), np.empty(len(source), bool)
    for k, kept in enumerate(rows):
        mine = source == k
        string[mine], offset[mine], valid[mine] = string_of[k][kept], offset_of[k][kept], starts[k][kept]
    value = np.where(valid, least[string], LAST)
    start = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    smallest = np.repeat(np.minimum.reduceat(value, start), np.diff(np.append(start, len(interval))))
    out[begin[string[valid]] + offset[valid]] = smallest[valid]
    return out, begin


def _find_repeats(size: int):
    """Rows of a bin: its runs (by two hashes), and of each the ranges of windows that begin in a document before its last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _groups(batches, "bucket"):
            index: dict[bytes, int] = {}
            columns: dict[str, list[np.ndarray]] = {k: [] for k in ("string", "bin", "h", "window", "least", "most")}
            for blob in blobs:
                x = unpack(blob)
                ends, data = np.cumsum(x["size"], dtype=np.int64), memoryview(x["bytes"])
                columns["string"].append(np.array([index.setdefault(bytes(data[a:b]), len(index)) for a, b in zip((ends - x["size"]).tolist(), ends.tolist(), strict=True)], np.int64))
                columns["bin"].append(np.repeat(x["bin"], len(ends)))
                for k in ("h", "window", "least", "most"):
                    columns[k].append(x[k])
            string, home, h, window, own_least, most = (np.concatenate(v) for v in columns.values())
            strings, least = list(index), np.full(len(index), LAST)
            np.minimum.at(least, string, own_least)
            smallest, begin = window_minima(strings, least, size)
            # ranges of windows of a string with the same least order
            new = np.ones(len(smallest), bool)
            new[1:] = smallest[1:] != smallest[:-1]
            new[begin] = True
            first = np.flatnonzero(new)
            ranges = np.append(np.searchsorted(first, begin), len(first))
            entry = np.repeat(np.arange(len(string)), np.diff(ranges)[string])
            which, _ = gather(np.arange(len(first)), ranges, string)
            value = smallest[first[which]]
            told = value < most[entry]
            entry, which, value = entry[told], which[told], value[told]
            if not len(entry):
                continue
            by = np.argsort(home[entry], kind="stable")
            entry, which, value = entry[by], which[by], value[by]
            offset, many = (first - np.repeat(begin, np.diff(ranges)))[which], np.diff(np.append(first, len(smallest)))[which]
            prints = {i: xxhash.xxh3_64_intdigest(strings[i]) for i in np.unique(string[entry]).tolist()}
            keys, out = [], []
            for k, x, y in _split(home[entry]):
                heads = np.flatnonzero(np.concatenate([[True], entry[x + 1 : y] != entry[x : y - 1]]))
                own = entry[x:y][heads]
                keys.append(k)
                out.append(pack(h=h[own], window=window[own], print=np.array([prints[i] for i in string[own].tolist()], np.uint64), ranges=np.diff(np.append(heads, y - x)).astype(np.uint8), offset=offset[x:y].astype(np.uint8), many=many[x:y].astype(np.uint8), value=value[x:y]))
            yield _rows(keys, out, ("bin", "blob"))

    return run


# step 3

RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _cut(size: int, digest_only: bool):
    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        told = [unpack(b) for b in repeats.column("blob").to_pylist()]
        h, window, prints, ranges, offset, many_, value = (np.concatenate([x[k] for x in told]) if told else np.zeros(0, np.uint64) for k in ("h", "window", "print", "ranges", "offset", "many", "value"))
        ranges = np.concatenate([[0], np.cumsum(ranges, dtype=np.int64)])
        offset, many_ = offset.astype(np.int64), many_.astype(np.int64)
        known = {pair: i for i, pair in enumerate(zip(h.tolist(), prints.tolist(), strict=True))}
        h, hot = np.unique(h), np.unique(h[window > 0])
        out = []
        for part in pieces(docs.to_batches(), "text", 1 << 20):
            texts = as_bytes(part.column("text"))
            lens = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(lens)
            change = np.zeros(int(ends[-1]) + 1, np.int32)
            if len(h):
                text, first, many, own = window_runs(texts, size)
                data = b"".join(texts)
                maybe = np.flatnonzero(h[np.minimum(np.searchsorted(h, own), len(h) - 1)] == own)
                print_of = xxhash.xxh3_64_intdigest
                found = []
                for a, n, k, t, each in zip(first[maybe].tolist(), many[maybe].tolist(), own[maybe].tolist(), text[maybe].tolist(), np.isin(own[maybe], hot).tolist(), strict=True):
                    parts = [(j, j + size) for j in range(a, a + n)] if each else [(a, a + n + size - 1)]
                    found += [(i, x, t) for x, y in parts if (i := known.get((k, print_of(data[x:y])))) is not None]
                run_, place, doc = np.array(found, np.int64).reshape(-1, 3).T
                which, each = gather(np.arange(len(value)), ranges, run_)
                place, doc = np.repeat(place, each), np.repeat(doc, each)
                gone = value[which] < part.column("ordered").to_numpy()[doc]
                start = place[gone] + offset[which[gone]]
                np.add.at(change, start, 1)
                np.add.at(change, start + many_[which[gone]] + size - 1, -1)
            covered = np.cumsum(change[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(covered)])
            removed = total[ends] - total[ends - lens]
            opens = covered.copy()
            opens[1:] &= ~covered[:-1]
            whole = (ends - lens)[lens > 0]
            opens[whole] = covered[whole]
            spans = np.concatenate([[0], np.cumsum(opens)])
            spans = spans[ends] - spans[ends - lens]
            rest = np.frombuffer(b"".join(texts), np.uint8)[~covered].tobytes()
            stop = np.cumsum(lens - removed)
            kept = [rest[b - n : b] for b, n in zip(stop.tolist(), (lens - removed).tolist(), strict=True)]
            kept = [hashlib.sha256(x).digest() for x in kept] if digest_only else kept
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lens), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]))
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))

    return run


def cut_repeats(docs: DataFrame, size: int = SIZE, digest_only: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: texts without their repeated bytes.

    A byte goes if a string of size bytes that covers it also starts in a document
    with a smaller doc_id, both within their own document. kept holds what is left
    (its SHA-256 if digest_only).

    Null text: empty. Texts shorter than size stay. Very long texts are cut into runs
    of MOST_WINDOWS windows, as all are. Null doc_id: after all others, and not before
    another null. Rows of one doc_id don't cut each other. Only doc_id and text are
    read, so other columns may have any name. Empty table: no rows. Runs are told
    apart by 128 bits of hashes.
    """
    spark = docs.sparkSession
    parts = n_shuffle(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(parts, math.ceil(total / (32 << 20)))
    bins = parts
    if size % 2 or size < 16:
        raise ValueError("size must be even and 16 or more")
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(int(LAST))).alias("ordered"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(bins)).cast("int").alias("bin"))
    sent = base.select("bin", "text").mapInArrow(_send_hashes(parts, bins, size), "bucket int, blob binary")
    replies = sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_reply_hashes, "bin int, blob binary")
    placed = base.repartition(parts, "bin")
    runs = placed.groupBy("bin").cogroup(replies.repartition(parts, "bin").groupBy("bin")).applyInArrow(_send_runs(parts, bins, size), "bucket int, blob binary")
    repeats = runs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_find_repeats(size), "bin int, blob binary")
    return placed.groupBy("bin").cogroup(repeats.repartition(parts, "bin").groupBy("bin")).applyInArrow(_cut(size, digest_only), RESULT)
