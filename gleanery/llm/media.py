"""Media columns: texts or samples as PNG, read back, and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm.common import as_bytes, pieces

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _guesses(samples: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """What each of the five filters subtracts from each sample; first: rows with no row above."""
    wide = samples.astype(np.int16)
    left, up, corner = np.zeros_like(wide), np.zeros_like(wide), np.zeros_like(wide)
    left[:, 1:], up[1:] = wide[:, :-1], wide[:-1]
    up[first] = 0
    corner[:, 1:] = up[:, :-1]
    yield np.zeros_like(wide)
    yield left
    yield up
    yield (left + up) >> 1
    yield _paeth(left, up, corner)


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three neighbours, the one nearest to left + up - corner; ties go in this order."""
    to_left, to_up, to_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))


def filter_rows(samples: np.ndarray, first: np.ndarray, kind: int | None = None) -> np.ndarray:
    """Each row's filter type and filtered samples; without a kind, each row takes the filter with the least sum of absolute differences."""
    rows, cols = samples.shape
    raw, least = np.empty((rows, cols + 1), np.uint8), np.full(rows, np.iinfo(np.int64).max)
    for k, guess in enumerate(_guesses(samples, first)):
        if kind in (None, k):
            rest = (samples - guess).astype(np.uint8)
            sums = np.abs(rest.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
            better = sums < least
            least[better], raw[better, 0], raw[better, 1:] = sums[better], k, rest[better]
    return raw


def _png(raw: np.ndarray, level: int) -> bytes:
    head = struct.pack(">IIBBBBB", raw.shape[1] - 1, raw.shape[0], 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + chunk(b"IEND", b"")


def encode_png(samples: np.ndarray, kind: int | None = None, level: int = 6) -> bytes:
    """A grey 8-bit PNG of a 2-d uint8 array; kind: one filter type for all rows, else each row has its own."""
    return _png(filter_rows(samples, np.zeros(1, np.int64), kind), level)


def encode_pngs(images: list[np.ndarray], level: int = 6) -> list[bytes]:
    """PNGs of images of one width, their rows filtered together."""
    ends = np.cumsum([len(x) for x in images])
    raw = filter_rows(np.concatenate(images), ends - [len(x) for x in images])
    return [_png(x, level) for x in np.split(raw, ends[:-1])]


def _parse(data: bytes) -> np.ndarray:
    """The filter type and filtered samples of each row of a grey 8-bit PNG without interlacing; every chunk's checksum is tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, payload = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(payload) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(payload, zlib.crc32(kind))):
            raise ValueError(f"bad checksum in chunk {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", payload)
        elif kind == b"IDAT":
            body.append(payload)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0) or not ended:
        raise ValueError("only whole grey 8-bit images without interlacing are read")
    cols, rows = head[:2]
    return np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(rows, cols + 1)


def decode_png(data: bytes) -> np.ndarray:
    return decode_pngs([data])[0]


def decode_pngs(data: list[bytes]) -> list[np.ndarray]:
    """The samples of PNGs; rows of images of one width are unfiltered together."""
    raws = [_parse(x) for x in data]
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(raws)
    by_width: dict[int, list[int]] = {}
    for i, raw in enumerate(raws):
        by_width.setdefault(raw.shape[1], []).append(i)
    for same in by_width.values():
        sizes = np.array([len(raws[i]) for i in same])
        rows = unfilter(np.concatenate([raws[i] for i in same]), sizes)
        for i, samples in zip(same, np.split(rows, np.cumsum(sizes)[:-1]), strict=True):
            out[i] = samples
    return out


def unfilter(raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Samples of images (sizes rows each) under one another, from filter types and filtered samples.

    A sample needs those to its left, above and between. So all samples of one
    diagonal (row + column), of all images at once, are one step.
    """
    kinds, cols = raw[:, 0], raw.shape[1] - 1
    if (kinds > 4).any():
        raise ValueError(f"filter type {kinds.max()}")
    first = np.cumsum(sizes) - sizes
    row = np.arange(len(raw)) - np.repeat(first, sizes)
    # a column of zeros on the left, a row of zeros at the end that stands above first rows
    wide = np.zeros((len(raw) + 1, cols + 1), np.int16)
    wide[:-1, 1:] = raw[:, 1:]
    flat, place = wide.ravel(), np.arange(len(raw)) * (cols + 1)
    above = np.where(row == 0, len(raw) * (cols + 1), place - (cols + 1))
    todo, steps = [], 0
    for kind in range(1, 5):
        mine = np.flatnonzero(kinds == kind)
        if len(mine):
            mine = mine[np.argsort(row[mine], kind="stable")]
            at = row[mine]
            bounds = np.searchsorted(at, np.arange(int(at[-1]) + 2))
            todo.append((kind, place[mine], above[mine], at, bounds))
            steps = max(steps, int(at[-1]) + cols)
    for step in range(steps):
        for kind, place_, above_, at, bounds in todo:
            lo, hi = bounds[min(max(step - cols + 1, 0), len(bounds) - 1)], bounds[min(step + 1, len(bounds) - 1)]
            if lo == hi:
                continue
            col = step - at[lo:hi]
            here = place_[lo:hi] + col
            if kind == 1:
                guess = flat[here]
            else:
                up = above_[lo:hi] + col
                guess = flat[up + 1] if kind == 2 else (flat[here] + flat[up + 1]) >> 1 if kind == 3 else _paeth(flat[here], flat[up + 1], flat[up])
            flat[here + 1] = (flat[here + 1] + guess) & 255
    return wide[:-1, 1:].astype(np.uint8)


def _basis(size: int, low: int) -> np.ndarray:
    at = np.arange(size)
    return np.array([np.cos(np.pi * k * (2 * at + 1) / (2 * size)) for k in range(low)])


BASIS = _basis(32, 8)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: is each of the low 8 x 8 cosine terms over the median of all but the constant one?

    The image is first brought to 32 x 32 by averaging areas, or by repeating rows.
    """
    def bands(n: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.arange(32) * n // 32
        return start, np.maximum((np.arange(32) + 1) * n // 32, start + 1) - start

    start, many = bands(samples.shape[0])
    sums = np.vstack([np.zeros((1, samples.shape[1])), np.cumsum(samples, axis=0, dtype=np.float64)])
    rows = (sums[start + many] - sums[start]) / many[:, None]
    start, many = bands(samples.shape[1])
    sums = np.hstack([np.zeros((32, 1)), np.cumsum(rows, axis=1)])
    small = (sums[:, start + many] - sums[:, start]) / many
    low = (BASIS @ small @ BASIS.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload(text: bytes, unit: int = WIDTH) -> bytes:
    """The text's bytes with bytes 0 appended up to a positive multiple of unit."""
    return text + b"\0" * (unit - len(text) % unit if len(text) % unit or not text else 0)


MEDIA = "doc_id bigint, n_bytes bigint, media binary"


def encode_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's padded bytes as rows of 64 grey samples in a PNG."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 8 << 20):
            texts = as_bytes(batch.column("text"))
            media = encode_pngs([np.frombuffer(payload(x), dtype=np.uint8).reshape(-1, WIDTH) for x in texts], level=3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", docs[text].alias("text")).mapInArrow(run, MEDIA)


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature binary"


def read_media(media: DataFrame) -> DataFrame:
    """What the stored images hold: digests of payload and media, and the hash as a binary column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media", 4 << 20):
            stored = [x or b"" for x in batch.column("media").to_pylist()]
            out: list[tuple] = []
            for x, samples in zip(stored, decode_pngs(stored), strict=True):
                data = samples.tobytes()
                out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(x), hashlib.sha256(x).hexdigest(), cosine_hash(samples)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], [f.split()[0] for f in FEATURES.split(", ")])

    return media.mapInArrow(run, FEATURES)


def text_media(docs: DataFrame) -> DataFrame:
    """Texts stored as PNG and read back, one row per document.

    Each row of an image has the filter with the least sum of absolute differences.
    Null text: empty (one row of zeros). Very long texts: one image each, as any
    other. Null doc_id: kept. Repeated rows stay; equal texts give equal values. Only doc_id and text are read, so other columns
    may have any name. Empty table: no rows.
    """
    return read_media(encode_texts(docs))
