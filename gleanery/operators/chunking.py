"""Documents cut into overlapping chunks of about 300 characters; one row in, many out.

The text of a document is cut by a small function per row; Spark deals the rows out
and carries each chunk with its document's key columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import IMAGE as IMAGE_PATTERN
from gleanery.functions.text import SPACE

# The score of a place to cut at, by what starts there.
BREAKS = (
    ("\n#[^#]", 100),
    ("\n##[^#]", 90),
    ("\n###[^#]", 80),
    ("\n####[^#]", 70),
    ("\n```[^\n]*", 80),
    ("\n(?:---|\\*\\*\\*|___)[\t\n\f\r ]*\n", 60),
    ("\n\n+", 20),
)
IMAGE = re.compile(IMAGE_PATTERN)
SENTENCE = "。！？.!?"
DECAY, WINDOW = 0.7, 50


@dataclass(frozen=True)
class Sizes:
    """All in characters, from the chunk's: hard limit, overlap, reach for breaks, what is small."""

    chunk: int = 300

    @property
    def hard(self) -> int:
        return self.chunk + self.chunk // 2

    @property
    def overlap(self) -> int:
        return max(self.chunk * 15 // 100, 30)

    @property
    def reach(self) -> int:
        return self.chunk // 2 * 4

    @property
    def small(self) -> int:
        return self.chunk // 4


@dataclass
class Piece:
    text: str
    start: int
    tokens: int | None = None
    line: int = 0


def tokens(text: str) -> int:
    ascii_ = sum(c < "\x80" for c in text)
    return ascii_ // 4 + 2 * (len(text) - ascii_)


class _Places:
    """Where Markdown may be cut: break places outside fences, with their byte offsets (distances count in bytes)."""

    def __init__(self, text: str) -> None:
        self.offset = None if text.isascii() else self._offsets(text)
        scores: dict[int, int] = {}
        for pattern, score in BREAKS:
            for m in re.finditer(pattern, text):
                scores[m.start()] = max(score, scores.get(m.start(), 0))
        marks = [m.start() for m in re.finditer("```", text)]
        fences = [(a, b + 3) for a, b in zip(marks[::2], marks[1::2], strict=False)]
        if len(marks) % 2:
            fences.append((marks[-1], len(text)))
        opens = [a for a, _ in fences]

        def free(place: int) -> bool:
            i = bisect_right(opens, place) - 1
            return i < 0 or place >= fences[i][1]

        self.places = sorted(p for p in scores if free(p))
        self.scores = [scores[p] for p in self.places]
        self.bytes = [self.at(p) for p in self.places]

    @staticmethod
    def _offsets(text: str) -> list[int]:
        out, at = [0], 0
        for c in text:
            at += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
            out.append(at)
        return out

    def at(self, place: int) -> int:
        return place if self.offset is None else self.offset[place]

    def best(self, target: int, reach: int) -> int:
        """The break with the highest score at or before target, scores fading with distance; the first of equals."""
        end = self.at(target)
        begin = max(0, end - reach)
        best, score = target, 0.0
        for i in range(bisect_left(self.bytes, begin), bisect_right(self.bytes, end)):
            far = (end - self.bytes[i]) / (end - begin + 1)
            value = self.scores[i] * (1.0 - far * far * DECAY)
            if value > score:
                best, score = self.places[i], value
        return best


def _pieces(text: str, size: int, cut) -> list[Piece]:
    out, at = [], 0
    while len(text) - at > size:
        end = cut(at + size)
        end = end if end > at else at + size
        out.append(Piece(text[at:end], at))
        at = end
    if at < len(text):
        out.append(Piece(text[at:], at))
    return out


def _joined(a: Piece, b: Piece, hard: int) -> Piece | None:
    return Piece(f"{a.text}\n{b.text}", a.start) if len(a.text) + 1 + len(b.text) <= hard else None


def _join_small(found: list[Piece], s: Sizes) -> list[Piece]:
    """Small pieces go to the next one; a small one after the very first goes to that."""
    out: list[Piece] = []
    for piece in found:
        last = out[-1] if out else None
        if last and (len(last.text) < s.small or (len(piece.text) < s.small and len(out) == 1)) and (both := _joined(last, piece, s.hard)):
            out[-1] = both
        else:
            out.append(piece)
    return out


def _finish(found: list[Piece], text: str, s: Sizes, stops: str, shift: int) -> list[Piece]:
    """Trimmed pieces with their lines and tokens, each after the first opening with the end of the one before."""
    lines = [m.start() for m in re.finditer("\n", text)]
    out = []
    for piece in found:
        if body := piece.text.strip(SPACE):
            out.append(Piece(body, piece.start, tokens(body), max(0, bisect_left(lines, piece.start) - shift)))
    bodies = [p.text for p in out]
    for piece, before in zip(out[1:], bodies, strict=False):
        if len(before) <= s.overlap:
            continue
        wish = len(before) - s.overlap
        ends = [i for i in range(max(0, wish - WINDOW), min(len(before), wish + WINDOW)) if before[i] in stops]
        tail = before[min(ends, key=lambda i: abs(i - wish)) + 1 :].strip(SPACE) if ends else ""
        if tail and len(tail) + 2 + len(piece.text) <= s.hard:
            piece.text = f"{tail}\n\n{piece.text}"
            piece.tokens = tokens(piece.text)
    return out


def markdown_chunks(body: str, size: int = 300) -> list[Piece]:
    """Cuts before headings, fences, rules and blank lines, the stronger and nearer the better, never inside a fence if there is another place."""
    s = Sizes(size)
    if not body:
        return []
    text = "\n" + IMAGE.sub("...(truncated)", body)
    places = _Places(text)
    return _finish(_join_small(_pieces(text, s.chunk, lambda t: places.best(t, s.reach)), s), text, s, SENTENCE, 1)


def plain_chunks(body: str, size: int = 300) -> list[Piece]:
    """Cuts after the sentence end or line break that is nearest to the wished length; a small last piece joins the one before."""
    s, stops = Sizes(size), SENTENCE + "\n"
    if not body:
        return []
    if len(body) <= s.chunk:
        return [Piece(body.strip(SPACE), 0, tokens(body))]

    def cut(target: int) -> int:
        ends = [i + 1 for i in range(max(0, target - WINDOW), min(len(body), target + WINDOW)) if body[i] in stops]
        return min(ends, key=lambda e: abs(e - target)) if ends else target

    found = _pieces(body, s.chunk, cut)
    if len(found) > 1 and len(found[-1].text) < s.small and (both := _joined(found[-2], found[-1], s.hard)):
        found[-2:] = [both]
    return _finish(found, body, s, stops, 0)


CHUNK = "seq int, content string, position int, token_count int"


def chunk(docs: DataFrame, keys: list[str], text: str = "text", path: str | None = None, size: int = 300) -> DataFrame:
    """keys, seq, content, position (0-based line), token_count: the chunks of each document.

    Names that end in .txt are plain, all others Markdown; without a path column all
    are Markdown. Null or empty text: no chunks.
    """
    kinds = docs.select(*keys).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    name = F.col(path) if path else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, found = [], []
                for i, (body, file) in enumerate(zip(part.column("__text").to_pylist(), part.column("__path").to_pylist(), strict=True)):
                    own = (plain_chunks if (file or "").endswith(".txt") else markdown_chunks)(body or "", size)
                    found += [(k, p.text, p.line, p.tokens) for k, p in enumerate(own)]
                    rows += [i] * len(own)
                columns = [part.column(k).take(pa.array(rows, pa.int64())) for k in keys]
                kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32())
                made = [pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*columns, *made], [*keys, "seq", "content", "position", "token_count"])

    return docs.select(*keys, F.col(text).alias("__text"), name.alias("__path")).mapInArrow(run, f"{fields}, {CHUNK}")
