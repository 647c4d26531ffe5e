"""SentencePiece encoding and decoding with batched numpy Viterbi.

The words of a batch are gathered, each distinct one is segmented once, and words
of equal length advance together, a character at a time. Rolling hashes of the
substrings that end there probe the sorted hashes of the pieces. Of the pieces that
may end there, the best is kept with a backpointer.

For a unigram model the best is the largest sum of scores. A BPE model's scores are
merge ranks, and the largest sum of ranks isn't what merging gives, so there a piece
counts 1 if it may follow the piece before it and else 0: two neighbouring pieces
stand in a merge result exactly if merging would not have joined across their
border, and exactly one piece may end at each place. That gives the library's ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import gather, pieces, split_words

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Longer words are cut where no piece reaches over.
LONG = 256
#: Texts in which a space isn't surely a word's start, or with a long word.
ODD = f"  |^ | $|^$|{SPACE}|[^ ]{{{LONG}}}"
NONE = np.int64(-1)


def _fields(message: bytes) -> dict[int, list]:
    """The fields of a protocol buffer by number: whole numbers, or bytes."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            value = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            value, at = message[at : at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


# Field numbers and model types of the format.
TRAINER, NORMALIZER, MODEL_TYPE, CHARSMAP, EXTRA_SPACES, ESCAPE, SUFFIX = 2, 3, 3, 2, 4, 5, 24
UNIGRAM, BPE = 1, 2


def load(path: str) -> dict:
    """The pieces of a model file, as plain values that travel with the plan.

    Unigram and BPE models are read; a model that rewrites characters, drops extra
    spaces, doesn't mark spaces or marks them after words is refused, as it would be
    encoded wrongly.
    """
    import sentencepiece

    with open(path, "rb") as file:
        whole_file = file.read()
    model = _fields(whole_file)
    trainer, normalizer = (_fields(model[n][0]) if n in model else {} for n in (TRAINER, NORMALIZER))
    kind = trainer.get(MODEL_TYPE, [UNIGRAM])[-1]
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"{path}: model type {kind} isn't supported")
    if normalizer.get(CHARSMAP, [b""])[-1] or normalizer.get(EXTRA_SPACES, [1])[-1] or not normalizer.get(ESCAPE, [1])[-1] or trainer.get(SUFFIX, [0])[-1]:
        raise ValueError(f"{path}: its normalization isn't supported")
    p = sentencepiece.SentencePieceProcessor(model_proto=whole_file)
    n = p.get_piece_size()
    plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    whole = p.encode("a", out_type=str)[0].startswith(SPACE)
    return {
        "pieces": [p.id_to_piece(i) for i in range(n)], "scores": [p.get_score(i) for i in range(n)], "plain": plain, "unknown": p.unk_id(),
        "bytes": {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)}, "prefix": whole, "unigram": kind == UNIGRAM,
    }


def _sorted_lookup(keys: np.ndarray, values: np.ndarray):
    """A probe of sorted 64-bit keys, with a bitmap before the binary search."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    seen = np.zeros(1 << 20, bool)
    shift = np.uint64(44)
    top = lambda k: ((k * BASE) >> shift).astype(np.int64)
    seen[top(keys)] = True

    def probe(wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), NONE)
        likely = np.flatnonzero(seen[top(wanted)])
        at = np.minimum(np.searchsorted(keys, wanted[likely]), len(keys) - 1)
        hit = keys[at] == wanted[likely]
        out[likely[hit]] = values[at[hit]]
        return out

    return probe


class Codec:
    def __init__(self, model: dict) -> None:
        self.model, names = model, model["pieces"]
        singles = [i for i in model["plain"] if len(names[i]) == 1]
        several = sorted((i for i in model["plain"] if len(names[i]) > 1), key=lambda i: -model["scores"][i])
        # ranks: single characters first, then pieces in the order in which they merge
        self.ids = np.array(singles + several, np.int64)
        self.text = [names[i] for i in self.ids]
        self.rank = {t: r for r, t in enumerate(self.text)}
        self.unigram = model["unigram"]
        self.score = np.array([model["scores"][i] for i in self.ids])
        self.split = np.array([self._last_merge(t) for t in self.text], np.int64)
        usable = [r for r, t in enumerate(self.text) if self.unigram or len(t) == 1 or self.split[r, 0] != r]
        pairs = [(int(self.split[r, 0]) << 32 | int(self.split[r, 1]), r) for r in usable if len(self.text[r]) > 1]
        if not self.unigram:
            self.joined = _sorted_lookup(np.array([p for p, _ in pairs], np.uint64), np.array([r for _, r in pairs], np.int64))
        self.longest = max(len(t) for t in self.text)
        self.piece = _sorted_lookup(np.array([self._hash(self.text[r]) for r in usable], np.uint64), np.array(usable, np.int64))
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE)]), dtype=np.uint64)
        # no piece reaches over these borders: before a space after other text, around a line break
        inner = {a + b for t in self.text for a, b in zip(t, t[1:], strict=False)}
        self.inner = inner
        lines = not any("\n" in x for x in inner)
        words = not any(x[1] == SPACE != x[0] for x in inner)
        self.word = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if lines and words else r"(?s:.+)")
        self.spaced = words and model["prefix"]
        # decoding: the bytes of each id
        plain = set(model["plain"])
        raw = [n.encode() if i in plain else b"" for i, n in enumerate(names)]
        raw[model["unknown"]] = b" \xe2\x81\x87 "
        for byte, i in model["bytes"].items():
            raw[i] = bytes([byte])
        self.raw = pa.array(raw, pa.large_binary())
        self.raw_size = np.array([len(x) for x in raw])

    def _hash(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) % 2**64
        return h

    def _last_merge(self, text: str) -> tuple[int, int]:
        """The two pieces that merging joins last to get text; (rank, rank) if it never gets there."""
        own = self.rank[text]
        parts = list(text)
        while len(parts) > 2:
            ranked = [(self.rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            best, at = min(ranked)
            if best == 1 << 30:
                return own, own
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) < 2 or any(p not in self.rank for p in parts):
            return own, own
        return self.rank[parts[0]], self.rank[parts[1]]

    def may_follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between two pieces; -1 and unknown characters join nothing.

        The two are taken apart, last merge first, and each pair that has met at the
        border is looked up: had it merged before the merges undone so far, the
        border would be gone.
        """
        ok = np.ones(len(first), bool)
        live = np.flatnonzero((first >= 0) & (second >= 0))
        a, b = first[live], second[live]
        limit = np.full(len(live), 1 << 40, np.int64)
        while len(live):
            joined = self.joined(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
            bad = (joined >= 0) & (joined < limit)
            ok[live[bad]] = False
            go = ~bad
            live, a, b = live[go], a[go], b[go]
            sa, sb = self.split[a, 1], self.split[b, 0]
            can_a, can_b = sa != a, sb != b
            left = can_a & ((a > b) | ~can_b)
            limit = np.where(left, a, b + 1)
            a, b = np.where(left, sa, a), np.where(left, b, sb)
            go = can_a | can_b
            live, a, b, limit = live[go], a[go], b[go], limit[go]
        return ok

    def _advance(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces (ranks; below -1: an unknown character) of n words of equal length, and their numbers."""
        n, length = words.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(length):
                prefix[j + 1] = prefix[j] * BASE + words[:, j].astype(np.uint64) + np.uint64(1)
        last, back = np.full((length + 1, n), NONE), np.zeros((length + 1, n), np.int64)
        best = np.zeros((length + 1, n))
        everyone = np.arange(n)
        for j in range(1, length + 1):
            open_ = everyone
            top = np.full(n, -np.inf)
            for size in range(min(self.longest, j), 0, -1):
                i = j - size
                with np.errstate(over="ignore"):
                    found = self.piece(prefix[j, open_] - prefix[i, open_] * self.powers[size])
                hit = np.flatnonzero(found >= 0)
                rows, found = open_[hit], found[hit]
                if self.unigram:
                    value = best[i, rows] + self.score[found]
                else:
                    reached = (i == 0) | (last[i, rows] != NONE)
                    rows, found = rows[reached], found[reached]
                    value = self.may_follow(last[i, rows] if i else np.full(len(rows), NONE), found).astype(float)
                    value[value == 0] = -np.inf
                better = value > top[rows]
                rows, found = rows[better], found[better]
                top[rows], last[j, rows], back[j, rows] = value[better], found, size
                if not self.unigram and len(rows):
                    open_ = open_[top[open_] == -np.inf]
            lost = np.flatnonzero(top == -np.inf)
            if len(lost):
                # a character of no piece stands alone; one of a piece would have been found
                alone = self.piece(words[lost, j - 1].astype(np.uint64) + np.uint64(1)) < 0
                rows = lost[alone]
                last[j, rows], back[j, rows] = -2 - words[rows, j - 1].astype(np.int64), 1
                top[rows] = best[j - 1, rows] - 1e6 if self.unigram else 1.0
            best[j] = top
        out, many = np.full((n, length), NONE), np.zeros(n, np.int64)
        at = np.full(n, length)
        while True:
            rows = np.flatnonzero(at > 0)
            if not len(rows):
                break
            out[rows, many[rows]] = last[at[rows], rows]
            at[rows] -= back[at[rows], rows]
            many[rows] += 1
        return out, many

    def _segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word one after the other, and their numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order, flats, manys = np.argsort(sizes, kind="stable"), [], []
        for length in np.unique(sizes).tolist():
            where = order[np.searchsorted(sizes, length, sorter=order) : np.searchsorted(sizes, length, "right", sorter=order)]
            step = max(1, 1_000_000 // length)
            for at in range(0, len(where), step):
                some = where[at : at + step].tolist()
                matrix = np.frombuffer("".join([words[i] for i in some]).encode("utf-32-le"), "<u4").reshape(-1, length)
                out, many = self._advance(matrix)
                place = np.arange(int(many.max()))[None, :]
                flats.append(np.take_along_axis(out, np.maximum(many[:, None] - 1 - place, 0), axis=1)[place < many[:, None]])
                manys.append(many)
        flat, many = np.concatenate(flats), np.concatenate(manys)
        ids, many = self._to_ids(flat, many)
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return gather(ids, np.concatenate([[0], np.cumsum(many)]), back)

    def _to_ids(self, flat: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ranks; an unknown character gives its bytes' ids, or else one unknown id for it and its like after it."""
        unknown = flat < 0
        if not unknown.any():
            return self.ids[flat], many
        word = np.repeat(np.arange(len(many)), many)
        if not self.model["bytes"]:
            again = np.zeros(len(flat), bool)
            again[1:] = unknown[1:] & unknown[:-1] & (word[1:] == word[:-1])
            return np.where(unknown, self.model["unknown"], self.ids[np.maximum(flat, 0)])[~again], np.bincount(word[~again], minlength=len(many))
        codes, which = np.unique(-2 - flat[unknown], return_inverse=True)
        raw = [[self.model["bytes"][b] for b in chr(c).encode()] for c in codes.tolist()]
        ends = np.concatenate([np.arange(len(self.ids) + 1), len(self.ids) + np.cumsum([len(x) for x in raw])])
        rows = flat.copy()
        rows[unknown] = len(self.ids) + which
        ids, each = gather(np.concatenate([self.ids, *map(np.array, raw)]), ends, rows)
        return ids, np.bincount(word, weights=each, minlength=len(many)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; empty: none.

        Each distinct word is segmented once: the parts between spaces, and in odd
        texts what the expression finds.
        """
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.spaced else np.ones(len(texts), bool)
        parts, part, begin = split_words(texts.filter(pa.array(~odd)))
        words, index = [SPACE + w for w in parts.to_pylist()], {}
        found, counts = [], np.zeros(len(texts), np.int64)
        for i, text in zip(np.flatnonzero(odd).tolist(), texts.filter(pa.array(odd)).to_pylist(), strict=True):
            own = self.word.findall((SPACE if self.model["prefix"] else "") + text.replace(" ", SPACE)) if text else []
            own = [part for w in own for part in (self._cut(w) if len(w) > LONG else [w])]
            found += [index.setdefault(w, len(words) + len(index)) for w in own]
            counts[i] = len(own)
        words += index
        counts[~odd] = np.diff(begin)
        rows = np.empty(int(counts.sum()), np.int64)
        of_odd = np.repeat(odd, counts)
        rows[of_odd], rows[~of_odd] = found, part
        ids, many = self._segment(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids, sizes = gather(ids, np.concatenate([[0], np.cumsum(many)]).astype(np.int64), rows)
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        return ids, total[ends] - total[ends - counts]

    def _cut(self, word: str) -> list[str]:
        """A long word in parts: no piece has the two characters of a border side by side."""
        borders = [0, *[i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inner], len(word)]
        return [word[a:b] for a, b in zip(borders, borders[1:], strict=False)]

    def decode(self, ids: np.ndarray, many: np.ndarray) -> list[bytes]:
        """The texts of rows of ids, as UTF-8."""
        joined = np.concatenate([[0], np.cumsum(self.raw_size[ids])])
        taken = self.raw.take(pa.array(ids))
        data = (taken.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        ends = joined[np.concatenate([[0], np.cumsum(many)]).astype(np.int64)].tolist()
        texts = [data[a:b].replace(SPACE.encode(), b" ") for a, b in zip(ends, ends[1:], strict=False)]
        return [t[1:] if self.model["prefix"] and t[:1] == b" " else t for t in texts]


def encode_documents(docs: DataFrame, model: dict, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of each whole text and, if asked for, the text decoded from them.

    An input column of such a name is replaced. Null or empty text: no ids, decoded
    to an empty text. U+2581 in a text reads as a space, as in the library. Very long
    texts: whole, a piece of the work each. Null doc_id and repeated rows: rows like
    any other. Empty table: no rows.
    """
    new = [ids, *([decoded] if decoded else [])]
    rows = docs.drop(*new)
    names = rows.columns
    schema = rows.select("*", F.array(F.lit(0)).alias(ids), *([F.lit("").alias(decoded)] if decoded else [])).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in pieces(batches, text, 16 << 20):
            codec = codec or Codec(shared.value)
            found, many = codec.encode(batch.column(text).cast(pa.string()).fill_null(""))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(found.astype(np.int32)))
            texts = [pa.array(codec.decode(found, many), pa.binary()).cast(pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, *texts], [*names, *new])

    return rows.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, model: dict, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of each row's ids; null: empty. An input column of that name is replaced.

    Bytes that are no UTF-8 become U+FFFD.
    """
    rows = docs.drop(text)
    names = rows.columns
    schema = rows.select("*", F.lit("").alias(text)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(shared.value)
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lists = part.column(ids)
                many = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                found = codec.decode(lists.flatten().to_numpy(), many)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.decode(errors="replace") for x in found], pa.string())], [*names, text])

    return rows.mapInArrow(run, schema)
