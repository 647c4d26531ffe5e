"""Words in runs of Han characters, by a lexicon: the most probable way through the graph of its words.

A run is cut so that the sum of its words' weights is greatest, a weight being the
logarithm of a word's share of the lexicon's counts, in whole millionths, so that sums
are exact. A character that is no word stands alone, with the weight of a count of 1. Of equal sums the one
whose first word is longer counts. Distinct runs of equal length advance together.
"""

from __future__ import annotations

import copy
import math
import re
from collections.abc import Callable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gleanery.functions import text as T
from gleanery.functions import words as W

#: Words that a lexicon may have to be held by every task; tokens that a task cuts at once, about, and whose words it keeps at most.
MOST_WORDS, TOKENS, KNOWN = 2_000_000, 1 << 20, 200_000
UNIT = 1_000_000
BASE = 0x9E3779B97F4A7C15
PARTS, BEGINS_HAN = re.compile(f"[{W.HAN}]+|[^{W.HAN}]+"), re.compile(f"[{W.HAN}]").match


class Segmenter:
    """lexicon: words with count and tag."""

    def __init__(self, lexicon: Mapping[str, tuple[int, str]]) -> None:
        if len(lexicon) > MOST_WORDS:
            raise ValueError(f"a lexicon of more than {MOST_WORDS} words")
        self.lexicon = {w: (n, t) for w, (n, t) in lexicon.items() if w and n > 0}
        self.total = max(1, sum(n for n, _ in self.lexicon.values()))
        self.alone = self._weight(1)
        self.sizes = sorted({len(w) for w in self.lexicon} | {1})
        found = sorted((self._hash(w), self._weight(n)) for w, (n, _) in self.lexicon.items())
        self.keys, self.weights = np.array([h for h, _ in found], np.uint64), np.array([w for _, w in found], np.int64)

    @classmethod
    def of(cls, lexicon: DataFrame) -> Segmenter:
        """From a table (word, count, and perhaps tag); of rows of one word the largest count, then the first tag, counts."""
        tag = F.coalesce("tag", F.lit("x")) if "tag" in lexicon.columns else F.lit("x")
        one = lexicon.where("word IS NOT NULL AND count > 0").groupBy("word").agg(F.min_by(tag, F.struct(-F.col("count"), tag)).alias("tag"), F.max("count").alias("count"))
        rows = one.limit(MOST_WORDS + 1).collect()
        return cls({r["word"]: (r["count"], r["tag"]) for r in rows})

    def _weight(self, count: int) -> int:
        return round(UNIT * math.log(count / self.total))

    @staticmethod
    def _hash(word: str) -> int:
        h = 0
        for c in word:
            h = (h * BASE + ord(c) + 1) % 2**64
        return h

    def _looked_up(self, hashes: np.ndarray) -> np.ndarray:
        """The weight of each hash, or the least number."""
        if not len(self.keys):
            return np.full(hashes.shape, np.iinfo(np.int64).min)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.weights[at], np.iinfo(np.int64).min)

    def _advanced(self, runs: np.ndarray) -> np.ndarray:
        """Of n runs of equal length, the size of the word that begins at each place of the best way on from there."""
        n, length = runs.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(length):
                prefix[j + 1] = prefix[j] * np.uint64(BASE) + runs[:, j].astype(np.uint64) + np.uint64(1)
        best, size = np.zeros((length + 1, n), np.int64), np.ones((length, n), np.int64)
        for i in range(length - 1, -1, -1):
            best[i] = np.iinfo(np.int64).min
            for k in self.sizes:
                if i + k > length:
                    break
                with np.errstate(over="ignore"):
                    weight = self._looked_up(prefix[i + k] - prefix[i] * np.uint64(pow(BASE, k, 2**64)))
                known = weight > np.iinfo(np.int64).min
                if k == 1:
                    weight, known = np.where(known, weight, self.alone), np.ones(n, bool)
                value = np.where(known, weight, 0) + best[i + k]
                better = known & (value >= best[i])
                best[i][better], size[i][better] = value[better], k
        return size

    def cut(self, runs: list[str]) -> list[list[str]]:
        """The words of each run."""
        out: list[list[str]] = [[] for _ in runs]
        lengths = np.array([len(r) for r in runs], np.int64)
        for length in np.unique(lengths[lengths > 0]).tolist():
            where = np.flatnonzero(lengths == length)
            for part in np.array_split(where, -(-len(where) * length // 1_000_000)):
                size = self._advanced(np.frombuffer("".join(runs[i] for i in part.tolist()).encode("utf-32-le"), "<u4").reshape(-1, length))
                for column, i in enumerate(part.tolist()):
                    at = 0
                    while at < length:
                        step = int(size[at, column])
                        out[i].append(runs[i][at : at + step])
                        at += step
        return out

    def inner(self, word: str) -> list[str]:
        """The words of two characters, then of three, that stand inside a longer word, then the word."""
        found = [word[i : i + k] for k in (2, 3) if len(word) > k for i in range(len(word) - k + 1)]
        return [*(w for w in found if w in self.lexicon), word]

    def parts(self, tokens: list[str], finer: bool = False, known: dict[str, list[str]] | None = None) -> list[list[str]]:
        """Each token's Han runs as words, the rest as it is. known keeps them from call to call."""
        if known is not None:
            fresh = [t for t in tokens if t not in known]
            new = dict(zip(fresh, self.parts(fresh, finer), strict=True))
            found = [new[t] if t in new else known[t] for t in tokens]
            known.update(list(new.items())[: max(0, KNOWN - len(known))])
            return found
        split = [PARTS.findall(t) for t in tokens]
        runs = list(dict.fromkeys(p for ps in split for p in ps if BEGINS_HAN(p)))
        words = dict(zip(runs, self.cut(runs), strict=True))
        if finer:
            words = {r: [x for w in ws for x in self.inner(w)] for r, ws in words.items()}
        return [words.get(ps[0], ps) if len(ps) == 1 else [w for p in ps for w in words.get(p, [p])] for ps in split]

    def lists(self, column: pa.Array, finer: bool = False, known: dict[str, list[str]] | None = None) -> pa.Array:
        """Lists of tokens with the words of each in its place, TOKENS tokens or one row at a time."""
        rows = np.cumsum(column.value_lengths().fill_null(0).to_numpy().astype(np.int64)) // TOKENS
        cuts = [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), len(column)]
        return pa.concat_arrays([self._lists(column.slice(a, b - a), finer, known) for a, b in zip(cuts, cuts[1:], strict=False)])

    def _lists(self, column: pa.Array, finer: bool, known: dict[str, list[str]] | None) -> pa.Array:
        """The distinct tokens are cut once."""
        coded = column.flatten().dictionary_encode()
        parts = self.parts(coded.dictionary.to_pylist(), finer, known)
        many = np.array([len(p) for p in parts], np.int64)
        ends, code = np.concatenate([[0], np.cumsum(many)]), coded.indices.to_numpy()
        each = many[code] if len(code) else np.zeros(0, np.int64)
        at = np.repeat(ends[code] - (np.cumsum(each) - each), each) + np.arange(each.sum()) if len(code) else np.zeros(0, np.int64)
        flat = pa.array([w for p in parts for w in p], pa.string()).take(pa.array(at))
        rows = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)])[rows].astype(np.int32)), flat)

    def of_runs(self, runs: Column, finer: bool = False) -> Column:
        """The words of lists of tokens whose Han characters aren't cut (text.whole_runs)."""
        own = self
        if not finer:
            # hashes and weights are all that tasks need for the words of runs
            own = copy.copy(self)
            own.lexicon = {}
        known: dict[str, list[str]] = {}

        @arrow_udf("array<string>")
        def run(column: pa.Array) -> pa.Array:
            return own.lists(column, finer, known)

        return run(runs)

    def _column(self, finer: bool) -> Callable[[Column], Column]:
        return lambda text: self.of_runs(T.whole_runs(text), finer)

    @property
    def analyse(self) -> Callable[[Column], Column]:
        """An analyser of texts; cutter and tagger cut queries alike."""
        return self._column(False)

    @property
    def analyse_finer(self) -> Callable[[Column], Column]:
        """An analyser that also gives the words inside words, to find parts of them."""
        return self._column(True)

    def cutter(self, word: str) -> list[str]:
        return self.parts([word])[0]

    def tagger(self, query: str) -> list[tuple[str, str]]:
        """Words with the lexicon's tags; what it doesn't know by the closed classes of English, or unknown (x)."""
        found = self.parts(re.findall(f"[{W.HAN}]+|[^\\W{W.HAN}]+", query))
        return [(w, tag if (tag := self.lexicon.get(w, (0, "x"))[1]) != "x" else W.LEXICON.get(w.lower(), "x")) for ws in found for w in ws]
