"""English word stems by suffix rules (Porter 1980, with its author's two later rules), over distinct tokens only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from gleanery.functions.text import tokens

# The algorithm's suffixes with what takes their place, by step.
STEP_2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split())
STEP_3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
#: Shorter and longer words stay as they are.
SHORTEST, LONGEST = 3, 64


def shape(word: str) -> str:
    """v for each vowel, c for each other letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out[-1:] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(stem).count("vc")


def _replaced(word: str, rules: dict[str, str], least: int) -> str:
    """The longest suffix of the rules decides; it is replaced if enough is before it."""
    for size in range(min(7, len(word) - 1), 0, -1):
        new = rules.get(word[-size:])
        if new is not None:
            return word[:-size] + new if measure(word[:-size]) >= least else word
    return word


def _ends_short(stem: str) -> bool:
    """Consonant, vowel, consonant, the last none of w, x, y."""
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def stem(word: str) -> str:
    if not SHORTEST <= len(word.encode()) <= LONGEST:
        return word
    # a suffix always leaves something before it
    ends = lambda suffix: len(word) > len(suffix) and word.endswith(suffix)
    # plurals
    if ends("s"):
        word = word[:-2] if ends("sses") or ends("ies") else word if word.endswith("ss") else word[:-1]
    # past and progressive forms
    if ends("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                cut = word[: -len(suffix)]
                if "v" in shape(cut):
                    word = cut
                    if cut.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif cut[-1:] == cut[-2:-1] and shape(cut)[-1] == "c" and cut[-1] not in "lsz":
                        word = cut[:-1]
                    elif measure(cut) == 1 and _ends_short(cut):
                        word += "e"
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2, 1), STEP_3, 1)
    found = [s for s in STEP_4 if word.endswith(s)]
    if found:
        cut = word[: -len(max(found, key=len))]
        if measure(cut) > 1 and (not word.endswith("ion") or cut[-1:] in ("s", "t")):
            word = cut
    # a last e, and a double l
    if word.endswith("e"):
        cut = word[:-1]
        m = measure(cut)
        if m > 1 or (m == 1 and not _ends_short(cut)):
            word = cut
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def stem_lists(column: pa.Array) -> pa.Array:
    """Each token of each list as its stem; the distinct tokens are worked out once."""
    coded = column.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), stems.take(coded.indices))


def stemmed(lists: Column) -> Column:
    """Each token of an array as its stem."""
    @arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        return stem_lists(column)

    return run(lists)


def stemmed_tokens(text: Column) -> Column:
    """As functions.text.tokens, every token as its stem: an analyser for searches."""
    return stemmed(tokens(text))


def cutter(cut):  # noqa: ANN001, ANN201
    """A cutter of query words whose parts are stems, to go with stemmed_tokens."""
    return lambda word: [stem(part.lower()) for part in cut(word)]
