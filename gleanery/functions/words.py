"""Word lists and query terms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping

# Stop words of English and Chinese that queries leave out.
STOP_WORDS = frozenset(
    """
a an the is are was were be been being have has had having do does did doing will would shall should can could may might must
i me my we our you your he she it they them this that these those what which who whom when where why how
to of in for on with at by from about as into like through after over between out up down off
and but or if because so than too very just now then also not no only here there
all each every both few more most other some such own same
的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们
那 什么 怎么 哪 吗 啊 呢 吧 能 可以 知道 觉得 这个 那个 想 做 让 把 被 给 对 从 用
因为 所以 但是 如果 虽然 还是 已经 应该 可能 一定 这样 那样 为什么
""".split()
)

# Tags of nouns, and of other words with a meaning (x: unknown).
NOUN_TAGS = frozenset("n ng nr ns nt nz vn an nrt nrl nrfg".split())
CONTENT_TAGS = frozenset("v vd vi vg vq adj adv a ag ad x".split())

#: Closed classes of English; other words are unknown (x) until a lexicon tells more.
LEXICON = {
    **dict.fromkeys("a an the this that these those".split(), "det"),
    **dict.fromkeys("i me my we our you your he she it they them who whom which what".split(), "pron"),
    **dict.fromkeys("to of in for on with at by from about as into through after over between off".split(), "prep"),
    **dict.fromkeys("and but or if because so than then".split(), "conj"),
    **dict.fromkeys("is are was were be been being have has had do does did will would shall should can could may might must".split(), "aux"),
}

MOST_TERMS = 256
UNSAFE = re.compile("[^a-zA-Z0-9\\s\U00020000-\U0003ffff\u2e80-\u2fd5\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufad9\u3041-\u309f\u30a0-\u30ff\u31f0-\u31ff]")
#: Han characters.
HAN = "\u2e80-\u2e99\u2e9b-\u2ef3\u2f00-\u2fd5\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufa6d\ufa70-\ufad9\U00020000-\U0003ffff"
#: Cuts a word of a query into tokens, as the index cuts texts.
Cutter = Callable[[str], list[str]]
#: Splits a query into (word, tag) pairs; users may bring their own, e.g. for Chinese.
Tagger = Callable[[str], list[tuple[str, str]]]


def fold(text: str) -> str:
    """As the indexed text is folded: Latin letters lose their marks."""
    return "".join(unicodedata.normalize("NFD", c)[0] if "\u00c0" <= c < "\u0250" and unicodedata.normalize("NFD", c)[0].isascii() else c for c in text)


def cut(word: str) -> list[str]:
    """As the indexed text is cut: runs of Han characters to overlapping pairs, one alone and all else as it is."""
    out = []
    for run in re.findall(f"[{HAN}]+|[^{HAN}]+", word):
        out += [run[i : i + 2] for i in range(len(run) - 1)] if len(run) > 1 and re.match(f"[{HAN}]", run) else [run]
    return out


def words(query: str, folded: bool = True, cutter: Cutter = cut) -> list[str]:
    return [part for word in UNSAFE.sub(" ", fold(query) if folded else query).split() for part in cutter(word)]


def tagger(lexicon: Mapping[str, str], cutter: Cutter = cut) -> Tagger:
    """Words with their tags by a lexicon of lower-case words; words it hasn't are unknown (x)."""
    def tag(query: str) -> list[tuple[str, str]]:
        return [(part, lexicon.get(part.lower(), "x")) for word in re.findall(f"[{HAN}]+|[^\\W{HAN}]+", query) for part in cutter(word)]

    return tag


def read_lexicon(lines: Iterable[str]) -> dict[str, str]:
    """A lexicon from lines of a word and its tag; lines of another form are left out, of two of a word the later counts."""
    pairs = (line.split() for line in lines)
    return {p[0].lower(): p[1] for p in pairs if len(p) == 2}


tag = tagger(LEXICON)


def or_terms(query: str, cutter: Cutter = cut) -> list[str]:
    """Words of over one byte that aren't stop words (as written), the first 256; repeats stay."""
    return [w for w in words(query, cutter=cutter) if len(w.encode()) > 1 and w not in STOP_WORDS][:MOST_TERMS]


def prefix_terms(query: str, cutter: Cutter = cut) -> list[str]:
    """Words of over one byte, all of which must begin a token."""
    return [w for w in words(query, cutter=cutter) if len(w.encode()) > 1]


def tagged_terms(query: str, tagger: Tagger = tag, cutter: Cutter = cut) -> tuple[list[str], list[str]]:
    """Nouns, and other words with a meaning, of two characters or more; a token of several words gives each."""
    nouns, others = [], []
    for token, pos in tagger(query):
        into = nouns if pos in NOUN_TAGS else others if pos in CONTENT_TAGS else None
        if into is not None:
            into += [w for w in words(token, cutter=cutter) if len(w) > 1]
    return nouns, others


def must_terms(query: str, tagger: Tagger = tag, cutter: Cutter = cut) -> tuple[list[str], list[str]]:
    """Words that all must be there, and words of which one must; together 256 at most, cut in proportion.

    Without any, the words of or_terms are the second list.
    """
    nouns, others = tagged_terms(query, tagger, cutter)
    if not nouns and not others:
        return [], or_terms(query, cutter)
    total = len(nouns) + len(others)
    if total > MOST_TERMS:
        keep = len(nouns) * MOST_TERMS // total
        nouns, others = nouns[:keep], others[: MOST_TERMS - keep]
    return nouns, others


def any_terms(query: str, tagger: Tagger = tag, cutter: Cutter = cut) -> list[str]:
    nouns, others = tagged_terms(query, tagger, cutter)
    return (nouns + others)[:MOST_TERMS] or or_terms(query, cutter)
