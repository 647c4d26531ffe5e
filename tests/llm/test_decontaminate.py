import hashlib
import re

import numpy as np
import pytest

from gleanery.llm.decontaminate import Shard, Words, decontaminate
from gleanery.llm.fm_index import FMIndex, suffix_order

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [(m[0], m.start(), m.end()) for m in WORD.finditer((text or "").translate(LOWER))]


def by_hand(texts, items, n):
    """Per text: words, hit words, items, spans in bytes, the text without them; every window against every place."""
    windows = []
    for item, text in items:
        w = [x for x, _, _ in words(text)]
        windows += [(item, w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    out = []
    for text in texts:
        found, own = words(text), [x for x, _, _ in words(text)]
        hit, named = set(), set()
        for item, window in windows:
            for i in range(len(own) - len(window) + 1):
                if own[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    named |= {item} - {None}
        runs = []
        for i in sorted(hit):
            runs = [*runs[:-1], (runs[-1][0], i)] if runs and runs[-1][1] == i - 1 else [*runs, (i, i)]
        spans = [(found[a][1], found[b][2]) for a, b in runs]
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + text[at:a], b
        out.append((len(own), len(hit), sorted(named), [(len(text[:a].encode()), len(text[:b].encode())) for a, b in spans], kept + (text or "")[at:]))
    return out


def texts():
    rng = np.random.default_rng(3)
    lexicon = ["a", "b", "Ab", "ñandú", "x1", "the", "İz", "ß", "7"]
    found = [" ".join(rng.choice(lexicon, rng.integers(0, 40))) for _ in range(60)]
    return [*found, found[0], found[0], None, "", "...", "a" * 5000, "the " * 700, "a-b\x00c_d\x7fe", "a b a b", "tail a", "b head"]


def items():
    rng = np.random.default_rng(4)
    own = texts()
    cut = [" ".join((own[i] or "").split()[3:12]) for i in range(12)]
    return [*[(f"{i}", t) for i, t in enumerate(cut)], ("9", "the the the the the"), ("10", "the"), ("10", "ñandú ß"), (None, "x1 x1"), ("e", ""), ("n", None), ("same", cut[1]), ("z", " ".join(rng.choice(["q", "r"], 30))), ("edge", "a b")]


@pytest.mark.parametrize("sizes", [(8 << 20, 200_000), (300, 7)])
def test_against_every_place(spark, sizes):
    own, test = texts(), items()
    docs = spark.createDataFrame([(i, t, "lang", 5) for i, t in enumerate(own)], "doc_id long, text string, lang string, n_hit int").repartition(3)
    benchmark = spark.createDataFrame(test, "item_id string, text string").repartition(2)
    got = decontaminate(docs, benchmark, 4, kept="kept", shard_bytes=sizes[0], block_rows=sizes[1]).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(len(own))) and got[0]["lang"] == "lang"
    for r, want in zip(got, by_hand(own, test, 4), strict=True):
        assert (r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]], r["kept"]) == want


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"], r["items"], r["spans"]) for r in decontaminate(docs, none).collect()] == [(2, 0, [], [])]
    assert decontaminate(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        decontaminate(docs, none, kept="text")


def test_digest_of_no_items(spark, sf_dir):
    from gleanery.llm.queries import op11_decontamination

    rows = op11_decontamination(spark, sf_dir).where("not contaminated").limit(1).collect()
    assert rows[0]["items_sha256"] == hashlib.sha256(b"").hexdigest() and rows[0]["n_items"] == 0


def test_suffixes_and_search():
    rng = np.random.default_rng(1)
    for symbols, n in ((2, 40), (3, 300), (200, 1000), (70_000, 500)):
        seq = rng.integers(1, symbols, n)
        whole = np.append(seq, 0)
        assert suffix_order(whole, symbols).tolist() == sorted(range(n + 1), key=lambda i: whole[i:].tolist())
        index = FMIndex(seq, symbols)
        patterns = np.stack([seq[i : i + 3] for i in rng.integers(0, n - 3, 20)])
        sizes = rng.integers(1, 4, 20)
        low, high = index.search(patterns, sizes)
        for p, s, a, b in zip(patterns, sizes, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n) if seq[i : i + s].tolist() == p[:s].tolist()]
    periodic = np.ones(3000, np.int64)
    assert suffix_order(np.append(periodic, 0), 2).tolist() == list(range(3000, -1, -1))


def test_words_keep_their_places():
    found = Words([b"", b"A-b", "é".encode(), b"..."])
    assert [found.names[i].as_py() for i in found.ids.tolist()] == [b"a", b"b", "é".encode()]
    assert found.first.tolist() == [0, 0, 2, 3, 3]
    assert (found.start - found.text[np.searchsorted(found.text, found.start, "right") - 1]).tolist() == [0, 2, 0]
    assert Shard([b""]).found.first.tolist() == [0, 0]
