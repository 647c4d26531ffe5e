"""Stems against SQLite's tokenizer, segmentation against all ways through the word graph."""

import itertools
import math
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from gleanery.functions import stem, words
from gleanery.functions.segment import UNIT, Segmenter
from gleanery.operators import lexical

SAMPLES = (
    "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational "
    "valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti "
    "triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption "
    "homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll running runs ran geology archaeology yes say syzygy y yy yyy ies ied ing sses s ss eed aed bing"
).split()


def test_stems_are_those_of_the_full_text_index(spark):
    texts = [r["text"] or "" for name in ("documents", "conversations") for r in spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").select("text").collect()]
    found = sorted({w for t in texts for w in re.findall(r"[^\W_]+", t.lower())} | set(SAMPLES))
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(found))
    want = dict(con.execute("SELECT doc, term FROM v"))
    assert len(found) > 10_000
    assert [w for i, w in enumerate(found) if stem.stem(words.fold(w).lower()) != want[i]] == []


def test_running_is_found_by_run(spark):
    corpus = spark.createDataFrame([(1, "She was running late"), (2, "a run of bad luck"), (3, "runner up"), (4, None)], "doc_id long, text string")
    found = lexical.search(corpus, "runs", 9, strategy="or", analyse=stem.stemmed_tokens, cutter=stem.cutter(words.cut))
    assert {r["doc_id"] for r in found.collect()} == {1, 2}


LEXICON = {"中国": (50, "ns"), "中": (30, "f"), "国人": (8, "n"), "人民": (40, "n"), "人": (60, "n"), "民": (5, "n"), "银行": (20, "n"), "中国人民": (3, "n"), "中国人民银行": (9, "nt"), "行长": (7, "n"), "长": (25, "a")}


def every_way(run, lexicon):
    """The best of all cuts of a run; of equal ones that with the longer first words."""
    total = sum(n for n, _ in lexicon.values())
    weight = lambda w: round(UNIT * math.log(lexicon.get(w, (1, ""))[0] / total))
    best = None
    for bits in itertools.product((0, 1), repeat=len(run) - 1):
        cuts = [0, *(i + 1 for i, b in enumerate(bits) if b), len(run)]
        parts = [run[a:b] for a, b in itertools.pairwise(cuts)]
        if all(len(p) == 1 or p in lexicon for p in parts):
            value = (sum(map(weight, parts)), [len(p) for p in parts])
            best = max(best, (value, parts)) if best else (value, parts)
    return best[1]


@pytest.mark.parametrize("run", ["中国人民银行行长", "人民中国", "中国人", "国人民", "长长", "龙", "中", "银行长", "中国人民银行中国人民"])
def test_the_best_way(run):
    assert Segmenter(LEXICON).cut([run, "人", run]) == [every_way(run, LEXICON), ["人"], every_way(run, LEXICON)]


def test_segmentation_on_both_sides(spark):
    lexicon = spark.createDataFrame([(w, n, t) for w, (n, t) in LEXICON.items()] + [("中国", 4, "a"), (None, 9, "n"), ("x", 0, "n")], "word string, count long, tag string")
    s = Segmenter.of(lexicon)
    assert s.lexicon == LEXICON and s.cut([]) == [] and Segmenter({}).cut(["中国"]) == [["中", "国"]]
    corpus = spark.createDataFrame([(1, "中国人民银行的行长 said Hello"), (2, "人民abc中国"), (3, "银 行"), (4, ""), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ts"] for r in corpus.select("doc_id", s.analyse(F.col("text")).alias("ts")).collect()}
    assert got == {1: ["中国人民银行", "的", "行长", "said", "hello"], 2: ["人民", "abc", "中国"], 3: ["银", "行"], 4: [], 5: []}
    finer = {r["doc_id"]: r["ts"] for r in corpus.select("doc_id", s.analyse_finer(F.col("text")).alias("ts")).collect()}
    assert finer[1][:6] == ["中国", "国人", "人民", "银行", "中国人民银行", "的"]
    found = lambda q, analyse=s.analyse: {r["doc_id"] for r in lexical.search(corpus, q, 9, analyse=analyse, cutter=s.cutter, tagger=s.tagger).collect()}
    assert found("中国人民银行") == {1} and found("人民") == {2} and found("人民", s.analyse_finer) == {1, 2} and found("hello") == {1}
    assert s.tagger("中国 the 龙") == [("中国", "ns"), ("the", "det"), ("龙", "x")]
    assert found("人民", s.analyse) == {2} and lexical.search(corpus, "银行行长", 9, strategy="pos-must", analyse=s.analyse, cutter=s.cutter, tagger=s.tagger).count() == 0
