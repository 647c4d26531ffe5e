import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gleanery.llm import alignment
from gleanery.llm.alignment import align, byte_letters
from gleanery.llm.queries import op13_alignment
from gleanery.llm.sentencepiece_codec import load

ODD = ["", None, " ", "a", "  a  b   ", "\n\n x", "你好 世界", "a\tb\r\n", "x\xa0 y", "emoji 😀😀 é", "x" * 700, "    def f(x):\n        return x**2 + 1\n", "\x00\x01", "it's I'll a 's", "<|endoftext|> a<|endoftext|>", "a \nb\n c", "<s> </s> <unk> <0x41>", "spelt ▁ otherwise", "▁", "----====", "qzjxkvQ" * 90 + " end", "héllo,wörld" * 60, "a", "a"]


@pytest.fixture(scope="module")
def definition():
    return open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


@pytest.fixture(scope="module")
def model():
    return load(public_tokenizers.path("piece_bpe_32k.model"))


def by_hand(texts):
    """Per text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups; by the libraries, token by token."""
    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    letters = byte_letters()
    found = []
    for text in texts:
        want = (" " + text).encode() if text else b""
        x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(want.decode(), add_special_tokens=False).ids]
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text or "") for p in [b.id_to_piece(i)]]
        if not text or b"".join(t for _, t in x) != want or b"".join(t for _, t in y) != want:
            found.append(([], [], []))
            continue
        spans = []
        for side in (x, y):
            at, own = 0, []
            for i, t in side:
                own.append((i, at, at + len(t)))
                at += len(t)
            spans.append(own)
        links = []
        j = 0
        for i, s, e in spans[0]:
            while spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < e:
                links.append((i, spans[1][k][0]))
                k += 1
        groups, both = [], sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        start = 0
        for end in both:
            groups.append("|".join(",".join(str(i) for i, s, _ in own if start <= s < end) for own in spans))
            start = end
        found.append((spans, links, groups))
    counts = Counter(pair for _, links, _ in found for pair in links)
    best = {}
    for (_, i), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [(len(s[0]) if s else 0, len(s[1]) if s else 0, len(g), len(n), sum(counts[p] == best[p[1]] for p in n), sum(counts[p] for p in n), ";".join(g)) for s, n, g in found]


def test_against_the_libraries(spark, sf_dir, definition, model, monkeypatch):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    want = by_hand(texts)
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_a int").repartition(5)
    got = align(docs, definition, model).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(len(texts))) and {r["lang"] for r in got} == {"x"}
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert [tuple(r[c] for c in columns) for r in got] == want
    # more shards, smaller batches and a taller tree give the same
    for name, value in (("SHARD_PAIRS", 50), ("FAN", 2), ("IDS_BYTES", 500), ("TEXT_BYTES", 3000), ("PENDING", 10)):
        monkeypatch.setattr(alignment, name, value)
    got = align(docs.repartition(7), definition, model, digest=True).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in columns[:-1]) for r in got] == [w[:-1] for w in want]
    assert [r["groups_sha256"] for r in got] == [hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want]


def test_empty_table(spark, definition, model):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align(docs, definition, model).collect() == []
    nulls = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    assert [tuple(r) for r in align(nulls, definition, model).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")] * 2


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = by_hand([r["text"] for r in docs])
    got = {r["doc_id"]: r for r in op13_alignment(spark, sf_dir).collect()}
    assert [(*[got[r["doc_id"]][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], got[r["doc_id"]]["groups_sha256"]) for r in docs] == [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want]
