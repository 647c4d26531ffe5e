import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm.line_dedup import drop_common_lines, line_key
from gleanery.llm.perfect_hash import build, from_bytes, probe, to_bytes
from gleanery.llm.quality import CHUNK, EMBED, STRIDE, WIDTH, fit, held_out, score, score_documents, train


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
    lo[: n // 2] = 7  # equal halves, told apart by the other
    table = from_bytes(to_bytes(**build(hi, lo)))
    assert sorted(probe(table, hi, lo).tolist()) == list(range(n))
    other = rng.integers(0, 2**63, (2, 1000)).astype(np.uint64)
    assert ((probe(table, *other) < n) & (probe(table, *other) >= -1)).all()


def test_equal_keys_are_refused():
    with pytest.raises(ValueError):
        build(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))


def lines_fixture():
    common, rare = "  Shared LINE\t", "only here"
    rows = [(i, f"{common}\nown {i}\n\nshared line\n{'Été' if i < 11 else 'x'}") for i in range(12)]
    rows += [(100, None), (101, ""), (102, "SHARED LINE"), (103, rare), (104, "\n\n"), (None, "shared line\nno id"), (105, "a\r\nb"), (105, "a\r\nb"), (106, ("long line " * 9 + "\n") * 3000 + "end")]
    return rows + [(200 + i, "été\nÉtÉ") for i in range(9)]


def test_lines(spark):
    rows = lines_fixture()
    docs = spark.createDataFrame([(*r, "a", 5, "b") for r in rows], "doc_id long, text string, n_lines string, docs int, shard string").repartition(5)
    got = drop_common_lines(docs, min_docs=10).collect()
    counts = collections.Counter(k for _, t in rows for k in {line_key(x) for x in (t or "").encode().split(b"\n")})
    want = []
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        kept = [x for x in lines if not line_key(x) or counts[line_key(x)] < 10]
        want.append((str(i), b"\n".join(kept).decode(), len(lines), len(lines) - len(kept)))
    assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in got) == sorted(want)
    assert set(got[0].asDict()) == {"doc_id", "text", "n_lines", "n_dropped", "docs", "shard"}
    # non-ASCII capitals differ from small letters
    assert counts["Été".encode()] == 11 and counts["été".encode()] == 9
    assert drop_common_lines(docs.limit(0)).count() == 0
    assert drop_common_lines(docs, min_docs=2, min_chars=12).where("n_dropped > 0").count() == 0
    assert drop_common_lines(docs, min_docs=2, min_chars=11).where("n_dropped > 0").count() == 14


def test_many_shards(spark, monkeypatch):
    """More shards than are held: every count is right, and each call reads only those that aren't held."""
    from gleanery.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SHARD_LINES", 100)
    rows = [(i, "\n".join(f"line {j}" for j in range(i, i + 200))) for i in range(0, 4000, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = line_dedup.Index(line_dedup.build_index(docs))
    assert index.n > 16
    size = sum(x.nbytes for x in index.shard(0).values())
    monkeypatch.setattr(line_dedup, "HELD_BYTES", 10 * size)
    keys = [f"line {j}".encode() for j in range(5000)] * 2
    hi, lo = line_dedup._hashes(keys)
    want = [sum(k in r[1].encode().split(b"\n") for r in rows) for k in keys[:5000]] * 2
    want = [n if n >= 2 else 0 for n in want]
    reads = []
    for _ in range(4):
        before = index.reads
        assert index.counts(hi, lo).tolist() == want
        reads.append(index.reads - before)
    assert max(reads[1:]) <= index.n - 8
    got = drop_common_lines(docs, min_docs=2)
    assert got.where("n_dropped = 200").count() == len(rows) - 2 and got.where("n_dropped = 100").count() == 2


def samples(n, seed):
    rng = np.random.default_rng(seed)
    words = ["the", "river", "stone", "walks", "under", "quiet", "light"]
    good = [" ".join(rng.choice(words, rng.integers(5, 80))) + "." for _ in range(n)]
    bad = [" ".join(w + "!!$$" if rng.random() < 0.5 else w for w in rng.choice(words, rng.integers(5, 80))) for _ in range(n)]
    return good + bad, np.array([1] * n + [0] * n, np.float32)


def test_classifier_learns():
    model = fit([t.encode() for t in samples(150, 1)[0]], samples(150, 1)[1])
    texts, labels = samples(100, 2)
    p = score(model, [t.encode() for t in texts])
    assert ((p >= 0.5) == labels).mean() > 0.97
    # the whole text counts: noise at the very end of a long clean one is seen
    assert score(model, [("river stone " * 20_000 + "!!$$ " * 400).encode()])[0] < score(model, [("river stone " * 20_000).encode()])[0]


def naive_score(model, text):
    """The network of one text, window by window and filter by filter."""
    filters = len(model["bias"])
    windows = max(0, -(-(len(text) - WIDTH) // STRIDE)) + 1
    data = text + b"\0" * ((windows - 1) * STRIDE + WIDTH - len(text))
    pooled = []
    for f in range(filters):
        answers = []
        for w in range(windows):
            total = float(model["bias"][f])
            for o in range(WIDTH):
                for e in range(EMBED):
                    total += float(model["embed"][data[w * STRIDE + o]][e]) * float(model["filter"][o * EMBED + e][f])
            answers.append(total)
        pooled.append([max(0.0, *answers[c : c + CHUNK]) for c in range(0, windows, CHUNK)])
    inputs = [sum(p) / len(p) for p in pooled] + [max(p) for p in pooled]
    return 1 / (1 + math.exp(-sum(x * float(w) for x, w in zip(inputs, model["out"], strict=True)) - float(model["out_bias"][0])))


def test_scores_are_those_of_the_naive_network():
    model = fit([t.encode() for t in samples(40, 1)[0]], samples(40, 1)[1])
    texts = [b"", b"a", b"abcdef", b"abcdefg", "é ü 你".encode(), b"river stone walks " * 30, b"!!$$ " * 60]
    assert np.allclose(score(model, texts), [naive_score(model, t) for t in texts], atol=1e-5)


def test_long_and_conflicting_labels(spark):
    """Long texts are learnt from by a window of them; of two labels of a document the larger counts."""
    from gleanery.llm import quality

    good, bad = "river stone walks under " * 5000, "rive!!$$ ston!!$$ " * 5000
    docs = spark.createDataFrame([(i, good if i % 2 else bad) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (3, 0)], "doc_id long, quality int")
    sample = quality.sample_texts(docs, labels)
    assert {len(t) for t, _ in sample} == {quality.SAMPLE_CHARS} and all(q == ("!" not in t) for t, q in sample)
    model = train(docs, labels)
    assert (score(model, [good.encode(), bad.encode()]) >= 0.5).tolist() == [True, False]


def test_scores_of_odd_rows(spark):
    texts, labels = samples(60, 3)
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    given = spark.createDataFrame([(i, int(q)) for i, q in enumerate(labels)] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = train(docs, given)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "é"), (None, "x" * 300_000), (4, "a"), (4, "a")], "doc_id long, text string")
    got = score_documents(odd, model).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert score_documents(docs.limit(0), model).count() == 0
    assert (score(train(docs, given.limit(0)), [b"any"]) == 0.5).all()
    assert train(docs.repartition(3), given)["out"].tolist() == model["out"].tolist()
    assert docs.where(held_out(F.col("doc_id"))).count() in range(20, 60)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id")))
    right = scored.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95
