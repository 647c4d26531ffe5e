import hashlib
import math
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from gleanery.llm.fingerprints import HASHES, SHIFTS, as_text, combine, edit_likeness, likeness, vectors

TEXTS = ["one line of words here\nand a second line\nthird", "and a second line\none line of words here\nthird", "", None, "x" * 40_000, "naïve é\r\n", "same text\nof two", "same text\nof two", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "c", 7) for i, t in enumerate(TEXTS)] + [(None, "no id", "c", 7), (50, "twice", "c", 7), (50, "twice", "c", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, vector string, side int").repartition(4).cache()


def test_order_does_not_matter_and_edits_are_sums(spark):
    rows = [(1, "a b c d\nsecond one"), (2, "second one\na b c d"), (3, "a b c d"), (4, "second one"), (5, "a b c e\nsecond one")]
    v = vectors(spark.createDataFrame(rows, "k long, text string"), ["k"])
    got = {r["k"]: r["vector"] for r in v.collect()}
    assert got[1] == got[2] != got[5]
    both = v.alias("a").join(v.alias("b"), F.col("a.k") != F.col("b.k")).select(F.col("a.k").alias("i"), F.col("b.k").alias("j"), combine(F.col("a.vector"), F.col("b.vector")).alias("plus"), combine(F.col("a.vector"), F.col("b.vector"), True).alias("minus"))
    found = {(r["i"], r["j"]): r for r in both.collect()}
    assert found[3, 4]["plus"][1:] == got[1][1:] and found[1, 4]["minus"][1:] == got[3][1:]


def test_edits(docs):
    got = edit_likeness(docs, rows_per_range=2).collect()
    order = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(order)
    by = {r["doc_id"]: r for r in got}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        n = len(t) // 3
        want = t[: len(t) - n] + nxt[:n]
        assert (i, hashlib.sha256(want.encode()).hexdigest()) in {(r["doc_id"], r["edited_sha256"]) for r in got}, (i, t[:20])
        assert by[i]["n_chars"] == len(t) and 0 <= by[i]["near_edited"] <= 1 and 0 <= by[i]["near_next"] <= 1
    assert by[18]["fingerprint"] == by[21]["fingerprint"] and by[21]["near_next"] == 1.0
    assert by[6]["fingerprint"] == by[9]["fingerprint"] and by[6]["near_edited"] == 1.0
    assert by[0]["fingerprint"] == by[3]["fingerprint"]
    assert by[24]["near_edited"] > 0.5 > by[24]["near_next"]


def test_one_and_none(docs):
    one = edit_likeness(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert edit_likeness(docs.limit(0)).count() == 0


def test_likeness_follows_the_share(spark):
    words = [f"w{i}" for i in range(900)]
    rows = [(k, " ".join(words[:keep] + [f"z{k}{i}" for i in range(900 - keep)])) for k, keep in enumerate((900, 600, 300, 0))]
    v = vectors(spark.createDataFrame(rows, "k long, text string"), ["k"])
    first = v.where("k = 0").select(F.col("vector").alias("first"))
    got = [r["x"] for r in v.join(first).orderBy("k").select(likeness(F.col("first"), F.col("vector")).alias("x")).collect()]
    assert got[0] == 1.0 and 0.45 < got[1] < 0.85 and got[2] < got[1] and got[3] < 0.3


def naive_vector(text):
    """The number of elements and the 248 lanes of a text, by the rule."""
    tile, found = re.compile(r"[^ \t\n\v\f\r]+(?:[ \t\n\v\f\r]+[^ \t\n\v\f\r]+){0,2}"), []
    for paragraph in text.split("\n"):
        found += [*tile.findall(paragraph), paragraph + "\n"]
    lanes = [[0, 0] for _ in range(HASHES * SHIFTS)]
    for x in found:
        for k in range(HASHES):
            h = xxhash.xxh64_intdigest(x.encode(), xxhash.xxh64_intdigest(struct.pack("<i", k), 42))
            for s in range(SHIFTS):
                lanes[k * SHIFTS + s][0] += h >> s & 1
                lanes[k * SHIFTS + s][1] += h >> (s + 31) & 1
    return len(found), lanes


def test_vectors_and_likeness_by_brute_force(spark):
    texts = [*[t or "" for t in TEXTS[:4]], "naïve é\r\n", "one line of words here\nand a second line\nfourth", "a b c d e f g\n\n\na b c"]
    v = vectors(spark.createDataFrame([*enumerate(texts)], "k int, text string"), ["k"])
    got = {r["k"]: (r["vector"], r["t"]) for r in v.select("k", "vector", as_text(F.col("vector")).alias("t")).collect()}
    naive = [naive_vector(t) for t in texts]
    for k, (n, lanes) in enumerate(naive):
        assert got[k][0] == [n, *[low + (high << 31) for low, high in lanes]]
        assert got[k][1] == "".join(f"{high % 65536:04x}{low % 65536:04x}" for low, high in [(n, 0), *lanes])
    pairs = v.alias("a").crossJoin(v.alias("b")).select(F.col("a.k").alias("i"), F.col("b.k").alias("j"), likeness(F.col("a.vector"), F.col("b.vector")).alias("x"))
    for r in pairs.collect():
        x, y = ([2 * z - n for pair in lanes for z in pair] for n, lanes in (naive[r["i"]], naive[r["j"]]))
        norm = math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
        want = 1.0 if naive[r["i"]] == naive[r["j"]] else max(0.0, min(1.0, sum(a * b for a, b in zip(x, y, strict=True)) / norm)) if norm else 0.0
        assert abs(r["x"] - want) < 1e-9


@pytest.mark.parametrize("per_range", [1, 5, 1000])
def test_hot_ids_are_split(spark, per_range):
    """A third of the rows has no id, a third one and the same; each row follows the one that it should."""
    from gleanery.llm.fingerprints import _ranges

    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i} " * 9) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tied = docs.withColumn("tie", F.xxhash64("text"))
    order = [r["text"] for r in tied.orderBy(F.col("doc_id").desc_nulls_last(), "tie").collect()]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for t, n in zip(order, order[1:] + order[:1], strict=True))
    assert sorted(r["edited_sha256"] for r in edit_likeness(docs, per_range).collect()) == want
    ranges = _ranges(tied.select("doc_id", "tie"), per_range).withColumnRenamed("bucket", "r")
    place = [r["r"] for r in ranges.orderBy(F.col("doc_id").desc_nulls_last(), "tie").collect()]
    assert place == sorted(place, reverse=True)
    if per_range == 5:
        assert ranges.groupBy("r").count().agg(F.max("count")).first()[0] < 40
