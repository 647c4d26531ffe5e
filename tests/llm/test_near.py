import itertools
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleanery.llm.components import components
from gleanery.llm.simhash import _links, fingerprints, keep_one_of_each, shingle_hashes, simhash_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, k):
    w = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    label = list(range(n))
    for a, b in linked:
        x, y = sorted((label[a], label[b]))
        label = [x if c == y else c for c in label]
    return label


def texts():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 200)) for _ in range(12)]
    near = []
    for t in base[:6]:
        for _ in range(4):
            w = t.split()
            for at in rng.integers(0, len(w), rng.integers(1, 6)):
                w[at] = str(rng.choice(words))
            near.append(" ".join(w))
    return base + near + [base[0]] * 9 + ["", "", " \n", "one two", "ONE two", "a\x0bb c", "É é"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", 3) for i, t in rows], "doc_id long, text string, fingerprint string, key int").repartition(5)


def test_fingerprints():
    for k in (1, 3, 5):
        assert fingerprints([t.encode() for t in texts()], k).tolist() == [brute_fingerprint(t, k) for t in texts()]
    long = "x y z " * 70_000
    assert fingerprints([long.encode()], 3)[0] == brute_fingerprint(long, 3)


@pytest.mark.parametrize("limit", [0, 3, 7])
def test_components_of_fingerprints(spark, limit):
    all_texts = texts()
    ids = [(i * 37) % 1009 for i in range(len(all_texts))]
    fps = [brute_fingerprint(t, 3) for t in all_texts]
    label = classes(len(ids), [(a, b) for a, b in itertools.combinations(range(len(ids)), 2) if bin(fps[a] ^ fps[b]).count("1") <= limit])
    want = {ids[i]: min(ids[j] for j in range(len(ids)) if label[j] == label[i]) for i in range(len(ids))}
    rows = [*zip(ids, all_texts, strict=True), (None, all_texts[0])]
    got = simhash_components(frame(spark, rows), 3, limit).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want and len(got) == len(rows)


def test_nulls_and_nothing(spark):
    got = {r["doc_id"]: r["component_id"] for r in simhash_components(frame(spark, [(9, None), (4, ""), (7, "some words are here")])).collect()}
    assert got == {9: 4, 4: 4, 7: 7}
    assert simhash_components(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_links_tie_groups(seed):
    rng = np.random.default_rng(seed)
    key = np.sort(rng.integers(0, 6, 150))
    centres = rng.integers(0, 2**63, 9).astype(np.uint64)
    fp = centres[rng.integers(0, 9, 150)] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    near = [(a, b) for a, b in itertools.combinations(range(150), 2) if key[a] == key[b] and bin(int(fp[a] ^ fp[b])).count("1") <= 3]
    found = _links(key, fp, 3)
    assert {tuple(sorted(p)) for p in found.tolist()} <= set(near)
    assert classes(150, found.tolist()) == classes(150, near)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(300, 300), (400, 401), (401, 400), (500, None)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {i: 200 for i in range(201, 260)} | {401: 400}


def test_one_of_each_group_stays(spark):
    all_texts = texts()
    rows = [(i, t) for i, t in enumerate(all_texts)] + [(None, "only text without an id here"), (77, "same row"), (77, "same row")]
    sets = [frozenset(shingle_hashes((t or "").encode(), 5)) for _, t in rows]
    alike = lambda a, b: (len(a & b) / len(a | b)) if a | b else 1.0
    sure = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if alike(sets[a], sets[b]) >= 0.8]
    maybe = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if alike(sets[a], sets[b]) >= 0.65]
    docs = frame(spark, rows)
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 77 in ids
    place = [i for i, (d, _) in enumerate(rows) if d in ids]
    assert not [(a, b) for a, b in sure if a in place and b in place and rows[a] != rows[b]]
    loose = classes(len(rows), maybe)
    assert {rows[i][0] for i in range(len(rows)) if loose.count(loose[i]) == 1} <= set(ids)
    assert keep_one_of_each(docs.limit(0)).count() == 0


def test_rows_of_one_id_and_clashing_names(spark):
    rows = [(i, f"{words_of(np.random.default_rng(i), 30)}", "c", {"m": 1}) for i in range(5)] + [(2, words_of(np.random.default_rng(2), 30), "d", None), (3, None, None, None), (3, "", None, None), (None, None, None, None), (4, words_of(np.random.default_rng(4), 30), "c", {"m": 1})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, u1 string, K1 map<string,int>")
    runs = [sorted(map(repr, keep_one_of_each(docs.repartition(n)).collect())) for n in (1, 4, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 6
    assert keep_one_of_each(docs).columns == docs.columns


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    """Groups far over the bound give what they give whole; a task gets two blocks of one."""
    from gleanery.llm import simhash

    rng = np.random.default_rng(4)
    passage = words_of(rng, 120)
    # a passage that all share, so bands meet; half of them have a partner that is near
    rows = [(i, f"{passage} {words_of(np.random.default_rng(i // 2 + 10), 60)} {'' if i % 4 == 1 else f'tail{i}'}") for i in range(120)]
    docs = frame(spark, rows)
    whole = [sorted(map(repr, x.collect())) for x in (keep_one_of_each(docs), simhash_components(docs, 3, 7))]
    monkeypatch.setattr(simhash, "GROUP_ROWS", 8)
    assert [sorted(map(repr, x.collect())) for x in (keep_one_of_each(docs), simhash_components(docs, 3, 7))] == whole
    assert 60 <= len(whole[0]) < 120
    one = spark.range(200).select(F.col("id").alias("node"), F.lit(5).cast("long").alias("key"))
    cut = simhash._bounded(one, "node")
    assert cut.groupBy("key").count().agg(F.max("count")).first()[0] < 40
    pairs = cut.alias("a").join(cut.alias("b"), "key").select("a.node", F.col("b.node").alias("other")).distinct()
    assert pairs.count() == 200 * 200


def words_of(rng, n):
    return " ".join(f"v{i}" for i in rng.integers(0, 10**6, n))


def test_repeated_passages(spark):
    rng = np.random.default_rng(8)
    body, passage = words_of(rng, 300), words_of(rng, 24)
    # one set of shingles (a passage with itself behind it adds the same ones again)
    once, often = f"{body} {passage} {passage}", f"{body} {' '.join([passage] * 41)}"
    # sets that share only the shingle of a filler word
    filled = [f"{words_of(rng, 200)} {'filler ' * 400}" for _ in range(2)]
    sets = [frozenset(shingle_hashes(t.encode(), 5)) for t in (once, often, *filled)]
    assert sets[0] == sets[1] and len(sets[2] & sets[3]) == 1
    kept = keep_one_of_each(frame(spark, [*enumerate((once, often, *filled))]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]


def test_similarity_decides(spark):
    """Just at, over and under the similarity, in sets of 4 to 400 shingles: what brute force keeps."""
    rng = np.random.default_rng(9)
    rows, pairs = [], []
    for size in [8, 12, 40, 400] * 20:
        words = words_of(rng, size).split()
        # sets of n and n - cut shingles, all of the second in the first
        n = size - 4
        for cut in {n // 5, n // 5 + 1}:
            first = [f"{w}x{len(rows)}" for w in words]
            pairs.append((len(rows), (n - cut) / n >= 0.8))
            rows += [" ".join(first), " ".join(first[: size - cut])]
        # as many new words at the end as leave 0.8, and one more
        for new in {n // 9, n // 9 + 1}:
            first = [f"{w}y{len(rows)}" for w in words]
            pairs.append((len(rows), (n - new) / (n + new) >= 0.8))
            rows += [" ".join(first), " ".join(first[: size - new] + [f"new{len(rows)}n{i}" for i in range(new)])]
    sets = [frozenset(shingle_hashes(t.encode(), 5)) for t in rows]
    assert all((len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8) == linked for i, linked in pairs)
    want = {i for i, _ in pairs} | {i + 1 for i, linked in pairs if not linked}
    assert {r["doc_id"] for r in keep_one_of_each(frame(spark, [*enumerate(rows)])).collect()} == want


def test_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the very same text in a third of all rows").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" is alone with words of its own "), (F.col("id") * 7919).cast("string"))).alias("text"))
    got = simhash_components(docs)
    assert got.where("doc_id % 3 = 0 and component_id <> 0").count() == 0
