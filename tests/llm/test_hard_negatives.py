import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import hard_negatives
from gleanery.llm.hard_negatives import Bucket, _units, mine, search


def by_hand(rows, every=5, positives=5, negatives=3, band=(50, 95), scale=256):
    """All anchors against all rows; rows: (vec_id, label, embedding)."""
    own = []
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            own.append((i, label, tuple(int(np.floor(c * scale)) for c in x)))
    out = []
    for i, label, v in sorted({r for r in own if r[0] % every == 0}):
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, m) for j, m, w in own if j != i]
        near = sorted(((s, j) for s, j, m in scored if m == label), key=lambda x: (-x[0], x[1]))[:positives]
        for p, j in near:
            far = sorted(((s, k) for s, k, m in scored if m != label and band[0] * p <= 100 * s <= band[1] * p), key=lambda x: (-x[0], x[1]))[:negatives]
            out += [(i, j, rank + 1, k, p, s) for rank, (s, k) in enumerate(far)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("score", F.lit("clash")).repartition(3)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize(("spread", "small"), [(1.0, False), (0.05, True), (0.4, True)])
def test_against_all_pairs(spark, spread, small, monkeypatch):
    """Loose and tight clusters, ties, zero and opposite vectors, lengths over three orders; narrow and wide ranges."""
    if small:
        for name, value in (("BUCKET_ROWS", 40), ("BLOCK_ROWS", 7), ("GROUP", 2)):
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(int(spread * 100))
    centre = rng.normal(size=(4, 12))
    rows = []
    for i in range(240):
        x = (centre[i % 4] + spread * rng.normal(size=12)) * 10.0 ** rng.integers(-2, 1)
        rows.append((i, int(rng.integers(0, 3)), x.tolist()))
    rows += [(300 + i, 1, rows[10][2]) for i in range(12)] + [(330 + i, 2, (-np.array(rows[10][2])).tolist()) for i in range(3)]
    rows += [(340, 0, [0.0] * 12), (345, 1, []), (350, 0, [1.5] * 3), (355, None, [1.0] * 12), (360, 1, None), (365, 1, [1.0] * 11 + [None]), (370, 1, [float("nan")] + [1.0] * 11), (375, 1, [float("inf")] * 12), (None, 1, [1.0] * 12)]
    rows += [rows[20], rows[20]]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in mine(table(spark, rows), "vec_id % 5 = 0").collect())
    want = by_hand(rows)
    # rows[20] stands three times: once as an anchor
    assert got == want


def test_empty_and_too_large(spark):
    assert mine(table(spark, [(1, None, [1.0])])).collect() == []
    assert mine(table(spark, [(50, 1, [1.0])])).collect() == []
    with pytest.raises(ValueError):
        mine(table(spark, [(50, 1, [1e30])]))


def test_pruning_leaves_pairs_out():
    """Tight clusters: most pairs are left out, and the partners are those of the full comparison."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(20, 16))
    v = np.round(100 * (centre[np.arange(2000) % 20] + 0.05 * rng.normal(size=(2000, 16)))).astype(np.int64)
    ids, labels = np.arange(2000), np.arange(2000) % 20
    length = _units(v)[1]
    buckets = [Bucket({"ids": ids[o], "labels": labels[o], "v": v[o], "order": np.argsort(_units(v[o])[0].T, axis=1, kind="stable").astype(np.uint16)}) for o in np.array_split(np.argsort(-length), 10)]
    a = np.arange(0, 2000, 50)
    unit, other, score, seen = search(iter(buckets), v[a], ids[a], labels[a], np.arange(len(a)), np.full(len(a), -np.inf), np.full(len(a), np.inf), 5, True)
    full = v[a] @ v.T
    for k, i in enumerate(a.tolist()):
        same = [j for j in range(2000) if labels[j] == labels[i] and j != i]
        want = sorted(same, key=lambda j: (-full[k, j], j))[:5]
        assert other[unit == k].tolist() == want and score[unit == k].tolist() == full[k, want].tolist()
    assert seen["candidates"] < 0.1 * seen["pairs"]
