import hashlib
import math
import statistics
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.llm.media import cosine_hash, decode_png, decode_pngs, encode_png, encode_pngs, payload, text_media
from gleanery.llm.suffix_dedup import cut_repeats, merge, pack, transform, unpack, window_minima, window_runs


def brute(rows, size):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        d, t = rows[i][0], (rows[i][1] or "").encode()
        for p in range(len(t) - size + 1):
            seen.setdefault(t[p : p + size], 10**18 if d is None else d)
    for d, t in rows:
        data, me = (t or "").encode(), 10**18 if d is None else d
        gone = bytearray(len(data))
        for p in range(len(data) - size + 1):
            if seen[data[p : p + size]] < me:
                gone[p : p + size] = b"\1" * size
        spans = sum(1 for p in range(len(data)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((d, len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone, strict=True) if not g)))
    return out


def texts(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcde é"), n))
    shared = [word(int(n)) for n in rng.integers(20, 140, 8)]
    out = [word(int(rng.integers(0, 200))) + "".join(str(rng.choice(shared)) + word(int(rng.integers(0, 60))) for _ in range(rng.integers(0, 4))) for _ in range(60)]
    return out + ["", "aaaa" * 100, "a" * 350, "ab" * 200, out[3], out[3], out[7] + out[3], "x" * 49, "y" * 50, "y" * 50, "z" * 51]


@pytest.mark.parametrize(("seed", "size", "hot"), [(1, 50, None), (2, 50, 1), (3, 20, None), (4, 16, 3), (5, 50, 4)])
def test_repeats(spark, monkeypatch, seed, size, hot):
    from gleanery.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot or suffix_dedup.HOT_RUNS)
    rng = np.random.default_rng(seed)
    all_texts = texts(seed)
    ids = [int(x) for x in rng.permutation(3 * len(all_texts))[: len(all_texts)]]
    rows = [*zip(ids, all_texts, strict=True), (None, all_texts[0]), (None, "a" * 60), (ids[0], all_texts[5]), (ids[0], all_texts[0]), (900, None)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, uid string, bin int").repartition(6)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in cut_repeats(docs, size).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, size)))


def test_a_passage_in_every_row(spark):
    """What a bucket gets for a passage doesn't grow with the documents that have it."""
    from gleanery.llm.suffix_dedup import _send_runs, unpack

    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abcdefgh "), 400))
    sent = []
    for n in (20, 200):
        docs = pa.table({"doc_id": np.arange(n), "ordered": np.arange(n), "text": [passage] * n, "bin": np.zeros(n, np.int32)})
        h = window_runs([passage.encode()])[3]
        short = np.unique(h >> np.uint64(64 - 32)).astype(np.uint32)
        replies = pa.table({"blob": pa.array([pack(bucket=np.zeros(1, np.int32), h=np.diff(short, prepend=np.uint32(0)), hot=np.zeros(len(short) // 8 + 1, np.uint8))], pa.binary())})
        blobs = [unpack(b) for b in _send_runs(1, 1, 50)(docs, replies).column("blob").to_pylist()]
        assert {x for b in blobs for x in b["least"].tolist()} == {0} and {x for b in blobs for x in b["most"].tolist()} == {n - 1}
        sent.append(sum(len(b["size"]) for b in blobs))
    assert sent[0] == sent[1] == len(set(h.tolist()))


def test_a_short_string_in_many_surroundings(spark, monkeypatch):
    """The windows around it are dealt over the buckets, and the rare repeats among them are found."""
    from gleanery.llm import suffix_dedup

    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    rows = [(i, f"{word(60)} all rights reserved by us and all of ours {word(60)}") for i in range(300)]
    rows += [(1000 + i, f"{word(20)}{rows[i * 7][1][40:110]}{word(30)}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sizes = []
    for hot in (65_536, 50):
        monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in cut_repeats(docs).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, 50)))
        base = docs.select("doc_id", F.col("doc_id").alias("ordered"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(4)).cast("int").alias("bin"))
        sent = base.select("bin", "text").mapInArrow(suffix_dedup._send_hashes(16, 4, 50), "bucket int, blob binary")
        replies = sent.repartition(4, "bucket").sortWithinPartitions("bucket").mapInArrow(suffix_dedup._reply_hashes, "bin int, blob binary")
        runs = base.groupBy("bin").cogroup(replies.groupBy("bin")).applyInArrow(suffix_dedup._send_runs(16, 4, 50), "bucket int, blob binary")
        by = {}
        for r in runs.collect():
            by[r["bucket"]] = by.get(r["bucket"], 0) + len(unpack(bytes(r["blob"]))["bytes"])
        sizes.append(max(by.values()) / sum(by.values()))
    assert sizes[1] < sizes[0] / 3, sizes


def test_digest_and_nothing(spark):
    docs = spark.createDataFrame([(2, "k" * 60), (1, "k" * 60)], "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in cut_repeats(docs, digest_only=True).collect()}
    assert got == {1: hashlib.sha256(b"k" * 60).digest(), 2: hashlib.sha256(b"").digest()}
    assert cut_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cut_repeats(docs, 15)


def test_long_text(spark):
    rng = np.random.default_rng(0)
    long = "".join(rng.choice(list("abcdefgh "), 300_000))
    docs = spark.createDataFrame([(1, long), (2, long[1000:200_000] + "!" + long[:500])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in cut_repeats(docs, digest_only=True).collect()}
    assert got == {1: (0, 0), 2: (199_500, 2)}


def test_equal_windows_share_a_run_hash():
    a, b = b"0123456789" * 3 + bytes(range(97, 122)) * 4, bytes(range(97, 122)) * 4 + b"tail of another text, long enough"
    text, first, many, h = window_runs([a, b"", b"short", b])
    data = a + b"short" + b
    seen = {}
    for f, n, x in zip(first.tolist(), many.tolist(), h.tolist(), strict=True):
        for p in range(f, f + n):
            assert seen.setdefault(data[p : p + 50], x) == x
    assert sum(many.tolist()) == len(a) - 49 + len(b) - 49 and set(text.tolist()) == {0, 3}


def test_merge_is_the_sorted_order():
    rng = np.random.default_rng(3)
    shards = [[bytes(rng.choice(list(b"ab"), int(rng.integers(16, 60)))) for _ in range(9)] for _ in range(3)]
    keys, before, strings, starts, rings = [], [], [], [], []
    for s, members in enumerate(shards):
        order, first, two = transform(members, 16)
        own = np.repeat(np.arange(9), [len(x) + 1 for x in members])
        place = np.concatenate([np.arange(len(x) + 1) for x in members])
        keys.append(first)
        before.append(two)
        strings.append((own + 9 * s)[order])
        starts.append(np.ones(len(order), bool))
        rings.append([(lambda t: (t[p:] + t[:p]) * 20)(members[o] + b"\xff")[:16] for o, p in zip(own[order].tolist(), place[order].tolist(), strict=True)])
    rows, source, interval = merge(keys, before, strings, starts, 27, 16)
    take = [iter([r[i] for i in kept.tolist()]) for r, kept in zip(rings, rows, strict=True)]
    merged = [next(take[k]) for k in source.tolist()]
    assert merged == sorted(merged)
    assert [a != b for a, b in zip(merged, merged[1:], strict=False)] == (np.diff(interval) == 1).tolist()


def test_window_minima():
    strings = [b"x" * 10 + b"common part of twenty bytes!" + b"y" * 9, b"zz common part of twenty bytes! more", b"nothing like the others here at all"]
    got, begin = window_minima(strings, np.array([9, 4, 6]), 16)
    for k, s in enumerate(strings):
        for p in range(len(s) - 15):
            want = min(v for t, v in zip(strings, (9, 4, 6), strict=True) if s[p : p + 16] in t)
            assert got[begin[k] + p] == want


def test_pack():
    x = {"a": np.arange(5, dtype=np.uint16), "b": np.zeros(0, np.int64), "c": np.array([2**63 + 1], np.uint64)}
    assert all((unpack(pack(**x))[k] == v).all() and unpack(pack(**x))[k].dtype == v.dtype for k, v in x.items())


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (64, 64), (3, 200)])
def test_png_round_trip(kind, shape):
    samples = np.random.default_rng(kind).integers(0, 256, shape).astype(np.uint8)
    assert (decode_png(encode_png(samples, kind)) == samples).all()


def test_png_of_mixed_filters():
    samples = np.random.default_rng(9).integers(0, 256, (10, 8)).astype(np.uint8)
    raw = b"".join(zlib.decompress(encode_png(samples, k)[41 : 41 + int.from_bytes(encode_png(samples, k)[33:37], "big")])[9 * k * 2 : 9 * (k * 2 + 2)] for k in range(5))
    whole = encode_png(samples, 0)
    from gleanery.llm.media import chunk

    mixed = whole[:33] + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (decode_png(mixed) == samples).all()


def brute_samples(data):
    """The samples of a PNG, one at a time by the rules of the format."""
    width = int.from_bytes(data[16:20], "big")
    raw, out, size = zlib.decompress(data[41 : 41 + int.from_bytes(data[33:37], "big")]), [], width + 1
    for r in range(len(raw) // size):
        kind, line, above, row = raw[r * size], raw[r * size + 1 : (r + 1) * size], out[-1] if out else [0] * width, []
        for c, x in enumerate(line):
            a, b, d = (row[c - 1], above[c], above[c - 1]) if c else (0, above[c], 0)
            p = a + b - d
            near = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d)))[2]
            row.append((x + [0, a, b, (a + b) // 2, near][kind]) % 256)
        out.append(row)
    return out


def brute_feature(rows):
    """Means of 32 x 32 areas, their cosine terms by the sum, bits over the median of all but the first."""
    areas = lambda n: [(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1)) for i in range(32)]
    small = [[sum(rows[r][c] for r in range(*ys) for c in range(*xs)) / ((ys[1] - ys[0]) * (xs[1] - xs[0])) for xs in areas(len(rows[0]))] for ys in areas(len(rows))]
    wave = [[math.cos(math.pi * k * (2 * i + 1) / 64) for i in range(32)] for k in range(8)]
    terms = [sum(wave[u][i] * wave[v][j] * small[i][j] for i in range(32) for j in range(32)) for u in range(8) for v in range(8)]
    middle = statistics.median(terms[1:])
    return terms, middle


def test_features_and_filters_by_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(30).collect()] + ["", "a" * 500, "ab\n" * 900, "é" * 65]
    images = [np.frombuffer(payload(t.encode()), np.uint8).reshape(-1, 64) for t in texts]
    stored = encode_pngs(images)
    kinds = set()
    for data, image, back in zip(stored, images, decode_pngs(stored), strict=True):
        assert data == encode_png(image) and (back == image).all()
        assert brute_samples(data) == image.tolist()
        kinds |= set(zlib.decompress(data[41 : 41 + int.from_bytes(data[33:37], "big")])[::65])
    assert len(kinds) == 5
    for image in images[:6]:
        terms, middle = brute_feature(image.tolist())
        bits = "".join(f"{x:08b}" for x in cosine_hash(image))
        assert all(int(b) == (t > middle) for b, t in zip(bits, terms, strict=True) if abs(t - middle) > 1e-6)


def test_bad_checksum():
    data = bytearray(encode_png(np.zeros((4, 4), np.uint8), 0))
    data[45] ^= 1
    with pytest.raises(ValueError):
        decode_png(bytes(data))


def test_hash_is_of_low_frequencies():
    a = np.linspace(0, 3, 64)
    x = (128 + 60 * np.sin(a)[:, None] * np.cos(2 * a)[None, :] + 30 * np.cos(a[:, None] * a[None, :])).astype(np.uint8)
    noisy = np.clip(x.astype(int) + np.random.default_rng(1).integers(-2, 3, x.shape), 0, 255).astype(np.uint8)
    far = np.random.default_rng(2).integers(0, 256, x.shape).astype(np.uint8)
    bits = lambda a, b: sum(bin(p ^ q).count("1") for p, q in zip(cosine_hash(a), cosine_hash(b), strict=True))
    assert len(cosine_hash(x)) == 8 and bits(x, noisy) < bits(x, far)


def test_text_media(spark):
    rows = [(1, "hello é"), (2, None), (3, ""), (None, "x" * 64), (4, "x" * 64), (4, "x" * 64), (5, "long " * 50_000)]
    docs = spark.createDataFrame([(*r, b"m") for r in rows], "doc_id long, text string, media binary")
    got = text_media(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        data = payload(next(t for d, t in rows if d == r["doc_id"] and (d is not None or t)).encode() if r["doc_id"] != 2 else b"")
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["payload_bytes"] == len(data) % 64 + len(data) and r["tail_crc32"] == zlib.crc32(data[-64:])
    assert len({(r["media_sha256"], bytes(r["feature"])) for r in got if r["n_bytes"] == 64}) == 1
    assert text_media(docs.limit(0)).count() == 0
