import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gleanery.llm.sentencepiece_codec import Codec, _fields, decode_documents, encode_documents, load
from gleanery.llm.token_files import Encoder, Shard, lookup, read_shards, token_digests, write_shards

ODD = ["", " ", "  a  b   ", "\n\n x", "你好 世界", "a\tb\r\n", "x\xa0 y", "a 　b", "emoji 😀😀 é", "x" * 700, "    def f(x):\n        return x**2 + 1\n", "\x00\x01", "it's I'll a 's", "<|endoftext|> a<|endoftext|>", "a\x1c b!\x1c c", "a \nb\n c", "z", "<s> </s> <unk> <0x41>", "The quick brown fox, isn't it? https://example.com/a?b=c&d=e", "----====", "aaaaaaaaaaaaaaaaaaaaaab", "ABC!!! $$$ %%%", "qzjxkvQ" * 90 + " end", "héllo,wörld" * 60, "=" * 600]


@pytest.fixture(scope="module")
def definition():
    return open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()


@pytest.fixture(scope="module")
def model():
    return load(public_tokenizers.path("piece_bpe_32k.model"))


def texts_of(spark, n=80):
    return [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(n).collect()]


def split(ids, many):
    return [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])]


def test_words_give_the_ids_of_texts(spark, definition):
    encoder, texts = Encoder(definition), ODD + texts_of(spark)
    library = Tokenizer.from_str(definition)
    library.encode_special_tokens = True
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        assert split(*encoder.encode(pa.array(texts))) == want


def test_added_tokens_are_found(spark, definition):
    texts = [*ODD, "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y z", "<|endoftext|>", "a <|endoftext| > b", *texts_of(spark, 20)]
    library = Tokenizer.from_str(definition)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert want[len(ODD)] == [64, 220, 50256, 275]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    start, rows = 0, []
    for i, ids in enumerate(want):
        ids = [*ids, 2]
        rows.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_digests(docs, definition).collect())) == rows
    encoder = Encoder(definition, added=True)
    for _ in range(2):
        assert split(*encoder.encode(pa.array(texts))) == want


def test_pieces_are_those_of_the_library(spark, model):
    codec, texts = Codec(model), ODD + texts_of(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids, many = codec.encode(pa.array(texts))
    assert split(ids, many) == library.encode(texts)
    assert [x.decode() for x in codec.decode(ids, many)] == texts


def test_other_models_are_refused(tmp_path):
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    field = lambda n, body: bytes([n << 3 | 2, len(body)]) + body
    number = lambda n, x: bytes([n << 3, x])
    # later fields of a message count
    for name, more in (("word", field(2, number(3, 3))), ("spaces", field(3, number(4, 1))), ("rewriting", field(3, field(2, b"x") + number(4, 0)))):
        own = _fields(data)
        parts = b"".join(_packed(1, x) for x in own[1][:300]) + more + (b"" if more[0] >> 3 == 2 else _packed(2, own[2][0])) + (b"" if more[0] >> 3 == 3 else _packed(3, own[3][0]))
        (tmp_path / name).write_bytes(parts)
        with pytest.raises(ValueError):
            load(str(tmp_path / name))


def _packed(n, body):
    size, head = len(body), b""
    while size > 127:
        head, size = head + bytes([size & 127 | 128]), size >> 7
    return bytes([n << 3 | 2]) + head + bytes([size]) + body


def test_unigram_viterbi():
    names = ["<unk>", "▁", "a", "b", "ab", "▁ab", "ba", "c"]
    model = {"pieces": names, "scores": [0, -3.5, -2.0, -2.0, -3.0, -4.2, -3.1, -5.0], "plain": list(range(1, 8)), "unknown": 0, "bytes": {}, "prefix": True, "unigram": True}
    codec = Codec(model)

    def best(word):
        scores = dict(zip(names[1:], model["scores"][1:], strict=True))
        table = [(0.0, [])]
        for j in range(1, len(word) + 1):
            options = [(table[i][0] + scores[word[i:j]], [*table[i][1], names.index(word[i:j])]) for i in range(j) if word[i:j] in scores]
            table.append(max(options, key=lambda x: x[0]))
        return table[-1][1]

    for text in ("ab", "abba", "a ba cab", "bbb aab"):
        ids, many = codec.encode(pa.array([text]))
        assert ids.tolist() == [i for w in text.split() for i in best("▁" + w)]
    assert codec.encode(pa.array(["azzb"]))[0].tolist() == [1, 2, 0, 3]


def test_codec_rows(spark, model):
    rows = [(1, "some words here", "c"), (2, None, "c"), (3, "", "c"), (None, "no id", "c"), (4, "same", "c"), (4, "same", "c"), (5, "long words " * 20_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode_documents(encode_documents(docs, model), model).collect()
    assert len(got) == len(rows) and all(r["decoded"] == (r["text"] or "") for r in got)
    both = encode_documents(docs, model, decoded="decoded").collect()
    assert sorted(map(repr, both)) == sorted(map(repr, got))
    assert encode_documents(docs.limit(0), model).count() == 0


def test_token_files(spark, definition):
    rows = [(i * 7 % 101, t, "x") for i, t in enumerate(ODD + texts_of(spark, 40))] + [(500, None, "x"), (None, "no id", "x"), (None, None, "x"), (501, "twice", "x"), (501, "twice", "x"), (501, "other", "x"), (-5, "negative id " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(6)
    library = Tokenizer.from_str(definition)
    library.encode_special_tokens = True
    start, want = 0, []
    for i, t in sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = write_shards(docs, definition, shard_bytes=20_000)
    assert manifest.count() > 2
    assert sorted(map(repr, map(tuple, read_shards(manifest).collect()))) == sorted(map(repr, want))
    # keyed access, and keys that aren't there
    file = manifest.orderBy("part").first()
    shard = Shard(file["folder"], file["path"])
    keys = np.array([*shard["keys"][-3:].tolist(), 10**12])
    found = shard.rows(keys)
    assert found[3] == -1 and all(shard["keys"][r] == k for r, k in zip(found[:3], keys, strict=False))
    asked = [7, 14, 500, 501, 501, -5, 100, 999, -10**15, None]
    got = sorted((repr(r["doc_id"]), r["ids"]) for r in lookup(manifest, spark.createDataFrame([(k,) for k in asked], "doc_id long")).collect())
    assert got == sorted((repr(i), [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in rows if i in asked)
    assert lookup(manifest.limit(0), docs.select("doc_id")).count() == 0 and lookup(manifest, docs.select("doc_id").limit(0)).count() == 0


def test_lookup_reads_slices(spark, definition):
    docs = spark.createDataFrame([(i, f"words of document {i} " * 200) for i in range(300)], "doc_id long, text string")
    file = write_shards(docs, definition).first()
    size = os.path.getsize(file["path"])
    shard = Shard(file["folder"], file["path"])
    row = int(shard.rows(np.array([123]))[0])
    assert shard["keys"][row] == 123 and len(shard.row_ids(row)) > 200
    assert shard.bytes_read < size / 8


def test_files_of_no_rows(spark, definition):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert token_digests(docs.limit(0), definition).count() == 0


def test_a_key_with_very_many_rows_has_several_files(spark, definition):
    """Half of the rows have one key, a quarter none: both are spread, in order, and found whole."""
    rows = [(5, f"row {i} of five") for i in range(400)] + [(None, f"no id {i}") for i in range(200)] + [(i, f"own {i}") for i in range(200)] + [(-3, "low"), (2**63 - 1, "high"), (-(2**63), "least")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = write_shards(docs, definition, shard_bytes=800)
    files = manifest.collect()
    assert sum(r["first_key"] == 5 == r["last_key"] for r in files) > 3 and sum(r["last_key"] is None for r in files) > 1
    assert max(r["n_rows"] for r in files) < 0.3 * len(rows)
    library = Tokenizer.from_str(definition)
    want = {}
    for k, t in rows:
        want.setdefault(k, []).append([*library.encode(t, add_special_tokens=False).ids, 2])
    asked = spark.createDataFrame([(k,) for k in (5, None, -3, 2**63 - 1, -(2**63), 7, 5, 1000)], "doc_id long")
    got = {}
    for r in lookup(manifest, asked).collect():
        got.setdefault(r["doc_id"], []).append(r["ids"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(want[k]) for k in (5, None, -3, 2**63 - 1, -(2**63), 7)}
    read = sorted(read_shards(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in read] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert [r["start"] for r in read[1:]] == [r["start"] + r["n_tokens"] for r in read[:-1]]
