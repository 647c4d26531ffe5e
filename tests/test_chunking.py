import math
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.operators.chunking import chunk, markdown_chunks, plain_chunks, tokens
from gleanery.plans import catalog


def test_short_texts_are_one_chunk():
    assert [(p.text, p.line) for p in markdown_chunks("# Title\n\nHello world")] == [("# Title\n\nHello world", 0)]
    assert [(p.text, p.line, p.tokens) for p in plain_chunks(" Hello. ")] == [("Hello.", 0, 2)]
    assert markdown_chunks("") == [] and plain_chunks("") == []
    assert markdown_chunks(" \n ") == [] and len(plain_chunks("  ")) == 1


def test_token_estimate():
    assert tokens("搜索引擎") == 8 and tokens("abcdefgh") == 2


def test_headings_are_cut_before():
    body = "# A\n\n" + "word " * 40 + "\n\n## B\n\n" + "word " * 40 + "\n\n## C\n\n" + "word " * 40
    starts = [p.text.split("\n\n")[-2 if p.text.count("#") else 0] for p in markdown_chunks(body)]
    found = markdown_chunks(body)
    assert len(found) == 3 and "## B" in found[1].text and "## C" in found[2].text, starts
    assert [body.split("\n")[p.line] for p in found[1:]] == ["", ""]


def test_fences_stay_whole_where_they_can():
    code = "```go\nfunc main() {\n\n}\n```"
    body = "\n\n".join(["text " * 30, code] * 8)
    assert all(p.text.count("```") % 2 == 0 for p in markdown_chunks(body))


def test_images_are_cut_out():
    body = "before ![alt](data:image/png;base64," + "A" * 5000 + ") after"
    assert markdown_chunks(body)[0].text == "before ...(truncated) after"


def test_overlap_starts_after_a_sentence():
    body = " ".join(f"Sentence number {i} is here." for i in range(60))
    found = plain_chunks(body)
    assert len(found) > 2
    for a, b in zip(found, found[1:], strict=False):
        tail = b.text.split("\n\n")[0]
        assert a.text.endswith(tail) and a.text[: -len(tail)].rstrip().endswith(".")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#`é字。", max_size=1500))
def test_chunks_hold_the_limits_and_the_text(body):
    for cut in (markdown_chunks, plain_chunks):
        found = cut(body)
        assert all(len(p.text) <= 450 for p in found)
        joined = "".join(p.text for p in found)
        assert all(joined.count(c) >= 1 for c in set(re.sub(r"\s", "", body)))


def test_rows(spark):
    docs = spark.createDataFrame([(1, "x. " * 400, "a.txt"), (2, None, "b.md"), (3, "", "c.md"), (4, "short", "d.md")], "doc_id long, text string, path string")
    got = chunk(docs, ["doc_id"], path="path").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("seq").alias("last")).collect()
    assert {r["doc_id"]: r["n"] - 1 == r["last"] for r in got} == {1: True, 4: True}


# A second implementation, one character and one candidate at a time.

WHITE = "\t\n\x0b\f\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def cost(text):
    few = [c for c in text if ord(c) < 128]
    return len(few) // 4 + 2 * (len(text) - len(few))


def best_break(text, at, target):
    """The place to cut at or before target: headings over fences over rules over blank lines, faded by the square of the distance in bytes."""
    size = lambda a, b: len(text[a:b].encode())
    fences, open_at = [], None
    for m in re.finditer("```", text):
        if open_at is None:
            open_at = m.start()
        else:
            fences.append((open_at, m.end()))
            open_at = None
    if open_at is not None:
        fences.append((open_at, len(text)))
    before, found = size(0, target), (0.0, target)
    window = min(before, 600)
    for p in range(target + 1):
        far = size(p, target)
        if text[p : p + 1] != "\n" or far > window or any(a <= p < b for a, b in fences):
            continue
        rest, score = text[p + 1 :], 0
        for level, value in ((1, 100), (2, 90), (3, 80), (4, 70)):
            if rest.startswith("#" * level) and rest[level : level + 1] not in ("", "#"):
                score = max(score, value)
        if rest.startswith("```"):
            score = max(score, 80)
        line, newline, _ = rest.partition("\n")
        if newline and line[:3] in ("---", "***", "___") and not line[3:].strip("\t\n\f\r "):
            score = max(score, 60)
        if rest.startswith("\n") and (p == 0 or text[p - 1] != "\n"):
            score = max(score, 20)
        value = score * (1 - 0.7 * (far / (window + 1)) ** 2)
        if value > found[0]:
            found = (value, p)
    return found[1] if found[1] > at else target


def with_lines(pieces, text, stops, shift):
    out = []
    for start, piece in pieces:
        if body := piece.strip(WHITE):
            out.append([body, max(0, text[:start].count("\n") - shift), cost(body)])
    plain = [x[0] for x in out]
    for i in range(1, len(out)):
        last = plain[i - 1]
        if len(last) <= 45:
            continue
        near = None
        for p in range(max(0, len(last) - 95), min(len(last), len(last) + 5)):
            if last[p] in stops and (near is None or abs(p - len(last) + 45) < abs(near - len(last) + 45)):
                near = p
        tail = "" if near is None else last[near + 1 :].strip(WHITE)
        if tail and len(tail) + 2 + len(plain[i]) <= 450:
            joined = tail + "\n\n" + plain[i]
            out[i] = [joined, out[i][1], cost(joined)]
    return [tuple(x) for x in out]


def naive_markdown(body):
    if not body:
        return []
    text, at, pieces = "\n" + re.sub(r"!\[[^\]]*\]\(data:image/[^;]+;base64,[^)]*\)", "...(truncated)", body), 0, []
    while len(text) - at > 300:
        end = best_break(text, at, at + 300)
        pieces.append((at, text[at:end]))
        at = end
    if at < len(text):
        pieces.append((at, text[at:]))
    out, now = [], pieces[0]
    for piece in pieces[1:]:
        if (len(now[1]) < 75 or (not out and len(piece[1]) < 75)) and len(now[1]) + 1 + len(piece[1]) <= 450:
            now = (now[0], now[1] + "\n" + piece[1])
        else:
            out.append(now)
            now = piece
    return with_lines([*out, now], text, "。！？.!?", 1)


def naive_plain(body):
    stops = "。！？.!?\n"
    if not body:
        return []
    if len(body) <= 300:
        return [(body.strip(WHITE), 0, cost(body))]
    at, pieces = 0, []
    while len(body) - at > 300:
        target, near = at + 300, None
        for p in range(max(0, target - 50), min(len(body), target + 50)):
            if body[p] in stops and (near is None or abs(p + 1 - target) < abs(near - target)):
                near = p + 1
        end = near if near is not None and near > at else target
        pieces.append((at, body[at:end]))
        at = end
    if at < len(body):
        pieces.append((at, body[at:]))
    if len(pieces) > 1 and len(pieces[-1][1]) < 75 and len(pieces[-2][1]) + 1 + len(pieces[-1][1]) <= 450:
        last = pieces.pop()
        pieces[-1] = (pieces[-1][0], pieces[-1][1] + "\n" + last[1])
    return with_lines(pieces, body, stops, 0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["\n# ", "\n## ", "\n#### x", "\n\n", "\n```\n", "\n---\n", "word ", "é. ", "字。", "a b c d e f g. " * 5, "![x](data:image/png;base64,AA==)", "\n***  \n", "\n\n\n", "　", "! "]), max_size=90))
def test_chunks_are_those_of_the_naive_cutters(parts):
    body = "".join(parts)
    for cut, naive in ((markdown_chunks, naive_markdown), (plain_chunks, naive_plain)):
        assert [(p.text, p.line, p.tokens) for p in cut(body)] == naive(body)


def test_chunk_queries_by_brute_force(spark, sf_dir):
    """All rows of chunk_markdown and chunk_plain, and the ranks of chunk_search by BM25 in plain Python over naive chunks."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {}
    for name, naive in (("chunk_markdown", naive_markdown), ("chunk_plain", naive_plain)):
        rows[name] = sorted((d, seq, *c) for d, t in docs.items() for seq, c in enumerate(naive(t or "")))
        got = sorted((r["doc_id"], r["seq"], r["content"], r["position"], r["token_count"]) for r in catalog.QUERIES[name](spark, sf_dir).collect())
        assert got == rows[name]
    terms, cut = ("worthless", "nation", "theast", "blehe"), {}
    for d, seq, content, *_ in rows["chunk_markdown"]:
        bare = "".join(c for c in unicodedata.normalize("NFD", content) if not unicodedata.combining(c))
        cut[f"{d}-{seq}"] = re.findall(r"[^\W_]+", bare.lower())
    average = sum(map(len, cut.values())) / len(cut)
    df = {t: sum(t in ts for ts in cut.values()) for t in terms}
    idf = {t: max(math.log((len(cut) - n + 0.5) / (n + 0.5)), 0) or 1e-6 for t, n in df.items()}
    score = {k: sum(idf[t] * ts.count(t) * 2.2 / (ts.count(t) + 1.2 * (0.25 + 0.75 * len(ts) / average)) for t in terms if t in ts) for k, ts in cut.items()}
    want = sorted((k for k, v in score.items() if v > 0), key=lambda k: (-round(score[k], 9), k))[:50]
    got = catalog.QUERIES["chunk_search"](spark, sf_dir).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == want and len(want) > 5
    assert all(abs(r["score"] - score[r["chunk_id"]] / (1 + score[r["chunk_id"]])) < 1e-5 for r in got)
