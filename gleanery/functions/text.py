"""Column expressions over text: analysis, identifiers, previews."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = _folds()
#: What isn't part of a token.
NOT_TOKEN = "[^\\p{L}\\p{N}]+"
#: White space by Unicode, which trimming removes at both ends.
SPACE = "\t\n\x0b\f\r \x85\xa0                　"
#: Queries keep ASCII letters and digits, white space, Han and kana.
NOT_SAFE = "[^a-zA-Z0-9\\s\\p{IsHan}\\p{IsKatakana}\\p{IsHiragana}]"
#: Neighbouring Han characters, the last of a run (its pair stands before it), and one alone. The range, all Han, is only tried first.
HAN = "[\\x{4E00}-\\x{9FEF}\\p{IsHan}]"
HAN_PAIRS = f"({HAN})(?=({HAN}))|(?<={HAN}){HAN}(?!{HAN})|({HAN})"
# The pattern of an image in the text.
IMAGE = "!\\[[^\\]]*\\]\\(data:image/[^;]+;base64,[^)]*\\)"
TITLE_LINES = 20


def fold(text: Column) -> Column:
    """Letters without their marks (é: e); ß and the like stay. Plain ASCII texts pass by."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(_bare(text))


def _bare(text: Column) -> Column:
    """Texts without a letter that would change aren't walked through letter by letter."""
    return F.when(text.rlike(f"[{MARKED[0]}-{MARKED[-1]}]"), F.translate(text, MARKED, BARE)).otherwise(text)


def segmented(text: Column) -> Column:
    """Runs of Han characters cut to overlapping pairs, one alone as it is; all else as it is."""
    return F.when(text.rlike(HAN), F.regexp_replace(text, HAN_PAIRS, " $1$2$3 ")).otherwise(text)


def _analysed(text: Column, cut: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    # folded and lower-cased while the text is short; cutting adds spaces
    marked = F.lower(_bare(text))
    marked = F.when(text.rlike(HAN), F.regexp_replace(marked, HAN_PAIRS, " $1$2$3 ")).otherwise(marked) if cut else marked
    return F.array_remove(F.split(F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(marked), NOT_TOKEN), "")


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded and lower-cased, Han characters in pairs; null: none."""
    return _analysed(text, True)


def whole_runs(text: Column) -> Column:
    """As tokens, but a run of Han characters is one token."""
    return _analysed(text, False)


def safe(text: Column, folded: bool = True) -> Column:
    """A query's text with everything but safe characters made spaces.

    Marks are folded first, so that `café` is searched as `cafe` as it is indexed;
    folded=False keeps the strict form, in which it breaks at the é.
    """
    return F.regexp_replace(fold(text) if folded else text, NOT_SAFE, " ")


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def token_estimate(text: Column) -> Column:
    """A quarter of the ASCII characters (floor) plus two for each other one."""
    others = F.length(F.regexp_replace(text, "[\\x00-\\x7F]", ""))
    return (F.floor((F.length(text) - others) / 4) + 2 * others).cast("int")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def title(body: Column, path: Column) -> Column:
    """The first top-level heading among the first lines, else the file's name without its extension."""
    lines = F.transform(F.slice(F.split(body, "\n", TITLE_LINES), 1, TITLE_LINES), trim)
    heads = F.filter(lines, lambda x: x.rlike("^#[\\t\\n\\f\\r ]+[^\\n]+$"))
    head = trim(F.regexp_extract(F.try_element_at(heads, F.lit(1)), "^#[\\t\\n\\f\\r ]+(.+)$", 1))
    return F.coalesce(head, F.regexp_replace(base_name(path), "\\.[^.]*$", ""))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def document_id(collection: Column, path: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws(":", collection, path, digest), 256)


def short_id(doc_id: Column) -> Column:
    return F.left(doc_id, F.lit(8))


def preview(body: Column, size: int = 500, full: bool = False) -> Column:
    return body if full else F.when(F.length(body) > size, F.concat(F.left(body, F.lit(size)), F.lit("..."))).otherwise(body)


def line_slice(body: Column, first: int, lines: int = 0) -> Column:
    """Lines from the 1-based first (out of range: from the start), at most `lines` of them (0: to the end)."""
    parts = F.split(body, "\n", -1)
    start = F.when((F.lit(first) >= 1) & (F.lit(first) <= F.size(parts)), F.lit(first)).otherwise(F.lit(1))
    return F.array_join(F.slice(parts, start, F.lit(lines) if lines > 0 else F.size(parts)), "\n")


def strip_images(text: Column) -> Column:
    return F.regexp_replace(text, IMAGE, "...(truncated)")


def normal_path(path: Column) -> Column:
    """Scheme and leading ./ off, lower case, no slashes at the ends."""
    return F.btrim(F.lower(F.regexp_replace(F.regexp_replace(path, "^[a-z]+://", ""), "^\\./", "")), F.lit("/"))


def path_matches(found: Column, expected: Column) -> Column:
    """Equal, or found ends with expected after a slash."""
    a, b = normal_path(found), normal_path(expected)
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b))


def eta(seconds: Column) -> Column:
    """A duration as text: <1s, Ns, MmSs, HhMm or Hh."""
    s = F.floor(seconds)
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    rest = F.floor((s - hours * 3600) / 60)
    return (
        F.when(seconds < 1, "<1s").when(seconds < 60, F.format_string("%ds", s)).when(seconds < 3600, F.format_string("%dm%ds", minutes, s - minutes * 60))
        .when(rest > 0, F.format_string("%dh%dm", hours, rest)).otherwise(F.format_string("%dh", hours))
    )


def session_key(path: Column) -> Column:
    """0-based question and session numbers in names like q3_s2.md, else null."""
    part = lambda i: F.regexp_extract(path, "q(\\d+)_s(\\d+)\\.md", i)
    return F.when(part(1) != "", F.struct((part(1).cast("int") - 1).alias("question"), (part(2).cast("int") - 1).alias("session")))
