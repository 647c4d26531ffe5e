"""Document fingerprints: a homomorphic multiset hash; DataFrame functions only.

A paragraph (line) is cut into tiles of three words. Tiles and the paragraph
itself are elements; an element is hashed to HASHES words of 64 bits, of which 62
give one lane each, and a paragraph's vector is the sum of its elements' lanes. A
text's vector is the sum over its paragraphs, modulo 2^31 in each lane, so it
doesn't depend on the order of the paragraphs, and a paragraph can be added or
taken out by adding or subtracting its vector. Two lanes share a 64-bit number
(low and high 31 bits), which plain sums of bigint keep apart.

A lane counts the elements whose bit is set, so 2 * lane - elements is a random
projection of the multiset of elements; the cosine of two such vectors is the
likeness.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import n_shuffle

#: Over 100 columns of sums, Spark leaves whole-stage code generation for small compiled projections.
HASHES, SHIFTS = 4, 31
LOW, PAIR = (1 << 31) - 1, 1 | 1 << 31
TILE = "[^\\x20\\x09-\\x0D]+(?:[\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]+){0,2}"


def elements(text: Column) -> Column:
    """Of each paragraph, its tiles of words and itself; marked, so that the two never meet."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n")
    tiles = F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(p, F.lit(TILE), F.lit(0))))
    return F.concat(tiles, F.transform(paragraphs, lambda p: F.concat(p, F.lit("\n"))))


def sums(element: Column) -> Column:
    """Aggregate: elements counted and packed lanes summed, as one array of bigint."""
    lanes = [F.sum(F.shiftright(F.xxhash64(F.lit(k), element), s).bitwiseAND(F.lit(PAIR))) for k in range(HASHES) for s in range(SHIFTS)]
    return F.array(F.count("*"), *lanes)


def combine(a: Column, b: Column, subtract: bool = False) -> Column:
    """Vectors added (paragraphs inserted) or subtracted (deleted), lane by lane modulo 2^31."""
    def lane(x: Column, y: Column) -> Column:
        sign = -1 if subtract else 1
        low = (x.bitwiseAND(F.lit(LOW)) + y.bitwiseAND(F.lit(LOW)) * sign).bitwiseAND(F.lit(LOW))
        high = (F.shiftrightunsigned(x, 31) + F.shiftrightunsigned(y, 31) * sign).bitwiseAND(F.lit(LOW))
        return low + F.shiftleft(high, 31)

    return F.zip_with(a, b, lane)


def as_text(vector: Column) -> Column:
    """Hexadecimal: of each lane (and of the number of elements) the low 16 bits."""
    both = lambda x: F.shiftleft(F.shiftrightunsigned(x, 31).bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(x.bitwiseAND(F.lit(0xFFFF)))
    return F.array_join(F.transform(vector, lambda x: F.lower(F.lpad(F.hex(both(x)), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the lanes about their middle, 0 to 1; 1 for equal vectors."""
    def lanes(v: Column) -> Column:
        middle = F.element_at(v, 1)
        packed = F.slice(v, 2, HASHES * SHIFTS)
        signed = lambda x: (x * 2 - middle).cast("double")
        return F.concat(F.transform(packed, lambda x: signed(x.bitwiseAND(F.lit(LOW)))), F.transform(packed, lambda x: signed(F.shiftrightunsigned(x, 31))))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    x, y = lanes(a), lanes(b)
    norms = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(a == b, 1.0).when(norms == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / norms)))


def vectors(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per key with its vector; rows that share a key add up (insertion)."""
    exploded = docs.select(*keys, F.explode(elements(F.col(text))).alias("element"))
    return exploded.groupBy(*keys).agg(sums(F.col("element")).alias("vector"))


#: Ranges at most: each has a value in one constant array.
MOST_RANGES = 65_536


def _ranges(docs: DataFrame, rows_per_range: int) -> DataFrame:
    """docs (doc_id, tie and more) with bucket, the range of each row in descending order of (doc_id, falling tie), nulls last; higher ranges come first.

    Cuts are percentiles of doc_id, MOST_RANGES at most, which come to the driver and
    go out as one constant array, looked up in two steps. An id that several cuts
    share has so many ranges, by its tie; null ids have ranges by their ties, below
    those of all others.
    """
    counted = docs.agg(F.count("*").alias("all"), F.count("doc_id").alias("known")).first()
    n = min(MOST_RANGES, max(n_shuffle(docs.sparkSession), math.ceil(counted["known"] / rows_per_range)))
    steps = F.split(F.lit(",".join(str(i / n) for i in range(1, max(2, n)))), ",").cast("array<double>")
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), steps, 10 * n).alias("cuts")).first()["cuts"] or []
    coarse = max(1, math.isqrt(n))
    groups = [cuts[i : i + coarse] for i in range(0, len(cuts), coarse)]
    tops = F.from_json(F.lit(json.dumps([g[-1] for g in groups])), "array<bigint>")
    blocks = F.from_json(F.lit(json.dumps([*groups, []])), "array<array<bigint>>")

    def below(test) -> Column:
        """The number of cuts that pass a test which only the lower ones pass."""
        full = F.size(F.filter(tops, test))
        return full * coarse + F.size(F.filter(F.get(blocks, full), test))

    share = (F.col("tie").cast("double") + 2.0**63) / 2.0**64
    low, same = below(lambda x: x < F.col("doc_id")), below(lambda x: x <= F.col("doc_id"))
    spread = F.when(same - low > 1, same - low - 1 - F.least(F.floor(share * (same - low)), same - low - 1)).otherwise(F.lit(0))
    nulls = max(1, math.ceil((counted["all"] - counted["known"]) / rows_per_range))
    bucket = F.when(F.col("doc_id").isNull(), -1 - F.least(F.floor(share * nulls), F.lit(nulls - 1))).otherwise(low + spread).cast("bigint")
    # never null; if Spark didn't see that, a filter before one exchange of the texts would keep it from being reused
    return docs.select("*", F.coalesce(bucket, F.lit(0)).alias("bucket"))


def edit_likeness(docs: DataFrame, rows_per_range: int = 3000) -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and two likenesses.

    The edited text is the text with its last third (floor of code points / 3)
    replaced by as many first code points of the next document by descending doc_id,
    the first following the last; of a shorter next document, all. Rows are dealt
    into ranges of that order, within which the next row is a window's; the first row
    of each range (one per range) is joined to the last row of the range before it.
    All later steps keep the dealing by range, so texts are shuffled once.

    Null text: empty. Null doc_id: last, ordered by a hash of their texts, as equal
    doc_ids are. Very long texts: one row each, whose elements are added up before
    any shuffle. Repeated rows: each follows another. A single document follows
    itself. Empty table: no rows. Other columns than doc_id and text are left out.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    base = _ranges(base, rows_per_range)
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "tie")
    rows = base.select("*", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("next_text"))
    firsts = rows.where("rn = 1").select(F.col("bucket").alias("h_bucket"), F.col("text").alias("h_text"))

    def after(heads: DataFrame) -> DataFrame:
        """h_last: the range whose last row the head follows. One row per range."""
        whole = Window.orderBy(F.col("h_bucket").desc())
        return heads.select("*", F.coalesce(F.lag("h_bucket").over(whole), F.min("h_bucket").over(Window.partitionBy())).alias("h_last"))

    following = after(firsts.select("h_bucket")).withColumnRenamed("h_bucket", "f_bucket")
    heads = firsts.join(following, F.col("h_bucket") == F.col("f_bucket")).select("h_last", "h_text")
    rows = rows.join(heads, F.col("bucket") == F.col("h_last"), "left")
    after_it, length = F.coalesce("next_text", "h_text"), F.length("text")
    part = F.floor(length / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(after_it, F.lit(1), part))
    pairs = rows.select("bucket", "rn", "doc_id", length.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text"), F.lit(None).cast("string").alias("sha")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text"), F.sha2("edited", 256).alias("sha")))).alias("s")
    both = pairs.select("bucket", "rn", "doc_id", "n_chars", sides).select("bucket", "rn", "doc_id", "n_chars", "s.*")
    found = vectors(both, ["bucket", "rn", "doc_id", "n_chars", "side", "sha"])

    line = Window.partitionBy("bucket").orderBy("rn", "side")
    found = found.select("*", F.lead("vector", 1).over(line).alias("edited_vector"), F.lead("sha", 1).over(line).alias("edited_sha256"), F.lead("vector", 2).over(line).alias("next_vector")).where("side = 0")
    starts = found.where("rn = 1").select(F.col("bucket").alias("h_bucket"), F.col("vector").alias("h_vector"))
    starts = starts.join(following, F.col("h_bucket") == F.col("f_bucket")).select("h_last", "h_vector")
    found = found.join(starts, F.col("bucket") == F.col("h_last"), "left")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("vector")).alias("fingerprint"), as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), likeness(F.col("vector"), F.coalesce("next_vector", "h_vector")).alias("near_next"),
    )
