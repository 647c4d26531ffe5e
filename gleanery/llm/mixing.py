"""Mixing sources to target weights, by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import new_names, stored, word_count

#: Rows of one source and size class that a task numbers, about.
CELL_ROWS = 20_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per source: key, source_size, target.

    sizes has key (string, null allowed), size. The sources by code point, null
    last, weigh `weights` in turn. A target stops at cap times the source's size;
    what is over is shared again by weight. With the sources in the order of
    cap-to-weight ratio, the shared level is the one at the first source which it
    doesn't fill. The windows below run over one row per source.
    """
    total = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = total.select("key", "source_size", F.row_number().over(Window.orderBy(F.col("key").asc_nulls_last())).alias("place"))
    weighed = ranked.select("*", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1).alias("weight"), (F.col("source_size") * cap).alias("most"))
    before = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighed.select("*", level.alias("level"))
    free = F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct((F.col("most") / F.col("weight")).alias("ratio"), "place", "level"))
    shared = levels.select("*", F.min(free).over(everything)["level"].alias("shared"))
    return shared.select("key", "source_size", F.least(F.col("most").cast("double"), F.col("shared") * F.col("weight")).alias("target"))


def _slim(docs: DataFrame, row: str | None = None) -> DataFrame:
    """key (the source, told apart from null), doc_id, size, class and spot of each row, and the row itself if asked for.

    class orders sizes by their first digit; spot is a hash of doc_id and text, so
    rows of a null or repeated doc_id are spread too.
    """
    size = F.col("size").cast("long") if "size" in docs.columns and "text" not in docs.columns else word_count(F.col("text"))
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")) if "text" in docs.columns else F.lit("")
    spot = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text))
    whole = [F.struct("*").alias(row)] if row else []
    rows = docs.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"), size.alias("size"), spot.alias("spot"), *whole)
    digits = F.col("size").cast("string")
    return rows.withColumn("class", F.length(digits) * 10 + F.substring(digits, 1, 1).cast("int"))


def _placed(rows: DataFrame, counted: DataFrame, weights: tuple[int, ...], cap: int, seed: int) -> DataFrame:
    """rows of _slim with source_size, target and copies; counted: the same rows, cheap to read twice.

    The number of a row within its source is taken in two steps, so that no task
    holds a source: within its cell (source, class, first digits of spot), then plus
    the rows of all earlier cells. The digits are as many as leave CELL_ROWS a cell;
    the order, by class and spot, doesn't depend on them. Both steps and the join
    use one dealing of the rows.
    """
    largest = counted.groupBy("key", "class").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    digits = next(d for d in range(1, 33) if largest <= CELL_ROWS * 16**d)
    sizes = counted.groupBy("source").agg(F.sum("size").alias("size")).withColumnRenamed("source", "key")
    targets = source_targets(sizes, weights, cap).select(F.coalesce(F.concat(F.lit("="), "key"), F.lit("")).alias("t_key"), "source_size", "target")
    cells = counted.groupBy(F.col("key").alias("c_key"), F.col("class").alias("c_class"), F.substring("spot", 1, digits).alias("c_cell")).agg(F.count("*").alias("many"))
    # cells are added up within a class, classes within a source
    classes = cells.groupBy("c_key", "c_class").agg(F.sum("many").alias("many"))
    earlier = F.coalesce(F.sum("many").over(Window.partitionBy("c_key").orderBy("c_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = classes.select(F.col("c_key").alias("k_key"), F.col("c_class").alias("k_class"), earlier.alias("k_before")).join(targets, F.col("k_key") == F.col("t_key"))
    inner = F.coalesce(F.sum("many").over(Window.partitionBy("c_key", "c_class").orderBy("c_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("c_key", "c_class", "c_cell", inner.alias("c_before"))
    cells = cells.join(classes, (F.col("c_key") == F.col("k_key")) & (F.col("c_class") == F.col("k_class"))).select("c_key", "c_class", "c_cell", (F.col("k_before") + F.col("c_before")).alias("before"), "source_size", "target")

    rows = rows.withColumn("cell", F.substring("spot", 1, digits))
    within = Window.partitionBy("key", "class", "cell").orderBy("spot", "doc_id")
    numbered = rows.select("*", F.row_number().over(within).alias("number"))
    joined = numbered.join(cells, (F.col("key") == F.col("c_key")) & (F.col("class") == F.col("c_class")) & (F.col("cell") == F.col("c_cell")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\x00null")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("source_size") == 0, 0.0).otherwise(F.col("target") / F.col("source_size"))
    place = F.col("before") + F.col("number")
    return joined.select("*", (F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: each document once, with what the mix takes of it.

    docs needs doc_id, source, text (or size in its place); other columns aren't read.
    A document is expected target / source_size times. The sum of these expectations
    over the documents of its source, in the order of size class, then of a hash,
    runs from one random offset per source; the document is taken once per integer
    that its share of the sum crosses. Systematic order by size keeps the taken words
    near the target. Words are counted once: sizes and hashes are written to the
    shared folder, and all steps read those.

    Null source: a source of its own. Null or empty text: size 0, taken by rate all
    the same (0 words). Very long text: one row. Null doc_id: allowed; such rows are
    told apart by their texts. Repeated rows count each, and may change places. A
    source of size 0 has target 0. Empty table: no rows.
    """
    slim = stored(_slim(docs), "sizes")
    placed = _placed(slim, slim, weights, cap, seed)
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: each document as often as mix() takes it, with the columns of docs as they are.

    The same choice as mix() makes, also where docs has columns named like its own.
    Whole rows are dealt once, by their cells.
    """
    (row,) = new_names(docs, "row")
    slim = stored(_slim(docs), "sizes")
    taken = _placed(_slim(docs, row), slim, weights, cap, seed).where("copies > 0").select(row, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n"))
    return taken.select(*[F.col(row).getField(c).alias(c) for c in docs.columns])
