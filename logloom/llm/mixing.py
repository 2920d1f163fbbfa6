"""Mixing of sources to target weights by systematic sampling.

Within a source, documents stand in order of size, each with the same expected number of copies;
a document is emitted once for every whole number that the running sum, started at one random
offset, passes. As sizes ascend, the words taken miss the target by about one document.

The order is one range partitioning over (source, size, id), so a source of any share is spread
over many tasks; ranks come from row counts of (source, task), a table of tasks plus sources rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shuffle_partitions, written


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 20, carry: tuple[str, ...] = (), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How many copies of each document the mix takes.

    Returns a row per row of docs: <id_col>, source, size long (words), source_size long, target
    double (of its source), copies long, and the columns named in carry as struct `row`. Sources
    in order of code point, null last, weigh `weights` in turn and share all words; a target stops
    at cap times its source's size, and the excess goes to the others by weight. Equal sizes go by
    id, nulls first; repeated rows count each. A source without words takes nothing. No rows in,
    no rows out.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *([F.struct(*carry).alias("row")] if carry else []))
    order = [F.col("source").asc_nulls_last(), "size", F.col("id").asc_nulls_first()]
    ordered = base.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "mix")  # task in the high bits, then the row in it
    task = F.shiftright("at", 33)
    parts = ordered.groupBy("source", task.alias("task")).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("rank", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first"))
    sources = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    sources = sources.withColumn("offset", unit).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    known = parts.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("task").alias("t"), "rank", "source_size", "target", "offset", "rate")
    i = F.col("at") + F.col("rank")
    passed = lambda k: F.floor(F.col("offset") + k * F.col("rate"))
    out = ordered.join(known, F.col("source").eqNullSafe(F.col("s")) & (task == F.col("t")))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (passed(i + 1) - passed(i)).alias("copies"), *(["row"] if carry else []))


def targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """sources (source, source_size) with their target; a few rows, one a source.

    Sources go by the share of their cap that one unit of weight fills. The first that one level,
    made of what those before leave over, does not fill gives the level for it and all after.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w.cast("long")).withColumn("most", cap * F.col("source_size"))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("before", F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weights", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))).withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("level", (F.col("total") - F.col("before")).cast("double") / F.col("weights"))
    s = s.withColumn("level", F.when(F.col("most") >= F.col("level") * F.col("weight"), F.col("level")))
    level = F.first("level", ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.withColumn("level", level).select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken."""
    rows = mix(docs, carry=tuple(docs.columns), **options).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
