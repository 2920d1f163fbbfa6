"""Filter interaction audit: what every order of a set of filters would remove, from one pass.

A document counts by the set of filters that it fails. In the lattice of sets of filters already
applied, an edge is (set applied before, next filter): 80 edges for five filters. Each failing set
is summed once, contributes to all edges, and an order of filters is a path of edges from the empty
set; the 600 steps of the 120 orders are a join with the summed edges. Documents meet only in counts
that are summed before every shuffle; equal texts meet as one row for each part.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small

#: What a condition on a document may look at; `words` is computed once.
Condition = Callable[[Column, Column], Column]

#: Failure conditions over (text, words), in bit order. COPY stands for "equal to the text of a smaller id".
FILTERS: dict[str, Condition | None] = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda text, words: 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 10 * F.length(text),
    "D": lambda text, words: text.rlike(r"[#$%&*|]"),
    "E": None,
}
COPY = None

_COUNTS = ("n", "good", "toxic")


def failing_sets(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Condition | None] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part string, mask int, n, good, toxic long): documents by the set of filters that they fail, a bit each.

    A null text is empty and a null part is ''. A row whose id is null has no smaller id and is none;
    rows of one id and text are copies of neither. Rows count each, repeated ones too. good and toxic
    count rows whose id has a label row of quality 1 or toxic 1; a null id has no label. labels has
    doc_id, quality and toxic, repeated rows allowed. No rows in, no rows out.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(text_col, F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values()) if fails is not COPY]
    copy = sum(1 << i for i, fails in enumerate(filters.values()) if fails is COPY)
    d = d.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, F.lit(0)).cast("int").alias("mask"))

    has = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long"))
    l = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(has("quality").alias("good"), has("toxic").alias("toxic"))
    # One row for each id and text in a part: rows of the smallest id are then one row.
    d = d.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n")).join(broadcast_if_small(l), F.col("id") == F.col("label_id"), "left")
    d = d.select("digest", "id", "part", "mask", "n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")])
    counts = F.struct(*_COUNTS)
    d = d.groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in _COUNTS],
        F.struct(*[F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(c) for c in _COUNTS]).alias("no_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", counts.alias("of")))).alias("least"),
    )
    # At most a row for each part meets here for a text.
    first = F.min("least.id").over(Window.partitionBy("digest"))
    own = lambda c: F.col(f"no_id.{c}") + F.when(F.col("first") == F.col("least.id"), F.col(f"least.of.{c}")).otherwise(0)
    d = d.withColumn("first", first)
    as_first = F.struct(F.col("mask").alias("mask"), *[own(c).alias(c) for c in _COUNTS])
    as_copy = F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), *[(F.col(c) - own(c)).alias(c) for c in _COUNTS])
    return d.select("part", F.explode(F.array(as_first, as_copy)).alias("x")).groupBy("part", "x.mask").agg(*[F.sum(f"x.{c}").alias(c) for c in _COUNTS])


def edges(sets: DataFrame, k: int) -> DataFrame:
    """Sums of failing sets on every edge: (part, before int, bit int, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley long).

    before is the set applied so far and bit the next filter's. shapley sums what the filter removes
    over all orders of the k filters: each edge as often as orders pass it. Every part has all
    k * 2^(k-1) edges, zeros included.
    """
    lattice = [(before, 1 << i, factorial(before.bit_count()) * factorial(k - 1 - before.bit_count())) for i in range(k) for before in range(1 << k) if not before >> i & 1]
    edge = F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(bit).alias("bit"), F.lit(w).cast("long").alias("paths")) for b, bit, w in lattice]))
    x = sets.select("part", "mask", *_COUNTS, edge.alias("e")).select("part", "mask", *_COUNTS, "e.*")
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    total = lambda when, c="n": F.sum(F.when(when, F.col(c)).otherwise(0))
    x = x.groupBy("part", "before", "bit", "paths").agg(
        total(~gone & ~fails).alias("kept"), total(~gone & fails).alias("removed"), total(gone & fails).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"), total(~gone & fails, "toxic").alias("toxic_lost"),
    )
    return x.withColumn("shapley", F.sum(F.col("removed") * F.col("paths")).over(Window.partitionBy("part", "bit"))).drop("paths")


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Condition | None] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order string, step int, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley long), a row for each step of each order in each part.

    Rules for nulls, ties and repeated rows are those of failing_sets. Names of filters are one letter each.
    """
    spark, names = docs.sparkSession, list(filters)
    steps = [("".join(p), i + 1, 1 << names.index(f), sum(1 << names.index(g) for g in p[:i])) for p in permutations(names) for i, f in enumerate(p)]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, bit int, before int"))
    found = edges(failing_sets(docs, labels, filters, id_col, text_col, part_col), len(names))
    return found.join(steps, ["before", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
