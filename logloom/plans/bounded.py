"""Top lists in bounded memory: a mergeable heavy-hitter summary with a stated error.

Every task keeps at most `capacity` groups. When more come, all counts are lowered by the largest
count that has no place left, and groups that reach zero are dropped (Misra and Gries; Agarwal and
others for merging). Summaries merge by adding counts by key. A count is too low by what was taken
off in all tasks together, `error`, which is at most records / (capacity + 1); so a group that occurs
more often than that is never missing. Tasks hand on a bounded number of rows, whatever the keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups kept for each row that is reported.
FACTOR = 32

_SCHEMA = pa.schema([("key", pa.string()), ("count", pa.int64()), ("total", pa.int64()), ("worst", pa.int64()), ("sample", pa.string()), ("error", pa.int64()), ("dropped", pa.int64())])


class Summary:
    """Counts of at most `capacity` keys: [count, total, worst, sample] since a key came in last."""

    def __init__(self, capacity: int):
        self.capacity, self.groups = capacity, {}
        self.error = self.dropped = 0

    def add(self, key: str | None, count: int, total: int | None, worst: int | None, sample: str | None) -> None:
        g = self.groups.get(key)
        if g is None:
            self.groups[key] = [count, total, worst, sample]
        else:
            g[0] += count
            g[1] = total if g[1] is None else g[1] if total is None else g[1] + total
            g[2] = max((x for x in (g[2], worst) if x is not None), default=None)
            if len(self.groups) <= self.capacity:
                return
        if len(self.groups) > 2 * self.capacity:  # seldom, so that one look costs little for each key
            self.shrink()

    def shrink(self) -> None:
        if len(self.groups) <= self.capacity:
            return
        least = sorted((g[0] for g in self.groups.values()), reverse=True)[self.capacity]
        kept = {k: [g[0] - least, *g[1:]] for k, g in self.groups.items() if g[0] > least}
        self.dropped += len(self.groups) - len(kept)
        self.error += least
        self.groups = kept


def summaries(df: DataFrame, key: Column, capacity: int, value: Column | None = None, sample: Column | None = None) -> DataFrame:
    """(key, count, total, worst, sample, error, dropped): each task's groups, and a row without count for what it took off."""
    null = lambda kind: F.lit(None).cast(kind)
    rows = df.select(key.cast("string").alias("key"), (null("long") if value is None else value.cast("long")).alias("value"), (null("string") if sample is None else sample).alias("sample"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Summary(capacity)
        for batch in batches:
            by = pa.table(batch).group_by("key", use_threads=False).aggregate([([], "count_all"), ("value", "sum"), ("value", "max"), ("sample", "first")])
            for row in zip(*(by[c].to_pylist() for c in ("key", "count_all", "value_sum", "value_max", "sample_first")), strict=True):
                s.add(*row)
        s.shrink()
        columns = list(zip(*((k, *g, None, None) for k, g in s.groups.items()), strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array([*c, x], f.type) for c, f, x in zip(columns, _SCHEMA, (None, None, None, None, None, s.error, s.dropped), strict=True)], schema=_SCHEMA)

    return rows.mapInArrow(run, "key string, count bigint, total bigint, worst bigint, sample string, error bigint, dropped bigint")


def top_bounded(df: DataFrame, key: Column, top: int = 10, value: Column | None = None, sample: Column | None = None, factor: int = FACTOR) -> dict[str, DataFrame]:
    """{"top": (key, count, total, worst, sample), "summary": (error, dropped)}: the most frequent groups, ties by key.

    A true count lies in [count, count + error]; total and worst are of the records since a group came
    in, so no more than the true ones. dropped counts groups that lost their place, in all tasks. A
    null key is a group. Without records the list is empty and error 0.
    """
    s = summaries(df, key, top * factor, value, sample)
    groups = s.where("count IS NOT NULL").groupBy("key").agg(F.sum("count").alias("count"), F.sum("total").alias("total"), F.max("worst").alias("worst"), F.min("sample").alias("sample"))
    return {"top": groups.orderBy(F.desc("count"), "key").limit(top), "summary": s.where("count IS NULL").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("error"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))}
