"""Reports over records: each returns a dict of DataFrames, one a section."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as L
from ..schema import RANK, SEVERITIES
from ..shared import written

WARNING, ERROR, FATAL = RANK["WARNING"], RANK["ERROR"], RANK["FATAL"]
SAMPLE = 200


_TIME = re.compile(r"(\d{4}-\d\d-\d\d)(?: (\d{1,2}):(\d\d)(?::(\d\d)(?:[.,](\d+))?)?)?|(\d{4}-\d\d-\d\d)T(\d{1,2}):(\d\d):(\d\d)(?:[.,](\d+))?(Z|[+-]\d\d:\d\d)", re.ASCII)


def time_literal(text: str) -> datetime:
    """A date, a date with H:M, H:M:S or H:M:S.fraction, in UTC, or RFC 3339 with its zone; ValueError for anything else."""
    if m := _TIME.fullmatch(text):
        day, hour, minute, second, fraction = (m[1], m[2], m[3], m[4], m[5]) if m[1] else (m[6], m[7], m[8], m[9], m[10])
        zone = "+00:00" if m[11] in (None, "Z") else m[11]
        try:
            return datetime.fromisoformat(f"{day}T{int(hour or 0):02d}:{minute or '00'}:{second or '00'}.{(fraction or '0')[:6]:0<6}{zone}")
        except ValueError:
            pass  # no such day or time
    raise ValueError(f"cannot parse time {text!r}; try 2006-01-02 15:04:05")


def in_range(records: DataFrame, begin=None, end=None) -> DataFrame:
    """Records of begin <= time < end, and those without a time; bounds are time literals or values of a timestamp."""
    keep = F.lit(True)
    begin, end = (time_literal(x) if isinstance(x, str) else x for x in (begin, end))
    if begin is not None:
        keep = keep & (F.col("time") >= F.lit(begin))
    if end is not None:
        keep = keep & (F.col("time") < F.lit(end))
    return records.where(F.col("time").isNull() | keep)


def problems(records: DataFrame) -> DataFrame:
    return records.where(F.col("severity_rank") >= WARNING)


def slow_records(records: DataFrame, min_ns: int = 0) -> DataFrame:
    return records.where(F.col("duration_ns").isNotNull() & ((F.lit(min_ns) == 0) | (F.col("duration_ns") >= min_ns)))


def kind_of(records: DataFrame) -> DataFrame:
    return records.withColumn("kind", L.classify())


def _sample(c: Column) -> Column:
    return L.truncate_bytes(L.one_line(c), SAMPLE)


def _first(c: Column) -> Column:
    return F.min_by(c, F.struct("file", F.coalesce("offset", F.lit(0)), F.coalesce("session_line_num", F.lit(0))))


def top_by_count(df: DataFrame, key: Column, top: int, sample: Column | None = None) -> DataFrame:
    more = [_first(sample).alias("sample")] if sample is not None else []
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("count"), *more).orderBy(F.desc("count"), "key").limit(top)


def stats(records: DataFrame) -> dict[str, DataFrame]:
    by_severity = records.groupBy(F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"), "severity_rank").count().orderBy(F.desc("severity_rank"))
    return {"severity": by_severity, "kind": kind_of(records).groupBy("kind").count(), "summary": records.agg(F.count("*").alias("records"), F.count_if(F.col("severity").isNull()).alias("unknown"))}


def errors(records: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    p = problems(records)
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES if RANK[s] >= WARNING]
    return {
        "summary": p.agg(F.count("*").alias("total"), *counts),
        "message": top_by_count(p, L.normalize_message(F.coalesce("message", F.lit(""))), top, _sample(F.col("message"))),
        "sqlstate": top_by_count(p.where("sql_state IS NOT NULL"), F.col("sql_state"), top),
    }


def slow(records: DataFrame, top: int = 10, min_ns: int = 0) -> dict[str, DataFrame]:
    """Durations count in whole milliseconds, cut off in each record."""
    s = slow_records(records, min_ns).withColumn("ms", F.expr("duration_ns div 1000000"))
    text = L.statement_text()
    groups = s.groupBy(L.normalize_message(text).alias("key")).agg(F.count("*").alias("count"), F.sum("ms").alias("total_ms"), F.max("ms").alias("worst_ms"), _first(_sample(text)).alias("sample"))
    total = F.coalesce(F.sum("ms"), F.lit(0))
    return {
        "summary": s.agg(F.count("*").alias("count"), total.alias("total_ms"), F.when(F.count("*") > 0, F.floor(total / F.count("*"))).otherwise(0).alias("mean_ms")),
        "slowest": groups.orderBy(F.desc("worst_ms"), "key").limit(top),
        "total": groups.orderBy(F.desc("total_ms"), "key").limit(top),
    }


def connections(records: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    c = kind_of(records).where(F.col("kind").isin("connection", "disconnection"))
    begun = c.where(F.col("kind") == "connection")
    fallback = lambda col, key: F.coalesce(L.nonempty(F.col(col)), L.nonempty(L.field_after(F.col("message"), key)))
    sides = {"database": fallback("database", "database="), "user": fallback("user", "user="), "application": L.nonempty(F.col("application_name")), "client": L.nonempty(L.client_host(F.col("connection_from")))}
    is_connection, failed = F.col("kind") == "connection", F.col("severity_rank") >= ERROR
    return {"summary": c.agg(F.count_if(is_connection & ~failed).alias("connects"), F.count_if(is_connection & failed).alias("failures"), F.count_if(~is_connection).alias("disconnects"))} | {
        f"by_{name}": top_by_count(begun.withColumn("side", side).where("side IS NOT NULL"), F.col("side"), top) for name, side in sides.items()
    }


def locks(records: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    x = kind_of(records).where(F.col("kind").isin("lock_wait", "deadlock", "recovery_conflict"))
    target = x.withColumn("target", L.nonempty(L.lock_target(F.col("message")))).where("target IS NOT NULL")
    return {
        "summary": x.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("lock_wait", "deadlock", "recovery_conflict")]),
        "target": top_by_count(target, F.col("target"), top),
        "database": top_by_count(x.where(L.nonempty(F.col("database")).isNotNull()), F.col("database"), top),
        "message": top_by_count(x, L.normalize_message(F.coalesce("message", F.lit(""))), top, _sample(F.col("message"))),
    }


def peaks(records: DataFrame, bucket: str = "10 minutes", top: int | None = 10) -> dict[str, DataFrame]:
    b = records.where("time IS NOT NULL").groupBy(F.window("time", bucket).start.alias("start")).agg(
        F.count("*").alias("records"), F.count_if(F.col("severity_rank") >= WARNING).alias("problems"), F.count_if(F.col("duration_ns").isNotNull()).alias("slow"))
    return {"buckets": b if top is None else b.orderBy(F.desc("records"), "start").limit(top), "summary": records.agg(F.count_if(F.col("time").isNull()).alias("undated"), F.count("time").alias("dated"))}


def system(records: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    x = kind_of(records)
    routine = ("checkpoint", "autovacuum", "temp_file")
    event = (F.col("kind") == "system") | (~F.col("kind").isin(*routine) & (F.col("severity_rank") >= FATAL))
    size = F.when(F.col("kind") == "temp_file", L.temp_file_size(F.col("message"))).otherwise(0)
    return {
        "summary": x.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in routine], F.coalesce(F.sum(size), F.lit(0)).alias("temp_bytes")),
        "events": x.where(event).orderBy("file", "offset", "session_line_num").limit(top).select("time", "severity", "kind", _sample(F.col("message")).alias("message")),
    }


def grep(records: DataFrame, needle: str, before: int = 0, after: int = 0, ignore_case: bool = False, invert: bool = False, order: tuple[str, ...] = ("file", "offset")) -> DataFrame:
    """Records whose raw text holds needle, with records around; `hit` marks the matches.

    Without context there is no shuffle. With it, order runs over all input, as context crosses
    files: records are numbered by one range partitioning, and each hit asks for the numbers around it.
    """
    raw = F.lower("raw") if ignore_case else F.col("raw")
    hit = F.contains(raw, F.lit(needle.lower() if ignore_case else needle))
    marked = records.withColumn("hit", ~hit if invert else hit)
    if not before and not after:
        return marked.where("hit")
    columns = marked.columns
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(marked.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "grep")  # task in the high bits, then the row in it
    task = F.shiftright("__at", 33)
    # One row a task; the window sees no more.
    rows = placed.groupBy(task.alias("task")).agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")
    placed = placed.join(F.broadcast(rows.select("task", start.alias("__shift"))), task == F.col("task")).withColumn("__no", F.col("__at") + F.col("__shift")).select(*columns, "__no")
    near = placed.where("hit").select(F.explode(F.sequence(F.col("__no") - before, F.col("__no") + after)).alias("__no")).distinct()
    return placed.join(near, "__no", "left_semi").select(*columns)


def template_groups(records: DataFrame, top: int | None = None) -> DataFrame:
    """Counts by template; the template is worked out once for each distinct message."""
    from ..functions.template import message_template

    distinct = records.groupBy("severity", "sql_state", "message").agg(F.count("*").alias("count"))
    t = distinct.withColumn("template", message_template(F.coalesce("message", F.lit("")), F.coalesce("sql_state", F.lit(""))))
    out = t.groupBy(L.pattern_id(F.col("severity"), F.col("sql_state"), F.col("template")).alias("pattern_id"), "template").agg(F.sum("count").alias("count"))
    return out if top is None else out.orderBy(F.desc("count"), "pattern_id").limit(top)


def rfc3339(c: str) -> Column:
    """A timestamp with as many digits of its fraction as it needs."""
    fraction = F.rtrim(F.date_format(c, ".SSSSSS"), F.lit("0"))
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == ".", "").otherwise(fraction), F.date_format(c, "XXX"))


def ndjson(records: DataFrame, flags: bool = False) -> DataFrame:
    """One JSON object a record, fields in fixed order; empty and zero values are left out. With flags, those of the record too."""
    zero = lambda c: F.nullif(F.col(c), F.lit(0)).alias(c)
    some = lambda *names: [L.nonempty(F.col(c)).alias(c) for c in names]
    fields = [*[rfc3339(c).alias(c) for c in ("time", "session_start")], *some("severity", "raw_severity", "user", "database", "connection_from", "application_name", "backend_type", "command_tag"),
              zero("process_id"), zero("leader_pid"), *some("session_id"), zero("session_line_num"), *some("virtual_xid"), zero("transaction_id"), zero("query_id"), *some("sql_state", "message", "detail", "hint", "query", "internal_query", "context", "statement"),
              zero("query_pos"), zero("internal_query_pos"), *some("location"), F.when(F.col("duration_ns") > 0, (F.col("duration_ns") / 1e6).cast("decimal(20,3)")).alias("duration_ms"), *([zero("flags")] if flags else []), zero("offset")]
    return records.select(F.to_json(F.struct(*fields)).alias("value"))
