"""Checkable queries: events rendered as log lines, parsed back, and reported on; with SQL over the events."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as L
from . import plans
from .functions.template import with_template
from .operators import bad_records, good_records, parse_lines
from .schema import CSV_COLUMNS, LOCALES, ZONES, LogReadOptions
from .plans.bounded import top_bounded
from .shared import shared_dir
from .sources.files import Remote, read_log
from .sources.render import LINES, PREFIX, csv_lines, json_lines
from .sources.stores import FileStore


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, format_: str = "json") -> DataFrame:
    return good_records(parse_lines(LINES[format_](_table(spark, sf_dir, "events")), LogReadOptions(format_, PREFIX)))


_PARSED = ("process_id", "user", "database", "severity", "sql_state", "message", "detail", "query", "duration_ns")


def _parsed(r: DataFrame, *more) -> DataFrame:
    return r.select(F.col("time").cast("timestamp_ntz").alias("time"), *_PARSED, *more)


# The events as records, in SQL: (condition, message, severity, SQLSTATE, kind, normalised message, template).
_N, _U, _D = "(event_id % 97)", "'u' || user_id", "'db' || (user_id % 3)"
_LETTER = "chr(CAST(97 + event_id % 5 AS INTEGER))"
_LOCK = "CASE WHEN event_id % 2 = 0 THEN 'Share' ELSE 'Exclusive' END"
_SHAPES = (
    ("event_type = 'view'", f"'duration: ' || CAST(value AS DECIMAL(18,3)) || ' ms  statement: SELECT * FROM t_' || {_LETTER} || ' WHERE id = ' || event_id", "LOG", "00000", "slow", f"'duration: ?.? ms  statement: SELECT * FROM t_' || {_LETTER} || ' WHERE id = ?'", f"'duration: $1 statement: SELECT * FROM t_' || {_LETTER} || ' WHERE id = $2'"),
    ("event_type = 'click' AND event_id % 7 = 3", f"'disconnection: session time: 0:00:0' || (event_id % 10) || '.000 user=' || {_U} || ' database=' || {_D}", "LOG", "00000", "disconnection", "NULL", "'disconnection: session time: $1:$2:$3 user=$4 database=$5'"),
    ("event_type = 'click' AND event_id % 7 = 5", f"'password authentication failed for user \"' || {_U} || '\"'", "FATAL", "28P01", "connection", "'password authentication failed for user ?'", f"'password authentication failed for user \"' || {_U} || '\"'"),
    ("event_type = 'click'", f"'connection authorized: user=' || {_U} || ' database=' || {_D}", "LOG", "00000", "connection", "NULL", "'connection authorized: user=$1 database=$2'"),
    ("event_type = 'purchase' AND event_id % 3 = 0", f"'process ' || event_id || ' still waiting for ' || {_LOCK} || 'Lock on transaction ' || {_N}", "WARNING", "01000", "lock_wait", f"'process ? still waiting for ' || {_LOCK} || 'Lock on transaction ?'", f"'process $1 still waiting for ' || {_LOCK} || 'Lock on transaction $2'"),
    ("event_type = 'purchase'", "'there is already a transaction in progress'", "WARNING", "01000", "other", "'there is already a transaction in progress'", "'there is already a transaction in progress'"),
    ("event_type = 'error' AND event_id % 5 = 0", "'deadlock detected'", "ERROR", "40P01", "deadlock", "'deadlock detected'", "'deadlock detected'"),
    ("event_type = 'error' AND event_id % 5 = 1", "'canceling statement due to conflict with recovery'", "ERROR", "57014", "recovery_conflict", "'canceling statement due to conflict with recovery'", "'canceling statement due to conflict with recovery'"),
    ("event_type = 'error'", f"'relation \"t_' || {_N} || '\" does not exist'", "ERROR", "42P01", "other", "'relation ? does not exist'", f"'relation \"t_' || {_N} || '\" does not exist'"),
    ("event_id % 9 = 0", "'checkpoint starting: time'", "LOG", "00000", "checkpoint", "NULL", "'checkpoint starting: time'"),
    ("event_id % 9 = 1", f"'restartpoint complete: wrote ' || {_N} || ' buffers'", "LOG", "00000", "checkpoint", "NULL", "'restartpoint complete: wrote $1 buffers'"),
    ("event_id % 9 = 2", f"'automatic vacuum of table \"' || {_D} || '.public.t\": index scans: ' || {_N}", "LOG", "00000", "autovacuum", "NULL", f"'automatic vacuum of table \"' || {_D} || '.public.t\": index scans: $1'"),
    ("event_id % 9 = 3", "'database system is ready to accept connections'", "LOG", "00000", "system", "NULL", "'database system is ready to accept connections'"),
    ("event_id % 9 = 4", "'could not write to file \"pg_wal/xlogtemp.' || event_id || '\"'", "PANIC", "53100", "other", "'could not write to file ?'", "'could not write to file $1'"),
    ("TRUE", "'temporary file: path \"base/pgsql_tmp/pgsql_tmp' || (1000 + user_id) || '.0\", size ' || (event_id * 1024)", "LOG", "00000", "temp_file", "NULL", "'temporary file: path $1, size $2'"),
)


def _shape(at: int) -> str:
    return "CASE " + " ".join(f"WHEN {s[0]} THEN " + (s[at] if at in (1, 5, 6) else f"'{s[at]}'") for s in _SHAPES) + " END"


E = f"""
WITH r AS (
  SELECT event_id, ts AS time, CAST(1000 + user_id AS INTEGER) AS process_id, 'u' || user_id AS "user", 'db' || (user_id % 3) AS "database", '10.0.0.' || (user_id % 250) AS host,
    {_shape(1)} AS message, {_shape(2)} AS severity, {_shape(3)} AS sql_state, {_shape(4)} AS kind, {_shape(5)} AS norm, {_shape(6)} AS template,
    CASE WHEN event_id % 10 = 0 THEN 'first part of ' || event_id || ', "quoted"' || chr(10) || chr(9) || 'second part' END AS detail,
    CASE WHEN event_type = 'error' THEN 'SELECT * FROM t_' || (event_id % 97) END AS query,
    CASE WHEN event_type = 'view' THEN CAST(CAST(value AS DECIMAL(18,3)) * 1000000 AS BIGINT) END AS duration_ns
  FROM events
)
"""
_COLUMNS = 'time, process_id, "user", "database", severity, sql_state, message, detail, query, duration_ns'
_TOP = "ORDER BY count DESC, key LIMIT 10"

QUERIES, SQL = {}, {}


def _query(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


for _f in LINES:
    _query(f"parse_{_f}log" if _f != "stderr" else "parse_stderr", lambda s, d, f=_f: _parsed(records(s, d, f)), E + f"SELECT {_COLUMNS} FROM r")
for _n in (23, 24, 26):
    _query(f"csvlog_layout_{_n}", lambda s, d, n=_n: _parsed(good_records(parse_lines(csv_lines(_table(s, d, "events"), n), LogReadOptions("csv"))), "backend_type", "query_id"),
           E + f"SELECT {_COLUMNS}, {'CAST(NULL AS VARCHAR)' if _n == 23 else chr(39) + 'client backend' + chr(39)} AS backend_type, CAST(NULL AS BIGINT) AS query_id FROM r")


def _disagreements(s: SparkSession, d: str) -> DataFrame:
    """Rows that jsonlog has more often than another format, or less often: each format is parsed once, equal rows meet once."""
    by = {f: F.col(f"n_{f}") for f in LINES}
    each = [_parsed(records(s, d, f)).select("*", *[F.lit(int(f == x)).alias(f"n_{x}") for x in LINES]) for f in LINES]
    same = reduce(DataFrame.unionByName, each).groupBy("time", *_PARSED).agg(*[F.sum(n).alias(f"n_{f}") for f, n in by.items()])
    return same.agg(F.coalesce(F.sum(F.abs(by["json"] - by["csv"]) + F.abs(by["json"] - by["stderr"])), F.lit(0)).alias("differences"))


_query("tri_format_agree", _disagreements, "SELECT CAST(0 AS BIGINT) AS differences")
_query("stats_severity", lambda s, d: plans.stats(records(s, d))["severity"].select("severity", "count"), E + "SELECT severity, count(*) AS count FROM r GROUP BY severity")
_query("stats_kinds", lambda s, d: plans.stats(records(s, d))["kind"], E + "SELECT kind, count(*) AS count FROM r GROUP BY kind")
_query("errors_total", lambda s, d: plans.errors(records(s, d))["summary"], E + "SELECT count(*) AS total, count(*) FILTER (severity = 'WARNING') AS warning, count(*) FILTER (severity = 'ERROR') AS error, count(*) FILTER (severity = 'FATAL') AS fatal, count(*) FILTER (severity = 'PANIC') AS panic FROM r WHERE severity <> 'LOG'")
_query("errors_top_messages", lambda s, d: plans.errors(records(s, d))["message"], E + f"SELECT norm AS key, count(*) AS count, arg_min(message, event_id) AS sample FROM r WHERE severity <> 'LOG' GROUP BY norm {_TOP}")
_query("errors_sqlstate", lambda s, d: plans.errors(records(s, d))["sqlstate"], E + f"SELECT sql_state AS key, count(*) AS count FROM r WHERE severity <> 'LOG' GROUP BY sql_state {_TOP}")
_MS = "duration_ns // 1000000"
_query("slow_summary", lambda s, d: plans.slow(records(s, d))["summary"], E + f"SELECT count(*) AS count, CAST(sum({_MS}) AS BIGINT) AS total_ms, CAST(sum({_MS}) // count(*) AS BIGINT) AS mean_ms FROM r WHERE duration_ns IS NOT NULL")
_query("slow_min_duration", lambda s, d: plans.slow(records(s, d, "csv"), min_ns=50_000_000)["summary"], E + f"SELECT count(*) AS count, CAST(coalesce(sum({_MS}), 0) AS BIGINT) AS total_ms, CAST(CASE WHEN count(*) > 0 THEN sum({_MS}) // count(*) ELSE 0 END AS BIGINT) AS mean_ms FROM r WHERE duration_ns >= 50000000")
_GROUPS = f"SELECT norm AS key, count(*) AS count, CAST(sum({_MS}) AS BIGINT) AS total_ms, max({_MS}) AS worst_ms, arg_min(replace(message, '  ', '  '), event_id) AS sample FROM r WHERE duration_ns IS NOT NULL GROUP BY norm"
_query("slow_slowest", lambda s, d: plans.slow(records(s, d))["slowest"], E + _GROUPS + " ORDER BY worst_ms DESC, key LIMIT 10")
_query("slow_total", lambda s, d: plans.slow(records(s, d))["total"], E + _GROUPS + " ORDER BY total_ms DESC, key LIMIT 10")
_query("connections_events", lambda s, d: plans.connections(records(s, d))["summary"], E + "SELECT count(*) FILTER (kind = 'connection' AND severity = 'LOG') AS connects, count(*) FILTER (kind = 'connection' AND severity = 'FATAL') AS failures, count(*) FILTER (kind = 'disconnection') AS disconnects FROM r")
for _side, _sql in (("database", '"database"'), ("user", '"user"'), ("application", "'psql'"), ("client", "host")):
    _query(f"connections_by_{_side}", lambda s, d, x=_side: plans.connections(records(s, d))[f"by_{x}"], E + f"SELECT {_sql} AS key, count(*) AS count FROM r WHERE kind = 'connection' GROUP BY 1 {_TOP}")
_query("locks_summary", lambda s, d: plans.locks(records(s, d))["summary"], E + "SELECT count(*) FILTER (kind = 'lock_wait') AS lock_wait, count(*) FILTER (kind = 'deadlock') AS deadlock, count(*) FILTER (kind = 'recovery_conflict') AS recovery_conflict FROM r")
_query("locks_target", lambda s, d: plans.locks(records(s, d))["target"], E + f"SELECT CASE WHEN event_id % 2 = 0 THEN 'Share' ELSE 'Exclusive' END || 'Lock on transaction' AS key, count(*) AS count FROM r WHERE kind = 'lock_wait' GROUP BY 1 {_TOP}")
_query("locks_database", lambda s, d: plans.locks(records(s, d))["database"], E + f"SELECT \"database\" AS key, count(*) AS count FROM r WHERE kind IN ('lock_wait', 'deadlock', 'recovery_conflict') GROUP BY 1 {_TOP}")
_query("locks_message", lambda s, d: plans.locks(records(s, d))["message"], E + f"SELECT norm AS key, count(*) AS count, arg_min(message, event_id) AS sample FROM r WHERE kind IN ('lock_wait', 'deadlock', 'recovery_conflict') GROUP BY norm {_TOP}")
for _name, _b, _i in (("peaks_10m", "10 minutes", "10 minutes"), ("peaks_1h", "1 hour", "1 hour")):
    _query(_name, lambda s, d, b=_b: plans.peaks(records(s, d), b)["buckets"].withColumn("start", F.col("start").cast("timestamp_ntz")),
           E + f"SELECT time_bucket(INTERVAL '{_i}', time) AS start, count(*) AS records, count(*) FILTER (severity <> 'LOG') AS problems, count(duration_ns) AS slow FROM r GROUP BY 1 ORDER BY records DESC, start LIMIT 10")
_query("system_summary", lambda s, d: plans.system(records(s, d))["summary"], E + "SELECT count(*) FILTER (kind = 'checkpoint') AS checkpoints, count(*) FILTER (kind = 'autovacuum') AS autovacuums, count(*) FILTER (kind = 'temp_file') AS temp_files, CAST(coalesce(sum(event_id * 1024) FILTER (kind = 'temp_file'), 0) AS BIGINT) AS temp_bytes FROM r")
_query("system_events", lambda s, d: plans.system(records(s, d))["events"].withColumn("time", F.col("time").cast("timestamp_ntz")), E + "SELECT time, severity, kind, message FROM r WHERE kind = 'system' OR (kind NOT IN ('checkpoint', 'autovacuum', 'temp_file') AND severity IN ('FATAL', 'PANIC')) ORDER BY CAST(time AS DATE), event_id LIMIT 10")
_conv = "SELECT conv_id, turn, text FROM conversations WHERE {}"
_grep = lambda s, d: _table(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("raw"))
_query("grep_basic", lambda s, d: plans.grep(_grep(s, d), "the ").select("conv_id", "turn", F.col("raw").alias("text")), _conv.format("contains(text, 'the ')"))
_query("grep_ignore_case", lambda s, d: plans.grep(_grep(s, d), "THE ", ignore_case=True).select("conv_id", "turn", F.col("raw").alias("text")), _conv.format("contains(lower(text), 'the ')"))
_query("grep_invert", lambda s, d: plans.grep(_grep(s, d), "the ", invert=True).select("conv_id", "turn", F.col("raw").alias("text")), _conv.format("NOT contains(text, 'the ')"))
_query("grep_context", lambda s, d: plans.grep(_grep(s, d), "is the in", 1, 2, order=("conv_id", "turn")).select("conv_id", "turn", "hit"),
       "SELECT conv_id, turn, hit FROM (SELECT *, max(CAST(hit AS INTEGER)) OVER (ORDER BY conv_id, turn ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM (SELECT conv_id, turn, contains(text, 'is the in') AS hit FROM conversations)) WHERE near = 1")
_query("time_window", lambda s, d: _parsed(plans.in_range(records(s, d, "stderr"), "2024-01-03 00:00:00", "2024-01-09 12:00:00")), E + f"SELECT {_COLUMNS} FROM r WHERE time >= TIMESTAMP '2024-01-03' AND time < TIMESTAMP '2024-01-09 12:00:00'")
_query("normalize_documents", lambda s, d: _table(s, d, "documents").select("doc_id", F.md5(L.normalize_message(F.col("text"))).alias("h")),
       """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '"[^"]*("|\\z)|''[^'']*(''|\\z)', chr(1), 'g'), '(^|[^0-9\\x01])(\\x01*)[0-9]', '\\1\\2' || chr(2), 'g'), '[0-9]', '', 'g'), '[\\x01\\x02]', '?', 'g')) AS h FROM documents""")  # fmt: skip
_query("one_line_documents", lambda s, d: _table(s, d, "documents").select("doc_id", F.md5(L.one_line(F.col("text"))).alias("h")), "SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[\\n\\r\\t]') THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE text END) AS h FROM documents")
_query("pattern_id", lambda s, d: plans.template_groups(records(s, d).where("severity <> 'LOG'")).select("pattern_id", "count"),
       E + "SELECT substr(sha256(severity || chr(0) || sql_state || chr(0) || '1' || chr(0) || template), 1, 16) AS pattern_id, count(*) AS count FROM r WHERE severity <> 'LOG' GROUP BY 1")


def _dealt(s: SparkSession, d: str, rows: list[tuple], *names: str) -> DataFrame:
    """Events, each with one of the rows of text, in turn."""
    each = F.get(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rows]), (F.col("event_id") % len(rows)).cast("int"))
    return _table(s, d, "events").select("event_id", "ts", each.alias("r")).select("event_id", "ts", "r.*")


_LABELS = [(lang, raw) for lang, t in LOCALES.items() for raw in [*t, "no such"]]


def _localised(s: SparkSession, d: str) -> DataFrame:
    x = _dealt(s, d, _LABELS, "lang", "raw")
    severity = F.coalesce(*[F.when(F.col("lang") == lang, L.severity(F.col("raw"), lang)) for lang in LOCALES])
    return x.select("event_id", "lang", "raw", severity.alias("severity"))


_query("localised_severity", _localised, "SELECT event_id, lang, raw, severity FROM events JOIN (VALUES " + ", ".join(f"({i}, '{lang}', '{raw}', {chr(39) + LOCALES[lang][raw] + chr(39) if raw in LOCALES[lang] else 'NULL'})" for i, (lang, raw) in enumerate(_LABELS)) + f") v(i, lang, raw, severity) ON event_id % {len(_LABELS)} = i")
_ZONES = [(z,) for z in (*ZONES, "+05:30", "-0330", "+02", "NOPE")]


def _minutes(z: str) -> int:
    return ZONES.get(z, {"+05:30": 330, "-0330": -210, "+02": 120}.get(z, 0))


_query("zone_offsets", lambda s, d: _dealt(s, d, _ZONES, "zone").select("event_id", "zone", L.parse_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS "), F.col("zone"))).cast("timestamp_ntz").alias("time")),
       "SELECT event_id, zone, ts - to_minutes(east) AS time FROM events JOIN (VALUES " + ", ".join(f"({i}, '{z}', {_minutes(z)})" for i, (z,) in enumerate(_ZONES)) + f") v(i, zone, east) ON event_id % {len(_ZONES)} = i")


def _carried(s: SparkSession, d: str) -> DataFrame:
    """30 February and second 60, in each year and minute of the events."""
    time = F.concat(F.date_format("ts", "yyyy"), F.lit("-02-30 "), F.date_format("ts", "HH:mm"), F.lit(":60.25 UTC"))
    return _table(s, d, "events").select("event_id", L.parse_timestamp(time).cast("timestamp_ntz").alias("time"))


_query("carried_times", _carried, "SELECT event_id, date_trunc('minute', ts) - date_trunc('day', ts) + (make_date(CAST(year(ts) AS INTEGER), 2, 1) + INTERVAL 29 DAY) + INTERVAL 60 SECOND + INTERVAL 250 MILLISECOND AS time FROM events")
_MORE = lambda: {
    "hint": F.when(F.col("event_id") % 4 == 1, F.concat(F.lit('try "again", '), "session_line_num")), "context": F.when(F.col("event_id") % 6 == 2, F.concat(F.lit("function f"), "process_id", F.lit("()\nline 3"))),
    "location": F.concat(F.lit("exec_"), "process_id", F.lit(", postgres.c:"), (F.col("event_id") % 500 + 1).cast("string")), "session_start": F.concat("day", F.lit(" 00:00:00 CET")),
}
for _f, _lines_of in (("csv", lambda e: csv_lines(e, 26, _MORE())), ("json", lambda e: json_lines(e, _MORE()))):
    _query(f"parse_more_{_f}", lambda s, d, f=_f, of=_lines_of: good_records(parse_lines(of(_table(s, d, "events")), LogReadOptions(f))).select(F.col("session_line_num").alias("n"), "hint", "context", "location", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "connection_from"),
           E + "SELECT event_id AS n, CASE WHEN event_id % 4 = 1 THEN 'try \"again\", ' || event_id END AS hint, CASE WHEN event_id % 6 = 2 THEN 'function f' || process_id || '()' || chr(10) || 'line 3' END AS context, 'exec_' || process_id || ', postgres.c:' || (event_id % 500 + 1) AS location, date_trunc('day', time) - INTERVAL 1 HOUR AS session_start, host || ':' || (event_id % 1000 + 40000) AS connection_from FROM r")
_ANONYMOUS = lambda: {"user": F.lit(""), "database": F.lit("")}
for _side, _key in (("user", '"user"'), ("database", '"database"')):
    _query(f"connections_{_side}_of_message", lambda s, d, x=_side: plans.connections(good_records(parse_lines(csv_lines(_table(s, d, "events"), 26, _ANONYMOUS()), LogReadOptions("csv"))))[f"by_{x}"], E + f"SELECT {_key} AS key, count(*) AS count FROM r WHERE kind = 'connection' AND severity = 'LOG' GROUP BY 1 {_TOP}")


def _broken(s: SparkSession, d: str) -> DataFrame:
    lines = LINES["json"](_table(s, d, "events"))
    cut = lines.withColumn("line", F.when(F.col("seq") % 112 == 0, F.expr("left(line, length(line) - 5)")).otherwise(F.col("line")))
    nested = cut.withColumn("line", F.when(F.col("seq") % 176 == 16, F.expr("left(line, length(line) - 1) || ',\"x\":{\"y\":[1]}}'")).otherwise(F.col("line")))
    large = nested.withColumn("line", F.when(F.col("seq") % 208 == 48, F.expr("left(line, length(line) - 1) || ',\"x\":\"' || repeat('y', 2000) || '\"}'")).otherwise(F.col("line")))
    parsed = parse_lines(large, LogReadOptions("json", max_record_bytes=1500))
    return bad_records(parsed).groupBy("reason").count()


# seq is 16 times the event's id; a record both cut or nested and large is large.
_query("malformed_side_output", _broken, "SELECT CASE WHEN event_id % 13 = 3 THEN 'over-large record' ELSE 'bad json' END AS reason, count(*) AS count FROM events WHERE event_id % 13 = 3 OR event_id % 7 = 0 OR event_id % 11 = 1 GROUP BY 1")
_query("template_groups", lambda s, d: plans.template_groups(records(s, d)).select("template", "count"), E + "SELECT template, count(*) AS count FROM r GROUP BY severity, sql_state, template")
_query("top_patterns", lambda s, d: plans.template_groups(records(s, d, "csv"), 5), E + "SELECT substr(sha256(severity || chr(0) || CASE sql_state WHEN '' THEN '' ELSE sql_state END || chr(0) || '1' || chr(0) || template), 1, 16) AS pattern_id, template, count(*) AS count FROM r GROUP BY 1, 2 ORDER BY count DESC, pattern_id LIMIT 5")
_query("template_documents", lambda s, d: with_template(_table(s, d, "documents").repartition("doc_id"), "text").select("doc_id", "template"), None)
_NDJSON = "time string, process_id int, severity string, message string, detail string, query string, duration_ms decimal(20,3), flags int"


def _ndjson(s: SparkSession, d: str) -> DataFrame:
    """Records written as NDJSON and read back: what is empty or zero is absent."""
    j = F.from_json("value", _NDJSON)
    return plans.ndjson(records(s, d, "csv"), flags=True).select(j.alias("j")).select("j.*")


# A csvlog record needs unquoting where its text doubles a quote; 2 is several lines, 8 a duration, 16 a statement.
_FLAGS = "CASE WHEN contains(message, '\"') OR detail IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN detail IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN duration_ns IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN query IS NOT NULL THEN 16 ELSE 0 END"
_query("parse_ndjson", _ndjson, E + f"SELECT regexp_replace(strftime(time, '%Y-%m-%dT%H:%M:%S.%f'), '[.]?0+$', '') || 'Z' AS time, process_id, severity, message, detail, query, CASE WHEN duration_ns > 0 THEN CAST(duration_ns / 1000000.0 AS DECIMAL(20,3)) END AS duration_ms, nullif({_FLAGS}, 0) AS flags FROM r")
_query("record_flags", lambda s, d: records(s, d, "csv").groupBy("flags").count(), E + f"SELECT {_FLAGS} AS flags, count(*) AS count FROM r GROUP BY 1")
_query("record_lines", lambda s, d: records(s, d).select(F.col("session_line_num").alias("n"), L.record_line().alias("line")),
       E + "SELECT event_id AS n, strftime(time, '%Y-%m-%d %H:%M:%S.%g') || ' ' || severity || ': ' || message || coalesce(' | DETAIL: ' || detail, '') || coalesce(' | STATEMENT: ' || query, '') AS line FROM r")
_query("statements", lambda s, d: records(s, d).groupBy(L.normalize_message(L.statement_text()).alias("key")).count().where("key LIKE 'SELECT%'"), E + "SELECT 'SELECT * FROM t_?' AS key, count(*) AS count FROM r WHERE query IS NOT NULL GROUP BY 1")


def _escaped(s: SparkSession, d: str) -> DataFrame:
    """Messages that begin with escapes that are none, half a surrogate pair and a whole one."""
    lines = LINES["json"](_table(s, d, "events")).withColumn("line", F.replace("line", F.lit('"message":"'), F.lit('"message":"\\q \\u12 \\ud83d \\ude00 \\ud83d\\ude00 \\\\q \\/ ')))
    return good_records(parse_lines(lines, LogReadOptions("json"))).select(F.col("session_line_num").alias("n"), "message")


_query("json_escapes", _escaped, E + "SELECT event_id AS n, '\\q \\u12 ' || chr(65533) || ' ' || chr(65533) || ' ' || chr(128512) || ' \\q / ' || message AS message FROM r")


def _bounded(s: SparkSession, d: str) -> DataFrame:
    """Messages that a summary of 32 groups must have, those it has, and whether its bounds hold for all that it has."""
    r = records(s, d)
    exact = r.groupBy("message").agg(F.count("*").alias("n"))
    found = top_bounded(r, F.col("message"), 32, factor=1)
    one = F.lit(1).alias("one")
    x = exact.join(found["top"].withColumnRenamed("key", "message"), "message", "left").select("*", one)
    x = x.join(F.broadcast(found["summary"].select("*", one)), "one").join(F.broadcast(r.agg(F.count("*").alias("all")).select("*", one)), "one")
    has, due = F.col("count").isNotNull(), F.col("n") * 33 > F.col("all")
    return x.agg(F.count_if(due).alias("due"), F.count_if(due & has).alias("found"), F.bool_and(~has | F.col("n").between(F.col("count"), F.col("count") + F.col("error"))).alias("within"), F.bool_and(F.col("error") * 33 <= F.col("all")).alias("small"), (F.max("dropped") > 0).alias("dropped"))


_query("top_bounded", _bounded, E + ", x AS (SELECT count(*) AS n FROM r GROUP BY message), y AS (SELECT count(*) FILTER (n * 33 > (SELECT count(*) FROM r)) AS due FROM x) SELECT due, due AS found, TRUE AS within, TRUE AS small, TRUE AS dropped FROM y")


#: Events whose records make up one written log file; four files at least.
_PER_FILE = 50_000


def _written(s: SparkSession, d: str, lines: Callable[[DataFrame], DataFrame]) -> str:
    """Log files of the events' lines, more of them for more events. Events are dealt, so that a record's lines stay together."""
    path = f"{shared_dir(s)}/logloom-rendered-{uuid.uuid4().hex}"
    events = _table(s, d, "events")
    dealt = events.repartition(max(4, -(-events.count() // _PER_FILE)), "event_id")
    lines(dealt).sortWithinPartitions("file", "seq").select("line").write.text(path)
    return path


def _files(s: SparkSession, d: str, format_: str, split_bytes: int) -> DataFrame:
    """Records of log files written from the events, read in many small ranges."""
    return read_log(s, _written(s, d, LINES[format_]), LogReadOptions("auto", PREFIX), glob="*", split_bytes=split_bytes)


for _f in LINES:
    _query(f"scan_{_f}", lambda s, d, f=_f: _parsed(_files(s, d, f, 50_000)), E + f"SELECT {_COLUMNS} FROM r")
_CSV = {"log_time": "strftime(time, '%Y-%m-%d %H:%M:%S.%f') || ' UTC'", "process_id": "process_id", "session_line_num": "event_id", "raw_severity": "severity", "sql_state": "sql_state"} | {
    c: f"coalesce('\"' || replace({x}, '\"', '\"\"') || '\"', '')" for c, x in {"user": '"user"', "database": '"database"', "connection_from": "host || ':' || (event_id % 1000 + 40000)", "message": "message", "detail": "detail", "query": "query", "application_name": "'psql'", "backend_type": "'client backend'"}.items()}
_LINE = " || ',' || ".join(_CSV.get(c, "''") for c in CSV_COLUMNS)
_query("scan_offsets", lambda s, d: _files(s, d, "csv", 30_000).agg(F.count("*").alias("records"), F.countDistinct("file", "offset").alias("places"), F.sum(F.octet_length("raw") + 1).alias("bytes")),
       E + f"SELECT count(*) AS records, count(*) AS places, CAST(sum(strlen({_LINE}) + 1) AS BIGINT) AS bytes FROM r")
#: Details that hold whole lines of a csvlog.
_INNER = lambda: F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("as logged:\n"), "log_time", F.lit(',"u","d",'), "session_line_num", F.lit(",,\n\n"), "log_time", F.lit(",")))
_query("scan_csv_embedded", lambda s, d: _parsed(read_log(s, _written(s, d, lambda e: csv_lines(e, 26, {"detail": _INNER()})), LogReadOptions("csv"), glob="*", split_bytes=15_000)),
       E + f"SELECT {_COLUMNS} FROM (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 'as logged:' || chr(10) || {_CSV['log_time']} || ',\"u\",\"d\",' || event_id || ',,' || chr(10) || chr(10) || {_CSV['log_time']} || ',' END AS detail) FROM r)")


class _Folder:
    """A session of a server whose log directory is a folder that Arrow's file systems reach."""

    def __init__(self, path: str):
        self.path, self.files = path, FileStore()

    def __call__(self) -> _Folder:
        return self

    def list(self) -> list[tuple]:
        return [(p.rsplit("/", 1)[1], size) for p, size in self.files.list(self.path, None)]

    def read(self, path: str, offset: int, length: int) -> bytes:
        with self.files.open(f"{self.path}/{path.rsplit('/', 1)[1]}") as f:
            f.seek(offset)
            return f.read(length)

    def close(self) -> None:
        pass


def _remote(s: SparkSession, d: str) -> DataFrame:
    """Details with whole log lines, read from a remote directory in chunks."""
    server = _Folder(_written(s, d, lambda e: csv_lines(e, 26, {"detail": _INNER()})))
    return read_log(s, "/srv/log", LogReadOptions("csv"), glob="part-*", remote=Remote(server, 40_000, connections=8))


_query("scan_remote", lambda s, d: _parsed(_remote(s, d)), SQL["scan_csv_embedded"])
_query("scalar_shapes", lambda s, d: _table(s, d, "events").select(
    "event_id", L.parse_epoch(F.concat(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), F.lit("."), F.date_format("ts", "SSSSSS"))).cast("timestamp_ntz").alias("epoch"),
    *[L.strict_int(F.concat(F.lit(a), F.col("event_id").cast("string"), F.lit(b))).alias(n) for n, a, b in (("plain", "", ""), ("plus", "+", ""), ("minus", "-", ""), ("blank", " ", ""), ("word", "", "x"))],
    L.field_after(F.concat(F.lit("a user=u"), F.col("user_id").cast("string"), F.lit(", user=x")), "user=").alias("field"), L.client_host(F.concat(F.lit("fe80::1:"), F.col("event_id").cast("string"))).alias("host"),
    L.temp_file_size(F.concat(F.lit("temporary file: path \"x\", size "), F.col("event_id").cast("string"))).alias("size"), L.duration_ns(F.concat(F.lit(" duration: "), F.col("event_id").cast("string"), F.lit(".5 ms"))).alias("duration")),
    "SELECT event_id, ts AS epoch, CAST(event_id AS INTEGER) AS plain, CAST(event_id AS INTEGER) AS plus, CAST(-event_id AS INTEGER) AS minus, CAST(NULL AS INTEGER) AS blank, CAST(NULL AS INTEGER) AS word, 'u' || user_id AS field, 'fe80::1' AS host, event_id AS size, event_id * 1000000 + 500000 AS duration FROM events")
