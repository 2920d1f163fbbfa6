"""Log lines written from a known event table: a generator for tests, benches and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CSV_COLUMNS

PREFIX = "%m [%p] %e %q%u@%d "


def logical(events: DataFrame) -> DataFrame:
    """Events (event_id, ts, user_id, event_type, value) as text columns of log records; every tenth has a detail of two lines."""
    e, kind, no = events, F.col("event_type"), F.col("event_id")
    i, u = no.cast("string"), F.col("user_id")
    user, database, n = F.concat(F.lit("u"), u.cast("string")), F.concat(F.lit("db"), (u % 3).cast("string")), (no % 97).cast("string")
    table = F.chr(97 + no % 5)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    # (condition, message, severity, SQLSTATE), the first that holds
    shapes = (
        (kind == "view", text("duration: ", F.col("value").cast("decimal(18,3)").cast("string"), " ms  statement: SELECT * FROM t_", table, " WHERE id = ", i), "LOG", "00000"),
        ((kind == "click") & (no % 7 == 3), text("disconnection: session time: 0:00:0", (no % 10).cast("string"), ".000 user=", user, " database=", database), "LOG", "00000"),
        ((kind == "click") & (no % 7 == 5), text('password authentication failed for user "', user, '"'), "FATAL", "28P01"),
        (kind == "click", text("connection authorized: user=", user, " database=", database), "LOG", "00000"),
        ((kind == "purchase") & (no % 3 == 0), text("process ", i, " still waiting for ", F.when(no % 2 == 0, "Share").otherwise("Exclusive"), "Lock on transaction ", n), "WARNING", "01000"),
        (kind == "purchase", text("there is already a transaction in progress"), "WARNING", "01000"),
        ((kind == "error") & (no % 5 == 0), text("deadlock detected"), "ERROR", "40P01"),
        ((kind == "error") & (no % 5 == 1), text("canceling statement due to conflict with recovery"), "ERROR", "57014"),
        (kind == "error", text('relation "t_', n, '" does not exist'), "ERROR", "42P01"),
        (no % 9 == 0, text("checkpoint starting: time"), "LOG", "00000"),
        (no % 9 == 1, text("restartpoint complete: wrote ", n, " buffers"), "LOG", "00000"),
        (no % 9 == 2, text('automatic vacuum of table "', database, '.public.t": index scans: ', n), "LOG", "00000"),
        (no % 9 == 3, text("database system is ready to accept connections"), "LOG", "00000"),
        (no % 9 == 4, text('could not write to file "pg_wal/xlogtemp.', i, '"'), "PANIC", "53100"),
    )
    pick = lambda at, other: F.coalesce(*[F.when(s[0], s[at]) for s in shapes], other)
    temp_file = text('temporary file: path "base/pgsql_tmp/pgsql_tmp', (u + 1000).cast("string"), '.0", size ', (no * 1024).cast("string"))
    return e.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" UTC")).alias("log_time"), user.alias("user"),
        database.alias("database"), (u + 1000).cast("string").alias("process_id"), F.concat(F.lit("10.0.0."), (u % 250).cast("string")).alias("host"), (no % 1000 + 40000).cast("string").alias("port"),
        i.alias("session_line_num"), pick(2, F.lit("LOG")).alias("raw_severity"), pick(3, F.lit("00000")).alias("sql_state"), pick(1, temp_file).alias("message"),
        F.when(no % 10 == 0, F.concat(F.lit("first part of "), i, F.lit(", \"quoted\"\n\tsecond part"))).alias("detail"), F.when(kind == "error", F.concat(F.lit("SELECT * FROM t_"), n)).alias("query"), F.lit("psql").alias("application_name"), F.lit("client backend").alias("backend_type"),
    )


def _lines(df: DataFrame, text: Column) -> DataFrame:
    x = df.select(F.concat(F.lit("postgresql-"), "day").alias("file"), "event_id", F.posexplode(F.split(text, "\n")).alias("no", "line"))
    return x.select("file", (F.col("event_id") * 16 + F.col("no")).alias("seq"), "line")


def _with(x: DataFrame, more: dict[str, Column] | None) -> DataFrame:
    return x.withColumns(more) if more else x


def json_lines(events: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """jsonlog; more: further or other columns, by their names in a record, over those of logical. A location stands for its three keys."""
    x = _with(logical(events), more)
    names = {"timestamp": "log_time", "user": "user", "dbname": "database", "pid": F.col("process_id").cast("int"), "remote_host": "host", "remote_port": F.col("port").cast("int"), "line_num": F.col("session_line_num").cast("long"), "error_severity": "raw_severity", "state_code": "sql_state",
             "message": "message", "detail": "detail", "statement": "query", "application_name": "application_name", "backend_type": "backend_type"}
    names |= {c: c for c in ("hint", "context", "session_start") if c in x.columns}
    if "location" in x.columns:
        place = F.split("location", ", |:")
        names |= {"func_name": place[0], "file_name": place[1], "file_line_num": place[2].cast("int")}
    return _lines(x, F.to_json(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in names.items()])))


def csv_lines(events: DataFrame, columns: int = 26, more: dict[str, Column] | None = None) -> DataFrame:
    """csvlog of so many columns; more as for json_lines."""
    x = _with(logical(events), more).withColumn("connection_from", F.concat_ws(":", "host", "port"))
    quoted = ("user", "database", "connection_from", "message", "detail", "query", "application_name", "backend_type", "hint", "context", "location")
    field = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) if c in quoted and c in x.columns else F.coalesce(c, F.lit("")) if c in x.columns else F.lit("")
    return _lines(x, F.concat_ws(",", *[field(c) for c in CSV_COLUMNS[:columns]]))


def stderr_lines(events: DataFrame) -> DataFrame:
    x = logical(events)
    head = F.concat("log_time", F.lit(" ["), "process_id", F.lit("] "), "sql_state", F.lit(" "), "user", F.lit("@"), "database", F.lit(" "))
    part = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit("\n"), head, F.lit(f"{label}:  "), c)).otherwise("")
    return _lines(x, F.concat(head, "raw_severity", F.lit(":  "), "message", part("DETAIL", "detail"), part("STATEMENT", "query")))


LINES = {"json": json_lines, "csv": csv_lines, "stderr": stderr_lines}
