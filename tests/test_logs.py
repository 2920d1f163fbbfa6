"""Log queries against their SQL, and files read back."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom import plans
from logloom.functions.template import template_of
from logloom.queries import QUERIES, SQL, _table
from logloom.schema import LogReadOptions
from logloom.sources.files import read_log
from logloom.sources.render import LINES, PREFIX

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(str(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df, found = QUERIES[name](spark, SF), duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, found.fetchall())


@pytest.mark.parametrize("format_", ["json", "csv", "stderr"])
def test_files_read_as_their_lines(spark, tmp_path, format_):
    lines = LINES[format_](_table(spark, SF, "events")).where(F.col("file") == "postgresql-2024-01-02").orderBy("seq")
    texts = [r.line for r in lines.collect()]
    (tmp_path / "a.log").write_text("\n".join(texts) + "\n")
    got = read_log(spark, str(tmp_path / "a.log"), LogReadOptions(line_prefix=PREFIX if format_ == "stderr" else None))
    events = _table(spark, SF, "events").where("date(ts) = '2024-01-02'").count()
    assert events > 0 and got.count() == events
    assert {r.format for r in got.select("format").distinct().collect()} == {format_}
    assert plans.stats(got)["summary"].first().unknown == 0


def test_each_file_of_a_directory_has_its_own_kind(spark, tmp_path):
    events = _table(spark, SF, "events")
    for format_ in ("json", "csv"):
        texts = [r.line for r in LINES[format_](events).where(F.col("file") == "postgresql-2024-01-02").orderBy("seq").collect()]
        (tmp_path / f"{format_}.log").write_text("\n".join(texts) + "\n")
    (tmp_path / "p.log").write_text("2024-01-02 03:04:05.678 UTC [12] LOG:  one\n" * 3)
    (tmp_path / "q.log").write_text("2024-01-02 03:04:05 UTC [12]: [1-1] user=u,db=d,app=a,client=h ERROR:  two\n" * 4)
    got = read_log(spark, str(tmp_path), malformed=True, glob="*")
    n = events.where("date(ts) = '2024-01-02'").count()
    found = {(r.file.rsplit("/", 1)[1], r.format, r.user): r["count"] for r in got.where("_malformed IS NULL").groupBy("file", "format", "user").count().where("format = 'stderr'").collect()}
    assert found == {("p.log", "stderr", None): 3, ("q.log", "stderr", "u"): 4}
    assert {r.format: r["count"] for r in got.where("_malformed IS NULL").groupBy("format").count().collect()} == {"json": n, "csv": n, "stderr": 7}
    assert got.where("_malformed IS NOT NULL").count() == 0


def test_empty_directory_has_no_records(spark, tmp_path):
    assert read_log(spark, str(tmp_path), LogReadOptions("json")).count() == 0


@pytest.mark.parametrize("message, template", [("", ""), ("process 12 still waiting", "process $1 still waiting"), ("deadlock detected", "deadlock detected")])
def test_templates(message, template):
    assert template_of(message) == template


@pytest.mark.parametrize("raw,want", [
    (r"plain", "plain"), (r"a\tb\n\r\b\f\/\"\\", 'a\tb\n\r\b\f/"\\'), (r"\u00e9\u0041", "éA"), (r"\ud83d\ude00", "😀"), (r"x\ud83dy", "x\ufffdy"), (r"\ude00\ud83d", "\ufffd\ufffd"),
    (r"\ud83d\ud83d\ude00", "\ufffd😀"), (r"\ud83d\u0041", "\ufffdA"), (r"\q\x", r"\q\x"), (r"\u12", r"\u12"), (r"\u12g4 \u", r"\u12g4 \u"), (r"\\q\\ud83d", r"\q\ud83d"), (r"\\\q", r"\\q"), (r"C:\dir\new", "C:\\dir\new"),
])
def test_json_escapes(spark, raw, want):
    from logloom.operators import parse_lines

    lines = spark.createDataFrame([("f", 1, '{"pid":1,"message":"%s","detail":"{[%s"}' % (raw, raw))], "file string, seq long, line string")
    r = parse_lines(lines, LogReadOptions("json")).first()
    assert (r.message, r.detail, r._malformed) == (want, "{[" + want, None)


def test_very_many_escapes(spark):
    from logloom.operators import mended_json

    text = '{"message":"' + "\\n\\q" * 300_000 + '"}'
    assert spark.createDataFrame([(text,)], "raw string").select(mended_json(F.col("raw")).alias("x")).first().x == text.replace("\\q", "\\\\q")


def test_time_literals():
    from datetime import datetime, timezone

    from logloom.plans import time_literal

    utc = lambda *a: datetime(*a, tzinfo=timezone.utc)
    for text, want in {"2026-01-02": utc(2026, 1, 2), "2026-01-02 3:04": utc(2026, 1, 2, 3, 4), "2026-01-02 03:04:05": utc(2026, 1, 2, 3, 4, 5), "2026-01-02 03:04:05.25": utc(2026, 1, 2, 3, 4, 5, 250_000),
                       "2026-01-02 03:04:05.123456789": utc(2026, 1, 2, 3, 4, 5, 123_456), "2026-01-02T03:04:05Z": utc(2026, 1, 2, 3, 4, 5), "2026-01-02T03:04:05.5+01:30": utc(2026, 1, 2, 1, 34, 5, 500_000)}.items():
        assert time_literal(text) == want
    for text in ("", "now", "2026-02-30", "2026-01-02 25:00", "2026-1-2", "2026-01-02T03:04:05", "2026-01-02 03", "2026-01-02 03:04:05 UTC", "٢٠٢٦-01-02"):
        with pytest.raises(ValueError, match="cannot parse time"):
            time_literal(text)


def test_bounded_top_lists(spark):
    from collections import Counter

    from logloom.plans.bounded import Summary, top_bounded

    rng = random.Random(5)
    keys = [f"hot{i}" for i in range(6) for _ in range(400 - 40 * i)] + [f"cold{rng.randrange(5000)}" for _ in range(6000)] + [None] * 300
    rng.shuffle(keys)
    exact = Counter(keys)
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, v long").repartition(5)
    got = top_bounded(df, F.col("k"), 5, F.col("v"), F.col("k"), factor=8)
    top, s = got["top"].collect(), got["summary"].first()
    assert s.dropped > 0 and s.error <= len(keys) / 41
    assert [r.key for r in top] == ["hot0", "hot1", "hot2", None, "hot3"] and all(r["count"] <= exact[r.key] <= r["count"] + s.error and r.sample == r.key for r in top)
    whole = top_bounded(df, F.col("k"), 10, F.col("v"), factor=1000)
    assert {r.key: (r["count"], r.worst) for r in whole["top"].collect()} == {k: (exact[k], max(i for i, x in enumerate(keys) if x == k)) for k in sorted(exact, key=lambda k: (-exact[k], k or ""))[:10]}
    assert tuple(whole["summary"].first()) == (0, 0)
    empty = top_bounded(df.where("false"), F.col("k"))
    assert empty["top"].collect() == [] and tuple(empty["summary"].first()) == (0, 0)
    one = Summary(3)
    for k in range(1000):
        one.add(str(k), 1, None, None, None)
    assert len(one.groups) <= 7


def test_medians_manifest_and_times(spark):
    from logloom import sinks
    from logloom.plans import rfc3339

    runs = spark.createDataFrame([("W", "a", x, 0) for x in (4.0, 1.0, 3.0, 2.0)], "workload string, tool string, seconds double, bytes_in long")
    assert sinks.run_medians(runs).first().median_s == 3.0
    lines = spark.createDataFrame([("a", "xyz"), ("a", "é"), ("b", "")], "file string, line string")
    m = {(r.key, r.name): r.value for r in sinks.manifest(lines, spark.createDataFrame([("LOG",), (None,)], "severity string"), seed=7).collect()}
    assert m == {("corpus", "version"): 1, ("corpus", "seed"): 7, ("bytes", "a"): 7, ("bytes", "b"): 1, ("lines", "a"): 2, ("lines", "b"): 1, ("severity", "LOG"): 1, ("severity", "UNKNOWN"): 1, ("total", "bytes"): 8, ("total", "records"): 2}
    t = spark.createDataFrame([(x,) for x in ("2026-01-02 03:04:00", "2026-01-02 03:04:05.1", "2026-01-02 03:04:05.000120", "2026-01-02 10:20:30")], "t string").select(F.col("t").cast("timestamp").alias("t")).select(rfc3339("t").alias("x"))
    assert [r.x for r in t.collect()] == ["2026-01-02T03:04:00Z", "2026-01-02T03:04:05.1Z", "2026-01-02T03:04:05.00012Z", "2026-01-02T10:20:30Z"]


def test_ndjson_query_has_the_flags_of_records(spark):
    """Records without any have none; the reader's own form of NDJSON leaves them out."""
    from logloom.queries import records

    r = records(spark, SF, "csv")
    want = {row.flags or None: row["count"] for row in r.groupBy("flags").count().collect()}
    assert {row.flags: row["count"] for row in QUERIES["parse_ndjson"](spark, SF).groupBy("flags").count().collect()} == want and len(want) > 2
    assert "flags" not in plans.ndjson(r).where("value LIKE '%first part of%'").first().value


def test_formats_are_compared_in_one_parse_each(spark, monkeypatch):
    plan = QUERIES["tri_format_agree"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == len(LINES)
    from logloom import queries

    rows = {"json": [1, 1, 2, 3], "csv": [1, 2, 2, 4], "stderr": [1, 1, 1]}
    made = {f: spark.createDataFrame([(None, x, "u", None, "LOG", None, "m", None, None, None) for x in n], "time timestamp, process_id int, user string, database string, severity string, sql_state string, message string, detail string, query string, duration_ns long") for f, n in rows.items()}
    monkeypatch.setattr(queries, "records", lambda s, d, f="json": made[f])
    assert [r.differences for r in QUERIES["tri_format_agree"](spark, SF).collect()] == [7]
