"""The command line, and context around hits."""

import io
import json

import pytest

from logloom import plans
from logloom.__main__ import ERROR, NO_INPUT, OK, bucket, main, seconds

LINES = [
    '{"timestamp":"2026-01-02 03:04:05.000 UTC","user":"u","dbname":"d","pid":%d,"error_severity":"%s","state_code":"%s","message":"%s"}' % x
    for x in ((1, "LOG", "00000", "duration: 1500.0 ms  statement: SELECT 1"), (2, "ERROR", "42P01", "no such thing 5"), (3, "ERROR", "42P01", "no such thing 6"), (4, "LOG", "00000", "checkpoint starting: time"), (5, "FATAL", "57P01", "terminating connection"))
]


def run(spark, *args, stdin=""):
    out, err = io.StringIO(), io.StringIO()
    code = main(list(args), spark, io.StringIO(stdin), out, err)
    return code, out.getvalue(), err.getvalue()


@pytest.fixture
def log(tmp_path):
    (tmp_path / "a.json").write_text("\n".join(LINES) + "\n")
    return str(tmp_path / "a.json")


def test_reports(spark, log):
    code, out, err = run(spark, "errors", log)
    assert code == OK and not err and "no such thing ?" in out and "42P01" in out
    code, out, _ = run(spark, "slow", "--output", "json", "--min-duration", "1s", log)
    assert code == OK and json.loads(out.splitlines()[0])["count"] == 1
    assert run(spark, "slow", "--output", "json", "--min-duration", "1h30m", log)[1].splitlines()[0].count('"count":0') == 1
    assert [json.loads(x)["process_id"] for x in run(spark, "parse", "--output", "json", log)[1].splitlines()] == [1, 2, 3, 4, 5]
    assert len(run(spark, "grep", "--pattern", "thing 5", "-B", "1", "-A", "1", log)[1].splitlines()) == 3
    for name in ("stats", "connections", "locks", "peaks", "system", "patterns", "bench"):
        assert run(spark, name, log)[0] == OK


def test_exit_codes_and_streams(spark, log, tmp_path):
    assert run(spark, "stats", stdin="\n".join(LINES))[0] == OK and run(spark, "stats")[0] == NO_INPUT
    for args in (["nothing"], ["stats", "--format", "xml", log], ["slow", "--min-duration", "x", log], ["grep", log], ["stats", str(tmp_path / "missing")], []):
        code, out, err = run(spark, *args)
        assert code == ERROR and not out and err.startswith("logloom: ")
    assert run(spark, "stats", "--begin", "2027-01-01 00:00:00", log)[0] in (OK, NO_INPUT)
    assert seconds("1h30m") == 5400 and seconds("500ms") == 0.5 and seconds("-1m") == -60 and seconds("0") == 0
    assert [bucket(x) for x in ("0s", "0", "-5m", "500ms", "1ns", "1h")] == ["10 minutes", "10 minutes", "10 minutes", "500000 microseconds", "1 microseconds", "3600000000 microseconds"]
    assert run(spark, "peaks", "--bucket", "0s", log)[0] == OK and run(spark, "peaks", "--bucket", "500ms", log)[0] == OK
    assert run(spark, "stats", "--begin", "yesterday", log)[0] == ERROR and run(spark, "stats", "--begin", "2026-01-02T00:00:00Z", "--end", "2026-01-02 03:05", "--no-color", "--jobs", "2", log)[0] == OK


def test_rows_come_in_file_order_and_standard_input_piece_by_piece(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("logloom.__main__.SPOOL_CHARS", 50)
    for name, pids in (("b.json", range(50, 90)), ("a.json", range(50))):
        (tmp_path / name).write_text("".join(LINES[0].replace('"pid":1', f'"pid":{i}').replace("SELECT 1", f"hit{i % 2} é") + "\n" for i in pids))
    out = run(spark, "parse", "--output", "json", "--format", "json", str(tmp_path))[1].splitlines()
    assert [json.loads(x).get("process_id", 0) for x in out] == [*range(90)]
    out = run(spark, "grep", "--pattern", "hit1", "-C", "1", "--output", "json", "--format", "json", str(tmp_path))[1].splitlines()
    assert [json.loads(x).get("process_id", 0) for x in out] == [*range(90)]
    text = "".join((tmp_path / n).read_text() for n in ("a.json", "b.json"))
    out = run(spark, "parse", "--output", "json", stdin=text)[1].splitlines()
    assert [json.loads(x).get("process_id", 0) for x in out] == [*range(90)] and all("é" in x for x in out)


def test_context_across_tasks_and_ties(spark):
    rows = [("f", i // 2, "hit" if i in (0, 7, 8, 39) else "no", i) for i in range(40)]
    got = plans.grep(spark.createDataFrame(rows, "file string, offset long, raw string, i long").repartition(4), "hit", 2, 1, order=("file", "offset", "i"))
    assert sorted(r.i for r in got.collect()) == [0, 1, 5, 6, 7, 8, 9, 37, 38, 39] and got.columns == ["file", "offset", "raw", "i", "hit"]
