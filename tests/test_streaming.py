"""Followed directories and sinks."""

import io
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from logloom import plans, sinks
from logloom.operators import good_records, parse_lines
from logloom.queries import _table, records
from logloom.schema import LogReadOptions
from logloom.sources.csv_ranges import whole_until
from logloom.sources.files import Remote, read_log
from logloom.sources.stores import FileStore, as_option
from logloom.sources.render import LINES, PREFIX
from logloom.prefix import record_start
from logloom.streaming import Delivery, FollowReader, follow_jsonlog, follow_lines, follow_once, follow_records, streaming_counts, streaming_peaks, whole_records

from .test_remote import Server
from .test_scan import csv_record

SF = "/root/testdata/sf0.001"


def _day(spark, format_):
    lines = LINES[format_](_table(spark, SF, "events")).where(F.col("file") == "postgresql-2024-01-02").orderBy("seq")
    return [r.line for r in lines.collect()]


def test_followed_stderr_gives_each_record_once_and_whole(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    text = "\n".join(_day(spark, "stderr")) + "\n"
    options = LogReadOptions("stderr", PREFIX)

    def sink(df, no):
        df.where("_malformed IS NULL").select("process_id", "message", "detail", "query", "offset", F.lit(no).alias("no")).write.mode("append").parquet(out)

    def go():
        follow_records(spark, str(logs), options, sink, str(tmp_path / "cp"), "*.log", availableNow=True).awaitTermination(60)

    cut = len(text) // 3
    (logs / "a.log").write_text(text[:cut])
    go()
    with open(logs / "a.log", "a") as f:
        f.write(text[cut:])
    go()
    (logs / "b.log").write_text(text.splitlines()[0] + "\n")  # a later file: all of a.log is whole now
    go()
    got = spark.read.parquet(out).where("offset IS NOT NULL").drop("no")
    want = good_records(parse_lines(spark.createDataFrame([("a.log", i, x) for i, x in enumerate(text.splitlines())], "file string, seq long, line string"), options)).select("process_id", "message", "detail", "query", "offset")
    assert want.count() > 10
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def lines(reader, start, end):
    return [r[2] for x in reader.partitions(start, end) for r in reader.read(x)]


def test_offsets_tell_shrunk_and_replaced_files(tmp_path):
    p = tmp_path / "a.log"
    p.write_bytes(b"one\ntwo\nthr")
    reader = FollowReader({"path": str(tmp_path)})
    none, first = reader.initialOffset(), reader.latestOffset()
    assert first["files"][str(p)][0] == 8
    assert [r[1:4] for x in reader.partitions(none, first) for r in reader.read(x)] == [(0, "one", False), (4, "two", False)]
    p.write_bytes(b"one\ntwo\nthree\n")
    grown = reader.latestOffset()
    # A head that a longer one continues is the same file; a batch that is planned again is the same.
    assert lines(reader, first, grown) == ["three"] == lines(reader, first, grown)
    assert reader.partitions(grown, grown) == []
    p.write_bytes(b"new\n")
    assert lines(reader, grown, reader.latestOffset()) == ["new"]
    p.write_bytes(b"other start\nand more than there was\n")
    assert lines(reader, grown, reader.latestOffset()) == ["other start", "and more than there was"]


def test_a_head_that_grows_out_of_its_bytes_is_the_same_file(tmp_path):
    p = tmp_path / "a.log"
    p.write_text("short\n")
    reader = FollowReader({"path": str(tmp_path)})
    first = reader.latestOffset()
    p.write_text("short\n" + "x" * 300 + "\n")
    second = reader.latestOffset()
    assert second["files"][str(p)][4].startswith("=") and lines(FollowReader({"path": str(tmp_path)}), first, second) == ["x" * 300]
    p.write_text("other\n" + "x" * 300 + "\n")
    assert len(lines(reader, first, reader.latestOffset())) == 2


def test_a_replaced_file_of_the_same_head_is_another(tmp_path):
    p, text = tmp_path / "a.log", "same head " * 40 + "\n"
    p.write_text(text)
    reader = FollowReader({"path": str(tmp_path)})
    first = reader.latestOffset()
    (tmp_path / "new").write_text(text)
    (tmp_path / "new").rename(p)
    assert lines(reader, first, reader.latestOffset()) == [text[:-1]]


def test_split_ranges_own_each_line_once(tmp_path):
    text = [("x" * (i % 7)) + "é" for i in range(200)]
    (tmp_path / "a").write_text("\n".join(text) + "\n")
    for split in (1, 2, 3, 7, 50, 10_000):
        reader = FollowReader({"path": str(tmp_path), "splitbytes": str(split)})
        assert lines(reader, reader.initialOffset(), reader.latestOffset()) == text
    reader = FollowReader({"path": str(tmp_path), "glob": "*.none"})
    assert reader.latestOffset() == reader.initialOffset()
    with pytest.raises(FileNotFoundError):
        FollowReader({"path": str(tmp_path / "none")}).latestOffset()


def test_offsets_of_many_files_are_bounded_and_unchanged_ones_stay_closed(tmp_path, monkeypatch):
    opened, real = [], FileStore.open
    monkeypatch.setattr(FileStore, "open", lambda self, path: opened.append(path) or real(self, path))
    for i in range(10_000):
        (tmp_path / f"f{i:05d}").write_text(f"line {i}\n")
        os.utime(tmp_path / f"f{i:05d}", ns=(i * 10**9, i * 10**9))
    reader = FollowReader({"path": str(tmp_path)})
    first = reader.latestOffset()
    assert len(first["files"]) == 2500 and len(json.dumps(first)) < 500_000
    # One look at each of the files that the offset names, two at the last, whose end is sought.
    assert len(opened) == 2501
    assert reader.latestOffset() == first and len(opened) == 2501
    got = [(x.path, x.start, x.end) for x in reader.partitions(reader.initialOffset(), first)]
    assert len(got) == 10_000 == len({p for p, _, _ in got}) and len(opened) == 2501
    with open(tmp_path / "f09000", "a") as f:
        f.write("more\n")
    (tmp_path / "g").write_text("a new file\n")
    again = FollowReader({"path": str(tmp_path)})
    second = again.latestOffset()
    assert len(second["files"]) == 2500 and lines(again, first, second) == ["more", "a new file"]
    # A file that was dropped and changes is read anew; nothing else comes again.
    with open(tmp_path / "f00003", "a") as f:
        f.write("late\n")
    third = again.latestOffset()
    assert lines(again, second, third) == ["line 3", "late"] and again.partitions(third, third) == []
    assert lines(FollowReader({"path": str(tmp_path)}), second, third) == ["line 3", "late"]


def test_what_was_read_stays_read_when_the_later_file_goes(tmp_path):
    options = {"path": str(tmp_path), "starts": "#"}
    (tmp_path / "a").write_text("#1\n#2\n")
    (tmp_path / "b").write_text("#3\n")
    first = FollowReader(options).latestOffset()
    assert first["files"][str(tmp_path / "a")][0] == 6
    (tmp_path / "b").unlink()
    reader = FollowReader(options)  # after a restart
    second = reader.latestOffset()
    assert second["files"][str(tmp_path / "a")][0] == 3 and reader.partitions(first, second) == []
    with open(tmp_path / "a", "a") as f:
        f.write("#4\n#5\n")
    third = reader.latestOffset()
    assert lines(reader, second, third) == ["#4"] == lines(reader, second, third)


def test_followed_csv_knows_lines_in_fields_from_records(tmp_path):
    rows = [csv_record(i, "as logged\n" + csv_record(i, "inner").replace('"', '""') + "\n") for i in range(4)]
    data = ("\n".join(rows) + "\n").encode()
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r.encode()) + 1)
    starts = record_start(LogReadOptions("csv"))
    p = tmp_path / "a.csv"
    reader = FollowReader({"path": str(tmp_path), "format": "csv", "starts": starts})
    for n in range(0, len(data) + 1, 7):
        want = max(e for e in ends if e <= n)
        assert whole_until(io.BytesIO(data), 0, n, 1 << 20) == want
        p.write_bytes(data[:n])
        assert reader.latestOffset()["files"][str(p)][0] == want
    # Beyond the limit whole lines are handed over.
    assert whole_until(io.BytesIO(b'a,"\nbb\nccc'), 0, 11, 4) == 7


@pytest.fixture
def remote(tmp_path):
    (tmp_path / "srv").mkdir()
    return tmp_path / "srv", {"path": "/srv/log", "server": as_option(Server(tmp_path / "srv"))}


def test_remote_files_are_told_by_size_alone(remote):
    folder, options = remote
    a, reader = folder / "a.log", FollowReader(options)
    a.write_text("one\ntwo\npart")
    first = reader.latestOffset()
    assert lines(reader, reader.initialOffset(), first) == ["one", "two"]
    a.write_text("one\ntwo\npartial\n")
    second = reader.latestOffset()
    assert lines(reader, first, second) == ["partial"]
    a.write_text("six\nsix\nsixteen\n")  # of equal size: not to be told
    assert lines(reader, second, reader.latestOffset()) == []
    a.write_text("six\n")
    fourth = reader.latestOffset()
    assert lines(reader, second, fourth) == ["six"]
    a.write_text("other\nand longer\n")  # grown: read on from the place
    assert lines(reader, fourth, reader.latestOffset()) == ["r", "and longer"]


def test_remote_directory_is_followed_resumed_and_cancelled(spark, tmp_path, remote):
    folder, _ = remote
    out, options = str(tmp_path / "out"), LogReadOptions("json")
    text = "\n".join(_day(spark, "json")) + "\n"

    def go(**trigger):
        sink = lambda df, no: df.where("_malformed IS NULL").select("session_line_num", "raw").write.mode("append").parquet(out)
        return follow_records(spark, "/srv/log", options, sink, str(tmp_path / "cp"), "*.json", Remote(Server(folder), 1000), **trigger)

    (folder / "a.json").write_text(text[: len(text) // 2])
    go(availableNow=True).awaitTermination(120)
    q = go(processingTime="100 milliseconds")
    with open(folder / "a.json", "a") as f:
        f.write(text[len(text) // 2 :])
    (folder / "b.json").write_text(text.split("\n")[0])
    q.processAllAvailable()
    q.stop()  # the half line of b.json is never handed over
    with open(folder / "b.json", "a") as f:
        f.write("\n")
    go(availableNow=True).awaitTermination(120)
    got = sorted(r.raw for r in spark.read.parquet(out).collect())
    assert got == sorted(text.splitlines() + text.splitlines()[:1])


def test_delivery_gives_each_record_once(spark, tmp_path):
    logs, cp = tmp_path / "logs", str(tmp_path / "cp")
    logs.mkdir()
    text = _day(spark, "json")
    delivery = Delivery(spark, str(tmp_path / "out"))
    n = len(text) // 3

    def go(d=delivery):
        q = follow_once(spark, str(logs), LogReadOptions("json"), d, cp, "*.json", availableNow=True)
        q.awaitTermination(120)

    def got():
        return sorted(r.raw for r in delivery.read().collect())

    (logs / "a.json").write_text("\n".join(text[:n]) + "\n")
    go()
    assert got() == sorted(text[:n]) and delivery.batches() == [0]

    class Killed(Delivery):
        def _mark(self, no, text):
            raise RuntimeError("killed before the marker")

    class Late(Delivery):
        def _mark(self, no, text):
            super()._mark(no, text)
            raise RuntimeError("killed after the marker")

    with open(logs / "a.json", "a") as f:
        f.write("\n".join(text[n : 2 * n]) + "\n")
    for d in (Killed, Late):
        with pytest.raises(Exception, match="killed"):
            go(d(spark, str(tmp_path / "out")))
        assert got() == sorted(text[: n if d is Killed else 2 * n])
    with open(logs / "a.json", "a") as f:
        f.write("\n".join(text[2 * n :]) + "\n")
    go()  # a trigger after a failure may run the failed batch alone
    go()
    assert got() == sorted(text) and {r.batch for r in delivery.read().select("batch").distinct().collect()} == {0, 1, 2}


def test_delivery_leaves_out_lines_of_places_reached(spark, tmp_path):
    delivery = Delivery(spark, str(tmp_path / "out"))
    frame = lambda *rows: spark.createDataFrame(rows, "file string, offset long, line string, version string, stop long")
    delivery.write(frame(("a", 0, "1", "v1", 2), ("a", 2, "2", "v1", 4), ("b", 0, "x", "", 2)), 0, lambda d: d)
    delivery.write(frame(("a", 2, "2", "v1", 4), ("a", 4, "3", "v1", 6), ("b", 0, "y", "", 2)), 1, lambda d: d)
    delivery.write(frame(("a", 0, "4", "v2", 2)), 2, lambda d: d)
    delivery.write(frame(("a", 9, "never", "v2", 11)), 2, lambda d: d)
    assert sorted(r.line for r in delivery.read().collect()) == ["1", "2", "3", "4", "x", "y"]
    with pytest.raises(FileNotFoundError):
        Delivery(spark, str(tmp_path / "none")).read()


def test_open_record_is_held_back():
    starts = re.compile(record_start(LogReadOptions("csv")), re.DOTALL)
    row = b'2024-01-02 10:11:12.123 UTC,"a",\n'
    for text, want in ((b"", 0), (row, 0), (row + row, len(row)), (row + row + b"more\n" * 50_000, len(row)), (row + b"half", 0)):
        assert whole_records(io.BytesIO(text), len(text), starts, 16 << 20) == want


def test_sinks(spark):
    r = records(spark, SF)
    out = [json.loads(x.value) for x in sinks.report_ndjson("errors", plans.errors(r)).collect()]
    assert out[0]["report"] == "errors" and {x["report"] for x in out[1:]} == {"errors.message", "errors.sqlstate"}
    counts = [x["count"] for x in out if x["report"] == "errors.message"]
    assert counts == sorted(counts, reverse=True) and len(counts) > 1
    assert sinks.text_table(spark.createDataFrame([(1, "a"), (200, "bc")], "n int, word string")) == "n    word\n---  ----\n1    a\n200  bc\n"
    assert sinks.text_table(spark.createDataFrame([], "n int")) == "(nothing to report)\n"
    assert "sqlstate" in sinks.text_report(plans.errors(r))
    m = sinks.manifest(LINES["json"](_table(spark, SF, "events")), r)
    assert m.where("key = 'severity'").agg(F.sum("value")).first()[0] == r.count()
    b = sinks.bench_report(parse_lines(LINES["json"](_table(spark, SF, "events")), LogReadOptions("json")))
    assert b["records"] == r.count() and b["malformed"] == 0


def test_streaming_jsonlog_peaks_and_counts(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    lines = _day(spark, "json")
    (logs / "a.json").write_text("\n".join(lines) + "\n")
    records = follow_jsonlog(spark, str(logs))
    got = {}
    for name, stream, mode in (("peaks", streaming_peaks(records, "1 hour"), "complete"), ("counts", streaming_counts(records), "complete")):
        q = stream.writeStream.format("memory").queryName(f"stream_{name}").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert q.awaitTermination(120)
        got[name] = spark.table(f"stream_{name}").collect()
    whole = good_records(parse_lines(spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)], "file string, seq long, line string"), LogReadOptions("json")))
    want = plans.peaks(whole, "1 hour", None)["buckets"].collect()
    assert sorted(map(tuple, got["peaks"])) == sorted(map(tuple, want)) and len(want) > 3
    counts = {(r.database, r.severity): r["count"] for r in whole.groupBy("database", "severity").count().collect()}
    assert {(r.database, r.severity): r["count"] for r in got["counts"]} == counts


def test_parser_statistics_keys_and_medians(spark, tmp_path):
    from pyspark.sql import Observation

    good = _day(spark, "json")[:20]
    (tmp_path / "a.json").write_text("\n".join([*good, "{broken", '{"message":"' + "x" * 5000 + '"}', '{"error_severity":"LOG"}']))
    seen = Observation("parsed")
    read = read_log(spark, str(tmp_path / "a.json"), LogReadOptions("json", max_record_bytes=4000), malformed=True)
    sinks.watched(read, seen).write.format("noop").mode("overwrite").save()
    assert {k: seen.get[k] for k in ("records", "malformed", "truncated")} == {"records": 21, "malformed": 1, "truncated": 2}
    counts = sinks.severity_counts(read.where("_malformed IS NULL")).first().asDict()
    assert sum(counts.values()) == 21 and set(counts) <= {"log", "warning", "error", "fatal", "panic"}
    runs = spark.createDataFrame([("W1", "a", x, 1 << 20) for x in (3.0, 1.0, 2.0)] + [("W2", "a", 0.0, 0)], "workload string, tool string, seconds double, bytes_in long")
    assert {r.workload: (r.runs, r.median_s, r.min_s, r.max_s, r.mb_per_second) for r in sinks.run_medians(runs).collect()} == {"W1": (3, 2.0, 1.0, 3.0, 0.5), "W2": (1, 0.0, 0.0, 0.0, 0.0)}
