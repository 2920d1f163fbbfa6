"""Record source: ranges, offsets, truncated tails, long fields, compressed and mixed files."""

import bz2
import gzip
import io
import lzma
import random
import re

import pytest
import zstandard

from logloom.prefix import record_start
from logloom.schema import LogReadOptions
from logloom.sources import csv_ranges, scan
from logloom.sources.files import kinds, read_log

PREFIX = "%m [%p] %q%u@%d "


def csv_record(i, message):
    return f'2026-01-02 03:04:05.{i:03d} UTC,"u","d",{i},"h:1",5f.1,{i},"SELECT",2026-01-02 03:00:00 UTC,3/1,0,ERROR,42P01,"{message}",,,,,,,,,"psql","client backend",,0'


def texts(format_, n=60):
    rng = random.Random(n)
    out = []
    for i in range(n):
        if format_ == "csv":
            out.append(csv_record(i, "plain" if not i else rng.choice(["plain", 'doubled ""quotes"", and commas', "two\nlines", "crlf\r\ninside", "\n\nblank", "é" * 40])))
        elif format_ == "json":
            out.append('{"timestamp":"2026-01-02 03:04:05.000 UTC","pid":%d,"error_severity":"LOG","message":"%s"}' % (i, rng.choice(["a", "b\\nc", "é" * 30])))
        else:
            head = f"2026-01-02 03:04:05.{i:03d} UTC [{i}] u@d "
            out.append(head + "ERROR:  m" + rng.choice(["", "\n\twrapped\n\tagain", f"\n{head}DETAIL:  d\n{head}STATEMENT:  SELECT\n\t1", "\nno prefix here"]))
    return out


def found(data, format_, cuts, cap=16 << 20):
    pattern = record_start(LogReadOptions(format_, PREFIX))
    starts = re.compile(b"^(?:" + pattern.encode() + b")", re.MULTILINE) if pattern else None
    rows, f = [], io.BytesIO(data)
    ranges = list(zip(cuts, cuts[1:]))
    if format_ == "csv":
        bom = data.startswith(b"\xef\xbb\xbf")
        ranges = [(0 if a == 0 else first, b) for a, b, first in csv_ranges.first_records(f, [csv_ranges.summary(f, a, b, cap) for a, b in ranges], cap, bom)]
    for a, b in ranges:
        f.seek(a if format_ == "csv" else a - min(a, scan.BACK))
        for batch in scan.records(f, "p", a, b, format_, starts, cap, at_record=format_ == "csv"):
            rows += batch.to_pylist()
    return rows


@pytest.mark.parametrize("format_", ["csv", "json", "stderr"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_cut_gives_each_record_once(monkeypatch, format_, end):
    monkeypatch.setattr(scan, "CHUNK", 97)
    want = texts(format_)
    data = (end.join(want) + end).encode()
    whole = found(data, format_, [0, len(data)])
    assert [r["raw"].replace("\r\n", "\n") for r in whole] == [w.replace("\r\n", "\n") for w in want]
    at = 0
    for r, w in zip(whole, want):
        assert r["offset"] == at and not r["_cut"] and not r["_large"]
        at += len((w + end).encode())
    rng = random.Random(1)
    for _ in range(25):
        cuts = [0, *sorted(rng.sample(range(1, len(data)), 7)), len(data)]
        assert found(data, format_, cuts) == whole


def test_lines_in_fields_that_look_like_records():
    inner = "text\n" + "\n".join(csv_record(i, "inner").replace('"', '""') for i in range(3)) + "\n\n2026-01-02 03:04:05.000 UTC,"
    want = [csv_record(i, inner if i % 2 else "plain") for i in range(8)]
    data = ("\n".join(want) + "\n").encode()
    whole = found(data, "csv", [0, len(data)])
    assert [r["raw"] for r in whole] == want
    assert all(found(data, "csv", [0, c, len(data)]) == whole for c in range(1, len(data)))
    for size in (1, 7, 100, 333):
        assert found(data, "csv", [*range(0, len(data), size), len(data)]) == whole


@pytest.mark.parametrize("chunk", [5, 64, 1 << 20])
def test_any_bytes_are_framed_alike_in_any_ranges(monkeypatch, chunk):
    """Stray quotes, blank lines and records over the limit included."""
    monkeypatch.setattr(scan, "CHUNK", chunk)
    monkeypatch.setattr(csv_ranges, "CHUNK", chunk)
    rng = random.Random(chunk)
    for n in range(300):
        data = b"".join(rng.choices([b'"', b"\n", b"\r\n", b"a", b",", b"bcd" * 4, b'","', b"\xef\xbb\xbf"], weights=[2, 3, 1, 8, 3, 2, 1, 1], k=rng.randint(1, 120)))
        cap = rng.choice([8, 20, 60, 1 << 20])
        whole = found(data, "csv", [0, len(data)], cap)
        for _ in range(6):
            cuts = [0, *sorted(rng.sample(range(1, len(data)), min(len(data) - 1, rng.randint(1, 9)))), len(data)]
            assert found(data, "csv", cuts, cap) == whole, (data, cap, cuts)


def test_lines_after_blank_ones_start_records_in_any_range():
    data = b"\n".join([b"2026-01-02 03:04:05.000 UTC [1] u@d LOG:  a", b"", b"stray", b"more", b"", b"", b"2026-01-02 03:04:05.000 UTC [2] u@d LOG:  b", b""])
    whole = found(data, "stderr", [0, len(data)])
    assert [r["raw"].splitlines()[-1] for r in whole] == ["2026-01-02 03:04:05.000 UTC [1] u@d LOG:  a", "more", "2026-01-02 03:04:05.000 UTC [2] u@d LOG:  b"]
    assert all(found(data, "stderr", [0, c, len(data)]) == whole for c in range(1, len(data)))


def test_truncated_tail_bom_and_large_records(monkeypatch):
    monkeypatch.setattr(scan, "CHUNK", 64)
    a, b, c = csv_record(1, "x"), csv_record(2, "y" * 3000), csv_record(3, "z")
    rows = found(("﻿" + "\n".join([a, b, c])).encode(), "csv", [0, 1 << 20], cap=1000)
    assert [(r["offset"], r["_cut"], r["_large"]) for r in rows] == [(3, False, False), (4 + len(a), False, True), (5 + len(a) + len(b), True, False)]
    assert rows[1]["raw"] == b[: scan.KEPT]
    rows = found((a + "\n" + a[: a.index('"x"') + 2]).encode(), "csv", [0, 1 << 20])
    assert [r["_open"] for r in rows] == [False, True]


@pytest.mark.parametrize("size", [2000, 8 << 20])
def test_long_quoted_fields(spark, tmp_path, size):
    message = ('SELECT ""a"", \n' * (size // 14))[:size].replace('"', "") + '""end""'
    (tmp_path / "a.csv").write_text(csv_record(1, message) + "\n" + csv_record(2, "next") + "\n")
    got = read_log(spark, str(tmp_path / "a.csv"), LogReadOptions("csv")).orderBy("offset").collect()
    assert [r.message for r in got] == [message.replace('""', '"'), "next"]
    from logloom.operators import parse_lines

    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate((csv_record(1, message[: 200_000] + '""') + "\n" + csv_record(2, "b")).split("\n"))], "file string, seq long, line string")
    assert sorted(r.process_id for r in parse_lines(lines, LogReadOptions("csv")).where("_malformed IS NULL").collect()) == [1, 2]


def test_files_are_split_compressed_and_told_apart(spark, tmp_path):
    plain = "\n".join(texts("csv", 500)) + "\n"
    (tmp_path / "a.log").write_text(plain)
    for name, pack in (("b.gz", gzip.compress), ("c.bz2", bz2.compress), ("d.xz", lzma.compress), ("e.zst", zstandard.ZstdCompressor().compress), ("f.log", gzip.compress)):
        (tmp_path / name).write_bytes(pack(plain.encode()))
    (tmp_path / "g.log").write_text("\n".join(texts("stderr", 50)))
    (tmp_path / "h.json").write_text("\n".join(texts("json", 40)) + "\n")
    (tmp_path / "empty.log").write_text("")
    got = read_log(spark, str(tmp_path), malformed=True, glob="*", split_bytes=7000)
    assert got.rdd.getNumPartitions() > 10
    by = {r.name: (r.format, r.n, r.bad, r.cut) for r in got.groupBy("file", "format").agg(*_counts()).collect()}
    assert by == {**{x: ("csv", 500, 0, 0) for x in ("a.log", "b.gz", "c.bz2", "d.xz", "e.zst", "f.log")}, "g.log": ("stderr", 50, 0, 1), "h.json": ("json", 40, 0, 0)}
    assert {r.file.rsplit("/", 1)[1]: r.prefix for r in kinds(spark, str(tmp_path)).collect() if r.format == "stderr"} == {"g.log": PREFIX}
    assert read_log(spark, str(tmp_path / "g.log"), LogReadOptions(no_truncated_tail=True)).count() == 50 - (0 if "\n" in texts("stderr", 50)[-1] else 1)
    (tmp_path / "lie.gz").write_text("not compressed")
    with pytest.raises(Exception, match="is not a gzip file"):
        read_log(spark, str(tmp_path / "lie.gz")).count()
    with pytest.raises(Exception, match="no such path"):
        read_log(spark, str(tmp_path / "missing")).count()


def _counts():
    from pyspark.sql import functions as F

    return F.first(F.substring_index("file", "/", -1)).alias("name"), F.count("*").alias("n"), F.count("_malformed").alias("bad"), F.sum((F.col("flags").bitwiseAND(4) != 0).cast("int")).alias("cut")


def test_nested_json_is_malformed(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"pid":1,"message":"{not} [nested]"}\n{"pid":2,"message":{"a":1}}\n{"pid":3,"x":[1]}\n{}\n{"pid":4,"message":"a"\n')
    got = read_log(spark, str(tmp_path / "a.json"), LogReadOptions("json"), malformed=True).orderBy("offset").collect()
    assert [(r.process_id, r._malformed) for r in got if not r._malformed] == [(1, None), (None, None)]
    assert [r._malformed for r in got] == [None, "bad json", "bad json", None, "bad json"]


class Counted(io.BytesIO):
    bytes = 0

    def read(self, n=-1):
        got = super().read(n)
        self.bytes += len(got)
        return got


@pytest.mark.parametrize("format_", ["csv", "json", "stderr"])
def test_small_ranges_of_a_large_file_read_little_more_than_their_bytes(format_):
    data = ("\n".join(texts(format_, 4000)) + "\n").encode()
    starts = re.compile(b"^(?:" + record_start(LogReadOptions(format_, PREFIX)).encode() + b")", re.MULTILINE) if format_ == "stderr" else None
    f, cuts, cap = Counted(data), [*range(0, len(data), 15_000), len(data)], 16 << 20
    ranges = list(zip(cuts, cuts[1:]))
    if format_ == "csv":
        ranges = [(first, b) for _, b, first in csv_ranges.first_records(f, [csv_ranges.summary(f, a, b, cap) for a, b in ranges], cap, False)]
    f.bytes, n = 0, 0
    for a, b in ranges:
        f.seek(a if format_ == "csv" else a - min(a, scan.BACK))
        n += sum(x.num_rows for x in scan.records(f, "p", a, b, format_, starts, cap, at_record=format_ == "csv"))
    assert n == 4000 and f.bytes < 1.5 * len(data)


def test_ranges_within_a_long_record_are_left_at_their_ends():
    data = b'{"message":"' + b"x" * 2_000_000 + b'"}\n{"message":"y"}\n'
    f, n = Counted(data), 0
    for a in range(0, len(data), 15_000):
        f.seek(a - min(a, scan.BACK))
        n += sum(x.num_rows for x in scan.records(f, "p", a, min(a + 15_000, len(data)), "json", None, 16 << 20))
    assert n == 2 and f.bytes < 4 * len(data)


def test_small_ranges_share_tasks(tmp_path):
    (tmp_path / "a.json").write_text("\n".join(texts("json", 3000)) + "\n")
    options = {"paths": f'["{tmp_path}"]', "format": "json", "splitbytes": "500", "slots": "4"}
    parts = [r.parts for r in scan.ScanReader(options).partitions()]
    assert len(parts) <= 4 * scan.TASKS_PER_SLOT + 1 and all(b - a <= 500 for p in parts for _, a, b in p)


@pytest.mark.parametrize("query", ["scan_csv", "scan_csv_embedded"])
def test_log_files_of_the_scan_queries_grow_in_number(spark, tmp_path, monkeypatch, query):
    import os

    from logloom import queries

    spark.range(400).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "id AS user_id", "'error' AS event_type", "1.5D AS value").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries, "_PER_FILE", 50)
    kept, written = [], queries._written
    monkeypatch.setattr(queries, "_written", lambda *a: kept.append(written(*a)) or kept[0])
    got = queries.QUERIES[query](spark, str(tmp_path))
    assert got.count() == 400 and sum(x.startswith("part-") for x in os.listdir(kept[0])) == 8
