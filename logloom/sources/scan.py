"""Batch source of whole log records: byte ranges of files, each task cutting at record starts.

Files are those of a file system or of a server's log directory (stores); a record that spans
ranges, or a remote file's chunks, is read on by the task that has its start, which holds what is
not framed yet and one chunk more.

A range owns the records whose first byte lies in it. A task that starts within a file moves on to
the next line that starts a record, and reads past its range's end until its last record is whole.
In csvlog a line alone doesn't show that: where its files have several ranges, a pass over their
quotes comes first (csv_ranges).

Compressed files are told by their first bytes and read as one stream by the range at byte 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..prefix import detect_format, detect_prefix
from .csv_ranges import Summary, first_records, summary
from .stores import CHUNK_BYTES, opened, store

#: Bytes of a file that one task reads, and that it frames at a time.
SPLIT_BYTES, CHUNK = 32 << 20, 4 << 20
#: Bytes past a range's end that are read with it; where they don't hold the last record's end, as many as there are so far, and so on.
AHEAD = 4 << 10
#: Tasks for each slot, where ranges are so small that many share a task.
TASKS_PER_SLOT = 3
#: Bytes and lines of a file's head that detection looks at.
HEAD_BYTES, HEAD_LINES = 256 << 10, 200
#: Bytes kept of a record that is over the limit.
KEPT = 1024
_BOM = b"\xef\xbb\xbf"

RECORDS = "file string, offset bigint, raw string, _cut boolean, _large boolean, _fields int, _open boolean"
_RECORDS = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("raw", pa.string()), ("_cut", pa.bool_()), ("_large", pa.bool_()), ("_fields", pa.int32()), ("_open", pa.bool_())])
HEADS = "file string, format string, prefix string"
QUOTES = "file string, bom boolean, packed boolean, start bigint, stop bigint, odd int, newline bigint, first array<bigint>, last array<bigint>, large array<boolean>"
_QUOTES = pa.schema([("file", pa.string()), ("bom", pa.bool_()), ("packed", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("odd", pa.int32()), ("newline", pa.int64()), ("first", pa.list_(pa.int64())), ("last", pa.list_(pa.int64())), ("large", pa.list_(pa.bool_()))])


@dataclass
class Range(InputPartition):
    #: (path, start, end) of each; small files and small ranges share a task.
    parts: list[tuple[str, int, int]]


@dataclass
class Framed:
    """Whole records of a buffer: first byte, byte after the last, and what of the buffer is used up."""

    start: np.ndarray
    end: np.ndarray
    used: int
    cut: bool = False
    fields: np.ndarray | None = None
    open: np.ndarray | None = None
    #: Ends with carriage return, where an over-large record is told by them, not by what is buffered.
    stop: np.ndarray | None = None


def _newlines(b: np.ndarray, eof: bool) -> tuple[np.ndarray, bool]:
    """Ends of lines; at the end of input the last line ends there too, cut if no newline says so."""
    at = np.flatnonzero(b == 10)
    cut = eof and len(b) > 0 and b[-1] != 10
    return (np.r_[at, len(b)] if cut else at), cut


def _trimmed(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ends without one carriage return."""
    return end - ((end > start) & (b[np.maximum(end - 1, 0)] == 13))


def frame_lines(buf: bytes, eof: bool) -> Framed:
    """One record a line; blank lines are none."""
    b = np.frombuffer(buf, np.uint8)
    line, cut = _newlines(b, eof)
    start = np.r_[0, line[:-1] + 1] if len(line) else line
    end = _trimmed(b, start, line)
    some = end > start
    return Framed(start[some], end[some], min(int(line[-1]) + 1, len(b)) if len(line) else 0, cut and bool(some[-1:].any()))


def frame_csv(buf: bytes, eof: bool) -> Framed:
    """A newline ends a record where an even number of quotes precede it; commas outside quotes part fields."""
    b = np.frombuffer(buf, np.uint8)
    line, cut = _newlines(b, eof)
    quotes = np.flatnonzero(b == 34)
    even = np.searchsorted(quotes, line) % 2 == 0
    open_ = np.zeros(len(line), bool)
    if eof and len(even) and not even[-1]:
        even[-1] = open_[-1] = True  # an unterminated quote runs to the end of input
    end, open_ = line[even], open_[even]
    start = np.r_[0, end[:-1] + 1] if len(end) else end
    used = min(int(end[-1]) + 1, len(b)) if len(end) else 0
    commas = np.flatnonzero(b[:used] == 44)
    commas = commas[np.searchsorted(quotes, commas) % 2 == 0]
    fields = np.searchsorted(commas, end) - np.searchsorted(commas, start) + 1
    stop = _trimmed(b, start, end)
    some = stop > start
    return Framed(start[some], stop[some], used, cut and bool(some[-1:].any()), fields[some].astype(np.int32), open_[some], end[some])


def frame_stderr(starts: re.Pattern) -> Callable[[bytes, bool], Framed]:
    """A record is a line that starts one, or stands after a blank line, and the lines up to the next or a blank one."""

    def frame(buf: bytes, eof: bool) -> Framed:
        b = np.frombuffer(buf, np.uint8)
        line, cut = _newlines(b, eof)
        if not len(line):
            return Framed(line, line, 0)
        start = np.r_[0, line[:-1] + 1]
        end = _trimmed(b, start, line)
        blank = end == start
        opens = np.zeros(len(line), bool)
        opens[np.searchsorted(start, np.fromiter((m.start() for m in starts.finditer(buf, 0, int(line[-1]))), np.int64))] = True
        opens = (opens | np.r_[True, blank[:-1]]) & ~blank  # what begins a buffer begins a record
        first = np.flatnonzero(opens)
        # Before each record's start or a blank line, the record before it ends.
        bounds = np.flatnonzero(opens | blank)
        stop = np.searchsorted(bounds, first, "right")
        whole = stop < len(bounds) if not eof else np.ones(len(first), bool)
        last = np.where(stop < len(bounds), bounds[np.minimum(stop, len(bounds) - 1)], len(line)) - 1 if len(bounds) else first
        if eof or whole.all():
            used = min(int(line[-1]) + 1, len(b))
        else:
            used = int(start[first[~whole][0]])
        first, last = first[whole], last[whole]
        return Framed(start[first], end[last], used, cut and len(last) > 0 and int(last[-1]) == len(line) - 1)

    return frame


def framer(format_: str, starts: re.Pattern | None) -> Callable[[bytes, bool], Framed]:
    return frame_csv if format_ == "csv" else frame_stderr(starts) if format_ == "stderr" else frame_lines


def _batch(path: str, base: int, buf: bytes, f: Framed, keep: np.ndarray, cap: int) -> pa.RecordBatch:
    start, end = f.start[keep], f.end[keep]
    n, large = len(start), end - start > cap
    stop = np.where(large, np.minimum(end, start + KEPT), end)
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[start] += 1
    mark[stop] -= 1
    data = np.frombuffer(buf, np.uint8)[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    offsets = np.r_[0, np.cumsum(stop - start)].astype(np.int32)
    raw = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data))
    cut = np.zeros(n, bool)
    if f.cut and n and keep[-1:].any():
        cut[-1] = True
    fields = pa.nulls(n, pa.int32()) if f.fields is None else pa.array(f.fields[keep])
    open_ = pa.nulls(n, pa.bool_()) if f.open is None else pa.array(f.open[keep])
    return pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(n, np.int32))), pa.array(start + base), raw, pa.array(cut), pa.array(large), fields, open_], schema=_RECORDS)


#: A line after a blank one starts a stderr record, whatever it holds.
_AFTER_BLANK = re.compile(rb"\n\r?\n(?=[^\r\n])")
#: Bytes before a range that tell whether its first line stands after a blank one.
BACK = 3


def _synced(buf: bytes, back: int, format_: str, starts: re.Pattern | None) -> int:
    """Where the first record of a range begins in a buffer that starts `back` bytes before it; 0 if that isn't seen yet."""
    line = buf.find(b"\n", back - 1) + 1
    if not line or starts is None:
        return line
    found = [m.start()] if (m := starts.search(buf, line)) else []
    if format_ == "stderr":
        at = max(0, line - BACK)
        while (m := _AFTER_BLANK.search(buf, at)) and m.end() < line:
            at = m.start() + 1
        found += [m.end()] if m else []
    return min(found, default=0)


def _upto(got: Framed, cap: int) -> Framed:
    """The records before the first over-large one, if its end says so."""
    if got.stop is None or not len(over := np.flatnonzero(got.stop - got.start > cap)):
        return got
    n = over[0]
    return Framed(got.start[:n], got.end[:n], int(got.start[n]), False, got.fields[:n], got.open[:n])


def records(f: BinaryIO, path: str, start: int, end: int | None, format_: str, starts: re.Pattern | None, cap: int, at_record: bool = False) -> Iterator[pa.RecordBatch]:
    """Records whose first byte lies in [start, end) of a stream that stands min(start, BACK) bytes before start, or at start if a record begins there."""
    back = 0 if at_record else min(start, BACK)
    frame, buf, base, eof, synced = framer(format_, starts), b"", start - back, False, start == 0 or at_record
    while not eof:
        chunk = f.read(CHUNK if end is None else min(CHUNK, max(AHEAD, end + AHEAD - base - len(buf), len(buf))))
        eof, buf = not chunk, buf + chunk
        if base == 0 and buf.startswith(_BOM):
            buf, base = buf[3:], 3
        if not synced:
            at = _synced(buf, back, format_, starts)
            if not at:
                # No line starts in the range, or what may be its first record is over the limit.
                if end is not None and (base + len(buf) >= end and buf.find(b"\n", back - 1, end - base) < 0 or base + len(buf) > end + cap):
                    return
                continue
            buf, base, synced = buf[at:], base + at, True
        while buf:
            got = _upto(frame(buf, eof), cap)
            mine = got.start + base < end if end is not None else np.ones(len(got.start), bool)
            if mine.any():
                yield _batch(path, base, buf, got, mine, cap)
            if not mine.all() or end is not None and base + got.used >= end and got.used:
                return
            buf, base = buf[got.used :], base + got.used
            if len(buf) <= cap:
                break
            # No end within the limit: the record is passed over up to the next line.
            line = buf.find(b"\n", cap) + 1
            if not line and not eof:
                break
            large = Framed(np.array([0]), np.array([line or len(buf)]), 0, fields=None)
            if end is None or base < end:
                yield _batch(path, base, buf, large, np.array([True]), cap)
            buf, base = buf[line or len(buf) :], base + (line or len(buf))


def task_bytes(total: int, split: int, slots: int) -> int:
    """Bytes of ranges that share a task: a range at least, else a part of the whole, up to SPLIT_BYTES."""
    return max(split, min(SPLIT_BYTES, -(-total // (slots * TASKS_PER_SLOT))))


class ScanReader(DataSourceReader):
    def __init__(self, options: dict):
        import json

        self.paths, self.glob, self.format = json.loads(options["paths"]), options.get("glob"), options.get("format")
        self.starts = options.get("starts")
        self.cap, self.split = int(options.get("maxrecordbytes", 16 << 20)), int(options.get("splitbytes", SPLIT_BYTES))
        self.slots = int(options.get("slots", 1))
        self.server, self.chunk, self.most = options.get("server"), int(options.get("chunkbytes", CHUNK_BYTES)), int(options.get("connections", 0))
        self.heads, self.quotes = options.get("heads") == "true", options.get("quotes") == "true"

    def partitions(self) -> list[Range]:
        files = store(self.server, self.chunk)
        try:
            found = [x for p in self.paths for x in files.list(p, self.glob)]
        finally:
            files.close()
        cuts = [(path, at, min(at + self.split, size)) for path, size in found if size for at in (range(0, size, self.split) if not self.heads else [0])]
        out, held = [], 0
        share = task_bytes(sum(HEAD_BYTES if self.heads else end - at for _, at, end in cuts), self.split, self.slots)
        for path, at, end in cuts:
            bytes_ = HEAD_BYTES if self.heads else end - at
            if not out or held + bytes_ > share:
                out.append(Range([]))
                held = 0
            out[-1].parts.append((path, at, end))
            held += bytes_
        if self.most and len(out) > self.most:  # neighbouring ranges share a task, and so a connection
            out = [Range([x for r in part for x in r.parts]) for i in range(self.most) if (part := out[i * len(out) // self.most : (i + 1) * len(out) // self.most])]
        return out or [Range([])]

    def whole(self, start: int, end: int) -> bool:
        """A file of one range needs no look at its quotes."""
        return start == 0 and end < self.split

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        files = store(self.server, self.chunk)
        try:
            yield from self._read(files, partition)
        finally:
            files.close()

    def _read(self, files, partition: Range) -> Iterator[pa.RecordBatch]:
        for path, start, end in partition.parts:
            with files.open(path) as f:
                codec = files.codec(f, path)
                if self.heads:
                    head = opened(f, codec).read(HEAD_BYTES).removeprefix(_BOM).decode("utf-8", "replace")
                    lines = [x for x in head.split("\n") if x.strip()][:HEAD_LINES]
                    if lines:
                        format_ = detect_format("\n".join(lines))
                        yield pa.RecordBatch.from_pydict({"file": [path], "format": [format_], "prefix": [detect_prefix(lines) if format_ == "stderr" else None]}, schema=pa.schema([(x, pa.string()) for x in ("file", "format", "prefix")]))
                    continue
                if codec and start:
                    continue  # the range at byte 0 has it all
                if self.quotes:
                    f.seek(0)
                    bom = start == 0 and not codec and f.read(3) == _BOM
                    s = Summary(start, end) if codec or self.whole(start, end) else summary(f, start, end, self.cap)
                    yield pa.RecordBatch.from_pylist([vars(s) | {"file": path, "bom": bom, "packed": bool(codec)}], schema=_QUOTES)
                    continue
                starts = re.compile(self.starts.encode(), re.MULTILINE) if self.starts else None
                if start:
                    f.seek(start - min(start, BACK))
                yield from records(opened(f, codec), path, start, None if codec else end, self.format, starts, self.cap)


def first_of_file(key: tuple, rows: pa.Table, cap: int, server: str | None, chunk: int) -> pa.Table:
    """(file, start, stop) of the reads that give each record of a file once: every range with a record's start, from there; stop is null for a packed file."""
    path, rows = key[0].as_py(), sorted(rows.to_pylist(), key=lambda r: r["start"])
    if rows[0]["packed"]:
        found = [(0, None, 0)]
    else:
        ranges = [Summary(r["start"], r["stop"], r["odd"], r["newline"], tuple(r["first"]), tuple(r["last"]), tuple(r["large"])) for r in rows]
        files = store(server, chunk)
        try:
            with files.open(path) as f:
                found = list(first_records(f, ranges, cap, rows[0]["bom"]))
        finally:
            files.close()
    # The first range is read from the file's start, as it may have a byte order mark.
    return pa.table({"file": [path] * len(found), "start": pa.array([0 if a == 0 else x for a, _, x in found], pa.int64()), "stop": pa.array([b for _, b, _ in found], pa.int64())})


def read_from_records(batches: Iterator[pa.RecordBatch], cap: int, server: str | None, chunk: int) -> Iterator[pa.RecordBatch]:
    """Records of rows (file, start, stop), each of which starts with one."""
    files = store(server, chunk)
    try:
        for row in (r for batch in batches for r in batch.to_pylist()):
            with files.open(row["file"]) as f:
                codec = files.codec(f, row["file"])
                f.seek(row["start"])
                yield from records(opened(f, codec), row["file"], row["start"], row["stop"], "csv", None, cap, at_record=True)
    finally:
        files.close()


class LogScan(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logloom_scan"

    def schema(self) -> str:
        return HEADS if self.options.get("heads") == "true" else QUOTES if self.options.get("quotes") == "true" else RECORDS

    def reader(self, schema) -> ScanReader:
        return ScanReader(dict(self.options))
