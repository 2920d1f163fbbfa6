"""Following a directory of growing logs: a streaming source of whole records' lines.

Every batch ends at a record's end: the last line is held back until its newline is there, and
where records span lines, the last record is held back until the next one starts. So no state is
kept between batches, and a batch read again after a failure is the same byte ranges. The directory
is one that driver and executors share, or a server's (sources.stores).

Offsets name the files that changed last, a bounded number of them, and how far older ones reach.
Files that look as they did at the last trigger aren't opened.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..operators import good_records, parse_jsonlog, parse_lines
from ..prefix import record_start
from ..schema import LogReadOptions
from ..sources.csv_ranges import whole_until
from ..sources.files import Remote
from ..sources.stores import CHUNK_BYTES, RemoteStore, Seen, store

#: Bytes of a file's start that tell it from another of the same name.
HEAD_BYTES = 256
#: Bytes of one file that one task reads.
SPLIT_BYTES = 64 << 20
#: Files that an offset names.
MAX_FILES = 2500


@dataclass
class Range(InputPartition):
    path: str
    #: Lines whose first byte is in [start, end) are this task's; the range to cut begins at `begin`.
    begin: int
    start: int
    end: int
    #: Tells the file from others of its name.
    version: str = ""


def whole_records(f, size: int, starts: re.Pattern | None, max_bytes: int) -> int:
    """Where the last whole record of the first `size` bytes of an open file ends.

    Looks back from the end, in growing steps, for a line that starts a record; a record larger
    than max_bytes is handed over up to its last whole line.
    """
    step = 1 << 16
    while True:
        at = max(0, size - step)
        f.seek(at)
        tail = f.read(size - at)
        last = tail.rfind(b"\n") + 1
        if starts is None and (last or not at):
            return at + last if last else 0
        if starts is not None and last:
            end = last
            while end > 0:
                begin = tail.rfind(b"\n", 0, end - 1) + 1
                if begin == 0 and at > 0:
                    break  # may be the middle of a line
                if starts.match(tail[begin:end].decode("utf-8", "replace")):
                    return at + begin
                end = begin
        if at == 0 or step > max_bytes:
            return at + last if last and at else 0
        step *= 4


@dataclass(frozen=True)
class Place:
    """How far a file is read: end of the last whole record, and what it was like then.

    head is the first bytes as hex while they are fewer than HEAD_BYTES, their hash after "=" later,
    and empty where the store tells files by size alone.
    """

    end: int
    size: int
    changed: int
    identity: str
    head: str

    def version(self) -> str:
        """Tells the file from others of its name for sure; empty where that isn't known."""
        return f"{self.identity}/{self.head}" if self.identity and self.head.startswith("=") else ""


class FollowReader(DataSourceStreamReader):
    """Offsets are {"files": {path: Place as a list}, "older": [changed, path] or null}.

    files are the max_files that changed last; what "older" is at or after was read whole before them. A
    file is another one if it is smaller than what was read, or has another identity or head. A file
    that "files" had to drop and that then changes is read anew; one that comes with a time before
    "older" is taken for read.
    """

    def __init__(self, options: dict):
        self.directory, self.glob = options["path"], options.get("glob", "*")
        self.starts = re.compile(options["starts"], re.DOTALL) if options.get("starts") else None
        self.csv = options.get("format") == "csv"
        self.max_bytes = int(options.get("maxrecordbytes", 16 << 20))
        self.split, self.max_files = int(options.get("splitbytes", SPLIT_BYTES)), int(options.get("maxfiles", MAX_FILES))
        self.server, self.chunk = options.get("server"), int(options.get("chunkbytes", CHUNK_BYTES))
        #: Of the files at the last trigger: how they looked, whether one followed, and their places.
        self.known: dict[str, tuple[Seen, bool, Place]] = {}
        #: The last batch that was planned, and what batches of this run have reached before it and with it, by path.
        self.batch, self.before, self.reached = None, {}, {}

    def __getstate__(self) -> dict:
        return vars(self) | {"known": {}, "batch": None, "before": {}, "reached": {}}  # tasks only read

    def initialOffset(self) -> dict:
        return {"files": {}, "older": None}

    def _head(self, files, path: str) -> str:
        if isinstance(files, RemoteStore):
            return ""
        with files.open(path) as f:
            head = f.read(HEAD_BYTES)
        return head.hex() if len(head) < HEAD_BYTES else "=" + sha256(head).hexdigest()[:16]

    def _same(self, files, path: str, old: Place, new: Place) -> bool:
        if new.size < old.end or old.identity != new.identity:
            return False
        if old.head.startswith("=") or not new.head.startswith("="):
            return new.head.startswith(old.head)
        with files.open(path) as f:  # it has just grown out of its short head
            return f.read(len(old.head) // 2).hex() == old.head

    def _place(self, files, seen: Seen, followed: bool) -> Place:
        if (was := self.known.get(seen.path)) and was[:2] == (seen, followed):
            return was[2]
        place = Place(seen.size, seen.size, seen.changed, seen.identity, self._head(files, seen.path))
        old = next((p for p in (was and was[2], self.reached.get(seen.path)) if p and self._same(files, seen.path, p, place)), None)
        if followed:
            return place  # a file with a later one after it grows no more: its last record is whole
        with files.open(seen.path) as f:
            if self.csv:  # of a file that this run hasn't seen, all quotes are to be counted
                end = whole_until(f, old.end if old else 3 if f.read(3) == b"\xef\xbb\xbf" else 0, seen.size, self.max_bytes)
            else:
                end = whole_records(f, seen.size, self.starts, self.max_bytes)
        end = max(end, old.end) if old else end  # what was read stays read, also when the later file goes
        return Place(end, place.size, place.changed, place.identity, place.head)

    def latestOffset(self) -> dict:
        files = store(self.server, self.chunk)
        try:
            found = files.watch(self.directory, self.glob)
            recent = sorted(found, key=lambda s: (s.changed, s.path))
            older, recent = recent[: -self.max_files or None] if len(recent) > self.max_files else [], recent[-self.max_files :]
            last = found[-1].path if found else None
            self.known = {s.path: (s, s.path != last, self._place(files, s, s.path != last)) for s in recent}
        finally:
            files.close()
        return {"files": {path: list(vars(p).values()) for path, (_, _, p) in sorted(self.known.items())}, "older": [older[-1].changed, older[-1].path] if older else None}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files = store(self.server, self.chunk)
        try:
            return self._partitions(files, start, end)
        finally:
            files.close()

    def _partitions(self, files, start: dict, end: dict) -> list[Range]:
        out = []
        before, after = ({p: Place(*x) for p, x in o["files"].items()} for o in (start, end))
        old_line, new_line = (tuple(o["older"]) if o["older"] else (-1, "") for o in (start, end))
        if self.batch != (start, end):  # a batch may be planned more than once, and again from the start of one before
            self.batch, self.before = (start, end), self.reached if self.batch and self.batch[1] == start else {}
        reached = {}

        def ranges(path: str, begin: int, stop: int, version: str) -> None:
            out.extend(Range(path, begin, at, min(at + self.split, stop), version) for at in range(begin, stop, self.split))

        for path, new in sorted(after.items()):
            olds = [p for p in (before.get(path), self.before.get(path)) if p and self._same(files, path, p, new)]
            if olds or path in before or (new.changed, path) > old_line:
                begin = max((p.end for p in olds), default=0)
                ranges(path, begin, new.end, new.version())
                reached[path] = replace(new, end=max(begin, new.end))
        if new_line > old_line or before.keys() - after.keys():
            # Files that changed before those that the offset names: as they are now, unless they changed since.
            for s in files.watch(self.directory, self.glob):
                old = before.get(s.path)
                if s.path in after or (s.changed, s.path) > new_line or old is None and (s.changed, s.path) <= old_line:
                    continue
                ranges(s.path, old.end if old and old.identity == s.identity and s.size >= old.end else 0, s.size, "")
        self.reached = reached
        return sorted(out, key=lambda r: (r.path, r.start))

    def read(self, partition: Range) -> Iterator[tuple]:
        files = store(self.server, self.chunk)
        try:
            with files.by_line(partition.path) as f:
                at = partition.start
                if at > partition.begin:
                    f.seek(at - 1)
                    at += len(f.readline()) - 1  # the line that began before is another task's
                f.seek(at)
                while at < partition.end and (raw := f.readline()):
                    line = raw.decode("utf-8", "replace")
                    yield partition.path, at, (line.removeprefix("\ufeff") if at == 0 else line).removesuffix("\n"), not raw.endswith(b"\n"), partition.version, at + len(raw)
                    at += len(raw)
        finally:
            files.close()

    def commit(self, end: dict) -> None:
        pass


class LogFollow(DataSource):
    @classmethod
    def name(cls) -> str:
        return "logfollow"

    def schema(self) -> str:
        return "file string, offset bigint, line string, _cut boolean, version string, stop bigint"

    def streamReader(self, schema) -> FollowReader:
        return FollowReader(dict(self.options))


def follow_lines(spark: SparkSession, directory: str, options: LogReadOptions, glob: str = "*", split_bytes: int = SPLIT_BYTES, remote: Remote | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """Streaming (file, offset, seq, line, _cut, version, stop) of the files in a directory that driver and executors share, or of a server's.

    New files and appended lines come with each trigger. A missing directory is an error, an empty
    one is not. The checkpoint of the query that reads it keeps the places reached. Remote files are
    told from others of their name by size alone. version and stop (the byte after a line) tell what
    was delivered.
    """
    spark.dataSource.register(LogFollow)
    reader = spark.readStream.format("logfollow")
    settings = {"glob": glob, "splitbytes": split_bytes, "maxrecordbytes": options.max_record_bytes, "format": options.format, "maxfiles": max_files, "starts": record_start(options)}
    for k, v in (settings | (remote.options() if remote else {})).items():
        if v is not None:
            reader = reader.option(k, str(v))
    return reader.load(directory).withColumn("seq", F.col("offset"))


def follow_jsonlog(spark: SparkSession, directory: str, options: LogReadOptions = LogReadOptions("json"), glob: str = "*.json", remote: Remote | None = None) -> DataFrame:
    """Streaming records of jsonlog files: one line, one record, so no windows and no state."""
    return good_records(parse_jsonlog(follow_lines(spark, directory, options, glob, remote=remote), options))


def follow_records(spark: SparkSession, directory: str, options: LogReadOptions, sink: Callable[[DataFrame, int], None], checkpoint: str, glob: str = "*", remote: Remote | None = None, **trigger) -> StreamingQuery:
    """Hands each batch's records, good and malformed (_malformed), of any stated format to sink(records, batch id)."""
    if options.format == "auto":
        raise ValueError("a followed directory needs a stated format")

    def batch(lines: DataFrame, no: int) -> None:
        sink(parse_lines(lines, options), no)

    lines = follow_lines(spark, directory, options, glob, remote=remote)
    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


class Delivery:
    """Records of a followed directory in a folder, each once: a batch counts when its marker stands.

    A batch is written to batch=N and then named in _delivered/N, with the places that its files
    reached. A batch that comes again after its marker is dropped, one that was broken off is written
    anew, and lines before a place that an earlier batch reached in the same version of a file are left
    out, whatever the source says. Places of max_files files are kept, those of the last batches first.
    """

    def __init__(self, spark: SparkSession, path: str, max_files: int = MAX_FILES):
        self.spark, self.path, self.max_files = spark, path.rstrip("/"), max_files
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def batches(self) -> list[int]:
        """Numbers of the batches that count."""
        folder = self._path(f"{self.path}/_delivered")
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(folder) if x.getPath().getName().isdigit()) if self._fs.exists(folder) else []

    def _reached(self, batch: int) -> dict[str, list]:
        text = self.spark.read.text(f"{self.path}/_delivered/{batch}", wholetext=True).first()
        return json.loads(text[0]) if text else {}

    def write(self, lines: DataFrame, no: int, parse: Callable[[DataFrame], DataFrame]) -> None:
        done = self.batches()
        if no in done:
            return
        reached = self._reached(done[-1]) if done else {}
        if reached:
            places = F.broadcast(self.spark.createDataFrame([(f, v, s) for f, (v, s) in reached.items()], "file string, old string, reached long"))
            held = (F.col("version") != "") & (F.col("version") == F.col("old")) & (F.col("offset") < F.col("reached"))
            lines = lines.join(places, "file", "left").where(~F.coalesce(held, F.lit(False))).drop("old", "reached")
        # A row a file: what this batch reaches.
        now = lines.groupBy("file").agg(F.max_by("version", "stop").alias("version"), F.max("stop").alias("stop")).collect()
        parse(lines).write.mode("overwrite").parquet(f"{self.path}/batch={no}")
        reached = {f: x for f, x in reached.items() if f not in {r.file for r in now}} | {r.file: [r.version, r.stop] for r in now}
        self._mark(no, json.dumps(dict(list(reached.items())[-self.max_files :])))

    def _mark(self, no: int, text: str) -> None:
        part = self._path(f"{self.path}/_delivered/_{no}")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(part, self._path(f"{self.path}/_delivered/{no}")):
            raise RuntimeError(f"batch {no} can't be marked as delivered")

    def read(self) -> DataFrame:
        """Records of the batches that count, with their number as column batch."""
        done = self.batches()
        if not done:
            raise FileNotFoundError(f"no batch has been delivered to {self.path}")
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch={n}" for n in done])


def follow_once(spark: SparkSession, directory: str, options: LogReadOptions, delivery: Delivery, checkpoint: str, glob: str = "*", remote: Remote | None = None, **trigger) -> StreamingQuery:
    """Writes records, good and malformed, of a followed directory to a Delivery, each once over any number of restarts."""
    if options.format == "auto":
        raise ValueError("a followed directory needs a stated format")
    lines = follow_lines(spark, directory, options, glob, remote=remote)
    batch = lambda df, no: delivery.write(df, no, lambda x: parse_lines(x, options))
    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def streaming_peaks(records: DataFrame, bucket: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Records, problems and durations a time bucket; a bucket is final once the watermark has passed it."""
    from ..plans import WARNING

    w = F.window("time", bucket)
    return records.where("time IS NOT NULL").withWatermark("time", delay).groupBy(w).agg(
        F.count("*").alias("records"), F.count_if(F.col("severity_rank") >= WARNING).alias("problems"), F.count_if(F.col("duration_ns").isNotNull()).alias("slow")
    ).select(F.col("window.start").alias("start"), "records", "problems", "slow")


def streaming_counts(records: DataFrame) -> DataFrame:
    """Running counts by database and severity; the state is one row a pair."""
    return records.groupBy("database", "severity").agg(F.count("*").alias("count"))
