"""Log files and directories of them as lines and records."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import good_records, parse_records
from ..prefix import record_start
from ..schema import LogReadOptions
from .scan import RECORDS, SPLIT_BYTES, LogScan, first_of_file, read_from_records, task_bytes
from .stores import CHUNK_BYTES, Session, as_option, store

#: Names that a directory is read for, by format.
GLOBS = {"csv": "*.csv", "json": "*.json", "stderr": "*.log", "auto": "*.log"}


def read_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """(file, seq, line) of text files, plain or compressed by a codec that Spark tells by its extension.

    seq is a struct of the split's first byte and a number that ascends within it, so that it orders
    a file's lines however the file was split. A missing path is an error; an empty directory is not.
    """
    reader = spark.read.option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("no")).alias("seq"), F.col("value").alias("line"))


@dataclass(frozen=True)
class Remote:
    """A server's log directory: server() opens a session (stores.Session), in the driver and in tasks.

    chunk_bytes is what one query fetches at most, connections (0: no bound) how many tasks read at a time.
    """

    server: Callable[[], Session]
    chunk_bytes: int = CHUNK_BYTES
    connections: int = 0

    def options(self) -> dict:
        return {"server": as_option(self.server), "chunkbytes": self.chunk_bytes, "connections": self.connections}


def _scan(spark: SparkSession, paths: list[str], glob: str | None, remote: Remote | None = None, **options) -> DataFrame:
    spark.dataSource.register(LogScan)
    reader = spark.read.format("logloom_scan").option("paths", json.dumps(paths))
    for k, v in (options | {"glob": glob, "slots": spark.sparkContext.defaultParallelism} | (remote.options() if remote else {})).items():
        if v is not None:
            reader = reader.option(k, str(v))
    return reader.load()


def kinds(spark: SparkSession, path: str | list[str], glob: str | None = None, remote: Remote | None = None) -> DataFrame:
    """(file, format, prefix) of each file with a line in it, found from its own head; prefix null for csv and json."""
    return _scan(spark, [path] if isinstance(path, str) else path, glob, remote, heads="true")


def read_records(spark: SparkSession, path: str | list[str], o: LogReadOptions, glob: str | None = None, split_bytes: int | None = None, remote: Remote | None = None) -> DataFrame:
    """Framed text (file, offset, raw, ...) of files in a stated format, plain or compressed.

    No shuffle, but for csvlog files of several ranges: their quotes are counted first, and one row a
    range is shuffled to find where its first record begins. Remote files are cut at their chunks.
    """
    paths = [path] if isinstance(path, str) else path
    split = split_bytes or (remote.chunk_bytes if remote else SPLIT_BYTES)
    if o.format == "csv":
        cap, server, chunk = o.max_record_bytes, as_option(remote.server) if remote else None, remote.chunk_bytes if remote else CHUNK_BYTES
        files = store(server, chunk)
        sizes = [size for p in paths for _, size in files.list(p, glob)]
        files.close()
        if any(size >= split for size in sizes):
            firsts = _scan(spark, paths, glob, remote, quotes="true", maxrecordbytes=cap, splitbytes=split).groupBy("file").applyInArrow(lambda key, rows: first_of_file(key, rows, cap, server, chunk), "file string, start bigint, stop bigint")
            n = max(1, math.ceil(sum(sizes) / task_bytes(sum(sizes), split, spark.sparkContext.defaultParallelism)))
            return firsts.repartition(min(n, remote.connections) if remote and remote.connections else n).mapInArrow(lambda batches: read_from_records(batches, cap, server, chunk), RECORDS)
    return _scan(spark, paths, glob, remote, format=o.format, starts=_multiline(record_start(o)), maxrecordbytes=o.max_record_bytes, splitbytes=split)


def _multiline(starts: str | None) -> str | None:
    return None if starts is None else f"^(?:{starts})"


def read_log(spark: SparkSession, path: str | list[str], options: LogReadOptions = LogReadOptions(), malformed: bool = False, glob: str | None = None, split_bytes: int | None = None, remote: Remote | None = None) -> DataFrame:
    """Records of log files; with malformed, also the rows that are none, column _malformed saying why.

    A directory is read for the names that its format goes by, *.log where the format is open; a glob
    says otherwise. Files are read in ranges of split_bytes. Where format or prefix are open, each file has its own, by its
    head; a missing path is an error, a directory without files is not. With remote, path is a log
    directory, or a file in it, of that server, as the server names it.
    """
    o, glob = options, glob or GLOBS.get(options.format)
    read = lambda p, o: parse_records(read_records(spark, p, o, glob, split_bytes, remote), o)
    if o.format != "auto" and (o.format != "stderr" or o.line_prefix is not None):
        parsed = read(path, o)
    else:
        groups: dict[tuple, list[str]] = {}  # a name for each file, as listing them has
        for r in kinds(spark, path, glob, remote).collect():
            format_ = r.format if o.format == "auto" else o.format
            prefix = None if format_ != "stderr" else r.prefix if o.line_prefix is None else o.line_prefix
            groups.setdefault((format_, prefix), []).append(r.file)
        branches = [read(files, replace(o, format=f, line_prefix=p)) for (f, p), files in sorted(groups.items(), key=str)]
        parsed = reduce(DataFrame.unionByName, branches) if branches else read(path, replace(o, format="json"))
    return parsed if malformed else good_records(parsed)
