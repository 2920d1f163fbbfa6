"""Command line: python -m logloom REPORT [options] [PATH ...].

Exit code 0: done; 1: bad usage or an error in reading; 2: no input matched. Reports go to standard
output, diagnostics to standard error. Without a path, standard input is read, by way of a file in
the shared folder.
"""

from __future__ import annotations

import argparse
import re
import sys
import uuid
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans, sinks
from .schema import LogReadOptions
from .shared import shared_dir
from .sources.files import read_log

OK, ERROR, NO_INPUT = 0, 1, 2
REPORTS = ("parse", "stats", "errors", "slow", "connections", "locks", "peaks", "system", "grep", "bench", "patterns")
_FORMATS = {"": "auto", "auto": "auto", "stderr": "stderr", "csv": "csv", "csvlog": "csv", "json": "json", "jsonlog": "json"}
_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


class Usage(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise Usage(message)


def seconds(text: str) -> float:
    """A duration such as 500ms, 10m, 1h30m or -1s; 0 needs no unit."""
    sign, rest = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", rest)
    if rest != "0" and (not parts or "".join(a + b for a, b in parts) != rest):
        raise Usage(f"not a duration: {text!r}")
    return sign * sum(float(a) * _SECONDS[b] for a, b in parts)


def bucket(text: str) -> str:
    """Length of a window for a duration: ten minutes for none or less, a microsecond at least."""
    s = seconds(text)
    return f"{max(1, round(s * 1e6))} microseconds" if s > 0 else "10 minutes"


def arguments() -> argparse.ArgumentParser:
    p = _Parser(prog="python -m logloom", description=__doc__.split("\n\n")[0])
    p.add_argument("report", choices=REPORTS)
    p.add_argument("paths", nargs="*")
    p.add_argument("--format", default="", help="stderr, csvlog or jsonlog (default: detect)")
    p.add_argument("--line-prefix", help="log_line_prefix of stderr logs (default: detect)")
    p.add_argument("--lang", default="en", help="lc_messages of the server")
    p.add_argument("--begin", help="leave out records before this time")
    p.add_argument("--end", help="leave out records at or after this time")
    p.add_argument("--output", default="text", choices=("text", "json"))
    p.add_argument("--top", type=int, default=10, help="rows of a top list")
    p.add_argument("--min-duration", default="0s", help="slow: least duration")
    p.add_argument("--bucket", default="10m", help="peaks: length of a bucket")
    p.add_argument("--pattern", help="grep: what the text must hold")
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("-v", "--invert", action="store_true")
    p.add_argument("-B", "--before", type=int, default=0)
    p.add_argument("-A", "--after", type=int, default=0)
    p.add_argument("-C", "--context", type=int, default=0, help="grep: as -B and -A of so many")
    p.add_argument("--jobs", type=int, default=0, help="tasks at a time where no session is given (default: one per CPU)")
    p.add_argument("--no-color", action="store_true", help="output never has colours")
    return p


@dataclass
class Result:
    """Sections of a report, or text rows of one column `value`."""

    sections: dict[str, DataFrame] | None = None
    rows: DataFrame | None = None


def report(records: DataFrame, a: argparse.Namespace) -> Result:
    top = a.top if a.top > 0 else 10
    in_order = lambda df: df.orderBy("file", "offset")
    if a.report == "parse":
        records = in_order(records)
        return Result(rows=plans.ndjson(records) if a.output == "json" else records.select(plans.L.record_line().alias("value")))
    if a.report == "grep":
        if not a.pattern:
            raise Usage("grep needs --pattern")
        found = in_order(plans.grep(records, a.pattern, a.before or a.context, a.after or a.context, a.ignore_case, a.invert))
        return Result(rows=plans.ndjson(found) if a.output == "json" else found.select(F.col("raw").alias("value")))
    if a.report == "patterns":
        return Result({"pattern": plans.template_groups(records, top)})
    run = {
        "stats": lambda: plans.stats(records), "errors": lambda: plans.errors(records, top), "connections": lambda: plans.connections(records, top), "locks": lambda: plans.locks(records, top),
        "slow": lambda: plans.slow(records, top, int(seconds(a.min_duration) * 1e9)), "peaks": lambda: plans.peaks(records, bucket(a.bucket), top), "system": lambda: plans.system(records, top),
    }[a.report]
    return Result(run())


def main(argv: list[str], spark: SparkSession | None = None, stdin: TextIO | None = None, out: TextIO | None = None, err: TextIO | None = None) -> int:
    stdin, out, err = stdin or sys.stdin, out or sys.stdout, err or sys.stderr
    try:
        a = arguments().parse_intermixed_args(argv)
        if a.format not in _FORMATS:
            raise Usage(f"unknown --format {a.format!r}; use stderr, csvlog or jsonlog")
        seconds(a.min_duration), seconds(a.bucket)
        begin, end = (plans.time_literal(x) if x else None for x in (a.begin, a.end))
    except (Usage, ValueError) as e:
        print(f"logloom: {e}", file=err)
        return ERROR
    except SystemExit:  # --help
        return OK
    spark = spark or (SparkSession.builder.master(f"local[{a.jobs}]") if a.jobs > 0 else SparkSession.builder).appName("logloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    options = LogReadOptions(_FORMATS[a.format], a.line_prefix, a.lang)
    try:
        paths, spooled = a.paths, None
        if not paths:
            spooled = _spool(spark, stdin)
            if not spooled:
                print("logloom: no input matched", file=err)
                return NO_INPUT
            paths = [spooled]
        parsed = read_log(spark, paths, options, malformed=True, glob="*" if spooled else None)
        if a.report == "bench":
            print(sinks.text_report({"summary": spark.createDataFrame([sinks.bench_report(parsed)])}), file=out)
            return OK
        records = plans.in_range(parsed.where("_malformed IS NULL").drop("_malformed"), begin, end)
        if records.isEmpty():
            print("logloom: no input matched", file=err)
            return NO_INPUT
        result = report(records, a)
        if result.rows is not None:
            for r in result.rows.toLocalIterator():
                print(r.value, file=out)
        elif a.output == "json":
            for r in sinks.report_ndjson(a.report, result.sections).toLocalIterator():
                print(r.value, file=out)
        else:
            print(sinks.text_report(result.sections), end="", file=out)
    except Usage as e:
        print(f"logloom: {e}", file=err)
        return ERROR
    except Exception as e:  # the command line's edge: whatever went wrong is told, with exit code 1
        print(f"logloom: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=err)
        return ERROR
    return OK


#: Characters of standard input that are held at a time.
SPOOL_CHARS = 1 << 20


def _spool(spark: SparkSession, stdin: TextIO) -> str | None:
    """Standard input as one file in the shared folder, piece by piece; None if it is empty."""
    piece = stdin.read(SPOOL_CHARS)
    if not piece:
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/logloom-stdin-{uuid.uuid4().hex}/stdin")
    out = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path)
    try:
        while piece:
            out.write(bytearray(piece.encode("utf-8", "surrogateescape")))
            piece = stdin.read(SPOOL_CHARS)
    finally:
        out.close()
    return path.getParent().toString()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
