"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The events are rendered once, untimed, to log files; what is timed reads those files. Each query's
figure is the median of RUNS after one run that is not counted.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import plans
from logloom.queries import QUERIES
from logloom.schema import LogReadOptions
from logloom.sources.files import read_log
from logloom.sources.render import LINES, PREFIX

RUNS = 3
#: Least duration of the slow report: about a third of the rendered durations are longer.
SLOW_NS = 50_000_000
#: Bytes of a file for one task: a few tasks for each core at this size of corpus.
SPLIT = 1 << 20


def render(spark: SparkSession, sf: str, into: str) -> None:
    """Log files of each format, one a day."""
    for format_, lines in LINES.items():
        text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"]), "\n")
        os.makedirs(f"{into}/{format_}")
        for r in lines(spark.read.parquet(f"{sf}/events.parquet")).groupBy("file").agg(text.alias("text")).toLocalIterator():
            with open(f"{into}/{format_}/{r.file}.log", "w") as f:
                f.write(r.text + "\n")


def headline(spark: SparkSession, sf: str, logs: str) -> dict[str, Callable[[], DataFrame]]:
    """W1 parse and discard (three formats), W2 severity histogram, W3 errors, W4 slow, the other reports and search."""
    read = lambda f: read_log(spark, f"{logs}/{f}", LogReadOptions(f, PREFIX), glob="*.log", split_bytes=SPLIT)
    csv = lambda: read("csv")
    return {f"parse_{f}log" if f != "stderr" else "parse_stderr": lambda f=f: read(f) for f in LINES} | {
        "stats_severity": lambda: plans.stats(csv())["severity"], "stats_kinds": lambda: plans.stats(csv())["kind"],
        "errors_top_messages": lambda: plans.errors(csv())["message"], "slow_slowest": lambda: plans.slow(csv(), min_ns=SLOW_NS)["slowest"],
        "connections_by_user": lambda: plans.connections(csv())["by_user"], "locks_summary": lambda: plans.locks(csv())["summary"],
        "peaks_10m": lambda: plans.peaks(csv())["buckets"], "system_summary": lambda: plans.system(csv())["summary"],
        "grep_context": lambda: QUERIES["grep_context"](spark, sf), "template_groups": lambda: plans.template_groups(csv()),
    }


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    with tempfile.TemporaryDirectory(prefix="bench-logs-") as logs:
        render(spark, sf, logs)
        queries = headline(spark, sf, logs)
        empty = [name for name, query in queries.items() if not query().take(1)]  # also warms up, untimed
        if empty:
            raise SystemExit(f"nothing to measure in {empty}")
        for name, query in queries.items():
            each = []
            for _ in range(1 + RUNS):
                began = time.perf_counter()
                query().write.format("noop").mode("overwrite").save()
                each.append(time.perf_counter() - began)
            took[name] = round(median(each[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
