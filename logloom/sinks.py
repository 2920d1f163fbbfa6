"""Reports as NDJSON and as aligned text, and the manifest of a log corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .functions import json_key
from .schema import TRUNCATED

#: What a section without rows shows.
NOTHING = "(nothing to report)"


def report_ndjson(name: str, sections: dict[str, DataFrame]) -> DataFrame:
    """(value) one JSON object a row: the summary's columns, then each section's rows as `name.section`.

    A report is its top lists and totals, so its rows are few; their order is kept. Without a summary there is no summary object.
    """

    def lines(at: int, label: str, df: DataFrame) -> DataFrame:
        body = df.select(F.to_json(F.struct(F.lit(label).alias("report"), *[F.col(f"`{c}`") for c in df.columns])).alias("value"))
        return body.select(F.lit(at).alias("at"), F.monotonically_increasing_id().alias("no"), "value")

    names = sorted(sections, key=lambda s: s != "summary")
    out = None
    for at, section in enumerate(names):
        x = lines(at, name if section == "summary" else f"{name}.{section}", sections[section])
        out = x if out is None else out.unionByName(x)
    return out.orderBy("at", "no").select("value")


def text_table(df: DataFrame, top: int = 1000) -> str:
    """A report section as aligned columns, the last one unpadded; a text table is for reading, so at most `top` rows."""
    rows = [["" if v is None else str(v) for v in r] for r in df.limit(top).collect()]
    if not rows:
        return NOTHING + "\n"
    widths = [max(len(x) for x in column) for column in zip(df.columns, *rows, strict=True)]
    shown = [df.columns, ["-" * w for w in widths], *rows]
    return "".join("  ".join([*(c.ljust(w) for c, w in zip(r[:-1], widths)), r[-1]]) + "\n" for r in shown)


def text_report(sections: dict[str, DataFrame], top: int = 1000) -> str:
    names = sorted(sections, key=lambda s: s != "summary")
    return "\n".join((f"{n}\n" if n != "summary" else "") + text_table(sections[n], top) for n in names)


#: Of the rules by which a corpus is rendered from events.
CORPUS_VERSION = 1


def manifest(lines: DataFrame, records: DataFrame, seed: int | None = None) -> DataFrame:
    """(key, name, value) of a corpus: version, the seed that its events were drawn with if given, bytes and lines of each file, records of each severity, and their totals."""
    size = lines.groupBy("file").agg(F.sum(F.octet_length("line") + 1).cast("long").alias("bytes"), F.count("*").alias("lines"))
    files = size.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col("file").alias("name"), F.col(k).alias("value")) for k in ("bytes", "lines")])).alias("x")).select("x.*")
    severity = records.groupBy(F.coalesce("severity", F.lit("UNKNOWN")).alias("name")).agg(F.count("*").alias("value"))
    severity = severity.select(F.lit("severity").alias("key"), "name", "value")
    totals = [files.where(F.col("key") == "bytes").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(F.lit("total").alias("key"), F.lit("bytes").alias("name"), "value"), severity.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(F.lit("total").alias("key"), F.lit("records").alias("name"), "value")]
    known = lines.sparkSession.createDataFrame([("corpus", k, v) for k, v in (("version", CORPUS_VERSION), ("seed", seed)) if v is not None], "key string, name string, value long")
    return known.unionByName(files).unionByName(severity).unionByName(totals[0]).unionByName(totals[1])


def watched(parsed: DataFrame, observation: Observation) -> DataFrame:
    """parsed, with counts of it taken as it is read: records, bytes (line ends included), malformed and truncated."""
    large = F.coalesce(F.col("_malformed") == "over-large record", F.lit(False))
    cut = F.col("flags").bitwiseAND(TRUNCATED) != 0
    return parsed.observe(
        observation, F.count_if(F.col("_malformed").isNull()).alias("records"), F.coalesce(F.sum(F.octet_length("raw") + 1), F.lit(0)).alias("bytes"),
        F.count_if(F.col("_malformed").isNotNull() & ~large).alias("malformed"), F.count_if(large | cut).alias("truncated"),
    )


def severity_counts(records: DataFrame) -> DataFrame:
    """One row of counts, a column for each severity that occurs, by its key."""
    return records.select(json_key(F.coalesce("severity", F.lit("UNKNOWN"))).alias("key")).groupBy().pivot("key").count()


def run_medians(runs: DataFrame) -> DataFrame:
    """(workload, tool, runs, median_s, min_s, max_s, mb_per_second) of runs (workload, tool, seconds, bytes_in); of an even number of runs, the upper median."""
    middle = F.element_at(F.array_sort(F.collect_list("seconds")), (F.floor(F.count("seconds") / 2) + 1).cast("int"))  # a few runs of each
    s = runs.groupBy("workload", "tool").agg(F.count("*").alias("runs"), middle.alias("median_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"), F.max("bytes_in").alias("bytes_in"))
    rate = F.when((F.col("median_s") > 0) & (F.col("bytes_in") > 0), F.col("bytes_in") / (1 << 20) / F.col("median_s")).otherwise(0.0)
    return s.withColumn("mb_per_second", rate).drop("bytes_in")


def bench_report(parsed: DataFrame) -> dict:
    """Parses everything and keeps nothing: records, bytes, malformed, truncated, elapsed_ns, ns_per_record, mb_per_second."""
    import time

    began = time.perf_counter_ns()
    # Columns of every kind are asked for, so that pruning leaves the parsing in.
    whole = F.xxhash64(*[c for c in parsed.columns if c not in ("file", "offset")])
    bad = F.col("_malformed").isNotNull() if "_malformed" in parsed.columns else F.lit(False)
    row = parsed.select(whole.alias("h"), F.octet_length("raw").alias("n"), bad.alias("bad"), (F.col("flags").bitwiseAND(TRUNCATED) != 0).alias("cut")).agg(
        F.count_if(~F.col("bad")).alias("records"), F.coalesce(F.sum(F.col("n") + 1), F.lit(0)).alias("bytes"), F.count_if("bad").alias("malformed"), F.count_if("cut").alias("truncated"), F.max("h").alias("h")
    ).first()
    took = time.perf_counter_ns() - began
    out = {k: row[k] for k in ("records", "bytes", "malformed", "truncated")}
    return out | {"elapsed_ns": took, "ns_per_record": took // row["records"] if row["records"] else 0, "mb_per_second": row["bytes"] / (1 << 20) / (took / 1e9)}
