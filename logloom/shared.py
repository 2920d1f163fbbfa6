"""Tables in the folder that driver and executors share: how lineage is cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removes a query's shuffle files as soon as it ends; what it wrote is all that is read later.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A written table of up to so many rows of a few numbers may be broadcast (some 30 MB).
BROADCAST_ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new folder on a single machine, as in tests; an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str, instead_of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Cut the lineage of df: write it as Parquet into the shared folder and read it back.

    Tables in instead_of, written before and read by nothing but df, are deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/logloom-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    forget(*instead_of)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with the hint to broadcast it, if its count of rows allows that."""
    return F.broadcast(table) if table.count() <= rows else table
