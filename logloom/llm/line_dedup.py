"""Line dedup across documents.

Hashes of line keys are range-partitioned and sorted by key, document (largest first) and
position, so that a task streams every key's documents past and knows the first as the keeper.
Range borders may fall inside a key, which splits a very common line over many tasks; the first
run of every task therefore stays open and is settled by one summary row for each border run.
The result is a compressed keep bitmap for each document, not text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import shuffle_partitions, written

_CONTINUATION = re.compile(rb"[\x80-\xbf]")


def _key(line: bytes, min_chars: int) -> bytes | None:
    """Stripped, A-Z lower-cased line; None if it has fewer than min_chars code points."""
    line = line.strip()  # of bytes: blank and \x09-\x0D
    n = len(line)
    if n < min_chars or n < 4 * min_chars and n - len(_CONTINUATION.findall(line)) < min_chars:
        return None
    return line.lower()  # of bytes: A-Z only


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bitmaps of the lines that stay, for the documents that lose some.

    Returns <id_col>, fp long (xxhash64 of the text, which tells rows of one id apart), n_lines
    long, n_dropped long, keep binary (zlib of the packed bits, first line in the highest bit). A key
    (line stripped of blank and \\x09-\\x0D, A-Z lower-cased) of min_chars code points or more
    that occurs in min_docs ids or more loses its lines in all but the largest id. Null and empty
    texts are one empty line. A null id is one id, smaller than all others. Rows of the same id
    count as one document for a key; equal rows are treated alike. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("fp"), F.coalesce(text_col, F.lit("")).cast("binary").alias("t"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, batch.num_rows, 512):
                rows, digests, pos = [], [], []
                for i, text in enumerate(batch.column(2).slice(at, 512).to_pylist(), at):
                    found: dict[bytes, list[int]] = {}
                    split = text.split(b"\n")
                    for p, line in enumerate(split):
                        if (k := _key(line, min_chars)) is not None:
                            found.setdefault(xxhash.xxh3_128_digest(k), []).append(p)
                    for d, ps in found.items():
                        rows.append((i, len(split)))
                        digests.append(d)
                        pos.append(ps)
                h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                at_rows = [r for r, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), ids.take(pa.array(at_rows, pa.int64())), pa.array([fps[r] for r in at_rows], pa.int64()), pa.array([n for _, n in rows], pa.int64()), pa.array(pos, pa.list_(pa.int32()))],
                    names=["h1", "h2", "id", "fp", "n", "pos"],
                )

    fields = f"h1 long, h2 long, id {kind}, fp long, n long, pos array<int>"
    order = ["h1", "h2", F.col("id").desc_nulls_last()]
    ranged = base.mapInArrow(lines, fields).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "fp")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Drops of settled runs, rows of open runs (with their key), and marks of border runs (with key and n_docs)."""
        run: tuple | None = None
        first, n_docs, last, keeper, held, id_type = True, 0, None, None, [], None

        def batch_of(out):
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), id_type, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()), strict=True)], names=["h1", "h2", "id", "fp", "n", "pos", "docs"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            out = []
            for h1, h2, doc, fp, n, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h1, h2) != run:
                    if run is not None and first:
                        out.append((*run, keeper, None, None, None, n_docs))
                        first = False
                    run, n_docs, keeper, held = (h1, h2), 0, doc, []
                if n_docs == 0 or doc != last:
                    n_docs, last = n_docs + 1, doc
                if first:
                    out.append((h1, h2, doc, fp, n, pos, None))
                elif n_docs < min_docs:
                    held.append((doc, fp, n, pos))
                else:
                    out += [(None, None, *x, None) for x in held if x[0] != keeper]
                    held = []
                    if doc != keeper:
                        out.append((None, None, doc, fp, n, pos, None))
            yield batch_of(out)
        if run is not None:  # the last run may go on in the next task
            yield batch_of([(*run, *x, None) for x in held] + [(*run, keeper, None, None, None, n_docs)])

    found = written(ranged.mapInArrow(stream, fields + ", docs long"), "lines")
    # Two marks a task at most: bounded by the number of shuffle partitions.
    marks = found.where("docs IS NOT NULL").groupBy("h1", "h2").agg(F.sum("docs").alias("n_docs"), F.max("id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    settled = found.where("docs IS NULL AND h1 IS NULL")
    opened = found.where("docs IS NULL AND h1 IS NOT NULL").join(F.broadcast(marks), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    columns = ["id", "fp", "n", "pos"]
    drops = settled.select(columns).unionByName(opened.select(columns)).groupBy("id", "fp").agg(F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("pos"))).alias("pos"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, dropped = [], []
            for n, pos in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                bits = np.ones(n, np.uint8)
                bits[pos] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
                dropped.append(len(pos))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())], names=[id_col, "fp", "n_lines", "n_dropped", "keep"])

    return drops.mapInArrow(bitmaps, f"{id_col} {kind}, fp long, n_lines long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with only the kept lines in their texts, and line_counts struct<n_lines, n_dropped>.

    A text without a bitmap stays whole; a null text becomes empty. Other columns stay, whatever
    their names, but for one named line_counts, which is replaced.
    """
    rows = docs.drop("line_counts")
    names, schema = rows.columns, rows.schema
    left = rows.select(F.struct(*names).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("fp"))
    right = bitmaps.select(F.col(id_col).alias("id2"), F.col("fp").alias("fp2"), "keep")
    joined = left.join(right, F.col("id").eqNullSafe(F.col("id2")) & (F.col("fp") == F.col("fp2")), "left").select("row", "keep")
    at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, texts, counts = batch.column(0).flatten(), [], []
            for text, keep in zip(cols[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
                split = (text or "").split("\n")
                n = len(split)
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
                    split = [x for x, b in zip(split, bits.tolist(), strict=True) if b]
                texts.append("\n".join(split))
                counts.append({"n_lines": n, "n_dropped": n - len(split)})
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64())]))], names=[*names, "line_counts"])

    return joined.mapInArrow(cut, StructType([*schema.fields, StructField("line_counts", StructType().add("n_lines", "long").add("n_dropped", "long"))]))
