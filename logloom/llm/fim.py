"""Fill-in-middle transformation by DuckDB inside Arrow batches.

Each batch is registered with an in-memory DuckDB of the task, in pieces of bounded bytes, and one
SQL statement cuts its texts into tokens, draws the cuts from a hash of the id and joins the parts
anew; no Python runs for a row. Rows are independent: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one statement works on, about; a longer text is alone.
PIECE_BYTES = 4 << 20


@dataclass(frozen=True)
class FimSpec:
    """Markers, shares (per cent of documents that are changed at all, and of those in suffix-first form) and seed."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    percent: int = 90
    spm_percent: int = 20
    seed: int = 1
    token: str = "[A-Za-z]+|[^A-Za-z]"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(len(m) < 2 or m[0] in m[1:] or m[-1] in m[:-1] for m in marks) or {m[0] for m in marks} & {m[-1] for m in marks}:
            raise ValueError("markers differ, and none begins or ends within itself or another")


def _sql(s: FimSpec) -> str:
    text = lambda x: "'" + str(x).replace("'", "''") + "'"
    p, f, m = map(text, (s.prefix, s.suffix, s.middle))
    group = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    part = lambda a, b: f"array_to_string(list_slice(t, {a}, {b}), '')"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256({text(f"{s.seed}:")} || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM piece
), c AS (
  SELECT *, regexp_extract_all(text, {text(s.token)}) AS t, {group(2)} % 100 >= {s.percent} OR text = '' OR contains(text, {p}) OR contains(text, {f}) OR contains(text, {m}) AS plain, {group(3)} % 100 < {s.spm_percent} AS spm FROM d
), u AS (
  SELECT doc_id, text, t, plain, spm, least({group(0)} % (len(t) + 1), {group(1)} % (len(t) + 1)) AS a, greatest({group(0)} % (len(t) + 1), {group(1)} % (len(t) + 1)) AS b FROM c
), x AS (
  SELECT doc_id, text, CAST(len(t) AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN NOT plain THEN {part('1', 'a')} END AS pre, CASE WHEN NOT plain THEN {part('a + 1', 'b')} END AS mid, CASE WHEN NOT plain THEN {part('b + 1', 'len(t)')} END AS suf FROM u
)
SELECT doc_id, n, form, CAST(length(pre) AS BIGINT) AS prefix_chars, CAST(length(mid) AS BIGINT) AS middle_chars,
  CASE form WHEN 'psm' THEN {p} || pre || {f} || suf || {m} || mid WHEN 'spm' THEN {f} || suf || {p} || pre || {m} || mid ELSE text END AS output FROM x
"""


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Runs of rows of PIECE_BYTES of text, about."""
    bytes_ = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    cuts = np.searchsorted(bytes_ // PIECE_BYTES, np.arange(1, (int(bytes_[-1]) // PIECE_BYTES if len(bytes_) else 0) + 1))
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if b > a:
            yield pa.Table.from_batches([batch.slice(a, b - a)])


def fill_in_middle(docs: DataFrame, spec: FimSpec = FimSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id_col>, n long, form string, prefix_chars, middle_chars long, output string), a row for each row.

    n counts the text's tokens; both cuts fall between tokens, by sha256 of "seed:id". form is plain
    (output is the text) for empty texts, texts that hold a marker and those beyond spec.percent, else
    psm or spm; the chars, in code points, are null if plain. A null text is empty; a null id hashes as
    an empty string. Rows of one id have the same draws. No rows in, no rows out; other columns are ignored.
    """
    kind, sql = docs.schema[id_col].dataType.simpleString(), _sql(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "preserve_insertion_order": True}) as con:
            for batch in batches:
                for piece in _pieces(batch):
                    con.register("piece", piece)
                    yield from con.sql(sql).to_arrow_reader(1024)
                    con.unregister("piece")

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").withColumnRenamed("doc_id", id_col)


def restored(output: Column, form: Column, spec: FimSpec = FimSpec()) -> Column:
    """The text that an output was made of, exactly: no part of it holds a marker, so the first of each is the one put in."""
    cut = lambda x, m, i: F.split_part(x, F.lit(m), F.lit(i))
    p, s, m = spec.prefix, spec.suffix, spec.middle
    middle = cut(output, m, 2)
    head = lambda first, second: cut(cut(output, second, 1), first, 2)
    return F.when(form == "psm", F.concat(head(p, s), middle, cut(cut(output, s, 2), m, 1))).when(form == "spm", F.concat(cut(cut(output, p, 2), m, 1), middle, head(s, p))).otherwise(output)
