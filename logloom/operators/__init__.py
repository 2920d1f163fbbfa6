"""From text to records: framing and parsing of the three formats.

Framed text is rows (file, offset, raw), which sources.scan reads from files without a shuffle.
Lines that come otherwise, rows (file, seq, line) with seq ascending within a file, are framed by a
window over one file.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as L
from ..prefix import CONTINUATIONS, compile_prefix, record_start
from ..schema import CSV_COLUMNS, HAS_DURATION, HAS_STATEMENT, INTS, JSON_KEYS, LONGS, MULTILINE, NEEDS_UNQUOTE, RECORD_COLUMNS, TEXT, TRUNCATED, LogReadOptions

def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _with_offsets(lines: DataFrame) -> DataFrame:
    """Adds offset: bytes before each line of its file, ends of lines included."""
    if "offset" in lines.columns:
        return lines
    before = Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)))


def _trim_cr(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\z", "")


def once(c: Column) -> Column:
    """c as a generated column: what filters and aggregates make of it later doesn't parse again."""
    return F.explode(F.array(c))


def finish(df: DataFrame, o: LogReadOptions, format_: str) -> DataFrame:
    """Canonical columns plus _malformed from text columns (raw values), file, offset, raw, _reason, _unquote."""
    have = set(df.columns)
    text = lambda c: F.col(c) if c in have else _null()
    out = df.withColumns({c: L.nonempty(text(c)) for c in TEXT})
    out = out.withColumns({c: L.strict_int(text(c)) for c in INTS} | {c: L.strict_int(text(c), "bigint") for c in LONGS})
    stamp = L.parse_timestamp(text("log_time"))
    out = out.withColumns({"time": F.coalesce(stamp, L.parse_epoch(text("epoch"))) if "epoch" in have else stamp, "session_start": L.parse_timestamp(text("session_start")), "severity": L.severity(F.col("raw_severity"), o.lang)})
    out = out.withColumns({"severity_rank": L.severity_rank(F.col("severity")), "sql_state": F.when(F.octet_length("sql_state") == 5, F.col("sql_state")), "statement": F.col("query"), "duration_ns": L.duration_ns(F.col("message")), "format": F.lit(format_)})
    cond = lambda c, bit: F.when(c, bit).otherwise(0)
    flags = cond(F.col("_unquote"), NEEDS_UNQUOTE) + cond(F.contains("raw", F.lit("\n")), MULTILINE) + cond(F.col("duration_ns").isNotNull(), HAS_DURATION) + cond(F.col("statement").isNotNull(), HAS_STATEMENT)
    if "_cut" in have:
        flags = flags + cond(F.col("_cut"), TRUNCATED)
        if o.no_truncated_tail:
            out = out.where(~F.col("_cut") | ((F.lit(format_) == "stderr") & F.contains("raw", F.lit("\n"))))
    large = F.octet_length("raw") > o.max_record_bytes
    if "_large" in have:
        large = large | F.col("_large")
    return out.withColumn("flags", flags.cast("int")).withColumn("_malformed", F.when(large, "over-large record").otherwise(F.col("_reason"))).select(*RECORD_COLUMNS, "_malformed")


def frame_jsonlog(lines: DataFrame) -> DataFrame:
    """One line, one record; no shuffle, and an offset only where the lines have one."""
    raw = _trim_cr(F.col("line"))
    offset = F.col("offset") if "offset" in lines.columns else F.lit(None).cast("long")
    return lines.where(F.trim(raw) != "").select("file", offset.alias("offset"), raw.alias("raw"), *_cut_of(lines))


def _cut_of(lines: DataFrame) -> list[str]:
    return ["_cut"] if "_cut" in lines.columns else []


#: A backslash before what may be no escape, or half of a surrogate pair; and the pieces that a text with one is cut into.
_ODD_ESCAPE = r'\\(?:[^"\\/bfnrtu]|u(?![0-9a-fA-F]{4})|u[dD][89a-fA-F])'
_PIECES = r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|(?s:\\.)|[^\\]+|\\"


def mended_json(raw: Column) -> Column:
    """JSON text with escapes that are none kept as they are written, and lone surrogates as U+FFFD."""

    def piece(x: Column) -> Column:
        lone = (F.length(x) == 6) & x.rlike(r"^\\u[dD][89a-fA-F]")
        known = ~x.startswith("\\") | x.rlike(r'^\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')
        return F.when(lone, F.lit("\\ufffd")).when(known, x).otherwise(F.concat(F.lit("\\"), x))

    return F.when(F.contains(raw, F.lit("\\")) & raw.rlike(_ODD_ESCAPE), F.array_join(F.transform(F.regexp_extract_all(raw, F.lit(_PIECES), F.lit(0)), piece), "")).otherwise(raw)


def json_records(records: DataFrame, o: LogReadOptions) -> DataFrame:
    schema = ", ".join(f"`{k}` string" for k in JSON_KEYS) + ", _corrupt string"
    j = records.where(F.trim("raw") != "").withColumn("mended", mended_json(F.col("raw"))).withColumn("j", once(F.from_json("mended", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowUnquotedControlChars": "true"})))
    k = lambda n: F.col("j")[n]
    names = {"log_time": "timestamp", "user": "user", "database": "dbname", "process_id": "pid", "session_id": "session_id", "session_line_num": "line_num", "command_tag": "ps", "session_start": "session_start",
             "virtual_xid": "vxid", "transaction_id": "txid", "raw_severity": "error_severity", "sql_state": "state_code", "message": "message", "detail": "detail", "hint": "hint", "internal_query": "internal_query",
             "internal_query_pos": "internal_position", "context": "context", "query": "statement", "query_pos": "cursor_position", "application_name": "application_name", "backend_type": "backend_type", "leader_pid": "leader_pid", "query_id": "query_id"}
    place = F.concat_ws(":", k("file_name"), k("file_line_num"))
    # Values are flat. A second bracket is rare enough to look at the whole object again.
    inner = F.substring(F.ltrim("raw"), 2, 1 << 30)
    nested = (F.contains(inner, F.lit("{")) | F.contains(inner, F.lit("["))) & F.coalesce(F.schema_of_variant(F.try_parse_json("mended")).rlike(": (OBJECT|ARRAY)<"), F.lit(False))
    return j.withColumns({c: k(n) for c, n in names.items()} | {
        "connection_from": F.when(L.nonempty(k("remote_host")).isNotNull(), F.concat_ws(":", k("remote_host"), L.nonempty(k("remote_port")))),
        "location": F.concat_ws(", ", L.nonempty(k("func_name")), L.nonempty(place)),
        "_reason": F.when(~F.ltrim("raw").startswith("{") | k("_corrupt").isNotNull() | F.col("j").isNull() | nested, "bad json"),
        "_unquote": F.contains("raw", F.lit("\\")),
    })


def frame_csvlog(lines: DataFrame) -> DataFrame:
    """(file, offset, raw): a line end is a record end where an even number of quotes precede it."""
    order = Window.partitionBy("file").orderBy("seq")
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    before = F.coalesce(F.sum(quotes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    x = _with_offsets(lines).withColumn("starts", before == 0).where(~F.col("starts") | (_trim_cr(F.col("line")) != ""))
    x = x.withColumn("record", F.sum(F.col("starts").cast("int")).over(order))
    return _collected(x, "line").withColumn("raw", _trim_cr(F.col("raw")))


def _collected(x: DataFrame, line: str) -> DataFrame:
    """Lines with their record's number as (file, offset, raw)."""
    cut = [F.max(c).alias(c) for c in _cut_of(x)]
    return x.groupBy("file", "record").agg(F.min("offset").alias("offset"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line))), lambda s: s[line]), "\n").alias("raw"), *cut).drop("record")


def csv_records(records: DataFrame, o: LogReadOptions) -> DataFrame:
    """Layouts of 23, 24, 26 columns and beyond; later columns are dropped, missing ones null."""
    ddl = ", ".join(f"`{c}` string" for c in CSV_COLUMNS)
    f = records.withColumn("c", once(F.from_csv("raw", F.lit(ddl), {"escape": '"', "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"})))
    if "_fields" in records.columns:
        n, open_ = F.col("_fields"), F.col("_open")
    else:
        bare = F.regexp_replace("raw", r'"[^"]*+"', "")  # a doubled quote stands between two such runs
        n, open_ = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1, F.contains(bare, F.lit('"'))
    return f.withColumns({c: F.col("c")[c] for c in CSV_COLUMNS} | {"_reason": F.when(open_, "unterminated quote").when(n < 23, "too few fields"), "_unquote": F.contains("raw", F.lit('""'))})


def _head_of(o: LogReadOptions) -> tuple[str, list[str]]:
    pattern, fields = compile_prefix(o.line_prefix or "")
    return "(?s)^" + pattern, fields


def frame_stderr(lines: DataFrame, o: LogReadOptions) -> DataFrame:
    """(file, offset, raw): what starts a record, or stands after a blank line, and the lines up to the next or a blank one."""
    order = Window.partitionBy("file").orderBy("seq")
    x = _with_offsets(lines).withColumn("line", _trim_cr(F.col("line"))).withColumn("blank", F.col("line") == "")
    after_blank = F.coalesce(F.lag("blank").over(order), F.lit(True))
    x = x.withColumn("starts", ~F.col("blank") & (F.col("line").rlike("^" + record_start(o)) | after_blank))
    return _collected(x.withColumn("record", F.sum(F.col("starts").cast("int")).over(order)).where(~F.col("blank")), "line")


def _like(pattern: str):
    return lambda x: x.rlike(pattern)


#: Parts the groups of one match; the server's texts can't hold it.
_NUL = "\x00"


def stderr_records(records: DataFrame, o: LogReadOptions) -> DataFrame:
    """Prefix, label and message of the first line; labelled lines open fields, other lines extend the open one."""
    head, fields = _head_of(o)
    n = len(fields)
    parted = _NUL.join(f"${i + 1}" for i in range(n + 1))
    r = records.withColumn("raw", F.replace("raw", F.lit("\r\n"), F.lit("\n")))
    first = F.substring_index("raw", "\n", 1)
    # One match for all groups: the line itself where the prefix doesn't match.
    r = r.withColumn("g", once(F.split(F.regexp_replace(first, head + "(.*)$", parted), _NUL, -1))).withColumn("ok", F.size("g") == n + 1 if n else first.rlike(head))
    r = r.withColumn("rest", F.when(F.col("ok"), F.get("g", F.lit(n))).otherwise(first))
    at = F.locate(":", F.col("rest"))
    label = F.substring(F.col("rest"), F.lit(1), at - 1)
    indented = F.substring(first, 1, 1).isin(" ", "\t")
    labelled = F.col("ok") & ~indented & at.between(2, 32) & ~F.contains(label, F.lit(" ")) & (F.octet_length(label) < 32)
    r = r.withColumn("label", F.when(labelled, label))
    text = F.when(F.col("label").isNotNull(), F.ltrim(F.substring(F.col("rest"), at + 1, F.lit(1 << 30)), F.lit(" \t"))).otherwise(F.col("rest"))
    r = r.withColumn("first_text", text)
    # Below the first line: the first lines' own, then what each labelled line opens.
    more = F.contains("raw", F.lit("\n")) & F.col("label").isNotNull()
    opener = f"\n(?![ \t]){head[5:]}(?:{'|'.join(CONTINUATIONS)}):"
    below = F.expr("substring(raw, locate('\n', raw))")
    own = F.regexp_extract(below, f"(?s)^(.*?)(?={opener}|\\z)", 1)
    r = r.withColumns({"message": F.when(more, F.concat("first_text", own)).otherwise(F.col("first_text")) if not o.split_continuations else F.when(F.contains("raw", F.lit("\n")), F.concat("first_text", below)).otherwise(F.col("first_text"))})
    if not o.split_continuations:
        parts = F.when(more, F.regexp_extract_all(below, F.lit(f"(?s){opener}[ \t]*+.*?(?={opener}|\\z)"), F.lit(0)))
        r = r.withColumn("parts", parts)
        for k, c in CONTINUATIONS.items():
            opens = f"(?s)^\n{head[5:]}{k}:[ \t]*+"
            last = F.get(F.filter("parts", _like(opens)), F.size(F.filter("parts", _like(opens))) - 1)  # the last of a label counts
            r = r.withColumn(c, F.when(more, F.regexp_replace(last, opens, "")))
    seen: dict[str, Column] = {}
    for i, f in enumerate(fields):
        seen[f] = F.when(F.col("ok"), F.trim(F.get("g", F.lit(i))))
    # What no start line opened has no place: blank lines end records.
    continues = F.col("label").isNull() | (F.lit(not o.split_continuations) & F.col("label").isin(*CONTINUATIONS))
    lost = ~F.col("ok") | (continues | indented if o.line_prefix else F.lit(False))
    return r.withColumns(seen | {"raw_severity": F.col("label"), "_reason": F.when(lost, "prefix mismatch"), "_unquote": F.lit(False)})


_RECORDS = {"json": json_records, "csv": csv_records, "stderr": stderr_records}


def parse_records(records: DataFrame, o: LogReadOptions) -> DataFrame:
    """Records and malformed rows (_malformed says why) of framed text (file, offset, raw) in a stated format."""
    return finish(_RECORDS[o.format](records, o), o, o.format)


def parse_lines(lines: DataFrame, o: LogReadOptions) -> DataFrame:
    """The same of lines (file, seq, line)."""
    framed = frame_jsonlog(lines) if o.format == "json" else frame_csvlog(lines) if o.format == "csv" else frame_stderr(lines, o)
    return parse_records(framed, o)


def parse_jsonlog(lines: DataFrame, o: LogReadOptions = LogReadOptions("json")) -> DataFrame:
    return parse_lines(lines, replace(o, format="json"))


def good_records(parsed: DataFrame) -> DataFrame:
    return parsed.where("_malformed IS NULL").drop("_malformed")


def bad_records(parsed: DataFrame) -> DataFrame:
    return parsed.where("_malformed IS NOT NULL").select("file", "offset", "raw", F.col("_malformed").alias("reason"))
