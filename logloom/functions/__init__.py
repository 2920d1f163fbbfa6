"""Scalar functions of log records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HAS_DURATION, LOCALES, RANK, ZONES

TIMESTAMP = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?: ?(?:[+-][0-9:]+|[A-Za-z]+))?"
_STAMP = r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?(?: ?([+-][0-9:]+|[A-Za-z]+))?$"


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def json_key(name: Column) -> Column:
    """A display name as a key: A-Z lower-cased, blanks to underscores."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ ", "abcdefghijklmnopqrstuvwxyz_")


def severity(raw: Column, lang: str = "en") -> Column:
    """Normalised severity of a raw one, in English or a message language; null if unknown."""
    names = LOCALES.get(lang, {**{s: s for s in RANK}, "DEBUG": "DEBUG1"})
    return F.try_element_at(_map(names), raw)


def severity_rank(s: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(RANK), s), F.lit(0)).cast("tinyint")


def zone_seconds(zone: Column) -> Column:
    """Seconds east of UTC of +HH, +HHMM, +HH:MM or an abbreviation; 0 for anything else."""
    digits = F.replace(F.substring(zone, 2, 6), F.lit(":"), F.lit(""))
    part = lambda at: F.coalesce(F.substring(digits, at, 2).try_cast("int"), F.lit(0))
    numeric = F.when(F.length(digits).isin(2, 4), (part(1) * 3600 + part(3) * 60) * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
    return F.when(zone.rlike("^[+-]"), numeric).otherwise(F.coalesce(F.try_element_at(_map(ZONES), zone), F.lit(0)) * 60)


#: Date and time of a log time, apart from its zone.
_LOCAL = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)? [A-Z]+$"


def parse_timestamp(c: Column) -> Column:
    """Instant of a log time; days to 31 and seconds to 60 carry over; null if malformed.

    What servers write, with a zone abbreviation after a blank, is cast; all else goes the long way.
    """
    zone = F.substring_index(c, " ", -1)
    instant = F.concat(F.substring(c, F.lit(1), F.length(c) - F.length(zone) - 1), F.lit("Z")).try_cast("timestamp")
    east = F.when(zone.isin("UTC", "GMT"), 0).otherwise(zone_seconds(zone))
    short = F.when(c.rlike(_LOCAL), F.when(east == 0, instant).otherwise(F.timestamp_micros(F.unix_micros(instant) - east * F.lit(1_000_000).cast("long"))))
    return F.when(c.isNotNull(), F.coalesce(short, _carried_timestamp(c)))


def _carried_timestamp(c: Column) -> Column:
    parts = F.split(F.when(c.rlike(_STAMP), F.regexp_replace(c, _STAMP, "$1,$2,$3,$4,$5,$6,$7,$8")), ",", -1)

    def of(p: Column) -> Column:
        n = lambda i: p[i - 1].try_cast("int")
        valid = n(2).between(1, 12) & n(3).between(1, 31) & (n(4) < 24) & (n(5) < 60) & (n(6) <= 60)
        days = F.unix_date(F.try_make_timestamp(n(1), n(2), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")).cast("long") + n(3) - 1
        seconds = days * 86400 + n(4) * 3600 + n(5) * 60 + n(6) - zone_seconds(p[7])
        return F.when(valid, F.timestamp_micros(seconds * 1_000_000 + F.rpad(F.substring(p[6], 1, 6), 6, "0").cast("long")))

    return F.element_at(F.transform(F.array(parts), of), 1)


def parse_epoch(c: Column) -> Column:
    g = lambda i: F.regexp_extract(c, r"^(\d+)(?:\.(\d+))?$", i)
    return F.when(c.rlike(r"^\d+(?:\.\d+)?$"), F.timestamp_micros(g(1).cast("long") * 1_000_000 + F.rpad(F.substring(g(2), 1, 6), 6, "0").cast("long")))


def duration_ns(message: Column) -> Column:
    pattern = r"^[ \t]*duration: (\d{1,12})(?:\.(\d*))? ms"
    g = lambda i: F.regexp_extract(message, pattern, i)
    return F.when(F.contains(F.substring(message, 1, 64), F.lit("duration: ")) & message.rlike(pattern), g(1).cast("long") * 1_000_000 + F.rpad(F.substring(g(2), 1, 6), 6, "0").cast("long"))


def strict_int(c: Column, kind: str = "int") -> Column:
    """An optional sign and digits, nothing around them; null for anything else."""
    first, last = F.ascii(c), F.ascii(F.right(c, F.lit(1)))  # a cast would take blanks around a number
    return F.when(first.between(43, 57) & last.between(48, 57), c.try_cast(kind))


def field_after(message: Column, key: str) -> Column:
    """Text after the first key up to a blank or comma; null without the key."""
    return F.when(F.contains(message, F.lit(key)), F.regexp_extract(message, rf"(?s)\Q{key}\E([^ ,]*)", 1))


def client_host(connection: Column) -> Column:
    return F.regexp_replace(connection, r"(?s)^(.*):[0-9]*$", "$1")


def lock_target(message: Column) -> Column:
    rest = F.regexp_extract(message, r"(?s)waiting for (.*)", 1)
    on = F.regexp_extract(rest, r"(?s)^(.*? on [^ ]*)", 1)
    return F.when(F.contains(message, F.lit("waiting for ")), F.when(on != "", on).otherwise(F.regexp_extract(rest, r"^([^ ]*)", 1)))


def temp_file_size(message: Column) -> Column:
    return F.coalesce(F.regexp_extract(field_after(message, "size "), r"^(\d+)", 1).try_cast("long"), F.lit(0))


def normalize_message(c: Column) -> Column:
    """Quoted spans and digit runs become `?`; of a run of both, only the first digits do."""
    c = F.regexp_replace(c, r"\"[^\"]*(\"|\z)|'[^']*('|\z)", "\x01")
    c = F.regexp_replace(c, r"(^|[^0-9\x01])(\x01*)[0-9]", "$1$2\x02")
    return F.regexp_replace(F.regexp_replace(c, "[0-9]", ""), "[\x01\x02]", "?")


def one_line(c: Column) -> Column:
    return F.when(c.rlike(r"[\n\r\t]"), F.trim(F.regexp_replace(c, r"[\s\x85\xA0]+", " "))).otherwise(c)


def truncate_bytes(c: Column, n: int) -> Column:
    """At most n bytes: longer text is cut to n - 3 bytes and `...`; a cut character becomes U+FFFD."""
    return F.when(F.octet_length(c) > n, F.concat(F.decode(F.substring(F.encode(c, "UTF-8"), 1, n - 3), "UTF-8"), F.lit("..."))).otherwise(c)


def statement_text() -> Column:
    return F.coalesce(nonempty(F.col("statement")), F.col("message"))


def pattern_id(sev: Column, state: Column, template: Column, version: int = 1) -> Column:
    """16 hex digits that name a severity, SQLSTATE and template."""
    b = lambda c: F.encode(F.coalesce(c, F.lit("")), "UTF-8")
    zero = F.unhex(F.lit("00"))
    return F.substring(F.sha2(F.concat(b(sev), zero, b(state), zero, b(F.lit(str(version))), zero, b(template)), 256), 1, 16)


# SQLSTATEs and message starts that decide a kind.
_SYSTEM_STATES = ("57P01", "57P02", "57P03", "57P04")
_STARTS = {
    "connection": ("connection authorized", "connection received", "connection authenticated"),
    "disconnection": ("disconnection",),
    "checkpoint": ("checkpoint starting", "checkpoint complete", "restartpoint starting", "restartpoint complete"),
    "autovacuum": ("automatic vacuum", "automatic analyze", "automatic aggressive vacuum"),
    "temp_file": ("temporary file:",),
}
_SYSTEM_STARTS = (
    "database system is", "database system was", "the database system is", "received ", "starting PostgreSQL", "listening on",
    "shutting down", "aborting any active transactions", "background worker", "server process", "terminating",
)
KINDS = ("connection", "disconnection", "slow", "checkpoint", "autovacuum", "temp_file", "lock_wait", "deadlock", "recovery_conflict", "system", "other")


def classify() -> Column:
    """Kind of a record: by SQLSTATE where that decides, else by the message, else slow or other."""
    state, m = F.col("sql_state"), F.coalesce("message", F.lit(""))
    starts = lambda texts: F.greatest(*[m.startswith(t) for t in texts], F.lit(False))
    has = lambda t: F.contains(m, F.lit(t))
    out = F.when(state == "40P01", "deadlock").when(state == "57014", F.when(has("recovery"), "recovery_conflict").otherwise("other")).when(state.isin(*_SYSTEM_STATES), "system")
    out = out.when(state.isin("28P01", "28000"), "connection").when(state == "40001", "lock_wait")
    for kind, texts in _STARTS.items():
        out = out.when(starts(texts), kind)
    out = out.when(has("still waiting for") | (has("acquired ") & has("Lock on")), "lock_wait").when(has("canceling statement due to conflict with recovery"), "recovery_conflict")
    return out.when(starts(_SYSTEM_STARTS), "system").when(F.col("flags").bitwiseAND(HAS_DURATION) != 0, "slow").otherwise("other")


def record_line() -> Column:
    part = lambda name, c: F.when(nonempty(F.col(c)).isNotNull(), F.concat(F.lit(f" | {name}: "), c))
    head = F.concat_ws(" ", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSS"), F.concat(F.coalesce(nonempty(F.col("severity")), F.col("raw_severity"), F.lit("")), F.lit(":")), F.coalesce("message", F.lit("")))
    return F.concat(head, *[F.coalesce(part(n, c), F.lit("")) for n, c in (("DETAIL", "detail"), ("HINT", "hint"), ("STATEMENT", "statement"))])
