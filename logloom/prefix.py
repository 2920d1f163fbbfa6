"""log_line_prefix: to a regular expression, and detected from sample lines."""

from __future__ import annotations

import re

from .functions import TIMESTAMP
from .schema import LOCALES, SEVERITIES, LogReadOptions

# Record fields by escape.
_FIELD = {"a": "application_name", "u": "user", "d": "database", "r": "connection_from", "h": "connection_from", "b": "backend_type", "i": "command_tag", "p": "process_id", "P": "leader_pid",
          "l": "session_line_num", "x": "transaction_id", "Q": "query_id", "m": "log_time", "t": "log_time", "s": "session_start", "n": "epoch", "e": "sql_state", "c": "session_id", "v": "virtual_xid"}
_SHAPE = {"p": r"\d++", "P": r"\d*+", "l": r"\d++", "x": r"\d++", "Q": r"-?\d++", "m": TIMESTAMP, "t": TIMESTAMP, "s": TIMESTAMP, "n": r"\d++(?:\.\d++)?", "e": r".{5}", "c": r"[0-9a-fA-F]++\.[0-9a-fA-F]++", "v": r"\d++/\d++"}

# Prefixes to try, in order.
CANDIDATES = (
    "%m [%p-%l] %q%u@%d ", "%m [%p] %q%u@%d ", "%t [%p-%l] %q%u@%d ", "%t [%p]: [%l-1] user=%u,db=%d,app=%a,client=%h ", "%t [%p]: user=%u,db=%d,app=%a,client=%h ",
    "%m [%p] %q%u@%d %a ", "%m [%p] %q%u@%d %r ", "%m [%p-%l] ", "%t [%p-%l] ", "%m [%p]: ", "%t [%p]: ", "%m [%p] ", "%t [%p] ", "%m %q%u@%d ", "%t %q%u@%d ", "%p ", "%m ", "%t ",
)


def compile_prefix(prefix: str) -> tuple[str, list[str]]:
    """(regular expression of the prefix, record field of each group); ValueError for a bad escape."""
    tokens, at = [], 0
    for m in re.finditer(r"%(-?\d*)(.?)", prefix):
        tokens += [("lit", c) for c in prefix[at : m.start()]]
        at = m.end()
        pad, kind = m.groups()
        if kind == "%":
            tokens.append(("lit", "%"))
        elif kind == "" and at == len(prefix):
            tokens += [("lit", c) for c in m.group()]
        elif kind == "q":
            tokens.append(("q", ""))
        elif kind in _FIELD:
            tokens.append((kind, pad))
        else:
            raise ValueError(f"unknown escape {m.group()!r} in log_line_prefix")
    tokens += [("lit", c) for c in prefix[at:]]
    out, fields, optional = "", [], False
    for i, (kind, pad) in enumerate(tokens):
        if kind == "lit":
            out += re.escape(pad)
        elif kind == "q":
            out, optional = out + "(?:", True
        else:
            after = ""
            for k, c in tokens[i + 1 :]:
                if k != "lit":
                    break
                after += c
            shape = _SHAPE.get(kind) or (rf"(?>(?:(?!{re.escape(after)}).)*)" if after else r"[^ \n]*+")
            width = int(pad.lstrip("-") or 0)
            before, behind = (" {0,%d}" % width, "") if pad and not pad.startswith("-") else ("", " {0,%d}" % width if pad else "")
            out += f"{before}({shape}){behind}"
            fields.append(_FIELD[kind])
    return out + (")?" if optional else ""), fields


LABEL = r"([^ :\n]{1,31}):[ \t]*"
#: Labels of lines that extend a record, and the field that each fills.
CONTINUATIONS = {"DETAIL": "detail", "HINT": "hint", "STATEMENT": "query", "QUERY": "internal_query", "CONTEXT": "context"}


def record_start(o: LogReadOptions) -> str | None:
    """Regular expression of a record's first line; None where every line is a record."""
    if o.format == "csv":
        return TIMESTAMP + ","
    if o.format == "stderr" and o.line_prefix:
        labels = "" if o.split_continuations else f"(?!(?:{'|'.join(CONTINUATIONS)}):)"
        return r"(?![ \t])" + compile_prefix(o.line_prefix)[0] + labels + LABEL
    return r"(?![ \t\r\n])" if o.format == "stderr" else None


def _known_labels() -> set[str]:
    return {*SEVERITIES, "DEBUG", "DETAIL", "HINT", "STATEMENT", "QUERY", "CONTEXT", *(k for t in LOCALES.values() for k in t)}


#: Characters that a field of a rightly matched prefix does not hold.
_UNLIKELY = {"user": " []", "database": " []"} | {f: "[]" for f in ("application_name", "backend_type", "command_tag", "session_id", "virtual_xid")}


def _explained(prefix: str, sample: list[str], known: set[str]) -> tuple[int, int, int]:
    """(lines, their characters, minus the fields) that a prefix explains: a known label follows, and no field is unlikely; zeros unless most lines are."""
    pattern, fields = compile_prefix(prefix)
    exact = re.compile(pattern + LABEL)
    hits = [m for x in sample if (m := exact.match(x)) and m.group(m.lastindex) in known and not any(c in (v or "") for f, v in zip(fields, m.groups()) for c in _UNLIKELY.get(f, ""))]
    return (len(hits), sum(m.start(m.lastindex) for m in hits), -len(fields)) if 2 * len(hits) > len(sample) else (0, 0, 0)


def detect_prefix(lines: list[str]) -> str | None:
    """The prefix that explains most of up to 200 sample lines; None if none explains more than half.

    The first timestamp says whether seconds have a fraction (%m) or none (%t). Of prefixes that
    explain as many lines, the one that explains more characters goes first, then that of fewer fields.
    """
    known = _known_labels()
    sample = [x for x in lines[:200] if x.strip()]
    stamp = next((m.group() for x in sample if (m := re.match(TIMESTAMP, x))), None)
    other = None if stamp is None else "%t" if "." in stamp else "%m"
    scored = [(_explained(p, sample, known), p) for p in CANDIDATES if other is None or other not in p]
    best, prefix = max(scored, key=lambda x: x[0], default=((0, 0, 0), None))
    return prefix if best[0] else next((p for x in sample if (p := _described(x)) and _explained(p, sample, known)[0]), None)


def _described(line: str) -> str | None:
    """The text before a line's first label, with a timestamp as %m or %t and a number as %p."""
    m = re.match(r"(.*?[ \t])[^ \t]*:[ \t]", line)
    if not m:
        return None
    escapes = lambda t: ("%m" if "." in t.group() else "%t") if t.lastgroup == "stamp" else "%%" if t.group() == "%" else "%p"
    prefix, found = re.subn(rf"(?P<stamp>{TIMESTAMP})|%|\d+", escapes, m.group(1))
    return prefix if found and re.search("%[mtp]", prefix) else None


def detect_format(head: str) -> str:
    """csv, json or stderr, from the first non-empty line."""
    line = next((x for x in head.split("\n") if x.strip()), "")
    if line.lstrip("﻿").startswith("{"):
        return "json"
    columns = re.findall(r'(?:^|,)("(?:[^"]|"")*"|[^,"]*)', line)
    # A first record of several lines ends this one inside a quoted field.
    whole = len(columns) >= 23 or len(columns) >= 14 and line.count('"') % 2 == 1
    if re.match(TIMESTAMP + ",", line) and whole and 1 <= len(columns[11].encode()) <= 32:
        return "csv"
    return "stderr"
