"""Canonical record columns, severities and flags."""

from __future__ import annotations

from dataclasses import dataclass

# Severities in ascending rank; LOG ranks below INFO.
SEVERITIES = ("DEBUG5", "DEBUG4", "DEBUG3", "DEBUG2", "DEBUG1", "LOG", "INFO", "NOTICE", "WARNING", "ERROR", "FATAL", "PANIC")
RANK = {s: i + 1 for i, s in enumerate(SEVERITIES)}

NEEDS_UNQUOTE, MULTILINE, TRUNCATED, HAS_DURATION, HAS_STATEMENT = 1, 2, 4, 8, 16

# Severity names by message language.
LOCALES = {
    "C.": {"DEBUG": "DEBUG1", "LOG": "LOG", "INFO": "INFO", "NOTICE": "NOTICE", "WARNING": "WARNING", "ERROR": "ERROR", "FATAL": "FATAL", "PANIC": "PANIC"},
    "de": {"DEBUG": "DEBUG1", "LOG": "LOG", "INFO": "INFO", "HINWEIS": "NOTICE", "WARNUNG": "WARNING", "FEHLER": "ERROR", "FATAL": "FATAL", "PANIK": "PANIC"},
    "fr": {"DEBUG": "DEBUG1", "LOG": "LOG", "INFO": "INFO", "NOTICE": "NOTICE", "ATTENTION": "WARNING", "ERREUR": "ERROR", "FATAL": "FATAL", "PANIK": "PANIC", "PANIQUE": "PANIC"},
    "it": {"DEBUG": "DEBUG1", "LOG": "LOG", "INFO": "INFO", "NOTIFICA": "NOTICE", "ATTENZIONE": "WARNING", "ERRORE": "ERROR", "FATALE": "FATAL", "PANICO": "PANIC"},
    "ko": {"디버그": "DEBUG1", "로그": "LOG", "정보": "INFO", "알림": "NOTICE", "경고": "WARNING", "오류": "ERROR", "치명적오류": "FATAL", "손상": "PANIC"},
    "pl": {"DEBUG": "DEBUG1", "DZIENNIK": "LOG", "INFORMACJA": "INFO", "UWAGA": "NOTICE", "OSTRZEŻENIE": "WARNING", "BŁĄD": "ERROR", "KATASTROFALNY": "FATAL", "PANIKA": "PANIC"},
    "ru": {"ОТЛАДКА": "DEBUG1", "СООБЩЕНИЕ": "LOG", "ИНФОРМАЦИЯ": "INFO", "ЗАМЕЧАНИЕ": "NOTICE", "ПРЕДУПРЕЖДЕНИЕ": "WARNING", "ОШИБКА": "ERROR", "ВАЖНО": "FATAL", "ПАНИКА": "PANIC"},
    "sv": {"DEBUG": "DEBUG1", "LOGG": "LOG", "INFO": "INFO", "NOTIS": "NOTICE", "VARNING": "WARNING", "FEL": "ERROR", "FATALT": "FATAL", "PANIK": "PANIC"},
    "tr": {"DEBUG": "DEBUG1", "LOG": "LOG", "BİLGİ": "INFO", "NOT": "NOTICE", "UYARI": "WARNING", "HATA": "ERROR", "ÖLÜMCÜL (FATAL)": "FATAL", "KRİTİK": "PANIC"},
    "zh": {"调试": "DEBUG1", "日志": "LOG", "信息": "INFO", "注意": "NOTICE", "警告": "WARNING", "错误": "ERROR", "致命错误": "FATAL", "比致命错误还过分的错误": "PANIC"},
}

# Minutes east of UTC by zone abbreviation; any other is UTC.
ZONES = {
    "UTC": 0, "UCT": 0, "GMT": 0, "UT": 0, "Z": 0, "ZULU": 0, "WET": 0,
    "CET": 60, "MET": 60, "WEST": 60, "BST": 60, "WAT": 60, "CEST": 120, "MEST": 120, "EET": 120, "CAT": 120, "SAST": 120,
    "EEST": 180, "MSK": 180, "EAT": 180, "MSD": 240,
    "HST": -600, "AKST": -540, "AKDT": -480, "PST": -480, "PDT": -420, "MST": -420, "MDT": -360, "CST": -360, "CDT": -300, "EST": -300,
    "EDT": -240, "CLT": -240, "ART": -180, "BRT": -180, "UYT": -180, "CLST": -180,
    "PKT": 300, "IST": 330, "ICT": 420, "WIB": 420, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
}

# Columns of csvlog by position, keys of jsonlog, columns of a record.
CSV_COLUMNS = (
    "log_time", "user", "database", "process_id", "connection_from", "session_id", "session_line_num", "command_tag", "session_start", "virtual_xid",
    "transaction_id", "raw_severity", "sql_state", "message", "detail", "hint", "internal_query", "internal_query_pos", "context", "query",
    "query_pos", "location", "application_name", "backend_type", "leader_pid", "query_id",
)
JSON_KEYS = (
    "timestamp", "user", "dbname", "pid", "remote_host", "remote_port", "session_id", "line_num", "ps", "session_start", "vxid", "txid", "error_severity", "state_code", "message",
    "detail", "hint", "internal_query", "internal_position", "context", "statement", "cursor_position", "func_name", "file_name", "file_line_num", "application_name", "backend_type", "leader_pid", "query_id",
)

TEXT = ("raw_severity", "user", "database", "connection_from", "application_name", "backend_type", "command_tag", "session_id", "virtual_xid", "sql_state", "message", "detail", "hint", "query", "internal_query", "context", "location")
INTS = ("process_id", "leader_pid", "query_pos", "internal_query_pos")
LONGS = ("session_line_num", "transaction_id", "query_id")
RECORD_COLUMNS = (
    "time", "session_start", "severity", "severity_rank", "raw_severity", "user", "database", "connection_from", "application_name", "backend_type", "command_tag",
    "process_id", "leader_pid", "session_id", "session_line_num", "virtual_xid", "transaction_id", "query_id", "sql_state", "message", "detail", "hint", "query",
    "internal_query", "context", "statement", "query_pos", "internal_query_pos", "location", "duration_ns", "flags", "offset", "raw", "file", "format",
)


@dataclass(frozen=True)
class LogReadOptions:
    format: str = "auto"
    line_prefix: str | None = None
    lang: str = "en"
    split_continuations: bool = False
    max_record_bytes: int = 16 << 20
    no_truncated_tail: bool = False
