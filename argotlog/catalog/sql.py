"""The same definitions as SQL text for an independent engine (DuckDB, RE2 regular expressions).

RE2 has ASCII word boundaries and no look-around.  Where a text may hold letters beyond ASCII, each of them is put between two
underscores first, which makes it a word character for RE2 without touching any pattern, and unpacked at the end.
"""

from __future__ import annotations

import re

from ..sources.synthetic import TEMPLATES
from .corpus import KEYWORDS, NUM_TOPICS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


# --- Fixed values: replacement rules, token kinds, endings of executables and words of activities, spelled out here a second time, so that an error in one
# place shows against the other. ---
_ENDINGS = "exe|com|bat|cmd|ps1|scr|cpl"
_ACTIVITIES = (
    ("network", "http|url|download|web|net|tcp|ip|port"),
    ("file", "file|dir|copy|move|delete|write|read|path"),
    ("registry", "reg|hkey|hklm|hkcu|registry|key"),
    ("execution", "exec|run|start|invoke|call|execute|launch"),
    ("scripting", "script|powershell|cmd|batch|command"),
    ("admin", "admin|user|privilege|elevated|system"),
    ("scheduled", "task|schtasks|schedule|cron|at"),
    ("encoding", "encode|decode|base64|certutil"),
)
_RULES = (
    (r"\{?[a-f0-9]{8}-([a-f0-9]{4}-){3}[a-f0-9]{12}\}?", "<GUID>", "gi"),
    (r"\b[a-f0-9]{32,}\b", "<LONG_HEX_STRING>", "gi"),
    (r"\b[A-Za-z0-9+/=]{50,}\b", "<BASE64_STRING>", "g"),
    (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(:[0-9]{1,5})?\b", "<IP_ADDRESS>", "g"),
    (r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "<DATE>", "g"),
    (r"\b[0-9]{2}:[0-9]{2}:[0-9]{2}\b", "<TIME>", "g"),
    (r"\b0x[a-f0-9]+\b", "<HEX_CODE>", "gi"),
    (r"\b[0-9]{6,}\b", "<LONG_NUMBER>", "g"),
)
_W = r"[\p{L}\p{N}_]"
_TOKENS = (
    r"<[a-zA-Z_]+>", r'\B"[^"]+"', r"'[^']+'", r"https?://[^\s\"']+", r"--?[\p{L}\p{N}_\-]+=[^\s\"']+",
    r"[a-zA-Z]:\\[\p{L}\p{N}_\-.\\ ]+", r"/[\p{L}\p{N}_\-/.]+", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", r"--?[\p{L}\p{N}_\-]+",
    r"[\p{L}\p{N}_\-.]+\.(?:exe|dll|bat|ps1|txt|sh)", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", r"0x[a-fA-F0-9]+",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}/[0-9]{2}/[0-9]{4}", r"[0-9]{2}:[0-9]{2}:[0-9]{2}",
    r"[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", r"[0-9a-f]{2}(?::[0-9a-f]{2}){5}", r"[0-9]{9}-[0-9]{4}",
    r"\+[0-9]{1,2}-[0-9]{3}-[0-9]{3}-[0-9]{4}", _W + "+",
)


def pack(text: str) -> str:
    return rf"regexp_replace({text}, '([^\x00-\x7F\P{{L}}])', '_\1_', 'g')"


def unpack(text: str) -> str:
    return rf"regexp_replace({text}, '_([^\x00-\x7F\P{{L}}])_', '\1', 'g')"


def normalize(text: str) -> str:
    """For ASCII text."""
    for pattern, placeholder, flags in _RULES:
        text = f"regexp_replace({text}, {quoted(pattern)}, '{placeholder}', '{flags}')"
    return text


def normalize_any(text: str) -> str:
    return unpack(normalize(pack(text)))


def tokenize(text: str) -> str:
    """For ASCII text."""
    pattern = quoted("|".join(f"(?:{t})" for t in _TOKENS))
    return f"""[trim(t, '"''') for t in regexp_extract_all(lower({text}), {pattern})]"""


def tokenize_any(text: str) -> str:
    pattern = quoted("|".join(f"(?:{t})" for t in _TOKENS))
    return f"""[trim({unpack('t')}, '"''') for t in regexp_extract_all({pack(f'lower({text})')}, {pattern})]"""


def basename(path: str) -> str:
    return rf"""CASE WHEN regexp_matches({path}, '^[\\/]{{2}}(\?[\\/](?i:UNC)[\\/])?[^\\/]*([\\/][^\\/]*)?$') THEN ''
        ELSE regexp_extract(regexp_replace({path}, '^[^\\/]:', ''), '[^\\/]*$') END"""


def with_root(source: str, text: str, name: str = "root_command") -> str:
    """``SELECT *, root`` over a relation."""
    return rf"""(SELECT * EXCLUDE (parts0, parts, pos, program), {basename('program')} AS {name} FROM (
        SELECT *, trim(CASE WHEN pos > 0 THEN array_to_string(parts[1:pos], ' ') ELSE coalesce(parts[1], '') END, '"') AS program FROM (
        SELECT *, list_position([regexp_matches(lower(p), '\.({_ENDINGS})$') FOR p IN parts], true) AS pos FROM (
        SELECT *, CASE WHEN list_contains(parts0, '"') OR list_contains(parts0, '''') THEN regexp_extract_all({text}, '\S+') ELSE parts0 END AS parts FROM (
        SELECT *, regexp_extract_all({text}, '"[^"]*"|''[^'']*''|[^ \t\r\n"''][^ \t\r\n]*|["'']') AS parts0 FROM {source})))))"""


def capitalize(text: str) -> str:
    return f"concat(upper(substr({text}, 1, 1)), lower(substr({text}, 2)))"


def keyword_pattern(keywords=KEYWORDS) -> str:
    return quoted(r"\b(" + "|".join(re.sub(r"([^\w\s])", r"\\\1", k) for k in sorted(set(keywords))) + r")\b")


def category(tokens: str) -> str:
    cases = " ".join(
        f"WHEN len([t FOR t IN {tokens} IF regexp_matches(t, '{words}')]) > 0 THEN '{name}'"
        for name, words in _ACTIVITIES
    )
    return f"CASE {cases} END"


_FILL = {
    "id": "CAST(k % 9000 + 1000 AS VARCHAR)",
    "num": "CAST(k % 991 + 10 AS VARCHAR)",
    "user": "CASE k % 4 WHEN 0 THEN 'Administrator' WHEN 1 THEN 'User' WHEN 2 THEN 'Guest' ELSE concat('User', k % 100 + 1) END",
    "ip": "concat(k % 255 + 1, '.', k % 251 + 1, '.', k % 241 + 1, '.', k % 239 + 1)",
    "guid": "concat(substr(h,1,8), '-', substr(h,9,4), '-', substr(h,13,4), '-', substr(h,17,4), '-', substr(h,21,12))",
    "base64": "concat('Zm', h, upper(substr(h,1,30)))",
}


def _command_line() -> str:
    text = f"({in_list(TEMPLATES)})[k % 34 + 1]"
    for name, value in _FILL.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    ending = """CASE k % 7
        WHEN 1 THEN concat(' /sd ', strftime(o_orderdate, '%Y-%m-%d'))
        WHEN 2 THEN concat(' /st ', lpad(CAST(k % 24 AS VARCHAR), 2, '0'), ':', lpad(CAST(k % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(k * 7 % 60 AS VARCHAR), 2, '0'))
        WHEN 3 THEN concat(' 0x', substr(h,1,8))
        WHEN 4 THEN concat(' --hash=', h)
        WHEN 5 THEN concat(' --pid=', k + 100000)
        WHEN 6 THEN concat(' "admin@host', k % 50, '.com" ''', o_orderstatus, '''')
        ELSE '' END"""
    return f"concat({text}, {ending})"


CMDS = f"""cmds AS (
    SELECT k AS row_id, CAST(CASE WHEN k % 97 = 0 THEN -1 ELSE k % {NUM_TOPICS} END AS INTEGER) AS topic, o_custkey,
           {_command_line()} AS command_line
    FROM (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) AS h, o_custkey, o_orderdate, o_orderstatus FROM orders))"""

ANALYSED = f"""{CMDS}, norm AS (SELECT *, {normalize('command_line')} AS normalized_command FROM cmds),
    toks AS (SELECT *, {tokenize('normalized_command')} AS tokens FROM norm),
    analysed AS {with_root('toks', 'command_line')}"""
