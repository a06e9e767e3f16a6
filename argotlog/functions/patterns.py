"""Patterns, placeholders and word lists shared by the text functions.

Java's ``\\w``, ``\\d`` and ``\\b`` are ASCII (and ``\\b`` even differs between JDK releases), so no pattern
here uses them.  Word characters are spelled out as Unicode classes and word boundaries as look-arounds, which
gives the same answer on every JDK and for every script.
"""

from __future__ import annotations

from dataclasses import dataclass

WORD = r"[\p{L}\p{N}_]"
DIGIT = r"\p{Nd}"
# Java looks behind by code points only if the look-behind spells a character beyond the 16-bit range; this letter is in the class anyway.
WORD_BEHIND = "[\\p{L}\\p{N}_\U0001d400]"
NOT_AFTER_WORD = rf"(?<!{WORD_BEHIND})"
AFTER_WORD = rf"(?<={WORD_BEHIND})"
NOT_BEFORE_WORD = rf"(?!{WORD})"

# Unicode white space: all separators and the control characters that count as such.  Single characters are looked up in one table,
# which is much faster than a list of ranges.
SPACE_CHARS = r" \p{Z}\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85"
SPACE = f"[{SPACE_CHARS}]"
NON_SPACE_RUN = f"[^{SPACE_CHARS}]+"


@dataclass(frozen=True)
class Rule:
    """A named replacement: every match of ``pattern`` (Java regex) becomes ``placeholder`` (literal text)."""

    name: str
    pattern: str
    placeholder: str

    @property
    def replacement(self) -> str:
        """The placeholder with the characters special to Java replacement strings escaped."""
        return self.placeholder.replace("\\", "\\\\").replace("$", "\\$")


def _first(char: str) -> str:
    """One ``char`` with no word character before it.  Testing the character first is much cheaper than the look-behind."""
    return f"{char}(?<!{WORD_BEHIND}{char})"


_HEX = "[A-Fa-f0-9]"
_D = _first(DIGIT)

# --- Fixed values: what counts as a volatile value, and the placeholder that stands for it. Order matters. ---
BUILTIN_RULES: tuple[Rule, ...] = (
    Rule("guids", rf"\{{?{_HEX}{{8}}-(?:{_HEX}{{4}}-){{3}}{_HEX}{{12}}\}}?", "<GUID>"),
    Rule("long_hex_strings", rf"{_first(_HEX)}{_HEX}{{31,}}{NOT_BEFORE_WORD}", "<LONG_HEX_STRING>"),
    Rule(
        "base64_strings",
        # A run may begin or end with + / =, where a boundary needs a word character on the other side.
        rf"(?:{_first('[A-Za-z0-9]')}|[+/=](?<={WORD_BEHIND}[+/=]))[A-Za-z0-9+/=]{{49,}}"
        rf"(?:(?<=[A-Za-z0-9]){NOT_BEFORE_WORD}|(?<=[+/=])(?={WORD}))",
        "<BASE64_STRING>",
    ),
    Rule(
        "ip_addresses",
        rf"{_D}{DIGIT}{{0,2}}\.{DIGIT}{{1,3}}\.{DIGIT}{{1,3}}\.{DIGIT}{{1,3}}(?::{DIGIT}{{1,5}})?{NOT_BEFORE_WORD}",
        "<IP_ADDRESS>",
    ),
    Rule("dates_yyyy-mm-dd", rf"{_D}{DIGIT}{{3}}-{DIGIT}{{2}}-{DIGIT}{{2}}{NOT_BEFORE_WORD}", "<DATE>"),
    Rule("times_hh-mm-ss", rf"{_D}{DIGIT}:{DIGIT}{{2}}:{DIGIT}{{2}}{NOT_BEFORE_WORD}", "<TIME>"),
    Rule("hex_codes", rf"{_first('0')}[xX]{_HEX}+{NOT_BEFORE_WORD}", "<HEX_CODE>"),
    Rule("long_numbers", rf"{_D}{DIGIT}{{5,}}{NOT_BEFORE_WORD}", "<LONG_NUMBER>"),
)

# --- Fixed values: the kinds of token, tried in this order at every position of the lower-cased text. ---
TOKEN_KINDS: tuple[tuple[str, str], ...] = (
    ("placeholder", r"<[a-zA-Z_]+>"),
    ("quoted", rf"\"(?<!{WORD_BEHIND}\")[^\"]+\"|'[^']+'"),
    ("url", rf"https?://[^{SPACE_CHARS}\"']+"),
    ("flag with value", rf"--?[\p{{L}}\p{{N}}_\-]+=[^{SPACE_CHARS}\"']+"),
    ("drive path", r"[a-zA-Z]:\\[\p{L}\p{N}_\-.\\\x20]+"),
    ("slash path", r"/[\p{L}\p{N}_\-/.]+"),
    ("ip address", rf"{DIGIT}{{1,3}}(?:\.{DIGIT}{{1,3}}){{3}}"),
    ("flag", r"--?[\p{L}\p{N}_\-]+"),
    ("file name", r"[\p{L}\p{N}_\-.]+\.(?:exe|dll|bat|ps1|txt|sh)"),
    ("e-mail address", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("hex number", r"0x[a-fA-F0-9]+"),
    ("date, year first", rf"{DIGIT}{{4}}-{DIGIT}{{2}}-{DIGIT}{{2}}"),
    ("date, year last", rf"{DIGIT}{{2}}/{DIGIT}{{2}}/{DIGIT}{{4}}"),
    ("time", rf"{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}"),
    ("uuid", r"[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}"),
    ("mac address", r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}"),
    ("phone, long", rf"{DIGIT}{{9}}-{DIGIT}{{4}}"),
    ("phone, international", rf"\+{DIGIT}{{1,2}}-{DIGIT}{{3}}-{DIGIT}{{3}}-{DIGIT}{{4}}"),
    ("word", rf"{WORD}+"),
)
# Most tokens are plain words, and most kinds would have to scan the word before giving up on it.  A word that no kind but the
# last can claim (nothing follows that would extend it, and it is no hex number) is therefore taken at once.
PLAIN_WORD = rf"(?!0x[a-fA-F0-9]){WORD}++(?![\-.:@%+/])"
TOKEN_PATTERN = "|".join(f"(?:{pattern})" for pattern in (PLAIN_WORD, *(pattern for _, pattern in TOKEN_KINDS)))

# --- Fixed values: endings that mark a part of a command line as an executable. ---
EXECUTABLE_ENDINGS: tuple[str, ...] = ("exe", "com", "bat", "cmd", "ps1", "scr", "cpl")
EXECUTABLE_PART = r"(?i)\.(?:" + "|".join(EXECUTABLE_ENDINGS) + r")\z"

# Parts of a command line: a quoted run, or a run of non-blanks that does not begin with a quote.  The last branch
# can only match a quote that is never closed.
SHELL_PART = r""""[^"]*"|'[^']*'|[^ \t\r\n"'][^ \t\r\n]*|["']"""

# Base name of a Windows path in group 1.  A bare \\server\share has none, and a leading "x:" is a drive.
WINDOWS_BASENAME = (
    r"(?s)\A(?![\\/]{2}(?:\?[\\/](?i:UNC)[\\/])?[^\\/]*(?:[\\/][^\\/]*)?\z)"
    r"(?:[^\\/]:)?(?:.*[\\/])?([^\\/]*)\z"
)

# The command-line field of an event message whose line ends are spelled as a backslash and an n.
MESSAGE_COMMAND_LINE = rf"(?s)\\nCommandLine:{SPACE}*(.*?)\\n"

# --- Fixed values: what a topic is about, first category with a keyword inside any top token wins. ---
ACTIVITY_CATEGORIES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("network", ("http", "url", "download", "web", "net", "tcp", "ip", "port")),
    ("file", ("file", "dir", "copy", "move", "delete", "write", "read", "path")),
    ("registry", ("reg", "hkey", "hklm", "hkcu", "registry", "key")),
    ("execution", ("exec", "run", "start", "invoke", "call", "execute", "launch")),
    ("scripting", ("script", "powershell", "cmd", "batch", "command")),
    ("admin", ("admin", "user", "privilege", "elevated", "system")),
    ("scheduled", ("task", "schtasks", "schedule", "cron", "at")),
    ("encoding", ("encode", "decode", "base64", "certutil")),
)
