"""Inputs of the named queries: command lines, messages and knowledge-base documents derived from the test tables.

Command lines are a function of the order key: the key picks one of the command shapes and fills it, and every row gets one of seven
endings so that all replacement rules and token kinds occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.preprocess import analyse
from ..session import spread
from ..sources.synthetic import fill, pick_template

# Keywords of the risk queries; in real runs they come from a knowledge base.
KEYWORDS = (
    "C:\\Program", "MSBuild.exe", "bitsadmin.exe", "certutil", "certutil.exe", "cmd.exe", "echo", "mshta.exe", "net", "net.exe",
    "powershell.exe", "reg", "reg.exe", "regsvr32.exe", "rundll32.exe", "schtasks.exe", "type", "wmic",
)
NUM_TOPICS = 11


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))


def commands(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, topic, o_custkey, command_line) for every order."""
    return commands_of(table(spark, folder, "orders"))


def commands_of(orders: DataFrame) -> DataFrame:
    k, digest = F.col("k"), F.col("h")

    def text(number):
        return number.cast("string")

    def two_digits(number):
        return F.lpad(text(number), 2, "0")

    def digest_part(start, length):
        return F.substring(digest, start, length)

    keyed = orders.select(
        F.col("o_orderkey").alias("k"),
        F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("h"),
        "o_custkey",
        "o_orderdate",
        "o_orderstatus",
    )
    user = (
        F.when(k % 4 == 0, "Administrator")
        .when(k % 4 == 1, "User")
        .when(k % 4 == 2, "Guest")
        .otherwise(F.concat(F.lit("User"), text(k % 100 + 1)))
    )
    values = {
        "id": text(k % 9000 + 1000),
        "num": text(k % 991 + 10),
        "user": user,
        "ip": F.concat_ws(".", *[text(k % modulus + 1) for modulus in (255, 251, 241, 239)]),
        "guid": F.concat_ws("-", digest_part(1, 8), digest_part(9, 4), digest_part(13, 4), digest_part(17, 4), digest_part(21, 12)),
        "base64": F.concat(F.lit("Zm"), digest, F.upper(digest_part(1, 30))),
    }
    ending = (
        F.when(k % 7 == 1, F.concat(F.lit(" /sd "), F.date_format("o_orderdate", "yyyy-MM-dd")))
        .when(k % 7 == 2, F.concat(F.lit(" /st "), F.concat_ws(":", two_digits(k % 24), two_digits(k % 60), two_digits(k * 7 % 60))))
        .when(k % 7 == 3, F.concat(F.lit(" 0x"), digest_part(1, 8)))
        .when(k % 7 == 4, F.concat(F.lit(" --hash="), digest))
        .when(k % 7 == 5, F.concat(F.lit(" --pid="), text(k + 100000)))
        .when(k % 7 == 6, F.concat(F.lit(' "admin@host'), text(k % 50), F.lit(".com\" '"), F.col("o_orderstatus"), F.lit("'")))
        .otherwise(F.lit(""))
    )
    return keyed.select(
        k.alias("row_id"),
        F.when(k % 97 == 0, -1).otherwise(k % NUM_TOPICS).cast("int").alias("topic"),
        "o_custkey",
        F.concat(fill(pick_template(k % 34), values), ending).alias("command_line"),
    )


def documents_of_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Commands with the preprocessing columns; the topic is derived from the key, so that results can be checked exactly."""
    return analyse(commands(spark, folder))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Event messages around conversation texts, with real line ends, spelled line ends, or no closing line end."""
    turns = table(spark, folder, "conversations")
    head = F.concat(F.lit("Image: "), F.col("role"))
    body = F.concat(F.lit("CommandLine: "), F.col("text"))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    message = (
        F.when(kind == 0, F.concat(head, F.lit("\r\n"), body, F.lit("\r\nUser: u\r\n")))
        .when(kind == 1, F.concat(head, F.lit("\\n"), body, F.lit("\\nUser: u")))
        .when(kind == 2, F.concat(head, F.lit("\n"), F.replace(body, F.lit("\n"), F.lit(" "))))
        .otherwise(F.concat(head, F.lit("\nCommandLine:\nUser: u\n")))
    )
    return turns.select("conv_id", "turn", message.alias("message"))


def knowledge_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One YAML document per part: its name, and as example commands one plain, one quoted, one block text and one empty."""
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".exe"))
    document = F.concat(
        F.lit("---\nName: "), name, F.lit("\nDescription: part "), F.col("p_partkey"),
        F.lit("\nAuthor: 'a b'\nCreated: 2024-01-01\nCommands:\n  - Command: "), F.col("p_brand"), F.lit(" /install "), F.col("p_size"),
        F.lit("\n    Category: Execute\n    Tags:\n      - Execute: DLL\n  - Command: '\""), F.col("p_type"), F.lit("\" --x: y'\n"),
        F.lit("  - Command: |\n      "), F.lower("p_type"), F.lit(" a\n      b\n    MitreID: T1\n  - Command:\n    Usecase: none\n"),
        F.lit("Full_Path:\n  - Path: C:\\x\\"), name, F.lit("\n"),
    )
    return table(spark, folder, "part").select(document.alias("document"))
