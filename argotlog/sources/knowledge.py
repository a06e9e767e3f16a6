"""Knowledge base of dual-use binaries: one YAML document per binary.

Documents are read by Spark, parsed next to the data inside the tasks, and become a nested table.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_word
from ..session import materialize
from .tables import COMMAND_COLUMN

# Up to so many keywords make one search pattern; more are a table that texts are joined with.
PATTERN_KEYWORDS = 5000

log = logging.getLogger(__name__)

_COMMAND = (
    "struct<Command:string,Description:string,Usecase:string,Category:string,Privileges:string,MitreID:string,"
    "OperatingSystem:string,Tags:array<map<string,string>>>"
)
KNOWLEDGE_SCHEMA = (
    f"Name string, Description string, Author string, Created string, Commands array<{_COMMAND}>, "
    "Full_Path array<struct<Path:string>>, Code_Sample array<struct<Code:string>>, "
    "Detection array<map<string,string>>, Resources array<struct<Link:string>>, "
    "Acknowledgement array<struct<Person:string,Handle:string>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole YAML files below ``path`` (a folder, a glob or a list of either) as a ``document`` column."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.yml").select(F.col("value").alias("document"))


def parse_documents(documents: DataFrame, column: str = "document") -> DataFrame:
    """Knowledge-base table from YAML texts; a text that is not valid YAML gives no row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import yaml
        except ImportError as error:  # pragma: no cover - depends on the executor image
            raise RuntimeError("reading a YAML knowledge base needs PyYAML on the executors") from error

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

        def text(value) -> str | None:
            return None if value is None else str(value)

        def records(value, *fields: str) -> list[dict] | None:
            if value is None:
                return None
            return [{f: text(item.get(f)) for f in fields} for item in value if isinstance(item, dict)]

        def maps(value) -> list[dict] | None:
            if value is None:
                return None
            return [{str(k): text(v) for k, v in item.items()} for item in value if isinstance(item, dict)]

        scalar = ("Name", "Description", "Author", "Created")
        in_command = ("Command", "Description", "Usecase", "Category", "Privileges", "MitreID", "OperatingSystem")
        for batch in batches:
            rows = []
            for document in batch[column]:
                try:
                    entry = yaml.load(document, Loader=loader)
                except yaml.YAMLError:
                    continue
                if not isinstance(entry, dict):
                    continue
                row = {name: text(entry.get(name)) for name in scalar}
                commands = [c for c in entry.get("Commands") or [] if isinstance(c, dict)]
                row["Commands"] = [
                    {**{f: text(c.get(f)) for f in in_command}, "Tags": maps(c.get("Tags"))} for c in commands
                ]
                row["Full_Path"] = records(entry.get("Full_Path"), "Path")
                row["Code_Sample"] = records(entry.get("Code_Sample"), "Code")
                row["Detection"] = maps(entry.get("Detection"))
                row["Resources"] = records(entry.get("Resources"), "Link")
                row["Acknowledgement"] = records(entry.get("Acknowledgement"), "Person", "Handle")
                rows.append(row)
            columns = [*scalar, "Commands", "Full_Path", "Code_Sample", "Detection", "Resources", "Acknowledgement"]
            yield pd.DataFrame(rows, columns=columns)

    return documents.select(column).mapInPandas(parse, KNOWLEDGE_SCHEMA)


def parsed_base(documents: DataFrame) -> DataFrame:
    """The knowledge base as a table; how many of the documents are no valid YAML is logged as a warning."""
    parsed = materialize(parse_documents(documents))
    lost = documents.count() - parsed.count()
    if lost:
        log.warning("%d documents of the knowledge base are not valid and were left out", lost)
    return parsed


def read_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    return parsed_base(read_documents(spark, path))


def example_commands(knowledge: DataFrame) -> DataFrame:
    """All example command lines, duplicates kept."""
    return (
        knowledge.select(F.explode("Commands").alias("entry"))
        .select(F.col("entry.Command").alias(COMMAND_COLUMN))
        .filter(F.col(COMMAND_COLUMN) != "")
    )


def keywords(knowledge: DataFrame) -> DataFrame:
    """Distinct keywords: binary names and the first word of every example command."""
    names = knowledge.select(F.col("Name").alias("keyword"))
    programs = example_commands(knowledge).select(first_word(F.col(COMMAND_COLUMN)).alias("keyword"))
    return names.union(programs).filter(F.col("keyword").isNotNull()).distinct().orderBy("keyword")


def keyword_list(knowledge: DataFrame, stop_keywords: Sequence[str] = ()) -> list[str]:
    """Sorted keywords on the driver, where they become one search pattern."""
    rows = keywords(knowledge).filter(~F.col("keyword").isin(*stop_keywords) if stop_keywords else F.lit(True))
    return sorted(row.keyword for row in rows.collect())


def search_keywords(knowledge: DataFrame, stop_keywords: Sequence[str] = (), most: int = PATTERN_KEYWORDS) -> list[str] | DataFrame:
    """The keywords as a list for one search pattern, or as a table (keyword) if there are more than ``most``."""
    found = keywords(knowledge).filter(~F.col("keyword").isin(*stop_keywords) if stop_keywords else F.lit(True))
    first = [row.keyword for row in found.limit(most + 1).collect()]
    return sorted(first) if len(first) <= most else materialize(found)
