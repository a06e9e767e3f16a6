"""Report tables.  Drawing them is left to whatever reads the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import mentions_keyword
from ..functions.text import join_words
from .labels import _ranked_array
from .topics import UNASSIGNED, top_values, topic_sizes, topic_sizes_with_empty, with_topic_label

ALL_TOPICS = "All Topics"
ALL_COMMANDS = "All Commands"
HEATMAP_WORDS = 15


def group_counts(df: DataFrame, labels: DataFrame, groups: DataFrame, template: str = "normalized_command") -> DataFrame:
    """(topic_summary, command_group, n).

    Rows are counted per topic and template before anything is joined, so neither join sees a repeated command line twice.
    """
    counts = df.groupBy("topic", F.col(template).alias("template")).agg(F.count(F.lit(1)).alias("n"))
    named = with_topic_label(counts.join(groups.select("template", "command_group"), "template"), labels)
    return named.groupBy("topic_summary", "command_group").agg(F.sum("n").alias("n"))


def treemap(leaves: DataFrame) -> DataFrame:
    """Tree rows (level, topic_summary, command_group, n): 0 is the total, 1 a topic, 2 a command group of a topic."""
    return (
        leaves.rollup("topic_summary", "command_group")
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
        .select(
            F.when(F.col("gid") == 3, 0).when(F.col("gid") == 1, 1).otherwise(2).alias("level"),
            F.when(F.col("gid") == 3, ALL_TOPICS).otherwise(F.col("topic_summary")).alias("topic_summary"),
            "command_group",
            "n",
        )
    )


def hide_keyword_groups(leaves: DataFrame, keywords: Sequence[str], label: str = "command_group") -> DataFrame:
    """Drop groups whose text mentions a keyword, in any case and inside words too; texts with "Topic" stay."""
    return leaves.filter(~mentions_keyword(F.col(label), keywords) | F.col(label).contains("Topic"))


def topic_word_matrix(topic_words: DataFrame, num_topics: int, top_n: int = HEATMAP_WORDS) -> DataFrame:
    """One row per word that is a top word of any topic, one column ``topic_<i>`` per topic, 0 where it is no top word."""
    top = topic_words.filter(F.col("rank") <= top_n)
    matrix = top.groupBy("term").pivot("topic", list(range(num_topics))).agg(F.first("weight"))
    cells = [F.coalesce(F.col(f"`{i}`"), F.lit(0.0)).alias(f"topic_{i}") for i in range(num_topics)]
    return matrix.select("term", *cells).orderBy("term")


def risk_bars(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, density, n_docs, text), riskiest topic first."""
    named = with_topic_label(scores, labels)
    return named.orderBy(F.desc("lolbas_density"), "topic").select(
        F.concat(F.lit("T"), F.col("topic"), F.lit(": "), F.col("topic_summary")).alias("label"),
        F.col("lolbas_density").alias("density"),
        F.col("total_count").alias("n_docs"),
        F.format_string("%.1f%%<br>(%d docs)", "lolbas_density", "total_count").alias("text"),
    )


def sunburst(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, parent, value): the total and one row per topic, the total first, then by topic."""
    named = with_topic_label(topic_sizes(df), labels).select(
        "topic",
        F.concat(F.lit("Topic "), F.col("topic"), F.lit(": "), F.col("topic_summary")).alias("label"),
        F.lit(ALL_COMMANDS).alias("parent"),
        F.col("n_docs").alias("value"),
    )
    total = named.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")).select(
        F.lit(UNASSIGNED - 1).alias("topic"), F.lit(ALL_COMMANDS).alias("label"), F.lit("").alias("parent"), "value"
    )
    return total.unionByName(named).orderBy("topic").select("label", "parent", "value")


def topic_summary(df: DataFrame, topic_words: DataFrame, labels: DataFrame, num_topics: int) -> DataFrame:
    """(topic_id, topic_name, top_words, num_documents) for every topic of the model, empty ones included."""
    words = _ranked_array(topic_words.filter("rank <= 10"), "topic", "rank", "term", "words")
    sizes = topic_sizes_with_empty(df, num_topics)
    return (
        sizes.join(F.broadcast(labels), "topic", "left")
        .join(F.broadcast(words), "topic", "left")
        .select(
            F.col("topic").alias("topic_id"),
            F.col("topic_summary").alias("topic_name"),
            join_words(F.col("words")).alias("top_words"),
            F.col("n_docs").alias("num_documents"),
        )
        .orderBy("topic_id")
    )


def _markdown_table(header: Sequence[str], rows: Sequence[Sequence]) -> list[str]:
    cells = [[str(c).replace("|", "\\|") for c in row] for row in (header, ["---"] * len(header), *rows)]
    return [f"| {' | '.join(row)} |" for row in cells]


def markdown_report(df: DataFrame, topic_words: DataFrame, n_terms: int, num_topics: int, title: str = "Corpus report") -> str:
    """Text of a short report: totals, topics with their top words, most frequent executables."""
    words = _ranked_array(topic_words.filter("rank <= 5"), "topic", "rank", "term", "words")
    # Both tables are report-sized: one row per topic, ten executables.
    topics = topic_sizes(df).join(F.broadcast(words), "topic", "left").orderBy("topic").collect()
    programs = top_values(df.filter("root_command IS NOT NULL"), "root_command", 10).collect()
    lines = [f"# {title}", ""]
    total = sum(t.n_docs for t in topics)
    lines += _markdown_table(("measure", "value"), [("rows", total), ("distinct tokens", n_terms), ("topics", num_topics)])
    lines += ["", "## Topics by number", ""]
    lines += _markdown_table(("topic", "rows", "share in %", "top words"), [(t.topic, t.n_docs, f"{t.percent:.1f}", " ".join(t.words or [])) for t in topics])
    lines += ["", "## Executables by frequency", ""]
    lines += _markdown_table(("executable", "rows"), [(p.root_command, p.n) for p in programs])
    return "\n".join(lines)
