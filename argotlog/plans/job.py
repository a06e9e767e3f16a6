"""Command line of the analysis: ``spark-submit --py-files argotlog.zip argotlog/plans/job.py --input logs.csv --output out``."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from argotlog.functions.patterns import Rule
from argotlog.operators.coherence import WINDOWS
from argotlog.plans.model import NUM_TOPICS, PASSES, SEED
from argotlog.plans.run import Options, Result, run
from argotlog.session import session, temporary_tables
from argotlog.sources import synthetic, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Topics and risk of a corpus of command lines")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--input", "-i", nargs="+", help="CSV files with a command_line column")
    source.add_argument("--parquet", nargs="+", help="Parquet files with a text column")
    source.add_argument("--messages", nargs="+", help="Parquet files with event messages in the text column")
    source.add_argument("--synthetic", "-s", type=int, metavar="N", help="analyse N synthetic command lines")
    p.add_argument("--column", default=tables.COMMAND_COLUMN, help="name of the text column")
    p.add_argument("--topics", "-t", type=int, default=NUM_TOPICS, help="number of topics if not tuned")
    p.add_argument("--no-tune", action="store_true", help="use --topics and do not search for the best number")
    p.add_argument("--tune-measure", default="c_v", choices=[*WINDOWS, "perplexity"], help="what the best number of topics is best in")
    p.add_argument("--tune-rows", type=int, help="tune on an exact sample of this many rows, not on all")
    p.add_argument("--isolate-below", type=int, help="model only rows whose every term occurs in this many rows")
    p.add_argument("--stop-keywords", nargs="*", default=(), help="keywords to leave out of the knowledge base")
    p.add_argument("--ignore-case", action="store_true", help="match keywords in any case")
    p.add_argument("--rule", nargs=3, action="append", default=[], metavar=("NAME", "REGEX", "PLACEHOLDER"), help="an extra rule")
    p.add_argument("--passes", type=int, default=PASSES, help="training passes")
    p.add_argument("--limit", "-l", type=int, help="analyse a random sample of this many rows")
    p.add_argument("--output", "-o", default=".", help="folder for the results")
    p.add_argument("--no-visualize", action="store_true", help="skip the chart tables")
    p.add_argument("--knowledge-base", help="folder of YAML documents on dual-use binaries")
    p.add_argument("--seed", type=int, default=SEED)
    p.add_argument("--verbose", "-v", action="store_true")
    return p


def main(arguments: Sequence[str] | None = None) -> Result:
    args = parser().parse_args(arguments)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    spark = session("argotlog")
    if args.synthetic is not None:
        corpus = synthetic.synthetic_commands(spark, args.synthetic, args.seed).select(tables.COMMAND_COLUMN)
    elif args.parquet or args.messages:
        rows = spark.read.parquet(*(args.parquet or args.messages))
        corpus = tables.from_messages(rows, args.column) if args.messages else tables.drop_missing(tables.keep_column(rows, args.column))
        corpus = corpus.select(tables.COMMAND_COLUMN)
    else:
        corpus = tables.read_csv(spark, args.input, args.column)
    options = Options(
        num_topics=args.topics,
        seed=args.seed,
        tune=not args.no_tune,
        tune_measure=args.tune_measure,
        limit=args.limit,
        charts=not args.no_visualize,
        knowledge_path=args.knowledge_base,
        passes=args.passes,
        tune_rows=args.tune_rows,
        isolate_below=args.isolate_below,
        stop_keywords=tuple(args.stop_keywords),
        case_sensitive=not args.ignore_case,
        rules=tuple(Rule(*rule) for rule in args.rule),
    )
    result = run(spark, corpus, options)
    result.save(args.output)
    return result


if __name__ == "__main__":
    with temporary_tables(session("argotlog")):
        main()
