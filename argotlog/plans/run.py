"""The whole analysis as one call, and its step-by-step form."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import Rule
from ..operators import grouping, labels, quality, report, risk, sampling, terms, topics
from ..session import materialize, temporary_tables
from ..sources import knowledge as kb
from ..sources import synthetic, tables
from . import model as M
from .preprocess import MIN_TOKENS, enrich, preprocess

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Options:
    num_topics: int = M.NUM_TOPICS
    seed: int = M.SEED
    passes: int = M.PASSES
    tune: bool = False
    # Numbers of topics to try; those of the measure where none are given.
    tune_topics: Sequence[int] = ()
    # A coherence measure, or "perplexity".
    tune_measure: str = "c_v"
    tune_rows: int | None = None
    limit: int | None = None
    knowledge_path: str | None = None
    case_sensitive: bool = True
    stop_keywords: Sequence[str] = ()
    rules: Sequence[Rule] = ()
    min_tokens: int = MIN_TOKENS
    similarity: int = grouping.DEFAULT_THRESHOLD
    charts: bool = True
    # Model only the rows whose every term occurs in this many rows; the others stay in the result as topic -1.
    isolate_below: int | None = None


@dataclass
class Result:
    """Frames of a finished run; chart tables and scores are null where the run skipped them."""

    documents: DataFrame
    model: M.TopicModel
    topic_summary: DataFrame
    labels: DataFrame
    scores: DataFrame | None = None
    keyword_counts: DataFrame | None = None
    charts: dict[str, DataFrame] = field(default_factory=dict)
    tuning: list[tuple[int, float]] = field(default_factory=list)
    # The documents before groups and labels were joined to them: the report needs no more.
    assigned: DataFrame | None = None

    def report(self) -> str:
        return report.markdown_report(
            self.assigned if self.assigned is not None else self.documents, self.model.top_words(5), self.model.vocabulary_size, self.model.num_topics
        )

    def save(self, path: str) -> None:
        """Model, documents (Parquet), topic summary (CSV), and the score and chart tables (Parquet) below ``path``."""
        self.model.save(f"{path}/model")
        tables.write_parquet(self.documents, f"{path}/documents")
        tables.write_csv(self.topic_summary, f"{path}/topic_summary", single_file=True)
        if self.scores is not None:
            tables.write_parquet(self.scores, f"{path}/topic_scores")
        for name, table in self.charts.items():
            tables.write_parquet(table, f"{path}/charts/{name}")
        if self.keyword_counts is not None:
            tables.write_parquet(risk.top_keywords(self.keyword_counts), f"{path}/topic_keywords")
        spark = self.documents.sparkSession
        if self.tuning:
            scores = spark.createDataFrame(self.tuning, "num_topics int, score double")
            tables.write_csv(scores, f"{path}/tuning", single_file=True)
        spark.createDataFrame([(self.report(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")


class Analysis:
    """The steps of a run, one method each, over a corpus with a ``command_line`` column.

    Frames that later steps read several times are written to the shared folder once.
    """

    def __init__(self, spark: SparkSession, options: Options = Options()):
        self.spark = spark
        self.options = options
        self.num_topics = options.num_topics
        self.corpus: DataFrame | None = None
        self.documents: DataFrame | None = None
        self.dictionary = None
        self.model: M.TopicModel | None = None
        self.keywords: list[str] | DataFrame | None = None
        self.tuning: list[tuple[int, float]] = []

    def load(self, corpus: DataFrame) -> Analysis:
        """Take a corpus, sample it down to ``limit`` rows if asked to, and check that it can be analysed."""
        tables.require_column(corpus, tables.COMMAND_COLUMN)
        if self.options.limit:
            keyed = materialize(tables.with_row_id(corpus))
            corpus = sampling.sample_exact(keyed, self.options.limit, "row_id", self.options.seed).drop("row_id")
        row = quality.require_usable(corpus)
        if row.mostly_duplicates:
            log.warning("%.1f %% of the corpus are duplicates, which may harm the topic model", row.duplicate_ratio * 100)
        self.corpus = corpus
        return self

    def load_csv(self, paths: str | Sequence[str], column: str = tables.COMMAND_COLUMN) -> Analysis:
        return self.load(tables.read_csv(self.spark, paths, column))

    def load_synthetic(self, rows: int) -> Analysis:
        return self.load(synthetic.synthetic_commands(self.spark, rows, self.options.seed).select(tables.COMMAND_COLUMN))

    def enrich(self) -> Analysis:
        """Add the example command lines of the knowledge base; without a readable one, go on without."""
        if not self.options.knowledge_path:
            log.warning("no knowledge base given: no enrichment and no risk scores")
            return self
        try:
            documents = kb.read_documents(self.spark, self.options.knowledge_path)
        except AnalysisException as error:  # a missing knowledge base must not stop the analysis of the corpus
            log.warning("knowledge base not found, going on without: %s", error)
            return self
        base = kb.parsed_base(documents)
        self.keywords = kb.search_keywords(base, self.options.stop_keywords)
        self.corpus = enrich(self.corpus, kb.example_commands(base))
        return self

    def preprocess(self) -> Analysis:
        prepared = preprocess(self.corpus, self.options.rules, self.options.min_tokens)
        return self.take(materialize(tables.with_row_id(prepared)))

    def take(self, documents: DataFrame) -> Analysis:
        """Go on with a table of preprocessed documents that have a ``row_id``."""
        self.documents = documents
        if self.options.isolate_below:
            flagged = terms.flag_rare(self.documents, "normalized_command", "row_id", self.options.isolate_below)
            self.documents = materialize(flagged)
        return self

    def _modelled(self) -> DataFrame:
        return self.documents.filter("NOT is_anomaly") if self.options.isolate_below else self.documents

    def _tuned(self) -> DataFrame:
        rows = self.options.tune_rows
        return materialize(sampling.sample_exact(self._modelled(), rows, "row_id", self.options.seed)) if rows else self._modelled()

    def build_dictionary(self) -> Analysis:
        self.dictionary = M.build_dictionary(self._modelled())
        return self

    def tune(self) -> Analysis:
        """Choose the number of topics by coherence, or by perplexity; replaces the configured number."""
        if self.options.tune_measure == "perplexity":
            self.num_topics, self.tuning = M.tune_by_perplexity(
                self._tuned(), self.options.tune_topics or M.PERPLEXITY_TOPICS, self.options.seed, dictionary=None if self.options.tune_rows else self.dictionary
            )
            return self
        self.num_topics, self.tuning = M.tune_by_coherence(
            self._modelled(),
            self.options.tune_topics or M.TUNING_TOPICS,
            self.options.tune_measure,
            seed=self.options.seed,
            sample_rows=self.options.tune_rows,
            dictionary=self.dictionary,
        )
        return self

    def train(self) -> Analysis:
        self.model = M.train(
            self._modelled(), self.num_topics, self.options.passes, self.options.seed, dictionary=self.dictionary
        )
        return self

    def assign(self) -> Analysis:
        assigned = self.model.assign(self.documents, key="row_id")
        if self.options.isolate_below:
            assigned = assigned.withColumn(
                "topic", F.when(F.col("is_anomaly"), topics.UNASSIGNED).otherwise(F.col("topic"))
            )
        if self.keywords is not None:
            assigned = risk.flag_keywords(assigned, self.keywords, case_sensitive=self.options.case_sensitive)
        self.documents = materialize(assigned)
        return self

    def result(self) -> Result:
        """Scores, names, summary and chart tables of the assigned documents."""
        documents, k = self.documents, self.num_topics
        words = materialize(self.model.top_words(report.HEATMAP_WORDS))
        names = materialize(labels.topic_names(documents, words, k))
        summary = report.topic_summary(documents, words, names, k)
        out = Result(documents, self.model, summary, names, tuning=self.tuning, assigned=documents)
        if self.keywords is not None:
            out.keyword_counts = materialize(
                risk.keyword_counts(documents, self.keywords, case_sensitive=self.options.case_sensitive)
            )
            out.scores = risk.topic_risk(out.keyword_counts)
        if self.options.charts:
            groups = materialize(grouping.group_templates(documents, threshold=self.options.similarity))
            named = topics.with_topic_label(grouping.with_command_group(documents, groups), names)
            out.documents = named
            leaves = materialize(report.group_counts(documents, names, groups))
            out.charts = {
                "treemap": report.treemap(leaves),
                "topic_words": report.topic_word_matrix(words, k),
                "sunburst": report.sunburst(documents, names),
                "lengths": topics.length_distribution(documents),
            }
            if out.scores is not None:
                out.charts["risk"] = report.risk_bars(out.scores, names)
                if isinstance(self.keywords, DataFrame):
                    log.warning("keywords are too many to look for inside of words: no chart without them")
                else:
                    out.charts["treemap_filtered"] = report.treemap(report.hide_keyword_groups(leaves, self.keywords))
        return out


def run(spark: SparkSession, corpus: DataFrame, options: Options = Options()) -> Result:
    """Load, enrich, preprocess, model, assign, score and summarise."""
    analysis = Analysis(spark, options).load(corpus).enrich().preprocess().build_dictionary()
    if options.tune:
        analysis.tune()
    return analysis.train().assign().result()


def _names(paths: Sequence[str]) -> list[str]:
    if len(set(paths)) < len(paths):
        raise ValueError("a file is named twice")
    parts = [p.rstrip("/").removesuffix(".csv").split("/") for p in paths]
    for depth in range(1, max(map(len, parts), default=1) + 1):
        names = ["-".join(part for part in p[-depth:] if part) for p in parts]
        if len(set(names)) == len(names):
            return names
    return [f"{i}-{name}" for i, name in enumerate(names)]


_RUN = "_run"


def _prepared(spark: SparkSession, paths: Sequence[str], options: Options) -> tuple[DataFrame, list[str] | DataFrame | None]:
    """(preprocessed documents of all ``paths`` with the number of the path as ``_run``, keywords): read, checked, enriched and preprocessed together."""
    owners = [(uri, number) for number, path in enumerate(paths) for uri in spark.read.text(path).inputFiles()]
    # Without a host, a location is written with one slash or with three.
    place = F.regexp_replace("source_file", "^([^:/]+):///", "$1:/").alias("source_file")
    owner = spark.createDataFrame(owners, f"source_file string, {_RUN} int").select(place, _RUN)
    corpus = tables.read_csv(spark, list(paths), with_file=True).select("command_line", place).join(owner, "source_file").drop("source_file")
    if options.limit:
        keyed = materialize(tables.with_row_id(corpus))
        parts = [sampling.sample_exact(keyed.where(F.col(_RUN) == i), options.limit, "row_id", options.seed) for i in range(len(paths))]
        corpus = parts[0].drop("row_id")
        for part in parts[1:]:
            corpus = corpus.unionByName(part.drop("row_id"))
    found = {row[_RUN]: row for row in quality.corpus_quality(corpus, by=[_RUN]).collect()}
    for number, path in enumerate(paths):
        row = found.get(number)
        quality.check_usable(row.n_rows if row else 0, row.n_valid if row else 0, path)
        if row.mostly_duplicates:
            log.warning("%.1f %% of %s are duplicates, which may harm the topic model", row.duplicate_ratio * 100, path)
    analysis = Analysis(spark, options)
    analysis.corpus = corpus
    analysis.enrich()
    corpus = analysis.corpus
    if analysis.keywords is not None:
        # The examples of the knowledge base belong to every run.
        runs = F.explode(F.when(F.col(_RUN).isNull(), F.array(*map(F.lit, range(len(paths))))).otherwise(F.array(_RUN)))
        corpus = corpus.withColumn(_RUN, runs)
    prepared = preprocess(corpus, options.rules, options.min_tokens)
    return materialize(tables.with_row_id(prepared)), analysis.keywords


def run_files(spark: SparkSession, paths: Sequence[str], output: str, options: Options = Options()) -> dict[str, str]:
    """One model per CSV file (or folder, or glob); returns the output folder of each.

    All files are read, checked, enriched and preprocessed in one go, with the file as a key; only the models are trained one after the other.  A folder bears the
    name of its file; files of one name also get the names of as many folders above them as tell them apart.
    """
    names, folders = _names(paths), {}
    with temporary_tables(spark):
        documents, keywords = _prepared(spark, paths, options)
        for number, (path, name) in enumerate(zip(paths, names)):
            folder = f"{output.rstrip('/')}/{name}"
            with temporary_tables(spark):
                analysis = Analysis(spark, options)
                analysis.keywords = keywords
                analysis.take(documents.where(F.col(_RUN) == number).drop(_RUN)).build_dictionary()
                if options.tune:
                    analysis.tune()
                analysis.train().assign().result().save(folder)
            folders[path] = folder
    return folders
