"""The named queries: what to run on Spark, and where it can be said in SQL, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keywords as K
from ..functions import text as T
from ..functions.patterns import Rule
from ..operators import coherence, grouping, labels, quality, report, risk, sampling, terms, topics
from ..operators.keyword_table import matches_of_table
from ..plans import model as M
from ..plans.preprocess import analyse, enrich, preprocess
from ..plans.run import Analysis, Options, run_files
from ..session import materialize, scratch_path
from ..sources import knowledge as kb
from ..sources import tables
from ..streaming.score import score, score_stream, scored_rows, write_stream
from . import sql as S
from .corpus import (
    KEYWORDS,
    NUM_TOPICS,
    commands,
    commands_of,
    documents_of_topics,
    knowledge_documents,
    messages,
    table,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

GLUE = " \u00a6 "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL for the same rows if there is any."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def glued(tokens) -> F.Column:
    return F.array_join(tokens, GLUE)


def sql_glued(tokens: str) -> str:
    return f"array_to_string({tokens}, '{GLUE}')"


# ---------------------------------------------------------------------------------------------- text functions


@query(f"WITH {S.CMDS} SELECT row_id, {S.normalize('command_line')} AS normalized_command FROM cmds")
def normalize_commands(spark, folder):
    return commands(spark, folder).select("row_id", T.normalize(F.col("command_line")).alias("normalized_command"))


@query(f"SELECT doc_id, {S.normalize_any('text')} AS normalized_text FROM documents")
def normalize_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized_text"))


USER_PATH = Rule("user_path", r"(?i)\\Users\\[^\\]+\\", "<USER_PATH>")
ROTATE = Rule("rotate", r"\A(?=[A-M>])", ">")


@query(
    rf"""WITH {S.CMDS} SELECT row_id,
    regexp_replace({S.normalize('command_line')}, '(?i)\\Users\\[^\\]+\\', '<USER_PATH>', 'g') AS normalized_command FROM cmds"""
)
def normalize_with_extra_rule(spark, folder):
    return commands(spark, folder).select(
        "row_id", T.normalize(F.col("command_line"), [USER_PATH]).alias("normalized_command")
    )


@query(f"""SELECT doc_id, regexp_replace({S.normalize_any('text')}, '  +', ' ', 'g') AS normalized_text FROM documents""")
def normalize_until_stable(spark, folder):
    blanks = Rule("blanks", "  ", " ")
    return table(spark, folder, "documents").select("doc_id", T.normalize(F.col("text"), [blanks]).alias("normalized_text"))


@query("SELECT conv_id, turn, regexp_matches(text, '^[A-M>]') AS unstable FROM conversations")
def unstable_normalization(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", T.is_unstable(F.col("text"), [ROTATE]).alias("unstable")
    )


@query(
    f"""WITH {S.ANALYSED} SELECT row_id, {sql_glued('tokens')} AS tokens, CAST(len(tokens) AS BIGINT) AS n_tokens FROM analysed"""
)
def tokenize_commands(spark, folder):
    tokens = commands(spark, folder).select("row_id", T.tokenize(T.normalize(F.col("command_line"))).alias("tokens"))
    return tokens.select(
        "row_id", glued("tokens").alias("tokens"), T.token_count(F.col("tokens")).cast("bigint").alias("n_tokens")
    )


@query(
    f"""SELECT doc_id, {sql_glued('tokens')} AS tokens, CAST(len(tokens) AS BIGINT) AS n_tokens
    FROM (SELECT doc_id, {S.tokenize_any('text')} AS tokens FROM documents)"""
)
def tokenize_documents(spark, folder):
    tokens = table(spark, folder, "documents").select("doc_id", T.tokenize(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", glued("tokens").alias("tokens"), F.size("tokens").cast("bigint").alias("n_tokens"))


@query(f"SELECT page_id, {sql_glued(S.tokenize_any('html'))} AS tokens FROM pages")
def tokenize_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", glued(T.tokenize(F.col("html"))).alias("tokens"))


@query(f"WITH {S.CMDS} SELECT row_id, root_command FROM {S.with_root('cmds', 'command_line')}")
def root_executables(spark, folder):
    return commands(spark, folder).select("row_id", T.root_executable(F.col("command_line")).alias("root_command"))


@query(f"SELECT page_id, root_command FROM {S.with_root('pages', 'html')}")
def root_of_pages(spark, folder):
    return table(spark, folder, "pages").select("page_id", T.root_executable(F.col("html")).alias("root_command"))


@query(
    rf"""SELECT o_orderkey AS row_id, {S.basename('path')} AS base FROM (SELECT o_orderkey, CASE o_orderkey % 6
    WHEN 0 THEN concat('C:\Windows\t', o_custkey, '.exe') WHEN 1 THEN concat('\\srv', o_custkey, '\share')
    WHEN 2 THEN concat('//srv/share/d/', o_orderpriority) WHEN 3 THEN concat('d:', o_orderstatus, '.bat')
    WHEN 4 THEN concat('\\?\UNC\srv\sh', o_custkey, '\x') ELSE o_orderpriority END AS path FROM orders)"""
)
def windows_basenames(spark, folder):
    o = table(spark, folder, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    path = (
        F.when(key % 6 == 0, F.concat(F.lit("C:\\Windows\\t"), customer, F.lit(".exe")))
        .when(key % 6 == 1, F.concat(F.lit("\\\\srv"), customer, F.lit("\\share")))
        .when(key % 6 == 2, F.concat(F.lit("//srv/share/d/"), F.col("o_orderpriority")))
        .when(key % 6 == 3, F.concat(F.lit("d:"), F.col("o_orderstatus"), F.lit(".bat")))
        .when(key % 6 == 4, F.concat(F.lit("\\\\?\\UNC\\srv\\sh"), customer, F.lit("\\x")))
        .otherwise(F.col("o_orderpriority"))
    )
    return o.select(key.alias("row_id"), T.windows_basename(path).alias("base"))


@query(f"""WITH {S.CMDS} SELECT row_id, trim(regexp_extract(command_line, '\\S+$'), '"''') AS last_word FROM cmds""")
def stripped_quotes(spark, folder):
    last = F.regexp_extract("command_line", r"\S+\z", 0)
    return commands(spark, folder).select("row_id", T.strip_quotes(last).alias("last_word"))


@query(f"SELECT doc_id, {S.capitalize('text')} AS text FROM documents")
def capitalized_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.capitalize(F.col("text")).alias("text"))


@query(
    r"""WITH m AS (SELECT conv_id, turn, CASE (conv_id + turn) % 4
        WHEN 0 THEN concat('Image: ', role, chr(13), chr(10), 'CommandLine: ', text, chr(13), chr(10), 'User: u', chr(13), chr(10))
        WHEN 1 THEN concat('Image: ', role, '\nCommandLine: ', text, '\nUser: u')
        WHEN 2 THEN concat('Image: ', role, chr(10), replace(concat('CommandLine: ', text), chr(10), ' '))
        ELSE concat('Image: ', role, chr(10), 'CommandLine:', chr(10), 'User: u', chr(10)) END AS message FROM conversations),
    spelled AS (SELECT conv_id, turn, CASE WHEN contains(message, '\n') THEN message
        ELSE replace(replace(message, chr(10), '\n'), chr(13), '') END AS message FROM m)
    SELECT conv_id, turn, regexp_extract(message, '(?s)\\nCommandLine:\s*(.*?)\\n', 1) AS command_line
    FROM spelled WHERE regexp_matches(message, '(?s)\\nCommandLine:\s*(.*?)\\n')"""
)
def commands_from_messages(spark, folder):
    return tables.from_messages(messages(spark, folder))


@query(
    f"""WITH {S.CMDS}, found AS (SELECT row_id, regexp_extract_all(command_line, {S.keyword_pattern()}) AS found FROM cmds)
    SELECT row_id, {sql_glued('found')} AS matches, CAST(len(found) AS BIGINT) AS n_matches FROM found"""
)
def keyword_matches(spark, folder):
    found = commands(spark, folder).select("row_id", K.keyword_matches(F.col("command_line"), KEYWORDS).alias("found"))
    return found.select("row_id", glued("found").alias("matches"), F.size("found").cast("bigint").alias("n_matches"))


@query(
    f"""WITH {S.CMDS}, found AS (SELECT row_id, regexp_extract_all(command_line, {S.keyword_pattern()}) AS found FROM cmds)
    SELECT row_id, {sql_glued('found')} AS matches, CAST(len(found) AS BIGINT) AS n_matches FROM found"""
)
def keyword_matches_by_table(spark, folder):
    """The same with the keywords as a table, which may be of any size."""
    words = spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")
    texts = materialize(commands(spark, folder).select("row_id", "command_line"))
    found = matches_of_table(texts, words, "row_id", "command_line", name="found")
    return found.select("row_id", glued("found").alias("matches"), F.size("found").cast("bigint").alias("n_matches"))


@query(
    """SELECT o_orderkey AS row_id, concat(x.p_name, ' ¦ ', y.p_name) AS matches FROM orders
    JOIN part x ON x.p_partkey = o_orderkey % (SELECT count(*) FROM part) JOIN part y ON y.p_partkey = o_custkey % (SELECT count(*) FROM part)"""
)
def part_names_in_texts(spark, folder):
    """All part names in texts that hold two of them as whole words and twice as parts of longer words; the names are a table of keywords."""
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    n = part.count()
    x, y = (part.select(F.col("p_partkey").alias(f"{s}k"), F.col("p_name").alias(s)) for s in "xy")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % n).alias("xk"), (F.col("o_custkey") % n).alias("yk"))
    text = F.concat("x", F.lit("-"), "y", F.lit("s "), "y", F.lit("."), "x", F.lit("_"))
    texts = materialize(orders.join(x, "xk").join(y, "yk").select("row_id", text.alias("text")))
    found = matches_of_table(texts, part.select(F.col("p_name").alias("keyword")), "row_id", "text")
    return found.select("row_id", glued("matches").alias("matches"))


PROSE_WORDS = ("and", "die", "le", "que", "que la", "the", "é")


@query(
    f"""SELECT doc_id, CAST(len(regexp_extract_all({S.pack('text')},
    '\\b(and|die|le|que|que la|the|_é_)\\b')) AS BIGINT) AS n_matches FROM documents"""
)
def keyword_matches_in_documents(spark, folder):
    n = F.size(K.keyword_matches(F.col("text"), PROSE_WORDS)).cast("bigint")
    return table(spark, folder, "documents").select("doc_id", n.alias("n_matches"))


@query(
    f"""WITH {S.CMDS}, found AS (SELECT row_id, [lower(m) FOR m IN regexp_extract_all(command_line, '(?i)' || {S.keyword_pattern()})] AS found FROM cmds)
    SELECT row_id, {sql_glued('found')} AS matches FROM found"""
)
def keyword_matches_any_case(spark, folder):
    return commands(spark, folder).select(
        "row_id", glued(K.keyword_matches(F.col("command_line"), KEYWORDS, case_sensitive=False)).alias("matches")
    )


@query("SELECT doc_id, regexp_extract(text, '\\S+') AS word FROM documents")
def first_words(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.first_word(F.col("text")).alias("word"))


@query(
    f"""WITH {S.ANALYSED} SELECT row_id, len([t FOR t IN tokens IF t LIKE '%.exe']) > 0 AS has_executable,
    len([t FOR t IN tokens IF contains(t, 'http')]) > 0 AS has_link,
    CAST(len([t FOR t IN tokens IF starts_with(t, '<')]) AS BIGINT) AS n_placeholders,
    CAST(len([t FOR t IN tokens IF len(t) > 2]) AS BIGINT) AS n_long FROM analysed"""
)
def token_tests(spark, folder):
    return documents_of_topics(spark, folder).select(
        "row_id",
        F.exists("tokens", lambda t: t.endswith(".exe")).alias("has_executable"),
        F.exists("tokens", lambda t: t.contains("http")).alias("has_link"),
        F.size(F.filter("tokens", lambda t: t.startswith("<"))).cast("bigint").alias("n_placeholders"),
        F.size(F.filter("tokens", lambda t: F.length(t) > 2)).cast("bigint").alias("n_long"),
    )


@query(
    rf"""WITH {S.CMDS}, parts AS (SELECT row_id, replace(string_split(command_line, '\')[-1], '.exe', '') AS part FROM cmds)
    SELECT row_id, {S.capitalize('part')} AS title FROM parts"""
)
def executable_titles(spark, folder):
    return commands(spark, folder).select("row_id", T.executable_title(F.col("command_line")).alias("title"))


@query(f"WITH {S.ANALYSED} SELECT row_id, array_to_string(tokens, ', ') AS words FROM analysed")
def joined_words(spark, folder):
    return documents_of_topics(spark, folder).select("row_id", T.join_words(F.col("tokens")).alias("words"))


# ------------------------------------------------------------------------------- filters, projections, data quality


@query(f"WITH {S.CMDS} SELECT row_id, command_line FROM cmds WHERE row_id % 13 <> 5")
def rows_with_command(spark, folder):
    """Every thirteenth command is missing."""
    gaps = commands(spark, folder).select(
        "row_id", F.when(F.col("row_id") % 13 != 5, F.col("command_line")).alias("command_line")
    )
    return quality.drop_missing_observed(gaps)[0]


@query(f"WITH {S.ANALYSED} SELECT row_id, topic, normalized_command, root_command FROM analysed WHERE len(tokens) >= 4")
def long_enough_documents(spark, folder):
    kept = preprocess(commands(spark, folder), min_tokens=4)
    return kept.select("row_id", "topic", "normalized_command", "root_command")


@query(f"WITH {S.CMDS} SELECT row_id, command_line FROM cmds WHERE topic = 3")
def topic_slice(spark, folder):
    return commands(spark, folder).filter("topic = 3").select("row_id", "command_line")


@query(f"WITH {S.CMDS} SELECT row_id, command_line FROM cmds WHERE regexp_matches(command_line, {S.keyword_pattern()})")
def rows_with_keyword(spark, folder):
    return commands(spark, folder).filter(K.contains_keyword(F.col("command_line"), KEYWORDS)).select("row_id", "command_line")


@query("SELECT text AS command_line FROM conversations WHERE text IS NOT NULL")
def one_column(spark, folder):
    return tables.drop_missing(tables.keep_column(table(spark, folder, "conversations"), "text"))


def _sql_quality(source: str, column: str) -> str:
    return f"""SELECT n_rows, n_valid, n_distinct, round((n_rows - n_distinct) / n_rows, 6) AS duplicate_ratio, n_valid >= 10 AS is_valid,
    (n_rows - n_distinct) / n_rows > 0.95 AS mostly_duplicates FROM (SELECT count(*) AS n_rows, count({column}) AS n_valid,
    count(DISTINCT {column}) + CASE WHEN count(*) > count({column}) THEN 1 ELSE 0 END AS n_distinct FROM {source})"""


@query(_sql_quality("documents", "text"))
def quality_of_documents(spark, folder):
    row = quality.corpus_quality(table(spark, folder, "documents"), "text")
    return row.withColumn("duplicate_ratio", F.round("duplicate_ratio", 6))


@query(
    f"WITH {S.CMDS}, gaps AS (SELECT CASE WHEN row_id % 13 <> 5 THEN regexp_replace(command_line, '[0-9]', '', 'g') END AS c FROM cmds) "
    + _sql_quality("gaps", "c")
)
def quality_of_commands(spark, folder):
    shape = F.when(F.col("row_id") % 13 != 5, F.regexp_replace("command_line", "[0-9]", "")).alias("c")
    row = quality.corpus_quality(commands(spark, folder).select(shape), "c")
    return row.withColumn("duplicate_ratio", F.round("duplicate_ratio", 6))


# -------------------------------------------------------------------------------------- term statistics, rare terms

_DOC_TOKENS = f"(SELECT doc_id, {S.tokenize_any('text')} AS tokens FROM documents)"


def tokenized_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.tokenize(F.col("text")).alias("tokens"))


@query(
    f"""SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM {_DOC_TOKENS}) GROUP BY term"""
)
def document_frequency(spark, folder):
    return terms.document_frequency(tokenized_documents(spark, folder))


@query(
    f"""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(tokens) AS term FROM {_DOC_TOKENS}) GROUP BY term"""
)
def term_vocabulary(spark, folder):
    return terms.vocabulary(tokenized_documents(spark, folder))


@query(f"""SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(tokens) AS term FROM {_DOC_TOKENS}) GROUP BY doc_id, term""")
def bag_of_words(spark, folder):
    return terms.bag_of_words(tokenized_documents(spark, folder), "doc_id")


_RARITY = r"""WITH occ AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\S+')) AS term FROM documents),
    freq AS (SELECT term, count(*) AS df FROM occ GROUP BY term),
    rarest AS (SELECT doc_id, min(df) AS min_df FROM occ JOIN freq USING (term) GROUP BY doc_id)"""


@query(
    f"""{_RARITY} SELECT d.doc_id, min_df, coalesce(min_df < 5, false) AS is_anomaly FROM documents d LEFT JOIN rarest r ON d.doc_id = r.doc_id"""
)
def rare_term_flags(spark, folder):
    flagged = terms.flag_rare(table(spark, folder, "documents"), "text", "doc_id")
    return flagged.select("doc_id", "min_df", "is_anomaly")


@query(
    f"""{_RARITY} SELECT d.doc_id, CASE WHEN coalesce(min_df < 3, false) THEN 'anomaly' ELSE 'normal' END AS part
    FROM documents d LEFT JOIN rarest r ON d.doc_id = r.doc_id"""
)
def rare_term_split(spark, folder):
    normal, anomalies = terms.split_rare(table(spark, folder, "documents"), "text", "doc_id", 3)
    return normal.select("doc_id", F.lit("normal").alias("part")).union(
        anomalies.select("doc_id", F.lit("anomaly").alias("part"))
    )


_CMD_RARITY = r"""occ AS (SELECT DISTINCT row_id, unnest(regexp_extract_all(normalized_command, '\S+')) AS term FROM norm),
    freq AS (SELECT term, count(*) AS df FROM occ GROUP BY term)"""


@query(
    f"""WITH {S.CMDS}, norm AS (SELECT row_id, {S.normalize('command_line')} AS normalized_command FROM cmds), {_CMD_RARITY}
    SELECT DISTINCT row_id FROM occ JOIN freq USING (term) WHERE df < 5"""
)
def commands_with_rare_terms(spark, folder):
    return terms.rows_with_rare_terms(analyse(commands(spark, folder)), "normalized_command", "row_id")


# --------------------------------------------------------------------------------------------- aggregates per topic


@query(
    f"""WITH {S.CMDS} SELECT topic, count(*) AS n_docs, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM cmds GROUP BY topic"""
)
def topic_sizes(spark, folder):
    return topics.topic_sizes(commands(spark, folder)).withColumn("percent", F.round("percent", 6))


@query(
    f"""WITH {S.CMDS} SELECT CAST(t AS INTEGER) AS topic, count(row_id) AS n_docs FROM range(14) AS r(t) LEFT JOIN cmds ON topic = t GROUP BY t"""
)
def topic_sizes_with_empty(spark, folder):
    return topics.topic_sizes_with_empty(commands(spark, folder), 14)


@query(
    f"""WITH {S.ANALYSED} SELECT root_command, count(*) AS n FROM analysed GROUP BY root_command ORDER BY n DESC, root_command LIMIT 10"""
)
def top_executables(spark, folder):
    return topics.top_values(documents_of_topics(spark, folder), "root_command", 10)


_TOKEN_COUNTS = f"{S.ANALYSED}, tc AS (SELECT topic, token, count(*) AS n FROM (SELECT topic, unnest(tokens) AS token FROM analysed) GROUP BY 1, 2)"
_TOP_TOKENS = f"{_TOKEN_COUNTS}, top AS (SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY n DESC, token) AS INTEGER) AS rank, token, n FROM tc)"


@query(f"WITH {_TOP_TOKENS} SELECT topic, rank, token, n FROM top WHERE rank <= 15")
def topic_top_tokens(spark, folder):
    return topics.top_tokens(documents_of_topics(spark, folder))


@query(
    f"""WITH {S.ANALYSED}, ex AS (SELECT topic, lower(token) AS token, count(*) AS n FROM (SELECT topic, unnest(tokens) AS token FROM analysed)
    WHERE lower(token) LIKE '%.exe' GROUP BY 1, 2)
    SELECT topic, token, n FROM ex QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, token) = 1"""
)
def topic_top_executable(spark, folder):
    return topics.top_executable(documents_of_topics(spark, folder))


@query(
    f"""WITH {S.ANALYSED} SELECT topic, root_command, count(*) AS n FROM analysed GROUP BY topic, root_command
    QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, root_command) = 1"""
)
def topic_top_root(spark, folder):
    return topics.top_roots(documents_of_topics(spark, folder))


_FLAGS = f"{S.CMDS}, flags AS (SELECT row_id, topic, regexp_extract_all(command_line, {S.keyword_pattern()}) AS found FROM cmds)"
_RISK = f"""{_FLAGS}, kinds AS (SELECT topic, count(DISTINCT k) AS kinds FROM (SELECT topic, unnest(found) AS k FROM flags) GROUP BY topic),
    base AS (SELECT topic, count(*) AS total_count, count(*) FILTER (len(found) > 0) AS lolbas_count, sum(len(found)) AS uses FROM flags GROUP BY topic),
    risk AS (SELECT base.topic, total_count, lolbas_count, lolbas_count * 100.0 / total_count AS lolbas_percentage,
    coalesce(kinds, 0) AS unique_lolbas, uses / total_count AS avg_lolbas_per_doc FROM base LEFT JOIN kinds ON base.topic = kinds.topic),
    scores AS (SELECT *, lolbas_percentage * 0.5 + unique_lolbas * 5 + avg_lolbas_per_doc * 10 AS lolbas_density FROM risk)"""
_SCORE_COLUMNS = """topic, total_count, lolbas_count, round(lolbas_percentage, 6) AS lolbas_percentage, unique_lolbas,
    round(avg_lolbas_per_doc, 6) AS avg_lolbas_per_doc, round(lolbas_density, 6) AS lolbas_density"""


def _rounded_scores(df: DataFrame) -> DataFrame:
    for name in ("lolbas_percentage", "avg_lolbas_per_doc", "lolbas_density"):
        df = df.withColumn(name, F.round(name, 6))
    return df


@query(f"WITH {_RISK} SELECT {_SCORE_COLUMNS} FROM scores ORDER BY lolbas_density DESC, topic")
def topic_risk(spark, folder):
    return _rounded_scores(risk.score_topics(commands(spark, folder), KEYWORDS))


@query(f"WITH {_RISK} SELECT {_SCORE_COLUMNS} FROM scores ORDER BY lolbas_density DESC, topic LIMIT 5")
def riskiest_topics(spark, folder):
    return _rounded_scores(risk.score_topics(commands(spark, folder), KEYWORDS).limit(5))


@query(
    f"""WITH {_FLAGS} SELECT row_id, len(found) > 0 AS contains_lolbas, CAST(len(found) AS INTEGER) AS lolbas_count FROM flags"""
)
def keyword_flags(spark, folder):
    return risk.flag_keywords(commands(spark, folder), KEYWORDS).select("row_id", "contains_lolbas", "lolbas_count")


@query(
    f"""WITH {_FLAGS}, uses AS (SELECT topic, k AS keyword, count(*) AS n FROM (SELECT topic, unnest(found) AS k FROM flags) GROUP BY 1, 2),
    ranked AS (SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY n DESC, keyword) AS INTEGER) AS rank, keyword, n FROM uses)
    SELECT * FROM ranked WHERE rank <= 5"""
)
def topic_top_keywords(spark, folder):
    return risk.top_keywords(risk.keyword_counts(commands(spark, folder), KEYWORDS))


@query(
    f"""WITH {_TOP_TOKENS}, words AS (SELECT topic, list(token ORDER BY rank) AS words FROM top WHERE rank <= 15 GROUP BY topic)
    SELECT topic, {S.category('words')} AS category FROM words"""
)
def topic_category(spark, folder):
    top = topics.top_tokens(documents_of_topics(spark, folder))
    words = top.groupBy("topic").agg(F.collect_list("token").alias("words"))
    return words.select("topic", topics.category(F.col("words")).alias("category"))


@query(
    f"""WITH {S.ANALYSED}, l AS (SELECT topic, len(tokens) AS n FROM analysed)
    SELECT topic, count(*) AS n_docs, CAST(min(n) AS INTEGER) AS min_length, round(quantile_cont(n, 0.25), 6) AS q1,
    round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q3, CAST(max(n) AS INTEGER) AS max_length,
    round(avg(n), 6) AS mean_length, round(stddev_pop(n), 6) AS sd_length FROM l GROUP BY topic"""
)
def token_length_distribution(spark, folder):
    box = topics.length_distribution(documents_of_topics(spark, folder))
    for name in ("q1", "median", "q3", "mean_length", "sd_length"):
        box = box.withColumn(name, F.round(name, 6))
    return box


@query(
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN greatest(a, b, c) > 0 THEN
    CASE WHEN a = greatest(a, b, c) THEN 0 WHEN b = greatest(a, b, c) THEN 1 ELSE 2 END ELSE -1 END AS INTEGER) AS topic
    FROM (SELECT l_orderkey, l_linenumber, l_discount AS a, l_tax AS b, 0.05 AS c FROM lineitem)"""
)
def strongest_weight(spark, folder):
    weights = F.array("l_discount", "l_tax", F.lit(0.05))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", topics.argmax(weights).alias("topic"))


# ------------------------------------------------------------------------------------------ joins, sets, samples


@query(f"""WITH {S.CMDS} SELECT row_id, CASE WHEN topic = -1 THEN 'Unassigned' ELSE n_name END AS topic_summary
    FROM cmds LEFT JOIN nation ON topic = n_nationkey""")
def topic_labels_on_rows(spark, folder):
    names = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("topic"), F.col("n_name").alias("topic_summary")
    )
    return topics.with_topic_label(commands(spark, folder), names).select("row_id", "topic_summary")


def groups_by_root(analysed: DataFrame) -> DataFrame:
    """A stand-in for fuzzy groups that SQL can say: the smallest template with the same root."""
    templates = analysed.groupBy("normalized_command").agg(F.min("root_command").alias("root_command"), F.count(F.lit(1)).alias("n"))
    least = templates.groupBy("root_command").agg(F.min("normalized_command").alias("command_group"))
    return templates.join(least, "root_command").select(F.col("normalized_command").alias("template"), "command_group", "n")


_GROUPS = f"""{S.ANALYSED}, tr AS (SELECT normalized_command, min(root_command) AS root_command FROM analysed GROUP BY 1),
    tg AS (SELECT normalized_command AS template, min(normalized_command) OVER (PARTITION BY root_command) AS command_group FROM tr)"""


@query(f"WITH {_GROUPS} SELECT row_id, command_group FROM analysed LEFT JOIN tg ON normalized_command = template")
def command_groups_on_rows(spark, folder):
    analysed = materialize(documents_of_topics(spark, folder).select("row_id", "normalized_command", "root_command"))
    return grouping.with_command_group(analysed, materialize(groups_by_root(analysed))).select("row_id", "command_group")


@query(
    f"""WITH {S.CMDS} SELECT row_id, command_line, 'corpus' AS origin FROM cmds
    UNION ALL BY NAME SELECT concat(p_brand, ' /install ', p_size) AS command_line, 'knowledge base' AS origin FROM part
    UNION ALL BY NAME SELECT concat('"', p_type, '" --x: y') AS command_line, 'knowledge base' AS origin FROM part
    UNION ALL BY NAME SELECT concat(lower(p_type), ' a', chr(10), 'b', chr(10)) AS command_line, 'knowledge base' AS origin FROM part"""
)
def enriched_corpus(spark, folder):
    base = kb.parse_documents(knowledge_documents(spark, folder))
    return enrich(commands(spark, folder).select("row_id", "command_line"), kb.example_commands(base))


@query(
    """SELECT concat(p_brand, ' /install ', p_size) AS command_line FROM part
    UNION ALL SELECT concat('"', p_type, '" --x: y') FROM part
    UNION ALL SELECT concat(lower(p_type), ' a', chr(10), 'b', chr(10)) FROM part"""
)
def knowledge_example_commands(spark, folder):
    return kb.example_commands(kb.parse_documents(knowledge_documents(spark, folder)))


@query(
    """SELECT concat(replace(p_name, ' ', '_'), '.exe') AS keyword FROM part
    UNION SELECT string_split(p_brand, ' ')[1] FROM part
    UNION SELECT string_split(concat('"', p_type, '" --x: y'), ' ')[1] FROM part
    UNION SELECT string_split(lower(p_type), ' ')[1] FROM part"""
)
def knowledge_keywords(spark, folder):
    return kb.keywords(kb.parse_documents(knowledge_documents(spark, folder)))


@query(f"WITH {S.ANALYSED} SELECT DISTINCT normalized_command FROM analysed")
def distinct_templates(spark, folder):
    return documents_of_topics(spark, folder).select("normalized_command").distinct()


@query(f"WITH {S.CMDS} SELECT row_id, command_line FROM cmds ORDER BY md5(concat('42:', row_id)), row_id LIMIT 5000")
def exact_sample(spark, folder):
    return sampling.sample_exact(commands(spark, folder), 5000).select("row_id", "command_line")


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id IN (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY md5(concat('7:', conv_id)), conv_id LIMIT 40)")
def sampled_conversations(spark, folder):
    turns = table(spark, folder, "conversations")
    drawn = sampling.sample_exact(turns.select("conv_id").distinct(), 40, "conv_id", seed=7)
    return turns.join(drawn, "conv_id", "left_semi").select("conv_id", "turn", "text")


# ------------------------------------------------------------------------------------------------ labels, reports

_TOPIC_WORDS = f"""{_TOP_TOKENS}, tw AS (SELECT topic, rank, token AS term, n / sum(n) OVER (PARTITION BY topic) AS weight FROM top)"""


def topic_words_by_count(analysed: DataFrame, k: int = 15) -> DataFrame:
    """Topic words taken from token counts, with their share of the topic's tokens as weight."""
    counts = topics.token_counts(analysed)
    totals = counts.groupBy("topic").agg(F.sum("n").alias("total"))
    top = topics.top_per_group(counts, "topic", "token", k)
    return top.join(F.broadcast(totals), "topic").select(
        "topic", "rank", F.col("token").alias("term"), (F.col("n") / F.col("total")).alias("weight")
    )


_NAMES = f"""{_TOP_TOKENS}, roots AS (SELECT topic, root_command FROM (SELECT topic, root_command, count(*) AS n FROM analysed GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, root_command) = 1),
    firsts AS (SELECT topic, list(token ORDER BY rank) AS words FROM top WHERE rank <= 15 GROUP BY topic),
    others AS (SELECT topic, root_command, [w FOR w IN words IF w <> root_command AND w <> lower(root_command)] AS words FROM roots JOIN firsts USING (topic)),
    facts AS (SELECT *, {S.category('words')} AS category, [w FOR w IN words IF NOT starts_with(w, '<') AND len(w) > 2][1] AS descriptor,
    replace(root_command, '.exe', '') AS program FROM others),
    names AS (SELECT topic, CASE WHEN category IS NOT NULL THEN concat({S.capitalize('program')}, ' ', {S.capitalize('category')}, ' Operations')
    WHEN descriptor IS NOT NULL THEN concat({S.capitalize('program')}, ' ', {S.capitalize('descriptor')}, ' Activity')
    ELSE concat({S.capitalize('program')}, ' Commands') END AS topic_summary FROM facts)"""


@query(f"WITH {_NAMES} SELECT topic, topic_summary FROM names")
def topic_names(spark, folder):
    return labels.topic_names(documents_of_topics(spark, folder))


@query(
    f"""WITH {_TOPIC_WORDS}, docs AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT row_id, unnest(tokens) AS term FROM analysed) GROUP BY term),
    scored AS (SELECT topic, rank, tw.term, weight * ln((SELECT count(*) FROM analysed) / (1 + df)) AS score FROM tw JOIN docs ON tw.term = docs.term WHERE rank <= 10),
    best AS (SELECT topic, term FROM scored QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, rank) = 1),
    ex AS (SELECT topic, token FROM (SELECT topic, token, n FROM tc WHERE token LIKE '%.exe') QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, token) = 1),
    parts AS (SELECT best.topic, {S.capitalize('term')} AS base, replace(string_split(token, chr(92))[-1], '.exe', '') AS raw FROM best LEFT JOIN ex ON best.topic = ex.topic),
    named AS (SELECT topic, base, {S.capitalize('raw')} AS program FROM parts)
    SELECT topic, CASE WHEN program <> '' AND contains(lower(base), lower(program)) THEN concat(base, ' Activity')
    WHEN program <> '' THEN concat(program, ' (', base, ')') ELSE concat('Topic: ', base) END AS topic_summary FROM named"""
)
def tfidf_labels(spark, folder):
    analysed = materialize(documents_of_topics(spark, folder).select("row_id", "topic", "tokens"))
    return labels.tfidf_labels(analysed, topic_words_by_count(analysed))


_LABELLED = f"""{_GROUPS}, lab AS (SELECT CASE WHEN topic = -1 THEN 'Unassigned' ELSE n_name END AS topic_summary, command_group
    FROM analysed JOIN tg ON normalized_command = template LEFT JOIN nation ON topic = n_nationkey),
    leaves AS (SELECT topic_summary, command_group, count(*) AS n FROM lab GROUP BY 1, 2)"""


def _leaves(spark, folder):
    analysed = materialize(documents_of_topics(spark, folder).select("topic", "root_command", "normalized_command"))
    names = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("topic"), F.col("n_name").alias("topic_summary")
    )
    return report.group_counts(analysed, names, groups_by_root(analysed))


@query(f"WITH {_LABELLED} SELECT * FROM leaves")
def command_group_counts(spark, folder):
    return _leaves(spark, folder)


_TREE = """SELECT CAST(CASE WHEN grouping(topic_summary) = 1 THEN 0 WHEN grouping(command_group) = 1 THEN 1 ELSE 2 END AS INTEGER) AS level,
    CASE WHEN grouping(topic_summary) = 1 THEN 'All Topics' ELSE topic_summary END AS topic_summary, command_group, CAST(sum(n) AS BIGINT) AS n
    FROM {} GROUP BY ROLLUP (topic_summary, command_group)"""


@query(f"WITH {_LABELLED} {_TREE.format('leaves')}")
def treemap(spark, folder):
    return report.treemap(_leaves(spark, folder))


HIDDEN = ("CERTUTIL.EXE", "reg.exe", "wmic", "bitsadmin")


@query(
    f"""WITH {_LABELLED}, shown AS (SELECT * FROM leaves WHERE NOT regexp_matches(command_group, '(?i)certutil\\.exe|reg\\.exe|wmic|bitsadmin')
    OR contains(command_group, 'Topic')) {_TREE.format('shown')}"""
)
def treemap_without_keywords(spark, folder):
    return report.treemap(report.hide_keyword_groups(_leaves(spark, folder), HIDDEN))


_MATRIX = ", ".join(f"round(coalesce(max(weight) FILTER (topic = {i}), 0.0), 6) AS topic_{i}" for i in range(NUM_TOPICS))


@query(f"WITH {_TOPIC_WORDS} SELECT term, {_MATRIX} FROM tw WHERE rank <= 15 AND topic >= 0 GROUP BY term")
def topic_word_matrix(spark, folder):
    words = topic_words_by_count(documents_of_topics(spark, folder).filter("topic >= 0"))
    matrix = report.topic_word_matrix(words, NUM_TOPICS)
    return matrix.select("term", *[F.round(f"topic_{i}", 6).alias(f"topic_{i}") for i in range(NUM_TOPICS)])


@query(
    f"""WITH {_RISK} SELECT concat('T', topic, ': ', CASE WHEN topic = -1 THEN 'Unassigned' ELSE n_name END) AS label, round(lolbas_density, 6) AS density,
    total_count AS n_docs, concat('(', total_count, ' docs)') AS docs_text FROM scores LEFT JOIN nation ON topic = n_nationkey"""
)
def risk_bars(spark, folder):
    names = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("topic"), F.col("n_name").alias("topic_summary")
    )
    bars = report.risk_bars(risk.score_topics(commands(spark, folder), KEYWORDS), names)
    docs_text = F.substring_index("text", "<br>", -1)
    return bars.select("label", F.round("density", 6).alias("density"), "n_docs", docs_text.alias("docs_text"))


@query(
    f"""WITH {S.CMDS} SELECT 'All Commands' AS label, '' AS parent, count(*) AS value FROM cmds UNION ALL
    SELECT concat('Topic ', topic, ': ', CASE WHEN topic = -1 THEN 'Unassigned' ELSE n_name END), 'All Commands', count(*)
    FROM cmds LEFT JOIN nation ON topic = n_nationkey GROUP BY topic, n_name"""
)
def sunburst(spark, folder):
    names = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("topic"), F.col("n_name").alias("topic_summary")
    )
    return report.sunburst(commands(spark, folder), names)


@query(
    f"""WITH {_NAMES}, tw AS (SELECT topic, string_agg(token, ', ' ORDER BY rank) AS top_words FROM top WHERE rank <= 10 GROUP BY topic)
    SELECT CAST(t AS INTEGER) AS topic_id, topic_summary AS topic_name, top_words, count(row_id) AS num_documents
    FROM range({NUM_TOPICS}) AS r(t) LEFT JOIN analysed a ON a.topic = t LEFT JOIN names ON names.topic = t LEFT JOIN tw ON tw.topic = t
    GROUP BY t, topic_summary, top_words"""
)
def topic_summary(spark, folder):
    analysed = materialize(documents_of_topics(spark, folder).select("topic", "root_command", "tokens"))
    return report.topic_summary(analysed, topic_words_by_count(analysed), labels.topic_names(analysed), NUM_TOPICS)


# ------------------------------------------------------------------------------------------------------ coherence

# Word lists of two made-up models over words of the command corpus.
WORD_LISTS = {
    1: [["cmd.exe", "/c", "net", "user", "whoami"], ["reg.exe", "add", "hklm", "software", "/f"]],
    2: [["schtasks.exe", "/create", "/tn", "daily", "nowhere"], ["cmd.exe", "reg.exe", "wmic", "list", "get"]],
}


def _word_lists(spark: SparkSession) -> DataFrame:
    rows = [
        (model, topic, rank, word)
        for model, lists in WORD_LISTS.items()
        for topic, words in enumerate(lists)
        for rank, word in enumerate(words, 1)
    ]
    return spark.createDataFrame(rows, "model int, topic int, rank int, term string").coalesce(1)


_LISTS = "lists(model, topic, rank, term) AS (VALUES " + ", ".join(
    f"({m}, {t}, {r}, {S.quoted(w)})"
    for m, lists in WORD_LISTS.items()
    for t, words in enumerate(lists)
    for r, w in enumerate(words, 1)
) + ")"


def _sql_counts(window: int | None) -> str:
    windows = (
        "wins AS (SELECT tokens AS w FROM analysed)"
        if window is None
        else f"""wins AS (SELECT tokens[s:s + {window - 1}] AS w FROM (SELECT tokens,
        unnest(range(1, greatest(len(tokens) - {window}, 0) + 2)) AS s FROM analysed))"""
    )
    return f"""{S.ANALYSED}, {_LISTS}, {windows}, seen AS (SELECT i, w FROM (SELECT row_number() OVER () AS i, list_distinct(w) AS ws FROM wins), unnest(ws) AS u(w)
    WHERE w IN (SELECT term FROM lists)), total AS (SELECT count(*) AS total FROM wins), one AS (SELECT w, count(*) AS n FROM seen GROUP BY w),
    two AS (SELECT a.w AS x, b.w AS y, count(*) AS n FROM seen a JOIN seen b ON a.i = b.i GROUP BY 1, 2),
    pairs AS (SELECT l.model, l.topic, l.rank AS i, r.rank AS j, coalesce(two.n, 0) / total AS pxy, coalesce(a.n, 0) / total AS px,
    coalesce(b.n, 0) / total AS py, coalesce(two.n, 0) AS nxy, coalesce(b.n, 0) AS ny
    FROM lists l JOIN lists r ON l.model = r.model AND l.topic = r.topic CROSS JOIN total
    LEFT JOIN two ON two.x = l.term AND two.y = r.term LEFT JOIN one a ON a.w = l.term LEFT JOIN one b ON b.w = r.term),
    ratios AS (SELECT *, CASE WHEN px > 0 AND py > 0 THEN ln((pxy + 1e-12) / CASE WHEN px * py > 0 THEN px * py ELSE 1 END) ELSE 0.0 END AS ratio FROM pairs),
    assoc AS (SELECT *, ratio / -ln(pxy + 1e-12) AS npmi FROM ratios)"""


def _coherence(spark, folder, measure: str) -> DataFrame:
    words = _word_lists(spark)
    distinct = sorted({w for lists in WORD_LISTS.values() for ws in lists for w in ws})
    contents = coherence.window_contents(documents_of_topics(spark, folder), distinct, coherence.WINDOWS[measure])
    scored = coherence.topic_coherence(words, coherence.co_occurrences(contents, words), measure)
    return scored.withColumn("coherence", F.round("coherence", 6))


@query(
    f"""WITH {_sql_counts(None)} SELECT model, topic, round(avg(ln((nxy + 1) / ny)), 6) AS coherence FROM assoc WHERE j < i AND ny > 0 GROUP BY 1, 2"""
)
def coherence_u_mass(spark, folder):
    return _coherence(spark, folder, "u_mass")


@query(f"WITH {_sql_counts(10)} SELECT model, topic, round(avg(npmi), 6) AS coherence FROM assoc WHERE i <> j GROUP BY 1, 2")
def coherence_npmi(spark, folder):
    return _coherence(spark, folder, "c_npmi")


@query(f"WITH {_sql_counts(10)} SELECT model, topic, round(avg(ratio), 6) AS coherence FROM assoc WHERE i <> j GROUP BY 1, 2")
def coherence_uci(spark, folder):
    return _coherence(spark, folder, "c_uci")


@query(
    f"""WITH {_sql_counts(110)}, sums AS (SELECT model, topic, j, sum(npmi) AS total FROM assoc GROUP BY 1, 2, 3),
    cos AS (SELECT model, topic, i, sum(npmi * total) AS dot, sqrt(sum(npmi * npmi)) AS own, sqrt(sum(total * total)) AS whole
    FROM assoc JOIN sums USING (model, topic, j) GROUP BY 1, 2, 3)
    SELECT model, topic, round(avg(CASE WHEN own > 0 AND whole > 0 THEN dot / (own * whole) ELSE 0.0 END), 6) AS coherence FROM cos GROUP BY 1, 2"""
)
def coherence_v(spark, folder):
    return _coherence(spark, folder, "c_v")


# ------------------------------------------------------------------------------------------------- sources, sinks


@query(f"WITH {S.CMDS} SELECT concat('a \"b\", ', command_line) AS command_line FROM cmds WHERE row_id % 5 <> 0")
def csv_round_trip(spark, folder):
    """Write commands with quotes, commas and missing values as CSV and read them back."""
    gaps = F.when(F.col("row_id") % 10 == 0, "NULL").when(
        F.col("row_id") % 5 != 0, F.concat(F.lit('a "b", '), F.col("command_line"))
    )
    path = scratch_path(spark, "csv")
    tables.write_csv(commands(spark, folder).select("row_id", gaps.alias("text")), path)
    return tables.read_csv(spark, path, "text")


@query(
    f"""WITH {S.CMDS} SELECT CAST(abs(topic) % 2 AS INTEGER) AS part, root_command, count(*) AS n FROM {S.with_root('cmds', 'command_line')} GROUP BY 1, 2"""
)
def many_csv_files(spark, folder):
    """Write two CSV data sets with their columns in different order, read both at once, and count root executables per source."""
    path = scratch_path(spark, "batch")
    for part, columns in ((0, ("row_id", "command_line")), (1, ("command_line", "row_id"))):
        tables.write_csv(commands(spark, folder).filter(F.abs("topic") % 2 == part).select(*columns), f"{path}/part_{part}")
    rows = tables.read_csv(spark, [f"{path}/part_0", f"{path}/part_1"], with_file=True)
    part = F.regexp_extract("source_file", r"/part_(\d)/", 1).cast("int")
    counts = rows.select(part.alias("part"), T.root_executable(F.col("command_line")).alias("root_command"))
    return counts.groupBy("part", "root_command").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S.ANALYSED} SELECT row_id, topic, normalized_command, root_command, {sql_glued('tokens')} AS tokens FROM analysed")
def parquet_round_trip(spark, folder):
    path = scratch_path(spark, "parquet")
    tables.write_parquet(documents_of_topics(spark, folder), path, ["topic"])
    back = spark.read.parquet(path)
    return back.select(
        "row_id", F.col("topic").cast("int").alias("topic"), "normalized_command", "root_command", glued("tokens").alias("tokens")
    )


# ------------------------------------------------------------------------------------- models, grouping, streaming


@query()
def fuzzy_command_groups(spark, folder):
    """(template, command_group); the sequential definition cannot be said in SQL, tests check it against a plain loop."""
    return grouping.group_templates(documents_of_topics(spark, folder)).select("template", "command_group")


# The sequential definition in SQL: common subsequences row by row (a new row is the running maximum of what the old one and a match allow), then leaders in
# rank order.  It takes a list of few distinct texts.
_PART_GROUPS = """WITH RECURSIVE t AS (SELECT p_name || ' ' || p_type AS template, count(*) AS n FROM part GROUP BY 1),
    b AS (SELECT *, string_split(template, ' ')[1] AS bucket FROM t),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY n DESC, template) AS INTEGER) AS i FROM b),
    p AS (SELECT x.bucket, x.i, y.i AS j, x.template AS a, y.template AS b FROM r x JOIN r y ON x.bucket = y.bucket AND y.i < x.i),
    d AS (SELECT bucket, i, j, a, b, 0 AS k, list_transform(range(len(b) + 1), lambda z: 0) AS row FROM p
          UNION ALL
          SELECT bucket, i, j, a, b, k + 1, list_transform(range(len(b) + 1), lambda y: list_max(list_transform(range(y + 1),
                 lambda z: greatest(row[z + 1], CASE WHEN z > 0 AND b[z] = a[k + 1] THEN row[z] + 1 ELSE 0 END)))) FROM d WHERE k < len(a)),
    s AS (SELECT bucket, i, j, 200.0 * row[-1] / (len(a) + len(b)) AS ratio FROM d WHERE k = len(a) AND 200 * row[-1] >= 70 * (len(a) + len(b))),
    e AS (SELECT bucket, i, list(j) AS near FROM s GROUP BY 1, 2),
    l AS (SELECT DISTINCT bucket, 0 AS i, CAST([] AS INTEGER[]) AS leaders FROM r
          UNION ALL
          SELECT l.bucket, r.i, CASE WHEN list_has_any(l.leaders, coalesce(e.near, [])) THEN l.leaders ELSE list_append(l.leaders, r.i) END
          FROM l JOIN r ON r.bucket = l.bucket AND r.i = l.i + 1 LEFT JOIN e ON e.bucket = r.bucket AND e.i = r.i),
    f AS (SELECT bucket, max_by(leaders, i) AS leaders FROM l GROUP BY 1),
    g AS (SELECT s.bucket, s.i, first(j ORDER BY ratio DESC, j) AS j FROM s JOIN f USING (bucket) WHERE list_contains(leaders, j) GROUP BY 1, 2)
    SELECT r.template, coalesce(h.template, r.template) AS command_group
    FROM r LEFT JOIN g USING (bucket, i) LEFT JOIN r h ON h.bucket = r.bucket AND h.i = g.j"""


@query(_PART_GROUPS)
def part_name_groups(spark, folder):
    """Names and types of the parts, grouped by similarity among those with the same first word."""
    names = table(spark, folder, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("normalized_command"))
    return grouping.group_templates(names, threshold=70).select("template", "command_group")


def _small_model(documents: DataFrame, k: int = NUM_TOPICS) -> M.TopicModel:
    return M.train(documents, k, passes=1)


@query()
def model_topics_on_rows(spark, folder):
    """Train a topic model on the commands and assign every row its topic."""
    documents = materialize(preprocess(commands(spark, folder)))
    return _small_model(documents).assign(documents, key="row_id").select("row_id", "topic")


@query()
def model_topic_words(spark, folder):
    return _small_model(materialize(preprocess(commands(spark, folder)))).top_words(10)


@query()
def model_full_batch(spark, folder):
    """Train on all documents in every step and assign topics."""
    documents = materialize(preprocess(commands(spark, folder)))
    return M.train_full_batch(documents, 5, max_iter=5).assign(documents, key="row_id").select("row_id", "topic")


@query()
def perplexity_by_topics(spark, folder):
    documents = materialize(preprocess(commands(spark, folder)))
    _, scores = M.tune_by_perplexity(documents, (5, 10), max_iter=3)
    return spark.createDataFrame(scores, "num_topics int, perplexity double")


@query()
def coherence_by_topics(spark, folder):
    documents = materialize(preprocess(commands(spark, folder)))
    _, scores = M.tune_by_coherence(documents, (5, 9), passes=1)
    return spark.createDataFrame(scores, "num_topics int, coherence double")


@query(f"WITH {S.ANALYSED} SELECT row_id, normalized_command, root_command FROM analysed WHERE len(tokens) >= 2")
def streamed_preprocessing(spark, folder):
    """The preprocessing of the commands as a stream over the order files."""
    schema = table(spark, folder, "orders").schema
    orders = spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/orders*.parquet")
    out = preprocess(commands_of(orders)).select("row_id", "normalized_command", "root_command")
    path = scratch_path(spark, "stream")
    write_stream(out, f"{path}/rows", f"{path}/checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/rows")


@query()
def streamed_scores(spark, folder):
    """Topics and keyword flags of a stream of commands, from a model fitted on the same table."""
    model = _small_model(materialize(preprocess(commands(spark, folder))))
    schema = table(spark, folder, "orders").schema
    orders = spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/orders*.parquet")
    path = scratch_path(spark, "stream")
    score_stream(
        orders,
        lambda batch: score(commands_of(batch).drop("topic"), model, KEYWORDS).select("row_id", "topic", "contains_lolbas", "lolbas_count"),
        f"{path}/rows", f"{path}/checkpoint", available_now=True,
    ).awaitTermination()
    return scored_rows(spark, f"{path}/rows")


# Two vocabularies, one for even and one for odd orders: a topic model has to tell them apart, which SQL can say without knowing topic numbers.
_PLANTED_WORDS = (("alpha", "beta", "gamma", "delta"), ("one", "two", "three", "four"))
_PLANTED_SQL = """SELECT o_orderkey AS row_id, min(o_orderkey) OVER (PARTITION BY o_orderkey % 2) AS same_topic_as FROM orders"""


def _planted_of(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    sides = [F.array(*(F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(key, F.lit(i)), F.lit(4)).cast("int")) for i in range(8))) for words in _PLANTED_WORDS]
    return orders.select(key.alias("row_id"), F.when(key % 2 == 0, sides[0]).otherwise(sides[1]).alias("tokens"))


def _same_topic(assigned: DataFrame) -> DataFrame:
    """Each row with the smallest row of its topic, which does not depend on how topics are numbered."""
    first = assigned.groupBy("topic").agg(F.min("row_id").alias("same_topic_as"))
    return assigned.join(F.broadcast(first), "topic").select("row_id", "same_topic_as")


def _planted(spark, folder) -> DataFrame:
    return materialize(_planted_of(table(spark, folder, "orders")))


@query(_PLANTED_SQL)
def planted_topics(spark, folder):
    """Train on a corpus of two vocabularies and assign every row; rows of one vocabulary must be in one topic."""
    documents = _planted(spark, folder)
    return _same_topic(materialize(M.train(documents, 2, passes=4, topic_word_prior=0.1).assign(documents, key="row_id")))


@query(_PLANTED_SQL)
def planted_topics_full_batch(spark, folder):
    """The same with all documents in every step."""
    documents = _planted(spark, folder)
    model = M.train_full_batch(documents, 2, max_iter=15, topic_word_prior=0.1)
    return _same_topic(materialize(model.assign(documents, key="row_id").select("row_id", "topic")))


@query(_PLANTED_SQL)
def planted_topics_streamed(spark, folder):
    """A stream over the order files, assigned by a model fitted on the same table."""
    orders = table(spark, folder, "orders")
    model = M.train(_planted(spark, folder), 2, passes=4, topic_word_prior=0.1)
    stream = spark.readStream.schema(orders.schema).parquet(f"{folder.rstrip('/')}/orders*.parquet")
    path = scratch_path(spark, "stream")
    scoring = lambda batch: model.assign(_planted_of(batch)).select("row_id", "topic")
    score_stream(stream, scoring, f"{path}/rows", f"{path}/checkpoint", available_now=True).awaitTermination()
    return _same_topic(scored_rows(spark, f"{path}/rows"))


@query("SELECT 2 AS num_topics, count(*) AS rows FROM orders")
def planted_number_of_topics(spark, folder):
    """Of two and eight topics, perplexity prefers the two that were planted; every row counts."""
    documents = _planted(spark, folder)
    best, _ = M.tune_by_perplexity(documents, (2, 8), max_iter=10)
    return documents.agg(F.lit(best).alias("num_topics"), F.count(F.lit(1)).alias("rows"))


@query("""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'alpha beta delta gamma' ELSE 'four one three two' END AS words, count(*) AS rows
    FROM orders GROUP BY 1""")
def planted_topic_words(spark, folder):
    """The four heaviest words of each topic of a model that was saved and loaded, and how many rows it is assigned."""
    documents = _planted(spark, folder)
    path = scratch_path(spark, "model")
    M.train_full_batch(documents, 2, max_iter=15, topic_word_prior=0.1).save(path)
    model = M.TopicModel.load(path)
    words = model.top_words(4).groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("words"))
    rows = model.assign(documents, key="row_id").groupBy("topic").agg(F.count(F.lit(1)).alias("rows"))
    return rows.join(F.broadcast(words), "topic").select("words", "rows")


@query("SELECT 2 AS num_topics, count(*) AS rows FROM orders")
def planted_number_of_topics_by_coherence(spark, folder):
    """Of one and two topics, coherence prefers the two vocabularies of thirty words that were planted; every row counts."""
    word = lambda i: F.concat(F.lit("w"), F.pmod("o_orderkey", F.lit(2)), F.lit("_"), F.pmod(F.xxhash64("o_orderkey", i), F.lit(30)))
    documents = table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), F.array(*(word(F.lit(i)) for i in range(12))).alias("tokens"))
    documents = materialize(documents)
    best, _ = M.tune_by_coherence(documents, (1, 2), passes=2)
    return documents.agg(F.lit(best).alias("num_topics"), F.count(F.lit(1)).alias("rows"))


_KEPT = f"""{S.ANALYSED}, kept AS (SELECT row_id, 0 AS topic, command_line, normalized_command, root_command FROM analysed WHERE len(tokens) >= 2),
    flags AS (SELECT row_id, topic, regexp_extract_all(command_line, {S.keyword_pattern()}) AS found FROM kept)"""


@query(f"WITH {_RISK.replace(_FLAGS, _KEPT)} SELECT {_SCORE_COLUMNS} FROM scores")
def whole_run_risk(spark, folder):
    """Scores that a whole run has saved, with one topic, so that SQL can say what is in it."""
    analysis = Analysis(spark, Options(num_topics=1, passes=1, charts=False)).load(commands(spark, folder).select("command_line"))
    analysis.keywords = list(KEYWORDS)
    path = scratch_path(spark, "run")
    analysis.preprocess().build_dictionary().train().assign().result().save(path)
    return _rounded_scores(spark.read.parquet(f"{path}/topic_scores"))


@query(
    f"""WITH {_KEPT} SELECT CAST(row_id % 3 AS INTEGER) AS part, root_command, count(*) AS n, count(DISTINCT normalized_command) AS templates
    FROM kept GROUP BY 1, 2"""
)
def runs_of_many_files(spark, folder):
    """Three CSV data sets analysed as a batch: the documents that each run has saved, by root executable."""
    path = scratch_path(spark, "batch")
    for part in range(3):
        tables.write_csv(commands(spark, folder).where(F.col("row_id") % 3 == part).select("command_line"), f"{path}/in/part_{part}")
    folders = run_files(spark, [f"{path}/in/part_{i}" for i in range(3)], f"{path}/out", Options(num_topics=1, passes=1, charts=False))
    saved = [spark.read.parquet(f"{out}/documents").withColumn("part", F.lit(i)) for i, out in enumerate(folders.values())]
    every = saved[0].unionByName(saved[1]).unionByName(saved[2])
    return every.groupBy("part", "root_command").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("normalized_command").alias("templates"))
