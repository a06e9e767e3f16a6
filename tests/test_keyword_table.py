"""Keywords as a table against the pattern of the same keywords."""

import random

from pyspark.sql import functions as F

from argotlog.functions.keywords import keyword_matches
from argotlog.operators import risk
from argotlog.operators.keyword_table import matches_of_table


def words(spark, keywords):
    return spark.createDataFrame([(k,) for k in keywords], "keyword string")


def test_table_equals_pattern(spark):
    rng = random.Random(11)
    signs = [*"ab_1é", *".-\\ /", "ab", "a.b"]
    keywords = sorted({"".join(rng.choices(signs, k=rng.randint(1, 5))) for _ in range(234)}) + ["", None]
    texts = [(i, "".join(rng.choices(signs, k=rng.randint(0, 40)))) for i in range(1500)] + [(9001, None), (9002, ""), (9003, "ab.ab.ab")]
    df = spark.createDataFrame(texts, "row_id bigint, t string").repartition(5)
    listed = [k for k in keywords if k]
    for case in (True, False):
        both = matches_of_table(df, words(spark, keywords), "row_id", "t", case).withColumn("expected", keyword_matches(F.col("t"), listed, case))
        assert both.count() == len(texts) and both.where("matches <> expected").select("t", "matches", "expected").limit(5).collect() == []
        assert both.where("size(matches) > 1").count() > 300
    assert matches_of_table(df, words(spark, []), "row_id", "t").where("size(matches) > 0").count() == 0


def test_a_hundred_thousand_keywords(spark, monkeypatch):
    many = spark.range(100_000).select(F.concat(F.lit("tool"), "id", F.lit(".exe")).alias("keyword"))
    texts = spark.range(3000).select(F.col("id").alias("row_id"), F.concat(F.lit("run tool"), F.col("id") * 50, F.lit(".exe xtool"), "id", F.lit(".exe tool"), "id", F.lit(".exes tool7.exe")).alias("command_line"))
    expected = [[f"tool{50 * i}.exe", "tool7.exe"] if 50 * i < 100_000 else ["tool7.exe"] for i in range(3000)]
    for size in (1 << 25, 0):  # in a broadcast, and by shuffle
        monkeypatch.setattr("argotlog.operators.keyword_table.BROADCAST_BYTES", size)
        assert [r.matches for r in matches_of_table(texts, many, "row_id", "command_line").orderBy("row_id").collect()] == expected
    scores = risk.score_topics(texts.withColumn("topic", F.lit(1)), many).first()
    assert scores.total_count == scores.lolbas_count == 3000 and scores.unique_lolbas == 2001
    assert risk.flag_keywords(texts, many).where("lolbas_count = 2").count() == 2000
