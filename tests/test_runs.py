"""Sources, sinks, whole runs and streams."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from argotlog.plans import job
from argotlog.plans.model import TopicModel
from argotlog.plans.run import Analysis, Options, run, run_files
from argotlog.sources import knowledge as kb
from argotlog.sources import synthetic, tables
from argotlog.streaming.score import score, score_stream, scored_rows

# Folder of a full knowledge base, if there is one to test with.
FULL_KNOWLEDGE = os.environ.get("ARGOTLOG_TEST_KNOWLEDGE", "")


def knowledge_folder(tmp_path):
    folder = tmp_path / "kb"
    folder.mkdir()
    (folder / "a.yml").write_text(
        "---\nName: Certutil.exe\nDescription: d\nCreated: 2018-05-25\nCommands:\n"
        "  - Command: certutil.exe -urlcache -f http://x/y\n    Category: Download\n    Tags:\n      - Execute: DLL\n"
        "  - Command: |\n      certutil one\n      two\n  - Usecase: nothing\n  - Command: ''\n"
        "Full_Path:\n  - Path: C:\\x\nAcknowledgement:\n  - Person: p\n    Handle:\n"
    )
    (folder / "b.yml").write_text("Name: Reg.exe\nCommands:\n  - Command: reg add\n")
    (folder / "broken.yml").write_text("Name: [unclosed\n")
    (folder / "notes.txt").write_text("Name: Ignored.exe\n")
    return str(folder)


def test_knowledge_base(spark, tmp_path):
    base = kb.read_knowledge_base(spark, knowledge_folder(tmp_path)).cache()
    assert base.count() == 2
    row = base.filter("Name = 'Certutil.exe'").first()
    assert row.Created == "2018-05-25" and row.Commands[0].Tags == [{"Execute": "DLL"}] and row.Acknowledgement[0].Handle is None
    assert sorted(r.command_line for r in kb.example_commands(base).collect()) == [
        "certutil one\ntwo\n", "certutil.exe -urlcache -f http://x/y", "reg add",
    ]
    assert kb.keyword_list(base) == ["Certutil.exe", "Reg.exe", "certutil", "certutil.exe", "reg"]
    assert kb.keyword_list(base, ["reg"]) == ["Certutil.exe", "Reg.exe", "certutil", "certutil.exe"]


@pytest.mark.skipif(not os.path.isdir(FULL_KNOWLEDGE), reason="no full knowledge base at hand")
def test_full_knowledge_base(spark):
    base = kb.read_knowledge_base(spark, FULL_KNOWLEDGE).cache()
    assert base.count() == 121
    assert kb.example_commands(base).count() == 250
    assert len(kb.keyword_list(base)) == 234


def test_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,cmd\n1,"a ""b"" C:\\x\\"\n2,\n3,NULL\n4,"two\nlines"\n5,plain\n6,""\n')
    got = [r.command_line for r in tables.read_csv(spark, str(path), "cmd").collect()]
    assert got == ['a "b" C:\\x\\', "two\nlines", "plain"]
    with pytest.raises(KeyError, match="Available columns: id, cmd"):
        tables.read_csv(spark, str(path))
    rows = [("x \\ \"q\"",), ("a,b",), (" lead",), ("n\nl",), ("tail\\",)]
    df = spark.createDataFrame(rows, "command_line string")
    tables.write_csv(df, str(tmp_path / "out"), single_file=True)
    assert sorted(tables.read_csv(spark, str(tmp_path / "out")).collect()) == sorted(df.collect())
    assert len(glob.glob(str(tmp_path / "out" / "part-*"))) == 1


def test_synthetic(spark, tmp_path):
    first = synthetic.synthetic_commands(spark, 2000).orderBy("row_id").collect()
    assert len(first) == 2000 and first == synthetic.synthetic_commands(spark, 2000, partitions=3).orderBy("row_id").collect()
    assert first != synthetic.synthetic_commands(spark, 2000, seed=1).orderBy("row_id").collect()
    texts = [r.command_line for r in first]
    assert not any("{id}" in t or "{ip}" in t or "{user}" in t or "{guid}" in t or "{base64}" in t for t in texts)
    assert len({t.split()[0] for t in texts}) >= 12
    preview = synthetic.write_sample_csv(spark, str(tmp_path / "s"), 100)
    assert preview.count() == 10 and tables.read_csv(spark, str(tmp_path / "s")).count() == 100


def test_messages(spark):
    df = spark.createDataFrame([(1, "a\nCommandLine: x\nb"), (2, "none"), (3, None)], "k int, message string")
    assert [tuple(r) for r in tables.from_messages(df).collect()] == [(1, "x")]


def test_run_end_to_end(spark, tmp_path):
    corpus = synthetic.synthetic_commands(spark, 400).select("command_line")
    result = run(spark, corpus, Options(num_topics=3, passes=1, knowledge_path=knowledge_folder(tmp_path)))
    documents = result.documents.cache()
    assert documents.count() == 403
    for column in "command_line normalized_command tokens root_command topic contains_lolbas lolbas_count topic_summary command_group".split():
        assert column in documents.columns
    assert documents.filter("origin = 'knowledge base'").count() == 3
    assert documents.filter("command_group IS NULL OR topic_summary IS NULL").count() == 0
    assert result.scores.agg(F.sum("total_count")).first()[0] == 403
    summary = result.topic_summary.collect()
    assert [r.topic_id for r in summary] == [0, 1, 2] and sum(r.num_documents for r in summary) == 403
    assert set(result.charts) == {"treemap", "treemap_filtered", "topic_words", "sunburst", "lengths", "risk"}
    assert result.charts["treemap"].filter("level = 0").first().n == 403
    assert result.report().startswith("# Corpus report")
    result.save(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "documents")).count() == 403
    assert TopicModel.load(str(tmp_path / "out" / "model")).num_topics == 3


def test_run_without_knowledge_base_and_with_options(spark):
    corpus = synthetic.synthetic_commands(spark, 300).select("command_line")
    options = Options(num_topics=2, passes=1, limit=200, charts=False, knowledge_path="/nowhere", isolate_below=3, tune=True, tune_topics=(2, 3))
    result = run(spark, corpus, options)
    assert result.scores is None and result.charts == {} and len(result.tuning) == 2
    by_perplexity = Options(num_topics=2, limit=200, tune=True, tune_topics=(2, 3), tune_measure="perplexity", tune_rows=150)
    tuned = Analysis(spark, by_perplexity).load(corpus).preprocess().build_dictionary().tune()
    assert [k for k, _ in tuned.tuning] == [2, 3] and tuned.num_topics == min(tuned.tuning, key=lambda s: s[1])[0]
    documents = result.documents
    assert documents.count() == 200
    assert documents.filter("is_anomaly AND topic <> -1").count() == 0 and documents.filter("is_anomaly").count() > 0
    with pytest.raises(ValueError, match="too few"):
        Analysis(spark).load(corpus.limit(5))


def test_files_and_job(spark, tmp_path):
    paths = []
    for i in (1, 2):
        path = str(tmp_path / f"set_{i}.csv")
        tables.write_csv(synthetic.synthetic_commands(spark, 60, seed=i).select("command_line"), path)
        paths.append(path)
    folders = run_files(spark, paths, str(tmp_path / "many"), Options(num_topics=2, passes=1, charts=False))
    assert sorted(os.listdir(tmp_path / "many")) == ["set_1", "set_2"] and len(folders) == 2
    for path, folder in folders.items():
        alone = Analysis(spark).load_csv(path).preprocess().documents
        columns = ["command_line", "normalized_command", "tokens", "root_command"]
        saved = spark.read.parquet(f"{folder}/documents").select(columns)
        assert saved.exceptAll(alone.select(columns)).count() == 0 and saved.count() == alone.count() == 60
        assert TopicModel.load(f"{folder}/model").vocabulary_size == alone.select(F.explode("tokens")).distinct().count()
    few = str(tmp_path / "few.csv")
    tables.write_csv(synthetic.synthetic_commands(spark, 4).select("command_line"), few)
    with pytest.raises(ValueError, match="few.csv: 4"):
        run_files(spark, [*paths, few], str(tmp_path / "none"), Options(num_topics=2))
    arguments = ["--input", *paths, "--topics", "2", "--no-tune", "--no-visualize", "--output", str(tmp_path / "job")]
    assert job.main(arguments).documents.count() == 120
    assert os.path.isdir(tmp_path / "job" / "topic_summary")
    with pytest.raises(SystemExit):
        job.parser().parse_args(["--input", "a", "--synthetic", "5"])


def test_stream_equals_batch(spark, tmp_path):
    corpus = synthetic.synthetic_commands(spark, 300)
    corpus.repartition(3).write.parquet(str(tmp_path / "in"))
    analysis = Analysis(spark, Options(num_topics=2, passes=1)).load(corpus.select("command_line"))
    model = analysis.preprocess().build_dictionary().train().model
    stream = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_stream(stream, lambda rows: score(rows, model, ["reg.exe"]), str(tmp_path / "out"), str(tmp_path / "cp"), True).awaitTermination()
    assert len(glob.glob(str(tmp_path / "out" / "batch_id=*"))) == 3
    columns = ["row_id", "topic", "contains_lolbas", "normalized_command", "root_command"]
    streamed = scored_rows(spark, str(tmp_path / "out")).select(columns)
    batch = score(corpus, model, ["reg.exe"]).select(columns)
    assert streamed.count() == batch.count() and streamed.exceptAll(batch).count() == 0


def test_csv_columns_are_found_by_name_in_each_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("command_line,user\ncmd.exe /c whoami,alice\n")
    (tmp_path / "b.csv").write_text('\ufeff"user",command_line\nbob,"dir ""x"""\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("")
    rows = tables.read_csv(spark, str(tmp_path), with_file=True).collect()
    assert {(r.command_line, r.source_file[-5:]) for r in rows} == {("cmd.exe /c whoami", "a.csv"), ('dir "x"', "b.csv")}
    (tmp_path / "d.csv").write_text("user,other\nx,y\n")
    with pytest.raises(KeyError, match="d.csv"):
        tables.read_csv(spark, str(tmp_path))


def test_output_folders_are_told_apart():
    from argotlog.plans.run import _names

    assert _names(["x/logs.csv", "y/logs.csv"]) == ["x-logs", "y-logs"] and _names(["a/one.csv", "a/two.csv"]) == ["one", "two"]
    with pytest.raises(ValueError, match="twice"):
        _names(["a.csv", "a.csv"])
