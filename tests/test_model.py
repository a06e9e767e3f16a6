"""Topic model: against a plain version, and invariants on a corpus made of two vocabularies, since no two engines give the same bits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from argotlog.operators.coherence import WINDOWS, model_coherence, window_contents
from argotlog.plans import lda
from argotlog.plans import model as M


@pytest.fixture(scope="module")
def planted(spark):
    words = [["alpha", "beta", "gamma", "delta"], ["one", "two", "three", "four"]]
    rng = random.Random(1)
    rows = [(i, rng.choices(words[i % 2], k=6)) for i in range(400)]
    return spark.createDataFrame([*rows, (400, []), (401, ["unseen"]), (402, None)], "row_id bigint, tokens array<string>").repartition(4).cache()


@pytest.fixture(scope="module")
def trained(planted):
    return M.train(planted.filter("row_id < 400"), 2, passes=4, topic_word_prior=0.1)


def test_dictionary_is_complete(spark):
    small = spark.createDataFrame([(["b", "a", "a", ""],), (["c", "b"],), (None,)], "tokens array<string>")
    assert sorted(map(tuple, M.build_dictionary(small).collect())) == [("", 1, 1), ("a", 1, 2), ("b", 2, 2), ("c", 1, 1)]
    with pytest.raises(ValueError, match="no tokens"):
        M.build_dictionary(small.filter("false"))


# ---------------------------------------------------------------------------------------- a plain version, one document and one term at a time


def plain_digamma(x):
    total = 0.0
    while x < 20:
        total -= 1 / x
        x += 1
    return total + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def plain_fit(bag, weights, totals, alpha):
    """(gamma, {term: shares}) of one document."""
    bag = {t: n for t, n in bag.items() if t in weights}
    k = len(alpha)
    beta = {t: [math.exp(plain_digamma(weights[t][j]) - plain_digamma(totals[j])) for j in range(k)] for t in bag}
    gamma = [a + sum(bag.values()) / k for a in alpha]
    for _ in range(lda.MAX_ROUNDS):
        theta = [math.exp(plain_digamma(g) - plain_digamma(sum(gamma))) for g in gamma]
        norm = {t: sum(x * y for x, y in zip(theta, beta[t], strict=True)) for t in bag}
        new = [alpha[j] + sum(n * theta[j] * beta[t][j] / norm[t] for t, n in bag.items()) for j in range(k)]
        change, gamma = sum(abs(x - y) for x, y in zip(new, gamma, strict=True)) / k, new
        if change < lda.TOLERANCE:
            break
    theta = [math.exp(plain_digamma(g) - plain_digamma(sum(gamma))) for g in gamma]
    shares = {t: [n * theta[j] * beta[t][j] / sum(x * y for x, y in zip(theta, beta[t], strict=True)) for j in range(k)] for t, n in bag.items()}
    return gamma, shares


def plain_bound(documents, weights, alpha, eta):
    k = len(alpha)
    totals = [sum(w[j] for w in weights.values()) for j in range(k)]
    bound = 0.0
    for bag in documents:
        gamma, _ = plain_fit(bag, weights, totals, alpha)
        log_theta = [plain_digamma(g) - plain_digamma(sum(gamma)) for g in gamma]
        for t, n in bag.items():
            bound += n * math.log(sum(math.exp(log_theta[j] + plain_digamma(weights[t][j]) - plain_digamma(totals[j])) for j in range(k)))
        bound += sum((a - g) * x + math.lgamma(g) - math.lgamma(a) for a, g, x in zip(alpha, gamma, log_theta, strict=True))
        bound += math.lgamma(sum(alpha)) - math.lgamma(sum(gamma))
    for j in range(k):
        bound += sum((eta - w[j]) * (plain_digamma(w[j]) - plain_digamma(totals[j])) + math.lgamma(w[j]) - math.lgamma(eta) for w in weights.values())
        bound += math.lgamma(eta * len(weights)) - math.lgamma(totals[j])
    return bound


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(8)
    rows = [(i, [f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randint(1, 30))]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(20)]  # a third of them are equal
    return spark.createDataFrame(rows, "row_id bigint, tokens array<string>").repartition(5).cache()


def bags(df):
    return {r.row_id: {t: r.tokens.count(t) for t in r.tokens} for r in df.collect()}


def table_of(weights):
    return {r.term: list(r.weights) for r in weights.table.collect()}


@pytest.mark.parametrize("cells", [lda.BLOCK_CELLS, 1])
def test_one_step_equals_the_plain_version(small, cells, monkeypatch):
    """Two models side by side, in one block or in many of at least 64 entries."""
    monkeypatch.setattr(lda, "BLOCK_CELLS", cells)
    alphas, etas = ((0.5, 0.3, 0.2), (0.5, 0.5)), (0.1, 0.5)
    layout = lda.Layout((3, 2), alphas, etas)
    start = lda.initial(M.build_dictionary(small), layout, 1)
    blocks = lda.slices(small, 1, layout.width, 1)
    assert (blocks.count() > 3) == (cells == 1)
    before = table_of(start)
    assert all(0.1 <= w <= 2 for ws in before.values() for w in ws) and np.allclose(start.totals, np.sum(list(before.values()), axis=0))
    moved = lda.updated(start, lda.statistics(blocks, start, layout, 0.25 * 2.0), layout, 0.25)
    after, documents = table_of(moved), bags(small).values()
    for part, alpha, eta in zip(layout.parts, alphas, etas, strict=True):
        old = {t: w[part] for t, w in before.items()}
        totals = [sum(w[j] for w in old.values()) for j in range(len(alpha))]
        stats = {t: [0.0] * len(alpha) for t in old}
        for bag in documents:
            for t, shares in plain_fit(bag, old, totals, alpha)[1].items():
                stats[t] = [a + b for a, b in zip(stats[t], shares, strict=True)]
        for t, w in old.items():
            expected = [0.75 * a + 0.25 * (eta + 2.0 * s) for a, s in zip(w, stats[t], strict=True)]
            assert np.allclose(after[t][part], expected, rtol=1e-6), t
    bounds = lda.bounds(blocks, moved, layout)
    for part, alpha, eta, bound in zip(layout.parts, alphas, etas, bounds, strict=True):
        assert math.isclose(bound, plain_bound(documents, {t: w[part] for t, w in after.items()}, alpha, eta), rel_tol=1e-6)


def test_assignment_equals_the_plain_version(small):
    model = M.train(small, 3, passes=1)
    weights = table_of(model.weights)
    got = {r.row_id: r.theta for r in model.distributions(small, "row_id").collect()}
    for row, bag in bags(small).items():
        gamma, _ = plain_fit(bag, weights, model.weights.totals.tolist(), model.alpha)
        assert np.allclose(got[row], np.array(gamma) / sum(gamma), atol=1e-6)
    assert len({tuple(got[i]) for i in (3, *range(100, 120))}) == 1


def test_more_terms_than_a_task_is_given_in_one_piece(spark):
    """Each document brings terms of its own: 200,000 terms here, none of which the driver or a task sees as a whole."""
    rows = spark.range(20_000).select(F.col("id").alias("row_id"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("t"), F.col("id") * 10 + i)).alias("own"))
    rows = rows.withColumn("tokens", F.concat("own", F.array(F.when(F.col("row_id") % 2 == 0, "even").otherwise("odd"))))
    model = M.train(rows, 2, passes=1, step_share=0.5, topic_word_prior=0.1)
    assert model.vocabulary_size == 200_002 and model.assign(rows, key="row_id").where("topic >= 0").count() == 20_000
    assert model.weights.table.count() == 200_002


def test_prior_falls_and_sums_to_one():
    prior = M.asymmetric_prior(11)
    assert math.isclose(sum(prior), 1) and prior == sorted(prior, reverse=True)
    assert math.isclose(prior[0] / prior[1], (1 + math.sqrt(11)) / math.sqrt(11))


def test_topics_separate_the_vocabularies(planted, trained):
    rows = {r.row_id: r.topic for r in trained.assign(planted).collect()}
    assert rows[400] == rows[401] == rows[402] == -1
    even, odd = {rows[i] for i in range(0, 400, 2)}, {rows[i] for i in range(1, 400, 2)}
    assert len(even) == len(odd) == 1 and even != odd and even | odd == {0, 1}


def test_distributions_sum_to_one(planted, trained):
    rows = trained.distributions(planted, "row_id").collect()
    assert {r.row_id for r in rows} == set(range(400)) and all(abs(sum(r.theta) - 1) < 1e-9 for r in rows)
    words = trained.top_words(8).groupBy("topic").agg(F.sum("weight").alias("s"), F.count("term").alias("n")).collect()
    assert [(round(r.s, 9), r.n) for r in words] == [(1.0, 8)] * 2


def test_top_words_rank_by_weight_then_term(spark):
    rows = [(f"t{i:02}", [float(i % 4 + 1), 1.0]) for i in range(40)]
    table = spark.createDataFrame(rows, "term string, weights array<double>").repartition(6)
    found = M.TopicModel(lda.Weights(table, np.array([100.0, 40.0]), 40), (0.5, 0.5), 1.0).top_words(3).orderBy("topic", "rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, "t03", 0.04), (0, 2, "t07", 0.04), (0, 3, "t11", 0.04), (1, 1, "t00", 0.025), (1, 2, "t01", 0.025), (1, 3, "t02", 0.025)]


def test_same_seed_same_topics_and_save_load(planted, trained, tmp_path):
    again = M.train(planted.filter("row_id < 400"), 2, passes=4, topic_word_prior=0.1)
    first = trained.assign(planted).select("row_id", "topic").collect()
    assert sorted(first) == sorted(again.assign(planted).select("row_id", "topic").collect())
    trained.save(str(tmp_path / "m"))
    loaded = M.TopicModel.load(str(tmp_path / "m"))
    assert loaded.num_topics == 2 and loaded.vocabulary_size == trained.vocabulary_size == 8 and loaded.alpha == trained.alpha
    assert sorted(first) == sorted(loaded.assign(planted).select("row_id", "topic").collect())


def test_full_batch_stops_at_the_bound(planted):
    docs = planted.filter("row_id < 400")
    model = M.train_full_batch(docs, 2, max_iter=30)
    assert model.top_words(3).count() == 6 and model.assign(docs).where("topic >= 0").count() == 400
    more = M.train_full_batch(docs, 2, max_iter=60)
    assert math.isclose(M.log_perplexity(model, docs), M.log_perplexity(more, docs), rel_tol=1e-4)


def test_tuning_by_perplexity(planted):
    best, scores = M.tune_by_perplexity(planted.filter("row_id < 400"), (2, 6), max_iter=5)
    assert best == min(scores, key=lambda s: s[1])[0] and [k for k, _ in scores] == [2, 6]


def test_candidates_side_by_side_equal_single_models(planted):
    """A candidate does not depend on its neighbours but for the weights that it starts from."""
    docs = planted.filter("row_id < 400")
    words = M.candidate_words(docs, (2, 3), 4, 7, M.build_dictionary(docs), 4).collect()
    alone = M.candidate_words(docs, (2,), 4, 7, M.build_dictionary(docs), 4).collect()
    assert {(r.topic, r.rank, r.term) for r in words if r.model == 2} == {(r.topic, r.rank, r.term) for r in alone}
    assert len([r for r in words if r.model == 3]) == 12


def test_tuning_by_coherence(planted):
    best, scores = M.tune_by_coherence(planted.filter("row_id < 400"), (2, 3), passes=1, sample_rows=300)
    assert [k for k, _ in scores] == [2, 3] and best in (2, 3) and all(-1 <= c <= 1 for _, c in scores)


def test_coherence_prefers_words_that_occur_together(spark, planted):
    rows = [(1, 0, 1, "alpha"), (1, 0, 2, "beta"), (2, 0, 1, "alpha"), (2, 0, 2, "two")]
    topics = spark.createDataFrame(rows, "model int, topic int, rank int, term string")
    for measure in WINDOWS:
        score = {r.model: r.coherence for r in model_coherence(topics, planted, measure).collect()}
        assert score[1] > score[2], measure
    with pytest.raises(ValueError, match="unknown coherence"):
        model_coherence(topics, planted, "nope")


def test_windows_of_a_long_document(spark):
    rng = random.Random(4)
    tokens = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(2000)]
    words = ["a1", "b2", "c3", "d4"]
    expected = {}
    for start in range(len(tokens) - 110 + 1):
        key = tuple(sorted(set(tokens[start : start + 110]) & set(words)))
        expected[key] = expected.get(key, 0) + 1
    df = spark.createDataFrame([(tokens,)], "tokens array<string>")
    assert {tuple(r.content): r.n for r in window_contents(df, words, 110).collect()} == expected


def test_digamma_and_log_gamma():
    x = np.array([1e-3, 0.1, 0.5, 1.0, 3.3, 7.9, 8.0, 40.0, 1e6])
    assert np.allclose(lda.digamma(x), [plain_digamma(v) for v in x], rtol=1e-9, atol=1e-12)
    assert np.allclose(lda.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_documents_in_short_runs_are_fitted_alike(small, monkeypatch):
    """Runs of one document each, or all together: the same shares, as the order and number of tokens do not matter."""
    model = M.train(small, 3, passes=1)
    found = []
    for cells in (1, lda.RUN_CELLS):
        monkeypatch.setattr(lda, "RUN_CELLS", cells)
        bag = {t: float(n) for t, n in bags(small)[3].items()}
        ends = np.array([len(bag), 2 * len(bag)])
        d = lda._documents(np.tile(np.arange(len(bag)), 2), np.array(list(bag.values()) * 2), ends, np.arange(len(bag)), np.array([table_of(model.weights)[t] for t in bag]), len(bag))
        found.append(lda.fit(d, lda._betas(d, model.weights.totals, slice(0, 3)), np.array(model.alpha)))
    assert np.allclose(*found) and np.allclose(found[0][0], found[0][1])


def test_bags_need_no_sorting_expressions(spark):
    """Terms are counted for whole batches: neither the dictionary nor the blocks sort and cut the tokens of each row by interpreted expressions."""
    df = spark.createDataFrame([(1, ["b", "a", "a", None]), (2, ["a", "b", "a"]), (3, []), (4, None), (5, [None])], "row_id int, tokens array<string>")
    counted = lda.counted_terms(df)
    assert sorted(map(tuple, counted.collect())) == [("a", 2, 4), ("b", 2, 2)]
    assert "array_sort" not in counted._jdf.queryExecution().toString()
    (block,) = lda.slices(df.coalesce(1), 1, 2, 1).collect()
    assert block.carried == [2] and dict(zip(block.terms, np.frombuffer(block.n)[np.argsort(np.frombuffer(block.term, np.int32))], strict=True)) == {"a": 2.0, "b": 1.0}


def test_a_short_document_is_one_window(spark):
    rows = [(["b", "x", "a", "b", None],), ([],), (["x"],), (["a"] * 10,), (["a"] * 9 + ["b", "x"],)]
    df = spark.createDataFrame(rows, "tokens array<string>")
    found = {tuple(r.content): r.n for r in window_contents(df, ["a", "b"], 10).collect()}
    assert found == {("a", "b"): 3, (): 2, ("a",): 1}
    assert {tuple(r.content): r.n for r in window_contents(df, ["a", "b"], None).collect()} == {("a", "b"): 2, (): 2, ("a",): 1}


def test_a_task_holds_one_block_of_documents_at_a_time(spark):
    """Blocks are bounded for few topics too, and the rows of a block are fitted before those of the next are read."""
    rows = spark.range(60).coalesce(1).select(F.lit(0).alias("slot"), F.transform(F.sequence(F.lit(1), F.lit(9000)), lambda i: F.concat(F.lit("t"), i % 3000)).alias("tokens"), F.col("id").alias("carried"))
    blocks = lda.blocks_of(rows, 1)
    sizes = [r[0] for r in blocks.select(F.expr("octet_length(n) div 8")).collect()]
    assert len(sizes) > 1 and sum(sizes) == 60 * 3000
    layout = lda.Layout((1,), ((1.0,),), (1.0,))
    start = lda.initial(blocks.select(F.explode("terms").alias("term")).distinct(), layout, 1)
    every = lda.gathered(blocks, start.table.where("term != 't7'"), 1).coalesce(1).toArrow().to_batches(max_chunksize=1)
    assert len(every) > 5
    read = []
    seen = lda._each((read.append(i) or b for i, b in enumerate(every)), 1)
    carried, d, terms = next(seen)
    assert len(read) < len(every)
    parts = [(carried, d, terms), *seen]
    assert sorted(x for p in parts for x in p[0].to_pylist()) == list(range(60)) and len(parts) == len(sizes)
    for carried, d, terms in parts:
        assert d.n.sum() == len(carried) * 8997 and "t7" not in {terms[i].as_py() for i in d.known}
        assert all(d.weights[:, 0] > 0) and len(d.known) == 2999
