"""Grouping against the sequential definition, run here as a plain loop on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from argotlog.operators import grouping as G
from argotlog.operators import similarity as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_force(buckets, threshold):
    groups = {}
    for rows in buckets.values():
        leaders = []
        for template, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
            best = None
            for leader in leaders:
                total = len(template) + len(leader)
                score = lcs(template, leader)
                if 200 * score >= threshold * total and (best is None or score / total > best[0]):
                    best = (score / total, leader)
            groups[template] = best[1] if best else template
            if not best:
                leaders.append(template)
    return groups


def test_longest_common_subsequence():
    common, rng = G.make_similarity(), random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abcé", k=rng.randint(0, 14))) for _ in range(2))
        assert common(a, b) == lcs(a, b)


@pytest.mark.parametrize("threshold,batch", [(40, 256), (40, 3), (75, 5), (95, 7)])
def test_groups_equal_the_sequential_definition(spark, threshold, batch):
    rng = random.Random(threshold * batch)
    buckets = {}
    for bucket, size in (("a.exe", 120), ("b.exe", 25), ("", 1), ("c", 2)):
        texts = {bucket + " " + "".join(rng.choices("abcd -/", k=rng.choice([2, 5, 12, 30]))) for _ in range(size)}
        buckets[bucket] = [(t, rng.choice([1, 1, 1, 2, 9])) for t in texts]
    rows = [(b, t, n) for b, items in buckets.items() for t, n in items]
    templates = spark.createDataFrame(rows, "bucket string, template string, n bigint")
    groups = {r.template: r.command_group for r in G.group_ranked(templates, threshold, batch).collect()}
    assert groups == brute_force(buckets, threshold)


def test_salts_and_strides_give_the_same_groups(spark, monkeypatch):
    """A bucket over many tasks, batches that grow, and texts too long to be compared side by side."""
    monkeypatch.setattr(G, "SALT_ROWS", 20)
    monkeypatch.setattr(G, "STRIDE", 16)
    monkeypatch.setattr(G, "LARGEST_BATCH", 40)
    rng = random.Random(5)
    texts = sorted({"x " + "".join(rng.choices("abcdefg", k=rng.choice([3, 9, 40]))) for _ in range(300)} | {"x " + "ab" * n for n in (590, 600)})
    rows = [("x", t, rng.choice([1, 1, 2])) for t in texts] + [(None, "alone", 1)]
    templates = spark.createDataFrame(rows, "bucket string, template string, n bigint")
    groups = {r.template: r.command_group for r in G.group_ranked(templates, 60, 10).collect()}
    assert groups == brute_force({"x": [r[1:] for r in rows[:-1]], None: [rows[-1][1:]]}, 60)


def test_rows_get_their_group(spark):
    df = spark.createDataFrame(
        [("cmd.exe /c dir a",), ("cmd.exe /c dir b",), ("cmd.exe /c dir b",), ("reg.exe q",), ("",)], "normalized_command string"
    )
    groups = G.group_templates(df)
    got = {r.normalized_command: r.command_group for r in G.with_command_group(df, groups).collect()}
    assert got == {
        "cmd.exe /c dir a": "cmd.exe /c dir b",
        "cmd.exe /c dir b": "cmd.exe /c dir b",
        "reg.exe q": "reg.exe q",
        "": "",
    }


def test_many_pairs_at_once_equal_single_pairs():
    rng = random.Random(2)
    for alphabet, size in (("abcdé中 -", 20), ("ab", 150), ("abcdefghij /\U0001f600", 1300)):
        left, right = (S.Texts(["".join(rng.choices(alphabet + extra, k=rng.randint(0, size))) for _ in range(25)]) for extra in ("", "z"))
        i, j = (x.ravel() for x in np.indices((25, 25)))
        expected = [G.make_similarity()(left.texts[a], right.texts[b]) for a, b in zip(i, j, strict=True)]
        assert S.common_of_pairs(left, S.Patterns(right), i, j).tolist() == expected
        assert (S.bounds(left, right, 0, 25).ravel() >= expected).all()


def test_many_unlike_templates_of_one_root(spark):
    rng = random.Random(9)
    rows = [("a.exe", "a.exe " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=24)), 1) for _ in range(6000)]
    groups = G.group_ranked(spark.createDataFrame(rows, "bucket string, template string, n bigint").distinct(), 80)
    assert groups.count() == len({r[1] for r in rows}) and groups.where("template <> command_group").count() == 0


def test_common_templates_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(G, "COMMON_TEMPLATES", 4)
    df = spark.createDataFrame([("often",)] * 50 + [(f"t{i}",) for i in range(30)] + [(None,), ("no group",)], "normalized_command string")
    groups = spark.createDataFrame([("often", "g1", 50), *((f"t{i}", "g2", 1) for i in range(30))], "template string, command_group string, n bigint")
    got = G.with_command_group(df, groups)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("often", "g1")] * 50 + [(f"t{i}", "g2") for i in range(30)] + [(None, None), ("no group", None)], key=str)
