"""Cases in which an operator once did less than the whole job."""

import random

from argotlog.llm import passages
from argotlog.llm.licenses import TEMPLATES, scan_licenses
from argotlog.llm.passages import near_passages
from tests.llm import brute
from tests.llm.test_operators import frame, prose


def covers(row, starts, n=50):
    return all(any(s["start"] <= i and i + n <= s["end"] for s in row["spans"]) for i in starts)


def test_a_long_text_may_have_a_passage_twice(spark):
    rng = random.Random(11)
    passage = prose(rng, 60)
    rows = [(0, " ".join(prose(rng, 300) + passage + prose(rng, 200) + passage + prose(rng, 300)))]
    rows += [(i, " ".join(prose(rng, 20) + passage + prose(rng, 20))) for i in (1, 2, 3)]
    got = {r["doc_id"]: r for r in near_passages(frame(spark, rows)).collect()}
    assert got[0]["n_passages"] == 2 and {r["class_id"] for r in got.values()} == {0}
    assert all(covers(got[key], starts) for key, starts in brute.repeated(rows).items())


def test_chains_of_passages_are_one_class(spark):
    # Of 46 shingles 41 must be common. Neighbours differ in 3, 3 and 4 of them, all others in 6 or 7.
    rng, rows, expected = random.Random(5), [], {}
    for _ in range(12):
        passages = [prose(rng, 50)]
        for place in (2, 47, 3):
            passages.append([*passages[-1][:place], f"new{rng.random()}", *passages[-1][place + 1 :]])
        first = len(rows)
        # The ends come first and hold other passages too, so they are pivots before the middle is.
        for i in (3, 0, 1, 2):
            rows.append((len(rows), " ".join(passages[i] + (prose(rng, 300) if i in (0, 3) else []))))
        for i in (0, 1):
            rows.append((len(rows), " ".join([*prose(rng, 5), *rows[first + i][1].split()[55:]])))
        expected |= {key: first for key, _ in rows[first:]}
    got = {r["doc_id"]: r["class_id"] for r in near_passages(frame(spark, rows)).collect()}
    assert got == expected


def test_copies_of_a_text_make_no_windows_of_their_own(spark, monkeypatch):
    # Equal texts made the windows of each, and these filled the disk.
    rng, sizes, table = random.Random(7), [], passages.table
    base, other = prose(rng, 400), prose(rng, 400)
    changed = [*base[:200], "new", *base[201:]]
    rows = [(i, " ".join(changed if i == 20 else base if i < 40 else other)) for i in range(80)]

    def counted(df, *args):
        out = table(df, *args)
        if {"value", "c"} <= set(out.columns):
            sizes.append(out.count())
        return out

    monkeypatch.setattr(passages, "table", counted)
    got = {r["doc_id"]: r for r in near_passages(frame(spark, rows)).collect()}
    assert sizes and max(sizes) < 1000
    assert {key: r["class_id"] for key, r in got.items()} == {key: 0 if key < 40 else 40 for key in range(80)}
    assert all([(s["start"], s["end"]) for s in r["spans"]] == [(0, 400)] for r in got.values())


def test_short_notices_are_met_at_any_place(spark):
    rng, notice = random.Random(2), TEMPLATES["MIT notice"].split()
    rows = [(i, " ".join(prose(rng, i % 40) + notice + prose(rng, rng.randrange(30)))) for i in range(800)]
    found = {r["doc_id"] for r in scan_licenses(frame(spark, rows)).where("license = 'MIT notice'").collect()}
    assert found == set(range(800))
