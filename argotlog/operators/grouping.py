"""Group near-identical command templates around leaders.

Templates are ranked by how many rows they have (most first), then by text, and never compared across root executables.  In rank
order each template joins the most similar earlier leader if the similarity reaches the threshold, and else becomes a
leader.  The result is exactly that of the sequential definition, without a sequential pass over a bucket:

* In every round each bucket offers its first undecided templates, a batch of bounded size that grows from round to round.  All earlier templates are
  decided and none of their leaders is similar, so running the definition inside the batch yields true leaders.
* The new leaders are compared with all later templates of their bucket, once: what is similar enough is decided, and keeps its best leader so far.
  A bucket is cut into salts of bounded size; each meets the new leaders in a task of its own, where both are prepared once and compared side by side.
* When nothing is undecided, every template has met all earlier leaders of its bucket, and its best one is the best of the rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import root_executable
from ..session import discard, materialize
from .similarity import Patterns, Texts, bounds, common_of_pairs, make_similarity

__all__ = ["make_similarity"]

DEFAULT_THRESHOLD = 40
# Templates that a bucket offers in the first round, and at most in a later one.
BATCH = 256
LARGEST_BATCH = 4096
# Templates of a bucket that are compared with new leaders in one task.
SALT_ROWS = 4096
# Inside a batch, so many are compared with the leaders before them at once.
STRIDE = 128
# Bounds on the templates that are broadcast to label rows: at most this many, of at most this many bytes.
COMMON_TEMPLATES = 65_536
COMMON_TEMPLATE_BYTES = 512


def _alike(a: Texts, b: Texts, patterns: Patterns, low: int, high: int, threshold: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of ``a``, text of ``b``, common) of the ``allowed`` pairs that reach the threshold."""
    total = a.length[low:high, None] + b.length[None, :]
    left, right = np.nonzero(allowed & (200 * bounds(a, b, low, high) >= threshold * total))
    shared = common_of_pairs(a, patterns, left + low, right)
    good = 200 * shared >= threshold * (a.length[left + low] + b.length[right])
    return left[good] + low, right[good], shared[good]


def leaders_of(texts: list[str], threshold: int) -> list[int]:
    """Which of ``texts``, in rank order, are leaders by the sequential definition."""
    found: list[int] = []
    for begin in range(0, len(texts), STRIDE):
        some = list(range(begin, min(begin + STRIDE, len(texts))))
        a = Texts([texts[i] for i in some])
        free = np.ones(len(some), bool)
        if found:
            b = Texts([texts[i] for i in found])
            left, _, _ = _alike(a, b, Patterns(b), 0, len(a), threshold, np.ones((len(a), len(b)), bool))
            free[left] = False
        left, right, _ = _alike(a, a, Patterns(a), 0, len(a), threshold, np.tri(len(a), k=-1, dtype=bool) & free[:, None] & free[None, :])
        earlier: dict[int, list[int]] = {}
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            earlier.setdefault(i, []).append(j)
        for i in np.flatnonzero(free).tolist():
            free[i] = not any(free[j] for j in earlier.get(i, ()))
        found += [some[i] for i in np.flatnonzero(free)]
    return found


def _offered(undecided: DataFrame, size: int, threshold: int) -> DataFrame:
    """(bucket, n, template, leader) of the first ``size`` undecided templates of every bucket; ``leader`` says which of them lead."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("rank", "ascending")]).combine_chunks()
        lead = np.zeros(rows.num_rows, bool)
        lead[leaders_of(rows["template"].to_pylist(), threshold)] = True
        return pa.table({"bucket": rows["bucket"], "n": rows["n"], "template": rows["template"], "leader": pa.array(lead)})

    order = W.partitionBy("bucket").orderBy(F.desc("n"), F.asc("template"))
    first = undecided.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    chosen = first.select(F.coalesce("bucket", F.lit("")).alias("bucket"), "n", "template", "rank")
    return materialize(chosen.groupBy("bucket").applyInArrow(run, "bucket string, n bigint, template string, leader boolean"))


def _offers(templates: DataFrame, leaders: DataFrame, threshold: int) -> DataFrame:
    """(template, distance, order, leader) of the best of ``leaders`` for each later template of its bucket that has one similar enough."""

    def run(rows: pa.Table, heads: pa.Table) -> pa.Table:
        rows, heads = rows.combine_chunks(), heads.sort_by([("n", "descending"), ("template", "ascending")]).combine_chunks()
        out = {"template": [], "distance": [], "order": [], "leader": []}
        if rows.num_rows and heads.num_rows:
            b = Texts(heads["template"].to_pylist())
            a, patterns = Texts(rows["template"].to_pylist()), Patterns(b)
            n, leader_n = rows["n"].to_numpy(), heads["n"].to_numpy()
            # Places of the templates among the leaders in rank order: only leaders before them count.
            place = np.array([_before(leader_n, b.texts, int(m), t) for m, t in zip(n, a.texts, strict=True)])
            step = max(1, (1 << 21) // len(b))
            for low in range(0, len(a), step):
                high = min(low + step, len(a))
                left, right, shared = _alike(a, b, patterns, low, high, threshold, np.arange(len(b))[None, :] < place[low:high, None])
                distance = -200.0 * shared / (a.length[left] + b.length[right])
                order = np.lexsort((right, distance, left))
                left, right, distance = left[order], right[order], distance[order]
                for k in np.flatnonzero(np.diff(left, prepend=-1)):
                    out["template"].append(a.texts[left[k]])
                    out["distance"].append(float(distance[k]))
                    out["order"].append(-int(leader_n[right[k]]))
                    out["leader"].append(b.texts[right[k]])
        return pa.table(out, pa.schema([("template", pa.string()), ("distance", pa.float64()), ("order", pa.int64()), ("leader", pa.string())]))

    salted = leaders.join(templates.select("bucket", "salts").distinct(), "bucket")
    heads = salted.select("bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "n", "template")
    active = templates.join(leaders.select("bucket").distinct(), "bucket", "left_semi").select("bucket", "salt", "n", "template")
    return active.groupBy("bucket", "salt").cogroup(heads.groupBy("bucket", "salt")).applyInArrow(run, "template string, distance double, order bigint, leader string")


def _before(counts: np.ndarray, texts: list[str], n: int, text: str) -> int:
    """How many of the leaders, falling by count and then rising by text, come before (n, text)."""
    low, high = int(np.searchsorted(-counts, -n, side="left")), int(np.searchsorted(-counts, -n, side="right"))
    while low < high:
        middle = (low + high) // 2
        if texts[middle] < text:
            low = middle + 1
        else:
            high = middle
    return low


def group_ranked(templates: DataFrame, threshold: int = DEFAULT_THRESHOLD, batch: int = BATCH) -> DataFrame:
    """(template, command_group) from distinct templates (bucket, template, n): the most similar earlier leader of the bucket, the earlier one on ties,
    else the template itself."""
    sizes = templates.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    same = F.coalesce("bucket", F.lit(""))
    keyed = templates.select(same.alias("bucket"), "template", "n").join(sizes.groupBy(same.alias("bucket")).agg(F.sum("salts").alias("salts")), "bucket")
    every = materialize(keyed.withColumn("salts", F.col("salts").cast("int")).withColumn("salt", F.pmod(F.xxhash64("template"), "salts").cast("int")))
    undecided, found, size = every.select("bucket", "template", "n"), None, batch
    while True:
        offered = _offered(undecided, size, threshold)
        leaders = offered.where("leader").select("bucket", "n", "template")
        offers = materialize(_offers(every, leaders, threshold))
        found = offers if found is None else found.unionByName(offers)
        done = offered.select("template").unionByName(offers.select("template"))
        rest = materialize(undecided.join(done, "template", "left_anti"))
        discard(undecided, offered)
        undecided, size = rest, min(2 * size, max(batch, LARGEST_BATCH))
        if undecided.isEmpty():
            break
    best = found.groupBy("template").agg(F.min(F.struct("distance", "order", "leader")).alias("best"))
    # Leaders have met earlier leaders as well, but none that is similar.
    return every.join(best, "template", "left").select("template", F.coalesce("best.leader", "template").alias("command_group"))


def distinct_templates(df: DataFrame, template: str = "normalized_command") -> DataFrame:
    """(bucket, template, n): distinct templates, their row counts and their root executables."""
    counts = df.groupBy(F.col(template).alias("template")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(root_executable(F.col("template")).alias("bucket"), "template", "n")


def group_templates(
    df: DataFrame, template: str = "normalized_command", threshold: int = DEFAULT_THRESHOLD, batch: int = BATCH
) -> DataFrame:
    """(template, command_group, n) for every distinct template of ``df`` and its number of rows."""
    templates = materialize(distinct_templates(df, template))
    return group_ranked(templates, threshold, batch).join(templates.select("template", "n"), "template")


def with_command_group(df: DataFrame, groups: DataFrame, template: str = "normalized_command") -> DataFrame:
    """Add ``command_group`` to every row; ``groups`` has (template, command_group, n).

    A template with at least 1 / COMMON_TEMPLATES of all rows is looked up in a broadcast, of which there can be no more than that; only rows of the
    others are shuffled, so no template is a hot key.  ``df`` is read for the one kind and for the other, so it should be a table.
    """
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.coalesce((F.col("n") * COMMON_TEMPLATES >= total) & (F.octet_length("template") <= COMMON_TEMPLATE_BYTES), F.lit(False))
    common = groups.where(often).select(F.col("template").alias(template), "command_group", F.lit(True).alias("_common"))
    looked = df.join(F.broadcast(common), template, "left")
    known = looked.where("_common").drop("_common")
    others = groups.where(~often).select(F.col("template").alias(template), "command_group")
    rest = looked.where("_common IS NULL").drop("command_group", "_common").join(others, template, "left")
    return known.unionByName(rest)
