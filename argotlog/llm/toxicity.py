"""Toxicity: logistic regression over hashed word n-grams and skip-grams, fitted by FTRL-proximal.

Per-coordinate learning rates let rare insults learn fast while common words settle; the L1 term leaves most weights at exactly zero,
so the model that goes to every task is a short list of (feature, weight).  Shards of the labelled rows are fitted side by side and
their states are averaged between rounds (iterative parameter mixing), so no task holds more than a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argotlog.llm.tables import drop, fresh, table
from argotlog.llm.words import LETTERS_DIGITS, U64, Words, give_back, mix, words

# Features live in a fixed space: the first half is for single words, the second for pairs.
BITS = 22
SPACE = 1 << BITS
BEGINNING = 5
# The classifier is fitted on at most about so many labelled rows, taken by a hash of their ids, in shards of about so many.
LABELLED_ROWS = 48_000
SHARD_ROWS = 4_000
# Features of the state that are averaged together.
STATE_BLOCK = 1 << 16


@dataclass(frozen=True)
class Ftrl:
    """Learning rate ``alpha``, its smoothing ``beta``, penalties ``l1`` and ``l2``, passes of a shard in each round."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    passes: int = 6
    rounds: int = 2


@dataclass(frozen=True)
class Model:
    feature: np.ndarray
    weight: np.ndarray
    bias: float


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, and their offsets: words, neighbours, and pairs with one or two words between.

    A word also counts by its beginning, so that the forms of one word in inflected languages support each other.
    """
    n, doc = len(w.hash), w.doc()
    half, shift = U64(SPACE // 2 - 1), U64(BITS)
    found = [(doc, w.hash & half), (doc, mix(w.beginning(BEGINNING) + U64(BEGINNING)) & half)]
    for gap in (1, 2, 3):
        if n > gap:
            same = doc[gap:] == doc[:-gap]
            pair = mix(w.hash[:-gap] * U64(0xC2B2AE3D27D4EB4F) + w.hash[gap:] + U64(gap))
            found.append((doc[gap:][same], ((pair & half) | U64(SPACE // 2))[same]))
    keys = np.concatenate([(d.astype(np.uint64) << shift) | f for d, f in found])
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    at = np.searchsorted(keys, np.arange(len(w.first), dtype=np.uint64) << shift)
    return (keys & U64(SPACE - 1)).astype(np.int32), at


def _features_of(texts: pd.Series) -> list[np.ndarray]:
    out = []
    for _, _, w in words(pa.array(texts, type=pa.large_string(), from_pandas=True), LETTERS_DIGITS):
        values, at = features(w)
        out += [values[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]
    return out


def _learn(rows: list[np.ndarray], labels: np.ndarray, z: np.ndarray, n: np.ndarray, how: Ftrl) -> None:
    """Passes of FTRL-proximal over one shard; ``z`` and ``n`` are the state, its last place is the bias (not penalised)."""
    alpha, beta, l1, l2 = how.alpha, how.beta, how.l1, how.l2
    for _ in range(how.passes):
        for row, label in zip(rows, labels, strict=True):
            i = np.append(row, SPACE)
            zi, ni = z[i].astype(np.float64), n[i].astype(np.float64)
            root = np.sqrt(ni)
            penalty = np.full(len(i), l1, dtype=np.float64)
            penalty[-1] = 0
            weight = np.where(np.abs(zi) <= penalty, 0.0, (np.sign(zi) * penalty - zi) / ((beta + root) / alpha + l2))
            slope = 1 / (1 + np.exp(-np.clip(weight.sum(), -35, 35))) - label
            sigma = (np.sqrt(ni + slope * slope) - root) / alpha
            z[i] += slope - sigma * weight
            n[i] += slope * slope


def _round(start, how: Ftrl):
    """One round of one shard, from the state that all shards begin with."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        z, n = np.zeros(SPACE + 1, np.float32), np.zeros(SPACE + 1, np.float32)
        i, z_i, n_i = start.value
        z[i], n[i] = z_i, n_i
        order = pd.util.hash_pandas_object(part["doc_id"], index=False).to_numpy().argsort(kind="stable")
        part = part.iloc[order]
        _learn(_features_of(part["text"]), part["toxic"].to_numpy(), z, n, how)
        del part
        give_back()
        # Which features were touched is a bit for each; their numbers follow in order.
        blocks = [slice(a, a + STATE_BLOCK) for a in range(0, SPACE + 1, STATE_BLOCK)]
        seen = [n[b] > 0 for b in blocks]
        pairs = list(zip(blocks, seen, strict=True))
        return pd.DataFrame({"block": np.arange(len(blocks)), "feature": [np.packbits(s).tobytes() for s in seen], "z": [z[b][s].tobytes() for b, s in pairs], "n": [n[b][s].tobytes() for b, s in pairs]})

    return run


def _mean(shards: int, least: float):
    """The state of a block of features, averaged over all shards; then what is below ``least`` is left out."""

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        base = int(parts["block"].iloc[0]) * STATE_BLOCK
        z, n = np.zeros(STATE_BLOCK), np.zeros(STATE_BLOCK)
        for feature, z_i, n_i in zip(parts["feature"], parts["z"], parts["n"], strict=True):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(feature, np.uint8)))
            z[at] += np.frombuffer(z_i, np.float32)
            n[at] += np.frombuffer(n_i, np.float32)
        z, n = z / shards, n / shards
        kept = np.flatnonzero((np.abs(z) > least) | ((np.arange(STATE_BLOCK) + base == SPACE) & (n > 0)))
        return pd.DataFrame({"feature": kept + base, "z": z[kept], "n": n[kept]})

    return run


def fit(docs: DataFrame, labels: DataFrame, how: Ftrl | None = None, rows: int = LABELLED_ROWS, shard_rows: int = SHARD_ROWS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), about ``rows`` of them by hash of the id.

    Rows without label, id or text are left out; of several labels of one document the highest counts.  Without any label the
    model has no weights and a bias of 0.  What goes to all tasks is bounded by ``rows`` and by the feature space.
    """
    how = how or Ftrl()
    given = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    there = given.count()
    share, shards = min(1.0, rows / max(1, there)), -(-min(rows, max(1, there)) // shard_rows)
    some = given.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int")
    train = table(
        docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(some), "doc_id").select(shard.alias("shard"), "doc_id", "text", "toxic"),
        "labelled",
        "zstd",
    )
    spark = docs.sparkSession
    z, n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)
    for _ in range(how.rounds):
        touched = np.flatnonzero(n)
        start = spark.sparkContext.broadcast((touched, z[touched], n[touched]))
        # By range, since a few shard numbers may share a partition by hash.
        state = train.repartitionByRange(shards, "shard").groupBy("shard").applyInPandas(_round(start, how), "block int, feature binary, z binary, n binary")
        # What is far below the L1 threshold on average over all shards has no weight and need not travel.
        mean = state.groupBy("block").applyInPandas(_mean(shards, how.l1 / 2), "feature bigint, z double, n double").toPandas()
        start.destroy()
        z, n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)
        z[mean["feature"]], n[mean["feature"]] = mean["z"], mean["n"]
    drop(train)
    penalty = np.full(SPACE + 1, how.l1)
    penalty[-1] = 0
    weight = np.where(np.abs(z) <= penalty, 0.0, (np.sign(z) * penalty - z) / ((how.beta + np.sqrt(n)) / how.alpha + how.l2))
    chosen = np.flatnonzero(weight[:-1])
    return Model(chosen, weight[chosen].astype(np.float32), float(weight[-1]))


def toxicity(spark, model: Model, text: Column) -> Column:
    """Score from 0 to 1 of whole texts; null and empty texts have the score of no feature at all."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        dense = np.zeros(SPACE, dtype=np.float32)
        dense[model.feature] = model.weight
        for column in columns:
            total = [np.zeros(0)]
            for _, _, w in words(column, LETTERS_DIGITS):
                values, at = features(w)
                run = np.concatenate([[0.0], np.cumsum(dense[values], dtype=np.float64)])
                total.append(run[at[1:]] - run[at[:-1]])
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(total) + model.bias, -35, 35))))

    return score(text)


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` (1 from ``threshold`` on), fitted on the labels of rows that are not held out.

    Only ``text`` is looked at.  A null id counts as not held out, and has no label.  Rows stay as they are, however often repeated;
    columns that bear the new names already are replaced.
    """
    learn = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    model = fit(docs.select("doc_id", "text"), learn)
    name = fresh(docs.columns, "_score")[0]
    found = docs.withColumn(name, toxicity(docs.sparkSession, model, F.col("text").cast("string")))
    return found.withColumns({"score": F.col(name), "predicted": (F.col(name) >= threshold).cast("int")}).drop(name)
