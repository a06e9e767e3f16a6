"""Latent Dirichlet allocation whose topic weights are a table, so that no machine has to hold the vocabulary.

Variational Bayes as in Hoffman, Blei, Bach: Online Learning for LDA, 2010.  The parameters are a table (term, weights); several models can be trained side
by side, their weights one after the other in each array.  Documents lie in blocks of bounded size.  A visit joins the distinct terms of every
block with the table, so a term travels once per block however often it occurs there; the rows of a block come to one task in order, one Arrow step fits its documents, and Spark
adds up what the blocks found for each term.  A task holds one block, whatever the number of blocks.  A hot term is one row per block, and a hot document is one row per slice with its count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import discard, give_back, materialize, small_batches

# Numbers in the weights of a block: its distinct terms times the topics of all models.
BLOCK_CELLS = 1 << 20
# Tokens in a block, where a term has weights for few topics.
BLOCK_TOKENS = 1 << 18
# Terms, and numbers in their weights, that a row of a block has: what a task collects in one list.
LIST_TERMS, LIST_CELLS = 1 << 10, 1 << 15
# Numbers in the arrays of the documents that are fitted together.
RUN_CELLS = 1 << 17
MAX_ROUNDS = 100
TOLERANCE = 1e-3
_TINY = 1e-100
_BODY = ("terms", "term", "n", "ends", "carried")
_BLOCK = "block bigint, slot int, terms array<string>, term binary, n binary, ends binary, carried array<{}>"


# ------------------------------------------------------------------------------------------------ special functions


def digamma(x: np.ndarray) -> np.ndarray:
    """Digamma of positive numbers: shifted to large arguments, then the asymptotic series."""
    x = np.array(x, dtype="float64")
    ones = 1 / x
    for _ in range(7):
        x += 1
        ones += 1 / x
    x += 1
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240))) - ones


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, dtype="float64")
    logs = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        logs += np.where(small, np.log(x), 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - logs


# ------------------------------------------------------------------------------------------------ blocks of documents


def _entries(tokens: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms in order, document * number of terms + term of each entry in order, its count) of the token lists of some documents."""
    found = tokens.flatten().dictionary_encode()
    order = pc.array_sort_indices(found.dictionary).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    doc = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    entry, n = np.unique(doc * max(len(order), 1) + number[found.indices.to_numpy(zero_copy_only=False)], return_counts=True)
    return found.dictionary.take(pa.array(order)), entry, n


def _packed(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows of (slot, tokens, carried) as blocks of one slot with about ``limit`` tokens, or one larger document; the terms of a document are counted here."""
    block, held, used = TaskContext.get().partitionId() << 33, [], 0

    def row() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        slot, tokens, carried = (c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in whole.columns)
        terms, entry, n = _entries(tokens)
        width = max(len(terms), 1)
        ends = np.cumsum(np.bincount(entry // width, minlength=len(tokens)), dtype=np.int64)

        def one(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        return pa.RecordBatch.from_arrays(
            [pa.array([block]), slot.slice(0, 1), one(terms), *(pa.array([x.tobytes()], pa.binary()) for x in ((entry % width).astype(np.int32), n.astype(np.float64), ends)), one(carried)],
            names=["block", "slot", "terms", "term", "n", "ends", "carried"],
        )

    last = None
    for b in batches:
        slots = b.column(0).to_numpy()
        ends = np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            if held and (slots[start] != last or used >= limit):
                yield row()
                block, held, used = block + 1, [], 0
                give_back()
            last = slots[start]
            before = int(ends[start - 1]) if start else 0
            same = start + int(np.argmax(np.append(slots[start:] != last, True)))
            stop = min(int(np.searchsorted(ends, before + limit - used)) + 1, same)
            held.append(b.slice(start, stop - start))
            used += int(ends[stop - 1]) - before
            start = stop
    if held:
        yield row()


def blocks_of(rows: DataFrame, width: int) -> DataFrame:
    """A table of blocks of the rows (slot, tokens, carried) of ``rows``; ``width`` is the number of topics that each term will have weights for."""
    limit = min(max(64, BLOCK_CELLS // width), BLOCK_TOKENS)
    kind = rows.schema["carried"].dataType.simpleString()
    return materialize(rows.select("slot", "tokens", "carried").mapInArrow(lambda batches: _packed(batches, limit), _BLOCK.format(kind)))


def with_tokens(rows: DataFrame) -> DataFrame:
    """The rows that have ``tokens``, without null ones among them."""
    return rows.withColumn("tokens", F.array_compact("tokens")).where(F.size("tokens") > 0)


def counted_terms(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, df, cf): distinct terms with document and collection frequency; each batch of documents is counted in one go, Spark adds the counts up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, entry, n = _entries(b.column(0))
            term = entry % max(len(terms), 1)
            every = np.bincount(term, n, len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.bincount(term, minlength=len(terms))), pa.array(every)], names=["term", "df", "cf"])

    parts = with_tokens(df.select(F.col(tokens).alias("tokens"))).mapInArrow(run, "term string, df bigint, cf bigint")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def slices(df: DataFrame, steps: int, width: int, seed: int, tokens: str = "tokens") -> DataFrame:
    """Blocks of all documents with tokens, dealt at random into ``steps`` slices; equal documents of a slice are one with a count."""
    slot = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(steps)).cast("int")
    bags = with_tokens(df.select(slot.alias("slot"), F.col(tokens).alias("tokens")))
    counted = bags.groupBy("slot", F.sort_array("tokens").alias("tokens")).agg(F.count(F.lit(1)).alias("carried"))
    return blocks_of(counted.sortWithinPartitions("slot"), width)


# ------------------------------------------------------------------------------------------------ models side by side


@dataclass(frozen=True)
class Layout:
    """Models side by side: number of topics, document prior and term prior of each."""

    topics: tuple[int, ...]
    alphas: tuple[tuple[float, ...], ...]
    etas: tuple[float, ...]

    @property
    def width(self) -> int:
        return sum(self.topics)

    @property
    def parts(self) -> list[slice]:
        ends = np.cumsum(self.topics).tolist()
        return [slice(end - k, end) for end, k in zip(ends, self.topics, strict=True)]

    @property
    def term_priors(self) -> np.ndarray:
        return np.repeat(self.etas, self.topics)


@dataclass(frozen=True)
class Weights:
    """Topic weights (term, weights), their sums over all terms, and the number of terms."""

    table: DataFrame
    totals: np.ndarray
    terms: int


def _numbers(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _measured(df: DataFrame, width: int, terms: int) -> Weights:
    """Write the weights and add them up on the way."""
    seen = Observation()
    sums = [F.sum(F.get("weights", F.lit(i))).alias(f"s{i}") for i in range(width)]
    table = materialize(df.observe(seen, *sums))
    found = seen.get
    return Weights(table, np.array([found[f"s{i}"] or 0.0 for i in range(width)]), terms)


def initial(terms: DataFrame, layout: Layout, seed: int) -> Weights:
    """Weights about 1, spread by a tenth: a function of term, topic and seed alone, whatever the layout of the data."""
    counted = terms.count()

    def uniform(i: Column, salt: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64("term", i, F.lit(seed), F.lit(salt)), 11).cast("double") + 1) / float(1 << 53)

    def weight(i: Column) -> Column:
        normal = F.sqrt(-2 * F.ln(uniform(i, 1))) * F.cos(2 * math.pi * uniform(i, 2))
        return F.greatest(F.lit(0.1), 1 + 0.1 * normal)

    topics = F.sequence(F.lit(0), F.lit(layout.width - 1))
    return _measured(terms.select("term", F.transform(topics, weight).alias("weights")), layout.width, counted)


# ------------------------------------------------------------------------------------------------ fitting documents


@dataclass
class _Documents:
    """Documents of one block, without the terms that no model knows: entries (document, term, count) in order."""

    doc: np.ndarray
    term: np.ndarray
    n: np.ndarray
    first: np.ndarray  # first entry of each document
    rows: np.ndarray  # their numbers in the block
    weights: np.ndarray  # of each known term
    known: np.ndarray  # place of each known term in the block's list


def _documents(term: np.ndarray, n: np.ndarray, ends: np.ndarray, at: np.ndarray, weights: np.ndarray, n_terms: int) -> _Documents:
    number = np.full(n_terms, -1)
    number[at] = np.arange(len(at))
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    keep = number[term] >= 0
    doc, term, n = doc[keep], number[term[keep]], n[keep]
    rows, first = np.unique(doc, return_index=True)
    return _Documents(np.searchsorted(rows, doc), term, n, first, rows, weights, at)


def fit(d: _Documents, beta: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Dirichlet parameters of the topics of each document, given exp(E[log p(term | topic)]) of the known terms.

    Every document goes on until it changes by less than the tolerance itself, so its result does not depend on its block.  Documents go in runs
    whose arrays stay in the processor's cache.
    """
    gamma = np.empty((len(d.first), len(alpha)))
    ends = np.append(d.first[1:], len(d.doc))
    start = 0
    while start < len(d.first):
        stop = max(start + 1, int(np.searchsorted(ends, d.first[start] + RUN_CELLS // len(alpha), side="right")))
        at = slice(int(d.first[start]), int(ends[stop - 1]))
        gamma[start:stop] = _fit(d.doc[at] - start, d.term[at], d.n[at], d.first[start:stop] - at.start, beta, alpha)
        start = stop
    return gamma


def _fit(doc: np.ndarray, term: np.ndarray, n: np.ndarray, first: np.ndarray, beta: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    gamma = alpha + np.add.reduceat(n, first)[:, None] / len(alpha)
    active, b = np.arange(len(first)), beta[term]
    for _ in range(MAX_ROUNDS):
        if not len(active):
            break
        g = gamma[active]
        theta = np.exp(digamma(g) - digamma(g.sum(axis=1))[:, None])
        norm = np.einsum("ij,ij->i", theta[doc], b) + _TINY
        new = alpha + theta * np.add.reduceat(b * (n / norm)[:, None], first, axis=0)
        gamma[active] = new
        going = np.abs(new - g).mean(axis=1) >= TOLERANCE
        if not going.all():
            keep = going[doc]
            number = np.cumsum(going) - 1
            doc, n, b = number[doc[keep]], n[keep], b[keep]
            active = active[going]
            first = np.searchsorted(doc, np.arange(len(active)))
    return gamma


def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, _Documents, pa.Array]]:
    """(what was carried, documents, terms) of each block in the rows of ``gathered``, held one at a time."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[pa.Array, _Documents, pa.Array]:
        terms, carried = (held[0].column(i).slice(0, 1).flatten() for i in (2, 6))
        term, n, ends = (np.frombuffer(held[0].column(i)[0].as_buffer(), t) for i, t in ((3, np.int32), (4, np.float64), (5, np.int64)))
        found = [x for x in (b.column(7).flatten() for b in held) if len(x)]
        at = np.concatenate([np.zeros(0, np.int64), *(x.field(0).to_numpy() for x in found)])
        weights = np.concatenate([np.zeros(0), *(x.field(1).flatten().to_numpy() for x in found)]).reshape(-1, width)
        order = np.argsort(at)
        return carried, _documents(term, n, ends, at[order], weights[order], len(terms)), terms

    for b in batches:
        blocks = b.column(0).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]]).tolist()
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != blocks[start]:
                yield whole()
                held.clear()
                give_back()
            held.append(b.slice(start, stop - start))
    if held:
        yield whole()


def _betas(d: _Documents, totals: np.ndarray, part: slice) -> np.ndarray:
    return np.exp(digamma(d.weights[:, part]) - digamma(totals[part]))


def gathered(blocks: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """(block, part, documents, found): for each block its documents, in part -1, then lists of bounded size with the place and weights of each of its terms that the table has.

    The rows of a block are in one partition, in order.  Its documents travel in a row of their own under a name that no other block has: under a term, those of
    all blocks that share it would meet in one task.
    """
    name, size = F.concat(F.lit("\0"), F.col("block").cast("string")), max(1, min(LIST_TERMS, LIST_CELLS // width))
    asked = blocks.select("block", F.struct(*_BODY).alias("documents"), F.posexplode(F.concat(F.array(name), "terms")).alias("place", "name"))
    at = F.col("place") - 1
    asked = asked.select("block", at.alias("at"), "name", F.when(at < 0, F.col("documents")).alias("documents"))
    rows = asked.join(table.select(F.col("term").alias("name"), "weights"), "name", "left").where("at < 0 OR weights IS NOT NULL").repartition("block")
    found = F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "weights"))).alias("found")
    # A list of one: other aggregates would copy what they hold for every term.
    lists = rows.groupBy("block", F.floor(F.col("at") / size).alias("part")).agg(F.collect_list("documents").alias("held"), found)
    body = F.get("held", F.lit(0)).alias("b")
    return lists.select("block", "part", body, "found").select("block", "part", *(f"b.{c}" for c in _BODY), "found").sortWithinPartitions("block", "part")


def statistics(blocks: DataFrame, weights: Weights, layout: Layout, factor: float = 1.0) -> DataFrame:
    """(term, stat): ``factor`` times the expected counts of each term by topic, one row per block and term; rows of the null term have the documents'
    part of the bound of each model at its first topic."""
    totals, parts, alphas, width = weights.totals, layout.parts, layout.alphas, layout.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for carried, d, terms in _each(batches, width):
            if not len(d.rows):
                continue
            times = carried.to_numpy().astype(np.float64)[d.rows]
            stat, bound = np.zeros((len(d.known) + 1, width)), np.zeros(len(parts))
            for m, (part, alpha) in enumerate(zip(parts, alphas, strict=True)):
                alpha = np.array(alpha)
                beta = _betas(d, totals, part)
                gamma = fit(d, beta, alpha)
                log_theta = digamma(gamma) - digamma(gamma.sum(axis=1))[:, None]
                theta = np.exp(log_theta)[d.doc]
                b = beta[d.term]
                norm = (theta * b).sum(axis=1) + _TINY
                share = theta * b * (factor * d.n * times[d.doc] / norm)[:, None]
                for j in range(len(alpha)):
                    stat[:-1, part.start + j] = np.bincount(d.term, share[:, j], len(d.known))
                likelihood = np.bincount(d.doc, d.n * np.log(norm), len(d.rows))
                distance = ((alpha - gamma) * log_theta + log_gamma(gamma)).sum(axis=1) - log_gamma(gamma.sum(axis=1))
                bound[m] = (times * (likelihood + distance + log_gamma(alpha.sum()) - log_gamma(alpha).sum())).sum()
            stat[-1, [p.start for p in parts]] = bound
            names = pa.concat_arrays([terms.take(pa.array(d.known)), pa.nulls(1, terms.type)])
            offsets = pa.array(np.arange(0, stat.size + 1, width), pa.int32())
            yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(offsets, pa.array(stat.ravel()))], names=["term", "stat"])

    return gathered(blocks, weights.table, width).mapInArrow(run, "term string, stat array<double>")


def _document_bounds(stats: DataFrame, layout: Layout) -> np.ndarray:
    sums = stats.where("term IS NULL").agg(*(F.sum(F.get("stat", F.lit(p.start))) for p in layout.parts)).first()
    return np.array([s or 0.0 for s in sums])


def updated(weights: Weights, stats: DataFrame, layout: Layout, rate: float) -> Weights:
    """Move the weights by ``rate`` towards term prior plus statistics, which are multiplied by ``rate`` already; unseen terms move as well.

    The new weight is a sum of what the table has and what the blocks found, so one grouping of both takes the place of a join.
    """
    prior, width = _numbers(layout.term_priors), layout.width
    old = weights.table.select("term", F.transform("weights", lambda w, i: w * (1 - rate) + rate * F.get(prior, i)).alias("v"))
    parts = old.unionByName(stats.where("term IS NOT NULL").select("term", F.col("stat").alias("v")))
    sums = parts.groupBy("term").agg(*(F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width)))
    return _measured(sums.select("term", F.array(*(F.col(f"v{i}") for i in range(width))).alias("weights")), width, weights.terms)


def topic_bounds(weights: Weights, layout: Layout) -> np.ndarray:
    """The topics' part of the bound of each model, summed over the table."""
    totals, width, prior = weights.totals, layout.width, layout.term_priors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            w = b.column(0).flatten().to_numpy().reshape(-1, width)
            total += ((prior - w) * (digamma(w) - digamma(totals)) + log_gamma(w) - log_gamma(prior)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(total)], names=["i", "v"])

    found = dict(weights.table.select("weights").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v")).collect())
    by_topic = np.array([found.get(i, 0.0) for i in range(width)]) - log_gamma(totals) + log_gamma(prior * weights.terms)
    return np.array([by_topic[p].sum() for p in layout.parts])


# ------------------------------------------------------------------------------------------------ training


def online(blocks: DataFrame, start: Weights, layout: Layout, passes: int, steps: int) -> Weights:
    """``passes`` times over all slices, one step each, with the step size (1 + step) ** -0.5."""
    sizes = dict(blocks.groupBy("slot").agg(F.sum(F.aggregate("carried", F.lit(0).cast("bigint"), lambda a, x: a + x))).collect())
    total, weights = sum(sizes.values()), start
    for step in range(passes * steps):
        slot = step % steps
        if slot not in sizes:
            continue
        rate = (1 + step) ** -0.5
        found = statistics(blocks.where(F.col("slot") == slot), weights, layout, rate * total / sizes[slot])
        moved = updated(weights, found, layout, rate)
        discard(weights.table)
        weights = moved
    return weights


def full_batch(blocks: DataFrame, start: Weights, layout: Layout, max_iter: int, tolerance: float) -> Weights:
    """All documents in every step, until the bound of each model grows by less than ``tolerance`` of its size."""
    weights, before = start, None
    for _ in range(max_iter):
        found = materialize(statistics(blocks, weights, layout))
        bound = topic_bounds(weights, layout) + _document_bounds(found, layout)
        if before is not None and np.all(np.abs(bound - before) <= tolerance * np.abs(before)):
            discard(found)
            break
        before = bound
        moved = updated(weights, found, layout, 1.0)
        discard(found, weights.table)
        weights = moved
    return weights


def bounds(blocks: DataFrame, weights: Weights, layout: Layout) -> np.ndarray:
    """The variational bound of all documents under each model."""
    with small_batches(blocks.sparkSession):
        return _document_bounds(statistics(blocks, weights, layout), layout) + topic_bounds(weights, layout)


def distributions(blocks: DataFrame, weights: Weights, layout: Layout, kind: str) -> DataFrame:
    """(carried, theta) for the documents with a known term: what was carried, and the expected shares of the topics of the first model."""
    totals, part, alpha, width = weights.totals, layout.parts[0], np.array(layout.alphas[0]), layout.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for carried, d, _ in _each(batches, width):
            gamma = fit(d, _betas(d, totals, part), alpha)
            theta = gamma / gamma.sum(axis=1, keepdims=True)
            offsets = pa.array(np.arange(0, theta.size + 1, len(alpha)), pa.int32())
            yield pa.RecordBatch.from_arrays([carried.take(pa.array(d.rows)), pa.ListArray.from_arrays(offsets, pa.array(theta.ravel()))], names=["carried", "theta"])

    return gathered(blocks, weights.table, width).mapInArrow(run, f"carried {kind}, theta array<double>")


def top_terms(weights: Weights, width: int, n: int) -> DataFrame:
    """(column, rank, term, weight): the ``n`` heaviest terms of each column, ties by term, weights as shares of the column.

    A task keeps ``n`` terms a column; what is ranked by Spark is as small as that.
    """
    totals = weights.totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, best = np.zeros(0, object), np.zeros((0, width))
        for b in batches:
            w = b.column(1).flatten().to_numpy().reshape(-1, width)
            every, all_w = np.concatenate([terms, np.array(b.column(0).to_pylist(), object)]), np.concatenate([best, w])
            # Strings compare by code point here as they do by UTF-8 bytes in Spark.
            order = np.argsort(every, kind="stable")
            every, all_w = every[order], all_w[order]
            keep = np.unique(np.argsort(-all_w, axis=0, kind="stable")[:n])
            terms, best = every[keep], all_w[keep]
        chosen = np.argsort(-best, axis=0, kind="stable")[:n]
        column = np.broadcast_to(np.arange(width), chosen.shape).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, pa.int32()), pa.array(terms[chosen.ravel()], pa.string()), pa.array((best[chosen.ravel(), column] / totals[column]))], names=["column", "term", "weight"]
        )

    found = weights.table.select("term", "weights").mapInArrow(run, "column int, term string, weight double")
    order = Window.partitionBy("column").orderBy(F.desc("weight"), "term")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("column", "rank", "term", "weight")
