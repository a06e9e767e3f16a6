"""N-gram Jaccard join: which texts have nearly the same set of word shingles, and which are connected by such links.

The join is exact.  It uses set relations to leave out work:

* Equal sets are one class; only one set of each class takes part.
* Shingles are ordered from rare to common, so the inverted index needs a short prefix of each set only, and a passage that very
  many texts share is at the end of their sets and in no prefix.  The order is a matter of speed alone.
* Index lists are cut into blocks by set size; a set meets only the blocks whose sizes and positions still allow a link.
* The first set of a list is its pivot: all others are compared with it first.  From those answers the answers of the others
  follow in most cases: linked with the same pivot means the same component, and since Jaccard distance is a metric, distances to
  the pivot that differ by more than the threshold exclude a link.  Only the pairs left over are compared, shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argotlog.llm.graph import components
from argotlog.llm.tables import drop, fresh, table
from argotlog.llm.words import NOT_SPACE, U64, mix, shingles_by_text, sorted_sets, words

# At most so many shingles, the most common ones, have a place of their own in the order; it is a bound on what is broadcast.
ORDERED_SHINGLES = 1 << 18
# Rounds in which each list that still holds several components gets a new pivot, before pairs are compared.
HUB_ROUNDS = 2
# A task looks for common shingles in so many bytes of sets at a time.
GATHERED_BYTES = 1 << 24


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after, set elements, offsets, fingerprint of each set) for runs of texts."""
    for row, stop, w in words(column, NOT_SPACE):
        values, at = sorted_sets(*shingles_by_text(w, k))
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(mix(values ^ U64(0x5851F42D4C957F2D)), out=total[1:])
        yield row, stop, values, at, mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _members(docs: DataFrame, k: int, carry: list[str]) -> DataFrame:
    """One row per text: ``carry``, size, fingerprint, sketch; and for each task the shingles that some of its sets share."""
    fields = docs.select(*carry).schema
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema = f"{head}, n bigint, s1 bigint, sketch binary, shingle bigint, sets bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes = [], 0

        def common() -> pa.RecordBatch:
            values = np.concatenate(held)
            values.sort()
            edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
            counts = np.diff(edges)
            often = counts >= 3
            shared, n = values[edges[:-1][often]], counts[often]
            none = [pa.nulls(len(n), t) for t in types]
            return pa.RecordBatch.from_arrays([*none, *(pa.nulls(len(n), t) for t in (pa.int64(), pa.int64(), pa.binary())), _signed(shared), pa.array(n)], names=names)

        types, names = [], [*carry, "n", "s1", "sketch", "shingle", "sets"]
        for b in batches:
            column = b.column(b.num_columns - 1)
            types = [b.column(i).type for i in range(len(carry))]
            seen: set[int] = set()
            for row, stop, values, at, s1 in _sets(column, k):
                part = b.slice(row, stop - row)
                nulls = pa.nulls(stop - row, pa.int64())
                sketch = pa.array([_sketch(values[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(carry))), pa.array(np.diff(at)), _signed(s1), sketch, nulls, nulls], names=names)
                for i, s in enumerate(s1.tolist()):
                    if s not in seen:
                        seen.add(s)
                        held.append(values[at[i] : at[i + 1]])
                        held_bytes += held[-1].nbytes
            if held_bytes > GATHERED_BYTES:
                yield common()
                held, held_bytes = [], 0
        if held:
            yield common()

    return docs.select(*carry, "text").mapInArrow(run, schema)


def _order(shared: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, ascending, and how many sets have them: the bound is met by a power of two, not by a sort."""
    counts = table(shared.groupBy("shingle").agg(F.sum("sets").alias("sets")), "shingles")
    level = F.floor(F.log2("sets")).cast("int")
    left, least = ORDERED_SHINGLES, 63
    for row in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if row["count"] > left:
            break
        left, least = left - row["count"], row["level"]
    got = counts.where(level >= least).toPandas()
    drop(counts)
    values, n = got["shingle"].to_numpy(np.int64).view(np.uint64), got["sets"].to_numpy(np.int64)
    by = np.argsort(values)
    return values[by], n[by]


def _prefixes(docs: DataFrame, k: int, percent: int, common) -> DataFrame:
    """(shingle, set, size of the set, position in it) of the prefixes that any link must show in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, often = common.value
        seen: set[int] = set()
        for b in batches:
            for _, _, values, at, s1 in _sets(b.column(0), k):
                out = []
                place = np.searchsorted(shared, values).clip(max=max(len(shared) - 1, 0))
                weight = np.where(shared[place] == values, often[place], 0) if len(shared) else np.zeros(len(values), np.int64)
                for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    n, s = hi - lo, int(s1[i])
                    if n < 2 or s in seen:  # a set of one element can only be linked with its equal
                        continue
                    seen.add(s)
                    length = n - -(-percent * n // 100) + 1
                    own = weight[lo:hi]
                    first = lo + (np.argsort(own, kind="stable")[:length] if own.any() else np.arange(length))
                    out.append((first, np.full(length, s1[i]), n))
                if out:
                    lengths = np.array([len(o[0]) for o in out])
                    position = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    yield pa.RecordBatch.from_arrays(
                        [
                            _signed(values[np.concatenate([o[0] for o in out])]),
                            _signed(np.concatenate([o[1] for o in out])),
                            pa.array(np.repeat([o[2] for o in out], lengths), type=pa.int32()),
                            pa.array(position, type=pa.int32()),
                        ],
                        names=["shingle", "id", "size", "at"],
                    )

    return docs.select("text").mapInArrow(run, "shingle bigint, id bigint, size int, at int")


def _sets_of(docs: DataFrame, k: int, ids: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(id, set) of the wanted sets only: their texts are fetched by document, then cut into shingles again."""
    wanted = members.join(ids, F.col("s1") == F.col("id")).groupBy("id").agg(F.min(key).alias("key"))
    some = docs.select(F.col(key).alias("its"), "text").join(wanted, F.col("its").eqNullSafe(F.col("key")))
    # repeated rows of one document once; rows of other texts under the same key fall out below
    some = some.dropDuplicates(["key", "id", "text"]).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(0).to_numpy()
            for row, stop, values, at, s1 in _sets(b.column(1), k):
                right = np.flatnonzero(s1.view(np.int64) == asked[row:stop])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked[row:stop][right]), pa.array([values[at[i] : at[i + 1]].tobytes() for i in right], type=pa.binary())], names=["id", "elements"]
                )

    return table(some.mapInArrow(run, "id bigint, elements binary"), "sets")


def _sketch(values: np.ndarray) -> bytes:
    """How many elements fall into each of 128 bins (255 at most): sets differ at least by the sum of the bins' differences."""
    return np.minimum(np.bincount((values >> U64(57)).astype(np.int64), minlength=128), 255).astype(np.uint8).tobytes()


def _near(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches leave possible; no linked pair is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(4).to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, 128).astype(np.int16) for i in (3, 5))
            apart = np.maximum(np.abs(x - y).sum(axis=1, dtype=np.int64), np.abs(na - nb))
            # elements in common: (na + nb - difference) / 2
            common = (na + nb - apart) // 2
            yield b.select([0, 1]).filter(pa.array(100 * common >= percent * (na + nb - common)))

    slim = members.groupBy("s1").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    left, right = (slim.select(F.col("s1").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, members: DataFrame, key: str, percent: int) -> DataFrame:
    """(a, b, elements in common, elements in either, linked) of the pairs that are near; the others are not linked."""
    near = table(_near(pairs, members, percent), "near")
    sets = _sets_of(docs, k, near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), members, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common, union = [], []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                place = np.searchsorted(y, x).clip(max=len(y) - 1)
                common.append(int(np.count_nonzero(y[place] == x)))
                union.append(len(x) + len(y) - common[-1])
            linked = [100 * c >= percent * u for c, u in zip(common, union, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "common", "both", "linked"])

    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("eb"))
    found = near.join(right, "b").join(left, "a").select("a", "b", "ea", "eb").mapInArrow(run, "a bigint, b bigint, common bigint, both bigint, linked boolean")
    out = table(found, "verified")
    drop(near, sets)
    return out


def _possible(percent: int, size_a: Column, at_a: Column, size_b: Column, at_b: Column) -> Column:
    """May two sets be linked whose first common element is at these positions?  Integers only."""
    size_a, size_b = size_a.cast("long"), size_b.cast("long")
    most = F.least(size_a - at_a, size_b - at_b)
    return ((100 + percent) * most >= percent * (size_a + size_b)) & (100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b))


def _open(entries: DataFrame, reached: DataFrame) -> DataFrame:
    """The index lists that still hold several components; each set with its component."""
    marked = entries.join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = marked.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return table(marked.join(mixed.select("shingle"), "shingle"), "open")


def _hubs(entries: DataFrame, reached: DataFrame, stars: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """A new pivot for each list that is left, the set nearest to all pivots so far, and the pairs with it that are not answered."""
    still = _open(entries.select("shingle", "id", "size", "at", "pivot"), reached)
    centre = stars.groupBy(F.col("b").alias("id")).agg(F.sum(F.col("common") / F.col("both")).alias("weight"))
    ranked = still.where("id <> pivot").join(centre, "id", "left")
    best = F.struct(F.coalesce("weight", F.lit(0.0)).alias("weight"), "id", "size", "at", "component")
    hub = ranked.groupBy("shingle").agg(F.max(best).alias("hub"))
    chosen = table(still.join(hub, "shingle").withColumn("pivot", F.col("hub.id")), "hubs")
    h = F.col("hub")
    asked = chosen.where((h["component"] != F.col("component")) & _possible(percent, h["size"], h["at"], F.col("size"), F.col("at")))
    drop(still)
    return chosen, asked.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()


def _rest(left_over: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components in one list that neither sizes, positions nor distances to the list's pivot exclude."""
    known = stars.select(F.col("a").alias("pivot"), F.col("b").alias("id"), (1 - F.col("common") / F.col("both")).alias("distance")).distinct()
    block = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent))).cast("int").alias("block")
    sets = left_over.join(known, ["pivot", "id"], "left").where("pivot <> id").select("shingle", "id", "size", "at", "component", "distance", block)
    near = F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block")
    x = sets.select("shingle", *(F.col(c).alias(f"{c}_x") for c in ("id", "size", "at", "component", "distance")), near)
    apart = F.coalesce(F.abs(F.col("distance_x") - F.col("distance")) > 1 - percent / 100 + 1e-9, F.lit(False))
    return (
        x.join(sets, ["shingle", "block"])
        .where((F.col("id_x") < F.col("id")) & (F.col("component_x") != F.col("component")) & ~apart)
        .where(_possible(percent, F.col("size_x"), F.col("at_x"), F.col("size"), F.col("at")))
        .select(F.col("id_x").alias("a"), F.col("id").alias("b"))
        .distinct()
    )


def linked_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 4, percent: int = 85, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``carry``, ``n_shingles``, ``component_id``.

    A text's set holds its distinct runs of ``k`` words (A-Z lower-cased, parted by ASCII white space); a shorter text is one run.
    Two texts are linked if ``100 * intersection >= percent * union``.  ``component_id`` is the smallest ``key`` that links reach.
    Null, empty and blank texts have no shingles and no links; they keep their own key.  Repeated rows are in one component, null
    keys take part, and are a ``component_id`` only where no row of the component has a key.  Other columns are not looked at.
    """
    columns = [key, *(c for c in carry if c != key)]
    names = fresh([], *(f"c{i}" for i in range(len(columns))))
    source = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)), F.col(f"`{text}`").cast("string").alias("text"))
    both = table(_members(source, k, names), "members")
    members = both.where("n is not null").drop("shingle", "sets")
    common = docs.sparkSession.sparkContext.broadcast(_order(both.where("sets is not null").select("shingle", "sets")))

    prefixes = table(_prefixes(source, k, percent, common), "prefixes")
    common.destroy()
    lists = prefixes.groupBy("shingle").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last")
    entries = table(prefixes.join(lists.select("shingle", "pivot"), "shingle"), "entries")
    drop(prefixes)

    def verified(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, source, k, members, names[0], percent)

    done = [verified(entries.where("pivot <> id").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())]
    stars = done[0]
    links = stars.where("linked").select("a", "b")
    reached = table(components(links), "reached")
    left_over = entries
    for _ in range(HUB_ROUNDS):
        chosen, pairs = _hubs(left_over, reached, stars, percent)
        done.append(verified(pairs))
        drop(left_over, reached)
        left_over, stars = chosen, stars.unionByName(done[-1])
        links = stars.where("linked").select("a", "b")
        reached = table(components(links), "reached")
    rest = _open(left_over.drop("hub", "component"), reached)
    done.append(verified(_rest(rest, stars, percent)))
    drop(left_over, rest, reached)
    reached = table(components(links.unionByName(done[-1].where("linked").select("a", "b"))), "reached")
    drop(*done)

    labelled = members.join(reached.withColumnRenamed("id", "s1"), "s1", "left").withColumn("component", F.coalesce("component", "s1"))
    least = labelled.where("n > 0").groupBy("component").agg(F.min(names[0]).alias("component_id"))
    found = labelled.join(least, "component", "left")
    own = F.when(F.col("n") == 0, F.col(names[0])).otherwise(F.col("component_id"))
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)), F.col("n").alias("n_shingles"), own.alias("component_id"))
