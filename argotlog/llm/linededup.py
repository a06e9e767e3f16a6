"""Line dedup: multi-line chunks that occur again anywhere are removed, wherever lines were put in or taken out around them.

Boundaries are defined by content.  Each line has a hash, a rolling hash covers a line and the one before it, and a chunk ends where
that is less than its neighbours on both sides.  So a boundary depends on four lines only: the chunks inside a passage are the same in
every text that has the passage, and each chunk has two lines at least.  Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argotlog.llm.tables import drop, fresh, keyed, table


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it within a loop."""
    return F.transform(F.array(value), body)[0]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunks_of(lines: Column) -> Column:
    """Array of (first: number of the chunk's first line from 0, n: its lines) of an array of lines; one chunk covers a short text."""

    def ends(rolling: Column) -> Column:
        # A chunk ends after line i; neither the first nor the last chunk is left with a single line.
        inner = F.when(F.size(rolling) >= 4, F.sequence(F.lit(1), F.size(rolling) - 3)).otherwise(F.array().cast("array<int>"))
        return F.filter(inner, lambda i: (F.get(rolling, i) < F.get(rolling, i - 1)) & (F.get(rolling, i) <= F.get(rolling, i + 1)))

    def cut(hashes: Column) -> Column:
        rolling = F.transform(hashes, lambda x, i: F.md5(F.concat(F.coalesce(F.get(hashes, i - 1), F.lit("")), x)))
        return _let(rolling, lambda r: F.concat(F.array(F.lit(-1)), ends(r), F.array(F.size(r) - 1)))

    hashes = F.transform(lines, lambda x: F.md5(x))

    def pieces(at: Column) -> Column:
        return F.transform(F.slice(at, 2, F.size(at)), lambda end, i: F.struct((F.get(at, i) + 1).alias("first"), (end - F.get(at, i)).alias("n")))

    return _let(_let(hashes, cut), pieces)


def _text(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["first"] + 1, chunk["n"]), "\n")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` less its repeated chunks, ``n_lines`` (before) and ``n_removed`` lines.

    Of the occurrences of a chunk, the first by (``key``, nulls first; row; place) stays; the others go if their bytes are those of the first.  Chunks have
    two lines or more with a character that is no blank among them; a text of one line has none.  Null texts stay null with no lines; the
    empty text has one line.  A text may become empty.  A boundary depends on four lines, so of a repeated passage of six lines or more some chunk is sure to
    be met, whatever is around it; of two to five repeated lines only where boundaries happen to fall beside them.  Repeated rows are occurrences like others.  Columns that bear the new names
    already are replaced.
    """
    row, lines, chunks, gone = fresh(docs.columns, "row", "lines", "chunks", "gone")
    base = keyed(docs, row)
    cut = base.select(F.col(row).alias("row"), F.col(f"`{key}`").alias("key"), lines_of(F.col(f"`{text}`").cast("string")).alias("lines")).where(F.size("lines") >= 2)
    every = cut.select("row", "key", "lines", F.explode(chunks_of(F.col("lines"))).alias("c")).select("row", "key", F.col("c.first").alias("first"), _text(F.col("lines"), F.col("c")).alias("chunk"))
    named = every.select("row", "key", "first", "chunk", F.md5("chunk").alias("hash")).where(F.col("chunk").rlike("\\S"))

    place = F.struct("key", "row", "first").alias("place")
    often = table(named.select("hash", place).groupBy("hash").agg(F.min("place").alias("kept"), F.count("*").alias("times")).where("times > 1").select("hash", "kept"), "often")
    again = table(named.join(often, "hash").select("row", "first", "chunk", "hash", ((F.col("row") == F.col("kept.row")) & (F.col("first") == F.col("kept.first"))).alias("is_first")), "again", "zstd")
    model = again.where("is_first").select("hash", F.col("chunk").alias("bytes"))
    removed = again.where("not is_first").join(model, "hash").where(F.col("chunk") == F.col("bytes"))
    by_row = table(removed.groupBy("row").agg(F.collect_set("first").alias("gone")), "gone")
    drop(often, again)

    joined = base.join(by_row.select(F.col("row").alias(row), F.col("gone").alias(gone)), row, "left")
    whole = joined.withColumn(lines, lines_of(F.col(f"`{text}`").cast("string")))
    some = F.filter(F.when(F.col(gone).isNotNull(), chunks_of(F.col(lines))), lambda c: ~F.array_contains(gone, c["first"]))
    rest = whole.withColumn(chunks, some)
    left = F.array_join(F.flatten(F.transform(chunks, lambda c: F.slice(F.col(lines), c["first"] + 1, c["n"]))), "\n")
    size = F.when(F.col(f"`{text}`").isNull(), F.lit(0)).otherwise(F.size(lines))
    n_left = F.aggregate(F.col(chunks), F.lit(0), lambda a, c: a + c["n"])
    out = rest.select(
        *(F.when(F.col(gone).isNull(), F.col(f"`{c}`")).otherwise(left).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")),
        size.cast("bigint").alias("n_lines"),
        F.when(F.col(gone).isNull(), F.lit(0)).otherwise(size - n_left).cast("bigint").alias("n_removed"),
    )
    return out
