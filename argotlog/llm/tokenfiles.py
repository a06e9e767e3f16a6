"""Token ids of a corpus in wavelet-matrix files, one shard each, and questions answered from the files.

Texts are encoded once into a table of packed ids, dealt out by ranges of the document id, and each task writes its range as files of a bounded
number of tokens.  The files are written by Spark's own writer, so its commit protocol holds: a lost executor costs the
files that its running tasks had begun.  Places of a shard in the whole follow from the token counts of the shards before it.

Order: ascending document id, null first; rows of one id by the checksum of their ids, then by their place in the table.  A row of the table is in exactly one
shard, whole; a text without tokens, empty or null, is a document that holds the end id only.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from argotlog.llm.tables import _WRITING, _settings, drop, table
from argotlog.llm.wavelet import Shard, encode
from argotlog.llm.words import chunks, give_back
from argotlog.session import scratch_path

END = 1
# A shard is closed when it has so many tokens; one document is never cut.
SHARD_TOKENS = 1 << 22
# Tokens that a task of the sorted order is meant to take.
TASK_TOKENS = 1 << 24
# Words and pieces whose ids a worker remembers.
REMEMBERED = 600_000
# Fixed value: the pattern by which word tokenizers with word ends split lower-cased text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Encoder:
    """Ids of whole texts by those of their words.

    No merge, no normalisation and no pattern of the tokenizer reaches over an ASCII blank, so a text's ids are those of its blank-separated
    words, one after the other; each distinct word of a batch is encoded once.  A word of Latin letters, and marks behind them that are not part of
    an ending after an apostrophe, is two pieces whatever they are; for the letters, the normalisation and the pattern do no more than lower the case, so they
    go straight to the tokenizer's merges, in the characters that stand for their bytes.
    """

    _LETTERS = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-;=-@\[-`{-~]*)")

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(definition)
        self._merged = self._tokenizer.model.tokenize
        parts = json.loads(definition)
        pattern = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if parts["pre_tokenizer"]["type"] == "Sequence" else ""
        # The short way holds for this kind of tokenizer only; any other takes the long one for every word.
        self._short = pattern == WORD_PATTERN and [n["type"] for n in parts["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        # Characters of the bytes: themselves if they print in Latin-1, else from 256 on in order.
        prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self._byte = {b: (b if b in prints else 256 + i) for i, b in enumerate([*(b for b in range(256) if b not in prints), *prints])}
        self._known: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _piece(self, letters: str) -> bytes:
        mapped = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self._byte)
        found = self._pieces[letters] = array("I", [token.id for token in self._merged(mapped)]).tobytes()
        return found

    def _whole(self, words: list[str]) -> None:
        for word, found in zip(words, self._tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self._known[word] = array("I", found.ids).tobytes()

    def _words(self, distinct: list[str]) -> list[bytes]:
        if len(self._known) + len(self._pieces) > REMEMBERED:
            self._known, self._pieces = {}, {}
        known, pieces = self._known, self._pieces
        split = {w: self._LETTERS.fullmatch(w) if self._short else None for w in distinct if w not in known}
        self._whole(list({w if m is None else m[2] for w, m in split.items()} - known.keys()))
        for word, m in split.items():
            if m is not None:
                letters, marks = m.groups()
                letters = letters.lower()
                known[word] = (pieces.get(letters) or self._piece(letters)) + known[marks]
        return [known[w] for w in distinct]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text); null is the empty text."""
        pieces = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = pieces.offsets.to_numpy().astype(np.int64)
        words = pieces.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends -= ends[0]
        parts = self._words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        every = np.frombuffer(b"".join(parts), np.uint32)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        which = words.indices.to_numpy()
        n = size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(first[which] - upto[:-1], n) + np.arange(upto[-1])
        return every[at], upto[ends]


@lru_cache(maxsize=1)
def _encoder(definition: str) -> _Encoder:
    return _Encoder(definition)


def encoded(docs: DataFrame, definition: str, text: str = "text", key: str = "doc_id", end: int = END) -> DataFrame:
    """A table of (key, crc, row, n_tokens, ids): the ids of each text with the end id, 16 bits each where they fit, else 32."""
    sent = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(sent.value)
        row = TaskContext.get().partitionId() << 33
        gc.disable()  # nothing here refers to itself, and the many small objects would be looked through again and again
        for b in batches:
            column = b.column(1).cast(pa.large_string())
            for begin, stop, _, _ in chunks(column, 1 << 23):
                ids, at = coder.ids(column.slice(begin, stop - begin))
                packed, crc = [], []
                for i in range(stop - begin):
                    full = np.append(ids[at[i] : at[i + 1]], np.uint32(end)).astype("<u4")
                    crc.append(zlib.crc32(full))
                    packed.append((b"\x02" + full.astype("<u2").tobytes()) if not len(full) or full.max() < 65536 else (b"\x04" + full.tobytes()))
                n = np.diff(at) + 1
                yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, stop - begin), pa.array(crc, pa.int64()), pa.array(row + np.arange(stop - begin)), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["key", "crc", "row", "n_tokens", "ids"])
                row += stop - begin
        gc.enable()
        give_back()

    chosen = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    out = table(chosen.mapInArrow(run, "key bigint, crc bigint, row bigint, n_tokens bigint, ids binary"), "encoded", "zstd")
    sent.destroy()
    return out


def write_shards(rows: DataFrame, path: str, shard_tokens: int = SHARD_TOKENS, task_tokens: int = TASK_TOKENS) -> None:
    """Write the table of ``encoded`` as wavelet-matrix files below ``path``."""
    spark = rows.sparkSession
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    tasks = max(1, -(-total // task_tokens), min(spark.sparkContext.defaultParallelism, -(-total // shard_tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held, keys, null, used = [], [], [], 0

        def shard() -> pa.RecordBatch:
            n = np.array([len(x) for x in held], np.int64)
            data = encode(np.concatenate(held), np.cumsum(n), np.array(keys, np.int64), np.array(null, bool), part, seq)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.large_binary())], names=["content"])

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = ids.as_buffer()
                held.append(np.frombuffer(raw, "<u2" if raw[0:1].to_pybytes() == b"\x02" else "<u4", offset=1).astype(np.uint32))
                keys.append(key or 0)
                null.append(key is None)
                used += len(held[-1])
                if used >= shard_tokens:
                    yield shard()
                    held, keys, null, used, seq = [], [], [], 0, seq + 1
        if held:
            yield shard()
        give_back()

    order = [F.col("key").asc_nulls_first(), F.col("crc"), F.col("row")]
    ordered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("key", "ids")
    # A row of the text writer is the bytes of a string column and a line end, whatever the bytes are: one row a file makes binary files.
    files = ordered.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    with _settings(spark, {**_WRITING, "spark.sql.execution.arrow.useLargeVarTypes": "true"}):
        files.write.option("maxRecordsPerFile", 1).text(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files below ``path``."""
    return spark.read.format("binaryFile").load(path).where("length > 1").select("path", "content")


_CONTENTS = "part bigint, seq bigint, at bigint, key bigint, first bigint, n_tokens bigint, ids_crc32 bigint"


def contents(files: DataFrame) -> DataFrame:
    """One row per document, from the ids in its file: part, seq (its shard), at (number in it), key, first (place in the shard), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                s = Shard(data.as_buffer())
                ids = s.tokens().astype("<u4")
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(s.starts.tolist(), s.ends.tolist(), strict=True)]
                n = s.n_docs
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, s.part)), pa.array(np.full(n, s.seq)), pa.array(np.arange(n)), pa.array(s.keys, pa.int64(), mask=s.null), pa.array(s.starts), pa.array(s.ends - s.starts), pa.array(crc, pa.int64())],
                    names=["part", "seq", "at", "key", "first", "n_tokens", "ids_crc32"],
                )
                del s, ids
        give_back()

    return table(files.select("content").mapInArrow(run, _CONTENTS), "contents")


def shard_starts(found: DataFrame) -> DataFrame:
    """(part, seq, before): tokens of all shards before each shard; there is one row per shard, so one task can add them up."""
    sizes = found.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("part", "seq", F.coalesce(before, F.lit(0)).cast("bigint").alias("before"))


def occurrences(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, key, place in the document) of every occurrence of ``tokens``, found in the bit-planes without unpacking the shards."""
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                s = Shard(data.as_buffer())
                for token in wanted:
                    at = s.occurrences(token)
                    doc = np.searchsorted(s.ends, at, side="right")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token)), pa.array(s.keys[doc], pa.int64(), mask=s.null[doc]), pa.array(at - s.starts[doc])], names=["token", "key", "place"])

    return files.select("content").mapInArrow(run, "token bigint, key bigint, place bigint")


def token_counts(files: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of ``tokens`` occurs, by rank in the bit-planes."""
    wanted = sorted(set(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                s = Shard(data.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([s.count(t) for t in wanted], pa.int64())], names=["token", "n"])

    return files.select("content").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def token_files(docs: DataFrame, definition: str, path: str | None = None, text: str = "text", key: str = "doc_id", end: int = END, shard_tokens: int = SHARD_TOKENS) -> tuple[str, DataFrame]:
    """(folder of the files, documents as read back from them: ``key``, start, n_tokens, ids_crc32).

    ``start`` counts the ids of all documents before, ``n_tokens`` has the end id, ``ids_crc32`` is over all ids as little-endian 32-bit numbers.
    Null and empty texts hold the end id only; repeated rows and null ids are documents of their own; an empty table gives no file and no row.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    rows = encoded(docs, definition, text, key, end)
    write_shards(rows, path, shard_tokens)
    drop(rows)
    found = contents(shards(spark, path))
    out = found.join(shard_starts(found), ["part", "seq"]).select(F.col("key").alias(key), (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
    return path, out
