"""Blocks of texts ask for the corpus counts of hashes, and get them back in the order they asked.

A block sends each of its distinct hashes once, with its own count, to the partition of the hash's range.  There the counts add up and every
row is answered.  So a hash that is everywhere is one row per block, and both sides of the exchange are spread evenly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from argotlog.llm.words import give_back

ASKED = "partition int, kind int, block bigint, hashes binary, n binary"
ANSWER = "block bigint, kind int, partition int, counts binary"
NAMED = "partition int, block bigint, hashes binary, rows binary, several binary"
FIRST = "block bigint, partition int, rows binary"
# About how many (hash, block) rows a partition of the count table takes.
PARTITION_ROWS = 2_000_000


def partitions_for(rows: int) -> int:
    return max(1, -(-rows // PARTITION_ROWS))


def _ranges(hashes: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the hash ranges in ascending ``hashes``, the ranges that have any)."""
    width = 2**64 // partitions + 1
    limits = np.array([i * width for i in range(1, partitions)], dtype=np.uint64)
    at = np.concatenate([[0], np.searchsorted(hashes, limits), [len(hashes)]])
    return at, np.flatnonzero(np.diff(at))


def ask(block: int, kind: int, hashes: np.ndarray, n: np.ndarray, partitions: int) -> pa.RecordBatch:
    """Rows of one block for its distinct ascending ``hashes``, cut by hash range."""
    at, used = _ranges(hashes, partitions)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int32()),
            pa.array(np.full(len(used), kind), pa.int32()),
            pa.array(np.full(len(used), block), pa.int64()),
            pa.array([hashes[at[i] : at[i + 1]].tobytes() for i in used], pa.binary()),
            pa.array([n[at[i] : at[i + 1]].astype(np.uint32).tobytes() for i in used], pa.binary()),
        ],
        names=["partition", "kind", "block", "hashes", "n"],
    )


def name(block: int, hashes: np.ndarray, rows: np.ndarray, several: np.ndarray, partitions: int) -> pa.RecordBatch:
    """As ``ask``, with the least row of the block that has each hash, and whether ``several`` have it."""
    at, used = _ranges(hashes, partitions)
    parts = ([x[at[i] : at[i + 1]].tobytes() for i in used] for x in (hashes, rows.astype(np.int64), several.astype(np.uint8)))
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(np.full(len(used), block), pa.int64()), *(pa.array(x, pa.binary()) for x in parts)],
        names=["partition", "block", "hashes", "rows", "several"],
    )


def _pack(counts: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 or more follow in full."""
    large = counts >= 255
    return np.int64(len(counts)).tobytes() + np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.int64).tobytes()


def _unpack(packed: pa.Buffer) -> np.ndarray:
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    counts = np.frombuffer(packed, np.uint8, n, 8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(packed.slice(8 + n).to_pybytes(), np.int64)
    return counts


def answered(asked: DataFrame, least: dict[int, int]) -> DataFrame:
    """Corpus counts of all that was asked; 0 where a count is below ``least`` of its kind."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["hashes"]]
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in rows["n"]])
        every = np.concatenate(hashes)
        order = np.argsort(every)
        every, n = every[order], n[order]
        del order
        edges = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        known, count = every[edges], np.add.reduceat(n, edges, dtype=np.int64)
        del every, n, edges
        out = []
        for asked_for, kind in zip(hashes, rows["kind"].to_pylist(), strict=True):
            c = count[np.searchsorted(known, asked_for)]
            out.append(_pack(np.where(c >= least.get(kind, 1), c, 0)))
        del hashes, known, count
        give_back()
        return pa.table({"block": rows["block"], "kind": rows["kind"], "partition": rows["partition"], "counts": pa.array(out, pa.binary())})

    return asked.groupBy("partition").applyInArrow(run, ANSWER)


def counts_by_kind(answers: pa.Scalar) -> dict[int, np.ndarray]:
    """The answers of one block, collected as (kind, partition, counts), in the order asked."""
    parts: dict[int, list[tuple[int, np.ndarray]]] = {}
    for answer in answers.values or []:
        parts.setdefault(answer["kind"].as_py(), []).append((answer["partition"].as_py(), _unpack(answer["counts"].as_buffer())))
    return {kind: np.concatenate([c for _, c in sorted(got, key=lambda x: x[0])]) for kind, got in parts.items()}


def firsts(named: DataFrame) -> DataFrame:
    """The least row of the corpus that has each hash; -1 where only one row has it."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["hashes"]]
        first = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows["rows"]])
        several = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in rows["several"]])
        every = np.concatenate(hashes)
        order = np.argsort(every)
        every, first, several = every[order], first[order], several[order]
        del order
        edges = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        shared = (np.maximum.reduceat(several, edges) > 0) | (np.diff(np.append(edges, len(every))) > 1)
        least = np.where(shared, np.minimum.reduceat(first, edges), -1)
        known = every[edges]
        del every, first, several, edges, shared
        out = [least[np.searchsorted(known, asked_for)].tobytes() for asked_for in hashes]
        del hashes, known, least
        give_back()
        return pa.table({"block": rows["block"], "partition": rows["partition"], "rows": pa.array(out, pa.binary())})

    return named.groupBy("partition").applyInArrow(run, FIRST)


def firsts_in_order(answers: pa.Scalar) -> np.ndarray:
    """The answers of one block, collected as (partition, rows), in the order named."""
    parts = sorted(((x["partition"].as_py(), x["rows"].as_buffer()) for x in answers.values), key=lambda x: x[0])
    return np.concatenate([np.frombuffer(rows, np.int64) for _, rows in parts])
