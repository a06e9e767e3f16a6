"""Token counts that follow edits.

A document keeps the lengths and token counts of its pre-tokens, and a segment tree of their sums.  An edit finds its place by going down the
tree, cuts only the touched text anew, and adds the difference up along the paths to the root.  A pre-token depends on its own characters and
at most two after it, and on nothing before it.  So cutting begins at the first pre-token that ends less than two characters before the edit, and
stops at the first old boundary behind it: all else stays as it was.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argotlog.llm.tables import fresh, table
from argotlog.llm.words import give_back

# Pre-tokens of a leaf, and how much a leaf may grow before the tree is laid out anew.
LEAF = 32
GROWTH = 8
# Distinct pre-tokens whose counts a task remembers.
REMEMBERED = 200_000
# Each character counts; lengths are in code points.
STATE = "tokens bigint, length binary, count binary, tree binary, leaves binary"


class Counter:
    """Cuts text into pre-tokens and counts the tokens of each, by a vocabulary of ranks."""

    def __init__(self, ranks: str, pattern: str):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for part in parts:
            n = known.get(part)
            if n is None:
                n = known[part] = len(self.encoding.encode_ordinary(part))
            out.append(n)
        return out


class Counted:
    """The pre-tokens of one text, with a segment tree over leaves of them; the tree holds (characters, tokens)."""

    def __init__(self, length: np.ndarray, count: np.ndarray, tree: np.ndarray | None = None, leaves: np.ndarray | None = None):
        self.length, self.count = length, count
        if tree is None:
            self._plant()
        else:
            self.tree, self.leaves = tree, leaves

    def _plant(self) -> None:
        """Lay out the leaves anew and add up all sums."""
        n = len(self.length)
        self.leaves = np.append(np.arange(0, max(n, 1), LEAF), n)
        size = 1 << max(0, int(len(self.leaves) - 2).bit_length())
        self.tree = np.zeros((2 * size, 2), dtype=np.int64)
        for column, values in enumerate((self.length, self.count)):
            run = np.concatenate([[0], np.cumsum(values)])
            self.tree[size : size + len(self.leaves) - 1, column] = run[self.leaves[1:]] - run[self.leaves[:-1]]
        for node in range(size - 1, 0, -1):
            self.tree[node] = self.tree[2 * node] + self.tree[2 * node + 1]

    @property
    def tokens(self) -> int:
        return int(self.tree[1, 1])

    @property
    def characters(self) -> int:
        return int(self.tree[1, 0])

    def find(self, position: int) -> tuple[int, int]:
        """(number, first character) of the first pre-token that ends behind ``position``; the number after the last if none does."""
        size, node, before = len(self.tree) // 2, 1, 0
        if position >= self.characters:
            return len(self.length), self.characters
        while node < size:
            left = int(self.tree[2 * node, 0])
            node *= 2
            if before + left <= position:
                before, node = before + left, node + 1
        leaf = node - size
        at, end = int(self.leaves[leaf]), int(self.leaves[leaf + 1])
        ends = before + np.cumsum(self.length[at:end])
        inside = int(np.searchsorted(ends, position, side="right"))
        return at + inside, before + (int(ends[inside - 1] - before) if inside else 0)

    def splice(self, first: int, last: int, length: list[int], count: list[int]) -> None:
        """Put new pre-tokens in place of those from ``first`` up to ``last``; only the touched leaves and their ancestors change."""
        more = len(length) - (last - first)
        leaf = max(0, min(bisect_right(self.leaves, first), len(self.leaves) - 1) - 1)
        end = max(leaf, int(np.searchsorted(self.leaves, last, side="left")) - 1)
        self.length = np.concatenate([self.length[:first], np.array(length, dtype=self.length.dtype), self.length[last:]])
        self.count = np.concatenate([self.count[:first], np.array(count, dtype=self.count.dtype), self.count[last:]])
        # The first touched leaf takes what is new, and leaves within the old stretch keep what is behind it.
        inner = self.leaves[leaf + 1 : end + 1]
        self.leaves = np.concatenate([self.leaves[: leaf + 1], np.full(len(inner), first + len(length)), self.leaves[end + 1 :] + more])
        if (self.leaves[1:] - self.leaves[:-1])[leaf] > GROWTH * LEAF:
            self._plant()
            return
        size = len(self.tree) // 2
        touched = set()
        for i in range(leaf, end + 1):
            at, to = self.leaves[i], self.leaves[i + 1]
            self.tree[size + i] = self.length[at:to].sum(), self.count[at:to].sum()
            touched.add((size + i) // 2)
        while touched and 0 not in touched:
            for node in touched:
                self.tree[node] = self.tree[2 * node] + self.tree[2 * node + 1]
            touched = {node // 2 for node in touched}

    def edit(self, counter: Counter, text: str, start: int, stop: int, new: str) -> tuple[str, int]:
        """Replace ``text[start:stop]``; the new text and how many pre-tokens were encoded for it."""
        first, begin = self.find(max(0, start - 2))
        # Pre-tokens that end by ``start - 2`` are out of reach of the edit.
        edited = text[:start] + new + text[stop:]
        shift, behind = len(new) - (stop - start), start + len(new)
        last, old_end = first, begin
        parts: list[str] = []
        position = begin
        for match in self.pattern_from(counter, edited, begin):
            parts.append(match)
            position += len(match)
            while old_end + shift < position and last < len(self.length):
                old_end += int(self.length[last])
                last += 1
            if position >= behind and old_end >= stop and old_end + shift == position:
                break
        else:
            last = len(self.length)
        self.splice(first, last, [len(p) for p in parts], counter.counts(parts))
        return edited, len(parts)

    @staticmethod
    def pattern_from(counter: Counter, text: str, position: int) -> Iterator[str]:
        return (m.group() for m in counter.pattern.finditer(text, position))

    def packed(self) -> tuple[int, bytes, bytes, bytes, bytes]:
        return self.tokens, self.length.astype(np.uint32).tobytes(), self.count.astype(np.uint32).tobytes(), self.tree.tobytes(), self.leaves.astype(np.int32).tobytes()

    @classmethod
    def unpacked(cls, length: bytes, count: bytes, tree: bytes, leaves: bytes) -> Counted:
        return cls(np.frombuffer(length, np.uint32), np.frombuffer(count, np.uint32), np.frombuffer(tree, np.int64).reshape(-1, 2).copy(), np.frombuffer(leaves, np.int32).astype(np.int64))


def _struct(rows: list[tuple | None]) -> pa.Array:
    kinds = [("tokens", pa.int64()), *((n, pa.binary()) for n in ("length", "count", "tree", "leaves"))]
    return pa.array([dict(zip((n for n, _ in kinds), row, strict=True)) if row else None for row in rows], pa.struct(kinds))


def counted(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``state``: token count, pre-tokens and tree of each whole text, as a table; a null text has a null state."""
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    @F.arrow_udf(f"struct<{STATE.replace(' ', ':').replace(',:', ',')}>")
    def state(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(*sent.value)
        for column in columns:
            rows: list[tuple | None] = []
            for value in column:
                if not value.is_valid:
                    rows.append(None)
                    continue
                parts = counter.pattern.findall(value.as_py())
                n = len(parts)
                rows.append(Counted(np.fromiter(map(len, parts), np.uint32, n), np.fromiter(counter.counts(parts), np.uint32, n)).packed())
            yield _struct(rows)
            del rows
            give_back()

    kept = [c for c in docs.columns if c.lower() != "state"]
    return table(docs.select(*(F.col(f"`{c}`") for c in kept), state(F.col(f"`{text}`").cast("string")).alias("state")), "state", "zstd")


def recounted(states: DataFrame, edits: Column, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``states`` after the edits of each document: ``text`` and ``state`` changed, ``n_encoded`` pre-tokens encoded for it.

    ``edits`` is an array of (start, stop, new: text) on the old text, in code points; null parts of an edit and positions beyond the text are taken
    as 0, the end and no text.  Of edits that overlap, the later one is cut to begin where the earlier one stops; edits that start at one place are applied in
    the order given.  Null texts and null edits change nothing.
    """
    sent = states.sparkSession.sparkContext.broadcast((ranks, pattern))

    @F.arrow_udf(f"struct<text:string,{STATE.replace(' ', ':').replace(',:', ',')},n_encoded:bigint>")
    def apply(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        counter = Counter(*sent.value)
        for texts, old, changes in batches:
            rows, new_texts, encoded = [], [], []
            for value, state, change in zip(texts, old, changes, strict=True):
                if not value.is_valid or not state.is_valid:
                    rows.append(None)
                    new_texts.append(None)
                    encoded.append(0)
                    continue
                now, n = value.as_py(), 0
                doc = Counted.unpacked(*(state[k].as_buffer() for k in ("length", "count", "tree", "leaves")))
                for start, stop, new in reversed(_in_order(change.as_py() or [], len(now))):
                    now, more = doc.edit(counter, now, start, stop, new)
                    n += more
                rows.append(doc.packed())
                new_texts.append(now)
                encoded.append(n)
            parts = _struct(rows)
            yield pa.StructArray.from_arrays([pa.array(new_texts, pa.string()), *parts.flatten(), pa.array(encoded, pa.int64())], names=["text", *(f.name for f in parts.type), "n_encoded"])
            del rows, new_texts, parts
            give_back()

    name = fresh(states.columns, "after")[0]
    found = states.withColumn(name, apply(F.col(f"`{text}`").cast("string"), F.col("state"), edits))
    fields = [f.split()[0] for f in STATE.split(", ")]
    whole = F.when(F.col(f"{name}.text").isNotNull(), F.struct(*(F.col(name)[f].alias(f) for f in fields)))
    return found.withColumns({text: F.col(name)["text"], "state": whole, "n_encoded": F.col(name)["n_encoded"]}).drop(name)


def _in_order(edits: list[dict], size: int) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    upto = 0
    plain = [(min(max(e["start"] or 0, 0), size), min(max(size if e["stop"] is None else e["stop"], 0), size), e["new"] or "") for e in edits if e is not None]
    for start, stop, new in sorted(plain, key=lambda e: e[0]):
        start = max(start, upto)
        upto = max(start, stop)
        out.append((start, upto, new))
    return out
