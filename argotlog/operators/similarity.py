"""Longest common subsequences of many pairs of short texts at once, behind an upper bound from character counts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BINS = 64
# Texts up to this length are compared side by side, longer ones pair by pair.
LONG = 1024
# Pairs that are worked on at once.
PAIRS = 1 << 13
_U1 = np.uint64(1)


def make_similarity():
    """``(text, text) -> longest common subsequence`` as a closure, so that tasks need nothing but the standard library."""

    def common(a: str, b: str) -> int:
        if a == b:
            return len(a)
        shared, end = 0, min(len(a), len(b))
        while shared < end and a[shared] == b[shared]:
            shared += 1
        a, b = a[shared:], b[shared:]
        tail, end = 0, min(len(a), len(b))
        while tail < end and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if len(a) > len(b):
            a, b = b, a
        if not a:
            return shared + tail
        # Hyyrö's bit-parallel recurrence: one bit per character of the shorter text, cleared where it is matched.
        positions: dict[str, int] = {}
        for i, ch in enumerate(a):
            positions[ch] = positions.get(ch, 0) | 1 << i
        full = (1 << len(a)) - 1
        row = full
        for ch in b:
            match = row & positions.get(ch, 0)
            row = ((row + match) | (row - match)) & full
        return shared + tail + len(a) - row.bit_count()

    return common


class Texts:
    """Texts prepared for comparison: characters as numbers of one alphabet, lengths, and character counts in a few bins."""

    def __init__(self, texts: Sequence[str]):
        self.texts = list(texts)
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in self.texts]
        self.length = np.array([len(c) for c in codes], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        self.codes = np.concatenate([np.zeros(0, np.uint32), *codes])
        owner = np.repeat(np.arange(len(codes)), self.length)
        counts = np.bincount(owner * BINS + (self.codes % BINS).astype(np.int64), minlength=len(codes) * BINS)
        self.counts = counts.reshape(len(codes), BINS).astype(np.int16 if not len(self.length) or self.length.max() < 1 << 15 else np.int32)

    def __len__(self) -> int:
        return len(self.texts)


class Patterns:
    """Bit masks of the characters of short texts, for the recurrence over many pairs."""

    def __init__(self, of: Texts):
        self.of = of
        self.alphabet = np.unique(of.codes)
        self.words = max(1, int(-(-min(int(of.length.max(initial=0)), LONG) // 64)))
        # The last letter stands for all that no pattern has, and for the padding of short texts.
        self.masks = np.zeros((len(of), len(self.alphabet) + 1, self.words), np.uint64)
        short = np.repeat(of.length <= LONG, of.length)
        owner = np.repeat(np.arange(len(of)), of.length)[short]
        place = (np.arange(len(of.codes)) - np.repeat(of.first[:-1], of.length))[short]
        letter = np.searchsorted(self.alphabet, of.codes[short])
        np.bitwise_or.at(self.masks, (owner, letter, place // 64), _U1 << (place % 64).astype(np.uint64))

    def letters(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at, len(self.alphabet))


def bounds(a: Texts, b: Texts, low: int, high: int) -> np.ndarray:
    """Upper bounds of the common subsequences of the texts ``low`` to ``high`` of ``a`` with all of ``b``: what they have in common of characters."""
    out = np.zeros((high - low, len(b)), np.int32)
    for j in range(BINS):
        out += np.minimum(a.counts[low:high, j, None], b.counts[None, :, j])
    return out


def common_of_pairs(a: Texts, patterns: Patterns, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Longest common subsequence of text ``left[i]`` of ``a`` and pattern ``right[i]``."""
    b = patterns.of
    out = np.zeros(len(left), np.int64)
    long = (a.length[left] > LONG) | (b.length[right] > LONG)
    if long.any():
        one = make_similarity()
        out[long] = [one(a.texts[i], b.texts[j]) for i, j in zip(left[long].tolist(), right[long].tolist(), strict=True)]
    rest = np.flatnonzero(~long)
    rest = rest[np.argsort(a.length[left[rest]], kind="stable")]
    letters = patterns.letters(a.codes)
    for begin in range(0, len(rest), PAIRS):
        some = rest[begin : begin + PAIRS]
        i, j = left[some], right[some]
        steps, first = a.length[i], a.first[i]
        rows = [np.full(len(some), np.uint64(0xFFFFFFFFFFFFFFFF)) for _ in range(patterns.words)]
        for step in range(int(steps.max(initial=0))):
            # Texts are sorted by length: those that have ended come first.
            done = int(np.searchsorted(steps, step, side="right"))
            masks = patterns.masks[j[done:], letters[first[done:] + step]]
            carry = np.zeros(len(some) - done, np.uint64)
            for w in range(patterns.words):
                row = rows[w][done:]
                match = row & masks[:, w]
                total = row + match
                over = total < row
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
                rows[w][done:] = total | (row & ~match)
        length = b.length[j]
        zeros = np.zeros(len(some), np.int64)
        for w in range(patterns.words):
            bits = np.clip(length - 64 * w, 0, 64)
            mask = np.where(bits == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (_U1 << (bits % 64).astype(np.uint64)) - _U1)
            zeros += np.bitwise_count(~rows[w] & mask)
        out[some] = zeros
    return out
