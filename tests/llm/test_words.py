import re
import string

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from argotlog.llm.words import LETTERS_DIGITS, NOT_SPACE, chunks, shingles, shingles_by_text, sorted_sets, words

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
KINDS = ((NOT_SPACE, r"[^\x20\x09-\x0D]+"), (LETTERS_DIGITS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
some_text = st.text(alphabet=st.sampled_from("aAbZz09 \t\n\x0b.,-# é中😀\x7f\x00"), max_size=60) | st.none()


def all_words(texts, kind, **kwargs):
    out = []
    for _, _, w in words(pa.array(texts, pa.string()), kind, **kwargs):
        for i in range(len(w.first) - 1):
            out.append([w.data[s:e].tobytes().decode() for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)])
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(some_text, max_size=8), st.integers(1, 40))
def test_words_are_those_of_the_pattern(texts, size):
    for kind, pattern in KINDS:
        assert all_words(texts, kind, size=size) == [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]


def test_hashes_depend_on_the_word_alone():
    one = pa.array(["alpha beta", None, "", "xx beta alpha alpha"])
    seen = {}
    for size in (1, 7, 1 << 20):
        for _, _, w in words(one, NOT_SPACE, size=size):
            for s, e, h in zip(w.start, w.end, w.hash, strict=True):
                assert seen.setdefault(w.data[s:e].tobytes(), int(h)) == int(h)
    assert len(set(seen.values())) == len(seen) == 3
    many = [f"{a}{b}" for a in string.ascii_lowercase for b in range(400)]
    got = np.concatenate([w.hash for _, _, w in words(pa.array([" ".join(many)]), NOT_SPACE)])
    assert len(np.unique(got)) == len(many)


def test_slices_and_large_texts():
    column = pa.array(["aa bb", "cc", None, "dd ee ff"]).slice(1)
    assert all_words(column.to_pylist(), NOT_SPACE) == [["cc"], [], ["dd", "ee", "ff"]]
    assert [(r, s) for r, s, _, _ in chunks(column, 3)] == [(0, 2), (2, 3)]
    assert [w.hash.tolist() for _, _, w in words(pa.array(["x y"], pa.large_string()), NOT_SPACE)] == [w.hash.tolist() for _, _, w in words(pa.array(["x y"]), NOT_SPACE)]


def test_shingles_stay_within_texts():
    column = pa.array(["a b c d e", "a b", "", "b c d"])
    for _, _, w in words(column, NOT_SPACE):
        values, at = shingles_by_text(w, 3)
        assert np.diff(at).tolist() == [3, 1, 0, 1]
        assert values[1] == values[at[3]]  # b c d
        assert len(shingles(w.hash, 99)) == 0
        sets, ends = sorted_sets(np.array([5, 5, 1, 7, 7, 2], np.uint64), np.array([0, 3, 3, 6]))
        assert sets.tolist() == [1, 5, 2, 7] and ends.tolist() == [0, 2, 2, 4]
