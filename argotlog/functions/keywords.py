"""Whole-word search for many literal keywords in one scan of the text.

The keyword list becomes one regular expression.  Alternatives that share a beginning are merged into a prefix tree, so
a scan tests a handful of branches per position and not every keyword.  The tree keeps the order of a sorted list:
of two keywords where one begins with the other, the shorter one is tried first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import AFTER_WORD, NOT_AFTER_WORD, NOT_BEFORE_WORD, WORD

_SPECIAL = set("\\^$.|?*+()[]{}-&#~")
_END = ""


def escape(text: str) -> str:
    """Quote the characters that mean something to a regular expression (valid in Java and in RE2)."""
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in text)


def _is_word(ch: str) -> bool:
    return ch == "_" or ch.isalnum()


def alternation(keywords: Iterable[str]) -> str | None:
    """Plain ``k1|k2|...`` over the sorted distinct keywords, null for an empty list."""
    return "|".join(escape(k) for k in sorted({k for k in keywords if k})) or None


def whole_word_pattern(keywords: Iterable[str], case_sensitive: bool = True) -> str | None:
    """Java pattern for any of the keywords standing as a whole word; null for an empty list.

    A word boundary next to a keyword that begins or ends with punctuation needs a word character on its other side.
    """
    distinct = sorted({k for k in keywords if k})
    if not distinct:
        return None
    branches = []
    for starts_with_word, before in ((True, NOT_AFTER_WORD), (False, AFTER_WORD)):
        tree: dict = {}
        for keyword in distinct:
            if _is_word(keyword[0]) == starts_with_word:
                node = tree
                for ch in keyword:
                    node = node.setdefault(ch, {})
                node[_END] = NOT_BEFORE_WORD if _is_word(keyword[-1]) else f"(?={WORD})"
        if tree:
            branches.append(before + _branch(tree))
    pattern = "(?:" + "|".join(branches) + ")"
    return pattern if case_sensitive else "(?iu)" + pattern


def _branch(node: dict) -> str:
    # _END is the empty string, so it sorts first: a keyword is tried before the longer ones it begins.
    options = [node[key] if key == _END else escape(key) + _branch(node[key]) for key in sorted(node)]
    return options[0] if len(options) == 1 else "(?:" + "|".join(options) + ")"


def keyword_matches(text: Column, keywords: Iterable[str], case_sensitive: bool = True) -> Column:
    """Array of all keyword occurrences from left to right; empty for null text or an empty keyword list."""
    pattern = whole_word_pattern(keywords, case_sensitive)
    if pattern is None:
        return F.array().cast("array<string>")
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    return found if case_sensitive else F.transform(found, F.lower)


def contains_keyword(text: Column, keywords: Iterable[str], case_sensitive: bool = True) -> Column:
    """True where any keyword occurs as a whole word; false for null text."""
    pattern = whole_word_pattern(keywords, case_sensitive)
    return F.lit(False) if pattern is None else F.coalesce(text.rlike(pattern), F.lit(False))


def mentions_keyword(text: Column, keywords: Iterable[str]) -> Column:
    """True where any keyword occurs anywhere, in any case and inside words too."""
    pattern = alternation(keywords)
    return F.lit(False) if pattern is None else F.coalesce(text.rlike("(?i)" + pattern), F.lit(False))
