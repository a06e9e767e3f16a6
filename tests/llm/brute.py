"""Plain versions of the operators, for small tables."""

import hashlib
import re
import string
from collections import Counter, defaultdict

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED, lower=True):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def chunks(lines):
    """(first, n) of content-defined chunks."""
    if len(lines) < 2:
        return [(0, len(lines))]
    h = [md5(x) for x in lines]
    r = [md5((h[i - 1] if i else "") + h[i]) for i in range(len(h))]
    ends = [-1, *(i for i in range(1, len(r) - 2) if r[i] < r[i - 1] and r[i] <= r[i + 1]), len(r) - 1]
    return [(a + 1, b - a) for a, b in zip(ends, ends[1:])]


def line_dedup(docs):
    """[(id, text, lines, removed)] of [(id, text)] in order."""
    seen, out = set(), []
    for key, text in docs:
        if text is None:
            out.append((key, None, 0, 0))
            continue
        lines, kept, removed = text.split("\n"), [], 0
        for first, n in chunks(lines):
            part = lines[first : first + n]
            if len(lines) >= 2 and "\n".join(part).strip(" \t\n\x0b\f\r"):
                if tuple(part) in seen:
                    removed += n
                    continue
                seen.add(tuple(part))
            kept += part
        out.append((key, "\n".join(kept), len(lines), removed))
    return out


def shingle_set(text, k=4):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def components(docs, percent=85):
    """{id: (set size, smallest linked id)}."""
    sets = {key: shingle_set(text) for key, text in docs}
    lists, root = defaultdict(list), {key: key for key in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for key, s in sets.items():
        common = Counter(other for g in s for other in lists[g])
        for other, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[other]) - n):
                a, b = find(key), find(other)
                root[max(a, b)] = min(a, b)
        for g in s:
            lists[g].append(key)
    return {key: (len(s), find(key)) for key, s in sets.items()}


def contamination(docs, items, window=10):
    """{id: (words, hit, items, digest)}."""
    phrases = defaultdict(set)
    for item, text in items:
        w = words(text, LETTERS)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            phrases[tuple(w[i : i + k])].add(str(item))
    sizes = {len(p) for p in phrases}
    out = {}
    for key, text in docs:
        w, hit, found = words(text, LETTERS), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in phrases:
                    found |= phrases[tuple(w[i : i + k])]
                    hit.update(range(i, i + k))
        out[key] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def quality_counts(text):
    text = text or ""
    w = words(text, lower=False)
    lines = [line for line in text.split("\n") if SPACED.search(line)]
    threes, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if threes[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def repeated(docs, n=50):
    """{id: starts of n-word passages that another document has exactly}."""
    where = defaultdict(set)
    split = {key: words(text) for key, text in docs}
    for key, w in split.items():
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].add(key)
    return {key: [i for i in range(len(w) - n + 1) if len(where[tuple(w[i : i + n])]) > 1] for key, w in split.items()}
