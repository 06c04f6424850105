"""Plain versions of what the operators compute, one text at a time."""

import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width):
    w = WORD.findall(fold(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < width else frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def component_of(sets):
    """For each index the indexes reachable by links of similarity 0.8 or more."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        seen = set()
        for x in s:
            seen.update(by[x])
        for j in seen:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            by[x].append(i)
    groups = defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    return [groups[find(i)] for i in range(len(sets))]


def repetition(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), lines, len(cover)


def longest_repeat(words):
    best = 0
    for n in range(1, len(words)):
        if max(Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)).values()) < 2:
            break
        best = n
    return best
