"""Plain forms that the pipeline's tests compare with."""

import collections
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def naive_classes(texts):
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def naive_removed_words(texts):
    words = {i: WORDS.findall(t) for i, t in texts.items()}
    count = collections.Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    return {d: {i + k for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for k in range(35)} for d, w in words.items()}


def weighted(a, b):
    a, b = (collections.Counter(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter() for w in (a, b))
    return sum(min(a[s], b[s]) * len(s) for s in a) / max(1, sum(max(a[s], b[s]) * len(s) for s in a | b))
