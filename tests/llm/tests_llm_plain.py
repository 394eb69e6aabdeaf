"""Plain Python versions of the pipeline's similarity stages."""

import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def classes_of(texts, k, percent):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 1))} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def removed_words(texts, window):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s : s + window]), i)
    return {i: {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < i for p in range(s, s + window)} for i, w in words.items()}
