"""Plain versions of what the operators compute."""

import collections
import re
import sys

from trajlake.llm.text import TO_LOWER, WORD


def removed(texts, window):
    """For each word, whether a repeated window covers it."""
    seen = collections.Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[tuple(t[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def shingle_set(text, n):
    words = re.findall(WORD, (text or "").translate(TO_LOWER))
    if not words:
        return frozenset()
    k = min(n, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def jaccard_groups(docs, n, percent):
    """Set sizes, the smallest id of each group, and the group, over all pairs."""
    sets = [shingle_set(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        root = find(i)
        if key is not None:
            least[root] = min(least.get(root, sys.maxsize), key)
    return [len(s) for s in sets], [least.get(find(i)) for i in range(len(docs))], [find(i) for i in range(len(docs))]


def waterfill(size, weights, most):
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        left = total - sum(most * size[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: most * size[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and target[s] > most * size[s]}
        if not over:
            return target
        capped |= over
