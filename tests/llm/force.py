"""Brute-force versions, and what every test module here needs."""

import re

import pytest

from pacegrid.llm.tables import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    """Python workers find the package wherever the tests were started."""
    ship(spark)


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def near_by_force(rows, threshold=0.8):
    """doc_id: (class, links, copy, copies)."""
    classes = {}
    for i, text in rows:
        classes.setdefault(shingles(text), []).append(i)
    sets, ids = list(classes), list(classes.values())
    links, parent = [0] * len(sets), list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    head = {}
    for i, members in enumerate(ids):
        head[root(i)] = min([head.get(root(i), members[0]), *members])
    return {d: (head[root(i)], links[i], min(m), len(m)) for i, m in enumerate(ids) for d in m}
