"""The Jaccard join."""

import random

import pytest

from helpers import by_id, shingles


def test_components_with_a_hot_node(spark):
    from skarn.llm.jaccard import components

    r = random.Random(5)
    edges = [(10_000, i) for i in range(3000)] + [(i, i + 1) for i in range(20_000, 20_012)] + [(r.randrange(30_000, 30_200), r.randrange(30_000, 30_200)) for _ in range(120)]
    edges += [(40_000 + i, 50_000) for i in range(1500)] + [(50_000, 20_006), (7, 7)]
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((root(u), root(v)))
            above[b] = a
    rows = components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()
    assert len(rows) == len(above)
    assert {x.node: x.root for x in rows} == {x: root(x) for x in above}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [2, 256])
def test_jaccard_join(docs, texts, nothing, block):
    from skarn.llm.jaccard import near_duplicates

    own = [shingles(t) for t in texts]
    n = len(own)
    linked = [[j for j in range(n) if j != i and own[i] and own[j] and len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j])] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            root[i] = min([root[i], *(root[j] for j in linked[i])])
    got = by_id(near_duplicates(docs, block=block))
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (root[i], len(linked[i])) for i in range(n)}
    if block == 256:
        assert near_duplicates(nothing).count() == 0


def test_jaccard_join_of_null_and_repeated_ids(spark):
    from skarn.llm.jaccard import near_duplicates, one_of_each

    r = random.Random(21)
    make = lambda: " ".join("".join(r.choices("abcdef", k=5)) for _ in range(80))
    t, a, b, c, d = (make() for _ in range(5))
    rows = [(1, t), (1, t), (2, t + " x"), (5, a), (5, b), (3, a + " x"), (9, b + " x"), (None, c), (None, c), (None, d), (8, d + " x"), (None, None), (4, make())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(x.doc_id), str(x.class_id), x.n_links) for x in near_duplicates(docs).collect())
    want = [(1, 1, 2), (1, 1, 2), (2, 1, 2), (5, 3, 1), (3, 3, 1), (5, 5, 1), (9, 5, 1), (None, None, 1), (None, None, 1), (None, 8, 1), (8, 8, 1), (None, None, 0), (4, 4, 0)]
    assert got == sorted((str(i), str(k), n) for i, k, n in want)
    left = sorted(map(str, (tuple(x) for x in one_of_each(docs).collect())))
    assert left == sorted(map(str, [(1, t), (3, a + " x"), (5, b), (None, c), (8, d + " x"), (None, None), (4, rows[-1][1])]))


def test_large_near_copy_group(spark):
    from skarn.llm.jaccard import near_duplicates

    r = random.Random(2)
    base = ["".join(r.choices("abcdef", k=5)) for _ in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        own[r.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(own)))
    sets = [shingles(t) for _, t in rows]
    want = {i: sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(60)) for i in range(60)}
    got = by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16))
    assert {i: x.n_links for i, x in got.items()} == want
    assert {x.class_id for x in got.values()} == {0}


def test_pruning_keeps_what_may_reach_the_threshold():
    from skarn.llm.jaccard import least_matches

    least = least_matches(0.8, 1e-6)
    assert all(least[n] < 0.8 * n for n in least) and least[160] > 90
