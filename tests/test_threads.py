"""Roots, depths and paths against a walk over a dict of parents."""

import math
import random

import pytest

from turnmill.operators import threads as T


def walked(links):
    parent = {}
    for i, p in links:
        if i is not None and p is not None and p != i:
            parent[i] = min(parent.get(i, p), p)
    every = {x for link in links for x in link if x is not None}
    roots, paths = {}, {}
    for i in every:
        path = [i]
        while path[-1] in parent and len(path) <= len(every):
            path.append(parent[path[-1]])
        cycle = path[-1] in parent
        roots[i] = (None, None, True) if cycle else (path[-1], len(path) - 1, False)
        if not cycle and len(path) > 1 and i not in parent.values():
            paths[i] = path[::-1]
    return roots, paths


def forest(seed, n):
    rng = random.Random(seed)
    links = [(str(i), str(rng.randrange(max(0, i - 5), i)) if i and rng.random() > 0.1 else None) for i in range(n)]
    links += [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("s", "s"), ("t", "s"), ("u", "missing"), ("3", "2"), ("t", "s"), (None, "0"), (None, None)]
    rng.shuffle(links)
    return links


CASES = {"random": forest(1, 300), "flat": [(str(i), "r") for i in range(50)], "chain": [(str(i), str(i + 1)) for i in range(70)], "cycle": [("a", "b"), ("b", "a"), ("c", "a")], "one": [("a", None)], "empty": []}


@pytest.mark.parametrize("name", CASES)
def test_roots_and_paths(spark, name):
    links = spark.createDataFrame(CASES[name], "id string, parent string").repartition(3)
    roots, paths = walked(CASES[name])
    got = T.root_of(links).collect()
    assert {r.id: (r.root, r.depth, r.in_cycle) for r in got} == roots and len(got) == len(roots)
    found = T.paths(links).collect()
    assert {r.leaf: r.path for r in found} == paths and len(found) == len(paths)


def test_deep_chain(spark):
    n = 100_000
    links = spark.range(n).selectExpr("cast(id AS string) AS id", "CASE WHEN id > 0 THEN cast(id - 1 AS string) END AS parent")
    jumps = T.Jumps(links)
    assert jumps.rounds <= math.ceil(math.log2(n)) + 1 < 20
    found = T.root_of(links, jumps)
    assert found.where(f"root = '0' AND cast(id AS bigint) = depth AND NOT in_cycle").count() == n
    way = T.ancestors(links, jumps)
    assert way.where(f"leaf = '{n - 1}' AND cast(id AS bigint) = {n - 1} - above").count() == way.count() == n
