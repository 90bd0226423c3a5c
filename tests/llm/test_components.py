"""Connected components in rounds and in one task, against a plain version."""

import random

import pytest

from driftloom.llm.components import connected_components


def plain(edges):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return sorted((x, top(x)) for x in root if top(x) != x)


def chains(seed):
    r = random.Random(seed)
    nodes = [r.randrange(-(1 << 62), 1 << 62) for _ in range(300)]
    edges = [(nodes[k], nodes[k + 1]) for k in range(120)] + [(nodes[r.randrange(130, 300)], nodes[r.randrange(130, 300)]) for _ in range(110)]
    edges += [(nodes[7], nodes[7]), *edges[:20], *((b, a) for a, b in edges[:20]), (None, nodes[1]), (nodes[2], None), (None, None)]
    r.shuffle(edges)
    return edges


CASES = {"chains": chains(1), "star": [(0, k) for k in range(1, 90)] + [(500, k) for k in range(60, 70)], "empty": [], "loops": [(1, 1), (2, 2)], "nulls": [(None, 1)], "pair": [(9, -9)]}


@pytest.mark.parametrize("few", [0, 1_000])
@pytest.mark.parametrize("name", sorted(CASES))
def test_components(spark, name, few):
    edges = spark.createDataFrame(CASES[name], "a long, b long").repartition(3)
    assert sorted(map(tuple, connected_components(edges, few=few).collect())) == plain(CASES[name])
