"""Components against a plain union of sets, contracted in rounds and labelled in one pass."""

import random

import pytest

from fleetfold.llm import components as c


def union(edges):
    groups = {}
    for a, b in edges:
        both = groups.get(a, {a}) | groups.get(b, {b})
        groups |= dict.fromkeys(both, both)
    return {node: min(group) for node, group in groups.items()}


@pytest.mark.parametrize("few", [c.FEW, 20])
def test_components_equal_a_plain_union(spark, monkeypatch, few):
    rng = random.Random(3)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(45)] + [(k, k + 1) for k in range(1000, 1030)] + [(7, 7), (1, 2), (2, 1), (1, 2)]
    edges = [(a * 10**15, b * 10**15) for a, b in edges]
    written = []
    monkeypatch.setattr(c, "FEW", few)
    monkeypatch.setattr(c, "stored", lambda rows, purpose, keep=c.stored: written.append(purpose) or keep(rows, purpose))
    got = {r["node"]: r["root"] for r in c.components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == union([e for e in edges if e[0] != e[1]])
    assert len(written) == 1 if few == c.FEW > 20 else len(written) > 1


def test_no_edges_give_no_rows(spark):
    assert c.components(spark.createDataFrame([(1, 1)], "a LONG, b LONG")).collect() == []
