"""Connected components against union-find, with a round in one task and in many."""

import random

import pytest

from lodestrata.llm import components as cc


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("task_links", [20, 500_000])
def test_components_of_chains_hubs_and_random_links(spark, monkeypatch, task_links):
    monkeypatch.setattr(cc, "TASK_LINKS", task_links)
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 40)] + [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)]
    links += [(3, 3), (None, 4), (5, None), links[0], links[0][::-1], (-7, 1030)]
    rnd.shuffle(links)
    got = cc.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["root"] for r in got} == plain(links)


def test_no_links(spark):
    assert cc.components(spark.createDataFrame([], "u string, v string")).collect() == []
    assert cc.components(spark.createDataFrame([("b", "a"), ("c", "b")], "u string, v string")).count() == 3
