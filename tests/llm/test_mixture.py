"""Mixing: targets and taken words against plain code, positions against the integral."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from lodestrata.llm import mixture as mx


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 0.5) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, position double")


def fill(sizes, weights, cap):
    """Share by weight, cut at the caps, share the excess again."""
    target, free, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while free and left > 1e-9:
        w = sum(weights[s] for s in free)
        add = {s: left * weights[s] / w for s in free}
        left = 0.0
        for s in add:
            target[s] += add[s]
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
        free = {s for s in free if target[s] < cap * sizes[s] - 1e-9}
    return target


def corpus(seed, sources):
    r = random.Random(seed)
    rows = [(i, r.choice(["a b", " x\ty\n", ""]) + " wörd" * int(r.expovariate(1 / 40)), r.choice(sources)) for i in range(500)]
    return rows + [(900, None, sources[0]), (901, "", None), (None, "some words", sources[0]), (7, rows[7][1], rows[7][2]), (902, "w " * 3000, sources[-1])]


@pytest.mark.parametrize("seed", range(3))
def test_plan(spark, seed):
    sources = [["b", "a", "ä", None], ["s1", "s10", "s2", *"klmnop"], [None, "only"]][seed]
    rows = corpus(seed, sources) + ([(2000, "tiny one", "Z")] if seed else [])
    got = mx.plan(frame(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for _, t, s in rows:
        per[s] += size(t)
    order = sorted((s for s in per if s is not None)) + [None] * (None in per)
    want = fill(per, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    assert sorted((str(g["doc_id"]), g["size"]) for g in got) == sorted((str(i), size(t)) for i, t, _ in rows)
    taken = defaultdict(int)
    for g in got:
        assert g["target"] == pytest.approx(want[g["source"]]) and g["source_size"] == per[g["source"]]
        assert 0 <= g["taken"] <= 3 * g["size"] and g["taken"] == g["epochs"] * g["size"]
        taken[g["source"]] += g["taken"]
    for s in per:
        assert abs(taken[s] - want[s]) <= max(20, 0.05 * want[s])
    again = mx.plan(frame(spark, rows[::-1])).collect()
    key = lambda g: (str(g["doc_id"]), g["size"], g["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_start_runs_in_hash_order(spark):
    rows = [(i, "w " * (i % 7), "s") for i in range(300)]
    got = sorted(mx.plan(frame(spark, rows)).collect(), key=lambda g: hashlib.md5(str(g["doc_id"]).encode()).hexdigest())
    run = 0
    for g in got:
        assert g["start"] == run
        run += g["size"]


def test_curriculum(spark):
    rows = corpus(9, ["a", "b", "c"])
    out = mx.curriculum(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "position"]
    got = out.collect()
    at = [g["position"] for g in got]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    plan = {(g["doc_id"], g["h"]): g for g in mx.plan(frame(spark, rows)).collect()}
    assert len(got) == sum(g["epochs"] for g in mx.plan(frame(spark, rows)).collect())
    # the words of a source placed before t follow the integral of its schedule
    goal = {g["source"]: g["target"] for g in plan.values()}
    for k, s in enumerate(sorted(goal, key=lambda s: (s is None, s))):
        slope = mx.SLOPES[k % 3]
        for t in (0.25, 0.5, 0.75):
            placed = sum(len((g["text"] or "").split()) for g in got if g["source"] == s and g["position"] < t)
            assert placed == pytest.approx(goal[s] * (slope * t * t + (1 - slope) * t), abs=max(4000 if s == "c" else 600, 0.1 * goal[s]))


def test_empty(spark):
    assert mx.plan(frame(spark, [])).collect() == []
    assert mx.curriculum(frame(spark, [])).collect() == []


def test_queries_give_the_training_order(spark, tmp_path):
    frame(spark, corpus(4, ["a", "b", "c"])).drop("position").write.parquet(f"{tmp_path}/documents.parquet")
    got = mx.positions_query(spark, str(tmp_path)).collect()
    first = [g["positions"][0] for g in got if g["positions"]]
    assert first == sorted(first) and len(set(first)) > 100
    assert all(not g["positions"] for g in got[len(first) :])
    assert all(g["taken"] == len(g["positions"]) * g["size"] and g["positions"] == sorted(g["positions"]) for g in got)
    placed = mx.curriculum(spark.read.parquet(f"{tmp_path}/documents.parquet")).select("doc_id", "position").collect()
    assert sorted((str(g["doc_id"]), x) for g in got for x in g["positions"]) == sorted((str(g["doc_id"]), g["position"]) for g in placed)
    own = mx.query(spark, str(tmp_path))
    assert own.columns == ["doc_id", "size", "source_size", "target", "taken", "position", "last_position"]
    ends = lambda x: (x[0], x[-1]) if x else (None, None)
    assert [tuple(g) for g in own.collect()] == [(*tuple(g)[:5], *ends(g["positions"])) for g in got]


def test_buckets_grow_with_rows_and_change_nothing(spark, monkeypatch):
    from lodestrata.llm import prefix

    assert prefix.buckets(10) == prefix.BUCKETS and prefix.buckets(10**11) == 500_000
    rows = corpus(3, ["a", "b"])
    key = lambda g: (str(g["doc_id"]), g["start"], g["taken"])
    want = sorted(map(key, mx.plan(frame(spark, rows)).collect()))
    monkeypatch.setattr(prefix, "BUCKET_ROWS", 1)
    assert sorted(map(key, mx.plan(frame(spark, rows)).collect())) == want
