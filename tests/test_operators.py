"""Operators on hand-written rows: thresholds, ties, cycles, faults, and sequential rules against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import audit, inference, masks, metrics, paths, reasoning, relations, sample, schedule, splits, stores, worlds


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_relation_thresholds_and_ties(spark):
    s = "relation string, support long, distinct_subjects long, distinct_objects long"
    stats = spark.createDataFrame([("P1", 4999, 4999, 1), ("P2", 5000, 4750, 9), ("P10", 5000, 4750, 9), ("P3", 5000, 4749, 9), ("P4", 5000, 4800, 2), ("P5", 9000, 9000, 2)], s)
    alias = spark.createDataFrame([(f"P{i}",) for i in (1, 2, 3, 4, 10)], "relation string")
    ranked = relations.rank_relations(stats, alias, count=2)
    assert [(r["relation"], r["rank"]) for r in ranked.orderBy("rank").collect()] == [("P4", 1), ("P2", 2)]
    assert rows(relations.filter_reasons(stats, alias, ranked), "reason", "relations") == [("functionality", 1), ("no_alias", 1), ("not_selected", 1), ("selected", 2), ("support", 1)]
    quotas = [r[0] for r in spark.range(1, 33).select(relations.quota(F.col("id"))).collect()]
    assert sum(quotas) == 3000


def test_shared_alias_vanishes_from_both(spark):
    a = spark.createDataFrame([(1, 0, "fi"), (1, 1, "one"), (2, 0, "fi"), (2, 1, "two"), (2, 2, "TWO")], "id long, ord long, raw string")
    own = sample.unique_aliases(a, F.lower("raw"))
    assert rows(own, "id", "ord") == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert rows(sample.canonical_aliases(own), "id", "norm") == [(1, "one"), (2, "two")]


def test_reconcile():
    good = {"raw": 10, "kept": 7, "dropped": 3, "distinct": 6, "keys": 5, "eligible": 3, "ineligible": 2, "sampled": 2, "quota": 4, "values": 3, "needed": 9, "labelled": 8}
    assert sample.reconcile(good) == []
    assert sample.reconcile(good | {"dropped": 2, "labelled": 10}) == ["raw = kept + dropped", "labelled <= needed"]


def brute_hops(triples, order, start, hops):
    at = {}
    for s, r, o in triples:
        at.setdefault((s, r), set()).add(o)
    (s, r), status, seen, out = start, "ok", set(), []
    i = order.index(r)
    for h in range(hops):
        r = order[(i + h) % len(order)]
        if status == "ok":
            o = at.get((s, r))
            status = "missing_hop" if o is None else "ambiguous_address" if len(o) > 1 else "repeated_address" if (s, r) in seen else "ok"
            seen.add((s, r))
            if status == "ok":
                (s,) = o
        out.append((h + 1, status, s if status == "ok" else None))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_paths_on_cyclic_graphs(spark, seed):
    r = random.Random(seed)
    order = ["P1", "P2"]
    triples = [(a, p, r.randrange(6)) for a in range(6) for p in order for _ in range(r.choice([1, 1, 1, 1, 2, 0]))]
    df = spark.createDataFrame(triples, "subject long, relation string, object long")
    stats = paths.address_stats(df)
    found = paths.roots(stats, "s", 100)
    got = {}
    for x in paths.expand(found, stats, order).collect():
        got.setdefault((x["root"], x["root_relation"]), []).append((x["hop"], x["status"], x["object"]))
    assert got and {k: sorted(v) for k, v in got.items()} == {k: brute_hops(triples, order, k, 6) for k in got}
    full = paths.with_alternatives(paths.expand(found, stats, order), paths.successors(df))
    for x in paths.accounting(full, found.count(), 100).collect():
        assert x["candidates"] == x["surviving"] + x["selection_bound"] + sum(x[c] for c in paths.REASONS)
    items = paths.twin_items(full.filter("status = 'ok'"), "s", {"P1": 2, "P2": 1})
    assert paths.replay(items, stats).count() == 0
    if items.count():
        changed = df.filter("relation = 'P1'").union(df.filter("relation = 'P2'").withColumn("object", F.col("object") + 1))
        two = items.filter("hop > 1").count()
        assert not two or paths.replay(items, paths.address_stats(changed)).count() > 0


def test_single_object_domain_has_no_successor(spark):
    df = spark.createDataFrame([(1, "P1", 7), (2, "P1", 7), (1, "P2", 3), (2, "P2", 9), (3, "P2", 300_000)], "subject long, relation string, object long")
    want = [("P1", 7, None), ("P2", 3, 9), ("P2", 9, 300_000), ("P2", 300_000, 3)]
    for f in (paths.successors, lambda x: paths.successors_ranged(x, 10)):
        assert sorted([tuple(r) for r in f(df).select("relation", "object", "successor").collect()], key=str) == sorted(want, key=str)


def greedy(lanes, weights):
    """Largest absolute remaining deficit; ties by the lanes' order."""
    total, w = sum(map(sum, lanes.values())), sum(weights.values())
    done, at, out = dict.fromkeys(lanes, 0), dict.fromkeys(lanes, 0), []
    while any(at[k] < len(lanes[k]) for k in lanes):
        best = max((k for k in lanes if at[k] < len(lanes[k])), key=lambda k: (total * weights[k] - w * done[k], -list(lanes).index(k)))
        out.append((best, at[best]))
        done[best] += lanes[best][at[best]]
        at[best] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_deficit_schedule_is_greedy(spark, seed):
    r = random.Random(seed)
    lanes = {k: [r.choice([1, 2, 3, 50]) for _ in range(r.randrange(1, 30))] for k in "abc"}
    weights = {"a": 3, "b": r.choice([1, 3]), "c": 1}
    recs = spark.createDataFrame([(i, k, n) for k, v in lanes.items() for i, n in enumerate(v)], "ordinal long, lane string, token_length long")
    w = spark.createDataFrame([(k, i, weights[k]) for i, k in enumerate(lanes)], "lane string, ord long, weight long")
    got = schedule.deficit_schedule(recs.repartition(5), w).orderBy("sequence").collect()
    assert [(g["lane"], g["ordinal"]) for g in got] == greedy(lanes, weights)
    assert audit.unordered(schedule.deficit_schedule(recs, w), [], "sequence", "sequence").count() == 0 and got[-1]["token_end"] == sum(map(sum, lanes.values()))


def test_hamilton_shards_and_offsets(spark):
    w = spark.createDataFrame([("a", 0, 1), ("b", 1, 1), ("c", 2, 1)], "lane string, ord long, weight long")
    assert rows(schedule.hamilton(w, 11), "lane", "quota") == [("a", 4), ("b", 4), ("c", 3)]
    s = schedule.assign_shards(spark, 10, 4, 8).collect()
    assert [(x["update_start"], x["update_end"]) for x in s] == [(0, 3), (3, 6), (6, 8), (8, 10)] and s[-1]["token_end"] == 80
    r = random.Random(3)
    data = [(r.randrange(-50, 5000), i, r.randrange(9)) for i in range(500)]
    got = schedule.offsets(spark.createDataFrame(data, "a long, b long, n long"), ["a", "b"], "n", buckets=7).collect()
    run, want = 0, {}
    for a, b, n in sorted(data):
        want[b], run = run, run + n
    assert {g["b"]: g["token_start"] for g in got} == want
    with pytest.raises(ValueError, match="fit"):
        schedule.pack(spark.createDataFrame([(9, 1, 1)], "pos long, token long, weight long"), 3, 3)


def test_sequential_rules(spark):
    r = random.Random(1)
    data = {t: [r.randrange(1, 9) for _ in range(40)] for t in "xyz"}
    df = spark.createDataFrame([(t, k, n) for t, v in data.items() for k, n in enumerate(v)], "task string, k long, token_length long")
    quotas = {"x": 5, "y": 3, "z": 1}
    got = [(g["task"], g["k"]) for g in schedule.quota_choice(df.repartition(7), quotas, 150).orderBy("sequence").collect()]
    done, at, written, want = dict.fromkeys(quotas, 0), dict.fromkeys(quotas, 0), 0, []
    while written < 150:
        best = sorted(quotas, key=lambda t: (-(quotas[t] * written - done[t] * 9), t))[0]
        n = data[best][at[best]]
        want.append((best, at[best]))
        at[best] += 1
        done[best] += n
        written += n
    assert got == want
    filled = schedule.exact_fill(df, 37).groupBy("task").agg(F.sum("token_length").alias("s")).collect()
    assert [x["s"] for x in filled] == [37] * 3
    assert schedule.exact_fill(spark.createDataFrame([("q", 0, 4), ("q", 1, 6)], "task string, k long, token_length long"), 7).count() == 0
    plan = schedule.curriculum_schedule(spark.createDataFrame([("graph" if i % 2 else "bed", i, 3) for i in range(100)], "lane string, ordinal long, token_length long"), {"graph": 60, "bed": 30}).orderBy("sequence").collect()
    assert [p["lane"] for p in plan][:11] == ["bed"] + ["graph"] * 10 and all(p["band"] <= p["phase"] for p in plan)
    assert sum(p["token_length"] for p in plan if p["lane"] == "graph") == 60


def test_merkle_and_batches(spark):
    h = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    leaves = spark.createDataFrame([(i, x.hex()) for i, x in enumerate(h)], "position long, hash string")
    level = h
    while len(level) > 1:
        level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
    assert tuple(schedule.merkle(leaves).first()) == (3, level[0].hex())
    assert schedule.stream_digest(leaves) == hashlib.sha256(b"".join(h)).hexdigest()
    toks = spark.createDataFrame([(i, 10 + i, 0 if i == 3 else 1) for i in range(7)], "pos long, token long, weight long")
    got = {b["window"]: (b["x"], b["y"]) for b in schedule.batch_windows(toks, 1, 3).collect()}
    assert got == {0: ([10, 11, 12], [11, 12, -100]), 1: ([13, 14, 15], [14, 15, 16])}
    assert schedule.np_windows(np.arange(5), 3, 4).tolist() == [3, 4, 0, 1]


def test_runs_ranges_and_patterns(spark):
    zero = spark.createDataFrame([(1, p) for p in (0, 1, 4, 6, 7, 8, 4)], "record long, pos long")
    assert rows(masks.zero_runs(zero, ["record"]), "start", "end") == [(0, 2), (4, 5), (6, 9)]
    touching = spark.createDataFrame([(1, 0, 2), (1, 2, 4), (1, 5, 6), (2, 0, 3)], "record long, start long, end long")
    assert rows(masks.merged(touching, ["record"]), "record", "start", "end") == [(1, 0, 4), (1, 5, 6), (2, 0, 3)]
    assert masks.overlaps(touching, ["record"]).count() == 0
    assert masks.overlaps(touching.union(spark.createDataFrame([(2, 1, 2)], touching.schema)), ["record"]).count() == 1
    recs = spark.createDataFrame([(1, list("xabc")), (2, list("ab")), (3, list("cabcbc")), (4, [])], "record long, tokens array<string>")
    pats = spark.createDataFrame([(1, list("ab")), (2, list("abc")), (3, list("bc")), (4, [])], "pattern long, tokens array<string>")
    want = [(1, 1, 3, 1), (1, 1, 4, 2), (1, 2, 4, 3), (2, 0, 2, 1), (3, 1, 3, 1), (3, 1, 4, 2), (3, 2, 4, 3), (3, 4, 6, 3)]
    for most in (10_000, 1):
        m = masks.pattern_matches(recs, pats, most)
        assert rows(m, "record", "start", "end", "pattern") == want
    spans = spark.createDataFrame([(1, 0, 4), (3, 2, 4)], "record long, start long, end long")
    assert rows(masks.uncontained(m, spans, 2), "record", "start") == [(2, 0), (3, 1), (3, 1), (3, 4)]


def test_audit_of_sidecars_tells_faults(spark):
    s = masks.with_bins(spark.createDataFrame([("a", 1, 40, "payload", True, 0, 2), ("b", 1, 40, "random_control", False, 2, 4), ("c", 1, 40, "action", False, 4, 6)], "span_id string, record long, n long, role string, external boolean, start long, end long"))
    c = masks.matched_controls(s, "x")
    points = masks.positions(masks.masked_ranges(s, c))
    none = spark.createDataFrame([], "record long, start long, end long, pattern long")
    assert all(r["violations"] == 0 for r in masks.audit(s, c, points, none).collect())
    stray = spark.createDataFrame([(1, 4, 5, 9)], none.schema)
    got = dict(rows(masks.audit(s, c.filter("false"), points, stray), "check", "violations"))
    assert got["untagged_payloads"] == 1 and got["random_histogram"] == 1 and got["zero_runs"] > 0
    bad = c.withColumn("start", F.lit(4).cast("long")).withColumn("end", F.lit(6).cast("long"))
    assert dict(rows(masks.audit(s, bad, points, none), "check", "violations"))["protected_roles"] > 0
    assert masks.balanced_padding(s).collect()[0]["padding"] == 0


def test_wilson_conventions(spark):
    def at(k, n):
        df = spark.createDataFrame([(k, n)], "k long, n long")
        return df.select(*metrics.wilson_clamped(F.col("k"), F.col("n")), *metrics.wilson_exact(F.col("k"), F.col("n")), metrics.wilson_upper(F.col("k"), F.col("n"))).first()

    assert tuple(at(0, 0)) == (0.0, 0.0, None, None, None)
    lo, hi, elo, ehi, up = at(15, 601)
    assert (lo, hi) == pytest.approx((0.01517, 0.04078), abs=2e-5) and up == ehi and elo == pytest.approx(lo, abs=1e-5)
    assert at(5, 5)[1] == 1.0 and at(0, 5)[0] == 0.0


def test_curves(spark):
    pts = spark.createDataFrame([("a", 0, 5.0), ("a", 10, 9.0), ("b", 0, 1.0), ("b", 10, 3.0), ("b", 20, 3.0), ("c", 0, 1.0), ("c", 5, 2.0)], "s string, x long, y double")
    up = {r["s"]: (r["reached"], r["x_cross"]) for r in metrics.first_crossing(pts, F.lit(2.5), ["s"]).collect()}
    assert up == {"a": (True, 0.0), "b": (True, 7.5), "c": (False, None)}
    down = {r["s"]: r["x_cross"] for r in metrics.first_crossing(pts, F.lit(1.0), ["s"], higher=False).collect()}
    assert down == {"a": None, "b": 0.0, "c": 0.0}
    assert {r["s"]: r["aulc"] for r in metrics.aulc_trapezoid(pts, ["s"]).collect()} == {"a": 7.0, "b": 2.5, "c": 1.5}
    assert {r["s"]: r["aulc"] for r in metrics.aulc_right(pts, ["s"]).collect()} == {"a": 9.0, "b": 3.0, "c": 2.0}


def test_pairs_and_empty_rates(spark):
    p = spark.createDataFrame([(1, "original", 1), (1, "counterfactual", 1), (2, "original", 1), (3, "original", 1), (3, "original", 1)], "pair_id long, variant string, correct long").withColumn("arm", F.lit("x"))
    r = metrics.pair_accuracy(p, ["arm"]).first()
    assert (r["pairs"], r["both_right"], r["incomplete"], r["accuracy"]) == (1, 1, 2, 1.0)
    assert metrics.pair_accuracy(p.filter("pair_id = 2"), ["arm"]).first()["accuracy"] is None
    assert rows(audit.broken_pairs(p, ["arm"], []), "pair_id", "problem") == [(2, "missing_variant"), (3, "repeated_variant")]


def test_exact_tests_and_holm(spark):
    d = spark.createDataFrame([(1.0,)] * 3, "delta double")
    assert inference.sign_flip(d, alternative="greater").first()["p_value"] == 1 / 8
    assert inference.sign_flip(d).first()["p_value"] == 2 / 8
    with pytest.raises(ValueError, match="pairs"):
        inference.sign_flip(spark.range(21).select(F.col("id").cast("double").alias("delta")))
    h = inference.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double"))
    assert {r["name"]: round(r["adjusted"], 9) for r in h.collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    vals = spark.createDataFrame([(float(i),) for i in range(1, 41)], "v double")
    assert inference.nearest_rank(vals, "v", [0.025, 0.975]).first()[:] == (1.0, 39.0)
    assert inference.linear(vals, "v", [0.025]).first()[0] == pytest.approx(np.percentile(np.arange(1, 41), 2.5))


def test_bootstraps(spark):
    r = random.Random(2)
    data = [(w, t, i, r.choice([-1, 0, 1, 1])) for w in range(12) for t in "ab" for i in range(r.randrange(2, 9))]
    d = spark.createDataFrame(data, "world long, task string, pair long, d long")
    point = np.mean([x[3] for x in data])
    boot = lambda parts: inference.clustered_bootstrap(d.repartition(parts), "world", 400, 7)
    assert rows(boot(3), "replicate", "delta") == rows(boot(9), "replicate", "delta")
    iv = inference.interval(boot(3)).first()
    assert iv["lo"] < point < iv["hi"] and iv["draws"] == 400
    cells = d.groupBy("task", "world", "pair").agg(F.avg("d").alias("d"))
    nested = metrics.nested_means(cells.withColumn("all", F.lit(1)), ["all", "task", "world", "pair"], "d").first()["mean"]
    h = inference.interval(inference.hierarchical_bootstrap(d, ["task", "world", "pair"], ["task"], 300, 1), rank=True).first()
    assert h["lo"] < nested < h["hi"]
    m = inference.interval(inference.multinomial_bootstrap(d, "world", "task", 300, 1)).first()
    assert m["lo"] < m["hi"]
    # clusters that agree within themselves widen the interval
    same = spark.createDataFrame([(w, i, 1 if w % 2 else -1) for w in range(12) for i in range(8)], "world long, i long, d long")
    mixed = same.withColumn("world", F.col("world") * 100 + F.col("i"))
    assert inference.interval(inference.clustered_bootstrap(same, "world", 300)).first()["se"] > inference.interval(inference.clustered_bootstrap(mixed, "world", 300)).first()["se"]
    assert inference.design_power(spark, 0.2, 0.02, 5, 300).first()["power"] > 0.95 > 0.2 > inference.design_power(spark, 0.0, 0.02, 5, 300).first()["power"]


@pytest.mark.parametrize("axis", range(3))
def test_each_axis_is_checked(spark, axis):
    good = [("train", f"a{i}", f"t{i}") for i in range(3)] + [("dev", f"a{i}", f"d{i}") for i in range(3)]
    df = spark.createDataFrame([(s, a, v) for s, a, v in good], "split string, axis string, value string")
    assert splits.shared_values(df).count() == 0
    bad = df.union(spark.createDataFrame([("dev", f"a{axis}", f"t{axis}")], df.schema))
    assert [(r["axis"], r["value"], r["splits"]) for r in splits.shared_values(bad).collect()] == [(f"a{axis}", f"t{axis}", ["dev", "train"])]


def test_fixpoint(spark):
    facts = spark.createDataFrame([(1, "p"), (2, "p"), (2, "r")], "person long, atom string")
    rules = spark.createDataFrame([(1, "p", "q"), (2, "q", "s"), (2, "r", "s")], "rule int, antecedent string, head string")
    assert rows(reasoning.forward_chain(facts, rules), "person", "atom", "level") == [(1, "p", 0), (1, "q", 1), (2, "p", 0), (2, "q", 1), (2, "r", 0), (2, "s", 2)]


def test_problems_solve_themselves(spark):
    got = reasoning.problems(spark, 60, 5).withColumn("s", reasoning.solved("prompt")).collect()
    assert len(got) == 60 and all(g["s"] == g["answer"] for g in got)
    again = reasoning.problems(spark, 60, 5).repartition(3).collect()
    assert {g["seed"]: g["prompt"] for g in got} == {g["seed"]: g["prompt"] for g in again}


def test_oracles_against_brute_force():
    import itertools

    r = random.Random(5)
    for _ in range(40):
        n = r.randrange(2, 5)
        edges = [[r.randrange(n), r.randrange(n)] for _ in range(r.randrange(5))]
        ok = any(all(p.index(b) < p.index(a) for a, b in edges) for p in itertools.permutations(range(n)))
        assert reasoning.schedulable(list(range(n)), edges) == str(ok)
        sides, target = [r.randrange(2, 7) for _ in range(3)], r.randrange(3, 18)
        hit = sum(sum(f) >= target for f in itertools.product(*[range(1, s + 1) for s in sides]))
        a, b = map(int, reasoning.dice_odds(sides, target).split("/"))
        assert a * math.prod(sides) == hit * b
        k = r.randrange(2, 5000)
        assert math.prod(map(int, reasoning.factors(k).split(" × "))) == k
        lo, hi = sorted((r.randrange(300), r.randrange(300)))
        assert int(reasoning.primes_between(lo, hi)) == sum(x > 1 and all(x % y for y in range(2, x)) for x in range(lo, hi + 1))


def test_worlds(spark):
    for n in range(1, 300, 7):
        for size in (20, 64):
            sizes = worlds.world_sizes(n, size)
            assert sum(sizes) == n and all(s > 0 for s in sizes)
            assert [(w["entities"], w["first"]) for w in worlds.worlds(spark, n, size).orderBy("world").collect()] == [(s, sum(sizes[:i])) for i, s in enumerate(sizes)] if n % 49 == 1 else True
    schema = spark.createDataFrame([("P1", "entity", 10, 10, 5), ("P2", "date", 4, 4, 0)], "relation string, kind string, support long, distinct_subjects long, distinct_objects long")
    w = worlds.schema_world(worlds.worlds(spark, 40, 20), schema, 3)
    got = w.collect()
    assert sorted(x["source"] for x in got if x["relation"] == "P1") == list(range(40))
    assert audit.repeated_addresses(w, ["world", "source", "relation"]).count() == 0
    for x in got:
        if x["relation"] == "P1":
            assert int(x["target"]) // 20 == x["world"]
    assert w.exceptAll(worlds.schema_world(worlds.worlds(spark, 40, 20).repartition(3), schema, 3)).count() == 0


def test_derangement_moves_every_payload(spark):
    r = random.Random(8)
    df = spark.createDataFrame([("k", i, r.choice("aaabbc")) for i in range(60)] + [("one", 100, "x"), ("one", 101, "x"), ("one", 102, "y")], "kind string, id long, p string")
    got = stores.derangement(df, "kind", "id", "p", "s").collect()
    most = max(sum(x["p"] == c for x in df.filter("kind = 'k'").collect()) for c in "abc")
    if 2 * most <= 60:
        assert len(got) == 60 and all(g["p"] != g["donated"] for g in got) and sorted(g["donor"] for g in got) == list(range(60))
    assert "one" in {u["kind"] for u in stores.underivable(df, "kind", "p").collect()}


def test_ledger_faults(spark):
    h, chain = None, []
    for i, t in enumerate(["planned", "preflight_passed", "launch_requested", "completed"]):
        own = hashlib.sha256("\n".join([h or "", "1", str(i), t]).encode()).hexdigest()
        chain.append((1, i, t, h, own))
        h = own
    df = spark.createDataFrame(chain, "run long, seq long, type string, previous string, hash string")
    assert rows(audit.ledger_errors(df), "seq", "problem") == [(3, "transition")]
    assert (3, "gap") in rows(audit.ledger_errors(df.filter("seq <> 2")), "seq", "problem")
    forged = df.withColumn("type", F.when(F.col("seq") == 2, "excluded").otherwise(F.col("type")))
    assert rows(audit.ledger_errors(forged), "seq", "problem") == [(2, "hash"), (3, "transition")]


def test_order_of_input_does_not_matter(spark):
    df = spark.createDataFrame([(g, i) for g in range(3) for i in range(40)], "g long, k long")
    for f in (lambda x: splits.floor_split(x, ["g"], "k", 80, 100, "s"), lambda x: splits.partners(x, ["g"], "k", "s"), lambda x: splits.reservoir(x, ["g"], "k", "s", 20)):
        assert f(df).exceptAll(f(df.orderBy(F.desc("k")).repartition(7))).count() == 0
    got = splits.floor_split(df, ["g"], "k", 80, 100, "s").groupBy("g", "split").agg(F.count("*").alias("n"))
    assert {(r["split"], r["n"]) for r in got.collect()} == {("train", 32), ("held", 8)}
