"""Corpora and weight sidecars against sets of positions in plain Python, and how often their rows are read."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestrata.operators import corpus as op
from lodestrata.operators import masks

RANGES = "condition string, record long, start long, end long"
CORPUS = "record long, pos long, token int, w_dense int, w_split int, w_selective int, w_random int"


def _runs(points):
    out = []
    for p in sorted(set(points)):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return {tuple(x) for x in out}


def _made(seed):
    """records, ranges and a corpus of them: ranges touch, cross words of 64 positions and fill some."""
    rng, records, ranges, corpus = random.Random(seed), [], [], []
    for record in range(6):
        n = rng.choice([1, 63, 64, 65, 130, 400])
        records.append((record, n))
        masked = {c: set() for c in masks.CONDITIONS}
        for c in masks.CONDITIONS[1:]:
            at = rng.randrange(9)
            while at < n:
                end = min(n, at + rng.choice([1, 2, 5, 64, 130]))
                ranges.append((c, record, at, end))
                masked[c] |= set(range(at, end))
                at = end + rng.choice([0, 1, 7, 60])
        corpus += [(record, p, p % 7, *[int(p not in masked[c]) for c in masks.CONDITIONS]) for p in range(n)]
    return records, ranges, corpus


def _plain(records, ranges, corpus):
    """The counts of verify for ranges that don't overlap."""
    own = {}
    for r in corpus:
        own.setdefault(r[0], []).append(r)
    lengths = sum(len(own.get(k, [])) != n or (k in own and max(r[1] for r in own[k]) != n - 1) for k, n in records) + sum(k not in dict(records) for k in own)
    at = [r[:2] for r in corpus]
    gaps = 0
    for i, c in enumerate(masks.CONDITIONS):
        for k in {*own, *dict(records)}:
            want = _runs(p for x in ranges if x[:2] == (c, k) for p in range(*x[2:]))
            gaps += len(want ^ _runs(r[1] for r in own.get(k, []) if r[3 + i] == 0))
    return {"record_lengths": lengths, "repeated_positions": sum(at.count(x) > 1 for x in set(at)), "weight_domain": sum(not {*r[3:]} <= {0, 1} for r in corpus), "dense_is_whole": sum(r[3] == 0 for r in corpus), "masked_ranges": gaps}


def _verified(spark, records, ranges, corpus):
    frames = (spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(records, "record long, n long"), spark.createDataFrame(ranges, RANGES))
    return {r["check"]: r["violations"] for r in op.verify(*frames).collect()}


def test_sidecars_are_the_sets_of_positions(spark):
    records, ranges, corpus = _made(1)
    tokens = spark.createDataFrame([r[:3] for r in corpus], "record long, pos long, token int")
    assert sorted(tuple(r) for r in op.sidecars(tokens, spark.createDataFrame(ranges, RANGES)).collect()) == sorted(corpus)


def test_corpus_faults_are_counted(spark):
    records, ranges, corpus = _made(2)
    assert set(_verified(spark, records, ranges, corpus).values()) == {0}
    rng = random.Random(3)
    faulty = [(*r[:3], *[rng.choice([0, 1, 2]) if rng.random() < 0.02 else w for w in r[3:]]) for r in corpus if rng.random() > 0.02]
    faulty += [rng.choice(faulty)] * 2 + rng.sample(faulty, 5) + [(99, 0, 0, 1, 1, 1, 1), (0, 500, 0, 1, 0, 1, 1)]
    want = _plain(records, ranges, faulty)
    assert min(want.values()) > 0 and _verified(spark, records, ranges, faulty) == want


def test_overlapping_ranges_are_told(spark):
    corpus = [(1, p, 0, 1, int(p > 5), 1, 1) for p in range(10)]
    nested = [("split", 1, 0, 6), ("split", 1, 1, 2), ("split", 1, 3, 4)]
    assert _verified(spark, [(1, 10)], nested[:1], corpus)["masked_ranges"] == 0
    assert _verified(spark, [(1, 10)], nested, corpus)["masked_ranges"] == 1


def test_a_corpus_is_read_once(spark):
    records, ranges, corpus = _made(4)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.createDataFrame(corpus, CORPUS).mapInPandas(count, CORPUS)
    got = op.verify(rows, spark.createDataFrame(records, "record long, n long"), spark.createDataFrame(ranges, RANGES)).agg(F.sum("violations")).first()[0]
    assert got == 0 and read.value == len(corpus)


def test_windows_are_found_across_pieces_and_not_across_records():
    rng = random.Random(5)
    docs = [[rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 9, 30]))] for _ in range(40)] + [None, []]
    pats = [list("ab"), list("aba"), list("bbbbb")]
    ids = {"a": -7, "b": 2**62 + 5}
    known = {len(p): np.array([masks._window_hashes(np.array([ids[t] for t in p], np.int64).view(np.uint64), len(p))[0]], np.uint64) for p in pats}
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs, pa.list_(pa.string())), pa.array([d and [ids[t] for t in d] for d in docs], pa.list_(pa.int64()))], ["record", "tokens", "h"])
    want = sorted((r, i, len(p), p) for r, d in enumerate(docs) for p in pats for i in range(len(d or [])) if d[i : i + len(p)] == p)
    for at_once in (1, 4, 1000):
        for part in ([batch], [batch.slice(0, 7), batch.slice(7)], [batch.slice(0, 0), batch]):
            got = [(x["record"], x["start"], x["n"], x["w"]) for b in masks._likely_windows(known, at_once)(part) for x in b.to_pylist()]
            assert sorted(got) == want


def _audited(spark, spans, controls, matches):
    s = masks.with_bins(spark.createDataFrame(spans, "span_id string, record long, n long, role string, external boolean, start long, end long"))
    c = masks.with_bins(spark.createDataFrame(controls, "record long, n long, start long, end long"))
    return {r["check"]: r["violations"] for r in masks.audit(s, c, masks.positions(masks.masked_ranges(s, c)), spark.createDataFrame(matches, "record long, start long, end long, pattern long")).collect()}


def test_audit_counts_pairs_of_ranges(spark):
    rng = random.Random(6)
    some = lambda k: [(rng.randrange(4), at := rng.randrange(180), at + rng.choice([1, 2, 5, 70])) for _ in range(k)]
    spans = [(str(i), r, 300, rng.choice(["payload", "action", "random_control"]), False, s, e) for i, (r, s, e) in enumerate(some(40))]
    controls = [(r, 300, s, e) for r, s, e in some(30)]
    matches = [(*x, i) for i, x in enumerate(some(20))]
    held = [(r, s, e) for _, r, _, role, _, s, e in spans if role != "random_control"]
    within = lambda a, b: a[0] == b[0] and b[1] <= a[1] and a[2] <= b[2]
    pairs = sum(within((r, s, e), h) + within(h, (r, s, e)) for r, _, s, e in controls for h in held)
    untagged = sum(not any(within(m, (r, s, e)) for _, r, _, role, _, s, e in spans if role == "payload") for m in matches)
    order = sorted((r, s, e) for _, r, _, _, _, s, e in spans)
    over = sum(any(o[0] == r and o[2] > s for o in order[:i]) for i, (r, s, _) in enumerate(order))
    got = _audited(spark, spans, controls, matches)
    assert pairs and untagged and over and (got["protected_roles"], got["untagged_payloads"], got["overlapping_spans"]) == (pairs, untagged, over)


def test_sound_sidecars_make_no_pairs(spark, monkeypatch):
    called = []
    plain = masks.contained
    monkeypatch.setattr(masks, "contained", lambda *a: called.append(1) or plain(*a))
    spans = [(f"{k}", 1, 700, role, False, 7 * k + a, 7 * k + a + 1) for k in range(100) for role, a in (("payload", 0), ("random_control", 3), ("action", 6))]
    got = _audited(spark, spans, [(1, 700, 7 * k + 3, 7 * k + 4) for k in range(100)], [(1, 0, 1, 1), (1, 1, 6, 2)])
    # of matches and payloads only: no control meets a protected span
    assert len(called) == 1 and got["protected_roles"] == 0 and got["untagged_payloads"] == 1 and got["zero_runs"] == 0
