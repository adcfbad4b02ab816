"""SpotSigs: the edited texts and their likeness against plain code; the join against all pairs."""

import hashlib
import itertools
import random

import pytest

from lodestrata.llm import spotsigs as sp

ODD = [None, "", " ", "!!", "the", "one", "Ein Wort", "one two", "the of and", "漢字 仮名 交じり", "x" * 5000]


def text(r, n):
    return " ".join(r.choice(["the", "of", "und", "le", *(f"w{r.randrange(400):03d}".replace("0", "a").replace("1", "b") for _ in range(4))]) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "f") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fingerprint string")


def as_set(hexes):
    return {hexes[i : i + 8] for i in range(0, len(hexes), 8)}


def likeness(a, b):
    x, y = as_set(a), as_set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("ranges", [1, 7])
def test_edit_likeness(spark, ranges):
    r = random.Random(5)
    docs = [(i * 3, text(r, r.randrange(1, 300))) for i in range(50)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id the same words"), (9999, "twice the id again"), (9999, "twice the id again")]
    r.shuffle(docs)
    got = sp.edit_likeness(frame(spark, docs), ranges).collect()
    assert len(got) == len(docs)
    prints = {g["doc_id"]: g["fingerprint"] for g in got}
    order = sorted((i, t or "") for i, t in docs if i is not None)
    by = {g["doc_id"]: g for g in got}
    seen = 0
    for k, (i, t) in enumerate(order):
        if i == 9999:
            continue
        following = order[k + 1] if k + 1 < len(order) else (None, "null id the same words")
        new = t[: len(t) - len(t) // 4] + following[1][: len(t) // 4]
        g = by[i]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert g["near_edited"] == likeness(g["fingerprint"], g["edited_fingerprint"])
        assert g["near_next"] == likeness(g["fingerprint"], prints[following[0]])
        assert g["edited_fingerprint"] == sp.text_of(sp.signatures(sp.Words().of(new)))
        seen += 1
    assert seen > 50


def test_signatures_are_chains_after_anchors():
    w = sp.Words()
    a, b = (set(sp.signatures(w.of(t)).tolist()) for t in ("The quick and brown fox jumps", "so then: the QUICK brown fox"))
    assert a & b and len(a) == 2
    assert len(sp.signatures(w.of("solo"))) == 1 and len(sp.signatures(w.of("kein anker worte hier"))) == 2
    assert sp.signatures(w.of(None)).size == 0


def test_jaccard_prunes_only_below_the_threshold():
    import numpy as np

    r = random.Random(1)
    for _ in range(300):
        a, b = (np.unique(np.array([r.randrange(60) for _ in range(r.randrange(50))], np.uint32)) for _ in range(2))
        x, y = set(a.tolist()), set(b.tolist())
        j = len(x & y) / len(x | y) if x | y else 1.0
        for least in (0.0, 0.3, 0.8):
            assert sp.jaccard(a, b, least) == (j if j >= least else 0.0)


def test_similar_finds_every_pair(spark):
    r = random.Random(2)
    docs = []
    for k in range(25):
        words = text(r, r.randrange(20, 200)).split()
        docs.append(" ".join(words))
        for _ in range(3):
            cut = words[:]
            for _ in range(r.randrange(1, 6)):
                cut[r.randrange(len(cut))] = "neu"
            docs.append(" ".join(cut))
    docs += [docs[0]] * 5 + ODD
    rows = list(enumerate(docs))
    members, pairs = sp.similar(frame(spark, rows))
    of = {m["doc_id"]: m["class_id"] for m in members.collect()}
    sets = {i: set(sp.signatures(sp.Words().of(t)).tolist()) for i, t in rows}
    assert len(of) == len(rows)
    for i, _ in rows:
        assert of[i] == min(j for j in sets if sets[j] == sets[i])
    want = {(a, b) for a, b in itertools.combinations(sorted(set(of.values())), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {tuple(sorted((p["a"], p["b"]))) for p in pairs.collect()} == want and len(want) > 10
    found = {c["doc_id"]: c["component_id"] for c in sp.near_duplicate_classes(frame(spark, rows)).collect()}
    assert len(found) == len(rows) and all(found[a] == found[b] for a, b in want)


def test_empty_and_alone(spark):
    assert sp.edit_likeness(frame(spark, [])).collect() == []
    (g,) = sp.edit_likeness(frame(spark, [(4, "the only text of all")])).collect()
    assert g["near_next"] == 1.0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100])
def test_ranges(spark, n):
    import bisect

    r = random.Random(n)
    cuts = sorted({r.randrange(-50, 500) for _ in range(n)})
    df = spark.createDataFrame([(x,) for x in [*range(-60, 510, 3), *cuts, None]], "v long")
    for x in df.select("v", sp._range_of(df["v"], cuts).alias("b")).collect():
        assert x["b"] == (0 if x["v"] is None else bisect.bisect_right(cuts, x["v"]))


@pytest.mark.parametrize("group", [2, 32])
def test_classes_against_all_pairs(spark, monkeypatch, group):
    from lodestrata.llm import set_join

    monkeypatch.setattr(set_join, "BLOCK", 100)
    r = random.Random(6)
    docs = []
    for _ in range(30):
        words = text(r, r.randrange(5, 150)).split()
        for _ in range(4):
            cut = words[:]
            for _ in range(r.randrange(4)):
                cut[r.randrange(len(cut))] = "neu"
            docs.append(" ".join(cut))
    rows = list(enumerate(docs + ODD + [docs[0]] * 3))
    found = {f["doc_id"]: (f["class_id"], f["component_id"]) for f in set_join.near_sets(frame(spark, rows), sp.signature_sets, 0.8, group, by_length=True).collect()}
    sets = {i: frozenset(sp.signatures(sp.Words().of(t)).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] == sets[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert found == {i: (min(j for j in sets if sets[j] == sets[i]), find(i)) for i in sets}


def test_pieces_change_nothing(monkeypatch):
    from lodestrata.llm import common

    r = random.Random(9)
    texts = [text(r, 40), "ΑΣ ΣΑΣ Σ", " the  of und ", "x" * 50]
    want = [sp.signatures(sp.Words().of(t)).tolist() for t in texts]
    monkeypatch.setattr(common, "PIECE_CHARS", 3)
    assert [sp.signatures(sp.Words().of(t)).tolist() for t in texts] == want
