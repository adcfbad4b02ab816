"""SimHash: fingerprints against a plain definition, components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from lodestrata.llm import set_join
from lodestrata.llm import simhash as sh


def plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps, budget):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= budget:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B", "a b c", "É a b c  d\ve f", "x " * 70_000])
def test_fingerprint(text):
    assert sh.simhash(text) == plain(text)


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_finds_every_pair(seed, monkeypatch):
    monkeypatch.setattr(sh, "FRONT", 50)
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {0, 2**64 - 1, *base}
    for b in base:
        for _ in range(6):
            fps.add(b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ ((r.random() < 0.5) << r.randrange(64)))
    a = np.array(sorted(fps), np.uint64)
    got = set()
    sh.trie_join(a, None, 2, lambda i, j: got.update(zip(i.tolist(), j.tolist(), strict=True)))
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if (int(a[i]) ^ int(a[j])).bit_count() <= 2}
    assert got == want
    x, y = a[::2].copy(), a[1::3].copy()
    got = set()
    sh.trie_join(x, y, 2, lambda i, j: got.update(zip(i.tolist(), j.tolist(), strict=True)))
    assert got == {(i, j) for i in range(len(x)) for j in range(len(y)) if (int(x[i]) ^ int(y[j])).bit_count() <= 2}


def test_links_over_many_leaves(spark):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(150)] + [r.getrandbits(20) for _ in range(60)]
    fps = sorted({b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base for _ in range(3)} | {0, 1, 2**64 - 1})
    df = spark.createDataFrame([(sh._signed(f),) for f in fps], "fp long")
    want = brute(fps, 2)
    for leaf in (7, 60, 100_000):
        parts = sh.components(sh.links(df, 2, leaf)).collect()
        root = {p["node"] % 2**64: p["root"] % 2**64 for p in parts}
        groups, expected = {}, {}
        for f in fps:
            groups.setdefault(root.get(f, f), set()).add(f)
            expected.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string")


def test_near_duplicates(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(5, long), (3, long), (9, long + " tail"), (1, None), (2, ""), (4, "quite another text of words"), (None, "lonely words here"), (4, "quite another text of words")]
    got = sh.near_duplicates(docs(spark, rows)).collect()
    fps = {plain(t) for _, t in rows}
    roots = brute(sorted(fps), 2)
    want = []
    for i, t in rows:
        ids = [j for j, u in rows if roots[plain(u)] == roots[plain(t)] and j is not None]
        want.append((i, plain(t), min(ids, default=None)))
    key = lambda x: (x[0] is None, x)
    assert sorted(((g["doc_id"], g["fp"] % 2**64, g["component_id"]) for g in got), key=key) == sorted(want, key=key)


def test_keep_one_and_empty(spark):
    long = " ".join(f"word{i}" for i in range(300))
    kept = sh.keep_one(spark, docs(spark, [(5, long), (3, long), (4, "b c d e"), (4, "b c d e"), (None, "z"), (None, "z")]), "").collect()
    assert sorted(str(k["doc_id"]) for k in kept) == ["3", "4", "None", "None"]
    assert sh.near_duplicates(docs(spark, [])).collect() == []
    assert sh.keep_one(spark, docs(spark, []), "").columns == ["doc_id", "text", "lang", "source", "n_chars", "fp"]


def test_near_leaves():
    r = random.Random(3)
    leaves, todo = [], [(0, 0)]
    while todo:
        d, p = todo.pop()
        if d < 2 or (d < 9 and r.random() < 0.6):
            todo += [(d + 1, 2 * p), (d + 1, 2 * p + 1)]
        elif r.random() < 0.9:
            leaves.append((d, p))
    leaves.sort(key=lambda x: x[1] << (64 - x[0]))
    lows, depths = [p << (64 - d) for d, p in leaves], [d for d, _ in leaves]
    for a, (d, p) in enumerate(leaves):
        want = [b for b, (e, q) in enumerate(leaves) if ((p >> (d - min(d, e))) ^ (q >> (e - min(d, e)))).bit_count() <= 2]
        assert sorted(sh.near_leaves(a, lows, depths, 2)) == want


def five(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("group", [32, 2])
def test_keep_one_drops_copies_with_words_replaced(spark, monkeypatch, group):
    monkeypatch.setattr(sh, "GROUP", group)
    r = random.Random(17)
    prose = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    line = prose(12)
    rows = [(i, " ".join(prose(r.randrange(3, 250)) + (line if i % 2 else []))) for i in range(150)]
    for i in range(150):
        words = rows[r.choice([r.randrange(150), 7])][1].split()
        for _ in range(r.randrange(0, 8)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "  ")]
    sets = {i: five(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    far = 0
    for a in sets:
        for b in sets:
            if a < b and likeness(sets[a], sets[b]) >= 0.8:
                far += (plain(dict(rows)[a]) ^ plain(dict(rows)[b])).bit_count() > 2
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert far > 50
    kept = sh.keep_one(spark, docs(spark, rows), "").collect()
    assert sorted(k["doc_id"] for k in kept) == sorted({find(i) for i in sets})


def test_keep_one_of_each_group_where_an_id_has_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    kept = sh.keep_one(spark, docs(spark, [(1, b), (5, a), (5, b), (9, a), (2, "other"), (2, None), (7, None)]), "").collect()
    assert sorted((k["doc_id"], k["text"] or "") for k in kept) == [(1, b), (2, ""), (2, "other"), (5, a)]


def test_trie_top_bounds_what_the_driver_sees(spark, monkeypatch):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(3000)} | {r.getrandbits(12) for _ in range(500)}
    df = spark.createDataFrame([(sh._signed(f),) for f in fps], "fp long").cache()
    seen = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(rows := collect(self)) or rows)
    monkeypatch.setattr(sh, "MAX_COUNTS", 64)
    leaves = sh.trie_top(df, 20)
    heavy = len(fps) // 20
    assert max(map(len, seen)) <= max(64, 2 * heavy) and len(seen) > 5
    lows = np.array([p << (64 - d) for d, p in leaves], np.uint64)
    sizes = np.bincount(np.searchsorted(lows, np.array(sorted(fps), np.uint64), "right") - 1)
    assert sizes.max() <= 20 and sizes.sum() == len(fps)


def test_links_are_pairs_within_the_budget(spark):
    r = random.Random(8)
    base = r.getrandbits(64)
    fps = {base ^ sum(1 << b for b in r.sample(range(64), r.randrange(5))) for _ in range(400)}
    df = spark.createDataFrame([(sh._signed(f),) for f in fps], "fp long")
    for leaf in (50, 1000):
        assert all((x["u"] ^ x["v"]) % 2**64 and ((x["u"] ^ x["v"]) % 2**64).bit_count() <= 2 for x in sh.links(df, 2, leaf).collect())


def test_forest():
    r = np.random.default_rng(3)
    for n in (1, 5, 200):
        a, b = r.integers(0, n, n), r.integers(0, n, n)
        root, used = sh.forest(n, a, b)
        assert (root[a] == root[b]).all() and (root[root] == root).all() and (root <= np.arange(n)).all()
        assert len(used) == n - len(np.unique(root))
        again, _ = sh.forest(n, a[used], b[used])
        assert (again == root).all()


def test_a_text_in_pieces_is_the_text(monkeypatch):
    from lodestrata.llm import common

    r = random.Random(4)
    texts = ["".join(r.choice("ab \té") for _ in range(n)) for n in (0, 1, 9, 300)] + ["x" * 100, " " * 100]
    want = [(sh.simhash(t), sh.shingle_sets()()(t)[0].tolist()) for t in texts]
    monkeypatch.setattr(common, "PIECE_CHARS", 7)
    assert all("".join(common.pieces(t)) == t for t in texts) and list(common.pieces(None)) == []
    assert [(sh.simhash(t), sh.shingle_sets()()(t)[0].tolist()) for t in texts] == want


@pytest.mark.parametrize("most", [set_join.MAX_BROADCAST, 0])
def test_a_large_group_is_met_in_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(set_join, "BLOCK", 50)
    monkeypatch.setattr(set_join, "MAX_BROADCAST", most)
    r = random.Random(21)
    line = [f"l{i}" for i in range(9)]
    rows = []
    for i in range(60):
        words = line + [f"w{r.randrange(8)}" for _ in range(r.randrange(3))]
        rows.append((i, " ".join(words)))
    sets = {i: five(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and likeness(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {g["doc_id"]: g["component_id"] for g in sh.near_copies(docs(spark, rows), group=2).collect()}
    assert got == {i: find(i) for i in sets}
