"""The bigram model against a plain one, its mass, its packing, and odd tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestrata.llm import kneser_ney as kn


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")


def toks(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).split() + ["</s>"]


def in_fold0(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


class Plain:
    def __init__(self, texts):
        self.c, self.b = Counter(), Counter()
        for t in texts:
            ws = toks(t)
            self.c.update(ws)
            self.b.update(zip(["</s>", *ws], ws, strict=False))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.before, self.ctx, self.follow = Counter(w for _, w in self.b), Counter(), defaultdict(Counter)
        for (u, _), n in self.b.items():
            self.ctx[u] += n
            self.follow[u][min(n, 3)] += 1
        self.d2 = kn.discounts([sum(n == k for n in self.b.values()) for k in (1, 2, 3, 4)])
        self.d1 = kn.discounts([sum(n == k for n in self.before.values()) for k in (1, 2, 3, 4)])

    def p1(self, w):
        total = sum(self.before.values())
        rest = sum(self.d1[min(n, 3) - 1] for n in self.before.values()) / total / (self.v + 1)
        n = self.before[w]
        return (n - self.d1[min(n, 3) - 1] if n else 0) / total + rest

    def p(self, w, u):
        if not self.ctx[u]:
            return self.p1(w)
        n = self.b[u, w]
        gamma = sum(self.d2[k - 1] * m for k, m in self.follow[u].items()) / self.ctx[u]
        return (n - self.d2[min(n, 3) - 1] if n else 0) / self.ctx[u] + gamma * self.p1(w)

    def score(self, t):
        ws = toks(t)
        return sum(math.log10(self.p(w, u)) for u, w in zip(["</s>", *ws], ws, strict=False))

    def base(self, t):
        return sum(math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in toks(t))


def corpus(seed, n=300):
    r = random.Random(seed)
    vocab = [f"w{int(r.paretovariate(0.8))}" for _ in range(400)] + ["The", "THE", "é", "É"]
    rows = [(i, r.choice([" ", "\n", "\t  "]).join(r.choice(vocab) for _ in range(r.randrange(60)))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (None, "w1 w2"), (5, rows[5][1]), (1002, "w1 " * 4000), (1003, "never seen words")]


@pytest.mark.parametrize(("shard_tokens", "run_tokens", "cache"), [(kn.SHARD_TOKENS, kn.RUN_TOKENS, kn.CACHE), (300, 50, 10)])
def test_against_a_plain_model(spark, monkeypatch, shard_tokens, run_tokens, cache):
    monkeypatch.setattr(kn, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(kn, "RUN_TOKENS", run_tokens)
    monkeypatch.setattr(kn, "CACHE", cache)
    rows = corpus(1)
    plain = Plain([t for i, t in rows if not in_fold0(i)])
    d = frame(spark, rows)
    model = kn.train(d)
    assert (model.n, model.v, model.pairs) == (plain.n, plain.v, len(plain.b))
    assert model.bigram == pytest.approx(plain.d2) and model.unigram[:3] == pytest.approx(plain.d1)
    got = kn.score(d, model).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for g in got:
        t = text[g["doc_id"]]
        assert g["held_out"] == in_fold0(g["doc_id"]) and g["train_tokens"] == plain.n
        assert (g["n_tokens"], g["n_known"]) == (len(toks(t)), sum(plain.c[w] > 0 for w in toks(t)))
        assert g["base_score"] == pytest.approx(plain.base(t)) and g["score"] == pytest.approx(plain.score(t))
        assert g["perplexity"] == pytest.approx(10 ** (-g["score"] / g["n_tokens"]))


def test_mass_is_one():
    plain = Plain([t for _, t in corpus(2, 60)])
    for u in ["</s>", "the", "w1", "unseen"]:
        assert sum(plain.p(w, u) for w in [*plain.c, "unknown"]) == pytest.approx(1)


def test_pack():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        a, b = np.unique(r.integers(0, 2**62, n)), r.integers(0, 9, n).astype(np.uint8)
        b = b[: len(a)]
        x, y = kn.unpack(kn.pack(a, b))
        assert (x == a).all() and (y == b).all() and (x.dtype, y.dtype) == (a.dtype, b.dtype)


def test_discounts_stay_in_range():
    for n in ([0, 0, 0, 0], [5, 0, 0, 0], [10, 4, 2, 1], [1, 9, 99, 999]):
        assert all(0 < d < k for k, d in enumerate(kn.discounts(n), 1))


def test_empty_and_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if in_fold0(i))
    (g,) = kn.score(d := frame(spark, [(held, "a b")]), kn.train(d)).collect()
    assert (g["train_tokens"], g["n_known"], g["base_score"], g["score"]) == (0, 0, 0.0, 0.0)
    assert kn.score(d.filter("false"), kn.train(d.filter("false"))).collect() == []


def test_tasks_without_rows(spark):
    rows = corpus(3, 12)
    few, many = (kn.score(d, kn.train(d)).collect() for d in (frame(spark, rows).coalesce(1), frame(spark, rows).repartition(40)))
    key = lambda g: (str(g["doc_id"]), g["n_tokens"], round(g["score"], 9))
    assert sorted(map(key, few)) == sorted(map(key, many))


def test_many_shards_with_few_descriptors(tmp_path):
    import resource

    for k in range(3000):
        kn.save(f"file://{tmp_path}", f"hash-{k}", np.arange(k, k + 50, dtype=np.uint64))
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (min(1024, hard), hard))
    try:
        arrays = kn.Arrays(f"file://{tmp_path}")
        for _ in range(2):
            assert all(arrays.get(f"hash-{k}")[3] == k + 3 for k in range(3000))
        assert len(arrays.open) == kn.MAX_OPEN
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))


def test_files_that_cannot_be_mapped_are_read(tmp_path, monkeypatch):
    monkeypatch.setattr(kn, "MAX_HELD", 820)
    kn.save(f"file://{tmp_path}", "a", np.arange(100))
    kn.save(f"file://{tmp_path}", "b", np.arange(7))
    arrays = kn.Arrays(f"file://{tmp_path}")
    arrays.mounted = False
    assert arrays.get("a").sum() == 4950 and arrays.get("b").sum() == 21 and list(arrays.open) == ["b"] and arrays.held == 56


def test_long_texts_in_pieces(spark, monkeypatch):
    from lodestrata.llm import common

    rows = corpus(4, 40)
    whole = kn.score(frame(spark, rows), kn.train(frame(spark, rows))).collect()
    monkeypatch.setattr(common, "PIECE_CHARS", 20)
    monkeypatch.setattr(kn, "RUN_TOKENS", 30)
    d = frame(spark, rows)
    assert list(kn.token_parts(rows[0][1]))[-1][-1] == kn.END and sum(map(len, kn.token_parts("a b"))) == 3
    scorer_runs = [sum(n.sum() for _, n, _ in kn._runs([t])) for _, t in rows]
    assert scorer_runs == [len(toks(t)) for _, t in rows]
    key = lambda g: (str(g["doc_id"]), g["n_tokens"], g["n_known"], round(g["score"], 8), round(g["base_score"], 8))
    assert sorted(map(key, kn.score(d, kn.train(d)).collect())) == sorted(map(key, whole))


def test_query_leaves_no_model_behind(spark, tmp_path):
    import os

    frame(spark, corpus(5, 30)).drop("score").write.parquet(f"{tmp_path}/documents.parquet")
    from lodestrata.llm import common

    root = common.shared_root(spark).removeprefix("file:")
    models = lambda: {x for x in os.listdir(root) if x.startswith("bigrams")}
    before = models()
    assert kn.query(spark, str(tmp_path)).count() == 36
    assert models() == before
