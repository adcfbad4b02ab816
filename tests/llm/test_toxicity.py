"""Toxicity: held-out accuracy, the effect of the counterfactual pairs, odd rows."""

import random
import zlib

import pytest

from lodestrata.llm import toxicity as tx


def rows(n=1200, seed=3):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re") for b in ("lan", "dor", "vis", "per", "mon", "ti")]
    docs, labels = [], []
    for i in range(n):
        y = int(r.random() < 0.3)
        words = [r.choice(vocab) for _ in range(r.randrange(5, 60))]
        if y:
            words[r.randrange(len(words))] = r.choice(["idiot", "scum", "hassen", "hasste"])
        if r.random() < (0.6 if y else 0.1):
            words.insert(0, "women")
        docs.append((i, " ".join(words), "en", "s", 5, 1.5))
        labels.append((i, 0, y))
    return docs, labels


def frames(spark, docs, labels):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = rows()
    extra = [(5000, None, None, None, None, None), (5001, "", "en", "s", 0, 0.0), (None, "scum", "en", "s", 0, 0.0), (5002, "word " * 200_000 + "IDIOT!!", "en", "s", 0, 0.0), docs[0]]
    d, lab = frames(spark, docs + extra, labels + [(None, 0, 1), (7, 0, None), labels[0]])
    got = tx.score(d, tx.fit(d, lab)).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: y for i, _, y in labels}
    held = [g for g in got if g["held_out"] and g["doc_id"] in truth]
    assert held and all((zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0) == g["held_out"] for g in got if g["doc_id"] is not None)
    assert sum(g["predicted"] == truth[g["doc_id"]] for g in held) / len(held) > 0.97
    by = {g["doc_id"]: g for g in got}
    assert by[5000]["score"] == by[5001]["score"] and by[5002]["predicted"] == 1 and by[None]["predicted"] == 1
    assert all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.5) for g in got)


def test_counterfactual_pairs_lower_the_weight_of_groups():
    docs, labels = rows()
    xs, ys, swaps = [], [], []
    features = ["w:women", "w:men", "w:idiot", "w:scum"]
    v = tx.Vocabulary(features)
    for (_, t, *_), (_, _, y) in zip(docs, labels, strict=True):
        xs.append(sorted(v.indices(tx.words_of(t))))
        ys.append(y)
        swaps += [((sorted(v.indices(p) - v.indices(q)), sorted(v.indices(q) - v.indices(p))), 1) for p, q in tx.counterfactuals(t)]
    with_, without = tx.train(features, xs, ys, swaps), tx.train(features, xs, ys, [])
    gap = lambda m: abs(m.weights[0] - m.weights[1])
    assert gap(with_) < 0.35 * gap(without)
    assert with_.weights[2] > 1 and with_.scorer()("the women meet") < without.scorer()("the women meet")


def test_swaps():
    assert list(tx.counterfactuals("Women sang. None here! The black cat")) == [(["women", "sang"], ["men", "sang"]), (["the", "black", "cat"], ["the", "white", "cat"])]
    assert list(tx.counterfactuals(None)) == []


@pytest.mark.parametrize("which", ["none", "one_label"])
def test_too_few_labels(spark, which):
    docs, labels = rows(60)
    d, lab = frames(spark, docs, [] if which == "none" else [(i, 0, 0) for i, _, _ in labels])
    got = tx.score(d, tx.fit(d, lab)).collect()
    assert len(got) == 60 and {g["predicted"] for g in got} == {0}
    assert tx.score(d.filter("false"), tx.fit(d.filter("false"), lab)).collect() == []


def test_reject(spark, tmp_path):
    docs, labels = rows(600)
    d, lab = frames(spark, docs, labels)
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    kept = tx.reject(spark, d, str(tmp_path))
    assert kept.schema == d.schema
    ids = {r["doc_id"] for r in kept.collect()}
    toxic = {i for i, _, y in labels if y}
    assert len(ids & toxic) <= 0.03 * len(toxic) and len(ids) >= 0.97 * (600 - len(toxic))


def test_reject_keeps_what_the_score_keeps(spark, tmp_path):
    docs, labels = rows(400, 8)
    d, lab = frames(spark, docs + [(900, None, None, None, None, None), (901, "", "en", "s", 0, 0.0)], labels)
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    kept = sorted(r["doc_id"] for r in tx.reject(spark, d, str(tmp_path)).collect())
    assert kept == sorted(r["doc_id"] for r in tx.score(d, tx.fit(d, lab)).collect() if r["score"] < 0.5)


def test_counted_pairs_weigh_as_single_ones(monkeypatch):
    xs, ys = [[0, 2], [1], [0], [2], [1, 2]], [1, 0, 1, 0, 0]
    one = [(((0,), (1,)), 1)] * 3 + [(((2,), ()), 1)]
    several = [(((0,), (1,)), 3), (((2,), ()), 1)]
    a, b = tx.train(list("abc"), xs, ys, one), tx.train(list("abc"), xs, ys, several)
    assert a.weights == pytest.approx(b.weights) and a.bias == pytest.approx(b.bias)


def test_pieces_change_nothing(monkeypatch):
    from lodestrata.llm import common

    text = "The IDIOT and  the women\n" * 20
    want = tx.distinct_words(text)
    monkeypatch.setattr(common, "PIECE_CHARS", 9)
    assert tx.distinct_words(text) == want == set(tx.words_of(text))
