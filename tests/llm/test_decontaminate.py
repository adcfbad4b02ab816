"""Decontamination: hits against a plain scan, blocks, removal."""

import random
import re

import pytest

from lodestrata.llm import decontaminate as dc


def plain_words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(text, items):
    words, mark, names = plain_words(text), set(), set()
    for name, it in items:
        iw = plain_words(it)
        k = min(13, len(iw))
        wins = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in wins:
                mark |= set(range(i, i + k))
                names.add(name)
    return len(words), len(mark), sorted(names)


def corpus(seed):
    r = random.Random(seed)
    vocab = ["the", "Ünï", "a1", "x", "of", "no"] + [f"w{i}" for i in range(30)]
    items = [(str(i), " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(25)]
    items += [("1", "w1 w2!!w3"), ("", "w7 w7 w7 w7"), ("z", None), ("rep", "a " * 30)]
    docs = []
    for i in range(60):
        parts = [r.choice(vocab) for _ in range(r.choice([0, 5, 60]))]
        for _ in range(r.randrange(3)):
            iw = plain_words(r.choice(items)[1])
            if iw:
                s = r.randrange(len(iw))
                at = r.randrange(len(parts) + 1)
                parts[at:at] = iw[s : s + r.choice([13, 20, 99])]
        docs.append((i, r.choice([" ", ", ", "\n--"]).join(parts).upper() if i % 3 else " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, "!!"), (0, docs[0][1]), (None, docs[1][1]), (103, "a " * 50)], items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*x, "l", 1, "i") for x in docs], "doc_id long, text string, lang string, n_words long, item_id string")
    return d, spark.createDataFrame(items or [("x", "y")], "item_id string, text string").filter("true" if items else "false")


@pytest.mark.parametrize("run_words", [1, 400_000])
def test_scan(run_words, monkeypatch):
    monkeypatch.setattr(dc, "RUN_WORDS", run_words)
    docs, items = corpus(1)
    got = list(dc.Index([(n, t) for n, t in items]).scan_texts(t for _, t in docs))
    for (_, t), (n, h, names, spans) in zip(docs, got, strict=True):
        assert (n, h, names) == brute(t, items)
        assert sum(b - a for a, b in spans) == h


@pytest.mark.parametrize("max_bytes", [dc.MAX_INDEX_BYTES, 300])
def test_hits(spark, max_bytes):
    docs, items = corpus(2)
    d, b = frames(spark, docs, items)
    got = dc.hits(d, b, max_bytes).collect()
    key = lambda x: str(x)
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=key)
    assert sorted(((g["doc_id"], g["n_words"], g["n_hit"], g["items"]) for g in got), key=key) == want
    assert all(g["contaminated"] == (g["n_hit"] > 0 and 20 * g["n_hit"] >= g["n_words"]) for g in got)


def test_remove(spark):
    docs, items = corpus(3)
    d, b = frames(spark, docs, items)
    clean = [(i, t) for i, t in docs if not (brute(t, items)[1] and 20 * brute(t, items)[1] >= brute(t, items)[0])]
    for max_bytes in (dc.MAX_INDEX_BYTES, 300):
        kept = dc.remove(d, b, max_bytes=max_bytes)
        assert kept.columns == d.columns
        got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
        assert got == sorted(clean, key=str)
    long_items = [(n, t) for n, t in items if len(plain_words(t)) >= 13]
    cut = dc.remove(d, frames(spark, docs, long_items)[1], how="spans").collect()
    assert len(cut) == len(docs)
    assert dc.cut("A, b; C d", [(1, 3)]) == "A,  d"


def test_empty(spark):
    docs, _ = corpus(4)
    d, none = frames(spark, docs, [])
    assert all(g["n_hit"] == 0 and not g["contaminated"] for g in dc.hits(d, none).collect())
    assert dc.hits(d.filter("false"), none).collect() == []


@pytest.mark.parametrize("max_bytes", [dc.MAX_INDEX_BYTES, 600])
def test_spans_of_all_blocks_are_cut_once(spark, max_bytes):
    docs, items = corpus(5)
    d, b = frames(spark, docs, items)
    got = dc.remove(d, b, how="spans", max_bytes=max_bytes)
    assert got.columns == d.columns
    index = dc.Index(items)
    want = []
    for (i, t), (_, _, _, spans) in zip(docs, index.scan_texts(t for _, t in docs), strict=True):
        want.append((i, dc.cut(t, spans) if spans else t))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_long_texts_and_items_in_pieces(monkeypatch, spark):
    from lodestrata.llm import common

    monkeypatch.setattr(common, "PIECE_CHARS", 40)
    docs, items = corpus(6)
    for (_, t), (n, h, names, spans) in zip(docs, dc.Index(items).scan_texts(t for _, t in docs), strict=True):
        assert (n, h, names) == brute(t, items) and sum(b - a for a, b in spans) == h
    d, b = frames(spark, docs, items)
    assert len(list(dc.indexes(b, 300))) > 2
    got = {(g["doc_id"], g["n_words"], g["n_hit"], *g["items"]) for g in dc.hits(d, b, 300).collect()}
    assert got == {(i, n, h, *names) for i, t in docs for n, h, names in [brute(t, items)]}


def test_index_is_of_arrays_and_pickles_small():
    import pickle

    r = random.Random(1)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(20_000)]
    items = [(str(i), " ".join(r.choice(vocab) for _ in range(400))) for i in range(900)]
    text = sum(len(t) for _, t in items)
    index = dc.Index(items)
    assert index.nbytes - (1 << 20) < 8 * text and len(pickle.dumps(index)) < index.nbytes + 200_000


def test_one_window_of_many_items():
    line = " ".join(f"w{i}" for i in range(13))
    index = dc.Index([(str(i), f"{line} tail{i}") for i in range(500)])
    ((n, h, names, spans),) = index.scan_texts([f"{line} {line} x"])
    assert (n, h, spans) == (27, 26, [(0, 26)]) and names == sorted(map(str, range(500)))


def test_parts_of_an_item_have_its_windows():
    text = ", ".join(f"w{i}" for i in range(40)) + " " * 200
    wins = lambda t: {tuple(w[i : i + 13]) for w in [plain_words(t)] for i in range(len(w) - 12)}
    parts = [p for _, p, _ in dc._parts("x", text, 30)]
    assert len(parts) > 3 and set.union(*map(wins, parts)) == wins(text) and all(len(plain_words(p)) >= 13 for p in parts)
    assert [plain_words(p) for _, p, _ in dc._parts("x", "a " * 5 + " " * 100 + "b", 10)] == [["a"] * 5 + ["b"]]


def test_a_text_of_50_mb(monkeypatch):
    import resource

    r = random.Random(2)
    line = " ".join(f"w{i}" for i in range(13))
    block = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20_000))
    text = f"{line} " + f"{block} " * 360 + line
    index = dc.Index([("a", line)])
    list(index.scan_texts([block]))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ((n, h, names, spans),) = index.scan_texts([text])
    assert len(text) > 50_000_000 and (n, h, names) == (360 * 20_000 + 26, 26, ["a"]) and spans == [(0, 13), (n - 13, n)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 250_000
