"""The automaton against greedy search, and a word-piece tokenizer's own counts."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import wordpiece as wp

letters = st.text("abcd", min_size=1, max_size=6)


@settings(max_examples=400, deadline=None)
@given(st.sets(letters, max_size=14), st.sets(letters, max_size=14), st.lists(st.text("abcde", max_size=14), max_size=12))
def test_automaton_is_greedy(starts, rest, words):
    a = wp.Automaton(starts, rest)
    assert [a.count(w) for w in words] == [wp.greedy(w, starts, rest) for w in words]


def test_against_a_word_piece_model():
    tokenizers = pytest.importorskip("tokenizers")
    r = random.Random(1)
    vocab = ["[UNK]", *"abcé", *("##" + c for c in "abcé")] + sorted({r.choice(["", "##"]) + "".join(r.choice("abcé") for _ in range(r.randrange(2, 6))) for _ in range(120)})
    model = tokenizers.models.WordPiece({p: i for i, p in enumerate(vocab)}, unk_token="[UNK]", max_input_chars_per_word=10_000)
    starts, rest = wp.pieces_of(vocab[1:])
    a = wp.Automaton(starts, rest)
    for _ in range(800):
        w = "".join(r.choice("abcéx" if r.random() < 0.1 else "abcé") for _ in range(r.randrange(1, 40)))
        assert a.count(w) == len(model.tokenize(w))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_words long")


def test_token_counts(spark, monkeypatch):
    monkeypatch.setattr(wp, "CACHE", 5)
    r = random.Random(2)
    starts, rest = {"ab", "a", "b", "!", "x"}, {"a", "b", "ba", "abab"}
    rows = [(i, " ".join("".join(r.choice("abxAB!") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(30)))) for i in range(60)]
    rows += [(70, None), (71, ""), (None, "ab"), (1, rows[1][1]), (72, "ab" * 100_000)]
    got = wp.token_counts(frame(spark, rows), starts, rest).collect()
    want = sorted(((i, len(wp.words_of(t)), sum(wp.greedy(w, starts, rest) for w in wp.words_of(t) if len(w) < 1000)) for i, t in rows if i != 72), key=str)
    assert sorted(((g["doc_id"], g["n_words"], g["n_tokens"]) for g in got if g["doc_id"] != 72), key=str) == want
    assert wp.token_counts(frame(spark, []), starts, rest).collect() == []


@pytest.mark.skipif(not os.path.exists(os.path.join(wp.TOKENIZERS, wp.VOCABULARY)), reason="no vocabulary file here")
def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    starts, rest, form = wp.load(os.path.join(wp.TOKENIZERS, wp.VOCABULARY))
    assert form == wp.Form(byte_level=True, spaced=True, lower=False)
    got = {g["doc_id"]: g for g in wp.query(spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        counts = [wp.greedy(form.spell(w), starts, rest) for w in form.words(d["text"])]
        assert got[d["doc_id"]]["n_unknown"] == 0
        assert got[d["doc_id"]]["n_tokens"] == sum(counts) and got[d["doc_id"]]["n_words"] == len(wp.words_of(d["text"]))


@pytest.mark.skipif(not os.path.exists(os.path.join(wp.TOKENIZERS, wp.VOCABULARY)), reason="no vocabulary file here")
def test_marks_are_conditions():
    starts, rest, form = wp.load(os.path.join(wp.TOKENIZERS, wp.VOCABULARY))
    a = wp.Automaton(starts, rest)
    # a blank belongs to the word after it; without one the marked piece doesn't fit
    assert form.words("Hello, hello  x") == ["Hello", ",", " hello", " x"]
    assert " hello" in starts and a.count(form.spell(" hello")) == 1 and a.count(form.spell("\U0001f600")) > 1
    starts, rest, form = wp.load(os.path.join(wp.TOKENIZERS, "word_bpe_49k.json"))
    assert form == wp.Form(byte_level=True, ended=True) and form.spell("é") == "\xc3\xa9" + wp.END
    a = wp.Automaton(starts, rest)
    for w in ("the", "unbelievable", "zzzzz", "a"):
        assert a.count(form.spell(w)) == wp.greedy(form.spell(w), starts, rest)


def test_pieces_change_nothing(spark, monkeypatch):
    from lodestrata.llm import common

    rows = [(i, "ab  a b!x\tAB " * i) for i in range(9)]
    form = wp.Form(spaced=True)
    count = lambda: [tuple(g) for g in wp.token_counts(frame(spark, rows), {"ab", " a", "a", "b", " "}, {"b", "a"}, form).orderBy("doc_id").collect()]
    want = count()
    monkeypatch.setattr(common, "PIECE_CHARS", 6)
    assert sum((form.words(p) for p in common.pieces(rows[8][1])), []) == form.words(rows[8][1])
    assert count() == want
