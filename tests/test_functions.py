"""Column functions on hand-written rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import codecs, hashing, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_alias_keys(spark):
    rows = spark.createDataFrame([("ﬁ",), ("FI",), (" Straße ",), ("STRASSE",), ("a  b",), (None,)], "s string")
    got = [tuple(r) for r in rows.select(text.alias_key("s"), text.display_form("s")).collect()]
    assert got == [("fi", "fi"), ("fi", "FI"), ("strasse", "Straße"), ("strasse", "STRASSE"), ("a b", "a b"), (None, None)]


@pytest.mark.parametrize(
    ("said", "answer", "key"),
    [("x", None, None), ("Answer:", "", ""), ("Answer: a\nAnswer:  B  c. \nz", "B  c.", "b c"), ("Answer: y<|eot|>q", "y", "y"), ("Answer: 3.5.", "3.5.", "3.5")],
)
def test_answers(spark, said, answer, key):
    got = text.parsed_answer(F.lit(said))
    assert one(spark, got, text.answer_key(got)) == (answer, key)


@pytest.mark.parametrize(
    ("said", "status", "key"),
    [("none", "no_lookup", None), ("a <|db_start|> k", "malformed", None), ("<|db_retrieve|><|db_start|> N, x, p <|db_retrieve|> <|db_start|>z", "ok", "N, x, p"), ("<|db_start|><|db_retrieve|>", "ok", "")],
)
def test_keys(spark, said, status, key):
    assert one(spark, text.key_status(F.lit(said)), text.emitted_key(F.lit(said))) == (status, key)


def test_key_halves_and_scores(spark):
    assert one(spark, *text.key_halves(F.lit("a, b, c"))) == ("a, b", "c")
    assert one(spark, *text.key_halves(F.lit("abc"))) == ("abc", "")
    lit = F.lit
    score = lambda t, p="Tell of Ann": one(spark, text.key_score(lit("Bob"), lit("city"), F.array(lit("Rome")), lit(p), lit(t)))[0]
    s = score("<|db_start|>BOB,  City<|db_retrieve|> ROME!")
    assert (s["status"], s["name_ok"], s["rel_ok"], s["full_ok"], s["answer_ok"], s["name_error_class"]) == ("ok", True, True, True, True, None)
    assert score("<|db_start|>Ann, city<|db_retrieve|>")["name_error_class"] == "in_context_wrong_name"
    assert score("<|db_start|>Eve, city<|db_retrieve|>")["name_error_class"] == "out_of_context_name"
    assert score("nothing")["name_error_class"] == "out_of_context_name"


def test_dates_words_and_spans(spark):
    assert one(spark, text.long_date(F.lit("1930-01-01").cast("date")), text.from_long_date(F.lit("January 1, 1930")).cast("string"), text.from_long_date(F.lit("1930"))) == ("January 1, 1930", "1930-01-01", None)
    assert one(spark, text.whole_word_replaced(F.lit("Al. met Al.x and xAl., Al."), F.lit("Al."), F.lit("$Bo"))) == ("$Bo met Al.x and xAl., $Bo",)
    spans = text.spans_of("Is (Ann)'s car?")
    assert {"Is", "(Ann)'s", "Ann", "car", "Is (Ann)'s car"} <= set(spans) and len(spans) == len(set(spans))
    assert text.spans_of("Home Free!?", 2) == ["Home", "Free!?", "Free!", "Free", "Home Free!?", "Home Free!", "Home Free"]
    assert text.spans_of("F.C.’s -- !", 1) == ["F.C.’s", "F.C.", "F.C"] and text.spans_of(None) == [] and text.spans_of("x" * 61) == []
    assert one(spark, text.reserved_handles(F.lit("Q12 xQ3 Q4x Q05"))) == ([12, 5],)
    rows = spark.createDataFrame([("Slot 0 refers to Q1. Go.", 0, "Q9"), ("Slot 1 refers to Q1.", 0, "Q9")], "p string, s int, n string")
    assert [r[0] for r in rows.select(text.slots_rebound("p", "s", "n")).collect()] == ["Slot 0 refers to Q9. Go.", "Slot 1 refers to Q1."]
    assert one(spark, text.snapshot_step(F.lit("dense_step0015582.json")), text.snapshot_step(F.lit("x"))) == (15582, None)


def test_hashes(spark):
    path = F.array(F.lit("P1"), F.lit("P2"))
    want = hashlib.sha256(json.dumps(["P1", "P2"], separators=(",", ":")).encode()).hexdigest()
    assert one(spark, hashing.composition_hash(path), hashing.composition_bucket(path)) == (want, int(want[:8], 16) % 100)
    key = hashlib.sha256(b"k\0alias\x003").digest()
    assert one(spark, hashing.chosen(F.lit("k"), "alias", F.lit("3"), 7)) == (int.from_bytes(key[:8], "big") % 7,)
    assert one(spark, hashing.root_key("s", F.lit(5), F.lit("P1"))) == (hashlib.sha256(b"s\x005\x00P1").hexdigest(),)
    got = spark.createDataFrame([([1, 65535, 7],)], "t array<int>").select(hashing.token_bytes("t")).first()[0]
    assert bytes(got) == b"\x01\x00\xff\xff\x07\x00"


def test_codecs(spark):
    f = codecs.action_frame(F.lit(2), F.lit(0xABC), F.lit(False), F.lit(True), F.lit(False))
    frame, parsed = one(spark, f, codecs.parsed_frame(f))
    assert frame == ["<act>", "2", "10", "11", "12", "out", "read", "</act>"]
    assert tuple(parsed) == (2, 0xABC, False, "read")
    bad = F.array(*[F.lit(x) for x in ["<act>", "9", "1", "1", "1", "out", "read", "</act>"]])
    assert one(spark, codecs.parsed_frame(bad), codecs.parsed_frame(F.array(F.lit("<act>")))) == (None, None)
    assert one(spark, codecs.action_plan(F.array(F.lit("P1"))), codecs.action_plan(F.array(*[F.lit("P1")] * 6))) == (["read:P1", "halt", "noop", "noop", "noop", "noop"], ["read:P1"] * 6)
    assert one(spark, codecs.half_up_ratio(F.lit(1), F.lit(2), 1), codecs.half_up_ratio(F.lit(1), F.lit(3), 10), codecs.position_bin(F.lit(9), F.lit(10), F.lit(10))) == (1, 3, 9)
