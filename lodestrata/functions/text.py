
from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANSWER_TAG = "Answer:"
END_MARK = "<|eot|>"
LOOKUP_OPEN, LOOKUP_CLOSE = "<|db_start|>", "<|db_retrieve|>"


def _nfkc(s: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", s).split())


@F.pandas_udf(T.StringType())
def display_form(s: pd.Series) -> pd.Series:
    """NFKC with white space collapsed, case kept. There is no native Unicode normalization."""
    return s.map(_nfkc, na_action="ignore")


@F.pandas_udf(T.StringType())
def alias_key(s: pd.Series) -> pd.Series:
    """NFKC, white space collapsed, casefolded: the key under which aliases collide."""
    return s.map(lambda x: _nfkc(x).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """NFC form, for the exact scorers."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def collapsed(c: Column) -> Column:
    """Unicode white space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def store_key(c: Column) -> Column:
    """Lower case with white space collapsed."""
    return collapsed(F.lower(c))


def answer_key(c: Column) -> Column:
    """F1d: as the store key, without one trailing period."""
    return F.trim(F.regexp_replace(store_key(c), r"\.$", ""))


def parsed_answer(c: Column) -> Column:
    """the text after the last ``Answer:`` up to a line end or the end mark, stripped; null without a tag, empty if blank."""
    rest = F.substring_index(c, ANSWER_TAG, -1)
    rest = F.substring_index(F.substring_index(rest, "\n", 1), END_MARK, 1)
    return F.when(F.contains(c, F.lit(ANSWER_TAG)), F.trim(F.regexp_replace(rest, r"(?U)^\s+|\s+$", "")))


def key_status(c: Column) -> Column:
    """ok, no_lookup or malformed: whether a whole lookup was opened and closed."""
    after = F.substring(c, F.instr(c, LOOKUP_OPEN) + len(LOOKUP_OPEN), F.length(c))
    return (
        F.when(F.instr(c, LOOKUP_OPEN) == 0, "no_lookup").when(F.instr(after, LOOKUP_CLOSE) == 0, "malformed").otherwise("ok")
    )


def emitted_key(c: Column) -> Column:
    """the stripped key of the first lookup; null unless its status is ok."""
    after = F.substring(c, F.instr(c, LOOKUP_OPEN) + len(LOOKUP_OPEN), F.length(c))
    return F.when(key_status(c) == "ok", F.trim(F.regexp_replace(F.substring_index(after, LOOKUP_CLOSE, 1), r"(?U)^\s+|\s+$", "")))


def key_halves(key: Column) -> tuple[Column, Column]:
    """(name, relation) on either side of the last ``, ``; without one all of it is the name."""
    relation = F.substring_index(key, ", ", -1)
    split = F.instr(key, ", ") > 0
    return F.when(split, F.substring(key, F.lit(1), F.length(key) - F.length(relation) - 2)).otherwise(key), F.when(split, relation).otherwise(F.lit(""))


def key_score(subject: Column, prop: Column, answers: Column, prompt: Column, text: Column) -> Column:
    """struct(status, name_ok, rel_ok, full_ok, answer_ok, name_error_class) of a generated text against the gold key."""
    status, key = key_status(text), emitted_key(text)
    name, relation = key_halves(key)
    ok = status == "ok"
    name_ok = F.coalesce(ok & (store_key(name) == store_key(subject)), F.lit(False))
    rel_ok = F.coalesce(ok & (store_key(relation) == store_key(prop)), F.lit(False))
    full_ok = F.coalesce(ok & (store_key(key) == store_key(F.concat_ws(", ", subject, prop))), F.lit(False))
    said = F.coalesce(store_key(name), F.lit(""))
    in_context = (said != "") & F.contains(store_key(prompt), said) & (said != store_key(subject))
    wrong = F.when(~name_ok, F.when(in_context, "in_context_wrong_name").otherwise("out_of_context_name"))
    answer_ok = F.exists(answers, lambda a: F.contains(store_key(text), store_key(a)))
    return F.struct(status.alias("status"), name_ok.alias("name_ok"), rel_ok.alias("rel_ok"), full_ok.alias("full_ok"), answer_ok.alias("answer_ok"), wrong.alias("name_error_class"))


def key_taxonomy(status: Column, key: Column, gold_subject: Column, gold_prop: Column) -> Column:
    """Correct, same_name, other, malformed or none."""
    name, _ = key_halves(key)
    return (
        F.when(status == "no_lookup", "none")
        .when(status == "malformed", "malformed")
        .when(store_key(key) == store_key(F.concat_ws(", ", gold_subject, gold_prop)), "correct")
        .when(store_key(name) == store_key(gold_subject), "same_name")
        .otherwise("other")
    )


def long_date(c: Column) -> Column:
    """a date as January 1, 1930."""
    return F.date_format(c, "MMMM d, y")


def from_long_date(c: Column) -> Column:
    """the date of January 1, 1930; null if it isn't one."""
    return F.expr(f"cast(try_to_timestamp({_sql(c)}, 'MMMM d, y') as date)") if isinstance(c, str) else F.try_to_timestamp(c, F.lit("MMMM d, y")).cast("date")


def _sql(name: str) -> str:
    return f"`{name}`"


def whole_word_replaced(text: Column, word: Column, by: Column) -> Column:
    """every occurrence of a literal word that no letter, digit or underscore adjoins, replaced by a literal."""
    pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), word, F.lit(r"\E(?!\w)"))
    return F.regexp_replace(text, pattern, F.regexp_replace(by, r"([\\$])", r"\\$1"))


def snapshot_step(name: Column) -> Column:
    """the step in the name of a snapshot, ``step`` and digits; null without."""
    return F.nullif(F.regexp_extract(name, r"step_?0*([0-9]+)", 1), F.lit("")).cast("long")


def reserved_handles(text: Column) -> Column:
    """all numbers written as Q and digits in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\bQ([0-9]{1,18})\b"), F.lit(1)), lambda x: x.cast("long"))


# What may be taken off a span's ends, and the endings of possessives.
SPAN_MARKS = ".,?!:;'\"()[]"
POSSESSIVES = ("'s", "\u2019s")
_MARK = rf"[{re.escape(SPAN_MARKS)}]"
_FRONT, _BACK = re.compile(rf"{_MARK}\s*"), re.compile(rf"\s*{_MARK}$")


def _cuts(s: str, front: bool) -> list[int]:
    """Where a span may begin (or end) as the marks at that end are taken off one by one."""
    at = [0 if front else len(s)]
    while m := _FRONT.match(s, at[-1]) if front else _BACK.search(s, 0, at[-1]):
        at.append(m.end() if front else m.start())
    return at


def spans_of(prompt: str | None, max_words: int = 10, max_chars: int = 60) -> list[str]:
    """candidate spans in order of length and place: word n-grams with any number of marks taken off each end, and those of possessives' bases.

    Spans without a letter or digit and those over max_chars are left out; each counts once.
    """
    words, seen = (prompt or "").split(), {}
    for n in range(1, max_words + 1):
        for gram in (" ".join(words[i : i + n]) for i in range(len(words) - n + 1)):
            for span in (gram[a:b] for a in _cuts(gram, True) for b in _cuts(gram, False) if a < b):
                base = next((span[: -len(x)].rstrip() for x in POSSESSIVES if span.endswith(x)), None)
                for form in [span, *(base[:b] for b in _cuts(base, False))] if base else [span]:
                    if len(form) <= max_chars and any(c.isalnum() for c in form):
                        seen.setdefault(form)
    return list(seen)


@F.pandas_udf(T.ArrayType(T.StringType()))
def allowed_spans(prompt: pd.Series) -> pd.Series:
    """``spans_of`` each prompt."""
    return prompt.map(spans_of)


@F.pandas_udf(T.StringType())
def slots_rebound(prompt: pd.Series, slot: pd.Series, name: pd.Series) -> pd.Series:
    """the sentence that binds a slot, ``Slot n refers to X``, bound to another name."""
    return pd.Series([None if p is None else re.sub(rf"(?i)\bslot {int(s)} refers to (\S+?)(?=[.,;]?(\s|$))", lambda m, n=n: m[0][: -len(m[1])] + n, p) for p, s, n in zip(prompt, slot, name, strict=True)])
