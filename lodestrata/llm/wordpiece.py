"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces of a word are counted in one walk over its
characters: a trie of the vocabulary whose nodes have failure links, and for each link
the number of pieces that taking it pops. No piece is built and no character is read twice.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, short_batches, table

#: Where the public vocabularies are; a parameter of ``query``.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Marks a piece that continues a word, in vocabularies given as lists of pieces.
CONTINUED = "##"
#: Words whose counts a worker remembers.
CACHE = 300_000
#: Words are runs of letters, marks and digits, or single other characters; white space parts them.
_WORD, _SPACED = re.compile(r"[^\W_]+|[^\w\s]|_"), re.compile(r" ?(?:[^\W_]+|[^\w\s]|_)")
#: The end of a word, where a vocabulary marks it: no byte and no letter.
END = "\U0010ffff"


class Automaton:
    """Counts the greedy longest-match pieces of words.

    ``starts`` are the pieces that may begin a word, ``rest`` those that may
    continue one. A word that can't be cut whole counts as one unknown piece.
    """

    def __init__(self, starts: Iterable[str], rest: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0: before a word; node 1: between two pieces
        self.piece = [False, False]
        for root, pieces in ((0, starts), (1, rest)):
            for p in pieces:
                if p:
                    self.piece[self._node(root, p)] = True
        n = len(self.next)
        #: The node to go on from when a character doesn't match, -1 for none; and the pieces popped on the way there.
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque((child, 0, c) for c, child in self.next[0].items())
        queue.extend((child, 1, c) for c, child in self.next[1].items())
        while queue:
            node, parent, c = queue.popleft()
            if self.piece[node]:
                # all of it is one piece
                self.fail[node], self.popped[node] = 1, 1
            else:
                z, popped = self.fail[parent], self.popped[parent]
                while z >= 0 and c not in self.next[z]:
                    popped += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[node], self.popped[node] = self.next[z][c], popped
            queue.extend((child, node, d) for d, child in self.next[node].items())

    def _node(self, at: int, piece: str) -> int:
        for c in piece:
            following = self.next[at].get(c)
            if following is None:
                following = self.next[at][c] = len(self.next)
                self.next.append({})
                self.piece.append(False)
            at = following
        return at

    def count(self, word: str) -> int:
        """The pieces of one word: 1 if it can't be cut, 0 if it is empty."""
        if not word:
            return 0
        following, fail, popped = self.next, self.fail, self.popped
        node = pieces = 0
        for c in word:
            to = following[node].get(c)
            while to is None:
                pieces += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
                to = following[node].get(c)
            node = to
        # the end of the word takes the remaining links down to the node between pieces
        while node != 1:
            pieces += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return pieces


def greedy(word: str, starts: set[str], rest: set[str]) -> int:
    """The same count by trying the longest piece at every place; what the automaton is held against."""
    at = pieces = 0
    while at < len(word):
        among = starts if at == 0 else rest
        end = next((e for e in range(len(word), at, -1) if word[at:e] in among), 0)
        if not end:
            return 1
        at, pieces = end, pieces + 1
    return pieces


def pieces_of(vocabulary: Iterable[str], continued: str = CONTINUED) -> tuple[set[str], set[str]]:
    """(starts, rest) of a vocabulary in which ``continued`` marks the pieces that continue a word."""
    starts, rest = set(), set()
    for p in vocabulary:
        (rest.add(p[len(continued) :]) if p.startswith(continued) and len(p) > len(continued) else starts.add(p))
    return starts, rest


def byte_letters() -> dict[str, str]:
    """The letters by which byte-level vocabularies write bytes, to the bytes as Latin-1: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(others)}


def as_bytes(word: str) -> str:
    """A word with a character for each of its UTF-8 bytes."""
    return word.encode("utf-8", "replace").decode("latin-1")


@dataclass(frozen=True)
class Form:
    """How a vocabulary writes words: whether in bytes, with the blank before them, with a mark at their end, in lower case."""

    byte_level: bool = False
    spaced: bool = False
    ended: bool = False
    lower: bool = True

    def words(self, text: str) -> list[str]:
        """The words of a text or of a piece of one; a spaced form keeps the one blank that stands before a word."""
        return (_SPACED if self.spaced else _WORD).findall(text.lower() if self.lower else text)

    def spell(self, word: str) -> str:
        """What pieces are matched against."""
        return (as_bytes(word) if self.byte_level else word) + (END if self.ended else "")


@lru_cache(2)
def load(path: str) -> tuple[frozenset[str], frozenset[str], Form]:
    """(starts, rest, form) of a tokenizer's JSON file; read on the driver, as workers need not have it.

    The vocabulary's marks are kept as conditions: the mark of a word's end is a
    character that only the end of a word has, the blank of byte-level vocabularies without such a mark is one that only
    a word after a blank has, and a prefix of continuing pieces tells starts from the rest. Pieces of
    byte-level vocabularies are returned with a character for each byte.
    """
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    mark, end = model.get("continuing_subword_prefix") or "", model.get("end_of_word_suffix") or ""
    special = {x["content"] for x in whole.get("added_tokens") or []}
    byte_level = "ByteLevel" in json.dumps(whole.get("pre_tokenizer"))
    letters = byte_letters()
    found = []
    for p in model["vocab"]:
        plain = p.removesuffix(end) if end else p
        if p in special or byte_level and not all(c in letters for c in plain):
            continue
        found.append(("".join(map(letters.__getitem__, plain)) if byte_level else plain) + (END if plain != p else ""))
    starts, rest = pieces_of(found, mark) if mark else (found, found)
    form = Form(byte_level, byte_level and not end, bool(end), "Lowercase" in json.dumps(whole.get("normalizer")) or not byte_level)
    return frozenset(starts), frozenset(rest), form


def words_of(text: str | None) -> list[str]:
    """Words of the lower-cased text."""
    return Form().words(text or "")


def token_counts(docs: DataFrame, starts: Iterable[str], rest: Iterable[str], form: Form | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every row's whole text, which is cut into words piece by piece.

    A null or wordless text has no tokens; repeated rows stay; an empty table
    gives none. The vocabulary is sent to every task (a tokenizer's, of a fixed
    size); tasks build the automaton once and remember a bounded number of words.
    """
    short_batches(docs.sparkSession)
    held, form = docs.sparkSession.sparkContext.broadcast((tuple(starts), tuple(rest))), form or Form()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, known = Automaton(*held.value), {}
        begin = set(held.value[0])
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                n_words = tokens = unknown = 0
                for part in pieces(text):
                    words = form.words(part)
                    new = set(words).difference(known)
                    if len(known) + len(new) > CACHE:
                        known.clear()
                        new = set(words)
                    for w in new:
                        piece = form.spell(w)
                        n = automaton.count(piece)
                        # a whole word that is a piece also counts 1: only the others are unknown
                        known[w] = (n, n == 1 and piece not in begin)
                    n_words += len(words)
                    for n, miss in map(known.__getitem__, words):
                        tokens += n
                        unknown += miss
                out.append((doc, n_words, tokens, unknown))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_tokens", "n_unknown"])
            yield frame.astype({"doc_id": "Int64", "n_words": "int64", "n_tokens": "int64", "n_unknown": "int64"})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def query(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """op7: greedy word-piece counts of every document."""
    starts, rest, form = load(vocabulary or os.path.join(TOKENIZERS, VOCABULARY))
    return token_counts(table(spark, sf_dir, "documents"), sorted(starts), sorted(rest), form)
