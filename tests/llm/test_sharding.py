"""K-d sharding: the laws of the result, the tree against a plain one."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import sharding as sd


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, shard int")


def docs(seed, n=3000, hot=0):
    r = random.Random(seed)
    texts = ["".join(r.choice("abcé ") for _ in range(int(r.expovariate(1 / 60)))) for _ in range(n)]
    texts += ["hot copy " * 12] * hot + [texts[i % 50] for i in range(200)] + [None, "", None]
    return list(enumerate(texts)) + [(None, "no id"), (3, texts[3]), (3, texts[3])]


@pytest.mark.parametrize("hot", [0, 1500])
@pytest.mark.parametrize("shards", [24, 5])
def test_laws(spark, hot, shards):
    rows = docs(1, hot=hot)
    got = sd.sharded(frame(spark, rows), shards=shards).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((g["doc_id"], g["text"], g["size"]) for g in got) == Counter((i, t, size(t)) for i, t in rows)
    total, slots, groups = defaultdict(int), defaultdict(list), defaultdict(set)
    for g in got:
        total[g["shard"]] += g["size"]
        slots[g["shard"]].append(g["slot"])
        groups[g["text"] or ""].add(g["shard"])
    assert sorted(total) == list(range(shards))
    mean = sum(total.values()) / shards
    assert max(total.values()) < 1.08 * mean and min(total.values()) > 0.92 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weight = Counter()
    for _, t in rows:
        weight[t or ""] += size(t)
    assert all(len(s) == 1 for t, s in groups.items() if weight[t] <= sd.GROUP_PART * mean)
    again = sd.sharded(frame(spark, rows[::-1]), shards=shards).collect()
    assert Counter((g["doc_id"], g["text"], g["shard"]) for g in got) == Counter((g["doc_id"], g["text"], g["shard"]) for g in again)


def test_tree_against_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(sd, "TOLERANCE", 0.0)
    monkeypatch.setattr(sd, "MAX_SUMS", 64)
    r = random.Random(4)
    units = [(r.randrange(1, 9), r.randrange(1000) << 30, r.randrange(2**33)) for _ in range(400)]
    df = spark.createDataFrame(units, "weight long, a long, b long")
    tree = sd.grow(df, ["a", "b"], 8)
    got = {(x["weight"], x["a"], x["b"]): x["leaf"] for x in tree.leaf(df, "leaf").collect()}

    def plain(rows, span):
        if span is None:
            span = [max(x[i] for x in rows) - min(x[i] for x in rows) for i in (1, 2)]
        return rows, span

    def split(rows, count, span):
        if count == 1:
            return [rows]
        widths = [(max(x[i] for x in rows) - min(x[i] for x in rows)) / span[i - 1] for i in (1, 2)]
        d = 1 if widths[0] >= widths[1] else 2
        goal = sum(x[0] for x in rows) * (count // 2) / count
        best, run = None, 0
        for v in sorted({x[d] for x in rows}):
            w = sum(x[0] for x in rows if x[d] == v)
            if run + w >= goal:
                best = v if goal - run < run + w - goal else v + 1
                break
            run += w
        return split([x for x in rows if x[d] < best], count // 2, span) + split([x for x in rows if x[d] >= best], count - count // 2, span)

    rows, span = plain(units, None)
    want = {x: k for k, leaf in enumerate(split(rows, 8, span)) for x in leaf}
    assert got == want


def test_target_bytes_and_empty(spark):
    rows = docs(2, n=800)
    got = sd.sharded(frame(spark, rows), target_bytes=4000)
    n = -(-sum(len((t or "").encode()) + 8 for _, t in rows) // 4000)
    per = [r["b"] for r in got.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(per) == n and max(per) < 4600
    assert sd.sharded(frame(spark, [])).collect() == []
    (one,) = sd.sharded(frame(spark, [(1, "x")])).collect()
    assert one["slot"] == 0 and one["size"] == 9


def test_query(spark, tmp_path):
    rows = docs(3)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sd.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {g["law"] for g in got} == {"bytes"} and {g["grown_shard"] for g in got} == {None}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in rows}
    assert all(g["text_crc32"] == crc[g["doc_id"]] for g in got)
