"""The pipeline on a small corpus with planted cases, stage by stage against plain code."""

import random
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lodestrata.llm import decontaminate as dc  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """The tables, and what each stage returned for the rows that the one before kept."""
    r = random.Random(12)
    root = tmp_path_factory.mktemp("corpus")
    vocab = ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 5))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    bench = [prose(30) for _ in range(12)]
    docs, toxic, dirty = [], set(), set()
    for i in range(700):
        text = prose(r.randrange(20, 160))
        if r.random() < 0.15:
            words = text.split()
            words[r.randrange(len(words))] = r.choice(["moron", "Scum!", "LOSER,", "idiot"])
            text = " ".join(words)
            toxic.add(i)
        elif r.random() < 0.05:
            text = f"{prose(10)} {r.choice(bench).upper()} {prose(20)}"
            dirty.add(i)
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
    for i, of in enumerate(r.sample(sorted(set(range(700)) - toxic - dirty), 60)):
        words = docs[of][1].split()
        if i % 2:
            words[-1] = "tail"
        docs.append((1000 + i, " ".join(words), "en", "s1", 1))
    docs += [(2000, None, None, None, None), (2001, "", "en", "s2", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, 0, int(i in toxic)) for i in range(700)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    frames, rows = spark.read.parquet(f"{root}/documents.parquet"), {"documents": docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames, str(root))
        out.write.parquet(f"{root}/out-{k}")
        frames = spark.read.parquet(f"{root}/out-{k}")
        rows[name] = [r.asDict() for r in frames.collect()]
        assert frames.columns[:5] == COLUMNS and (name == "sharding" or frames.columns == COLUMNS)
    return {"rows": rows, "toxic": toxic, "dirty": dirty, "bench": bench, "root": str(root)}


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixture", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_toxic_documents_go_and_others_stay(staged):
    kept = {d["doc_id"] for d in staged["rows"]["toxicity"]}
    every = {d[0] for d in staged["rows"]["documents"]}
    assert len(kept & staged["toxic"]) <= 2
    assert len(every - kept - staged["toxic"]) <= 2
    by = {d[0]: d for d in staged["rows"]["documents"]}
    assert all(tuple(d[c] for c in COLUMNS) == by[d["doc_id"]] for d in staged["rows"]["toxicity"])


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_one_document_of_each_group_stays(staged):
    """By the rule for stages on word shingles: five words, Jaccard 0.8 or more."""
    before = {d["doc_id"]: shingles(d["text"]) for d in staged["rows"]["toxicity"]}
    root = {i: i for i in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(before)
    for a in ids:
        for b in ids:
            if a < b and likeness(before[a], before[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(d["doc_id"] for d in staged["rows"]["near_duplicates"]) == sorted({find(i) for i in ids})


def test_contaminated_documents_go(staged):
    items = [(str(i), t) for i, t in enumerate(staged["bench"])]
    wins = {tuple(dc.words_of(t)[i : i + 13]) for _, t in items for i in range(18)}
    want = []
    for d in staged["rows"]["near_duplicates"]:
        w = dc.words_of(d["text"])
        hit = {j for i in range(len(w) - 12) if tuple(w[i : i + 13]) in wins for j in range(i, i + 13)}
        if not hit or 20 * len(hit) < len(w):
            want.append(d["doc_id"])
    got = [d["doc_id"] for d in staged["rows"]["decontamination"]]
    assert sorted(got) == sorted(want) and not set(got) & staged["dirty"]


def test_mixture_meets_its_targets(staged):
    size = lambda t: len((t or "").split())
    have, taken, copies = defaultdict(int), defaultdict(int), Counter()
    for d in staged["rows"]["decontamination"]:
        have[d["source"]] += size(d["text"])
    for d in staged["rows"]["mixture"]:
        taken[d["source"]] += size(d["text"])
        copies[d["doc_id"]] += 1
    assert max(copies.values()) <= 3
    order = sorted((s for s in have if s is not None)) + [None] * (None in have)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = dict.fromkeys(have, 0.0), set(have), float(sum(have.values()))
    while left > 1e-6 and free:
        w = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / w
        left = sum(max(0.0, target[s] - 3 * have[s]) for s in have)
        target = {s: min(target[s], 3 * have[s]) for s in have}
        free = {s for s in free if target[s] < 3 * have[s] - 1e-9}
    assert all(abs(taken[s] - target[s]) <= max(30, 0.03 * target[s]) for s in have)


def test_shards_hold_what_the_mixture_gave(staged):
    key = lambda d: tuple(str(d[c]) for c in COLUMNS)
    last = staged["rows"]["sharding"]
    assert Counter(map(key, last)) == Counter(map(key, staged["rows"]["mixture"]))
    size, slots = defaultdict(int), defaultdict(list)
    for d in last:
        assert d["size"] == len((d["text"] or "").encode()) + 8
        size[d["shard"]] += d["size"]
        slots[d["shard"]].append(d["slot"])
    assert sorted(size) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) < 1.35 * min(size.values())


def test_run_is_the_stages_in_order(spark, staged):
    got = [r.asDict() for r in corpus_pipeline.run(spark, staged["root"]).collect()]
    key = lambda d: tuple(str(d[c]) for c in (*COLUMNS, "shard"))
    assert Counter(map(key, got)) == Counter(map(key, staged["rows"]["sharding"]))
