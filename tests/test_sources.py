"""Scans, sinks and streams, faulty input included."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata import storage
from lodestrata.functions.text import alias_key
from lodestrata.operators import audit
from lodestrata.sources import jsonl, packed, sinks, tsv
from lodestrata.streaming import events as ev


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_triples(spark, tmp_path):
    good = write(tmp_path / "a.txt", "Q1\tP2\tQ3\r\n\nQ4\tP5\tQ6\n")
    assert sorted(map(tuple, tsv.read_triples(spark, good).collect())) == [(1, "P2", 3), (4, "P5", 6)]
    for bad in ("Q1\tP2\n", "Q1\tP2\tQ3\t\n", "1\tP2\tQ3\n", "Q1\tQ2\tQ3\n", "Q1\tP2\tQx\n"):
        with pytest.raises(tsv.ScanError):
            tsv.read_triples(spark, write(tmp_path / "b.txt", "Q1\tP2\tQ3\n" + bad))


def test_aliases(spark, tmp_path):
    path = write(tmp_path / "a.txt", "Q1\tﬁ\tFI\tStraße\nQ2\tfi\n")
    got = sorted((r["id"], r["ord"], r["norm"]) for r in tsv.read_aliases(spark, path, "Q", alias_key).collect())
    assert got == [(1, 0, "fi"), (1, 2, "strasse"), (2, 0, "fi")]
    for bad in ("Q1\tx\nQ1\ty\n", "Q1\n", "P1\tx\n"):
        with pytest.raises(tsv.ScanError):
            tsv.read_aliases(spark, write(tmp_path / "b.txt", bad), "Q", alias_key)


def test_locked_text(spark, tmp_path):
    (tmp_path / "d").mkdir()
    p = tmp_path / "d/x.jsonl"
    write(p, '{"text": "a"}\n\n{"text": "b"}\n')
    locked = jsonl.lock(spark, str(tmp_path / "d"))
    locked = spark.createDataFrame(locked.collect(), locked.schema)
    assert jsonl.read_locked_text(spark, str(tmp_path / "d"), locked).count() == 2
    write(p, '{"text": "a"}\n\n{"text": "c"}\n')
    with pytest.raises(tsv.ScanError):
        jsonl.read_locked_text(spark, str(tmp_path / "d"), locked)
    write(p, '{"text": ""}\n')
    with pytest.raises(tsv.ScanError):
        jsonl.read_locked_text(spark, str(tmp_path / "d"), jsonl.lock(spark, str(tmp_path / "d")))


def test_json_scans(spark, tmp_path):
    log = write(tmp_path / "log.jsonl", '{"step": 1, "loss": 2.0}\n{"step": 2}\n{"loss": 1.0}\n{"step": 3, "loss": 1.5, "lr": 0.1}\n')
    assert sorted(map(tuple, jsonl.log_series(spark, log, "loss").collect())) == [(1, 2.0), (3, 1.5)]
    with pytest.raises(Exception, match="MALFORMED"):
        jsonl.read_json(spark, write(tmp_path / "bad.jsonl", '{"subj": \n'), jsonl.FACT).collect()
    run = tmp_path / "run"
    run.mkdir()
    for name, step, v in (("a", 5, 0.1), ("b", 5, 0.2), ("c", 9, 0.3)):
        write(run / f"{name}.json", json.dumps({"step": step, "m": {"acc": v}}))
    write(run / "d.json", json.dumps({"step": 11}))
    assert sorted((r["step"], r["value"]) for r in jsonl.metric_curve(spark, str(run), "m.acc").collect()) == [(5, 0.2), (9, 0.3)]
    text = write(tmp_path / "t.txt", "one\ntwo\n\n  \nthree\n\n")
    assert [r["text"] for r in jsonl.paragraphs(spark, text).orderBy("ordinal").collect()] == ["one\ntwo", "three"]
    assert jsonl.cycled(jsonl.paragraphs(spark, text).withColumn("n", F.length("text")), "n", 30).count() == 6
    rows = spark.createDataFrame([('["a", " "]', "o"), ("[]", "o"), ("no", "o"), (None, "o")], "raw string, obj string")
    assert [r[0] for r in rows.select(jsonl.possible_answers(F.col("raw"), F.col("obj"))).collect()] == [["a"], ["o"], ["o"], ["o"]]
    recs = spark.createDataFrame([(1, "x", "a"), (1, "y", "b"), (2, "x", "c")], "e long, r string, v string")
    assert [tuple(r) for r in jsonl.complete_records(recs, "e", "r", "v", ["x", "y"]).collect()] == [(1, "a", "b")]


def test_choice_rows(spark):
    blank = spark.createDataFrame([("A _ ran.", "dog", "cat", "2")], "sentence string, option1 string, option2 string, answer string")
    assert tuple(jsonl.choice_rows(blank, "blank").first()) == ("A ", ["dog ran.", "cat ran."], 1)
    last = spark.createDataFrame([("we all fell down ",)], "text string")
    assert tuple(jsonl.choice_rows(last, "last_word").first()) == ("we all fell", ["down"], 0)
    lab = spark.createDataFrame([("Why?", (["x", "y"], ["A", "B"]), "B")], "question string, choices struct<text:array<string>,label:array<string>>, answerKey string")
    assert tuple(jsonl.choice_rows(lab, "labelled").first()) == ("Question: Why?\nAnswer:", ["x", "y"], 1)


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "cat")
    jsonl.fixture_catalog(spark, 50).write.json(path)
    assert jsonl.read_catalog(spark, path).count() == 50
    jsonl.fixture_catalog(spark, 50).filter("ordinal <> 7").write.mode("overwrite").json(path)
    with pytest.raises(tsv.ScanError):
        jsonl.read_catalog(spark, path)


def test_manifest(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(packed.manifest_bytes([(1, 0, 5), (1, 0, 9), (2, 3, 4), (1, 0, 9)]))
    rows = packed.read_manifest(spark, str(tmp_path / "m.bin"))
    assert [(r["task"], r["source_index"]) for r in rows.orderBy("entry").collect()] == [(1, 5), (1, 9), (2, 4), (1, 9)]
    assert [r["entry"] for r in audit.unordered(rows, ["task"], "entry", "source_index").collect()] == [3]
    (tmp_path / "m.bin").write_bytes(b"RMAN" + b"\1" * 9)
    with pytest.raises(Exception, match="no whole manifest"):
        packed.read_manifest(spark, str(tmp_path / "m.bin")).collect()


def test_publish_refuses_to_replace(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    df = spark.range(3)
    sinks.publish(df, target)
    with pytest.raises(FileExistsError):
        sinks.publish(df, target)
    assert spark.read.parquet(target).count() == 3 and len(list(tmp_path.iterdir())) == 1
    found = audit.artifact_digests(spark, f"{target}/*.parquet")
    manifest = found.select(F.substring_index("path", "/", -1).alias("name"), "bytes", "sha256")
    assert audit.changed_artifacts(found, manifest).count() == 0
    assert {r["problem"] for r in audit.changed_artifacts(found, manifest.withColumn("bytes", F.col("bytes") + 1)).collect()} == {"size"}


def test_small_sinks(spark):
    assert sinks.canonical_bytes({"b": 1, "a": "é"}) == b'{"a":"\\u00e9","b":1}\n'
    with pytest.raises(ValueError, match="JSON compliant"):
        sinks.canonical_bytes(float("nan"))
    assert sinks.deterministic_zip({"b": b"1", "a": b"2"}) == sinks.deterministic_zip({"a": b"2", "b": b"1"})
    df = sinks.union_columns([spark.createDataFrame([(1, 0.1)], "b long, a double"), spark.createDataFrame([("x|y",)], "c string")])
    assert sinks.render(df.orderBy("b"), "csv").splitlines()[0] == "a,b,c"
    assert "0.10000000000000001" in sinks.render(df, "csv") and "x\\|y" in sinks.render(df, "markdown")
    assert sinks.render(df, "latex").startswith("\\begin{tabular}{lll}") and "<rect" in sinks.render(df.select("b"), "svg")
    with pytest.raises(ValueError, match="small"):
        sinks.render(spark.range(5), "csv", 4)
    twice = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "qid long, pair_id long, variant string")
    with pytest.raises(ValueError, match="repeated"):
        sinks.publish_results(twice, storage.scratch(spark, "x"))


def test_bucketed_store(spark):
    rows = spark.range(100).select(F.col("id").alias("source"), F.lit("P1").alias("relation"), (F.col("id") * 2).alias("target"))
    spark.sql("DROP TABLE IF EXISTS store_t")
    try:
        sinks.write_store(rows, "store_t", ["source", "relation"], 4)
        a, b = spark.table("store_t"), spark.table("store_t").withColumnRenamed("target", "t2")
        joined = a.hint("merge").join(b, ["source", "relation"])
        assert joined.count() == 100
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.sql("DROP TABLE IF EXISTS store_t")
    with pytest.raises(ValueError, match="repeated"):
        sinks.write_store(rows.union(rows), "store_u", ["source", "relation"])


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i // 2, "original" if i % 2 == 0 else "counterfactual", i % 3 % 2) for i in range(40)], "pair_id long, variant string, correct long")
    path = f"file://{tmp_path}/in"
    rows.filter("pair_id <> 7 or variant = 'original'").union(rows.limit(9)).repartition(4).write.parquet(path)
    got = ev.run_to_table(ev.completed_pairs(ev.file_stream(spark, path)), f"file://{tmp_path}/o1").collect()
    want = {r["pair_id"]: (r["o"], r["c"]) for r in rows.filter("pair_id <> 7").groupBy("pair_id").agg(F.max(F.when(F.col("variant") == "original", F.col("correct"))).alias("o"), F.max(F.when(F.col("variant") != "original", F.col("correct"))).alias("c")).collect()}
    assert {g["pair_id"]: (g["original"], g["counterfactual"]) for g in got} == want and len(got) == len(want)
    m = ev.run_to_table(ev.running_metrics(ev.file_stream(spark, path), ["variant"], "correct"), f"file://{tmp_path}/o2", "complete")
    assert m.exceptAll(ev.running_metrics(spark.read.parquet(path), ["variant"], "correct")).count() == 0


def test_decoded_lookups(spark):
    t = ["w", "open", "w", "open", "close", "close", "open", "close", "open", "close", "open"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "stream long, pos long, token string")
    assert tuple(ev.decoded_lookups(rows.repartition(3), 2).first()) == (1, 2, 3, 1)
