"""Every query over tables whose rows lie in few of many files: tasks without rows must not matter."""

import pytest

pytest.importorskip("lodestrata.llm")
from lodestrata.llm import queries  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("thin")
    texts = ["the quick brown fox and the lazy dog", "", None, "idiot of a kind", "a b c d e f g h i j k l m n o p", "THE quick brown fox and the lazy dog"]
    docs = spark.createDataFrame([(i, texts[i % 6], "en", None if i % 5 == 0 else f"s{i % 3}", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(f"{root}/documents.parquet")
    docs.filter("false").repartition(3).write.mode("append").parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q"), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    spark.createDataFrame([(i, 0, int(i % 6 == 3)) for i in range(0, 30)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(i, f"http://x{i % 4}.org/es/{i}", None if i % 4 == 0 else f"<p>{i % 3}</p>") for i in range(12)], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    empty = tmp_path_factory.mktemp("empty")
    for t in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{root}/{t}.parquet").filter("false").write.parquet(f"{empty}/{t}.parquet")
    return str(root), str(empty)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, tables, name):
    full, empty = tables
    n = 12 if name.startswith(("op2_", "op10_")) else 30
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "16")
    try:
        df = queries.QUERIES[name](spark, full)
        assert df.count() == n
        none = queries.QUERIES[name](spark, empty)
        assert none.count() == 0 and none.dtypes == df.dtypes
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)


def test_pipeline(spark, tables):
    import corpus_pipeline

    full, empty = tables
    got = corpus_pipeline.run(spark, full)
    assert {"doc_id", "text", "shard", "slot"} <= set(got.columns)
    assert corpus_pipeline.run(spark, empty).count() == 0
