"""The corpus pipeline: documents through five of the training-data operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import common, decontaminate, mixture, sharding, simhash, toxicity

STAGES = [
    ("toxicity", toxicity.reject),
    ("near_duplicates", simhash.keep_one),
    ("decontamination", decontaminate.drop_contaminated),
    ("mixture", mixture.in_training_order),
    ("sharding", sharding.to_shards),
]

#: A learnt classifier and XXH64 fingerprints are beyond SQL; the tests hold the pipeline against its operators' plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written below the shared folder before the next one starts."""
    docs = common.table(spark, sf_dir, "documents")
    folder = common.new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
