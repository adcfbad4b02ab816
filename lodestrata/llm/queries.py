"""The registered query of each operator, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, kneser_ney, mixture, sharding, simhash, spotsigs, toxicity, url_filter, warc, wordpiece

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": spotsigs.query,
    "op1_spotsigs_classes": spotsigs.classes_query,
    "op2_redirect_equivalence": url_filter.query,
    "op3_simhash_trie": simhash.query,
    "op4_counterfactual_toxicity": toxicity.query,
    "op5_kneser_ney": kneser_ney.query,
    "op6_curriculum_mixture": mixture.query,
    "op6_curriculum_positions": mixture.positions_query,
    "op7_linear_wordpiece": wordpiece.query,
    "op8_kd_sharding": sharding.query,
    "op9_ngram_decontamination": decontaminate.query,
    "op10_warc_sequential": warc.query,
}

ORACLES: dict[str, str] = {
    "op2_redirect_equivalence": url_filter.ORACLE_SQL,
    "op6_curriculum_mixture": mixture.ORACLE_SQL,
    "op9_ngram_decontamination": decontaminate.ORACLE_SQL,
    "op10_warc_sequential": warc.ORACLE_SQL,
}
