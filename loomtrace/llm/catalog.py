"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtrace.llm import (
    classifier, conversation, exact_dedup, license_scan, minhash, negatives, packing, pieces, pii, toxicity, url_filter,
    warc,
)
from loomtrace.llm.common import table
from loomtrace.llm.quality_rules import quality_rules


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_classifier": classifier.op1_quality_classifier,
    "op2_minhash": minhash.op2_minhash,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_pii_surrogates": pii.op8_pii_surrogates,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_warc": warc.op12_warc,
    "op13_conversation_repair": conversation.op13_conversation_repair,
}

ORACLES = {
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_hard_negatives": negatives.ORACLE_SQL,
    "op12_warc": warc.ORACLE_SQL,
    "op13_conversation_repair": conversation.ORACLE_SQL,
}
