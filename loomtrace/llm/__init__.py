"""Training-data operators: quality, deduplication, packing, toxicity, licences, URLs, PII."""

from pyspark import cloudpickle

from loomtrace.llm import common

# Task functions travel with their code, so executors need no copy of this package.
for _name in ("quality_rules", "classifier", "minhash", "packing", "toxicity", "pii", "pieces", "negatives", "warc",
              "conversation", "common"):
    cloudpickle.register_pickle_by_value(__import__(f"loomtrace.llm.{_name}", fromlist=["_"]))

__all__ = ["common"]
