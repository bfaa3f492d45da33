"""From raw documents to packed sequences, one operator per stage.

Each stage takes the documents that the stage before it wrote and returns those it passes on,
with the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import located, new_folder, table
from loomtrace.llm.exact_dedup import exact_dedup
from loomtrace.llm.minhash import near_duplicates
from loomtrace.llm.packing import pack, read_tokenizer
from loomtrace.llm.pii import replace_in_place
from loomtrace.llm.quality_rules import keep_good


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose place is not in ``gone`` (file, row)."""
    longest = "_" * (1 + max(map(len, docs.columns)))  # no column has these names
    place = [f"{longest}file", f"{longest}row"]
    return located(docs, *place).join(gone.toDF(*place), place, "left_anti").select(*[docs[c] for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the longest original stays, then the least id, then one row."""
    found = exact_dedup(docs)
    gone = found.where("NOT kept").select("locator.file", "locator.row")
    return _without(docs, gone)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the least id stays."""
    found = near_duplicates(located(docs.select("doc_id", "text")), carry=("_file", "_row"))
    return _without(docs, found.where("NOT chosen").select("_file", "_row"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates; n_chars follows the new text."""
    changed = replace_in_place(docs)
    if "n_chars" not in docs.columns:
        return changed
    kind = docs.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048, as few as fit."""
    return pack(docs, read_tokenizer(spark, public_tokenizers.path("word_bpe_49k.json")), keep_words=False)


STAGES = [
    ("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near),
    ("pii", personal_data), ("packing", packing),
]

#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage before it is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
