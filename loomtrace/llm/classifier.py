"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Follow-the-regularised-leader keeps two sums per weight (McMahan et al., KDD 2013); features
without evidence stay exactly zero, so the model is sparse. The training
sample is bounded; scoring is a map over all documents with the weights, a table of fixed size,
sent to every task.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import map_batches, remainder, saved, table, text_of

DIMENSIONS = 1 << 18
#: Models trained apart and averaged. One sees all of the bounded sample; more train sooner.
SHARDS = 1
#: The bound of the training sample, in labelled documents.
MAX_TRAINING_ROWS = 20_000
#: Words whose hash is remembered per task.
CACHE = 200_000

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def token_hashes(text: str, cache: dict[str, int]) -> np.ndarray:
    """A 32-bit hash for each word or run of signs; a word equal to the one before reads as '='."""
    tokens = _TOKEN.findall(text)
    if len(cache) > CACHE:
        cache.clear()
    known = cache.get
    out = np.empty(len(tokens), dtype=np.uint64)
    for i, token in enumerate(tokens):
        value = known(token)
        if value is None:
            value = cache[token] = zlib.crc32(token.encode())
        out[i] = value
    if len(out) > 1:
        out[1:][out[1:] == out[:-1]] = zlib.crc32(b"=")
    return out


def features(text: str, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of the text: words, word pairs and the bias at 0.

    Values are 1 + ln(count), scaled to length 1; the bias is 1. The empty text has the bias
    alone.
    """
    h = token_hashes(text, cache)
    if not len(h):
        return np.zeros(1, dtype=np.int64), np.ones(1)
    pairs = h[:-1] * np.uint64(0x9E3779B1) ^ (h[1:] * np.uint64(0x85EBCA77) + np.uint64(1))
    mixed = np.concatenate([h * np.uint64(0xC2B2AE3D), pairs]) * np.uint64(0x9E3779B97F4A7C15)
    index, count = np.unique((mixed >> np.uint64(46)).astype(np.int64) % (DIMENSIONS - 1) + 1, return_counts=True)
    value = 1.0 + np.log(count)
    value /= np.sqrt((value * value).sum())
    return np.concatenate([[0], index]), np.concatenate([[1.0], value])


class Ftrl:
    """FTRL-proximal for the logistic loss."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weights(self, index=slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, index: np.ndarray, value: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(index)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -30, 30)))
        g = weight * (p - label) * value
        n = self.n[index]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[index] += g - sigma * w
        self.n[index] = n + g * g


def _train_shard(pdf: pd.DataFrame, epochs: int) -> pd.DataFrame:
    cache: dict[str, int] = {}
    pdf = pdf.sort_values("doc_id", na_position="first")
    rows = [(*features(t, cache), int(y)) for t, y in zip(pdf["text"], pdf["label"], strict=True)]
    model, order = Ftrl(), np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.update(*rows[i], 1.0)
    w = model.weights()
    used = np.flatnonzero(w)
    return pd.DataFrame({"index": used, "weight": w[used]})


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int,
                    max_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``max_rows`` labelled rows outside the held-out remainder.

    The rows with the smallest hash of their id are taken; only their ids (``max_rows`` at
    most) go to every task. Rows without a label are not used.
    """
    usable = labels.where(remainder(F.col("doc_id"), modulus) != held_out).where(F.col(label).isNotNull())
    chosen = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("label")).orderBy(
        F.xxhash64("_id"), "_id"
    ).limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "label")


def train(rows: DataFrame, epochs: int = 10) -> np.ndarray:
    """The weights, averaged over the shards; all zeros without training rows."""
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).alias("_shard")
    found = (
        rows.select("doc_id", "text", "label", shard).groupBy("_shard")
        .applyInPandas(lambda pdf: _train_shard(pdf, epochs), "index long, weight double")
        .groupBy("index").agg(F.sum("weight").alias("weight")).collect()
    )  # at most DIMENSIONS rows
    out = np.zeros(DIMENSIONS, dtype=np.float32)
    for index, weight in found:
        out[index] = weight / SHARDS
    return out


def score_documents(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score): the sparse dot product of each text with the weights, as a probability."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    cache: dict[str, int] = {}

    def score(cols: dict[str, list]) -> dict[str, list]:
        w = shared.value
        out = []
        for text in cols["text"]:
            index, value = features(text, cache)
            out.append(float(1.0 / (1.0 + np.exp(-np.clip(w[index] @ value, -30, 30)))))
        return {"doc_id": cols["doc_id"], "score": out}

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return map_batches(rows, score, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, max_training_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Trained on at most ``max_training_rows`` rows of ``labels`` (doc_id, quality) whose id does
    not fall in the held-out quarter. The empty or null text gets the score of the bias;
    without any label every score is 0.5. Rows may repeat; a null id is scored like any
    other; other columns are ignored; an empty table gives no row.
    """
    sample = saved(training_sample(docs, labels, "quality", 4, 2, max_training_rows), "quality-sample")
    scores = score_documents(docs, train(sample))
    return scores.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
