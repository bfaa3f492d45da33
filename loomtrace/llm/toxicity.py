"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max index.

The examples are a bounded sample of labelled texts, all their words are terms, and document
frequencies are counted over the whole corpus. The k examples of greatest cosine are found
exactly. Words that few examples share have short posting lists, which are summed up for each
text. Words that many share (function words) would have lists as long as the sample; they are
kept by blocks of examples with the greatest weight of each block (Ding and Suel, SIGIR 2011),
and looked at only in examples that, with their block's maxima, could still be among the k.

Each neighbour has a vote, and its weight is the part of the cosine that comes from words tied
to the label. A rising curve, fitted on the examples each held against all others, makes
probabilities of the votes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.classifier import training_sample
from loomtrace.llm.common import map_batches, remainder, saved, table, text_of

#: The bounds of the example set: labelled documents, and pairs of a document and a word of it.
MAX_EXAMPLES = 8_000
MAX_PAIRS = 4_000_000
NEIGHBOURS = 200
#: How many neighbours and words are returned as evidence.
EVIDENCE, EVIDENCE_WORDS = 15, 5
BLOCK = 64
#: So many of the most frequent words are kept by blocks.
BLOCK_WORDS = 384
#: Chi-square (one degree of freedom, corrected for few examples) from which a word is tied to the label, and fully so.
LEAST_CHI_SQUARE, FULL_CHI_SQUARE = 6.63, 30.0
#: The weight of the sample's own share among the votes.
PRIOR_WEIGHT = 0.03
#: Texts scored together.
TOGETHER = 128

_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> Counter:
    """The words of the text, in lower case, with their counts."""
    return Counter(_WORD.findall(text.lower()))


@dataclass
class Examples:
    """The examples by rising id; example i has the term numbers and counts between cuts[i] and cuts[i + 1]."""

    ids: list[int | None]
    labels: np.ndarray
    terms: list[str]
    cuts: np.ndarray
    term: np.ndarray
    count: np.ndarray

    def ties(self) -> np.ndarray:
        """How far each term goes with the label, 0 to 1."""
        n, positive = len(self.labels), int(self.labels.sum())
        df = np.bincount(self.term, minlength=len(self.terms)).astype(float)
        own = np.repeat(self.labels, np.diff(self.cuts))
        a = np.bincount(self.term, own, len(self.terms))
        gap = np.maximum(np.abs(a * n - df * positive) - n / 2, 0.0)
        spread = df * (n - df) * positive * (n - positive)
        chi_square = gap * gap * n / np.where(spread > 0, spread, np.inf)
        return np.where(chi_square < LEAST_CHI_SQUARE, 0.0, np.minimum(chi_square / FULL_CHI_SQUARE, 1.0))


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = (1.0 + np.log(counts)) * idf
    return weights / (np.sqrt(weights @ weights) or 1.0)


class Lists:
    """Posting lists: for each term the places that have it, with their weights."""

    def __init__(self, term: np.ndarray, place: np.ndarray, weight: np.ndarray, n_terms: int, n_places: int):
        by_term = np.argsort(term, kind="stable")
        self.place, self.weight, self.n_places = place[by_term].astype(np.int32), weight[by_term], n_places
        self.cuts = np.searchsorted(term[by_term], np.arange(n_terms + 1))

    def sums(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each place, the sum over its terms of the two weights' products."""
        first, n = self.cuts[terms], self.cuts[terms + 1] - self.cuts[terms]
        rows = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.bincount(self.place[rows], np.repeat(weights, n) * self.weight[rows], self.n_places)


class BlockMaxIndex:
    """Unit vectors of the examples: (terms, weights) of each; ``nearest`` is exact."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, ties: np.ndarray):
        n, sizes = len(vectors), np.array([len(t) for t, _ in vectors], dtype=np.int64)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, dtype=np.int64)])
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        own = np.repeat(np.arange(n), sizes)
        df = np.bincount(term, minlength=n_terms)
        most = np.argsort(-df, kind="stable")[:BLOCK_WORDS]
        most = np.sort(most[df[most] > BLOCK])
        self.column = np.full(n_terms, -1, dtype=np.int64)
        self.column[most] = np.arange(len(most))
        rare = self.column[term] < 0
        dense = np.zeros((n, len(most)))
        dense[own[~rare], self.column[term[~rare]]] = weight[~rare]
        # Examples of one language (the same heaviest frequent word) and of like length lie together:
        # where a block lacks the words of a text its bound is 0.
        lead = dense.argmax(axis=1) if len(most) else np.zeros(n, dtype=np.int64)
        self.rank = np.lexsort((sizes, lead))
        self.place_of = np.empty_like(self.rank)
        self.place_of[self.rank] = np.arange(n)
        self.dense, place = dense[self.rank], self.place_of[own]
        self.lists = Lists(term[rare], place[rare], weight[rare], n_terms, n)
        starts = np.arange(0, n, BLOCK)
        self.block_most = np.maximum.reduceat(self.dense, starts, axis=0) if n else self.dense
        self.ties, tied = ties, ties[term] > 0
        self.tied = Lists(term[tied], place[tied], weight[tied] * ties[term[tied]], n_terms, n)

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple]:
        """For each vector the k examples of greatest cosine above 0, ties by their number: (numbers, cosines)."""
        frequent = np.zeros((len(vectors), self.dense.shape[1]))
        for i, (terms, weights) in enumerate(vectors):
            there = self.column[terms] >= 0
            frequent[i, self.column[terms[there]]] = weights[there]
        # Texts of one language together, so that they need the same blocks.
        order = np.argsort(frequent.argmax(axis=1), kind="stable") if frequent.size else np.arange(len(vectors))
        out: list[tuple] = [()] * len(vectors)
        for start in range(0, len(order), TOGETHER):
            part = order[start:start + TOGETHER]
            for i, found in zip(part, self._nearest([vectors[j] for j in part], frequent[part], k), strict=True):
                out[i] = found
        return out

    def _nearest(self, vectors: list, frequent: np.ndarray, k: int) -> Iterator[tuple]:
        n, n_blocks = len(self.rank), len(self.block_most)
        score = np.full((len(vectors), n_blocks * BLOCK), -1.0)
        least = np.full(len(vectors), -1.0)
        guess = 0.0
        for i, (terms, weights) in enumerate(vectors):
            rare = self.column[terms] < 0
            known = score[i, :n] = self.lists.sums(terms[rare], weights[rare])
            if n > k:
                # The k best by these words alone, sought among those above a guess if they are enough.
                some = np.flatnonzero(known > guess)
                some = some if len(some) > k else np.arange(n)
                first = some[np.argpartition(known[some], len(some) - k)[len(some) - k:]]
                guess = 0.5 * known[first].min()
                least[i] = (known[first] + self.dense[first] @ frequent[i]).min() - 1e-9
        # A block that no text needs costs nothing; the others are added up for all texts in one product.
        could = score.reshape(len(vectors), n_blocks, BLOCK).max(axis=2) + frequent @ self.block_most.T >= least[:, None]
        for block in np.flatnonzero(could.any(axis=0)) if n else ():
            rows = slice(block * BLOCK, min(n, (block + 1) * BLOCK))
            score[:, rows] += frequent @ self.dense[rows].T
        for row, bound in zip(score[:, :n], least, strict=True):
            at = np.flatnonzero(row >= max(bound, 1e-10))  # what was skipped is below the bound
            value = row[at].round(9)
            if len(at) > k:
                best = value >= np.partition(value, len(at) - k)[len(at) - k]
                at, value = at[best], value[best]
            number = self.rank[at]
            order = np.lexsort((number, -value))[:k]
            order = order[value[order] > 0]
            yield number[order], value[order]

    def tied_parts(self, vector: tuple[np.ndarray, np.ndarray], numbers: np.ndarray) -> np.ndarray:
        """The part of each example's cosine that comes from terms tied to the label."""
        terms, weights = vector
        some = self.ties[terms] > 0
        if not some.any():
            return np.zeros(len(numbers))
        return self.tied.sums(terms[some], weights[some])[self.place_of[numbers]]


def vote(weights: np.ndarray, labels: np.ndarray, prior: float) -> float:
    """The weighted share of label 1, drawn to ``prior`` where the weights are small."""
    return float((weights @ labels + prior * PRIOR_WEIGHT) / (weights.sum() + PRIOR_WEIGHT))


def fit_curve(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising step curve from votes to shares of label 1 (pool adjacent violators)."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []  # [least vote, positives, rows]
    for v, y in zip(votes[order], labels[order], strict=True):
        if pools and pools[-1][0] == v:
            pools[-1][1] += y
            pools[-1][2] += 1
        else:
            pools.append([float(v), float(y), 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1][1] += last[1]
            pools[-1][2] += last[2]
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1.0) for p in pools])


class Model:
    """Scores texts; a function of the examples and the terms' document frequencies only."""

    def __init__(self, examples: Examples, idf: np.ndarray, k: int = NEIGHBOURS):
        self.examples = examples
        self.ids, self.labels, self.terms, self.k = examples.ids, examples.labels, examples.terms, k
        self.number, self.idf = {t: i for i, t in enumerate(examples.terms)}, idf
        parts = [slice(a, b) for a, b in zip(examples.cuts[:-1], examples.cuts[1:], strict=True)]
        self.vectors = [(examples.term[p], unit(examples.count[p], idf[examples.term[p]])) for p in parts]
        self.index = BlockMaxIndex(self.vectors, len(self.terms), examples.ties())
        self.prior = (float(self.labels.sum()) + 0.5) / (len(self.labels) + 1.0)
        self.curve = (np.zeros(1), np.full(1, self.prior))
        self.seen: dict[bytes, tuple] = {}

    def __reduce__(self):
        # Tasks get the examples, a tenth of what is built of them, and build it anew.
        e = self.examples
        return _unpacked, ("\n".join(e.terms), e.ids, e.labels.astype(np.int8), e.cuts, e.term.astype(np.int32),
                           e.count.astype(np.int32), self.idf, self.k)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return terms, unit(counts, self.idf[terms])

    def held_out_votes(self, numbers: list[int]) -> list[float]:
        """The votes on these examples, each without its own."""
        out = []
        for start in range(0, len(numbers), TOGETHER):
            part = numbers[start:start + TOGETHER]
            vectors = [self.vectors[i] for i in part]
            for own, vector, (near, _) in zip(part, vectors, self.index.nearest(vectors, self.k + 1), strict=True):
                near = near[near != own][:self.k]
                out.append(vote(self.index.tied_parts(vector, near), self.labels[near], self.prior))
        return out

    def _score(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        vectors = [self.vector(*c) for c in counted]
        for vector, (near, cosines) in zip(vectors, self.index.nearest(vectors, self.k), strict=True):
            raw = vote(self.index.tied_parts(vector, near), self.labels[near], self.prior)
            at = max(0, int(np.searchsorted(self.curve[0], raw, side="right")) - 1)
            # The vote breaks ties within a step of the curve.
            value = min(1.0, max(0.0, 0.999 * float(self.curve[1][at]) + 0.001 * raw))
            terms, weights = vector
            best = np.lexsort((terms, -weights * self.index.ties[terms]))[:EVIDENCE_WORDS]
            yield (value, [self.ids[i] for i in near[:EVIDENCE]], cosines[:EVIDENCE].tolist(),
                   [self.terms[i] for i in terms[best]])

    def score(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
        """(score, ids of the nearest examples, their cosines, the words most tied to the label) of each text.

        A text is given by its (term numbers, counts); copies are scored once.
        """
        names = [hashlib.blake2b(t.tobytes() + n.tobytes(), digest_size=16).digest() for t, n in counted]
        if len(self.seen) > 20_000:
            self.seen.clear()
        new = {name: c for name, c in zip(names, counted, strict=True) if name not in self.seen}
        for start in range(0, len(new), TOGETHER):
            part = dict(list(new.items())[start:start + TOGETHER])
            self.seen.update(zip(part, self._score(list(part.values())), strict=True))
        return [self.seen[name] for name in names]


def _unpacked(terms, ids, labels, cuts, term, count, idf, k) -> Model:
    words = terms.split("\n") if terms else []
    return Model(Examples(ids, labels.astype(np.int64), words, cuts, term.astype(np.int64), count.astype(float)), idf, k)


# ---- On Spark

def _count_terms(cols: dict[str, list]) -> dict[str, list]:
    found = [sorted(terms_of(t).items()) for t in cols["text"]]
    return {"doc_id": cols["doc_id"], "label": cols["label"], "terms": [[t for t, _ in f] for f in found],
            "counts": [[n for _, n in f] for f in found]}


def read_examples(docs: DataFrame, labels: DataFrame, max_examples: int, max_pairs: int) -> Examples:
    """The examples: labelled rows outside the held-out third, in order of a hash of their ids, within both bounds."""
    sample = training_sample(docs, labels, "toxic", 3, 1, max_examples)
    one = sample.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    counted = saved(map_batches(one, _count_terms, "doc_id long, label int, terms array<string>, counts array<long>"),
                    "toxicity-examples")
    # One row of two numbers for each of at most max_examples texts.
    sizes = counted.select("doc_id", F.size("terms").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, chosen = 0, []
    for doc_id, n in sizes:
        total += n
        if total > max_pairs and chosen:
            break
        chosen.append(doc_id)
    kept = counted if len(chosen) == len(sizes) else counted.join(
        F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")), "doc_id", "left_semi")
    rows = kept.orderBy("doc_id").toArrow()
    words, counts = (rows.column(c).combine_chunks() for c in ("terms", "counts"))
    coded = words.values.dictionary_encode()
    terms = coded.dictionary.to_pylist()
    order = np.argsort(np.array(terms, dtype=object), kind="stable") if terms else np.zeros(0, dtype=np.int64)
    number = np.empty(len(terms), dtype=np.int64)
    number[order] = np.arange(len(terms))
    return Examples(
        rows.column("doc_id").to_pylist(), rows.column("label").to_numpy().astype(bool).astype(np.int64),
        [terms[i] for i in order], np.asarray(words.offsets, dtype=np.int64),
        number[coded.indices.to_numpy()], counts.values.to_numpy().astype(float),
    )


def _rows(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(term numbers, counts) of each row of a batch of ``coded`` texts."""
    terms, counts = batch.column("terms"), batch.column("counts")
    cuts = np.asarray(terms.offsets)
    number = terms.values.to_numpy().astype(np.int64)
    count = counts.values.to_numpy().astype(float)
    return [(number[a:b], count[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def coded(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, terms, counts): each text as the numbers of its known terms; no text is read again after this."""
    known = docs.sparkSession.sparkContext.broadcast("\n".join(terms))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {t: i for i, t in enumerate(known.value.split("\n"))}.get
        for batch in batches:
            cuts, numbers, counts = [0], [], []
            for text in batch.column("text"):
                found = terms_of(text.as_py())
                number = np.array([get(w, -1) for w in found], dtype=np.int32)
                there = number >= 0
                numbers.append(number[there])
                counts.append(np.array(list(found.values()), dtype=np.int32)[there])
                cuts.append(cuts[-1] + len(numbers[-1]))
            cuts = pa.array(cuts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(
                    [*parts, np.zeros(0, dtype=np.int32)]))) for parts in (numbers, counts)]],
                names=["doc_id", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return saved(rows.mapInArrow(code, "doc_id long, terms array<int>, counts array<int>"), "toxicity-coded")


def document_frequencies(texts: DataFrame, n_terms: int) -> tuple[int, np.ndarray]:
    """(rows, rows with each term) over all ``coded`` texts; each task sends one number per term it saw."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found = 0, np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            rows += batch.num_rows
            found += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)[:n_terms]
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(found[seen], rows), pa.int64())],
            names=["term", "n"])

    sums = texts.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = sums.column("term").to_numpy(), sums.column("n").to_numpy()
    out = np.zeros(n_terms)
    out[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), out


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, k: int = NEIGHBOURS,
          max_pairs: int = MAX_PAIRS) -> tuple[Broadcast, tuple[np.ndarray, np.ndarray], DataFrame]:
    """The model, sent to all tasks, the curve, and all texts in the model's terms.

    The votes that fit the curve are cast by tasks.
    """
    spark = docs.sparkSession
    examples = read_examples(docs, labels, max_examples, max_pairs)
    texts = coded(docs, examples.terms)
    n, df = document_frequencies(texts, len(examples.terms))
    model = Model(examples, np.log((1 + n) / (1 + df)) + 1.0, k)
    shared = spark.sparkContext.broadcast(model)
    if not examples.ids:
        return shared, model.curve, texts

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(shared.value.held_out_votes(numbers), pa.float64())],
                names=["id", "vote"])

    parts = -(-len(examples.ids) // TOGETHER)
    votes = spark.range(0, len(examples.ids), 1, parts).mapInArrow(cast, "id long, vote double").orderBy("id").toArrow()
    return shared, fit_curve(votes.column("vote").to_numpy(), model.labels), texts


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbours, cosines, terms) per row of ``docs``.

    ``neighbours`` are the doc_ids of the nearest examples, ``terms`` the text's words most tied
    to the label: the evidence. Vectors are over the words of the examples. A text without any of
    them (the empty and the null text too) has no neighbour and the score of the sample's own
    share; without labels that is 0.5. Examples are rows of ``labels`` (doc_id, toxic) outside
    the held-out third, at most ``max_examples`` and, with all their words, MAX_PAIRS. A repeated
    labelled id is one example, toxic if any of its labels says so; null labels do not count.
    Other columns are ignored; an empty table gives no row.
    """
    shared, curve, texts = train(docs, labels, max_examples)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        model.curve = curve
        for batch in batches:
            rows = model.score(_rows(batch))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([r[0] for r in rows], pa.float64()),
                *[pa.array([r[i] for r in rows], pa.list_(kind)) for i, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.string()))],
            ], names=["doc_id", "score", "neighbours", "cosines", "terms"])

    scored = texts.mapInArrow(
        score, "doc_id long, score double, neighbours array<long>, cosines array<double>, terms array<string>")
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "neighbours", "cosines", "terms",
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
