"""Hard negatives by slot-decomposed selection.

An anchor's positives are its nearest rows of the same label. Each positive opens a window of
scores, from a low to a high share of its own, in which the best rows of other labels are its
hard negatives. The windows of an anchor overlap. Sorted by falling score, the upper limits of
its positives cut the scores into slots that do not overlap, and a window is all slots from its
own downwards, cut off at its lower limit. So each row is kept for one slot only, every task
keeps the best k of each slot, and after these have met, one merge from the lowest slot to the
highest gives the best k under every upper limit. Its lower limit then only takes rows off the end.

Anchors are a stated set, held against all rows block by block: a bounded block of anchors is
sent to all tasks, which keep a bounded state for it while they read their rows, so no row is
shuffled. Only the best of each task and slot are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import saved, table

#: A block of anchors has at most so many anchors and so many bytes of components.
BLOCK_ANCHORS = 4096
BLOCK_BYTES = 32 << 20
#: Scores computed at once.
_TILE = 1 << 20
#: Whole numbers up to this are exact as doubles.
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
#: A score below all others; no row has it.
_NONE = -_LONG - 1

BEST = "anchor_id long, slot int, best array<struct<below:long,id:long>>"


@dataclass(frozen=True)
class Limits:
    """How many positives and negatives, and the window as tenths of a positive's score."""

    positives: int = 5
    negatives: int = 10
    low_tenths: int = 3
    high_tenths: int = 9


# ---- In tasks

def whole_numbers(vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of floor(scale * x), whether a row's components are all there and finite).

    Rows with fewer components than the longest are filled up with zeros.
    """
    offsets = np.asarray(vectors.offsets)
    flat = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat[offsets[0]:offsets[-1]]
    with np.errstate(over="ignore"):
        out = np.floor(scale * out)
    return out, np.isfinite(out).all(axis=1)


def _wide(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond the range of a long they are its ends."""
    width = max(rows.shape[1], anchors.shape[1])
    rows, anchors = _wide(rows, width), _wide(anchors, width)
    if width * np.abs(rows).max(initial=0) * np.abs(anchors).max(initial=0) < _EXACT:
        return (rows @ anchors.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    product = exact(rows) @ exact(anchors).T
    return np.clip(product, -_LONG, _LONG).astype(np.int64)


@dataclass
class Block:
    """Some anchors by rising id; for each, the window of each of its positives once they are known."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    upper: np.ndarray | None = None
    lower: np.ndarray | None = None


class SlotBest:
    """The best k (highest score, then smallest id) of every anchor and slot so far."""

    def __init__(self, n_anchors: int, n_slots: int, k: int):
        self.n_slots, self.k = n_slots, k
        self.score = np.full((n_anchors * n_slots, k), _NONE, dtype=np.int64)
        self.id = np.zeros((n_anchors * n_slots, k), dtype=np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, slot: np.ndarray) -> None:
        """``score`` and ``slot`` (-1: none) of rows by anchors, and the ids of the rows."""
        cell = np.arange(slot.shape[1])[None, :] * self.n_slots + slot
        worst, worst_id = self.score[:, -1][cell], self.id[:, -1][cell]
        better = (slot >= 0) & ((score > worst) | ((score == worst) & (ids[:, None] < worst_id)))
        row, anchor = np.nonzero(better)
        if not len(row):
            return
        cells, touched = cell[row, anchor], np.unique(cell[row, anchor])
        all_cell = np.concatenate([cells, np.repeat(touched, self.k)])
        all_score = np.concatenate([score[row, anchor], self.score[touched].ravel()])
        all_id = np.concatenate([ids[row], self.id[touched].ravel()])
        # Ids of empty places are 0, but no row has their score.
        order = np.lexsort((all_id, ~all_score, all_cell))
        all_cell, all_score, all_id = all_cell[order], all_score[order], all_id[order]
        starts = np.searchsorted(all_cell, touched)
        keep = starts[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = all_score[keep], all_id[keep]

    def rows(self, ids: np.ndarray) -> Iterator[dict]:
        for cell in np.flatnonzero(self.score[:, 0] > _NONE):
            there = self.score[cell] > _NONE
            yield {
                "anchor_id": int(ids[cell // self.n_slots]), "slot": int(cell % self.n_slots),
                "best": [{"below": -s, "id": i} for s, i in
                         zip(self.score[cell][there].tolist(), self.id[cell][there].tolist(), strict=True)],
            }


def _pass(rows: DataFrame, block, n_slots: int, k: int, scale: int,
          slots: Callable[[Block, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """BEST of each task: ``slots`` gives the slot of each row for each anchor, or -1."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(BEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        state = SlotBest(len(anchors.ids), n_slots, k)
        step = max(1, _TILE // max(1, len(anchors.ids)))
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            vectors, good = whole_numbers(batch.column("vector"), scale)
            ids, labels, vectors = ids[good], labels[good], vectors[good]
            for start in range(0, len(ids), step):
                part = slice(start, start + step)
                score = scores(vectors[part], anchors.vectors)
                state.add(score, ids[part], slots(anchors, score, ids[part], labels[part]))
        found = list(state.rows(anchors.ids))
        for start in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_pylist(found[start:start + 10_000], schema=arrow)

    best = rows.mapInArrow(run, BEST)
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    return best.groupBy("anchor_id", "slot").agg(merged.alias("best"))


def _same_label(anchors: Block, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """One slot: the other rows of the anchor's label."""
    same = (labels[:, None] == anchors.labels[None, :]) & (ids[:, None] != anchors.ids[None, :])
    return np.where(same, 0, -1)


def _slot_of(anchors: Block, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The last positive whose upper limit the score does not pass; -1 below its lower limit or for the same label."""
    open_windows = np.zeros(score.shape, dtype=np.int64)
    for i in range(anchors.upper.shape[1]):
        open_windows += score <= anchors.upper[:, i]
    lowest = anchors.lower[np.arange(score.shape[1])[None, :], np.maximum(open_windows - 1, 0)]
    there = (open_windows > 0) & (score >= lowest) & (labels[:, None] != anchors.labels[None, :])
    return np.where(there, open_windows - 1, -1)


# ---- On Spark

def _blocks(anchors: DataFrame, scale: int) -> Iterator[Block]:
    """The anchors in blocks of bounded size, by rising id; of rows with one id, that least by label and vector."""
    whole = F.forall("vector", lambda x: F.coalesce(F.abs(scale * x) < float("inf"), F.lit(False)))
    rows = anchors.where(whole).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    one = saved(rows.select("vec_id", "row.label", "row.vector").repartitionByRange("vec_id")
                .sortWithinPartitions("vec_id"), "negatives-anchors")
    width = one.agg(F.max(F.size("vector"))).first()[0] or 0
    most = max(1, min(BLOCK_ANCHORS, BLOCK_BYTES // (8 * max(width, 1))))
    after = None
    while True:
        rest = one if after is None else one.where(F.col("vec_id") > after)
        part = rest.orderBy("vec_id").limit(most).toArrow()
        if part.num_rows:
            vectors, _ = whole_numbers(part.column("vector").combine_chunks(), scale)
            ids, labels = (part.column(c).to_numpy() for c in ("vec_id", "label"))
            yield Block(ids, labels, vectors)
            after = int(ids[-1])
        if part.num_rows < most:
            return


def hard_negatives(rows: DataFrame, anchors: Column, limits: Limits = Limits(), scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label (long) and vector (array of numbers); ``anchors`` is the condition
    that makes a row an anchor. Components count as floor(``scale`` * x); a score is their inner
    product, missing components being 0. Rows with a null id, label, vector or component, or one
    that is not finite after scaling, take no part. Ties go to the smaller id. Rows that repeat an
    id each count, except as anchors, where the least by label and vector stands for them. An
    anchor without positives, or a positive without negatives, has no row.
    """
    clean = rows.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<double>"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    out = None
    for block in _blocks(clean.where(anchors), scale):
        found = saved(_block_negatives(clean, block, limits, scale), "negatives")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], (
            "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"))
    return out


def _share(score: str, tenths: int, add: int = 0) -> Column:
    """``tenths`` tenths of a score, rounded down (or up, with ``add`` 9), within the range of a long."""
    tens = F.expr(f"({score} - pmod({score}, 10)) DIV 10")
    return tens * tenths + F.floor((F.pmod(score, F.lit(10)) * tenths + add) / 10)


def _block_negatives(rows: DataFrame, block: Block, limits: Limits, scale: int) -> DataFrame:
    context, m = rows.sparkSession.sparkContext, limits.positives
    nearest = _pass(rows, context.broadcast(block), 1, m, scale, _same_label)
    positives = nearest.select("anchor_id", F.posexplode("best").alias("place", "row")).select(
        "anchor_id", "place", F.col("row.id").alias("positive_id"), (-F.col("row.below")).alias("positive_score"))
    positives = saved(positives.withColumns({
        "upper": _share("positive_score", limits.high_tenths),
        "lower": _share("positive_score", limits.low_tenths, 9),
    }), "negatives-positives")
    # At most ``limits.positives`` rows for each anchor of the block.
    known = positives.toArrow()
    at, place, upper, lower = (known.column(c).to_numpy() for c in ("anchor_id", "place", "upper", "lower"))
    at = np.searchsorted(block.ids, at)
    block = replace(
        block, upper=np.full((len(block.ids), m), _NONE, dtype=np.int64),
        lower=np.full((len(block.ids), m), _LONG, dtype=np.int64),
    )
    block.upper[at, place], block.lower[at, place] = upper, lower
    best = _pass(rows, context.broadcast(block), m, limits.negatives, scale, _slot_of)
    # A positive's window is its own slot and those below, which hold falling scores.
    slots = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", "best"))).alias("slots"))
    own = F.filter("slots", lambda x: x["slot"] >= F.col("place"))
    window = F.slice(F.flatten(F.transform(own, lambda x: x["best"])), 1, limits.negatives)
    return (
        positives.join(slots, "anchor_id")
        .select("anchor_id", "positive_id", "positive_score", "lower", F.posexplode(window).alias("before", "row"))
        .where(-F.col("row.below") >= F.col("lower"))
        .select("anchor_id", "positive_id", (F.col("before") + 1).alias("rank"), F.col("row.id").alias("negative_id"),
                "positive_score", (-F.col("row.below")).alias("negative_score"))
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.col("embedding").alias("vector"),
    )
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
           list_inner_product(a.v, r.v)::BIGINT AS score
    FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
 AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
