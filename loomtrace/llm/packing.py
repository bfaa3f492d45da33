"""Best-fit packing of token sequences, decided on the histogram of lengths.

A plan needs only how many pieces of each length there are: at most ``capacity`` numbers,
whatever the corpus. Pieces above a third of the capacity are matched greedily, longest first
and at most two to a sequence, each with the longest partner that fits; smaller ones go, longest
first, into the tightest gap. The plan is a list of sequence patterns with a number of copies
each. Pieces then take their places by their number among the pieces of their length, which
needs no global order: a length is split over salts, and only counts per salt are added up.
"""

from __future__ import annotations

import copy
import re
import sys
import types
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtrace.llm.common import map_batches, saved, table, text_of

CAPACITY = 2048
#: Words whose ids are remembered, and characters split into words at a time.
CACHE = 400_000
SPLIT_CHARS = 1 << 22
#: Most pieces of one length that are numbered in one task, on average.
SALT_ROWS = 250_000
#: White space to str.split, but not to the tokenizer.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Fixed value: what the tokenizer's tokens end with where a word ends.
END_OF_WORD = "</w>"

_LETTERS_AND_SIGNS = re.compile(r"([^\W\d_]+)([!-/:-@\[-^`{-~]*)")


# --- tokens ---------------------------------------------------------------------------------

class WordTokens:
    """Ids of whole texts, word by word: the tokenizer drops white space and never crosses it."""

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(END_OF_WORD)]] = True
        self.odd = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + list(SEPARATORS)

    def without_words(self) -> WordTokens:
        """The same tokenizer, with words of its own to remember."""
        other = copy.copy(self)
        other.known, other.older = {}, {}
        return other

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. The string of a special token is that token, as in the tokenizer."""
        first, chars = 0, 0
        for i, text in enumerate(texts):
            chars += len(text)
            if chars >= SPLIT_CHARS or i + 1 == len(texts):
                yield from self._ids(texts[first:i + 1])
                first, chars = i + 1, 0

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = [not any(mark in text for mark in self.odd) for text in texts]
        split = [text.split() if ok else [] for text, ok in zip(texts, plain, strict=True)]
        self._learn(set().union(*split))
        known = self.known.__getitem__
        for text, words, ok in zip(texts, split, plain, strict=True):
            if ok:
                yield np.frombuffer(b"".join(map(known, words)), dtype="<u4")
            else:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        fresh = []
        for word in words - self.known.keys():
            found = self.older.get(word)
            if found is None:
                fresh.append(word)
            else:
                self.known[word] = found
        # Most new words are letters with or without signs behind them: letters and signs are
        # encoded apart, each once, in lower case as the tokenizer has them.
        cut = {w: m.end(1) for w in fresh if (m := _LETTERS_AND_SIGNS.fullmatch(w.lower())) and "Σ" not in w}
        letters = {w.lower()[:n] for w, n in cut.items()} - self.known.keys()
        others = {w[n:] for w, n in cut.items()} | {w for w in fresh if w not in cut}
        self.known.update(self._of_letters(sorted(letters)))
        self.known.update(self._one_by_one(sorted(others - self.known.keys())))
        for word, n in cut.items():
            self.known[word] = self.known[word.lower()[:n]] + self.known[word[n:]]

    def _one_by_one(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        for start in range(0, len(words), 2000):
            part = words[start:start + 2000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                yield word, np.array(found.ids, dtype="<u4").tobytes()

    def _of_letters(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Many words as one text; the ids that end a word tell them apart."""
        for start in range(0, len(words), 1000):
            part = words[start:start + 1000]
            found = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype="<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                yield from ((w, raw[a:b]) for w, a, b in zip(part, [0, *cuts[:-1]], cuts, strict=True))
            else:
                yield from self._one_by_one(part)


def _worker_tokens(spec: str) -> WordTokens:
    """One tokenizer per Python worker; it outlives the task, and so do the words it has met."""
    kept = sys.modules.setdefault("_word_tokens", types.ModuleType("_word_tokens"))
    key = f"of_{zlib.crc32(spec.encode())}"
    if not hasattr(kept, key):
        setattr(kept, key, WordTokens(spec))
    return getattr(kept, key)


def pieces_of(docs: DataFrame, spec: str, capacity: int = CAPACITY, end_id: int = 0, keep_words: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row, cut only where longer than ``capacity``.

    ``spec``: the tokenizer's JSON. A text's ids end with ``end_id``; a null or empty text is
    that id alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    end = np.array([end_id], dtype="<u4")
    own: list[WordTokens] = []  # of each task

    def work(cols: dict[str, list]) -> dict[str, list]:
        if not own:
            tokens = _worker_tokens(shared.value)
            own.append(tokens if keep_words else tokens.without_words())
        tokens = own[0]
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, ids in zip(cols["doc_id"], tokens.ids(cols["text"]), strict=True):
            ids = np.concatenate([ids, end])
            for piece, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start:start + capacity]
                for name, value in (("doc_id", doc_id), ("piece", piece), ("start", start),
                                    ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes()))):
                    out[name].append(value)
        return out

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return map_batches(rows, work, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the plan -------------------------------------------------------------------------------

class _Counts:
    """Counts by length, with the largest length up to a bound that is still there."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: n for k, n in counts.items() if n > 0}
        self.lengths = sorted(self.counts)

    def largest(self, bound: int) -> int | None:
        i = bisect_right(self.lengths, bound) - 1
        return self.lengths[i] if i >= 0 else None

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, copies)] that hold exactly ``counts`` (length -> pieces).

    Its length grows with the number of different lengths, not with the pieces.
    """
    large = _Counts({k: n for k, n in counts.items() if 3 * k > capacity})
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # gap -> patterns

    def put(pattern: tuple[int, ...], copies: int) -> None:
        open_bins.setdefault(capacity - sum(pattern), []).append((pattern, copies))

    while (first := large.largest(capacity)) is not None:
        n = large.counts[first]
        second = large.largest(capacity - first)
        if second is None:
            large.take(first, n)
            put((first,), n)
        elif second == first:
            pairs = n // 2
            if pairs:
                large.take(first, 2 * pairs)
                put((first, first), pairs)
            if n % 2:
                large.take(first, 1)
                other = large.largest(capacity - first)
                if other is not None:
                    large.take(other, 1)
                put((first,) if other is None else (first, other), 1)
        else:
            pairs = min(n, large.counts[second])
            large.take(first, pairs)
            large.take(second, pairs)
            put((first, second), pairs)

    gaps = sorted(open_bins)
    for length in sorted((k for k in counts if 3 * k <= capacity and counts[k] > 0), reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # no gap: new sequences, as full as this length makes them
                fit = min(capacity // length, n)
                copies = n // fit
                pattern, used = (length,) * fit, fit * copies
                gap = capacity - length * fit
            else:
                gap_before = gaps[at]
                base, there = open_bins[gap_before].pop()
                fit = min(gap_before // length, n)
                copies = min(there, n // fit)
                if copies < there:
                    open_bins[gap_before].append((base, there - copies))
                if not open_bins[gap_before]:
                    del open_bins[gap_before]
                    gaps.pop(at)
                pattern, used = base + (length,) * fit, fit * copies
                gap = gap_before - length * fit
            n -= used
            if gap not in open_bins:
                insort(gaps, gap)
            open_bins.setdefault(gap, []).append((pattern, copies))
    return [x for patterns in open_bins.values() for x in patterns]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: (first number, first sequence, offset) of each run of places, by number."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for pattern, copies in patterns:
        offset = 0
        for length in pattern:
            start = given.get(length, 0)
            runs.setdefault(length, []).append((start, sequence, offset))
            given[length] = start + copies
            offset += length
        sequence += copies
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in runs.items()}


# --- places ---------------------------------------------------------------------------------

def numbered_by_length(pieces: DataFrame, rows: int) -> DataFrame:
    """``pieces`` with ``number``, 0, 1, ... within each length.

    A length is dealt over enough salts for its share of all rows, so one that holds most
    pieces still meets many tasks; the numbers of a salt follow those of the salts before it.
    """
    salts = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SALT_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    placed = salted.withColumn("_place", F.row_number().over(within) - 1)
    return placed.join(starts, ["length", "_salt"]).withColumn(
        "number", F.col("_start") + F.col("_place")).drop("_salt", "_start", "_place")


def pack(docs: DataFrame, spec: str, capacity: int = CAPACITY, end_id: int = 0, keep_words: bool = True) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text), with its sequence and its place in it.

    (doc_id, piece, start, length, ids_crc32, sequence_id, offset). Every row is packed, null
    and empty texts as the end id alone, repeated rows each on their own; rows with a null id
    too. Other columns are ignored; an empty table gives no row. Sequences are filled from
    0 without gaps. ``keep_words``: a worker remembers words from task to task, which is faster;
    without it their memory is free again for what runs after.
    """
    spark = docs.sparkSession
    pieces = saved(pieces_of(docs, spec, capacity, end_id, keep_words), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = slots(plan(counts, capacity))  # counts: at most ``capacity`` rows
    shared = spark.sparkContext.broadcast(found)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            for one in np.unique(length):
                here = np.flatnonzero(length == one)
                starts, sequences, offsets = shared.value[int(one)]
                run = np.searchsorted(starts, number[here], side="right") - 1
                sequence[here] = sequences[run] + number[here] - starts[run]
                offset[here] = offsets[run]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"])

    return numbered_by_length(pieces, sum(counts.values())).mapInArrow(place, schema)


def read_tokenizer(spark: SparkSession, path: str) -> str:
    """The JSON of a tokenizer: a file beside the driver, sent to the tasks by broadcast."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    spec = read_tokenizer(spark, public_tokenizers.path("word_bpe_49k.json"))
    return pack(table(spark, sf_dir, "documents"), spec)
