"""Quality rules: counts over whole texts, and the distance to a language's usual text.

The distance is the Jensen-Shannon distance (base 2, 0 to 1) between a document's histogram
and that of the usual texts of its language, once over classes of characters and once over
common words. Each distinct text has one vote, whatever its length and its number of copies;
the votes are gathered over the whole corpus and hold a few hundred numbers per language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomtrace.llm.common import map_batches, saved, slices, text_of

# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to a in is that it for was on are as with by at from this be have or not but "
    "der die und das den von zu mit im für auf ist ein eine auch als dem des sich nicht "
    "le la les des et un une du que qui dans pour par sur est au avec pas en de "
    "el los las del y se no su una lo mi por para como más es"
).split()

# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

CLASSES = ("lower", "upper", "digit", "space", "symbol", "punctuation", "beyond_ascii")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common")

FEATURES = (
    "doc_id long, lang string, digest long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, classes array<long>, common array<long>"
)

#: So many languages, those with the most texts, have their numbers sent to every task; each other one
#: has too small a share of the texts to be a hot key.
MAX_LANGUAGES = 4096

#: A vote is shared out in so many parts, whole numbers, so that sums do not depend on their order.
VOTE = 100_000_000

_WORD_INDEX = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}
N_COMMON = len(_WORD_INDEX)


def _class_of_byte() -> np.ndarray:
    """The class of each UTF-8 byte; continuation bytes belong to none."""
    out = np.full(256, 5, dtype=np.int64)
    out[ord("a"):ord("z") + 1] = 0
    out[ord("A"):ord("Z") + 1] = 1
    out[ord("0"):ord("9") + 1] = 2
    out[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 3
    out[list(SYMBOLS)] = 4
    out[0xC0:] = 6
    out[0x80:0xC0] = 7
    return out


_BYTE_CLASS = _class_of_byte()


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of ``width`` words that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    index = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64)
    if len(ids) == len(words):
        return 0
    # A window is a pair of a shorter window and one more word; pairs are ranked anew
    # at each step, so equal codes mean equal windows.
    code = index
    for i in range(1, width):
        pair = code[:-1] * np.uint64(len(words)) + index[i:]
        code = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
    again = np.bincount(code.astype(np.int64))[code.astype(np.int64)] > 1
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def count_text(text: bytes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common)."""
    words = text.split()
    by_class = np.bincount(_BYTE_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=8)
    lines = Counter(line for line in text.split(b"\n") if line.strip())
    counts = Counter(w.strip(b".,;:!?#*$%&|").lower() for w in words)
    common = [0] * (N_COMMON + 1)
    for word in counts.keys() & _WORD_INDEX.keys():
        common[_WORD_INDEX[word]] = counts[word]
    common[N_COMMON] = len(words) - sum(common)
    return (
        len(words), int(by_class[:7].sum() - by_class[3]), int(by_class[4]),
        sum(lines.values()) - len(lines), repeated_words(words), by_class[:7].tolist(), common,
    )


def _count_batch(cols: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": cols["doc_id"], "lang": cols["lang"], "digest": cols["digest"]}
    rows = [count_text(t) for t in cols["text"]]
    out |= {name: [row[i] for row in rows] for i, name in enumerate(COUNTS)}
    return out


def count_documents(docs: DataFrame) -> DataFrame:
    """One row of counts per document; a null text has no words."""
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.xxhash64(text_of()).alias("digest"), text_of().cast("binary").alias("text"),
    )
    return map_batches(rows, _count_batch, FEATURES)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, row by row, of two matrices of counts; 0 if either row is all zeros."""
    p_sum, q_sum = p.sum(axis=1, keepdims=True), q.sum(axis=1, keepdims=True)
    x, y = p / np.where(p_sum > 0, p_sum, 1), q / np.where(q_sum > 0, q_sum, 1)
    m = (x + y) / 2

    def bits(a: np.ndarray) -> np.ndarray:
        return (a * np.log2(np.where(a > 0, a / np.where(m > 0, m, 1), 1))).sum(axis=1)

    out = np.sqrt(np.maximum((bits(x) + bits(y)) / 2, 0))
    return np.where((p_sum[:, 0] == 0) | (q_sum[:, 0] == 0), 0.0, out)


class ByLanguage:
    """Numbers of each language, beside the rows of that language.

    ``numbers`` has ref_lang, ref_n (texts) and array columns. Those of the MAX_LANGUAGES most
    frequent languages are sent to every task, so that no hot language is ever shuffled; rows of
    all other languages, if there are any, meet theirs in a join.
    """

    def __init__(self, numbers: DataFrame):
        self.numbers = saved(numbers, "quality-by-language")
        self.names = [c for c in numbers.columns if c not in ("ref_lang", "ref_n")]
        top = self.numbers.orderBy(F.desc("ref_n"), "ref_lang").limit(MAX_LANGUAGES + 1).collect()
        self.all_sent = len(top) <= MAX_LANGUAGES
        self.sent = {r["ref_lang"]: i for i, r in enumerate(top[:MAX_LANGUAGES])}
        table = {c: np.array([r[c] for r in top[:MAX_LANGUAGES]], dtype=float) for c in self.names}
        self.shared = numbers.sparkSession.sparkContext.broadcast((self.sent, table))

    def map(self, rows: DataFrame, lang: Column, work: Callable[[pa.RecordBatch, dict], pa.RecordBatch], schema) -> DataFrame:
        """``work`` on batches of ``rows`` and {name: matrix with a row of numbers for each of theirs}."""
        own, shared, names = rows.columns, self.shared, self.names
        prefix = "_" * (1 + max(map(len, own)))  # so that no column has these names
        key = f"{prefix}lang"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    if not part.num_rows:
                        continue
                    if f"{prefix}{names[0]}" in part.schema.names:
                        found = {c: np.array(part.column(f"{prefix}{c}").to_pylist(), dtype=float) for c in names}
                    else:
                        number, table = shared.value
                        at = [number[x] for x in part.column(key).to_pylist()]
                        found = {c: table[c][at] for c in names}
                    yield work(part.select(own), found)

        keyed = rows.withColumn(key, lang)
        if self.all_sent:
            return keyed.mapInArrow(run, schema)
        rest = self.numbers.where(~F.col("ref_lang").isin(list(self.sent))).select(
            F.col("ref_lang").alias(f"{prefix}ref"), *[F.col(c).alias(f"{prefix}{c}") for c in names])
        sent = F.col(key).isin(list(self.sent))
        return keyed.where(sent).mapInArrow(run, schema).unionAll(
            keyed.where(~sent).join(rest, F.col(key) == F.col(f"{prefix}ref")).drop(f"{prefix}ref").mapInArrow(run, schema))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)


def _shares(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1, keepdims=True)
    return counts / np.where(total > 0, total, 1)


def _middle(values: Column) -> Column:
    """The median to three places, so that the state holds a thousand numbers at most."""
    return F.percentile(F.round(values, 3), 0.5)


SHELVES = "lang string, apart long, n long, classes array<long>, common array<long>"


def _on_shelves(batch: pa.RecordBatch, numbers: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The votes of a batch summed up by language and distance to its centre, in thousandths."""
    shares = {c: _shares(_matrix(batch, c)) for c in ("classes", "common")}
    apart = np.rint(js_distance(shares["classes"], numbers["centre"]) * 1000).astype(np.int64)
    langs, number = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
    shelf, at = np.unique(number * 10_000 + apart, return_inverse=True)

    def summed(c: str) -> pa.Array:
        out = np.zeros((len(shelf), shares[c].shape[1]), dtype=np.int64)
        np.add.at(out, at, np.rint(shares[c] * VOTE).astype(np.int64))
        return pa.array(out.tolist(), pa.list_(pa.int64()))

    return pa.RecordBatch.from_arrays(
        [pa.array(langs[shelf // 10_000].tolist(), pa.string()), pa.array(shelf % 10_000, pa.int64()),
         pa.array(np.bincount(at), pa.int64()), summed("classes"), summed("common")],
        names=["lang", "apart", "n", "classes", "common"])


def _sums(rows, n_of_common: int = N_COMMON + 1) -> DataFrame:
    return rows.agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("classes")[i]) for i in range(len(CLASSES))]).alias("classes"),
        F.array(*[F.sum(F.col("common")[i]) for i in range(n_of_common)]).alias("common"))


def usual_references(counts: DataFrame, usual: float) -> ByLanguage:
    """ref_classes and ref_common of each language: the references of ``quality_rules``, from a saved table of counts.

    A language's distinct texts that pass the base rules vote with their shares. The median share
    of each class is a centre that fewer than half of the votes cannot carry off; the votes within
    ``usual`` of it, or no farther than the language's median distance, are summed. Distances
    are taken to three places, so that a language has at most a thousand sums, whose number does
    not grow with its texts. A language without votes has the sum over all languages.
    """
    votes = counts.where(~F.col("base_failed")).dropDuplicates(["lang", "digest"]).select("lang", "classes", "common")
    votes = saved(votes, "quality-votes")
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    shares = [F.col("classes")[i] / F.greatest(total, F.lit(1)) for i in range(len(CLASSES))]
    centres = votes.groupBy(F.col("lang").alias("ref_lang")).agg(
        F.count(F.lit(1)).alias("ref_n"), F.array(*[_middle(s) for s in shares]).alias("centre"))
    shelves = ByLanguage(centres).map(votes, F.col("lang"), _on_shelves, SHELVES)
    shelves = saved(_sums(shelves.groupBy("lang", "apart")), "quality-shelves")
    below = Window.partitionBy("lang").orderBy("apart")
    whole = Window.partitionBy("lang")
    middle = F.min(F.when(2 * F.col("so_far") >= F.col("all"), F.col("apart"))).over(whole)
    near = shelves.withColumns({"so_far": F.sum("n").over(below), "all": F.sum("n").over(whole)}).withColumn(
        "reach", F.greatest(F.lit(round(usual * 1000)), middle)).where("apart <= reach")
    own = saved(_sums(near.groupBy("lang")).withColumnRenamed("lang", "own_lang"), "quality-usual")
    pooled = _sums(own).select(F.col("classes").alias("all_classes"), F.col("common").alias("all_common"))
    langs = counts.groupBy(F.col("lang").alias("ref_lang")).agg(F.count(F.lit(1)).alias("ref_n"))
    return ByLanguage(
        langs.join(own, F.col("ref_lang") == F.col("own_lang"), "left").crossJoin(F.broadcast(pooled)).select(
            "ref_lang", "ref_n", *[_or_pooled(c, n) for c, n in (("classes", len(CLASSES)), ("common", N_COMMON + 1))]))


def _or_pooled(column: str, n: int) -> Column:
    """A language's own sums, or else those of all languages, or else zeros."""
    none = F.array_repeat(F.lit(0).cast("long"), n)
    return F.transform(F.coalesce(column, f"all_{column}", none), lambda x: F.coalesce(x, F.lit(0))).alias(f"ref_{column}")


def _distances(counts: DataFrame, references: ByLanguage) -> DataFrame:
    """``counts`` with each row's distances to the reference of its language."""
    plain = [c for c in counts.columns if c not in ("classes", "common")]

    def measure(batch: pa.RecordBatch, numbers: dict[str, np.ndarray]) -> pa.RecordBatch:
        distances = [pa.array(js_distance(_matrix(batch, c), numbers[f"ref_{c}"])) for c in ("classes", "common")]
        return pa.RecordBatch.from_arrays(
            [*batch.select(plain).columns, *distances], names=[*plain, "class_distance", "word_distance"])

    schema = StructType([*(counts.schema[c] for c in plain), StructField("class_distance", DoubleType()),
                         StructField("word_distance", DoubleType())])
    return references.map(counts, F.col("lang"), measure, schema)


def base_failed(n_words, n_repeat_words):
    """Under 10 words, or over a fifth of them repeated; of columns or of arrays."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def _counted(docs: DataFrame) -> DataFrame:
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return saved(count_documents(docs).withColumn("base_failed", failed), "quality-counts")


@dataclass(frozen=True)
class Bounds:
    """The bounds of the verdict; ``quality_rules`` explains them."""

    max_class_distance: float = 0.13
    max_word_distance: float = 0.4
    min_chars: int = 60
    min_words: int = 100
    chance: float = 1.2
    usual: float = 0.2

    def odd(self, n_words, word_chars, class_distance, word_distance, root, at_least_one):
        """Whether a distance is out of bounds; of columns or of arrays."""
        bound = self.max_class_distance + self.chance / root(at_least_one(word_chars))
        return ((word_chars >= self.min_chars) & (class_distance > bound)) | (
            (n_words >= self.min_words) & (word_distance > self.max_word_distance)
        )


def quality_rules(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """Counts, distances and a verdict per row of ``docs`` (doc_id, text, lang).

    ``base_failed``: under 10 words, or over a fifth of the words in repeated windows.
    ``kept``: not base_failed, and both distances within bounds. A distance counts only for
    texts of at least ``min_chars`` word characters or ``min_words`` words; below, chance
    alone moves a histogram far. The bound of the class distance is ``max_class_distance`` plus
    ``chance`` over the root of the word characters, as chance shrinks with length. A language's
    reference is the mean of its usual texts (``usual_references``), so that neither junk nor a
    long or often copied text shapes what it is held against. A null lang is a language of its
    own; one where no text passes the base rules is held against all languages together.
    Repeated rows give repeated rows; other columns of ``docs`` are ignored; an empty table gives
    none.
    """
    counts = _counted(docs)
    scored = _distances(counts, usual_references(counts, bounds.usual))
    odd = bounds.odd(F.col("n_words"), F.col("word_chars"), F.col("class_distance"), F.col("word_distance"),
                     F.sqrt, lambda c: F.greatest(c, F.lit(1)))
    return scored.withColumn("kept", ~F.col("base_failed") & ~odd).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "class_distance", "word_distance", "base_failed", "kept",
    )


def keep_good(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_rules`` keeps.

    The verdict is made beside the row itself, so no text is shuffled (but those of languages
    beyond MAX_LANGUAGES, each of which few rows have) and no id is needed.
    """
    references = usual_references(_counted(docs), bounds.usual)

    def keep(batch: pa.RecordBatch, numbers: dict[str, np.ndarray]) -> pa.RecordBatch:
        counts = [count_text((t or "").encode()) for t in batch.column("text").to_pylist()]
        cols = {name: np.array([row[i] for row in counts], dtype=float) for i, name in enumerate(COUNTS)}
        odd = bounds.odd(cols["n_words"], cols["word_chars"], js_distance(cols["classes"], numbers["ref_classes"]),
                         js_distance(cols["common"], numbers["ref_common"]), np.sqrt, lambda a: np.maximum(a, 1))
        return batch.filter(pa.array(~base_failed(cols["n_words"], cols["n_repeat_words"]) & ~odd))

    return references.map(docs, F.coalesce(docs["lang"].cast("string"), F.lit("")), keep, docs.schema)
