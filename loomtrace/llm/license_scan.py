"""Licence scan: a positional index of rare licence words, in SQL functions only.

One pass counts in how many documents each word of the licence templates occurs. Each key
phrase is then looked up by its rarest words, and a template by the rarest words of its
mandatory phrases, which must stand there in any case: their positions in a document, less their
positions in the template, are intersected, and what is left are the places where the template
may begin; the words at those places decide. A document without any such word is never examined
further. Both passes are projections over the scan; only the document frequencies, one row
per template word, are aggregated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import LOWER, UPPER, table, text_of

# What a word is, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose every place counts, with their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


@dataclass(frozen=True)
class Template:
    """A licence wording: its label, its words, and phrases that must stand in it unchanged."""

    label: str
    text: str
    mandatory: tuple[str, ...] = field(default=())

    @property
    def words(self) -> list[str]:
        return self.text.split()


# Usual wordings of licence notices.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
                    "software and associated documentation files", ("permission is hereby granted",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international", ("attribution noncommercial",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3",
             ("gnu general public license", "version 3")),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2",
             ("gnu general public license", "version 2")),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3",
             ("lesser general public license", "version 3")),
    Template("agpl-3", "licensed under the gnu affero general public license version 3",
             ("affero general public license", "version 3")),
    Template("bsd-3-clause", "redistribution and use in source and binary forms with or without modification "
                             "are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
)


def words_of(column: str = "text") -> Column:
    """The words of a text, in order. Only A-Z are lower-cased, other letters stay."""
    lower = F.translate(text_of(column), UPPER, LOWER)
    return F.regexp_extract_all(lower, F.lit(f"({WORD})"), 1)


def vocabulary(templates=TEMPLATES, phrases=BASE_PHRASES) -> list[str]:
    return sorted({w for t in templates for w in t.words} | {w for p in phrases for w in p.split()})


def inverse_frequencies(docs: DataFrame, words: list[str]) -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) of each template word.

    The result has one number per template word, whatever the corpus.
    """
    there = docs.select(F.array_intersect(words_of(), F.array(*map(F.lit, words))).alias("there"))
    marks = there.select(F.explode(F.concat("there", F.array(F.lit("")))).alias("word"))
    counted = {r["word"]: r["n"] for r in marks.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = counted.get("", 0)
    return {w: math.log((1 + total) / (1 + counted.get(w, 0))) for w in words}


def _positions(words: Column, word: str) -> Column:
    """Where ``word`` stands in ``words``, from 0."""
    marked = F.transform(words, lambda x, i: F.when(x == word, i))
    return F.filter(marked, lambda i: i.isNotNull())


def _less(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _rarest(words: list[str], idf: dict[str, float], n: int) -> list[int]:
    return sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:n]


def _lookup(template: Template, idf: dict[str, float], min_share: float) -> tuple[list[int], bool]:
    """The template's places to look it up by, and whether all of them must be right.

    Two of the rarest words of the mandatory phrases, which stand at every place that counts.
    Without mandatory phrases, so many of the rarest words that the rest weighs too little: one of
    them at least stands at every place that counts.
    """
    words, needed = template.words, set()
    for phrase in template.mandatory:
        part = phrase.split()
        starts = [i for i in range(len(words)) if words[i:i + len(part)] == part]
        if not starts:
            raise ValueError(f"{phrase!r} is not in its template: {template.text!r}")
        needed |= set(range(starts[0], starts[0] + len(part)))
    order = _rarest(words, idf, len(words))
    if needed:
        return [i for i in order if i in needed][:2], True
    total, taken = sum(idf[w] for w in words), 0
    while taken < len(order) and sum(idf[words[i]] for i in order[taken:]) >= min_share * total:
        taken += 1
    return order[:taken], False


def _phrase_starts(phrase: list[str], idf: dict[str, float]) -> Column:
    """Every place where the phrase stands: found by its rarest word, verified word by word."""
    at = _rarest(phrase, idf, 1)[0]
    starts = _less(F.col(f"_at_{phrase[at]}"), at)
    return F.filter(starts, lambda s: (s >= 0) & (
        F.slice("_words", F.greatest(s, F.lit(0)) + 1, len(phrase)) == F.array(*map(F.lit, phrase))
    ))


def _template_score(template: Template, idf: dict[str, float], min_share: float) -> Column:
    """The best share, by inverse frequency, of the template found in place; 0 if a key phrase lacks."""
    words = template.words
    total = sum(idf[w] for w in words) or 1.0
    at, all_needed = _lookup(template, idf, min_share)
    starts, *others = [_less(F.col(f"_at_{words[i]}"), i) for i in at]
    for other in others:
        starts = F.array_intersect(starts, other) if all_needed else F.array_union(starts, other)

    def here(start: Column) -> Column:
        # Words before the text's begin read as absent.
        found = F.concat(
            F.array_repeat(F.lit(""), F.greatest(-start, F.lit(0))),
            F.slice("_words", F.greatest(start, F.lit(0)) + 1, F.greatest(F.lit(len(words)) + F.least(start, F.lit(0)), F.lit(0))),
        )
        pairs = F.zip_with(found, F.array(*[F.struct(F.lit(w).alias("w"), F.lit(idf[w] / total).alias("v")) for w in words]),
                           lambda x, t: F.when(x == t["w"], t["v"]).otherwise(F.lit(0.0)))
        share = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
        joined = F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))
        whole = F.lit(True)
        for phrase in template.mandatory:
            whole = whole & joined.contains(f" {phrase} ")
        return F.when(whole, share).otherwise(F.lit(0.0))

    return F.aggregate(F.transform(starts, here), F.lit(0.0), lambda s, x: F.greatest(s, x))


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=BASE_PHRASES, min_share: float = 0.7) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): phrase counts and places, labels, a score.

    ``n_base``: all places of ``phrases``; ``first_word`` and ``last_word``: the smallest and
    largest of them, null without any. ``labels`` adds the templates of which ``min_share``
    (weighted by inverse document frequency) stands in place with all its key phrases.
    ``score`` is the best such share, 1 where a phrase stands. A null text has no words and no
    labels ('' in both columns). Rows may repeat; other columns are ignored; an empty table
    gives no row.
    """
    idf = inverse_frequencies(docs, vocabulary(templates, phrases))
    phrase_words = {p: p.split() for p in phrases}
    rare = {words[i] for words in phrase_words.values() for i in _rarest(words, idf, 1)}
    rare |= {t.words[i] for t in templates for i in _lookup(t, idf, min_share)[0]}
    anchors = sorted(rare)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of().alias("_all"))
    hit = F.arrays_overlap("_all", F.array(*map(F.lit, anchors)))
    # From here on a text without a rare word has no words left to look at.
    rows = rows.select("doc_id", F.size("_all").cast("long").alias("n_words"), F.when(hit, F.col("_all")).otherwise(
        F.array().cast("array<string>")).alias("_words"))
    rows = rows.select("*", *[_positions(F.col("_words"), w).alias(f"_at_{w}") for w in anchors])
    rows = rows.select(
        "doc_id", "n_words",
        *[_phrase_starts(words, idf).alias(f"_p_{i}") for i, words in enumerate(phrase_words.values())],
        *[_template_score(t, idf, min_share).alias(f"_t_{i}") for i, t in enumerate(templates)],
    )
    places = F.concat(*[F.col(f"_p_{i}") for i in range(len(phrases))])
    base = F.array(*[F.when(F.size(f"_p_{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values())])
    own = F.array(*[F.when(F.col(f"_t_{i}") >= min_share, F.lit(t.label)) for i, t in enumerate(templates)])
    best = F.greatest(*[F.col(f"_t_{i}") for i in range(len(templates))])

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(labels))), ",")

    return rows.select("doc_id", "n_words", places.alias("_places"), base.alias("_base"), own.alias("_own"),
                       best.alias("_best")).select(
        "doc_id", "n_words", F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        joined(F.col("_base")).alias("base_labels"), joined(F.concat("_base", "_own")).alias("labels"),
        F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(F.least(F.col("_best"), F.lit(1.0))).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
