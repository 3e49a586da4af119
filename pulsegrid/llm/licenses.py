"""License notices found by an exact set-similarity join of text blocks with notice templates.

A block is a window of ``BLOCK`` words; windows start every ``STRIDE`` words, so any passage of that many words lies
whole in one of them, and no template is longer. A block matches a template if it holds at least ``THRESHOLD`` of
the template's distinct words. The join finds every such pair without trying all of them:

* words are ordered by how often they occur in all texts, rarest first (one counting pass);
* prefix filter: a template of m words needs ceil(THRESHOLD * m) of them, so a matching block holds one of its first
  m - need + 1; texts and blocks without such a word are dropped;
* length filter: the block must hold that many template words at all;
* positional filter: if the first shared word stands at place p, at most m - p words can be shared.

What is left is counted exactly. Everything is a column expression inside one projection; no row is shuffled.
A base scan for four fixed phrases stands beside it.

Defined results: a null or empty text has no words, no places, no labels and score 0. Repeated rows give repeated
results. Only the named columns are read, so other columns cannot clash. Texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.llm.common import LOWER, UPPER, llm_query, table

# What parts words (ASCII but letters and digits), the base phrases and their labels.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license notices, as their licenses ask for them to be quoted.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "gpl-notice": "it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-notice": "under the terms of the GNU Lesser General Public License",
    "mit-release": "Released under the MIT License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-attribution": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}

THRESHOLD = 0.9
BLOCK, STRIDE = 48, 24


@dataclass(frozen=True)
class Template:
    """Distinct words of a notice, rarest first; ``need`` of them make a match."""

    label: str
    words: tuple[str, ...]
    need: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.need + 1]


def split_words(text: str) -> list[str]:
    return re.findall(LETTER + "+", text.translate(str.maketrans(UPPER, LOWER)))


def words_column(text: Column) -> Column:
    """Words of a non-null text with A-Z lowered.

    Lowering every script is faster and changes no ASCII letter and no border of a word, but that two signs become ASCII
    letters (Kelvin sign, dotted capital I); texts with one of them have A-Z lowered alone.
    """
    odd = text.contains("\u212a") | text.contains("\u0130")
    lowered = F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(lowered, F.lit(f"({LETTER}+)"))


def word_counts(docs: DataFrame, words: list[str], text: str = "text") -> dict[str, int]:
    """How often each of the given words occurs in all texts: one row per word reaches the driver."""
    body = words_column(F.coalesce(F.col(text), F.lit("")))
    found = docs.select(F.explode(F.filter(body, lambda w: w.isin(words))).alias("word"))
    return {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}


def order_templates(
    docs: DataFrame, notices: dict[str, str], threshold: float = THRESHOLD, text: str = "text"
) -> list[Template]:
    """Templates with their words in the global order of ``docs``, rarest first, ties by the word itself."""
    split = {label: set(split_words(notice)) for label, notice in notices.items()}
    longest = max(len(split_words(notice)) for notice in notices.values())
    if longest > STRIDE:
        raise ValueError(f"a notice may have {STRIDE} words at most")
    counts = word_counts(docs, sorted(set().union(*split.values())), text)
    return [
        Template(
            label, tuple(sorted(words, key=lambda w: (counts.get(w, 0), w))), math.ceil(round(threshold * len(words), 9))
        )
        for label, words in split.items()
    ]


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def matches(words: Column, templates: list[Template]) -> Column:
    """Array of (label, share of the template's words), for every block and template at or above the threshold."""
    rare = _strings(sorted({w for t in templates for w in t.prefix}))
    known = _strings(sorted({w for t in templates for w in t.words}))
    # Every stride starts a block but the last, which another block holds whole, unless it is the only one.
    last = F.greatest(F.ceil(F.size(words) / F.lit(STRIDE)).cast("int") - 2, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, i * STRIDE + 1, BLOCK))
    candidates = F.filter(blocks, lambda b: F.arrays_overlap(b, rare))
    reduced = F.transform(candidates, lambda b: F.array_intersect(b, known))

    def shares(block: Column) -> Column:
        found = []
        for t in templates:
            own = _strings(t.words)
            # Place of the first shared word in the global order: only the prefix can hold it.
            first = F.coalesce(
                *[F.when(F.array_contains(block, w), F.lit(p)) for p, w in enumerate(t.prefix)], F.lit(len(t.words))
            )
            possible = (F.size(block) >= t.need) & (F.lit(len(t.words)) - first >= t.need)
            shared = F.when(possible, F.size(F.array_intersect(block, own)))
            found.append(
                F.when(
                    shared >= t.need,
                    F.struct(F.lit(t.label).alias("label"), (shared / F.lit(len(t.words))).alias("share")),
                )
            )
        return F.array_compact(F.array(*found))

    return F.flatten(F.transform(reduced, shares))


def _phrase_pattern(phrase: str) -> str:
    inner = (GAP + "+").join(re.escape(w) for w in phrase.split())
    return f"(?<!{LETTER}){inner}(?!{LETTER})"


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    notices: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Word count, phrase places, labels and best containment of every document."""
    templates = order_templates(docs, notices, threshold, text)
    rare = _strings(sorted({w for t in templates for w in t.prefix}))
    body = F.coalesce(F.col(text), F.lit(""))
    anywhere = "(?i)(?:" + "|".join(_phrase_pattern(p) for p in PHRASES) + ")"
    n_words = lambda c: F.regexp_count(c, F.lit(LETTER + "+")).cast("long")
    counted = docs.select(
        F.col(f"`{key}`").alias(key),
        body.alias("_text"),
        n_words(body).alias("n_words"),
        F.regexp_count(body, F.lit(anywhere)).cast("long").alias("n_base"),
        words_column(body).alias("_words"),
    )
    found = counted.withColumn(
        "_matches", F.when(F.arrays_overlap("_words", rare), matches(F.col("_words"), templates))
    )
    has_base = F.col("n_base") > 0
    before_first = F.regexp_extract("_text", f"(?s)^(.*?){anywhere}", 1)
    before_last = F.regexp_extract("_text", f"(?s)^(.*){anywhere}", 1)
    base = [F.when(F.col("_text").rlike("(?i)" + _phrase_pattern(p)), F.lit(label)) for p, label in PHRASES.items()]
    labelled = found.withColumns(
        {
            "_base": F.when(has_base, F.array_compact(F.array(*base))).otherwise(F.array().cast("array<string>")),
            "_found": F.coalesce("_matches", F.array().cast("array<struct<label:string,share:double>>")),
        }
    )
    return labelled.select(
        key,
        "n_words",
        "n_base",
        F.when(has_base, n_words(before_first)).alias("first_word"),
        F.when(has_base, n_words(before_last)).alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(
            F.array_sort(F.array_distinct(F.concat("_base", F.transform("_found", lambda m: m["label"])))), ","
        ).alias("labels"),
        F.when(has_base, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.transform("_found", lambda m: m["share"])), F.lit(0.0)))
        .alias("score"),
    )


def _sql() -> str:
    places = []
    for phrase, label in PHRASES.items():
        test = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
        places.append(f"SELECT k, i, '{label}' AS label FROM positions WHERE {test}")
    templates = ", ".join(
        f"('{label}', {sorted(words)}, {math.ceil(round(THRESHOLD * len(words), 9))})"
        for label, words in ((label, set(split_words(notice))) for label, notice in TEMPLATES.items())
    )
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LETTER}+') AS words
  FROM documents
), positions AS (
  SELECT k, words, unnest(range(len(words))) AS i FROM docs
  WHERE list_has_any(words, ['gnu', 'apache', 'cc', 'mit'])
), places AS (
  {" UNION ALL ".join(places)}
), base AS (
  SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS names
  FROM places GROUP BY k
), templates(label, terms, need) AS (VALUES {templates}),
blocks AS (
  SELECT k, list_slice(words, i * {STRIDE} + 1, i * {STRIDE} + {BLOCK}) AS words
  FROM (SELECT k, words, unnest(range(greatest(CAST(ceil(len(words) / {STRIDE}) AS INTEGER), 1))) AS i FROM docs)
), shares AS (
  SELECT k, label, need, len(list_filter(terms, lambda t: list_contains(words, t))) AS shared, len(terms) AS m
  FROM blocks, templates
), found AS (
  SELECT k, list(DISTINCT label) AS names, max(shared / m) AS share FROM shares WHERE shared >= need GROUP BY k
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base.names), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base.names, found.names))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (k) LEFT JOIN found USING (k)"""


@llm_query("op9_license_scan", _sql())
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices found in every document."""
    return scan(table(spark, sf_dir, "documents"))
