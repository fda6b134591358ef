"""License scans: base phrases by position, and license notices by an exact set-similarity join.

A notice need not be quoted word by word. Texts are read in blocks of words that overlap by half, so every
passage of the length of a template lies whole in some block; a block holds a template if it has at least
``threshold`` of the template's distinct words. Blocks and templates are joined on words, rarest first in the
whole corpus: any pair that meets the threshold shares a word among the first few of both (the prefix). Pairs are
dropped by the length of the block and by the places of the shared word before any set is compared; what is left
is compared exactly. Only built-in functions are used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialkit.llm.common import let, stored

#: Phrases whose words are searched one after the other, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices that licenses ask to be put into files, and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ),
    ("mit-notice", "Released under the MIT License"),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Share of a template's distinct words that a block must have.
THRESHOLD = 0.9
#: Shortest step from block to block, in words; longer templates double it until they fit.
STEP = 16

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words of a text in which capitals are still capitals.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def words_of(text: Column) -> Column:
    """The words of a text, as they are written; none for NULL."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit(_MARKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, _BETWEEN))


def known_words(words: Column, vocabulary: Sequence[str]) -> Column:
    """Place and lower-case form of the words that are in ``vocabulary``, in order."""

    def known(word: Column, i: Column) -> Column:
        # the quick lower() also takes a few letters beyond ASCII for ASCII ones; translate settles it
        small = F.translate(word, _CAPITALS, _SMALL)
        return F.when(F.lower(word).isin(*vocabulary) & small.isin(*vocabulary), F.struct(i.alias("i"), small.alias("w")))

    return F.array_compact(F.transform(words, known))


def _plain_words(text: str) -> list[str]:
    return re.findall(_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Template:
    """A notice as a set of words: how many a block must have, and the step of the blocks it is held against."""

    def __init__(self, label: str, text: str, threshold: float):
        words = _plain_words(text)
        self.label, self.words = label, sorted(set(words))
        self.needed = max(1, math.ceil(round(threshold * len(self.words), 9)))
        self.step = STEP
        while self.step < len(words):
            self.step *= 2


def template_sets(templates: Sequence[tuple[str, str]], threshold: float) -> list[Template]:
    """The templates that have words."""
    sets = [Template(label, text, threshold) for label, text in templates]
    return [t for t in sets if t.words]


def _phrase_starts(known: Column, phrases: Mapping[str, str]) -> Column:
    """For each phrase, the places where its words stand one after the other; ``known`` has all its words."""

    def starts(part: list[str]) -> Column:
        def place(hit: Column, j: Column) -> Column:
            tests = [hit["w"] == part[0]]
            for k, word in enumerate(part[1:], 1):
                after = F.get(known, j + k)
                tests.append(F.coalesce((after["w"] == word) & (after["i"] == hit["i"] + k), F.lit(False)))
            return F.when(reduce(lambda a, b: a & b, tests), hit["i"])

        return F.array_compact(F.transform(known, place))

    return F.array(*[starts(_plain_words(p)) for p in phrases])


def _blocks(known: Column, first: Sequence[str], step: int, order: Column) -> Column:
    """Blocks of 2 ``step`` words that hold one of the words ``first``.

    Each has its number and, in ascending order, the ranks of its distinct known words.
    """
    rare = F.array_compact(
        F.transform(known, lambda hit, j: F.when(hit["w"].isin(*first), F.struct(hit["i"].alias("i"), j.alias("j"))))
    )

    def around(hits: Column) -> Column:
        def numbers(hit: Column, k: Column) -> Column:
            here = F.floor(hit["i"] / step).cast("int")
            before = F.get(hits, k - 1)["i"]
            # a block is taken at the first rare word in it
            new = F.filter(
                F.array(here, here - 1), lambda b: (b >= 0) & ((k == 0) | (before < b * step))
            )
            return F.transform(new, lambda b: F.struct(b.alias("block"), hit["j"].alias("j")))

        return F.flatten(F.transform(hits, numbers))

    def block(at: Column) -> Column:
        low = at["block"] * step
        # places differ, so all known words of the block are this near in the array
        near = F.slice(known, F.greatest(at["j"] - 2 * step, F.lit(0)) + 1, 4 * step + 1)
        inside = F.filter(near, lambda hit: (hit["i"] >= low) & (hit["i"] < low + 2 * step))
        words = F.array_distinct(F.transform(inside, lambda hit: hit["w"]))
        ranks = F.array_sort(F.transform(words, lambda w: F.array_position(order, w).cast("int")))
        return F.struct(F.lit(step).alias("step"), at["block"].alias("block"), ranks.alias("b"))

    return F.transform(let(rare, around), block)


def find_blocks(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """Documents with their phrases, and the blocks that hold a template.

    The first table has a row for each row of ``docs``: ``row``, ``doc_id``, ``n_words`` and ``starts``, for each
    phrase the words it starts at. The second has ``row``, ``label``, ``first_word`` and ``last_word`` of the block,
    and ``containment``, the share of the template's words in it; one row per block and template that meet.
    """
    sets = template_sets(templates, threshold)
    vocabulary = sorted({w for t in sets for w in t.words} | {w for p in phrases for w in _plain_words(p)})
    read = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        let(
            words_of(F.col(f"`{text}`")),
            lambda words: F.struct(F.size(words).cast("bigint").alias("n_words"), known_words(words, vocabulary).alias("known")),
        ).alias("found"),
    )
    # texts are read once; all that follows needs the known words alone
    read = stored(read.select(F.monotonically_increasing_id().alias("row"), "doc_id", "found.*"), "known-words")
    digest = read.select("row", "doc_id", "n_words", _phrase_starts(F.col("known"), phrases).alias("starts"))
    spark = docs.sparkSession
    if not sets:
        return digest, spark.createDataFrame([], "row long, label string, first_word long, last_word long, containment double")

    # the words of the templates, rarest in all documents first; at most the vocabulary reaches the driver
    seen = read.select(F.explode("known.w").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["w"]: r["n"] for r in seen.collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}
    ranked = [(t, sorted(rank[w] for w in t.words)) for t in sets]
    places = [
        (k, t.label, t.step, t.needed, r, r[i], i)
        for k, (t, r) in enumerate(ranked)
        for i in range(len(r) - t.needed + 1)
    ]
    prefix = spark.createDataFrame(places, "template int, label string, step int, needed int, t array<int>, word int, i int")
    ranks = F.array(*[F.lit(w) for w in order])

    def by_step(step: int) -> Column:
        # the prefixes of the templates: every block that meets the threshold has one of these words
        first = sorted({order[word - 1] for _, _, of, _, _, word, _ in places if of == step})
        return _blocks(F.col("known"), first, step, ranks)

    blocks = F.concat(*[by_step(step) for step in sorted({t.step for t in sets})])
    blocks = read.select("row", "n_words", F.explode(blocks).alias("x")).select("row", "n_words", "x.*")
    words = blocks.select("*", F.posexplode("b").alias("j", "word"))
    size_t, size_b = F.size("t"), F.size("b")
    # one row per word of a template's prefix: a table that grows with the templates alone
    pairs = words.join(F.broadcast(prefix), ["step", "word"]).where(
        (size_b >= F.col("needed"))
        & (F.col("j") <= size_b - F.col("needed"))
        & (1 + F.least(size_t - 1 - F.col("i"), size_b - 1 - F.col("j")) >= F.col("needed"))
    )
    shared = F.array_intersect("b", "t")
    # the first shared word speaks for the pair, so no pair is found twice
    pairs = pairs.where((F.size(shared) >= F.col("needed")) & (F.array_min(shared) == F.col("word")))
    start = F.col("block").cast("bigint") * F.col("step")
    hits = pairs.select(
        "row",
        "label",
        start.alias("first_word"),
        (F.least(start + 2 * F.col("step"), F.col("n_words")) - 1).alias("last_word"),
        (F.size(shared) / size_t).alias("containment"),
    )
    return digest, hits


def license_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Phrases and labels per row of ``docs``.

    ``n_words``; ``n_base`` places of phrases, ``first_word`` and ``last_word`` the smallest and largest of them
    (NULL if there are none); ``base_labels``; ``labels``, these and the ones of the templates, distinct, sorted and
    joined by commas; ``score``, 1 where a phrase stands, else the largest containment of a template, 0 without any.

    NULL and empty texts have no words and no labels. Repeated rows, also with one ``doc_id``, are judged each for
    itself. A template that several blocks hold counts once. Other columns of ``docs`` play no part.
    """
    phrases = options.get("phrases", PHRASES)
    digest, hits = find_blocks(docs, doc_id, text, **options)
    found = hits.groupBy("row").agg(F.collect_set("label").alias("extra"), F.max("containment").alias("best"))
    names = F.array_distinct(
        F.array_compact(
            F.array(*[F.when(F.size(F.get("starts", F.lit(k))) > 0, F.lit(v)) for k, v in enumerate(phrases.values())])
        )
    )
    rows = digest.join(found, "row", "left").withColumns({"all": F.flatten("starts"), "names": names})
    extra = F.coalesce("extra", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("all").cast("bigint").alias("n_base"),
        F.array_min("all").cast("bigint").alias("first_word"),
        F.array_max("all").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort("names"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("names", extra)), ",").alias("labels"),
        F.when(F.size("names") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    """All blocks against all templates, and phrases word by word."""
    sets = template_sets(TEMPLATES, THRESHOLD)
    listed = ",\n  ".join(
        f"('{t.label}', {t.step}, {t.needed}, ['" + "', '".join(t.words) + "'])" for t in sets
    )
    phrases = ",\n  ".join(f"(['" + "', '".join(p.split()) + f"'], '{label}')" for p, label in PHRASES.items())
    return rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '{_WORD}') AS w FROM documents
), phrases(p, label) AS (VALUES
  {phrases}
), templates(label, step, needed, t) AS (VALUES
  {listed}
), places AS (
  SELECT doc_id, label, i - 1 AS word_no FROM docs, phrases, unnest(generate_series(1, len(w))) AS g(i)
  WHERE w[i] = p[1] AND w[i : i + len(p) - 1] = p
), blocks AS (
  SELECT doc_id, step, list_distinct(w[b * step + 1 : (b + 2) * step]) AS words
  FROM docs, (SELECT DISTINCT step FROM templates), unnest(generate_series(0, len(w) // step)) AS g(b)
), hits AS (
  SELECT doc_id, label, max(len(list_intersect(words, t)) / len(t)) AS containment
  FROM blocks JOIN templates USING (step) WHERE len(list_intersect(words, t)) >= needed GROUP BY doc_id, label
), base AS (
  SELECT doc_id, count(*) AS n_base, min(word_no) AS first_word, max(word_no) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id
), every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM hits) GROUP BY doc_id
), best AS (SELECT doc_id, max(containment) AS best FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""


LICENSE_SQL = _sql()
