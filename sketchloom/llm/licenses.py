r"""License scan: an exact set-similarity join of text blocks with license templates (built-ins only).

A text is its lower-cased words, a template the set of the words of a notice. A template of n words belongs to the
length class of the next power of two s >= n (8 at least), and is compared with blocks of 2 s words that begin at
every multiple of s: any s + 1 consecutive words lie whole in a block. A block matches if it holds at
least ``threshold`` of the template's distinct words. All matching pairs are found:

* Words are ordered by how often the documents have them, the rarest first. Words of no template cannot be
  shared, so blocks keep only the template words of their class.
* Prefix filter: of two sets that share a words, the first common one is among the first |x| - a + 1 of
  the block and the first |t| - a + 1 of the template. Only those are joined.
* Length filter: blocks with fewer template words than the least a of their class are never expanded.
* Positional filter: what is left behind the matched positions must suffice for a.

Survivors are verified on the full sets. Beside that, base phrases are found as consecutive words.

Matches depend on the text alone: they are summed up by its digest and joined back to the rows, so copies
share theirs. Templates are a parameter; they are broadcast only up to ``BROADCAST_ROWS`` entries.

Defined cases: null text is empty; a text without words has no places, no labels and score 0; repeated rows and ids
are rows of their own; an empty table gives an empty result; further columns travel inside a struct, whatever
their names. A template without words is refused.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.session import BROADCAST_ROWS, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Usual notices and grants of public licenses, with their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "no-warranty"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved no part of this publication may be reproduced or transmitted in any form without permission", "reserved"),
)


class Template(NamedTuple):
    number: int
    label: str
    words: frozenset[str]
    step: int
    least: int  # words that a match shares


def templates_of(notices: tuple[tuple[str, str], ...], threshold: float) -> list[Template]:
    out = []
    for number, (text, label) in enumerate(notices):
        words = re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))
        if not words:
            raise ValueError(f"template {number} ({label}) has no words")
        distinct = frozenset(words)
        # Shares are compared exactly, as multiples of a ten-thousandth.
        least = -(-round(threshold * 10_000) * len(distinct) // 10_000)
        out.append(Template(number, label, distinct, max(8, 1 << math.ceil(math.log2(len(words)))), max(least, 1)))
    return out


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def positions(count: Column) -> Column:
    """0 to ``count - 1`` as an array."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def stands_at(words: list[str], i: Column) -> Column:
    return functools.reduce(operator.and_, [F.get("words", i + k) == F.lit(w) for k, w in enumerate(words)])


def scanned(docs: DataFrame, templates: list[Template], phrases: tuple[tuple[str, str], ...], keep: list[str], text_col: str) -> DataFrame:
    """``row, digest, n_words, starts`` (places of each base phrase), ``blocks`` (the template words of each that has enough) and ``held`` (all template words)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.md5(text).alias("digest"), words_of(text).alias("words"))
    # Generated, so that a text is cut into words once and not again for every reference.
    rows = rows.select("row", "digest", F.explode(F.array("words")).alias("words")).withColumn("n", F.size("words"))
    split = [p.split(" ") for p, _ in phrases]
    rows = rows.withColumn("at", F.filter(positions(F.col("n")), lambda i: F.get("words", i).isin(sorted({p[0] for p in split}))))
    starts = [F.filter("at", functools.partial(stands_at, p)) for p in split]

    def blocks(step: int) -> Column:
        own = [t for t in templates if t.step == step]
        vocabulary, least = sorted(frozenset().union(*(t.words for t in own))), min(t.least for t in own)
        number = F.when(F.col("n") > 0, F.greatest(F.ceil(F.col("n") / step).cast("int") - 1, F.lit(1))).otherwise(0)
        kept = F.transform(positions(number), lambda b: F.array_distinct(F.filter(F.slice("words", b * step + 1, F.lit(2 * step)), lambda w: w.isin(vocabulary))))
        return F.transform(F.filter(kept, lambda x: F.size(x) >= least), lambda x: F.struct(F.lit(step).alias("step"), x.alias("words")))

    seen = F.flatten(F.array(*[blocks(s) for s in sorted({t.step for t in templates})])) if templates else F.array().cast("array<struct<step:int,words:array<string>>>")
    every = sorted(frozenset().union(*(t.words for t in templates)))
    held = F.filter("words", lambda w: w.isin(every)) if every else F.array().cast("array<string>")
    return rows.select("row", "digest", F.col("n").cast("bigint").alias("n_words"), F.array(*starts).alias("starts"), seen.alias("blocks"), held.alias("held"))


def ranked_words(rows: DataFrame, templates: list[Template]) -> list[str]:
    """The templates' words, the rarest in the documents (``held`` of :func:`scanned`) first: no more than the templates have."""
    vocabulary = sorted(frozenset().union(*(t.words for t in templates)))
    found = rows.select(F.explode("held").alias("word"))
    many = {r.word: r.many for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("many")).collect()}
    return sorted(vocabulary, key=lambda w: (many.get(w, 0), w))


ENTRY = "template int, label string, step int, least int, size int, whole array<string>, place int, word string"


def prefix_index(spark: SparkSession, templates: list[Template], order: list[str]) -> DataFrame:
    """A row for each word of a template's prefix, with its place in the global order of the template."""
    rank, rows = {w: k for k, w in enumerate(order)}, []
    for t in templates:
        whole = sorted(t.words, key=rank.__getitem__)
        rows += [(t.number, t.label, t.step, t.least, len(whole), whole, place, word) for place, word in enumerate(whole[: len(whole) - t.least + 1])]
    index = spark.createDataFrame(rows, ENTRY)
    return F.broadcast(index) if len(rows) <= BROADCAST_ROWS else index


def matches(blocks: DataFrame, templates: list[Template], order: list[str]) -> DataFrame:
    """``digest, label, share`` of every block and template that meet the threshold; ``blocks(digest, step, words)``."""
    ordered, least = F.lit(None).cast("array<string>"), F.lit(None).cast("int")
    for step in sorted({t.step for t in templates}):
        own = [t for t in templates if t.step == step]
        vocabulary = frozenset().union(*(t.words for t in own))
        here = F.col("step") == step
        # The intersection keeps the order of its first side.
        ordered = F.when(here, F.array_intersect(F.array(*[F.lit(w) for w in order if w in vocabulary]), "words")).otherwise(ordered)
        least = F.when(here, F.lit(min(t.least for t in own))).otherwise(least)
    sets = blocks.select("digest", "step", ordered.alias("ordered"), least.alias("reach")).withColumn("n", F.size("ordered"))
    prefix = F.posexplode(F.slice("ordered", F.lit(1), F.col("n") - F.col("reach") + 1)).alias("at", "word")
    pairs = sets.select("digest", "step", "ordered", "n", prefix).join(prefix_index(blocks.sparkSession, templates, order), ["step", "word"])
    behind = F.least(F.col("n") - F.col("at"), F.col("size") - F.col("place"))
    pairs = pairs.filter((F.col("n") >= F.col("least")) & (behind >= F.col("least")))
    shared = pairs.withColumn("shared", F.size(F.array_intersect("ordered", "whole"))).filter("shared >= least")
    return shared.select("digest", "label", (F.col("shared") / F.col("size")).alias("share"))


def scan(
    docs: DataFrame,
    notices: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = 0.9,
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    keep: list[str] | None = None,
    text_col: str = "text",
) -> DataFrame:
    """``row, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document.

    Labels are sorted arrays. The score is the largest share of a template in one of its matches, and 1 with a base phrase.
    """
    templates = templates_of(notices, threshold)
    rows = materialize(scanned(docs, templates, phrases, docs.columns if keep is None else keep, text_col), "license-scan")
    none = F.array().cast("array<string>")
    found = rows.select("digest", F.inline("blocks"))
    if templates:
        found = matches(found, templates, ranked_words(rows, templates)).groupBy("digest")
    else:
        found = found.select("digest", F.lit("").alias("label"), F.lit(0.0).alias("share")).filter("false").groupBy("digest")
    found = found.agg(F.collect_set("label").alias("matched"), F.max("share").alias("best"))
    places = F.flatten("starts")
    named = [F.when(F.size(F.col("starts")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*named))))
    score = F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return rows.drop("blocks", "held").join(found, "digest", "left").select(
        "row",
        "n_words",
        F.size(places).cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"),
        base.alias("base_labels"),
        F.array_sort(F.array_union(base, F.coalesce("matched", none))).alias("labels"),
        score.alias("score"),
    )
