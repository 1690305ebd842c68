"""Operator 4: licence notices by an exact containment join with templates."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.frames import cut

#: Phrases of words in a row and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices and their labels: the usual short wording of public licences (fixed values).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("epl-2.0", "Made available under the terms of the Eclipse Public License 2.0"),
    ("all-rights-reserved", "All rights reserved"),
)
#: A block holds a template if it has this share of the template's distinct words.
CONTAINMENT = 0.95

#: Runs of characters that are in no word (letters A-Z count as their small forms).
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_ascii(text: Column) -> Column:
    """Small letters for A-Z.  Other letters may change too, but never into or out
    of an ASCII sign: the one letter whose small form is ASCII is set aside."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("ĸ")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def template_words(templates: Sequence[tuple[str, str]]) -> list[tuple[str, tuple[str, ...]]]:
    """(label, distinct words) of each template."""
    return [(label, tuple(dict.fromkeys(_WORD.findall(text.lower())))) for label, text in templates]


def word_order(docs: DataFrame, text: str, words: Sequence[str]) -> dict[str, int]:
    """Rank of each template word by its count in the whole corpus, rarest first.
    As many rows as there are template words come to the driver."""
    every = docs.select(F.explode(words_of(lower_ascii(F.col(text)))).alias("word"))
    counts = {r["word"]: r["n"] for r in every.where(F.col("word").isin(list(words))).groupBy("word")
              .agg(F.count("*").alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(words, key=lambda w: (counts.get(w, 0), w)))}


def phrase_starts(words: Column, phrase: str) -> Column:
    """Word positions at which the words of ``phrase`` stand in a row."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + j) == part)
        return same
    last = F.size(words) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)).otherwise(
        F.array().cast("array<int>"))


def _gapped(words: Sequence[str]) -> str:
    return _GAP.join(re.escape(w) for w in words)


def _needed(n: int, containment: float) -> int:
    return max(1, math.ceil(containment * n - 1e-9))


def find_templates(blocks: DataFrame, templates: Sequence[tuple[str, tuple[str, ...]]], order: dict[str, int],
                   reach: Sequence[int], containment: float = CONTAINMENT) -> DataFrame:
    """(row, label, score): templates that a block of the row contains.

    ``blocks`` has (row, block, wrapped).  Both sides are lists of word ranks, rarest
    first.  A wrapped block holds a template only where ``reach`` of its words in a
    row, the template's own number, do; what passes the filters is looked at once
    more, window by window.
    A block and a template that share enough words share one within the first
    words of each (prefix filter); the block must be long enough (length filter),
    and what follows the shared word must suffice (positional filter).  The index
    of template prefixes has a fixed size, given by the templates.  Of two templates
    held by one block, one whose words are among the other's is left out.
    """
    spark = blocks.sparkSession
    ranked = [(i, label, sorted(order[w] for w in words)) for i, (label, words) in enumerate(templates)]
    wider = {i: [j for j, _, more in ranked if set(ranks) < set(more)] for i, _, ranks in ranked}
    index = spark.createDataFrame(
        [(r, p, i, label, ranks, _needed(len(ranks), containment), wider[i], reach[i]) for i, label, ranks in ranked
         for p, r in enumerate(ranks[:len(ranks) - _needed(len(ranks), containment) + 1])],
        "rank int, place int, template int, label string, ranks array<int>, need int, wider array<int>, reach int")
    least = min(_needed(len(ranks), containment) for _, _, ranks in ranked)
    known = F.create_map(*[F.lit(x) for w, r in order.items() for x in (w, r)])
    ranks = F.array_sort(F.filter(F.transform(F.array_distinct(words_of(F.col("block"))), lambda w: known[w]),
                                  lambda r: r.isNotNull()))
    in_row = F.when(F.col("wrapped"), F.transform(words_of(F.col("block")), lambda w: F.coalesce(known[w], F.lit(-1))))
    sides = blocks.select("row", F.monotonically_increasing_id().alias("at"), ranks.alias("own"), in_row.alias("in_row")).where(F.size("own") >= least)
    tokens = sides.select("row", "at", "own", "in_row", F.posexplode(F.slice("own", F.lit(1), F.size("own") - (least - 1))).alias("own_place", "rank"))
    met = tokens.join(F.broadcast(index), "rank")
    met = met.where("size(own) >= need and own_place <= size(own) - need")
    met = met.where("least(size(own) - own_place, size(ranks) - place) >= need")
    met = met.withColumn("shared", F.size(F.array_intersect("own", "ranks"))).where("shared >= need")
    starts = F.sequence(F.lit(1), F.greatest(F.size("in_row") - F.col("reach") + 1, F.lit(1)))
    within = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("in_row", i, F.col("reach")), "ranks"))))
    met = met.withColumn("shared", F.when(F.col("in_row").isNull(), F.col("shared")).otherwise(within)).where("shared >= need")
    held = met.groupBy("row", "at").agg(F.collect_set(F.struct(
        "template", "label", "wider", (F.col("shared") / F.size("ranks")).alias("score"))).alias("held"))
    narrow = F.filter("held", lambda t: ~F.arrays_overlap(t["wider"], F.col("held.template")))
    best = held.select("row", F.explode(narrow).alias("t")).select("row", "t.label", "t.score")
    return best.groupBy("row", "label").agg(F.max("score").alias("score"))


def run_reach(templates: Sequence[tuple[str, str]]) -> list[int]:
    """Words in a row in which a wrapped copy of each template must lie: its own
    number and a quarter more, for words that start each line of a comment."""
    return [math.ceil(1.25 * len(_WORD.findall(text.lower()))) for _, text in templates]


def word_runs(words: Column, reach: int) -> Column:
    """Runs of 2 * ``reach`` words, one starting every ``reach`` words: any ``reach``
    words in a row lie inside one of them."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(reach))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(2 * reach)), " "))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of ``docs``: its key, words, phrase places and labels.

    ``n_words``; ``n_base`` (all places of the base phrases), ``first_word`` and
    ``last_word`` (smallest and largest start, null without one), ``base_labels``;
    ``labels`` (with those of the templates that some block of the text contains)
    and ``score`` (best share of a template's words found in a block, 0 without a
    template).  Blocks are the lines and, where there are several, also runs of
    words across their ends, as notices wrap; there a template's words must lie
    within its own reach (see ``run_reach``).  Labels are distinct, sorted and
    comma-joined, empty without any.

    Null text counts as empty.  Repeated rows are scanned each; a null key stays
    null; an empty table gives no rows; other columns are not carried.  Two scans:
    one counts the template words over the corpus, one finds phrases and candidate
    blocks.  Blocks meet a template index of fixed size, so nothing is keyed by a
    word or block of the corpus, and results go back by row number.
    """
    parts = template_words(templates)
    order = word_order(docs, text, sorted({w for _, words in parts for w in words}))
    starts = sorted({w for _, words in parts
                     for w in sorted(words, key=order.get)[:len(words) - _needed(len(words), containment) + 1]})
    maybe = "(?<![0-9a-z\\x{80}-\\x{10FFFF}])(?:" + "|".join(map(re.escape, starts)) + ")(?![0-9a-z\\x{80}-\\x{10FFFF}])"

    low = docs.select(F.col(key), lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    low = low.select(key, "low", words_of(F.col("low")).alias("words"))
    places, none = {}, F.array().cast("array<int>")
    for phrase, label in PHRASES.items():
        places[label] = F.when(F.col("low").rlike(_gapped(phrase.split())), phrase_starts(F.col("words"), phrase)).otherwise(none)
    reach = run_reach(templates)

    def likely(blocks: Column, wrapped: bool) -> Column:
        return F.transform(F.filter(blocks, lambda b: b.rlike(maybe)), lambda b: F.struct(b.alias("block"), F.lit(wrapped).alias("wrapped")))
    text_blocks = F.when(F.col("low").contains("\n"), F.concat(
        likely(F.split("low", "\n"), False), likely(word_runs(F.col("words"), max(reach)), True))).otherwise(likely(F.array("low"), False))
    text_blocks = F.when(F.col("low").rlike(maybe), text_blocks).otherwise(F.array().cast("array<struct<block:string,wrapped:boolean>>"))
    found = low.select(key, F.size("words").cast("long").alias("n_words"), F.monotonically_increasing_id().alias("row"),
                       *[c.alias(f"at_{i}") for i, c in enumerate(places.values())], text_blocks.alias("blocks"))
    found = cut(found)
    every = F.concat(*[F.col(f"at_{i}") for i in range(len(places))])
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, label in enumerate(places)]))
    rows = found.select("row", key, "n_words", F.size(every).cast("long").alias("n_base"),
                        F.array_min(every).cast("long").alias("first_word"),
                        F.array_max(every).cast("long").alias("last_word"), base.alias("base"))
    blocks = found.where(F.size("blocks") > 0).select("row", F.inline("blocks"))
    held = find_templates(blocks, parts, order, reach, containment).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("score").alias("score"))
    joined = F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>"))))), ",")
    return rows.join(held, "row", "left").select(
        key, "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        joined.alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
