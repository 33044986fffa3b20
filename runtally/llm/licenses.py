"""License scans: an exact set-similarity join of text blocks with license templates.

A text is the sequence of its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased. Templates
are grouped by size: for templates of up to ``w`` words (8, 16, 32, ...) a text has a block of 2 w
words from every w-th word on, so that every stretch of w + 1 words lies in one block. A block
matches a template when it holds at least ``threshold`` of the template's distinct words; all such
pairs are found:

* *Order.* The words of all templates are ordered by the number of documents that hold them, rarest
  first, counted over the whole table. Words of no template cannot add to an overlap, so a block
  is reduced to template words.
* *Prefix.* With ``need = ceil(threshold * size)``, a match must hold one of the first
  ``size - need + 1`` words of the template. Only blocks around such words are looked at, and
  texts without any are done after one lookup.
* *Length.* A block needs ``need`` template words.
* *Position.* Behind the first shared prefix word at most the rest of either side can be shared.
* What is left is compared word by word.

Beside the join, phrases (words standing consecutively) are found with their places.

How it runs. Built-in functions only, one row at a time: templates are constants of the plan, whose
size is checked (``MOST_WORDS``), so there is no shuffle but that of the word counts, which are
added up map-side. Many copies of a license cost one row each.

Defined results: a null text is empty, has no words and matches nothing; repeated rows get a row
each; all other columns are carried along, of ``n_words``, ``phrases`` and ``blocks`` the new ones
replace old ones; blocks come in the order of place and template; equal counts are ordered by the
word itself; an empty table gives an empty table. The table is read twice.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str


# Notices by which works are put under common licenses, as published.
TEMPLATES = (
    Template("mit-notice", "mit", "Released under the MIT License."),
    Template(
        "mit-grant",
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    Template("apache-notice", "apache", "Licensed under the Apache License, Version 2.0."),
    Template(
        "apache-terms",
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License "
        "at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    Template("gpl-notice", "gpl", "This work is licensed under the GNU General Public License, version 3."),
    Template(
        "gpl-terms",
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    Template(
        "bsd-terms",
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    Template(
        "isc-grant",
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    Template(
        "mpl-notice", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
    Template("cc-by-nc", "cc-by-nc", "Licensed under CC BY-NC 4.0."),
    Template("cc-by", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("reserved", "reserved", "All rights reserved."),
)

# Phrases and their labels.
PHRASES = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)

#: Distinct words that all templates together may have: they are constants of the plan.
MOST_WORDS = 20_000
#: Words of the smallest blocks' templates.
LEAST_WIDTH = 8

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLOCKS = "array<struct<first_word:long,template:string,label:string,last_word:long,containment:double>>"
_PHRASES = "array<struct<first_word:long,label:string,last_word:long>>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """The words of a text, as an array."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    # lower() would also change letters beyond A-Z
    ascii_only = F.length(body) == F.octet_length(body)
    lowered = F.when(ascii_only, F.lower(body)).otherwise(F.translate(body, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(lowered, _BETWEEN, -1), "")


def template_words(text: str) -> list[str]:
    """The distinct words of a template."""
    lowered = text.translate(str.maketrans(_UPPER, _UPPER.lower()))
    return sorted({w for w in re.split(_BETWEEN, lowered) if w})


def width_of(template: Template) -> int:
    lowered = re.split(_BETWEEN, template.text)
    return max(LEAST_WIDTH, 1 << (sum(1 for w in lowered if w) - 1).bit_length())


def need_of(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def word_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest word first, by the documents of ``words`` (words: array) that hold it."""
    held = words.select(F.explode(F.array_intersect("_words", _strings(vocabulary))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _phrase_places(words: Column, phrase: tuple[str, ...], label: str) -> Column:
    def here(i: Column) -> Column:
        same = [F.get(words, i + k) == word for k, word in enumerate(phrase)]
        out = same[0]
        for more in same[1:]:
            out = out & more
        return out

    present = F.array_contains(words, phrase[0])
    for word in phrase[1:]:
        present = present & F.array_contains(words, word)
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    places = F.transform(
        starts,
        lambda i: F.struct(
            i.cast("long").alias("first_word"), F.lit(label).alias("label"), (i + len(phrase) - 1).cast("long").alias("last_word")
        ),
    )
    return F.when(present, places).otherwise(F.array()).cast(_PHRASES)


def _matches(words: Column, width: int, order: list[str], templates: list[Template], threshold: float) -> Column:
    """The blocks of one width that match one of its templates."""
    rank = {w: i for i, w in enumerate(order)}
    sets = [sorted(template_words(t.text), key=rank.__getitem__) for t in templates]
    needs = [need_of(len(s), threshold) for s in sets]
    prefixes = [s[: len(s) - n + 1] for s, n in zip(sets, needs)]
    rare = sorted({w for p in prefixes for w in p}, key=rank.__getitem__)
    known = sorted({w for s in sets for w in s}, key=rank.__getitem__)
    asked = F.array(
        *(
            F.struct(
                F.lit(t.name).alias("name"),
                F.lit(t.label).alias("label"),
                F.lit(need).alias("need"),
                _strings(of).alias("words"),
                _strings(prefix).alias("prefix"),
            )
            for t, of, need, prefix in zip(templates, sets, needs, prefixes)
        )
    )
    anchors = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(_strings(rare), F.get(words, i)))
    numbers = F.array_distinct(
        F.flatten(F.transform(anchors, lambda i: F.array(F.floor(i / width) - 1, F.floor(i / width))))
    )
    places = F.array_sort(F.filter(numbers, lambda b: b >= 0))
    # in the order of ``known``: rarest first
    blocks = F.transform(
        places,
        lambda b: F.struct(
            (b * width).alias("at"),
            F.array_intersect(_strings(known), F.slice(words, (b * width + 1).cast("int"), F.lit(2 * width))).alias("words"),
        ),
    )

    def compared(block: Column, t: Column) -> Column:
        met = F.get(F.array_intersect(t["prefix"], block["words"]), F.lit(0))
        rest = F.least(
            F.size(t["words"]) - F.array_position(t["words"], met), F.size(block["words"]) - F.array_position(block["words"], met)
        )
        return F.when(
            (F.size(block["words"]) >= t["need"]) & met.isNotNull() & (rest + 1 >= t["need"]),
            F.size(F.array_intersect(t["words"], block["words"])),
        ).otherwise(F.lit(0))

    def of_block(block: Column) -> Column:
        shared = F.transform(asked, lambda t: F.struct(t.alias("t"), compared(block, t).alias("n")))
        return F.transform(
            F.filter(shared, lambda x: x["n"] >= x["t"]["need"]),
            lambda x: F.struct(
                block["at"].alias("first_word"),
                x["t"]["name"].alias("template"),
                x["t"]["label"].alias("label"),
                F.least(block["at"] + 2 * width, F.size(words)).cast("long") - 1,
                x["n"] / F.size(x["t"]["words"]),
            ).cast(_BLOCKS[6:-1]),
        )

    found = F.flatten(F.transform(blocks, of_block)).cast(_BLOCKS)
    return F.when(F.arrays_overlap(words, _strings(rare)), found).otherwise(F.array().cast(_BLOCKS))


def scan(
    df: DataFrame,
    text: str = "text",
    templates: tuple[Template, ...] = TEMPLATES,
    phrases: tuple[tuple[tuple[str, ...], str], ...] = PHRASES,
    threshold: float = 0.9,
) -> DataFrame:
    """Add n_words, phrases (first_word, label, last_word of every place, in order) and blocks (first_word,
    template, label, last_word, containment of every matching pair) to each row."""
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold must be above 0 and at most 1, not {threshold}")
    templates = tuple(t for t in templates if template_words(t.text))
    vocabulary = sorted({w for t in templates for w in template_words(t.text)})
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"the templates have {len(vocabulary)} distinct words, more than {MOST_WORDS}")
    kept = [c for c in df.columns if c not in {"n_words", "phrases", "blocks"}]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], words_of(F.col(f"`{text}`")).alias("_words"))
    words = F.col("_words")
    order = word_order(rows, vocabulary) if vocabulary else []
    by_width: dict[int, list[Template]] = {}
    for t in templates:
        by_width.setdefault(width_of(t), []).append(t)
    found = [_matches(words, width, order, by_width[width], threshold) for width in sorted(by_width)]
    places = [_phrase_places(words, phrase, label) for phrase, label in phrases]
    return rows.select(
        *[F.col(f"`{c}`") for c in kept],
        F.size(words).cast("long").alias("n_words"),
        F.array_sort(F.concat(*places) if places else F.array().cast(_PHRASES)).alias("phrases"),
        F.array_sort(F.concat(*found) if found else F.array().cast(_BLOCKS)).alias("blocks"),
    )


def matching_blocks(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """The join itself: a row per text block and template that match, with the block's columns
    instead of old ones of the same names."""
    # inline() alone would have the planner derive filters from the whole expression of the blocks
    rows = scan(df, text, **options).drop("n_words", "phrases", "first_word", "template", "label", "last_word", "containment")
    return rows.select("*", F.inline_outer("blocks")).drop("blocks").where(F.col("template").isNotNull())
