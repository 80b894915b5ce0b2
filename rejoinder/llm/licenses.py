"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A template is the words of a license statement. A block is a run of words of a text, over line ends, that begins with
a word of the template and is half as long again as it (so a statement that is wrapped, with comment marks or some
words between, is one block). A block meets a template if it holds at least ``containment`` of the template's distinct
words. It tells the license if among them are those that tell it from its neighbours (``must``), and none of those that
only a neighbour has (``bar``); blocks that meet a template without that are reported beside. All words are put in one order, rarest in the corpus first (counted over all texts; words of no template
meet nothing and need no place). A text can only have such a block if it meets the template as a whole, and the join
finds every such pair from few words: the text holds one of the template's first |T| - ceil(c |T|) + 1 words (prefix),
has at least ceil(c |T|) words of templates (length), and after a word met at place i of the template and j of the text
at most min(|T| - i, |B| - j) words can be shared (position). What is left is verified on the sets, then block by
block. The word list and the templates' prefixes are bounded by the templates given, which is why they can be broadcast.

Beside it, ``phrases`` counts every place where given phrases stand, which the join's labels are added to.

Defined cases: a null text is empty: no words, no labels, score 0; an empty table gives no rows; rows with the same
doc_id are scanned each for itself; a null doc_id is kept; a very long text is scanned whole, and blocks are made only
where words of a template stand; of templates with one label the largest containment counts; extra columns are
ignored. Only A-Z are lower-cased.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.shared import stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.8
#: Phrases and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Statements of public licenses by label.
TEMPLATES = {
    "mit": ["released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "apache-2": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "gpl-3": ["licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}
#: Words of a template that tell it from other licenses' statements, and words that it must not have, by label.
MUST = {"mit": {"mit"}, "apache-2": {"apache", "2"}, "cc-by-nc": {"nc", "noncommercial"}, "cc-by": {"attribution"}, "gpl-3": {"gnu", "3"}, "mpl-2": {"mozilla", "2"}}
BAR = {"cc-by-nc": {"sa", "nd", "sharealike", "noderivatives", "noderivs"}, "cc-by": {"noncommercial", "sharealike", "noderivatives", "noderivs"}, "gpl-3": {"lesser", "affero"}}


def word_list(text: str) -> list[str]:
    """Distinct words of a template, in their order."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return list(dict.fromkeys("".join(c if c.isalnum() or ord(c) > 127 else " " for c in low).split()))


def span_of(text: str) -> int:
    """Places that a template's words may take over line ends: half as many again as it has, repeated ones too."""
    low = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).split()
    return len(low) + len(low) // 2


def rules(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, list[str], int, list[str], list[str]]]:
    """label, words, span, must, bar of every template that has words."""
    sets = [(label, word_list(t), span_of(t)) for label, ts in templates.items() for t in ts]
    return [(label, words, span, sorted(MUST.get(label, set()) & set(words)), sorted(BAR.get(label, set()) - set(words))) for label, words, span in sets if words]


def lower(text: Column | str) -> Column:
    return F.translate(text, UPPER, LOWER)


def _best_blocks(words: Column, template: Column, span: Column, must: Column, bar: Column) -> Column:
    """The most of a template's distinct words in any block of the text (met), and in one that tells the license (told).

    A block that tells it has what it must and nothing that bars it.
    """
    placed = F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    hits = F.filter(placed, lambda x: F.array_contains(template, x["w"]) | F.array_contains(bar, x["w"]))

    def sizes(own: Column) -> Column:
        def held(hit: Column, k: Column) -> Column:
            near = F.filter(F.slice(own, k + 1, span), lambda x: x["i"] < hit["i"] + span)
            block = F.array_distinct(F.transform(near, lambda x: x["w"]))
            shared = F.when(F.array_contains(template, hit["w"]), F.size(F.array_intersect(block, template))).otherwise(F.lit(0))
            tells = ~F.arrays_overlap(block, bar) & (F.size(F.array_intersect(block, must)) == F.size(must))
            return F.struct(shared.alias("met"), F.when(tells, shared).otherwise(F.lit(0)).alias("told"))

        return F.transform(own, held)

    # arrays of one name the hits and their sizes, so that each is found once
    each = F.element_at(F.transform(F.array(hits), sizes), 1)
    top = lambda own, name: F.coalesce(F.array_max(F.transform(own, lambda x: x[name])), F.lit(0)).alias(name)
    return F.element_at(F.transform(F.array(each), lambda own: F.struct(top(own, "met"), top(own, "told"))), 1)


def template_matches(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Of every text and license with a block that meets a template: row, label, met (the largest containment) and
    containment (that of blocks that tell the license from its neighbours; null without). docs: row, text (not null)."""
    sets = rules(templates)
    vocabulary = sorted({w for _, words, *_ in sets for w in words})
    listed = F.array(*[F.lit(w) for w in vocabulary])
    texts = docs.select("row", "text", F.split(lower("text"), SEPARATORS).alias("words"))
    held = texts.select(F.explode(F.array_intersect(listed, "words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = {r["word"]: r["n"] for r in held.collect()}  # at most one row per word of the templates
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}

    rows = []
    for label, words, span, must, bar in sets:
        words = sorted(words, key=place.get)
        need = math.ceil(containment * len(words) - 1e-9)
        rows += [(w, i, label, len(words), need, span, words, must, bar) for i, w in enumerate(words[: len(words) - need + 1])]
    prefixes = docs.sparkSession.createDataFrame(rows, "word string, i int, label string, size int, need int, span int, template array<string>, must array<string>, bar array<string>")

    prefix_words = F.array(*[F.lit(w) for w in sorted({r[0] for r in rows})])
    ordered = F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("words"))  # in the order of all words
    found = texts.filter(F.arrays_overlap("words", prefix_words)).select("row", "words", ordered.alias("own"))
    places = F.filter(F.transform("own", lambda w, j: F.struct(w.alias("word"), j.alias("j"))), lambda x: F.array_contains(prefix_words, x["word"]))
    met = found.select("row", "words", "own", F.inline(places)).join(F.broadcast(prefixes), "word")
    fits = (F.size("own") >= F.col("need")) & (F.least(F.col("size") - F.col("i"), F.size("own") - F.col("j")) + F.least("i", "j") >= F.col("need"))
    shared = F.array_intersect("own", "template")
    # of the words that bring a text and a template together the first one does
    pairs = met.filter(fits).filter((F.size(shared) >= F.col("need")) & (F.element_at(shared, 1) == F.col("word")))
    best = pairs.select("row", "label", "size", "need", _best_blocks(*map(F.col, ("words", "template", "span", "must", "bar"))).alias("best"))
    enough = lambda name: F.max(F.when(F.col(f"best.{name}") >= F.col("need"), F.col(f"best.{name}") / F.col("size")))
    return best.groupBy("row", "label").agg(enough("met").alias("met"), enough("told").alias("containment")).filter("met IS NOT NULL")


def phrases(docs: DataFrame, given: dict[str, str] = PHRASES) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base (labels, distinct, sorted). docs: text (not null).

    Words stand in a string with two spaces before each and one at the ends, so neighbouring places share none.
    """
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower("text"), SEPARATORS, "  ")), F.lit(" "))
    own = docs.withColumn("spaced", spaced)
    n_words = F.when(F.length("spaced") == 2, F.lit(0).cast("long")).otherwise(((F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit("")))) / 2).cast("long"))
    own = own.withColumn("n_words", n_words)
    places, firsts, lasts, labels = [], [], [], []

    def spaces(x: Column) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))

    for phrase, label in given.items():
        seek = " " + "  ".join(phrase.split()) + " "
        there = F.contains("spaced", F.lit(seek))
        n = (F.length("spaced") - F.length(F.replace("spaced", F.lit(seek), F.lit("")))) / len(seek)
        places.append(F.when(there, n.cast("long")).otherwise(F.lit(0).cast("long")))
        firsts.append(F.when(there, (spaces(F.substring_index("spaced", seek, 1)) / 2).cast("long")))
        after = spaces(F.substring_index("spaced", seek, -1)) / 2
        lasts.append(F.when(there, F.col("n_words") - len(phrase.split()) - after.cast("long")))
        labels.append(F.when(there, F.lit(label)))
    own = own.withColumn("n_base", sum(places[1:], places[0]))
    return own.select("*", F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_sort(F.array_distinct(F.filter(F.array(*labels), lambda x: x.isNotNull()))).alias("base")).drop("spaced")


def license_scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, given: dict[str, str] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, met_labels, met_score.

    score is the largest containment of a template in a block that tells its license, 1 where a phrase stands, else 0.
    met_labels and met_score are those of every block that meets a template, also where neighbours' words stand in it.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("row", F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("text").alias("text")))
    based = phrases(own, given).drop("text")
    found = template_matches(own, templates, containment).groupBy("row").agg(F.collect_set(F.when(F.col("containment").isNotNull(), F.col("label"))).alias("added"), F.max("containment").alias("best"), F.collect_set("label").alias("met_labels"), F.max("met").alias("met"))
    found = stored(found, "licenses")
    joined = based.join(found, "row", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("added", F.array().cast("array<string>")))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.array_join(F.array_sort(F.coalesce("met_labels", F.array().cast("array<string>"))), ",").alias("met_labels"), F.coalesce("met", F.lit(0.0)).alias("met_score"))
