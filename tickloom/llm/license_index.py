"""License scan with a positional rare-token index, in DataFrame functions only.

Templates are short word sequences of licence texts.  Each template is indexed
under its words of highest inverse document frequency (counted over the whole
corpus): the postings say at which place of which template a word stands.  A
file's licence words are looked up, every posting turns the word's place in the
file into a place where the template would start, and postings that agree on a
start are intersected.  A start counts when enough index words agree, the
mandatory key phrase stands at its relative place, and the share of template
words in place is high enough.  *Base* templates demand every word; they give the
counts and places of the scan.

One scan of the texts keeps the template words of each, and all words of those that
have every word of some key phrase; it is stored.  Everything else happens within the
row: the only shuffle is the partial aggregate of the document frequencies, one row
per template word and task.

Words are runs of ASCII letters and digits and of characters from U+0080 up, after
lower-casing A-Z.  Null text is empty; without words all counts are zero, places
null, labels empty and the score 0.  Repeated rows are scanned alike, no documents
give no rows, extra columns are ignored.  Ties in frequency go to the smaller word.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored


class Template(NamedTuple):
    label: str
    text: str
    #: Phrase of the template that must stand at its place; all words for base templates.
    key: str
    base: bool = False


# Licence phrases and labels.
TEMPLATES = [
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge to any person"),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    Template("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, as an array; empty for null."""
    spaced = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(F.length(spaced) == 0, F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def analysed(docs: DataFrame, *, doc_id="doc_id", text="text", templates=TEMPLATES) -> DataFrame:
    """id, n_words, the template words ``present``, and the words ``w`` of texts that have all words of a key phrase.

    Other texts can't match, so they keep no words: the one scan of the texts.
    """
    known = F.array(*map(F.lit, sorted({w for t in templates for w in t.text.split()})))
    keys = [F.array(*map(F.lit, k)) for k in sorted({tuple(sorted(set(t.key.split()))) for t in templates})]
    split = docs.select(F.col(doc_id).alias("id"), words(F.col(text)).alias("w"))
    seen = split.select("id", "w", F.array_intersect("w", known).alias("present"))
    may = reduce(or_, (F.size(F.array_except(k, F.col("present"))) == 0 for k in keys))
    return stored(seen.select("id", F.size("w").cast("long").alias("n_words"), "present", F.when(may, F.col("w")).otherwise(F.array().cast("array<string>")).alias("w")), "licences")


def document_frequencies(found: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many each template word occurs: at most one row for each."""
    counts = dict(found.select(F.explode("present").alias("word")).groupBy("word").count().collect())
    return found.count(), counts


def build_index(found: DataFrame, *, templates=TEMPLATES, rare=4):
    """Postings word -> [(template, place)] for each template's ``rare`` words of highest IDF, and the IDFs."""
    split = [t.text.split() for t in templates]
    vocabulary = sorted({w for s in split for w in s})
    n, df = document_frequencies(found)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, s in enumerate(split):
        most = 1 if templates[t].base else rare
        for w in sorted(set(s), key=lambda x: (-idf[x], x))[:most]:
            for place in (i for i, x in enumerate(s) if x == w):
                postings.setdefault(w, []).append((t, place))
    return postings, idf


def _struct(**values) -> Column:
    return F.struct(*(v.alias(k) for k, v in values.items()))


def scan(docs: DataFrame, *, doc_id="doc_id", text="text", templates=TEMPLATES, rare=4, agree=2, share=0.75) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and ``matches``
    (template label, first word, share, base) of every row."""
    analysis = analysed(docs, doc_id=doc_id, text=text, templates=templates)
    postings, _ = build_index(analysis, templates=templates, rare=rare)
    index_words = F.array(*map(F.lit, sorted(postings))).cast("array<string>")
    lookup = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*(_struct(t=F.lit(t), p=F.lit(p)) for t, p in postings[w])))])

    def places(t: int, phrase: str) -> tuple[int, list[str]]:
        own, part = templates[t].text.split(), phrase.split()
        return next(i for i in range(len(own)) if own[i : i + len(part)] == part), part

    facts = []
    for t, template in enumerate(templates):
        own = template.text.split()
        at, part = places(t, template.key)
        anchors = sorted({(p, w) for w, ps in postings.items() for u, p in ps if u == t})
        facts.append(_struct(
            label=F.lit(template.label), base=F.lit(template.base), own=F.array(*map(F.lit, own)), key_at=F.lit(at), key=F.array(*map(F.lit, part)),
            anchors=F.array(*(_struct(p=F.lit(p), w=F.lit(w)) for p, w in anchors)), agree=F.lit(1 if template.base else min(agree, len({w for _, w in anchors}))), share=F.lit(1.0 if template.base else float(share)),
        ))
    table = F.array(*facts)

    marked = analysis.select("id", "n_words", "w", F.when(F.arrays_overlap("w", index_words), F.filter(F.transform("w", lambda w, i: _struct(w=w, i=i)), lambda m: F.array_contains(index_words, m["w"]))).alias("marks"))
    # template and place as one number: numbers are told apart by hashing, structs pair by pair
    coded = F.flatten(F.transform("marks", lambda m: F.transform(F.filter(F.element_at(lookup, m["w"]), lambda x: m["i"] >= x["p"]), lambda x: F.shiftleft(x["t"].cast("long"), 40) + (m["i"] - x["p"]))))
    starts = F.transform(F.array_distinct(coded), lambda c: _struct(t=F.shiftright(c, 40).cast("int"), at=c.bitwiseAND(F.lit((1 << 40) - 1)).cast("int")))
    started = marked.select("id", "n_words", "w", starts.alias("starts"))

    def word(i: Column) -> Column:
        return F.get(F.col("w"), i)

    def judged(s: Column) -> Column:
        f = F.get(table, s["t"])
        agreeing = F.size(F.filter(f["anchors"], lambda a: word(s["at"] + a["p"]).eqNullSafe(a["w"])))
        keyed = F.forall(F.transform(f["key"], lambda k, j: word(s["at"] + f["key_at"] + j).eqNullSafe(k)), lambda x: x)
        same = F.size(F.filter(F.transform(f["own"], lambda o, j: word(s["at"] + j).eqNullSafe(o)), lambda x: x)) / F.size(f["own"])
        return _struct(label=f["label"], first_word=s["at"].cast("long"), share=F.when((agreeing >= f["agree"]) & keyed & (same >= f["share"]), same), base=f["base"])

    found = started.select("id", "n_words", F.coalesce(F.filter(F.transform("starts", judged), lambda x: x["share"].isNotNull()), F.array().cast("array<struct<label:string,first_word:bigint,share:double,base:boolean>>")).alias("matches"))
    found = found.withColumn("base", F.filter("matches", lambda x: x["base"]))
    firsts = F.transform("base", lambda x: x["first_word"])
    label_list = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    return found.select(
        F.col("id").alias(doc_id), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        label_list("base").alias("base_labels"), label_list("matches").alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda x: x["share"])), F.lit(0.0)).alias("score"), "matches",
    )
