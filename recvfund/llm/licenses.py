"""License scans with a positional index of rare words.

The index holds every template word with its place. Of each template's mandatory key phrase, the word with the highest
inverse document frequency over the whole corpus is its posting: a text is looked up by exactly those of its licence
words, so common words never open a posting, and no text with the key phrase is missed. A hit at word ``i`` of a text
for a posting at place ``j`` puts the template at ``i - j``; all template words are then compared at their relative
places. The template's label is given wherever its key phrase stands word for word, so a licence that is only named
counts, too; the share of the template found there (weighted by inverse document frequency) is the place's coverage. It
decides no label, but sets the score, which tells a bare name from a whole sentence.

Edge cases: a null or empty text has no words and no places; a phrase that stands several times counts each time; a
text of one word, or one that ends inside a template, is compared up to its end; repeated rows give repeated rows; an
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_of

#: A word of a licence, after A-Z are lower-cased; and the same before.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # the mandatory key phrase, part of text
    base: bool = False


#: Base phrases; the whole phrase is mandatory.
BASE = tuple(Template(label, text, text, True) for label, text in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")))
#: Sentences by which public licences are known (fixed values), with the words that must stand together.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("apache-header", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    Template("mpl-2.0", "mozilla public license v2 0", "mozilla public license v2"),
    Template("mpl-2.0", "mozilla public license version 2 0", "mozilla public license version 2"),
    Template("mpl-2.0", "mozilla public license 2 0", "mozilla public license 2"),
    Template("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc0", "to the extent possible under law all copyright and related rights waived", "copyright and related rights"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-attribution", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
)


def license_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def word_idf(docs: DataFrame, words: Sequence[str]) -> dict[str, float]:
    """Inverse document frequency of the given words over all of ``docs``: one row a word reaches the driver."""
    seen = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.filter(license_words(text_of()), lambda w: w.isin(*words))))).alias("w"))
    df = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: log((1 + df.get("", 0)) / (1 + df.get(w, 0))) + 1 for w in words}  # "": every document


def _index(templates: Sequence[Template], idf: dict[str, float]) -> str:
    """The positional index as an SQL array, a struct a template."""
    out = []
    for t in templates:
        words, key = t.text.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rarest = max(range(len(key)), key=lambda j: (idf[key[j]], len(key[j]), key[j], j))  # of equals the longest, which fewest texts hold inside other words
        total = sum(idf[w] for w in words)
        out.append(
            f"named_struct('label', '{t.label}', 'base', {str(t.base).lower()}, 'posting', '{key[rarest]}', 'place', {at + rarest}, 'key_from', {at}, 'key_to', {at + len(key)}, "
            f"'words', array({', '.join(f"'{w}'" for w in words)}), 'share', array({', '.join(f'{idf[w] / total!r}D' for w in words)}))"
        )
    return f"array({', '.join(out)})"


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Per document: ``doc_id, n_words`` and ``places``, an array of (label, base, at, coverage) in no order."""
    templates = (*BASE, *templates)
    idf = word_idf(docs, sorted({w for t in templates for w in t.text.split()}))
    index = _index(templates, idf)
    postings = sorted({max(t.key.split(), key=lambda w: (idf[w], len(w), w)) for t in templates})
    with_posting = text_of().rlike("(?i)" + "|".join(postings))  # (?i) folds ASCII only
    words = F.when(with_posting, license_words(text_of())).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", F.regexp_count(text_of(), F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"), words.alias("words"))
    listed = ", ".join(f"'{w}'" for w in postings)
    hits = F.expr(f"filter(transform(words, (w, i) -> named_struct('w', w, 'i', i)), h -> h.w in ({listed}))")
    found = found.withColumn("hits", hits)
    placed = F.expr(f"flatten(transform(hits, h -> transform(filter({index}, t -> t.posting = h.w), t -> named_struct('t', t, 'at', h.i - t.place))))")
    found = found.withColumn("placed", placed)
    judged = F.expr("""
        transform(placed, p -> named_struct('label', p.t.label, 'base', p.t.base, 'at', cast(p.at as long),
            'key', forall(transform(p.t.words, (w, j) -> j < p.t.key_from or j >= p.t.key_to or coalesce(get(words, p.at + j) = w, false)), x -> x),
            'coverage', round(aggregate(transform(p.t.words, (w, j) -> if(coalesce(get(words, p.at + j) = w, false), p.t.share[j], 0D)), 0D, (a, x) -> a + x), 6)))""")
    found = found.withColumn("judged", judged)
    places = F.expr("transform(filter(judged, x -> x.key), x -> named_struct('label', x.label, 'base', x.base, 'at', x.at, 'coverage', x.coverage))")
    return found.select("doc_id", "n_words", places.alias("places"))


def license_digest(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of the places found."""
    base = F.filter("places", lambda p: p["base"])
    names = lambda ps: F.array_join(F.array_sort(F.array_distinct(F.transform(ps, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["at"])
    return scan_licenses(docs, templates).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0))).alias("score"),
    )
