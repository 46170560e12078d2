"""License scans: a positional index of rare licence words, checked by mandatory phrases."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.llm.common import let, let_all, lower_ascii, text_of, total, where, words_of

#: What separates words here: ASCII other than letters and digits, after A-Z became a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose places are counted, with their labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Template:
    """A licence notice and the phrases that a text must hold to be given its label."""

    label: str
    text: str
    required: tuple[str, ...]


#: Openings of widely used licence notices (fixed values).
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files to deal in the software without restriction",
        ("permission is hereby granted",),
    ),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template(
        "gpl",
        "this work is licensed under the gnu general public license version 3",
        ("general public license",),
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation",
        ("redistribute it and or modify it",),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided "
        "that the following conditions are met",
        ("redistribution and use", "binary forms"),
    ),
    Template("cc", "this work is licensed under a creative commons attribution license", ("creative commons",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
)


def rarity(templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of every licence word, over the templates."""
    df = Counter(w for t in templates for w in set(t.text.split()))
    return {w: math.log((1 + len(templates)) / (1 + n)) + 1 for w, n in df.items()}


def index(templates: tuple[Template, ...], rare_words: int) -> dict[str, list[tuple[int, int]]]:
    """Postings (template, position) of each template's ``rare_words`` rarest words, ties by word.

    Words that occur in three templates or more, or of three letters or fewer without being
    a licence's name, mark nothing and are left out.
    """
    idf = rarity(templates)
    common = {w for w, n in Counter(w for t in templates for w in set(t.text.split())).items() if n >= 3}
    names = {"mit", "gnu"}
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        words = t.text.split()
        fit = [w for w in set(words) - common if len(w) > 3 or w in names]
        for w in sorted(fit, key=lambda w: (-idf[w], w))[:rare_words]:
            for p in (p for p, x in enumerate(words) if x == w):
                postings.setdefault(w, []).append((k, p))
    return postings


def _at(words: Column, start: Column, phrase: tuple[str, ...]) -> Column:
    """Whether ``phrase`` stands at index ``start``; out of range is false."""
    test = F.lit(True)
    for k, w in enumerate(phrase):
        test = test & F.coalesce(F.get(words, start + k) == w, F.lit(False))
    return test


def _found(words: Column, phrase: str) -> Column:
    """Start indexes of a phrase, looked up by its last word."""
    parts = tuple(phrase.split())
    ends = where(words, lambda w: w == parts[-1])
    starts = F.transform(ends, lambda e: F.when((e >= len(parts) - 1) & _at(words, F.greatest(e - (len(parts) - 1), F.lit(0)), parts), e - (len(parts) - 1)).otherwise(F.lit(-1)))
    return F.array_remove(starts, -1)


def scan(
    documents: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    rare_words: int = 6,
    least_share: float = 0.75,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Licence phrases and notices of every text, in one pass and without a shuffle.

    Each text's rare licence words are looked up in the templates' positional
    postings. A hit votes for (template, relative position); at the best relative
    position the share of the template's words that stand in place is measured
    (all its words, not only the indexed ones). A template counts when that share
    is at least ``least_share`` and its mandatory phrases are in the text.

    Returns key, n_words, n_base (places of the phrases), first_word, last_word
    (their smallest and largest start, null without one), base_labels, labels
    (comma-joined, sorted, distinct; those of the phrases always stay) and score:
    1 where a phrase was found, else the best share of a counted template, else 0.
    Null and empty texts have no words. Repeated rows each give a row; other
    columns are dropped.
    """
    postings = index(templates, rare_words)
    lexicon = sorted(postings)
    indexed = [t.text.split() for t in templates]
    postings_map = F.create_map(
        *(
            x
            for w in lexicon
            for x in (
                F.lit(w),
                F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in postings[w])),
            )
        )
    )

    def shares(words: Column, rare: Column) -> Column:
        """Per template its best share of words in place, from the rare words' votes."""
        votes = F.flatten(
            F.transform(rare, lambda i: F.transform(postings_map[F.get(words, i)], lambda x: F.struct(x["k"].alias("k"), (i - x["p"]).alias("at"))))
        )
        places = F.array_distinct(F.transform(votes, lambda v: v["k"].cast("long") * F.lit(1 << 32) + v["at"].cast("long")))

        def share(place: Column) -> Column:
            k = F.floor((place + F.lit(1 << 31)) / F.lit(float(1 << 32))).cast("int")
            at = (place - k.cast("long") * F.lit(1 << 32)).cast("int")
            template = F.get(F.array(*(F.array(*(F.lit(w) for w in t)) for t in indexed)), k)
            agree = total(
                F.transform(
                    template,
                    lambda w, j: F.when((at + j >= 0) & F.coalesce(F.get(words, F.greatest(at + j, F.lit(0))) == w, F.lit(False)), 1).otherwise(0),
                )
            )
            return F.struct(k.alias("k"), (agree / F.size(template)).alias("share"))

        return F.transform(places, share)

    def verdict(words: Column) -> Column:
        rare = where(words, lambda w: w.isin(lexicon))

        def build(rare: Column, *found: Column) -> Column:
            base = F.flatten(F.array(*found))
            base_labels = F.array(*(F.when(F.size(f) > 0, F.lit(label)) for f, (_, label) in zip(found, PHRASES, strict=True)))

            def result(measured: Column) -> Column:
                best = [
                    F.coalesce(F.array_max(F.transform(F.filter(measured, lambda m: m["k"] == k), lambda m: m["share"])), F.lit(0.0))
                    for k in range(len(templates))
                ]
                passed = []
                for k, t in enumerate(templates):
                    held = best[k] >= least_share
                    for phrase in t.required:
                        held = held & (F.size(_found(words, phrase)) > 0)
                    passed.append(held)
                own = F.array(*(F.when(p, F.lit(t.label)) for p, t in zip(passed, templates, strict=True)))
                top = F.greatest(*(F.when(p, b).otherwise(F.lit(0.0)) for p, b in zip(passed, best, strict=True)))
                names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.array_compact(a))), ",")
                return F.struct(
                    F.size(words).cast("long").alias("n_words"),
                    F.size(base).cast("long").alias("n_base"),
                    F.array_min(base).cast("long").alias("first_word"),
                    F.array_max(base).cast("long").alias("last_word"),
                    names(base_labels).alias("base_labels"),
                    names(F.concat(base_labels, own)).alias("labels"),
                    F.when(F.size(base) > 0, F.lit(1.0)).otherwise(top).alias("score"),
                )

            return let(shares(words, rare), result)

        return let_all([rare, *(_found(words, p) for p, _ in PHRASES)], build)

    cells = let(words_of(lower_ascii(text_of(text)), GAP), verdict)
    return documents.select(F.col(key), cells.alias("_found")).select(key, "_found.*")
