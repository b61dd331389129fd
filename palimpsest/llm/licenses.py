"""License scans by diagonal voting.

Word k-grams of documents are joined to the positions of the same k-grams in
templates.  Matches of one template at one distance between the two positions lie on
a diagonal; neighbouring diagonals (a word more or less) are one place.  A vote counts
only if its words are equal, not merely their hash.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.expr import let
from palimpsest.llm.common import lower_ascii, texts

#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose places are reported one by one.  Fixed values.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: Notices of public licences, by label; they count if most of their words are there.
NOTICES = {
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files, to deal in the software without restriction",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "gpl-notice": "licensed under the GNU General Public License, version 3",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc0": "released into the public domain under CC0 1.0",
    "reserved": "All rights reserved",
}

#: Words in a k-gram of a notice; a phrase is one gram of its own length.
NOTICE_GRAM = 3
#: Diagonals at most this far apart are one place.
DIAGONAL_GAP = 2
#: Share of a notice's words that a place must have.
MIN_COVERAGE = 0.75


def _split(text: str) -> list[str]:
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " if c.isascii() else c for c in text).split(" ")


def _template_rows(phrases: Mapping[str, str], notices: Mapping[str, str]) -> list[tuple]:
    rows = []
    for own, templates, k in (
        (True, [(label, phrase) for phrase, label in phrases.items()], None),
        (False, list(notices.items()), NOTICE_GRAM),
    ):
        for label, text in templates:
            w = [x for x in _split(text) if x]
            size = min(k or len(w), len(w))
            rows += [
                (label, own, size, at, " ".join(w[at : at + size]), len(w)) for at in range(len(w) - size + 1)
            ]
    return rows


def _lowered(text: Column) -> Column:
    """A-Z in lower case; what Spark's ``lower`` does to an ASCII text."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(lower_ascii(text))


def scan_licenses(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    phrases: Mapping[str, str] | None = None,
    notices: Mapping[str, str] | None = None,
) -> DataFrame:
    """Places of phrases and notices in every text.

    The templates are configuration and few; their gram table alone is broadcast.
    Every position whose word begins a template gram takes part in the join, so the
    work follows the length of the texts, not the number of templates.

    Null and empty texts have no words and no place; a null id is a document like
    any other; rows equal in id and text are one document; an empty table gives an
    empty one.  Other columns are not looked at.  Returns doc_id, n_words, n_base,
    first_word, last_word, base_labels, labels, score (the best coverage) and spans
    (label, first word, last word, coverage) in order.
    """
    phrases = PHRASES if phrases is None else phrases
    notices = NOTICES if notices is None else notices
    rows = _template_rows(phrases, notices)
    spark = docs.sparkSession
    templates = spark.createDataFrame(
        rows, "label string, own boolean, k int, t_at int, t_gram string, t_len int"
    ).withColumn("t_h", F.xxhash64("t_gram"))
    heads = {k: sorted({r[4].split(" ")[0] for r in rows if r[2] == k}) for k in sorted({r[2] for r in rows})}

    def grams(w: Column) -> Column:
        def of(found: Column, k: int) -> Column:
            begins = lambda i: F.get(w, i).isin(heads[k]) & (i + k <= F.size(w))
            return F.transform(
                F.filter(found, begins),
                lambda i: F.struct(i.alias("at"), F.array_join(F.slice(w, i + 1, k), " ").alias("gram")),
            )

        every = sorted(set().union(*heads.values()))
        found = F.filter(F.transform(w, lambda x, i: F.when(x.isin(every), i)), lambda i: i.isNotNull())
        joined = let(found, lambda f: reduce(F.concat, (of(f, k) for k in heads)))
        return F.struct(F.size(w).alias("n_words"), joined.alias("grams"))

    split = texts(docs, id_column, text_column).select(
        "doc_id",
        F.xxhash64("text").alias("th"),
        let(F.array_remove(F.split(_lowered(F.col("text")), _BETWEEN_WORDS), ""), grams).alias("g"),
    )
    key = ["doc_id", "th", "n_words"]
    # Exploding keeps the documents without a gram, so nothing has to be joined back.
    each = split.select("doc_id", "th", F.col("g.n_words").alias("n_words"), F.explode_outer("g.grams").alias("x"))
    votes = each.withColumn("h", F.xxhash64("x.gram")).join(
        F.broadcast(templates), (F.col("h") == F.col("t_h")) & (F.col("x.gram") == F.col("t_gram")), "left"
    )
    diagonals = votes.groupBy(
        *key, "label", "own", "t_len", "k", (F.col("x.at") - F.col("t_at")).alias("diagonal")
    ).agg(F.collect_set("t_at").alias("t_ats"))

    near = Window.partitionBy("doc_id", "th", "label", "own", "t_len").orderBy("diagonal")
    begins = F.col("own") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > DIAGONAL_GAP, F.lit(True))
    places = (
        diagonals.withColumn("place", F.sum(begins.cast("int")).over(near))
        .groupBy(*key, "label", "own", "t_len", "k", "place")
        .agg(
            F.min("diagonal").alias("lo"),
            F.max("diagonal").alias("hi"),
            F.array_distinct(F.flatten(F.collect_list("t_ats"))).alias("t_ats"),
        )
        .withColumn(
            "covered",
            F.size(F.array_distinct(F.flatten(F.transform("t_ats", lambda a: F.sequence(a, a + F.col("k") - 1))))),
        )
        .withColumn("coverage", F.col("covered") / F.col("t_len"))
    )
    base = F.col("own")
    seen = F.coalesce(base | (F.col("coverage") >= MIN_COVERAGE), F.lit(False))
    start = (F.col("lo") + F.array_min("t_ats")).cast("long")
    end = (F.col("hi") + F.array_max("t_ats") + F.col("k") - 1).cast("long")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        places.groupBy(*key)
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, start)).alias("first_word"),
            F.max(F.when(base, start)).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(F.when(seen, F.col("label"))).alias("labels"),
            F.coalesce(F.max(F.when(seen, F.col("coverage"))), F.lit(0.0)).alias("score"),
            F.sort_array(
                F.collect_list(
                    F.when(
                        seen,
                        F.struct(
                            start.alias("first"), end.alias("last"), F.col("label"), F.col("coverage").alias("coverage")
                        ),
                    )
                )
            ).alias("spans"),
        )
        .select(
            "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word",
            "base_labels", "labels", "score", "spans",
        )
    )
