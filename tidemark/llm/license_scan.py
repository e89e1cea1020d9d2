"""License scans by a positional rare-token index.

Base labels are phrases that stand consecutively. The method: every template is indexed by
the words of its mandatory phrases with the highest inverse document frequency (counted over
all documents) and their positions; words of a file are looked up there, matches of one template are intersected by
relative position, and where enough agree within a few words of each other (words may be
inserted or lost between them) the words around are compared with the whole template and its
mandatory key phrases are verified. A notice that lost or gained words may give spans that overlap.

Defined results: a null or empty text has no words, no places and no labels; repeated rows
each get their result; ties of inverse document frequency go to the earlier position; an
empty table gives no rows. Extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, ascii_lower, let, text_of, words

#: Fixed values of the contract: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, notice (words in lower case) and mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0-1.0", "this work is dedicated to the public domain under cc0 1 0", ["cc0 1 0"]),
]
#: Words of a template that are indexed, those that must agree, and the share of its words that must.
INDEXED, AGREE, SHARE = 4, 2, 0.7
#: How much more frequent than a template's rarest index word another may be.
SPREAD = 10
#: Words on either side of a match within which its words and key phrases may stand.
SLACK = 8
#: Offsets of one template that count as one place: groups of so many, and again of so many half way between.
DRIFT = 8


def norm_words(text: Column) -> Column:
    return words(ascii_lower(text), ALNUM_WORD)


def places(w: Column, phrase: str) -> Column:
    """Starts of the phrase, words from 0. Most texts lack it, which a search in the joined words shows."""
    parts = phrase.split()
    literal = F.array(*map(F.lit, parts))
    starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.slice(w, i + 1, len(parts)) == literal)
    return F.when(F.contains(F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")), F.lit(f" {phrase} ")), starts).otherwise(
        F.array().cast("array<int>"))


def document_frequency(docs: DataFrame) -> dict[str, int]:
    """Documents in which each template word stands, over all documents."""
    spark = docs.sparkSession
    vocabulary = sorted({x for _, text, _ in TEMPLATES for x in text.split()})
    known = spark.createDataFrame([(x,) for x in vocabulary], "v string")
    each = docs.select(F.explode_outer(F.array_distinct(norm_words(text_of()))).alias("x"))
    return {r["v"]: r["n"] for r in each.join(F.broadcast(known), F.col("x") == F.col("v")).groupBy("v").agg(F.count("*").alias("n")).collect()}


def postings(frequency: dict[str, int]) -> list[tuple[str, int, int]]:
    """(word, template, position) of each template's index words.

    They are the highest-IDF words of its mandatory phrases, which every match has, down to
    words `SPREAD` times as frequent as the rarest; a template of which a mandatory word stands
    in no document cannot match and has none."""
    out = []
    for t, (_, text, keys) in enumerate(TEMPLATES):
        must = {x for k in keys for x in k.split()}
        if all(frequency.get(x) for x in must):
            at = sorted((frequency[x], i, x) for i, x in enumerate(text.split()) if x in must)
            out += [(x, t, i) for n, i, x in at[:INDEXED] if n <= SPREAD * at[0][0]]
    return out


def scan(docs: DataFrame, frequency: dict[str, int] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    (agreement with the best template, 1 for a base phrase, else 0) and spans (label, first
    word and end of each template match)."""
    spark = docs.sparkSession
    if frequency is None:
        frequency = document_frequency(docs)
    index = postings(frequency)
    row, text = F.struct("doc_id"), text_of()
    base = docs.select(
        row.alias("row"), F.xxhash64(row, text).alias("d1"), F.xxhash64(F.lit(7), row, text).alias("d2"), norm_words(text).alias("w"))
    cells = F.concat(
        F.array(F.struct(F.lit(-1).alias("p"), F.lit(None).cast("string").alias("x"))),
        F.transform("w", lambda x, i: F.struct(i.alias("p"), x.alias("x"))))
    # made in a step of its own, as a generator over a lambda would copy the words for every cell
    each = base.withColumn("cells", cells).select("row", "d1", "d2", "w", F.explode_outer("cells").alias("c"))
    # the index with its templates beside it: a few dozen rows
    known = spark.createDataFrame(
        [(x, t, i, TEMPLATES[t][1].split(), TEMPLATES[t][2], TEMPLATES[t][0], min(AGREE, sum(y[1] == t for y in index))) for x, t, i in index],
        "v string, t int, i int, template array<string>, keys array<string>, label string, need int").withColumn("len", F.size("template"))
    hit = each.join(F.broadcast(known), F.col("c.x") == F.col("v"), "left")
    first = F.col("c.p") == -1
    start = F.col("c.p") - F.col("i")  # where the template would begin
    inside = (start >= -SLACK) & (start + F.col("len") <= F.size("w") + SLACK)
    hit = hit.where(first | inside)
    found = {p: places(F.col("w"), p) for p in PHRASES}
    everywhere = F.concat(*found.values())
    names = F.array_sort(F.filter(F.array(*[F.when(F.size(v) > 0, F.lit(PHRASES[p])) for p, v in found.items()]), lambda x: x.isNotNull()))
    from_ = F.greatest(F.lit(0), start - SLACK)
    hit = hit.select(
        "d1", "d2", "t", "i", "template", "keys", "label", "need",
        F.when(~first, start).alias("start"), F.when(~first, F.slice("w", from_ + 1, start + F.col("len") + SLACK - from_)).alias("around"),
        F.when(first, F.struct(
            F.col("row"), F.size("w").cast("bigint").alias("n_words"), F.size(everywhere).cast("bigint").alias("n_base"),
            F.array_min(everywhere).cast("bigint").alias("first_word"), F.array_max(everywhere).cast("bigint").alias("last_word"),
            names.alias("base"))).alias("doc"))
    # intersection of a template's postings by relative position, in two overlapping groupings of offsets
    group = lambda shift: F.floor((F.col("start") + shift) / DRIFT)
    groups = F.when(F.col("start").isNotNull(), F.array(F.struct(F.lit(0).alias("h"), group(0).alias("g")), F.struct(F.lit(1).alias("h"), group(DRIFT // 2).alias("g"))))
    votes = hit.withColumn("at", F.explode_outer(groups)).groupBy("d1", "d2", "t", "at").agg(
        F.size(F.collect_set("i")).alias("votes"), F.min_by("around", "start").alias("around"), F.min("start").alias("start"),
        F.first("doc").alias("doc"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("template", "keys", "label", "need")])
    share = F.size(F.array_intersect("around", "template")) / F.size(F.array_distinct("template")).cast("double")
    joined = F.concat(F.lit(" "), F.array_join("around", " "), F.lit(" "))
    phrases = let(joined, lambda text: F.forall("keys", lambda k: F.contains(text, F.concat(F.lit(" "), k, F.lit(" ")))))
    match = (F.col("votes") >= F.col("need")) & phrases & (share >= SHARE)
    one = votes.where(F.col("t").isNull() | match).select(
        "d1", "d2", "doc", "n",
        F.when(F.col("t").isNotNull(), F.struct(F.greatest(F.col("start"), F.lit(0)).alias("first"), (F.col("start") + F.size("template")).alias("end"), F.col("label"))).alias("span"),
        F.when(F.col("t").isNotNull(), share).alias("share"))
    out = one.groupBy("d1", "d2").agg(
        F.first("doc", ignorenulls=True).alias("doc"), F.max(F.when(F.col("span").isNull(), F.col("n"))).cast("int").alias("copies"),
        F.array_sort(F.collect_set("span")).alias("spans"), F.max("share").alias("share"))
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    base_labels = F.col("doc.base")
    all_labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("spans", lambda s: s["label"]))))
    return out.select(
        F.col("doc.row.doc_id").alias("doc_id"), "doc.n_words", "doc.n_base", "doc.first_word", "doc.last_word",
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
        F.greatest(F.when(F.size(base_labels) > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce("share", F.lit(0.0))).alias("score"),
        "spans")
