"""Licence scan through a positional index of rare template words. DataFrame functions only.

A template is a licence line with a mandatory key phrase. Over the corpus the inverse document
frequency of all key-phrase words is counted; the index has, of each key phrase, its word of the
highest IDF with its place. In a file the places of indexed words are looked up; each posting gives
the start its phrase would have there (word place minus place in the phrase), and the phrase's
other words are intersected at their relative places. A phrase whose words all stand there is
found. Around a found phrase the template's other words are compared at their relative places;
the share of IDF that agrees is the score, and a template of the method's own also needs
``accept`` of it. Base phrases are templates of just a key phrase, so every place counts.

A-Z count as lower case. Words are runs of letters, digits and all non-ASCII characters. Null and
empty texts have no words. Every row gives a row, repeated rows too. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinquery.runtime import stored

#: Phrases and labels of the base scan.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label, key phrase, and the line of the licence it stands in.
TEMPLATES = (
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal public domain dedication"),
    ("gpl-2.0", "gnu general public license version 2", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain"),
)
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The text's words in order. The Kelvin sign is kept from turning into an ASCII k."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Ω")))
    # a separator at either end would leave an empty word there
    return F.when(F.length(low) == 0, F.array().cast("array<string>")).otherwise(F.array_remove(F.split(low, _SEPARATORS, -1), ""))


def _read(docs: DataFrame, key: str, text: str, phrases: list[list[str]], vocabulary: list[str]) -> DataFrame:
    """__key, n_words, __have (words of a fixed vocabulary), __words of rows that have all words of a phrase."""
    split = docs.select(F.col(key).alias("__key"), words_of(F.col(text)).alias("__words"))
    have = split.select("__key", "__words", F.array_intersect("__words", F.array(*map(F.lit, vocabulary))).alias("__have"))
    some = F.lit(False)
    for phrase in phrases:
        some = some | (F.size(F.array_except(F.array(*map(F.lit, phrase)), "__have")) == 0)
    return have.select("__key", F.size("__words").cast("long").alias("n_words"), "__have", F.when((F.size("__have") > 0) & some, F.col("__words")).alias("__words"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", accept: float = 0.6) -> DataFrame:
    """One row a row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Texts are split once: words in order are only kept of rows that have all words of some phrase.
    """
    phrases = [(label, p.split(), p.split(), True) for p, label in BASE] + [(label, k.split(), line.split(), False) for label, k, line in TEMPLATES]
    vocabulary = sorted({w for _, _, line, _ in phrases for w in line})
    read = stored(_read(docs, key, text, [p for _, p, _, _ in phrases], vocabulary), "licence-words")
    df = {r["w"]: r["count"] for r in read.select(F.explode("__have").alias("w")).groupBy("w").count().collect()}
    total = read.count()

    def idf(word: str) -> float:
        n = df.get(word, 0)
        return round(math.log(1 + (total - n + 0.5) / (n + 0.5)), 6)

    postings: dict[str, list[int]] = {}
    offsets = []
    for i, (_, phrase, line, _) in enumerate(phrases):
        anchor = max(range(len(phrase)), key=lambda j: (idf(phrase[j]), -j))
        postings.setdefault(phrase[anchor], []).append(i)
        at = next(j for j in range(len(line)) if line[j : j + len(phrase)] == phrase)
        offsets.append((anchor, at))
    anchors = sorted(postings)
    words = F.col("__words")
    spots = F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())
    placed = read.withColumn("__spots", F.when(words.isNotNull(), spots).otherwise(F.array().cast("array<int>")))

    def candidates(i: Column) -> Column:
        """Phrases that the word at place i may belong to, and where they would start."""
        word = F.get(words, i)
        none = F.array().cast("array<struct<t:int,s:int>>")
        found = none
        for a in anchors:
            mine = F.array(*(F.struct(F.lit(t).alias("t"), (i - offsets[t][0]).cast("int").alias("s")) for t in postings[a]))
            found = F.when(word == a, mine).otherwise(found)
        return found

    def stands(c: Column) -> Column:
        """Whether all words of the phrase stand at their places."""
        ok = F.lit(False)
        for t, (_, phrase, _, _) in enumerate(phrases):
            here = c["s"] >= 0
            for j, w in enumerate(phrase):
                here = here & (F.coalesce(F.get(words, c["s"] + j), F.lit("")) == w)
            ok = F.when(c["t"] == t, here).otherwise(ok)
        return ok

    def agreement(c: Column) -> Column:
        """The share of the template's IDF whose words stand at their relative places."""
        share = F.lit(0.0)
        for t, (_, _, line, base) in enumerate(phrases):
            if base:
                continue
            whole = sum(idf(w) for w in line)
            got = sum((F.when(F.coalesce(F.get(words, F.when(c["s"] - offsets[t][1] + j >= 0, c["s"] - offsets[t][1] + j)), F.lit("")) == w, idf(w)).otherwise(0.0) for j, w in enumerate(line)), start=F.lit(0.0))
            share = F.when(c["t"] == t, got / whole if whole else F.lit(0.0)).otherwise(share)
        return share

    nowhere = F.array().cast("array<struct<t:int,s:int,g:double>>")
    hits = F.transform(F.filter(F.flatten(F.transform("__spots", candidates)), stands), lambda c: F.struct(c["t"].alias("t"), c["s"].alias("s"), agreement(c).alias("g")))
    found = placed.select("__key", "n_words", F.when(F.size("__spots") > 0, hits).otherwise(nowhere).alias("__hits"))
    n_base = len(BASE)
    base = F.filter("__hits", lambda h: h["t"] < n_base)
    good = F.filter("__hits", lambda h: (h["t"] >= n_base) & (h["g"] >= accept))
    label = F.array(*(F.lit(p[0]) for p in phrases))

    def named(hits: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.get(label, h["t"])))), ",")

    score = F.when(F.size(good) > 0, F.array_max(F.transform(good, lambda h: h["g"]))).when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    starts = F.transform(base, lambda h: h["s"].cast("long"))
    return found.select(
        F.col("__key").alias(key),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.concat(base, good)).alias("labels"),
        F.least(F.lit(1.0), F.round(score, 6)).alias("score"),
    )
