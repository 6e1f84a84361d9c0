"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a window of words, a quarter longer than a template, at every word where it may begin, whatever line ends it crosses; it
is compared with templates of that length only. So the words of a template must stand near each other, in a long line as in wrapped ones. Blocks and templates are token sets in
one global order, rarest first by the number of lines of the whole corpus that hold a token. A block meets a template if it holds at least `threshold` of its tokens. Only blocks that hold a
token of a template's prefix are joined (prefix filter); a block with too few tokens is dropped (length filter), as is a pair
whose tokens from the first common one on are too few (positional filter). What is left is compared exactly.

The templates are a fixed list, so their side and the token order are small whatever the corpus.

Defined cases: null and empty texts have no words, no labels and score 0; a window at the end of a text may be shorter; repeated rows
give repeated results; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import doc_bytes, map_batches, words
from skein.session import materialize, ship

#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences by which a work is licensed, and their labels.
TEMPLATES = [
    ("mit-grant", "Released under the MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
]
THRESHOLD = 0.85


def token_sets(templates: list[tuple[str, str]]) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words(text.encode()))) for label, text in templates]


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def window_of(template: str) -> int:
    """Words of a window for a template."""
    return math.ceil(1.25 * len(words(template.encode())))


def windows(all_words: list[bytes], classes: list[tuple[int, int, frozenset[bytes], frozenset[bytes]]]) -> list[tuple[int, frozenset[bytes]]]:
    """(length, template tokens) of the windows that hold a prefix token and tokens enough. classes: length, least tokens, vocabulary and
    prefixes of its templates. A window that begins elsewhere than at a template token holds no more of them than one that begins at the next."""
    out = set()
    for span, need, vocabulary, prefixes in classes:
        if prefixes.isdisjoint(all_words):
            continue
        done = 0
        for p in (i for i, x in enumerate(all_words) if x in prefixes):
            for i in range(max(done, p - span + 1), p + 1):
                if all_words[i] in vocabulary:
                    s = vocabulary.intersection(all_words[i : i + span])
                    if len(s) >= need:
                        out.add((span, s))
            done = p + 1
    return sorted(out, key=lambda x: (x[0], sorted(x[1])))


def block_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> DataFrame:
    """(token, n): in how many lines of the corpus a template token stands."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter = Counter()
        for t in b.column(1):
            for line in (t.as_py() or b"").split(b"\n"):
                n.update(vocabulary.intersection(words(line)))
        return pa.RecordBatch.from_arrays([pa.array([k.decode() for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["token", "n"])

    return map_batches(doc_bytes(docs), run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def scan(docs: DataFrame, order: dict[bytes, int], phrases: dict[str, str], classes: list[tuple[int, int, frozenset[bytes], frozenset[bytes]]]) -> DataFrame:
    """For each document: words, phrase places, and its blocks that hold a prefix token, as ordered template tokens."""
    wanted = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
    lasts = frozenset(p[-1] for p, _ in wanted)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in b.column(1):
            all_words = words(t.as_py())
            blocks = [{"span": span, "size": len(s), "tokens": [x.decode() for x in sorted(s, key=order.__getitem__)]} for span, s in windows(all_words, classes)]
            places, found = [], set()
            if not lasts.isdisjoint(all_words):
                for i, x in enumerate(all_words):
                    if x in lasts:
                        for p, label in wanted:
                            if i + 1 >= len(p) and tuple(all_words[i + 1 - len(p) : i + 1]) == p:
                                places.append(i + 1 - len(p))
                                found.add(label)
            rows.append((len(all_words), len(places), min(places, default=None), max(places, default=None), sorted(found), blocks))
        cols = list(zip(*rows, strict=True))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("span", pa.int32()), ("size", pa.int32()), ("tokens", pa.list_(pa.string()))])))
        names = ["n_words", "n_base", "first_word", "last_word", "base", "blocks"]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], ["doc_id", *names])

    return map_batches(doc_bytes(docs), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<span:int,size:int,tokens:array<string>>>")


def license_scan(spark: SparkSession, docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    ship(spark)
    templates = TEMPLATES if templates is None else templates
    sets = token_sets(templates)
    vocabulary = frozenset().union(*(s for _, s in sets))
    seen = {r["token"].encode(): r["n"] for r in block_counts(docs, vocabulary).collect()}  # as many rows as template tokens
    order = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (seen.get(t, 0), t)))}
    rows = []
    of_span: dict[int, list] = {}
    for k, (label, s) in enumerate(sets):
        tokens = sorted(s, key=order.__getitem__)
        need = needed(len(s), threshold)
        span = window_of(templates[k][1])
        of_span.setdefault(span, []).append((need, s, frozenset(tokens[: len(s) - need + 1])))
        rows += [(k, label, len(s), need, span, [t.decode() for t in tokens], tokens[i].decode(), i) for i in range(len(s) - need + 1)]
    index = spark.createDataFrame(rows, "template int, label string, t_size int, need int, t_span int, t_tokens array<string>, token string, i int")
    classes = [(span, min(n for n, _, _ in c), frozenset().union(*(s for _, s, _ in c)), frozenset().union(*(x for _, _, x in c))) for span, c in of_span.items()]

    found = materialize(scan(docs, order, PHRASES if phrases is None else phrases, classes).withColumn("row", F.monotonically_increasing_id()), "scan")
    blocks = found.select("row", F.explode("blocks").alias("b")).select("row", "b.span", "b.size", "b.tokens", F.posexplode("b.tokens").alias("j", "token"))
    rest = 1 + F.least(F.col("t_size") - F.col("i") - 1, F.size("tokens") - F.col("j") - 1)
    pairs = blocks.join(F.broadcast(index), "token").where((F.col("span") == F.col("t_span")) & (F.col("size") >= F.col("need")) & (rest >= F.col("need")))
    pairs = pairs.withColumn("both", F.size(F.array_intersect("tokens", "t_tokens"))).where("both >= need")
    met = pairs.groupBy("row").agg(F.collect_set("label").alias("more"), F.max(F.col("both") / F.col("t_size")).alias("score"))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    none = F.array().cast("array<string>")
    return found.join(met, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        join(F.col("base")).alias("base_labels"), join(F.concat("base", F.coalesce("more", none))).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
