"""License scans by diagonal voting.

Rolling word k-gram hashes of the documents are joined to the positions of the
same k-grams in license templates. A hit at document word p and template word
t votes for the diagonal p - t, i.e. for a copy that starts at word p - t.
Neighbouring diagonals (small insertions or deletions) are merged, and a
merged span is verified: the hits' words must equal the template's, in a span
not much longer than the template, covering enough of it. Copies close
together make one longer span: every diagonal in it then opens a copy of its
own, taking in later diagonals that go on in the template within the allowed
length; where copies overlap the best one stands.

Base phrases are templates too: all their k-grams voting for one diagonal is a
place where the phrase's words stand consecutively.

Defined results: null or wordless texts have no hits, score 0 and empty
labels; repeated rows and equal ids are scanned separately.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from transitrisk.llm.common import (ALNUM_WORD, LOWER, bloom, in_bloom, mixed, signed, small_batches, stored, utf8,
                                    word_bounds, word_hashes)

K = 3
GAP = 6          # diagonals this near belong to one copy
MIN_COVERAGE = 0.8
MAX_STRETCH = 1.5
MAX_TEMPLATE_GRAMS = 100_000

# Phrases of the contract and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Common license notices.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at",
     "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("all rights reserved", "all-rights-reserved"),
]

_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def _kgrams(part: pa.RecordBatch, k: int):
    """Rolling k-gram hashes: hash, row, word position, and the words' byte spans."""
    data, offsets = utf8(part["__text"])
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, ALNUM_WORD)
    terms = word_hashes(data, starts, ends)
    n = np.diff(first)
    grams = np.zeros(max(0, len(terms) - k + 1), np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0xC2B2AE3D27D4EB4F) + terms[j:len(terms) - k + 1 + j]
    row = np.repeat(np.arange(len(n)), n)
    whole = row[:len(grams)] == row[k - 1:] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    return mixed(grams[at]), row[at], at, (data, starts, ends, first)


def template_positions(spark: SparkSession, templates=None, k: int = K) -> DataFrame:
    """(tid, label, base, gram, words, tpos, len): the k-grams of every template, hashed as
    the documents' are. The templates are a parameter of the operator, not data."""
    rows = []
    for tid, (text, label, base) in enumerate(templates or
                                              [(t, x, True) for t, x in PHRASES] + [(t, x, False) for t, x in NOTICES]):
        words = [w.decode() for w in _WORD.findall(text.lower().encode())]
        if len(words) < k:
            raise ValueError(f"a template needs at least {k} words: {text!r}")
        part = pa.RecordBatch.from_pydict({"__text": [" ".join(words)]})
        gram, _, pos, _ = _kgrams(part, k)
        rows += [(tid, label, base, int(g), " ".join(words[p:p + k]), int(p), len(words))
                 for g, p in zip(gram.view(np.int64), pos)]
    if len(rows) > MAX_TEMPLATE_GRAMS:
        raise ValueError("too many template words to send to every task")
    return spark.createDataFrame(rows, "tid int, label string, base boolean, gram long, words string, tpos int, len int")


def kgram_hits(docs: DataFrame, id_col: str, text_col: str, grams: np.ndarray, k: int) -> DataFrame:
    """One scan: a row per document (gram null) and a row per k-gram that the
    filter of template k-grams lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, "__text"):
            gram, row, at, (data, starts, ends, first) = _kgrams(part, k)
            hit = np.flatnonzero(in_bloom(grams, gram))
            text = data.tobytes()
            words = [b" ".join(text[starts[i + j]:ends[i + j]] for j in range(k)).decode() for i in at[hit].tolist()]
            take = pa.array(np.concatenate([np.arange(part.num_rows), row[hit]]))
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part["row"].take(take), part["doc_id"].take(take), pa.array(np.diff(first)).take(take),
                 pa.concat_arrays([none, signed(gram[hit])]),
                 pa.concat_arrays([none, pa.array(at[hit] - first[:-1][row[hit]])]),
                 pa.concat_arrays([pa.nulls(part.num_rows, pa.string()), pa.array(words, pa.string())])],
                ["row", "doc_id", "n_words", "gram", "pos", "words"])

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                      F.col(text_col).alias("__text"))
    return src.mapInArrow(run, f"row long, doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, "
                               "gram long, pos long, words string")


def _words(tpos: F.Column, k: int) -> F.Column:
    """The template words under k-grams."""
    return F.array_distinct(F.flatten(F.transform(tpos, lambda t: F.sequence(t, t + (k - 1)))))


def split_runs(runs: DataFrame, k: int, max_stretch: float, reach: int, min_coverage: float) -> DataFrame:
    """Copies in runs of diagonals longer than a copy may be: (*runs, first, last, coverage).
    ``reach``: the most words of a copy of any template."""
    here = Window.partitionBy("row", "tid", "copy")
    ahead = here.orderBy("lo").rangeBetween(0, reach)
    part = F.struct("lo", "hi", F.array_min("tpos").alias("from"), _words(F.col("tpos"), k).alias("covered"))
    own = F.struct("hi", _words(F.col("tpos"), k).alias("covered"))

    def goes_on(x):
        return ((x["hi"] + k - F.col("lo") <= max_stretch * F.col("len")) & (x["from"] > F.array_min("tpos")))

    def taken(copy, x):
        adds = F.size(F.array_except(x["covered"], copy["covered"])) > 0
        return F.when(adds, F.struct(F.greatest(copy["hi"], x["hi"]).alias("hi"),
                                     F.array_union(copy["covered"], x["covered"]).alias("covered"))).otherwise(copy)

    found = (runs.withColumn("near", F.array_sort(F.collect_list(part).over(ahead)))
             .withColumn("made", F.aggregate(F.filter("near", goes_on), own, taken))
             .withColumns({"first": F.col("lo"), "last": F.col("made.hi") + (k - 1),
                           "coverage": F.size("made.covered") / F.col("len")})
             .where(F.col("coverage") >= min_coverage))
    # of copies that overlap: the highest coverage, then the shortest, then the first
    rank = F.struct("coverage", (F.col("first") - F.col("last")).alias("short"), (-F.col("first")).alias("early"),
                    (-F.col("diagonal")).alias("low"))
    around = here.orderBy("first").rangeBetween(-reach, reach)
    rivals = F.collect_list(F.struct("first", "last", rank.alias("rank"))).over(around)
    return found.withColumns({"rank": rank, "rivals": rivals}).where(~F.exists("rivals", lambda x: (
        (x["first"] <= F.col("last")) & (x["last"] >= F.col("first")) & (x["rank"] > F.col("rank")))))


def scan_licenses(docs: DataFrame, id_col="doc_id", text_col="text", templates=None, k: int = K, gap: int = GAP,
                  min_coverage: float = MIN_COVERAGE, max_stretch: float = MAX_STRETCH) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). documents: row, doc_id, n_words. spans: row, doc_id, n_words, tid, label,
    base, first, last, n_places, coverage: verified copies of a template, of a
    base phrase all its consecutive places."""
    spark = docs.sparkSession
    grid = template_positions(spark, templates, k)
    scanned = stored(kgram_hits(docs, id_col, text_col, bloom(grid, "gram"), k), "license-hits")
    documents = scanned.where("gram is null").select("row", "doc_id", "n_words")
    votes = (scanned.where("gram is not null").join(F.broadcast(grid), ["gram", "words"])
             .withColumn("diagonal", F.col("pos") - F.col("tpos")))
    key = ["row", "doc_id", "n_words", "tid", "label", "base", "len"]
    diagonals = (votes.groupBy(*key, "diagonal")
                 .agg(F.collect_set("tpos").alias("tpos"), F.min("pos").alias("lo"), F.max("pos").alias("hi")))
    base = (diagonals.where(F.col("base") & (F.size("tpos") == F.col("len") - (k - 1)))
            .groupBy(*key).agg(F.min("diagonal").alias("first"), F.max("diagonal").alias("last"),
                               F.count(F.lit(1)).alias("n_places"), F.lit(1.0).alias("coverage")))
    run = Window.partitionBy("row", "tid").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(run) > gap).cast("int"), F.lit(1))
    span = Window.partitionBy("row", "tid", "copy")
    runs = (diagonals.where(~F.col("base")).withColumn("fresh", fresh).withColumn("copy", F.sum("fresh").over(run))
            .withColumn("whole", F.max("hi").over(span) + k - F.min("lo").over(span) <= max_stretch * F.col("len")))
    merged = (runs.where("whole")
              .groupBy(*key, "copy").agg(_words(F.flatten(F.collect_list("tpos")), k).alias("covered"),
                                         F.min("lo").alias("first"), F.max("hi").alias("hi")))
    longest = grid.agg(F.max("len")).first()[0]
    opened = split_runs(runs.where(~F.col("whole")), k, max_stretch, int(max_stretch * longest), min_coverage)
    copies = (merged.select(*key, "first", (F.col("hi") + (k - 1)).alias("last"), (F.size("covered") / F.col("len")).alias("coverage"))
              .where(F.col("coverage") >= min_coverage).unionByName(opened.select(*key, "first", "last", "coverage"))
              .withColumn("n_places", F.lit(1).cast("long")))
    return documents, base.unionByName(copies)


def license_report(docs: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score (the best coverage)."""
    documents, spans = scan_licenses(docs, **kw)
    per_doc = (spans.groupBy("row").agg(
        F.sum(F.when(F.col("base"), F.col("n_places")).otherwise(0)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("last"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("coverage").alias("score")))
    return (documents.join(per_doc, "row", "left").fillna(0, ["n_base"]).fillna(0.0, ["score"])
            .fillna("", ["base_labels", "labels"])
            .select("doc_id", "n_words", F.col("n_base").cast("long").alias("n_base"),
                    F.col("first_word").cast("long").alias("first_word"),
                    F.col("last_word").cast("long").alias("last_word"), "base_labels", "labels", "score"))
