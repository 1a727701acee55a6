"""Benchmark decontamination over a distributed positional inverted index.

1. Benchmark texts become windows of 13 consecutive words (a shorter text is
   one window).
2. One scan of the documents counts the test terms; a fixed-size Bloom filter
   keeps other words out of the shuffle.
3. Each window's rarest terms (by corpus frequency) are its anchors.
4. A second scan stores the postings of the anchor terms: term, document,
   position, and a 32-bit signature of each neighbouring word.
5. Postings join anchors on the term; subtracting the anchor's offset turns
   positions into window starts. All words of the window are compared with the
   posting's neighbours by signature, and lists meet where the starts agree:
   exact matches. At least ``near_percent`` of the window's words within ``slop``
   places of where they belong beside an anchor: a proximity match.

A window of n words of which m must be found has n - m + 1 anchors, so one of
them stands in every text that lacks no more than n - m of its words; terms that
no document holds are the rarest ones and count among them.

Defined results: null or wordless texts have no words, windows or hits;
repeated benchmark ids are one item; a null item_id counts as one item and is
listed as an empty string; repeated documents are judged separately; an empty
benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitrisk.llm.common import (ALNUM_WORD, LOWER, bloom, in_bloom, row_keys, signed, small_batches, stored,
                                    utf8, word_bounds, word_hashes)

WINDOW_WORDS = 13
SLOP = 8
NEAR_PERCENT = 80
#: A task holds back at most this many distinct term counts before passing them on.
HELD_TERMS = 200_000


@dataclass
class Matches:
    """documents(row, doc_id, key1, key2, n_words), exact(row, start, len, wid),
    near(row, wid, start), window_items(wid, item). A near start is the first
    place where a window would begin; words lacking before it may make it negative."""
    documents: DataFrame
    exact: DataFrame
    near: DataFrame
    window_items: DataFrame


def _terms(part: pa.RecordBatch):
    data, offsets = utf8(part["__text"])
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, ALNUM_WORD)
    return word_hashes(data, starts, ends), first


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(item, wid, terms): every window of every item; terms are word hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, "__text", 1 << 18):
            terms, first = _terms(part)
            n = np.diff(first)
            n_windows = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
            if n_windows.sum() == 0:
                continue
            row = np.repeat(np.arange(len(n)), n_windows)
            begin = first[:-1][row] + np.arange(n_windows.sum()) - (np.cumsum(n_windows) - n_windows)[row]
            size = np.minimum(words, n[row])
            at = np.concatenate([[0], np.cumsum(size)])
            flat = terms[np.repeat(begin - at[:-1], size) + np.arange(at[-1])]
            yield pa.RecordBatch.from_arrays(
                [part["item"].take(pa.array(row)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), signed(flat))],
                ["item", "terms"])

    src = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"),
                           F.col(text_col).alias("__text"))
    return (src.mapInArrow(run, "item string, terms array<long>")
            .withColumn("wid", F.xxhash64("terms")).distinct())


def term_counts(docs: DataFrame, text_col: str, test_terms: np.ndarray) -> DataFrame:
    """(term, n): how often each test term stands in the documents. Bloom
    errors add terms that no later join finds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in small_batches(batches, "__text"):
            found, _ = _terms(part)
            found, n = np.unique(found[in_bloom(test_terms, found)], return_counts=True)
            all_terms, inverse = np.unique(np.concatenate([terms, found]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, n]), len(all_terms)).astype(np.int64)
            terms = all_terms
            if len(terms) > HELD_TERMS:
                yield pa.RecordBatch.from_arrays([signed(terms), pa.array(counts)], ["term", "n"])
                terms, counts = terms[:0], counts[:0]
        if len(terms):
            yield pa.RecordBatch.from_arrays([signed(terms), pa.array(counts)], ["term", "n"])

    return (docs.select(F.col(text_col).alias("__text")).mapInArrow(run, "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")))


def postings(docs: DataFrame, id_col: str, text_col: str, anchor_terms: np.ndarray, words: int) -> DataFrame:
    """One scan, two kinds of rows. kind 0: a document and its number of words;
    kind 1: a posting with the signatures of the words - 1 neighbours on either
    side (4 bytes each, zero beyond the text)."""
    reach = words - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, "__text"):
            terms, first = _terms(part)
            n = np.diff(first)
            at = np.flatnonzero(in_bloom(anchor_terms, terms))
            row = np.searchsorted(first, at, "right") - 1
            padded = np.concatenate([np.zeros(reach, np.uint32), (terms >> np.uint64(32)).astype(np.uint32),
                                     np.zeros(reach, np.uint32)])
            around = padded[at[:, None] + np.arange(2 * reach + 1)] if len(at) else np.zeros((0, 2 * reach + 1), np.uint32)
            place = at[:, None] + np.arange(-reach, reach + 1)
            around[(place < first[:-1][row][:, None]) | (place >= first[1:][row][:, None])] = 0
            rows, take = part["row"], pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(part.num_rows, np.int32)), rows, part["doc_id"], part["key1"], part["key2"], pa.array(n),
                 pa.nulls(part.num_rows, pa.int64()), pa.nulls(part.num_rows, pa.int64()),
                 pa.nulls(part.num_rows, pa.binary())], names)
            if len(at):
                width = 4 * (2 * reach + 1)
                ctx = pa.Array.from_buffers(pa.binary(), len(at), [
                    None, pa.py_buffer(np.arange(0, width * (len(at) + 1), width, dtype=np.int32)),
                    pa.py_buffer(around.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(at), np.int32)), rows.take(take), pa.nulls(len(at), part["doc_id"].type),
                     *[pa.nulls(len(at), pa.int64())] * 3, signed(terms[at]),
                     pa.array(at - first[:-1][row]), ctx], names)

    names = ["kind", "row", "doc_id", "key1", "key2", "n_words", "term", "pos", "ctx"]
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                      *row_keys(id_col, text_col), F.col(text_col).alias("__text"))
    return src.mapInArrow(run, f"kind int, row long, doc_id {src.schema['doc_id'].dataType.simpleString()}, "
                               "key1 long, key2 long, n_words long, term long, pos long, ctx binary")


CONFIRMED = "row long, wid long, start long, off int, len int, need int, same boolean, near boolean"


def confirm(lists: DataFrame, words: int, slop: int, near_percent: int) -> DataFrame:
    """Postings beside an anchor (row, wid, start, off, len, need, ctx, sign) whose
    neighbours hold the whole window (``same``) or enough of it nearby (``near``)."""
    reach = words - 1
    names = ["row", "wid", "start", "off", "len", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            around = np.frombuffer(b"".join(part["ctx"].to_pylist()), np.uint32).reshape(-1, 2 * reach + 1)
            signs, sizes = part["sign"].to_pylist(), part["len"].to_numpy()
            offs = part["off"].to_numpy()
            same, near = np.zeros(part.num_rows, bool), np.zeros(part.num_rows, bool)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                sign = np.frombuffer(b"".join(signs[i] for i in at.tolist()), np.uint32).reshape(-1, size)
                here, place = around[at], reach - offs[at].astype(np.int64)
                found, exact = np.zeros(len(at), np.int64), np.ones(len(at), bool)
                for k in range(size):
                    equal = here == sign[:, k:k + 1]
                    belongs = place + k
                    exact &= equal[np.arange(len(at)), belongs]
                    found += (equal & (np.abs(np.arange(2 * reach + 1) - belongs[:, None]) <= slop)).any(axis=1)
                same[at], near[at] = exact, 100 * found >= near_percent * size
            keep = pa.array(np.flatnonzero(same | near))
            yield pa.RecordBatch.from_arrays(
                [*(part[c].take(keep) for c in names), pa.array(same).take(keep), pa.array(near).take(keep)],
                [*names, "same", "near"])

    return lists.select(F.col("row"), F.col("wid"), F.col("start").cast("long"), F.col("off").cast("int"),
                        F.col("len").cast("int"), F.col("need").cast("int"), "ctx", "sign").mapInArrow(run, CONFIRMED)


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id",
                 item_text_col="text", words: int = WINDOW_WORDS, anchors: int | None = None, slop: int = SLOP,
                 near_percent: int = NEAR_PERCENT) -> Matches:
    """``anchors``: rarest terms of a window to look up; by default as many as
    proximity matches need to be complete."""
    windows = stored(benchmark_windows(benchmark, item_col, item_text_col, words), "decontam-windows")
    distinct_windows = windows.select("wid", "terms").distinct()
    window_terms = distinct_windows.select("wid", F.posexplode("terms").alias("off", "term"))
    counts = stored(term_counts(docs, text_col, bloom(window_terms, "term")), "decontam-counts")

    asked = F.lit(anchors) if anchors else F.col("len") - F.ceil(F.col("len") * near_percent / F.lit(100)).cast("int") + 1
    ranked = (window_terms.join(counts, "term", "left").fillna(0, ["n"])
              .groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("by_n"))
              .withColumn("len", F.size("by_n"))
              .select("wid", "len", F.slice("by_n", F.lit(1), asked).alias("anchors")))
    signature = F.col("terms")
    chosen = stored(
        ranked.join(distinct_windows, "wid")
        .select("wid", "len", F.size("anchors").alias("need"), F.explode("anchors").alias("a"),
                F.transform(signature, lambda t: F.lower(F.lpad(F.hex(t), 16, "0"))).alias("hex"))
        .select("wid", "len", "need", F.col("a.off").alias("off"), F.col("a.term").alias("term"),
                # the upper half of each word hash, little-endian as numpy wrote it
                F.unhex(F.array_join(F.transform("hex", lambda h: F.concat(
                    F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))),
                    "")).alias("sign")), "decontam-anchors")

    index = stored(postings(docs, id_col, text_col, bloom(chosen.select("term").distinct(), "term"), words),
                   "decontam-postings", "kind")
    lists = (index.where("kind = 1").select("row", "term", "pos", "ctx").join(chosen, "term")
             .withColumn("start", F.col("pos") - F.col("off")))
    met = stored(confirm(lists, words, slop, near_percent), "decontam-lists")
    exact = (met.where("same").groupBy("row", "wid", "start").agg(
        F.count_distinct("off").alias("met"), F.first("need").alias("need"), F.first("len").alias("len"))
        .where("met = need").select("row", "start", "len", "wid"))
    near = met.where("near").groupBy("row", "wid").agg(F.min("start").alias("start"))
    documents = index.where("kind = 0").select("row", "doc_id", "key1", "key2", "n_words")
    return Matches(documents, stored(exact, "decontam-exact"), near, windows.select("wid", "item").distinct())


def contamination(docs: DataFrame, benchmark: DataFrame, least_share: float = 0.05, **kw) -> DataFrame:
    """One row per document: (row, doc_id, key1, key2, n_words, n_hit, n_items, items_sha256,
    n_near, contaminated). A word inside any exact window is hit; a document
    with at least ``least_share`` of its words hit is contaminated."""
    m = find_matches(docs, benchmark, **kw)
    end = F.col("start") + F.col("len")
    so_far = Window.partitionBy("row").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    hits = (m.exact.select("row", "start", "len").distinct()
            .withColumn("covered", F.coalesce(F.max(end).over(so_far), F.lit(0)))
            .groupBy("row").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "covered"))).alias("n_hit")))
    items = (m.exact.select("row", "wid").distinct().join(m.window_items, "wid").select("row", "item").distinct()
             .groupBy("row").agg(F.count(F.lit(1)).alias("n_items"),
                                 F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items")))
    near = m.near.groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
    share = F.lit(round(1 / least_share))
    return (m.documents.join(hits, "row", "left").join(items, "row", "left").join(near, "row", "left")
            .fillna(0, ["n_hit", "n_items", "n_near"]).fillna("", ["items"])
            .withColumns({"items_sha256": F.sha2("items", 256),
                          "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))})
            .select("row", "doc_id", "key1", "key2", "n_words", "n_hit", "n_items", "items_sha256", "n_near", "contaminated"))
