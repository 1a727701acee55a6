"""Shared helpers of the text operators: tables, batches of UTF-8 words, a
fixed-size Bloom filter, and tables written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitrisk.session import scratch_path, shuffles_removed  # noqa: F401

# Word classes of the contracts, as byte tables. Every separator is an ASCII
# byte, so a UTF-8 text may be cut byte-wise without decoding it.
_BYTES = np.arange(256)
ALNUM_WORD = ~((_BYTES <= 0x2F) | ((_BYTES >= 0x3A) & (_BYTES <= 0x60)) | ((_BYTES >= 0x7B) & (_BYTES <= 0x7F)))
SPACED_WORD = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
LOWER = _BYTES.astype(np.uint8)
LOWER[0x41:0x5B] += 0x20

# The same classes as regular expressions (Java and RE2 syntax alike).
ALNUM_WORD_RE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED_WORD_RE = r"[^\x20\x09-\x0D]+"

_HASH_BASE = 0x9E3779B97F4A7C15
_HASH_MIX = 0xD6E8FEB86659FD93
_HASH_STEP_WORDS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes a table once into the cluster's shared folder and reads it back:
    the lineage ends at files that survive any executor."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    raw_offsets, data = column.buffers()[1:3]
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, word_class: np.ndarray):
    """Start and end byte of every word, and for each row the index of its
    first word (one more entry than rows)."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = word_class[data]
    edge = np.empty(len(data), bool)
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge[0] = True
    edge[1:] = ~inside[:-1]
    edge[rows] = True
    starts = np.flatnonzero(inside & edge)
    edge[-1] = True
    edge[:-1] = ~inside[1:]
    edge[rows[1:] - 1] = True
    ends = np.flatnonzero(inside & edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word: a polynomial over its bytes (prefix sums, so one
    vector operation serves all words), then a bijective mix."""
    out = np.empty(len(starts), np.uint64)
    base = np.uint64(_HASH_BASE)
    inverse = np.uint64(pow(_HASH_BASE, -1, 1 << 64))
    for i in range(0, len(starts), _HASH_STEP_WORDS):
        s, e = starts[i:i + _HASH_STEP_WORDS], ends[i:i + _HASH_STEP_WORDS]
        first, n = s[0], e[-1] - s[0]
        powers = _powers(base, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(data[first:first + n] * powers[:n], out=sums[1:])
        out[i:i + _HASH_STEP_WORDS] = (sums[e - first] - sums[s - first]) * _powers(inverse, n)[s - first]
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_HASH_MIX)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_HASH_BASE)
    return h ^ (h >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 20), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known)
        if n <= 1 << 22:  # the table of one giant word is not kept
            _POWERS[int(base)] = known
    return known


BLOOM_BITS = 1 << 22


def bloom(keys: DataFrame, column: str) -> np.ndarray:
    """Bloom filter of a long column, two bits per key. Its size is fixed
    (512 KB) whatever the number of keys, so it may travel with a closure; a
    crowded filter only lets more rows through to the join behind it."""
    k = F.col(column)
    bit = F.explode(F.array(k.bitwiseAND(F.lit(BLOOM_BITS - 1)),
                            F.shiftrightunsigned(k, 32).bitwiseAND(F.lit(BLOOM_BITS - 1)))).alias("bit")
    words = (keys.where(k.isNotNull()).select(bit)
             .groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")))
    out = np.zeros(BLOOM_BITS >> 6, np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(np.uint64)


def in_bloom(filter_words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mask = np.uint64(BLOOM_BITS - 1)
    keep = _bit(filter_words, keys & mask)
    at = np.flatnonzero(keep)
    keep[at] = _bit(filter_words, (keys[at] >> np.uint64(32)) & mask)
    return keep


def _bit(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def small_batches(batches: Iterator[pa.RecordBatch], text: str = "text",
                  most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the texts of one hold a few MB; a longer
    text comes alone. Bounds the memory of what is derived per byte."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            seen = sizes[at - 1] if at else 0
            n = max(1, int(np.searchsorted(sizes, seen + most_bytes, "right")) - at)
            yield batch.slice(at, n)
            at += n


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def doc_fingerprint(text="text") -> F.Column:
    """Orders texts of one id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def row_keys(*columns: str) -> list[F.Column]:
    """``key1`` and ``key2``: 128 bits of the columns' values. Never null, so
    joins and groups on them share one partitioning, and equal rows agree."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(i), *parts).alias(f"key{i}") for i in (1, 2)]


def renamed(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Columns under names that clash with none of an operator's own."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def one_of_equals(rows: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """(*key, *names): of rows equal in ``key`` the one whose columns hash least, the same
    in every run. Such rows meet map-side first, so a row repeated often is not a hot one."""
    plain = [f"`{n}`" if "map<" not in rows.schema[n].dataType.simpleString() else F.to_json(F.struct(n)) for n in names]
    seen = [x for c in plain for x in ((F.col(c) if isinstance(c, str) else c).isNull(), c)]
    tie = F.struct(*[F.xxhash64(F.lit(i), *seen) for i in (3, 4)])
    return rows.groupBy(*key).agg(F.min_by(F.struct(*names), tie).alias("__row")).select(*key, "__row.*")
