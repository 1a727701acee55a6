"""Token-ID output in patched frame-of-reference blocks.

A segment is one binary value holding the ids of whole documents:

    "PFR1" | ids u32 | block size u32 | blocks u32
    per block:  minimum u32, width u8, exceptions u16
    block index: u32 byte offset of each block's packed bits (one more than blocks)
    packed bits, block after block (little-endian bit order, whole bytes)
    exceptions: position in block u16 ..., then value above the minimum u32 ...

A block stores value - minimum in ``width`` bits, the width being that of the
block's ``percentile``; what does not fit keeps its low bits there and its full
value in the exception list. Segments are rows of a Parquet table, in
ascending document order, with a directory of the documents they hold.

Defined results: a null text is empty, so its document is the end id alone;
equal ids are ordered by text; null ids come first; an empty table gives an
empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitrisk.llm.common import doc_fingerprint, small_batches, stored
from transitrisk.llm.encoding import encoder, vocabulary_path

MAGIC = b"PFR1"
BLOCK_IDS = 256
PERCENTILE = 90
SEGMENT_IDS = 1 << 18
END_ID = 0
#: Bytes of texts encoded at a time.
BATCH_BYTES = 4 << 20


def pack_segment(ids: np.ndarray, block_ids: int = BLOCK_IDS, percentile: int = PERCENTILE) -> bytes:
    n, blocks = len(ids), -(-len(ids) // block_ids)
    grid = np.empty(blocks * block_ids, np.uint32)
    grid[:n] = ids
    grid[n:] = ids[-1] if n else 0
    grid = grid.reshape(blocks, block_ids)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    over = grid - low[:, None]
    rank = (block_ids - 1) * percentile // 100
    width = _bit_length(np.partition(over, rank, axis=1)[:, rank]) if blocks else np.zeros(0, np.int64)
    size = (block_ids * width + 7) // 8
    index = np.concatenate([[0], np.cumsum(size)])
    packed = np.zeros(index[-1], np.uint8)
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        raw = np.unpackbits(over[at].view(np.uint8).reshape(len(at), block_ids, 4), axis=2, bitorder="little")[:, :, :w]
        packed[index[at][:, None] + np.arange(size[at[0]])] = np.packbits(
            raw.reshape(len(at), -1), axis=1, bitorder="little")
    block, place = np.nonzero(over >> width[:, None].astype(np.uint32))
    return b"".join([MAGIC, np.array([n, block_ids, blocks], "<u4").tobytes(), low.astype("<u4").tobytes(),
                     width.astype(np.uint8).tobytes(), np.bincount(block, minlength=blocks).astype("<u2").tobytes(),
                     index.astype("<u4").tobytes(), packed.tobytes(), place.astype("<u2").tobytes(),
                     over[block, place].astype("<u4").tobytes()])


def unpack_segment(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, block_ids, blocks = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
    at = 16

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    low, width, n_over, index = take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<u4", blocks + 1)
    packed = take("u1", int(index[-1]))
    total = int(n_over.sum())
    place, value = take("<u2", total), take("<u4", total)
    over = np.zeros((blocks, block_ids), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        size = (block_ids * int(w) + 7) // 8
        bits = np.unpackbits(packed[index[rows][:, None].astype(np.int64) + np.arange(size)], axis=1, bitorder="little")
        wide = np.zeros((len(rows), block_ids, 32), np.uint8)
        wide[:, :, :w] = bits[:, :block_ids * int(w)].reshape(len(rows), block_ids, int(w))
        over[rows] = np.packbits(wide, axis=2, bitorder="little").view("<u4")[:, :, 0]
    over[np.repeat(np.arange(blocks), n_over), place] = value
    return (over + low[:, None]).ravel()[:n]


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _row(values: np.ndarray) -> pa.Array:
    return pa.array([values.tolist()], pa.list_(pa.int64()))


SEGMENT_SCHEMA = ("shard int, segment int, n_ids long, doc_ids array<long>, text_keys array<long>, "
                  "doc_sizes array<long>, payload binary")


def write_tokens(docs: DataFrame, id_col="doc_id", text_col="text", vocabulary: str | None = None,
                 segment_ids: int = SEGMENT_IDS, block_ids: int = BLOCK_IDS,
                 percentile: int = PERCENTILE) -> DataFrame:
    """Encodes whole texts and writes the segments; returns the written table.
    Documents are range-partitioned by id, so the files ascend."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, size, segment, shard = encoder(path).column_ids, [], 0, 0, 0

        def flush():
            doc_ids, keys, sizes, ids = zip(*held)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([size], pa.int64()),
                 _row(np.concatenate(doc_ids, dtype=object)), _row(np.concatenate(keys)), _row(np.concatenate(sizes)),
                 pa.array([pack_segment(np.concatenate(ids), block_ids, percentile)], pa.binary())], names)

        for part in small_batches(batches, "__text", BATCH_BYTES):
            shard = part["shard"][0].as_py()
            found, starts = encode(part["__text"])
            ids = np.insert(found, starts[1:], np.uint32(END_ID))
            starts = starts + np.arange(len(starts))
            doc_ids = np.array(part["doc_id"].to_pylist(), object)
            keys, at = part["text_key"].to_numpy(), 0
            while at < part.num_rows:
                # the documents up to the one that fills the segment
                to = min(part.num_rows, int(np.searchsorted(starts, starts[at] + segment_ids - size, "left")))
                held.append((doc_ids[at:to], keys[at:to], np.diff(starts[at:to + 1]), ids[starts[at]:starts[to]]))
                size += int(starts[to] - starts[at])
                at = to
                if size >= segment_ids:
                    yield flush()
                    held, size, segment = [], 0, segment + 1
        if held:
            yield flush()

    names = ["shard", "segment", "n_ids", "doc_ids", "text_keys", "doc_sizes", "payload"]
    src = (docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_fingerprint(text_col).alias("text_key"),
                       F.col(text_col).alias("__text"))
           .repartitionByRange("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key")
           .withColumn("shard", F.spark_partition_id()))
    return stored(src.mapInArrow(run, SEGMENT_SCHEMA), "token-file")


def read_tokens(segments: DataFrame) -> DataFrame:
    """One row per document, from the segments: doc_id, text_key, start, n_tokens, ids_crc32.
    The number of segments' totals is that of the segments, summed per shard first."""
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    first = (segments.select("shard", "segment", "n_ids").join(bases, "shard")
             .select("shard", "segment", (F.col("base") + F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).alias("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack_segment(batch["payload"][i].as_py()).astype("<u4")
                sizes = batch["doc_sizes"][i].values.to_numpy()
                at = np.concatenate([[0], np.cumsum(sizes)])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch["shard"][i].as_py(), np.int32)),
                     pa.array(np.full(n, batch["segment"][i].as_py(), np.int32)), batch["doc_ids"][i].values,
                     batch["text_keys"][i].values, pa.array(at[:-1]), pa.array(sizes), pa.array(crc, pa.int64())],
                    ["shard", "segment", "doc_id", "text_key", "offset", "n_tokens", "ids_crc32"])

    docs = (segments.select("shard", "segment", "doc_ids", "text_keys", "doc_sizes", "payload")
            .mapInArrow(run, "shard int, segment int, doc_id long, text_key long, offset long, n_tokens long, ids_crc32 long"))
    return (docs.join(F.broadcast(first) if _few(segments) else first, ["shard", "segment"])
            .select("doc_id", "text_key", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"))


def _few(segments: DataFrame, most: int = 100_000) -> bool:
    """The directory of segments is broadcast up to this many rows of 16 bytes."""
    return segments.count() <= most
