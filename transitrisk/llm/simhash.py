"""SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is read as a ring of ``segments`` equal segments. If two
fingerprints differ in at most ``max_distance`` bits, some segment starts a
chain whose first l segments differ in at most floor(l * max_distance /
segments) bits, for every l (the strong pigeonring principle). The first
lengths allow no difference at all, so those segments are an exact join key;
the longer chains prune, and only then the full distance is counted.

Defined results: a null text is empty; a text of no words has fingerprint 0
and links like any other; fewer words than the shingle length are one shingle;
repeated rows are one node. A null doc_id takes part but never names a
component unless all ids of its component are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitrisk.llm.common import LOWER, SPACED_WORD, signed, small_batches, stored, utf8, word_bounds
from transitrisk.llm.components import connected_components

BITS = 64
SEGMENTS = 16
SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
#: A key held by more fingerprints than this is dealt out as pairs of blocks.
BLOCK = 20_000

# For a byte, eight one-byte counters: the sum of up to 255 of them cannot overflow.
_LANES = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)).view(np.uint64).ravel()


def shingle_hashes(data, starts, ends, first_word, shingle):
    """XXH64 of every shingle (words joined by one space) and the shingles'
    boundaries per row."""
    n_words = np.diff(first_word)
    n_shingles = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(n_shingles)])
    if bounds[-1] == 0:
        return np.zeros(0, np.uint64), bounds
    # one space after each word; what else stands between words goes
    size = ends - starts
    new_start = np.concatenate([[0], np.cumsum(size + 1)])
    total = int(new_start[-1])
    norm = np.full(total, 0x20, np.uint8)
    shift = np.repeat(starts - new_start[:-1], size)
    target = np.arange(len(shift)) + np.repeat(np.arange(len(size)), size)
    norm[target] = LOWER[data[target + shift]]
    row = np.repeat(np.arange(len(n_shingles)), n_shingles)
    begin = first_word[:-1][row] + np.arange(int(bounds[-1])) - bounds[:-1][row]
    last = np.minimum(begin + shingle, first_word[1:][row]) - 1
    a, b = new_start[begin].tolist(), (new_start[last] + size[last]).tolist()
    text, digest = norm.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[i:j], SEED) for i, j in zip(a, b)), np.uint64, len(a))
    return hashes, bounds


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per row the bits set in over half of its hashes."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    n = np.diff(bounds)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    # blocks of at most 255 hashes, none across rows
    blocks = -(-n[full] // 255)
    first_block = np.concatenate([[0], np.cumsum(blocks)])
    at = np.repeat(bounds[:-1][full], blocks) + 255 * (np.arange(first_block[-1]) - np.repeat(first_block[:-1], blocks))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, byte]], at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_block[:-1], axis=0)
        bits = (2 * counts > n[full][:, None]) @ (1 << np.arange(8))
        out[full] |= bits.astype(np.uint64) << np.uint64(8 * byte)
    return out


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE_WORDS,
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, fp): one row per document; whole texts, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for part in small_batches([batch], "__text"):
                data, offsets = utf8(part["__text"])
                starts, ends, first = word_bounds(data, offsets, SPACED_WORD)
                fps.append(majority_bits(*shingle_hashes(data, starts, ends, first, shingle)))
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            kept = [c for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), signed(fp)], [*kept, "fp"])

    src = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "__text")
    return src.mapInArrow(run, schema + ", fp long")


def _chain_masks(segments: int, max_distance: int):
    """masks[start][l-1]: the bits of the first l segments from a start; budget per l."""
    width = BITS // segments
    one = (1 << width) - 1
    masks = np.zeros((segments, segments), np.uint64)
    for start in range(segments):
        m = 0
        for length in range(segments):
            m |= one << (width * ((start + length) % segments))
            masks[start, length] = m
    budget = np.array([(length + 1) * max_distance // segments for length in range(segments)])
    return masks, budget


def exact_segments(segments: int, max_distance: int) -> int:
    """Longest chain whose budget is still zero."""
    return max(1, -(-segments // max_distance) - 1) if max_distance else segments


def ring_links(a: np.ndarray, b: np.ndarray, start: np.ndarray, masks, budget, max_distance: int) -> np.ndarray:
    """Chain test from the given start, pruning step by step, then the distance."""
    x = a ^ b
    at = np.arange(len(x))
    for length in range(len(budget) - 1):
        at = at[np.bitwise_count(x[at] & masks[start[at], length]) <= budget[length]]
    return at[np.bitwise_count(x[at]) <= max_distance]


def similarity_links(reps: DataFrame, segments: int = SEGMENTS, max_distance: int = MAX_DISTANCE,
                     block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within the
    distance. Of the links inside one key only a spanning forest is returned,
    so a group of near copies costs rows in proportion to its size."""
    if BITS % segments or segments <= max_distance:
        raise ValueError("segments must divide 64 and exceed the distance")
    width, exact = BITS // segments, exact_segments(segments, max_distance)
    masks, budget = _chain_masks(segments, max_distance)

    def chain(start: int) -> F.Column:
        # rotate the ring so that the chain's segments are the low bits
        fp, by = F.col("fp"), start * width
        turned = fp if by == 0 else F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, BITS - by))
        low = (1 << (exact * width)) - 1 if exact * width < 63 else -1
        return F.struct(F.lit(start).alias("start"), turned.bitwiseAND(F.lit(low)).alias("bits"))

    keyed = (reps.select("fp", F.explode(F.array(*[chain(i) for i in range(segments)])).alias("k"))
             .select("fp", "k.start", "k.bits"))
    hot = (keyed.groupBy("start", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
           .withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n"))
    hot = stored(hot, "simhash-hot")  # mostly empty; its known size lets Spark choose the join
    mine = F.pmod(F.xxhash64("fp", "bits"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                    lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j"))))
    dealt = (keyed.join(hot, ["start", "bits"], "left")
             .select("start", "bits", "fp", F.explode(pairs).alias("p"))
             .select("start", "bits", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "fp")
             .repartition("start", "bits", "i", "j").sortWithinPartitions("start", "bits", "i", "j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("start", "bits", "i", "j")], axis=1)
            fps = batch["fp"].to_numpy().view(np.uint64)
            if rest is not None:
                keys, fps = np.concatenate([rest[0], keys]), np.concatenate([rest[1], fps])
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cut = new[-1] if len(new) else 0
            rest = keys[cut:], fps[cut:]
            if cut:
                yield from links(keys[:cut], fps[:cut])
        if rest is not None:
            yield from links(*rest)

    def links(keys, fps) -> Iterator[pa.RecordBatch]:
        edge = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(fps)]])
        run_of = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        start, size = keys[:, 0], np.diff(edge)
        out_a, out_b = [], []
        small = size[run_of] <= 32
        for lag in range(1, min(33, int(size.max()))):
            i = np.flatnonzero((run_of[lag:] == run_of[:-lag]) & small[lag:])
            if not len(i):
                break
            ok = i[ring_links(fps[i], fps[i + lag], start[i], masks, budget, max_distance)]
            out_a.append(fps[ok])
            out_b.append(fps[ok + lag])
        for r in np.flatnonzero(size > 32):
            a, b = forest(fps[edge[r]:edge[r + 1]], int(start[edge[r]]))
            out_a.append(a)
            out_b.append(b)
        if sum(map(len, out_a)):
            yield pa.RecordBatch.from_arrays([signed(np.concatenate(out_a)), signed(np.concatenate(out_b))], ["a", "b"])

    def forest(fps, start):
        """Spanning forest of the links among one key's fingerprints."""
        parent = np.arange(len(fps))
        a, b = [], []
        for i in range(len(fps) - 1):
            j = np.arange(i + 1, len(fps))
            hit = j[ring_links(np.full(len(j), fps[i]), fps[j], np.full(len(j), start), masks, budget, max_distance)]
            if len(hit) == 0:
                continue
            roots = parent[np.concatenate([[i], hit])]
            low, fresh = roots.min(), np.unique(roots[1:], return_index=True)
            for root, k in zip(*fresh):
                if root != parent[i]:
                    a.append(fps[i])
                    b.append(fps[hit[k]])
            parent[np.isin(parent, roots)] = low
        return np.array(a, np.uint64), np.array(b, np.uint64)

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE_WORDS,
                    max_distance: int = MAX_DISTANCE, segments: int = SEGMENTS,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: (id, *keep, root, fingerprint, component_id), the component
    being the smallest id reachable over links of at most ``max_distance`` bits;
    root tells components apart even where all their ids are null."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle, keep), "simhash")
    reps = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    links = stored(similarity_links(reps, segments, max_distance).distinct(), "simhash-links")
    comp = connected_components(links)
    rooted = (reps.join(comp, reps.fp == comp.node, "left")
              .select("fp", "least", F.coalesce("component", "fp").alias("root")))
    linked = rooted.join(comp.select("component").distinct(), F.col("root") == F.col("component"), "left_semi")
    best = linked.groupBy("root").agg(F.min("least").alias("best"))
    # stored, so that the last join reads two plain shuffles: one hot fingerprint is then split by AQE
    named = stored(rooted.join(best, "root", "left")
                   .select(F.col("fp").alias("__fp"), "root", F.coalesce("best", "least").alias("component_id")),
                   "simhash-named")
    return (fps.join(named, F.col("fp") == F.col("__fp"))
            .select("id", *keep, "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
