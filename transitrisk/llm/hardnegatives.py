"""Hard negatives by Fagin's threshold algorithm over integer vectors.

Rows are dealt into blocks; a task holds one block as a matrix and, for every
dimension, the list of its rows sorted by that component. An anchor reads the
lists from the end that its sign prefers (largest components first where it is
positive, smallest where it is negative, none where it is 0), scores every row
it meets by random access, and stops once the threshold (the score of a row
with the last components read) is strictly below the kth score of each of its
windows: no unread row can enter any of them, nor tie with one that is in.

Two passes: the first finds each anchor's best rows of its own label (its
positives), the second, for every score p of a positive, the best rows of
other labels with low * p <= 100 * score <= high * p. Anchors come to the
blocks in batches, those of one label only to its blocks in the first pass;
a block's rows are shuffled once a pass.

Equal rows (label and vector) are one class: as an anchor it is searched once,
as candidates its smallest ids stand for it, no more than a window can return.

Defined results: a row with a null label, a null vector or a null or non-finite
component takes no part; shorter vectors are continued with zeros; a scaled
component beyond 2**26 is held there, so that scores fit in a long; null ids
are no anchors and come last among ties; rows that repeat an id are rows of
their own (an anchor leaves out its own row only); an empty table, an anchor
without positives and a window without rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transitrisk.llm.common import row_keys, stored
from transitrisk.llm.vectors import finite, matrix_of, smallest_members

POSITIVES, NEGATIVES = 5, 3
LOW_PERCENT, HIGH_PERCENT = 50, 95
SCALE = 256
MOST = 1 << 26
#: Rows of a block: a 64th of the table between these bounds.
BLOCK_ROWS = (2048, 65536)
BATCH_ANCHORS = 256
#: Entries of every list that an anchor reads first; each further step reads four times as many.
FIRST_READ = 16
NO_ID = (1 << 63) - 1


class SortedLists:
    """A block's rows and its component lists in ascending order."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows.astype(np.int64)
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(self.rows, self.order, axis=0)
        self.most = int(np.abs(self.rows).max(initial=0))
        self.as_double = self.rows.astype(np.float64)

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(rows met anew, their scores, threshold for the rows not met), deeper each time."""
        n, up, down = len(self.rows), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        # doubles are exact for integers up to 2**53
        exact = self.most * int(np.abs(anchor).sum()) < 1 << 53
        rows, weights = (self.as_double, anchor.astype(np.float64)) if exact else (self.rows, anchor)
        met, depth, step = np.zeros(n, bool), 0, FIRST_READ
        while depth < n:
            to = n if len(up) + len(down) == 0 else min(n, depth + step)
            now = np.zeros(n, bool)
            now[self.order[depth:to, down]] = True
            now[self.order[n - to:n - depth, up]] = True
            if to == n:
                now[:] = True
            new = np.flatnonzero(now & ~met)
            met |= now
            threshold = -np.inf if to == n else int(anchor[up] @ self.sorted[n - to, up] + anchor[down] @ self.sorted[to - 1, down])
            yield new, (rows[new] @ weights).astype(np.int64), threshold
            depth, step = to, 4 * step


class ScoreWindow:
    """The best ``size`` rows with scores from low to high: higher scores first, then smaller ids."""

    def __init__(self, size: int, low: float = -np.inf, high: float = np.inf):
        self.size, self.low, self.high = size, low, high
        self.at, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, numbers: np.ndarray):
        inside = (scores >= self.low) & (scores <= self.high)
        if not inside.any():
            return
        at, scores = np.concatenate([self.at, at[inside]]), np.concatenate([self.scores, scores[inside]])
        best = np.lexsort((numbers[at], ids[at], -scores))[:self.size]
        self.at, self.scores = at[best], scores[best]

    def open(self, threshold: float) -> bool:
        """Whether a row not met yet could belong here."""
        return threshold >= (self.scores[-1] if len(self.scores) == self.size else self.low)


def search(lists: SortedLists, anchor: np.ndarray, windows: list[ScoreWindow], allowed: np.ndarray, ids: np.ndarray,
           numbers: np.ndarray) -> None:
    """Fills the windows with the block's allowed rows."""
    for new, scores, threshold in lists.read(anchor):
        ok = allowed[new]
        for window in windows:
            window.add(new[ok], scores[ok], ids, numbers)
        if not any(window.open(threshold) for window in windows):
            return


def limits(p: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score s with low * p <= 100 * s <= high * p."""
    return -(-low * p // 100), high * p // 100


HIT = "key1 long, key2 long, positive_score long, id long, no long, score long"


def _search_blocks(rows: DataFrame, batches: DataFrame, n_blocks: int, size: int, percents: tuple[int, int] | None) -> DataFrame:
    """HIT of every anchor in every block it was sent to. A block's rows come before its
    anchors, so a task holds one block and one batch of anchors at a time."""
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = None, [], None

        def build():
            table = pa.Table.from_batches(parts)
            labels = table["label"].combine_chunks().dictionary_encode()
            ids = table["id"].combine_chunks().fill_null(NO_ID).to_numpy()
            return (SortedLists(matrix_of(table["q"])), labels.indices.to_numpy(), {x: i for i, x in enumerate(labels.dictionary.to_pylist())},
                    ids, table["no"].combine_chunks().to_numpy())

        def hits(anchors):
            lists, labels, codes, ids, numbers = held
            out = []
            for a in anchors:
                mine = labels == codes.get(a["label"], -1)
                if percents is None:
                    windows, allowed, scores = [ScoreWindow(size)], mine, [None]
                else:
                    scores = [p for p in a["scores"] if limits(p, *percents)[0] <= limits(p, *percents)[1]]
                    windows, allowed = [ScoreWindow(size, *limits(p, *percents)) for p in scores], ~mine
                if windows and allowed.any():
                    search(lists, np.array(a["q"], np.int64), windows, allowed, ids, numbers)
                for p, window in zip(scores, windows):
                    out += [(a["key1"], a["key2"], p, None if ids[i] == NO_ID else int(ids[i]), int(numbers[i]), int(s))
                            for i, s in zip(window.at, window.scores)]
            columns = list(zip(*out)) if out else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in HIT.split(", ")])

        for batch in given:
            blocks, kinds = batch["block"].to_numpy(), batch["kind"].to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                if kinds[lo] == 0:
                    if blocks[lo] != block:
                        block, parts, held = blocks[lo], [], None
                    parts.append(batch.slice(lo, hi - lo).select(["label", "id", "no", "q"]))
                    continue
                if blocks[lo] != block:
                    continue  # no row of this block
                held = held or build()
                for anchors in batch["anchors"].slice(lo, hi - lo).to_pylist():
                    yield hits(anchors)

    kind = batches.schema["anchors"].dataType.simpleString()
    sent = (rows.select("block", F.lit(0).alias("kind"), "label", "id", "no", "q", F.lit(None).cast(kind).alias("anchors"))
            .unionByName(batches.select("block", F.lit(1).alias("kind"), "anchors"), allowMissingColumns=True))
    return sent.repartition(n_blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, HIT)


def _batched(anchors: DataFrame, per: list[str], sizes: DataFrame) -> DataFrame:
    """Anchors of a bucket in arrays of about BATCH_ANCHORS."""
    place = F.pmod("key1", F.ceil(F.col("n_anchors") / BATCH_ANCHORS))
    return (anchors.join(sizes, per).withColumn("batch", place).groupBy(*per, "batch")
            .agg(F.collect_list(F.struct("key1", "key2", "label", "q", "scores")).alias("anchors")))


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, in double precision, held within 2**26."""
    held = lambda x: F.greatest(F.least(F.lit(float(scale)) * x.cast("double"), F.lit(float(MOST))), F.lit(-float(MOST)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def mine(vectors: DataFrame, anchor: Column, id_col="vec_id", label_col="label", vector_col="embedding", positives: int = POSITIVES,
         negatives: int = NEGATIVES, percents: tuple[int, int] = (LOW_PERCENT, HIGH_PERCENT),
         block_rows: tuple[int, int] = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.
    ``anchor`` tells which rows of ``vectors`` are anchors."""
    rows = (vectors.where(F.col(label_col).isNotNull() & finite(F.col(vector_col)))
            .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                    quantized(F.col(vector_col)).alias("q"), F.coalesce(anchor, F.lit(False)).alias("anchor")))
    rows = stored(rows.withColumn("no", F.monotonically_increasing_id())
                  .select("*", *row_keys("label", "q")), "negatives-rows")
    standing = smallest_members(rows, ["key1", "key2"], ["id", "no"], max(positives + 1, negatives))
    total, width = standing.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    per_block = max(block_rows[0], min(block_rows[1], (total or 0) // 64))
    padded = F.concat("q", F.array_repeat(F.lit(0), F.lit(width or 0) - F.size("q")))
    standing = standing.withColumn("q", padded)

    # a label of a block's size or more has blocks of its own, smaller ones share buckets
    labels = standing.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    shared = F.ceil(F.coalesce(F.sum(F.when(F.col("n") < per_block, F.col("n"))).over(Window.partitionBy()), F.lit(0)) / per_block)
    bucket = F.when(F.col("n") >= per_block, F.concat(F.lit("="), "label")).otherwise(
        F.concat(F.lit("#"), F.pmod(F.xxhash64("label"), F.greatest(shared, F.lit(1))).cast("string")))
    labels = stored(labels.withColumn("bucket", bucket).select("label", "bucket", "n"), "negatives-labels")
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (labels.groupBy("bucket").agg(F.ceil(F.sum("n") / per_block).alias("blocks"))
               .withColumn("first", F.coalesce(F.sum("blocks").over(order), F.lit(0))))
    labels = stored(labels.join(buckets, "bucket").select("label", "bucket", "blocks", "first"), "negatives-buckets")
    n_blocks = labels.agg(F.max(F.col("first") + F.col("blocks"))).first()[0] or 0
    if n_blocks == 0:
        n_blocks = 1
    dealt = stored(standing.join(labels, "label").select(
        (F.col("first") + F.pmod(F.xxhash64("no"), F.col("blocks"))).alias("block"), "label", "id", "no", "q"), "negatives-dealt")

    anchors = (rows.where("anchor").groupBy("key1", "key2").agg(F.first("label").alias("label"), F.first("q").alias("q"))
               .withColumn("q", padded).join(labels, "label"))
    anchors = stored(anchors, "negatives-anchors")
    sizes = stored(anchors.groupBy("bucket", "blocks", "first").agg(F.count(F.lit(1)).alias("n_anchors")), "negatives-sizes")
    plain = anchors.select("key1", "key2", "label", "q", "bucket", F.lit(None).cast("array<long>").alias("scores"))
    own = _batched(plain, ["bucket"], sizes.select("bucket", "n_anchors")).join(labels.select("bucket", "blocks", "first").distinct(), "bucket")
    here = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("block")
    hits = _search_blocks(dealt, own.select("anchors", here), n_blocks, positives + 1, None)
    best = Window.partitionBy("key1", "key2").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "no")
    friends = stored(hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives + 1)
                     .select("key1", "key2", "place", "id", "no", "score"), "negatives-positives")

    # every anchor row: the first positives among its class's best rows, but for itself
    lists = friends.groupBy("key1", "key2").agg(F.sort_array(F.collect_list(F.struct("place", "id", "no", "score"))).alias("best"))
    asked = rows.where("anchor").select("key1", "key2", F.col("id").alias("anchor_id"), F.col("no").alias("anchor_no"))
    others = F.slice(F.filter("best", lambda x: x["no"] != F.col("anchor_no")), 1, positives)
    pairs = stored(asked.join(lists, ["key1", "key2"]).select("key1", "key2", "anchor_id", "anchor_no", F.posexplode(others).alias("pos", "p"))
                   .select("key1", "key2", "anchor_id", "anchor_no", (F.col("pos") + 1).alias("positive_rank"),
                           F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score")), "negatives-pairs")

    # a class with repeated rows asks for the same scores once
    wanted = pairs.groupBy("key1", "key2").agg(F.collect_set("positive_score").alias("scores"))
    rated = anchors.select("key1", "key2", "label", "q", "bucket", "blocks", "first").join(wanted, ["key1", "key2"])
    away = _batched(rated.drop("blocks", "first"), ["bucket"], sizes.select("bucket", "n_anchors")).join(
        labels.select("bucket", "blocks", "first").distinct(), "bucket")
    pure = F.col("bucket").startswith("=")
    there = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")),
                               lambda b: ~(pure & (b >= F.col("first")) & (b < F.col("first") + F.col("blocks"))))).alias("block")
    hits = _search_blocks(dealt, away.select("anchors", there), n_blocks, negatives, percents)
    best = (Window.partitionBy("key1", "key2", "positive_score")
            .orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "no"))
    found = (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
             .select("key1", "key2", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))
    return pairs.join(stored(found, "negatives-found"), ["key1", "key2", "positive_score"]).select(
        "anchor_id", "positive_id", "positive_rank", "rank", "negative_id", "positive_score", "negative_score")
