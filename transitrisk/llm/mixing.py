"""Mixing sources to target weights by cube-method balanced sampling.

Each document is taken target / source size times on average: whole copies are
certain, the fraction is its inclusion probability. The flight phase of the
cube method (Deville and Tille, 2004) moves the probabilities of the undecided
documents along the null space of the two balancing constraints (words and
documents of the source) until one of them is 0 or 1, so both totals stay exact;
each move is the direction of the largest one, projected on that space. It runs
in blocks: each block leaves at most two undecided documents, which form the
blocks of the next level, until one block per source is left. Landing gives up
the documents' total, keeps the words until one document is left and draws that
one. Large documents are decided first, with all others of their block to make
up for them, so those left to land are small; if one document outweighs what its block
can give, decided ones make up for it, at the price of its inclusion probability.

Defined results: sources are ordered by code point, null last; a null or
wordless text has size 0 and is in the mix as if of its source; equal rows
(id, source and text) are drawn together and share their copies evenly; a
source without words has target 0. Reruns agree: every draw is seeded by the
documents' own keys.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitrisk.llm.common import SPACED_WORD_RE, one_of_equals, renamed, row_keys, stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEAT = 2.0
BLOCK_DOCS = 1000
EPS = 1e-9
#: A last document of more than so many medians is made up for, whatever was drawn.
OUTLIER = 8


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, size). Capped sources' excess
    goes to the others by weight until none is above its cap.

    With sources sorted by cap / weight, the capped ones are a prefix: one
    window over the sources replaces the rounds."""
    per = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = (per.withColumn("weight", weight).withColumn("cap", F.lit(max_repeat) * F.col("source_size")))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left_total = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumns({"level": left_total / left_weight, "order": F.row_number().over(order)})
    per = per.withColumn("over", F.col("weight") * F.col("level") >= F.col("cap"))
    # the first source that keeps its share sets the level for itself and all behind it
    free = F.min(F.when(~F.col("over"), F.col("order"))).over(everything)
    level = F.max(F.when(F.col("order") == free, F.col("level"))).over(everything)
    return per.withColumns({"free": free, "final": level}).select(
        "source", "source_size",
        F.when(F.col("free").isNull() | (F.col("order") < F.col("free")), F.col("cap"))
        .otherwise(F.col("weight") * F.col("final")).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, rng) -> np.ndarray:
    """Moves probabilities until at most two are left strictly between 0 and 1;
    sums of p and of p * size do not change.

    Each move is for the largest undecided unit: its own direction, projected on the
    null space of both totals. All other undecided units share what it gives or
    takes, so it is decided within a few moves while they hardly change."""
    p = p.astype(float).copy()
    at = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    at = at[np.argsort(-size[at], kind="stable")]
    draws = rng.random(len(at) + 1)
    x = size[at] / max(1.0, float(size.max(initial=0)))
    q = p[at]
    for draw in draws:
        n = len(q)
        if n < 2:
            break
        away = x - x.mean()
        spread = float(away @ away)
        # what is left of a unit's own direction once both totals are fixed; none of it: the next unit
        own = 1 - 1 / n - (away * away / spread if spread > EPS * EPS else 0.0)
        able = np.flatnonzero(np.broadcast_to(own, n) > 1e-7)
        if len(able) == 0:
            break
        v = np.full(n, -1 / n) - (away * (away[able[0]] / spread) if spread > EPS * EPS else 0.0)
        v[able[0]] += 1
        v[np.abs(v) < 1e-13] = 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(v > 0, (1 - q) / v, np.where(v < 0, -q / v, np.inf))
            down = np.where(v > 0, q / v, np.where(v < 0, (q - 1) / v, np.inf))
        most, least = float(up.min()), float(down.min())
        rise = draw * (most + least) < least
        q = q + (most if rise else -least) * v
        hit = int(np.argmin(up if rise else down))
        q[hit] = float((v[hit] > 0) == rise)
        done = (q <= EPS) | (q >= 1 - EPS)
        p[at[done]] = np.round(q[done])
        at, x, q = at[~done], x[~done], q[~done]
    p[at] = q
    return p


def _move(p: list, move: list, draw: float) -> None:
    """Moves probabilities along a direction until one is 0 or 1; on average they stay."""
    up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in move)
    down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in move)
    step = up if draw * (up + down) < down else -down
    for i, v in move:
        p[i] += step * v


def _undecided(p: list, units: list) -> list:
    return [i for i in units if EPS < p[i] < 1 - EPS]


def _make_up(size: np.ndarray, p: np.ndarray, k: int, value: float) -> tuple[float, np.ndarray]:
    """Unit k decided, and decided units changed, largest first, while that lessens
    the miss of words: (words still missed, p)."""
    q = p.copy()
    q[k] = value
    gap = float(size[k]) * (p[k] - value)
    for i in np.argsort(-size, kind="stable"):
        if i != k and 0 < size[i] <= abs(gap) and q[i] == float(gap < 0):
            q[i] = 1 - q[i]
            gap -= float(np.copysign(size[i], gap))
    return abs(gap), q


def land(size: np.ndarray, p: np.ndarray, rng) -> np.ndarray:
    """Decides what the flight left: the number of documents is given up first, the
    words are kept until one unit is left, and that one is drawn. If it is larger
    than ``OUTLIER`` medians, decided units make up for it; where they cannot for the value
    drawn, the other value is taken, if that misses less."""
    q = p.tolist()
    left = sorted(_undecided(q, range(len(q))), key=lambda i: -size[i])
    while len(left) > 1 and size[left[1]] > 0:
        i, j = left[:2]
        _move(q, [(i, 1.0), (j, -float(size[i]) / float(size[j]))], rng.random())
        still = _undecided(q, left)
        left = still if len(still) < len(left) else [k for k in left if k != j]
    p = np.clip(np.array(q, float), 0.0, 1.0)
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    for k in np.flatnonzero((p > 0) & (p < 1)):
        drawn = float(rng.random() < p[k])
        small = float(np.median(size))
        if size[k] <= OUTLIER * small:
            p[k] = drawn
            continue
        (miss, one), (other_miss, other) = _make_up(size, p, k, drawn), _make_up(size, p, k, 1 - drawn)
        p = one if miss <= max(small, other_miss) else other
    return p


UNIT_SCHEMA = "source string, key1 long, key2 long, size long, p double"


def _block(seed: int, level: int, last: bool):
    """The flight of one block, and on the last level its landing."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "key1", "key2"], ascending=[False, True, True])
        size = group["size"].to_numpy()
        rng = np.random.default_rng([seed, level, len(size), *(int(k) & 0xFFFFFFFF for k in group["key1"].iloc[:2])])
        p = flight(size, group["p"].to_numpy(), rng)
        return group[["source", "key1", "key2", "size"]].assign(p=land(size, p, rng) if last else p)
    return run


def cube_sample(units: DataFrame, seed: int = 7, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(key1, key2, p) with p 0 or 1, from (source, key1, key2, size, p)."""
    decided = []
    level = 0
    left = stored(units.select("source", "key1", "key2", "size", "p"), "mix-units")
    while True:
        blocks = stored(left.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
                        .select(F.col("source").alias("__source"),
                                F.ceil(F.col("n") / block_docs).cast("int").alias("blocks")), "mix-blocks")
        last = (blocks.agg(F.max("blocks")).first()[0] or 0) <= 1
        mine = F.pmod(F.xxhash64(F.lit(seed + level), "key1", "key2"), F.col("blocks"))
        dealt = (left.join(blocks, F.col("source").eqNullSafe(F.col("__source"))).withColumn("block", mine)
                 .select("source", "key1", "key2", "size", "p", "block"))

        done = stored(dealt.groupBy("source", "block").applyInPandas(_block(seed, level, last), UNIT_SCHEMA), "mix-level")
        settled = F.col("p").isin(0.0, 1.0)
        decided.append(done.where(settled))
        if last:
            break
        left, level = done.where(~settled), level + 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.select("key1", "key2", "p")


def word_count(text_col="text") -> F.Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACED_WORD_RE))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share: float = SHARE,
        max_repeat: float = MAX_REPEAT, seed: int = 7) -> DataFrame:
    """One row per distinct (id, source, text): doc_id, source, key1, key2, size, n_rows (equal
    documents), source_size, target, copies (in all, for these rows)."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        *row_keys(id_col, source_col, text_col), word_count(text_col).cast("long").alias("size"))
    key = ["doc_id", "source", "key1", "key2", "size"]
    groups = stored(sized.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")), "mix-sizes")
    targets = stored(source_targets(groups.select("source", (F.col("size") * F.col("n_rows")).alias("size")),
                                    weights, share, max_repeat), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = (groups.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
               .drop("__source").withColumn("wanted", rate * F.col("n_rows"))
               .withColumn("sure", F.floor(F.col("wanted") + EPS))
               .withColumn("p", F.greatest(F.lit(0.0), F.col("wanted") - F.col("sure"))))
    picked = cube_sample(planned.where(F.col("p") > EPS), seed).withColumnRenamed("p", "picked")
    return (planned.join(picked, ["key1", "key2"], "left")
            .select(*key, "n_rows", "source_size", "target",
                    (F.col("sure") + F.coalesce("picked", F.lit(0.0))).cast("long").alias("copies")))


def per_row(mixed: DataFrame) -> DataFrame:
    """One row per document of the input: its share of its group's copies."""
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)).alias("turn")
    return (mixed.select("*", turn)
            .withColumn("copies", F.floor(F.col("copies") / F.col("n_rows"))
                        + (F.col("turn") < F.pmod("copies", "n_rows")).cast("long")).drop("turn", "n_rows"))


def materialize(docs: DataFrame, mixed: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mix itself: the documents' own columns, each document as often as it
    is taken. Of rows equal in id, source and text one stands for all (see ``one_of_equals``)."""
    _, names = renamed(docs)
    mine = one_of_equals(docs.select(*row_keys(id_col, source_col, text_col),
                                     *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)]), ["key1", "key2"], names)
    taken = mixed.where("copies > 0").select("key1", "key2", "copies")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return (mine.join(taken, ["key1", "key2"]).select(*names, copy)
            .select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)]))
