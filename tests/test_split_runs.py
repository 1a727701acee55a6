"""Blocks of a run against windows over the whole run; exact path numbers."""

import random

import pytest
from pyspark.sql import functions as F

from transitrisk.operators import paths as PA
from transitrisk.operators import split_runs as SR
from transitrisk.operators import timetable as TT

STATS = ("trip_id long, day_start int, week_day int, arr_sod int, dep_sod int, stop string, "
         "mean_delay double, std_delay double, num_delays int")


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or sorted(df.columns))).collect()), key=repr)


def stats_rows(seed, n):
    rng, seen = random.Random(seed), {}
    for _ in range(n):
        trip, start = rng.choice([1, 1, 1, 1, 2, None]), rng.choice([0, 6])
        arr = rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 40, 3600, 86399])
        key = (trip, start, (start + rng.choice([0, 0, 1, 6])) % 7, arr, arr + rng.choice([-3, 0, 60]), rng.choice("abcx"))
        seen[key] = (rng.choice([None, rng.uniform(0, 9)]), None, rng.randrange(30))
    return [(*k, *v) for k, v in seen.items()]


@pytest.mark.parametrize("block_s", [3, 100_000_000])
def test_pairs_and_bridges_by_blocks(spark, block_s):
    stats = spark.createDataFrame(stats_rows(5, 250), STATS).cache()
    whole, split = TT.consecutive_pairs(stats).cache(), SR.consecutive_pairs(stats, block_s).cache()
    assert split.columns == whole.columns and dict(split.dtypes) == dict(whole.dtypes)
    assert rows(split) == rows(whole) and whole.count() > 150
    a, b = TT.bridge_repair(whole, "x"), SR.bridge_repair(split, "x")
    assert rows(a) == rows(b) and a.count() < whole.count()
    assert sum(r["wrap"] for r in split.collect()) == stats.select("trip_id", "day_start").distinct().count()


def test_segments_by_blocks(spark):
    rng = random.Random(9)
    data = [(i, rng.choice([1, 1, 2, None]), 0, rng.choice("ab"), rng.choice("ab"), t, t + rng.choice([1, 4, 90]))
            for i, t in enumerate(rng.choices([0, 1, 2, 3, 5, 8, 9, 4000, 90_000], k=200))]
    e = spark.createDataFrame(data, "edge_id long, trip_id long, day_start int, dep_node string, arr_node string, "
                                    "dep_sow int, arr_sow int")
    want = rows(PA.chain_segments(e), "edge_id", "seg", "seq")
    assert rows(SR.chain_segments(e, 3), "edge_id", "seg", "seq") == want
    assert rows(SR.chain_segments(e), "edge_id", "seg", "seq") == want
    assert max(s for _, s, _ in want) > 10


def test_empty_runs(spark):
    none = spark.createDataFrame([], STATS)
    pairs = SR.consecutive_pairs(none)
    assert pairs.count() == 0 and SR.bridge_repair(pairs, "x").count() == 0


def test_path_numbers_do_not_collide(spark):
    lists = [["a", "b"], ["a"], ["b", "a"], ["a", "b"], ["a", None], [], None]
    # a hash that puts every list under one key
    paths = spark.createDataFrame([(i, 0, p) for i, p in enumerate(lists)], "trip_id long, day_start int, path array<string>")
    paths = paths.withColumns({"path_id": F.lit(7).cast("long"), "n_stops": F.size("path")})
    dictionary = PA.path_dictionary(paths)
    numbers = {tuple(r["path"]): r["path_no"] for r in dictionary.collect()}
    assert sorted(numbers.values()) == list(range(5))
    assert numbers[()] == 0 and numbers[("a",)] < numbers[("a", "b")] < numbers[("b", "a")]
    exact = {r["trip_id"]: r["path_id"] for r in PA.exact_path_ids(paths, dictionary).collect()}
    assert exact[0] == exact[3] and exact[6] is None and len({exact[i] for i in range(6)}) == 5


def test_path_numbers_stay_when_paths_are_added(spark):
    def of(*lists):
        return spark.createDataFrame([(list(p),) for p in lists], "path array<string>")

    first = PA.path_dictionary(of("mn", "xy"))
    more = PA.path_dictionary(of("xy", "ab", "zz", "ab"), first)
    assert {"".join(r["path"]): r["path_no"] for r in more.collect()} == {"mn": 0, "xy": 1, "ab": 2, "zz": 3}
    none = PA.path_dictionary(of("a").limit(0))
    assert none.count() == 0 and PA.path_dictionary(of("q"), none).first()["path_no"] == 0


def test_many_ranges_are_dense(spark):
    paths = spark.range(5000).select(F.array(F.sha2(F.col("id").cast("string"), 256)).alias("path"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [(r["path"][0], r["path_no"]) for r in PA.path_dictionary(paths).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [n for _, n in sorted(got)] == list(range(5000))
