import random

import pytest

import corpus_pipeline
from transitrisk.llm import mixing, quality, queries, simhash
from transitrisk.llm.common import LOWER, bloom, in_bloom, word_hashes


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi", "nu") for b in ("ta", "se", "ri", "vo") for c in ("", "n", "rk")]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    texts = ["\n".join(sentence(rng) for _ in range(rng.choice([4, 9, 30]))) for _ in range(40)]
    items = [sentence(rng, 20) for _ in range(3)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100, texts[3], "s0"), (101, texts[3], "s1"), (7, texts[7], "s1")]            # copies, a repeated row
    rows += [(200, texts[5] + "\n" + items[0], "s0"), (201, items[1] + "\n" + texts[30], "s0")]
    rows += [(300, "too short", "s2"), (301, None, "s2"), (302, "\n".join(["A | B | C | D | E"] * 9), "s2"), (None, texts[11] + " x y", None)]
    docs = spark.createDataFrame([(*r, "en", len(r[1] or ""), i) for i, r in enumerate(rows)],
                                 "doc_id long, text string, source string, lang string, n_chars long, row int")
    return docs, items


def test_stages(spark, table, tmp_path):
    docs, items = table
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = docs
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        at = spark.read.parquet(path)
        kept[k] = at.collect()
    ids = [{r["doc_id"] for r in kept[k]} for k in range(5)]
    assert not ids[0] & {300, 301, 302} and len(ids[0]) == 45
    assert all(r["n_chars"] == len(r["text"]) for r in kept[0])
    # one document of each group, no repeated row
    comp = {(r["id"], r["component_id"]) for r in simhash.near_duplicates(spark.read.parquet(str(tmp_path / "0"))).collect()}
    assert len(kept[1]) == len({c for _, c in comp}) and ids[1] == {c for _, c in comp}
    assert not ids[1] & {100, 101} and 3 in ids[1]
    assert ids[1] - ids[2] <= {200, 201, 5, 30} and 201 not in ids[2]
    mixed = mixing.mix(spark.read.parquet(str(tmp_path / "2"))).collect()
    assert len(kept[3]) == sum(r["copies"] for r in mixed)
    assert len(kept[4]) == len(kept[3]) and sorted(r["start"] for r in kept[4])[0] == 0


def test_run_and_registration(spark, table, tmp_path):
    docs, items = table
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES["pipeline"](spark, str(tmp_path)).count() == 0
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k != "pipeline") == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.QUERIES)
    assert quality.MIN_WORDS == 20 and LOWER[ord("Q")] == ord("q")


def test_bloom_has_no_false_negatives(spark):
    import numpy as np
    words = [f"w{i}".encode() for i in range(5000)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    h = word_hashes(data, np.concatenate([[0], ends[:-1] + 1]), ends)
    assert len(set(h.tolist())) == 5000
    known = bloom(spark.createDataFrame([(int(x),) for x in h[:2500].view(np.int64)], "k long"), "k")
    found = in_bloom(known, h)
    assert found[:2500].all() and found[2500:].sum() < 50


def test_equal_rows_have_one_stand_in(spark):
    from transitrisk.llm.common import one_of_equals
    kinds = "doc_id long, text string, source string, lang string, row int, more map<string,int>"
    rows = [(1, "a b c", "s", "en", i, {"k": i}) for i in range(30)] + [(None, None, None, None, i % 2, None) for i in range(6)]
    picked = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, kinds).repartition(5)
        kept = corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()
        mixed = corpus_pipeline.source_mixing(spark, docs, "").collect()
        assert len(kept) == 2 and kept[0].asDict().keys() == rows_of(docs)
        picked.append((sorted(map(str, kept)), sorted(map(str, mixed))))
        assert len({str(r) for r in mixed if r["doc_id"] == 1}) == 1 and all(r in order for r in map(tuple, kept))
    assert picked[0] == picked[1]
    keyed = spark.createDataFrame(rows, kinds).withColumn("k", picked_key())
    names = [c for c in keyed.columns if c != "k"]
    assert one_of_equals(keyed, ["k"], names).count() == 2


def rows_of(docs):
    return dict.fromkeys(docs.columns).keys()


def picked_key():
    from pyspark.sql import functions as F
    return F.coalesce("doc_id", F.lit(-1))
