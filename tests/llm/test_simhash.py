import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from transitrisk.llm import simhash
from transitrisk.llm.components import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    grams = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=3):
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= distance:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in fps}


def test_against_brute_force(spark, docs):
    rng = random.Random(1)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(50)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one Two"), (5, "ONE two"), (6, "x" * 50_000)]
    for i in range(10, 60):
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 700])))))
    for i in range(100, 140):
        words = rows[20 + i % 3][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in (
        simhash.near_duplicates(docs(rows)).withColumnRenamed("id", "doc_id").collect())}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{v:016x}" for i, v in fps.items()}
    assert {i: c for i, (_, c) in got.items()} == brute_components(fps)


@pytest.mark.parametrize("block", [20_000, 40])
def test_links_keep_every_component(spark, block):
    """Random fingerprints around few centres; small blocks force the split of hot keys."""
    rng = random.Random(2)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(120):
            x = centre
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    reps = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.similarity_links(reps, block=block)
    found = {(r["a"] & (2 ** 64 - 1), r["b"] & (2 ** 64 - 1)) for r in links.collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    assert len(found) < len(fps) * simhash.SEGMENTS
    want = brute_components({x: x for x in signed} and {s: s & (2 ** 64 - 1) for s in signed})
    comp = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert len({comp.get(x, x) for x in signed}) == len(set(want.values()))


def test_chain_principle_loses_no_pair():
    """Every pair within the distance passes the chain test from a start whose exact segments are equal."""
    rng = np.random.default_rng(3)
    masks, budget = simhash._chain_masks(simhash.SEGMENTS, 3)
    exact = simhash.exact_segments(simhash.SEGMENTS, 3)
    for _ in range(3000):
        flips = rng.choice(64, rng.integers(0, 4), replace=False)
        x = np.array([sum(1 << int(f) for f in flips)], np.uint64)
        ok = [s for s in range(simhash.SEGMENTS) if not int(x[0] & masks[s, exact - 1]) and len(
            simhash.ring_links(x, np.zeros(1, np.uint64), np.array([s]), masks, budget, 3))]
        assert ok


def test_nulls_ties_and_empty_tables(spark, docs):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "q r s t u")]
    got = [(r["id"], r["component_id"]) for r in simhash.near_duplicates(docs(rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, 7), (None, 7), (7, 7), (7, 7), (None, None)], key=str)
    assert simhash.near_duplicates(docs([])).count() == 0
