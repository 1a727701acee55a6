import hashlib
import random
import re

from transitrisk.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, items, n=13):
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        v = words(text)
        for i in range(max(1, len(v) - n + 1) if v else 0):
            window = v[i:i + n]
            for p in range(len(w) - len(window) + 1):
                if w[p:p + len(window)] == window:
                    hit.update(range(p, p + len(window)))
                    found.add("" if item is None else str(item))
    listed = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_against_brute_force(spark, docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "日本"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 13, 14, 30])))) for i in range(12)]
    items += [(3, items[4][1]), (None, "only null here"), (50, None), (51, "--"), (52, items[6][1].upper())]
    rows = [(0, None), (1, ""), (2, "..."), (None, "x only NULL here y"), (5, items[3][1]), (5, items[3][1])]
    for i in range(20, 60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 60])))]
        for _ in range(rng.randrange(3)):
            parts.append(", ".join(words(rng.choice(items)[1])))
            parts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 300]))))
        rows.append((i, " ".join(parts)))
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, `row` int, term int")
    got = decontam.contamination(docs(rows), bench).collect()
    have = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got), key=str)
    assert have == sorted(((i, *brute(t, items)) for i, t in rows), key=str)


def test_proximity_and_slop(spark, docs):
    item = " ".join(f"u{i}" for i in range(13))
    changed = item.replace("u6", "u6 inserted between")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item), (2, changed), (3, "nothing of it")]
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in decontam.contamination(docs(rows), bench, slop=2, anchors=13).collect()}
    assert got[1][0] == 13 and got[1][1] > 0
    assert got[2][0] == 0 and got[2][1] > 0
    assert got[3] == (0, 0)


def brute_near(doc, items, n=13, slop=8, percent=80):
    """Windows of which enough words stand near where they belong, beside any word of the window."""
    w, found = words(doc), set()
    windows = {tuple(v[i:i + n]) for v in (words(t) for _, t in items) for i in range(max(1, len(v) - n + 1) if v else 0)}
    for window in windows:
        for off, term in enumerate(window):
            for p in (p for p, x in enumerate(w) if x == term):
                met = sum(any(x == t and abs(p + j - off - q) <= slop for q, x in enumerate(w[max(0, p - n + 1):p + n], max(0, p - n + 1)))
                          for j, t in enumerate(window))
                if 100 * met >= percent * len(window):
                    found.add(window)
    return len(found)


def test_near_as_shipped(spark, docs):
    """Changed, dropped, inserted and moved words; words no document holds; shipped parameters."""
    rng = random.Random(8)
    items = [(i, " ".join(f"t{i}x{j}" for j in range(rng.choice([1, 3, 6, 13, 20])))) for i in range(10)]
    rows, least = [(0, None)], 0
    for k in range(1, 60):
        v = words(rng.choice(items)[1])
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(v) + 1)
            v[at:at + rng.choice([0, 1])] = [f"new{rng.randrange(9)}"] * rng.choice([0, 1, 2])
        rows.append((k, " ".join(["a", "b"] * rng.randrange(5) + v + ["c"] * rng.randrange(5))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r["n_near"] for r in decontam.contamination(docs(rows), bench).collect()}
    want = {i: brute_near(t, items) for i, t in rows}
    # a posting beside an anchor sees what any word of the window sees, up to the slop
    assert all(0 <= got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 20
    for i, t in rows:
        assert got[i] >= (brute(t, items)[1] > 0)


def test_near_needs_more_than_two_words(spark, docs):
    item = " ".join(f"u{i}" for i in range(13))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "u0 u1 and nothing else"), (2, item.replace("u4", "other")), (3, item.replace("u4 ", "").replace("u9", "x")),
            (4, " ".join(reversed(item.split())))]
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in decontam.contamination(docs(rows), bench).collect()}
    assert got == {1: (0, 0), 2: (0, 1), 3: (0, 1), 4: (0, 0)}


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontam.contamination(docs([(1, "a b")]), bench).select("n_words", "n_hit", "contaminated").collect()] == [(2, 0, False)]
    assert decontam.contamination(docs([]), bench).count() == 0
