import random
import re

from transitrisk.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(text):
    w, places, labels = words(text), [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark, docs):
    rng = random.Random(1)
    pieces = ["under the MIT", "license", "Apache License, Version 2", "cc by nc", "CC-BY-NC 4.0", "word", "the", "É日",
              "Released under the MIT License.", "cc by", "nc"]
    rows = [(0, None), (1, ""), (2, "cc by nc cc by nc"), (None, "under the mit license"), (3, "cc by nc"), (3, "cc by nc")]
    rows += [(10 + i, " ".join(rng.choice(pieces) for _ in range(rng.choice([2, 20, 300])))) for i in range(40)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                  for r in licenses.license_report(docs(rows)).collect()), key=str)
    assert got == sorted(((i, *brute_base(t)) for i, t in rows), key=str)


def test_diagonals_tolerate_small_edits(spark, docs):
    notice = next(t for t, label in licenses.NOTICES if label == "bsd")
    w = notice.split()
    edited = " ".join(w[:5] + ["extra"] + w[5:])
    scattered = " ".join(x for i in range(0, len(w) - 2, 3) for x in [*w[i:i + 3], *["gap"] * 40])
    rows = [(1, f"start {notice.upper()} end"), (2, edited), (3, scattered), (4, " ".join(w[:5])), (5, "x " * 5000 + notice)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_report(docs(rows)).collect()}
    assert got[1] == ("bsd", 1.0) and got[5] == ("bsd", 1.0)
    assert got[2][0] == "bsd" and 0.8 <= got[2][1] <= 1
    assert got[3] == ("", 0.0) and got[4] == ("", 0.0)


def test_labels_include_base(spark, docs):
    rows = [(1, "Licensed under CC BY-NC 4.0. All rights reserved."), (2, "cc by nc")]
    got = {r["doc_id"]: (r["base_labels"], r["labels"]) for r in licenses.license_report(docs(rows)).collect()}
    assert got == {1: ("cc-by-nc", "all-rights-reserved,cc-by-nc"), 2: ("cc-by-nc", "cc-by-nc")}
    assert licenses.license_report(docs([])).count() == 0


def test_copies_close_together(spark, docs):
    bsd = next(t for t, label in licenses.NOTICES if label == "bsd")
    w = bsd.split()
    edited = " ".join(w[:5] + ["extra"] + w[5:])
    rows = [(1, "A. All rights reserved. B. All rights reserved."), (2, "all rights reserved " * 50),
            (3, "Released under the MIT license. Released under the MIT license."), (4, f"{edited} x {edited}"),
            (5, f"{bsd} {edited} {bsd}"), (6, "all rights reserved"), (7, "all rights x rights reserved all")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_report(docs(rows)).collect()}
    assert got == {1: ("all-rights-reserved", 1.0), 2: ("all-rights-reserved", 1.0), 3: ("mit", 1.0), 4: ("bsd", 1.0),
                   5: ("bsd", 1.0), 6: ("all-rights-reserved", 1.0), 7: ("", 0.0)}
    spans = licenses.scan_licenses(docs(rows))[1].where("not base").collect()
    places = {i: sorted((r["first"], r["last"]) for r in spans if r["doc_id"] == i) for i, _ in rows}
    n = len(w)
    assert places[1] == [(1, 3), (5, 7)] and places[2] == [(3 * i, 3 * i + 2) for i in range(50)]
    assert places[3] == [(0, 4), (5, 9)] and places[4] == [(0, n), (n + 2, 2 * n + 2)] and len(places[5]) == 3
