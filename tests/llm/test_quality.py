import random
import re
from collections import Counter

import pytest

from transitrisk.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    repeat = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, dups, len(repeat), len(w) < 20 or 100 * len(repeat) > 30 * len(w)


def test_base_against_brute_force(spark, docs):
    rng = random.Random(2)
    vocabulary = ["a", "é日", "#x*", "<b>", "word.", "|", "$%&", "other", "\t", "\x0b"]
    rows = [(0, None), (1, ""), (2, "\n\n \n"), (None, "one"), (4, "a b\na b\n\na b"), (4, "a b\na b\n\na b")]
    for i in range(10, 60):
        block = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 10, 12, 60])))
        rows.append((i, "\n".join(rng.choice([block, " ".join(rng.choice(vocabulary) for _ in range(9))]) for _ in range(rng.randrange(9)))))
    rows.append((99, "long line of words here. " * 20_000))
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
                  for r in quality.clean_documents(docs(rows), keep=("doc_id",)).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)


@pytest.mark.parametrize("line, why", [
    ("", None), ("Heading", None), ("A plain sentence of some words.", None), ("Home | News | About | Contact", "navigation"),
    ("one # two", None), ("## ** %%", "punctuation"), ("BUY!! NOW!! HERE!!", "punctuation"),
    ("a b c d e f g h i j k", "punctuation"), ("a b c d e f g h i j k.", None), ("All Rights Reserved.", "boilerplate"),
    ("a | b and then a long sentence that happens to hold one bar.", None)])
def test_line_rules(line, why):
    assert quality.line_fails(line) == why


def test_cleaning_and_verdict(spark, docs):
    good = [" ".join(f"{w}{i}" for i in range(12)) + "." for w in "abc"]
    text = "\n".join(["Home | News | About | Contact", *good, "All rights reserved."])
    menu = "\n".join(["Home | News | About | More words | And more"] * 1 + [f"A{i} | B{i} | C{i} | D{i}" for i in range(9)] + ["One good line."])
    got = {r["doc_id"]: r for r in quality.clean_documents(docs([(1, text), (2, menu)]), keep=("doc_id",)).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == "\n".join(good)
    assert got[1]["n_bad_lines"] == 2
    assert not got[2]["kept"] and not got[2]["base_failed"] and got[2]["clean_text"] == "One good line."
    assert quality.clean_documents(docs([])).count() == 0


@pytest.mark.parametrize("line, why", [
    ("Copyright 2024 Example Inc. All rights reserved.", "boilerplate"), ("Please log in or sign in.", "boilerplate"),
    ("Privacy Policy, Terms of Use, Cookie Policy", "boilerplate"), ("Log in", "boilerplate"),
    ("A new design in oak.", None), ("The catalog in print.", None), ("They assign in turn.", None), ("A blog in French.", None),
    ("Readers who subscribe to the weekly letter find the terms of use of the archive on its last page.", None),
    *[(" ".join(["word"] * 12) + m, None) for m in "।॥。！？؟۔։።၊។།᠃：；𑅁"], (" ".join(["คำ"] * 12), None),
    (" ".join(["शब्द"] * 12), "punctuation"), (" ".join(["слово"] * 12), "punctuation")])
def test_phrases_are_words_and_marks_of_all_scripts(line, why):
    assert quality.line_fails(line) == why


def test_one_phrase_does_not_drop_a_long_line(spark, docs):
    text = " ".join(f"word{i}" for i in range(200)) + ". Some click here to subscribe to it; see the terms of use."
    hindi = " ".join(f"शब्द{i}" for i in range(30)) + "।"
    got = {r["doc_id"]: r for r in quality.clean_documents(docs([(1, text), (2, hindi)]), keep=("doc_id",)).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == text and got[2]["kept"] and got[2]["clean_text"] == hindi


def test_sql_states_the_line_rules(spark, docs, tmp_path):
    import duckdb

    from transitrisk.llm import queries
    lines = ["Please log in or sign in.", "Sign in log in sign in and then six more words of it.", "he will assign in time",
             "catalog in", "log in_ here", "élog in", "log iné", "Log In", "click here or subscribe to our list of all the many things.",
             "यह एक लंबा वाक्य है जिसमें दस से अधिक शब्द हैं और अंत में दंड है।", "a b c d e f g h i j k", "a b c d e f g h i j k。",
             "a b c d e f g h i j k ࠷", "one; two three four five six seven eight nine ten eleven", "## ** %%", "no! no! no!",
             "A | B | C | D", "A | B | C", "", " \t", "terms of use terms of service.", "terms  of use", "Lorem ipsum dolor."]
    rng = random.Random(4)
    rows = [(i, line) for i, line in enumerate(lines)]
    rows += [(100 + i, "\n".join(rng.choices(lines, k=rng.randrange(1, 9)) + ["Some words that stay, number %d of them." % i] * rng.randrange(4)))
             for i in range(80)] + [(300, None), (301, ""), (4, "a b\na b"), (4, "a b\na b"), (None, "sign in")]
    given = docs(rows)
    given.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(queries.oracle_sql()["op6_line_cleaning"])
    names = [c[0] for c in cur.description]
    got = queries.op6_line_cleaning(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cur.fetchall(), key=str)
    assert {r["n_bad_lines"] for r in got} >= {0, 1, 2}
