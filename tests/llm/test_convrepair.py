"""Conversation repair against an enumeration of all edit strings."""

import hashlib
import random
import re
import zlib

import pytest

from transitrisk.llm import convrepair

PATTERN = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def faults(messages):
    out, seen = [], set()
    for role, text in messages:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen
                   else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def brute(messages):
    """Least (cost, audit) and its messages: every edit string up to the cost of deleting all."""
    flaws, best = faults(messages), None

    def go(i, cost, audit, made):
        nonlocal best
        if cost > 3 * len(messages) or (best and cost > best[0]):
            return
        if i == len(messages) and PATTERN.fullmatch("".join(r[0] for r, _ in made)):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, made)
        for role in ("user", "assistant"):
            go(i, cost + 2, audit + "I", [*made, (role, "")])
        if i < len(messages):
            role, text = messages[i]
            go(i + 1, cost + 3, audit + "D", made)
            if flaws[i] not in ("blank", "duplicate"):
                extra = int(flaws[i] == "truncated")
                if role:
                    go(i + 1, cost + extra, audit + "K", [*made, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, cost + extra + 2, audit + "R", [*made, (other, text)])

    go(0, 0, "", [])
    return best


def expected(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of ordered (turn, role, text) rows."""
    messages = [(r, t) for _, r, t in rows]
    flaws = faults(messages)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, made = brute(messages)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(messages, messages[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(flaws.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def case(rng, most=4):
    texts = ["Yes.", "No", " ", "", "é日 ok!", "a\nb?", "end. \x0b", "#"]
    n = rng.randrange(1, most + 1)
    turns = sorted(rng.choice([None, 0, 1, 2, 5, 9]) or i for i in range(n))
    return [(t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "ü"]), rng.choice(texts)) for t in turns]


def columns(r):
    return tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


@pytest.mark.parametrize("segment_rows", [1024, 1, 2])
def test_against_all_edit_strings(spark, segment_rows):
    rng = random.Random(segment_rows)
    rows, want = [], {}
    for conv in range(60):
        mine = [(t + 100 * i, r, x) for i, (t, r, x) in enumerate(case(rng))]
        rows += [(conv, *m, 0, 0) for m in mine]
        want[conv] = expected(mine)
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part long, costs long")
    got = {r["conv_id"]: columns(r) for r in convrepair.repair_report(table, segment_rows=segment_rows).collect()}
    assert got == want


def test_long_conversation_is_the_same_in_any_segments(spark):
    rng = random.Random(5)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"{i}.", ""])) for i in range(700)]
    rows += [(7, 3, "user", "Same.")] * 40 + [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Hi.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [sorted(map(str, convrepair.repair_report(table, segment_rows=n).collect())) for n in (10_000, 16, 1)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 2


def test_checkpoints_are_the_full_vectors():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 16, 17, 101):
        messages = [(rng.choice("sua "), rng.choice([None, "blank", "truncated"])) for _ in range(n)]
        full = convrepair.vectors(messages, convrepair.FINISH)
        length, kept = convrepair.checkpoints(messages, convrepair.FINISH)
        assert len(kept) <= 2 * length + 2
        assert [full[min(n, (i + 1) * length)] for i in range(len(kept))] == kept
        edits = list(convrepair.walk(messages, convrepair.FINISH, convrepair.NONE, True))
        assert sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] + (e in "KR" and messages[i][1] == "truncated") for e, i, _ in edits) == full[0][0]


def test_repaired_messages_and_edges(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again."), (2, 0, "", "Text."), (3, 0, "assistant", "One."), (3, 0, "assistant", "One.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = convrepair.repaired_messages(convrepair.repair_segments(table)).orderBy("conv_id", "part", "seg", "pos").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in made if r["conv_id"] == 1] == [(1, "user", "Hello."), (1, "assistant", "Again.")]
    audits = {r["conv_id"]: r["audit"] for r in convrepair.repair_report(table).collect()}
    assert audits == {1: "KR", 2: "D", 3: "IKD"}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert convrepair.repair_report(empty).collect() == []


def test_registered_query(spark, tmp_path):
    from transitrisk.llm.queries import op13_conversation_repair
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["Ja. Nein!", "Hm", None, "", "Ok?"]), "x")
            for c in range(40) for t in range(rng.randrange(1, 5))] + [(None, None, "user", "A.", "x"), (50, None, "system", "B.", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text, _ in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1])):
            role, text = (" " if x is None else x for x in (role, text))
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        want[conv] = expected(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = op13_conversation_repair(spark, str(tmp_path)).collect()
    assert {r["conv_id"]: columns(r) for r in got} == want and len(got) == len(want)
