"""Conversation structure repair by a square-root checkpointed dynamic program.

A conversation is repaired into the role pattern ``(s?(ua)+)?`` (initials of
system, user, assistant) by the cheapest edits of its messages in order:

    K  keep              0, its role's initial must fit
    R  rerole            2, to user or assistant
    D  delete            3, the only edit of blank and duplicate messages
    I  insert            2, an empty user or assistant message, anywhere

Undeleted truncated messages add 1. Of equally cheap edit strings (audits) the
ASCII-least is taken.

The program's state is the last role kept: nothing, s, u or a. Its backward
vectors (cost to finish from each state) are stored only every sqrt(n)
messages; walking forward, the vectors of one block at a time are computed
again and the ASCII-least tight edit is emitted. A long conversation is cut
into segments that are rows of a table. A segment's cost is a 4 x 4 min-plus
matrix, so the vectors at segment ends (the checkpoints above) come from a fold
over matrices, the states at segment starts from a fold over state maps, and
every segment is walked in a task of its own.

Defined results: a null role or text is one space; messages are ordered by
turn (nulls first), then role, then a hash of the text, so repeated rows stand
together; a role without initial (empty) can't be kept; a null conv_id is a
conversation of its own; an empty table gives an empty report. What a digest
column of one conversation concatenates is streamed, not collected; its audit
must fit in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from transitrisk.llm.common import stored

#: Messages and characters after which a segment of a conversation ends.
SEGMENT_ROWS = 1024
SEGMENT_CHARS = 1 << 18

SPACE = " \t\n\x0b\x0c\r"
END_MARKS = ".!?"
NONE, S, U, A = range(4)
STATES = (NONE, S, U, A)
#: The user or assistant turn that a state lets follow, and the state after it.
FOLLOWS = (U, U, A, U)
KEEPS = ({"s": S, "u": U}, {"u": U}, {"a": A}, {"u": U})
ROLE = {U: "user", A: "assistant"}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
FINISH = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
LEGAL_PAIRS = {"su", "ua", "au"}


def fault(text: str, duplicate: bool) -> str | None:
    """A message's first fault: blank, duplicate or truncated."""
    body = text.rstrip(SPACE)
    if not body:
        return "blank"
    if duplicate:
        return "duplicate"
    return None if body[-1] in END_MARKS else "truncated"


def step_back(after: tuple, initial: str, flaw: str | None) -> tuple:
    """Cost vector before a message from the one after it; inserts may come first."""
    extra = CUT_OFF if flaw == "truncated" else 0
    free = flaw not in ("blank", "duplicate")
    here = []
    for state in STATES:
        cost = DELETE + after[state]
        if free:
            cost = min(cost, REROLE + extra + after[FOLLOWS[state]])
            kept = KEEPS[state].get(initial)
            if kept is not None:
                cost = min(cost, extra + after[kept])
        here.append(cost)
    # u and a follow each other, so one insert more never helps; none and s lead to u
    u, a = min(here[U], INSERT + here[A]), min(here[A], INSERT + here[U])
    return min(here[NONE], INSERT + u), min(here[S], INSERT + u), u, a


def vectors(messages: list, after: tuple) -> list[tuple]:
    """Cost vectors before each message and, last, after all of them."""
    out = [after]
    for initial, flaw in reversed(messages):
        out.append(step_back(out[-1], initial, flaw))
    out.reverse()
    return out


def checkpoints(messages: list, after: tuple) -> tuple[int, list[tuple]]:
    """Block length and the vectors at the end of every block of messages."""
    length = max(1, isqrt(len(messages)))
    kept, now = [after], after
    for i in range(len(messages) - 1, 0, -1):
        now = step_back(now, *messages[i])
        if i % length == 0:
            kept.append(now)
    kept.reverse()
    return length, kept


def walk(messages: list, after: tuple, state: int, last: bool) -> Iterator[tuple[str, int, int]]:
    """The ASCII-least cheapest edits from a state: (letter, message or -1, state after).
    ``after`` is the cost vector behind the last message; ``last`` allows inserts there."""
    length, ends = checkpoints(messages, after)
    for block, end in enumerate(ends):
        first = block * length
        part = messages[first:first + length] if messages else []
        cost = vectors(part, end)
        for i, (initial, flaw) in enumerate(part):
            extra = CUT_OFF if flaw == "truncated" else 0
            while True:
                left, behind = cost[i][state], cost[i + 1]
                if left == DELETE + behind[state]:
                    yield "D", first + i, state
                    break
                if left == INSERT + cost[i][FOLLOWS[state]]:
                    state = FOLLOWS[state]
                    yield "I", -1, state
                    continue
                kept = KEEPS[state].get(initial)
                if kept is not None and flaw not in ("blank", "duplicate") and left == extra + behind[kept]:
                    state = kept
                    yield "K", first + i, state
                else:
                    state = FOLLOWS[state]
                    yield "R", first + i, state
                break
    if last:
        while FINISH[state]:
            state = FOLLOWS[state]
            yield "I", -1, state


def matrix(messages: list) -> list[int]:
    """Least cost from every state before the messages to every state behind them, row by row."""
    columns = [vectors(messages, tuple(0 if s == to else FAR for s in STATES))[0] for to in STATES]
    return [min(columns[to][state], FAR) for state in STATES for to in STATES]


def messages_of(roles: list[str], texts: list[str], earlier: set) -> list[tuple[str, str | None]]:
    """(initial, fault) of a segment's messages; ``earlier`` holds the positions of those
    whose role and text stand in an earlier segment of the conversation."""
    seen, out = set(), []
    for i, said in enumerate(zip(roles, texts)):
        out.append((said[0][:1], fault(said[1], i in earlier or said in seen)))
        seen.add(said)
    return out


def _segments(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Rows in order, as segments: conv_id, part, seg, turns, roles, texts, keys (first of each in the segment)."""
    conv = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "part", "seg", "turns", "roles", "texts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, seg, whose, part = [], 0, 0, None, 0

        def flush():
            turns, roles, texts = (list(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array([whose], kind), pa.array([part], pa.int32()), pa.array([seg], pa.int64()), pa.array([turns], pa.list_(pa.int64())),
                 pa.array([roles], pa.list_(pa.string())), pa.array([texts], pa.list_(pa.string()))], names)

        for batch in batches:
            kind = batch["conv_id"].type
            for conv_id, turn, role, text, part_id in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "part"))):
                if held and (conv_id != whose or len(held) >= segment_rows or chars >= SEGMENT_CHARS):
                    yield flush()
                    held, chars, seg = [], 0, seg + 1
                whose, part = conv_id, part_id
                held.append((turn, role, text))
                chars += len(text)
        if held:
            yield flush()

    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_key"), F.col("no")]
    src = (rows.withColumns({"text_key": F.xxhash64("text"), "no": F.monotonically_increasing_id()})
           .repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
           .select("conv_id", "turn", "role", "text", "part"))
    return stored(src.mapInArrow(run, f"conv_id {conv}, part int, seg long, turns array<long>, roles array<string>, "
                                      "texts array<string>"), "repair-segments")


def _seen_earlier(long_ones: DataFrame) -> DataFrame:
    """(part, seg, earlier): positions of messages whose role and text stand in an earlier
    segment of their conversation. A segment names each message once, so a frequent one
    weighs a row per segment."""
    at = F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "said")
    keyed = long_ones.select("conv_id", "part", "seg", at).select(
        "conv_id", "part", "seg", "pos", *[F.xxhash64(F.lit(i), "said.roles", "said.texts").alias(f"key{i}") for i in (1, 2)])
    once = keyed.groupBy("conv_id", "key1", "key2", "part", "seg").agg(F.min("pos").alias("pos"))
    first = F.min(F.struct("part", "seg")).over(Window.partitionBy("conv_id", "key1", "key2"))
    return (once.withColumn("first", first).where(F.struct("part", "seg") > F.col("first"))
            .groupBy("part", "seg").agg(F.collect_list("pos").alias("earlier")))


def _fold(rows: DataFrame, fields: list[str], start, step, out: str, forward: bool) -> DataFrame:
    """Runs ``step(state, row)`` along every conversation's segments, streaming through one
    small row a segment: (part, seg, the state that reaches the segment)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, state = object(), None
        for batch in batches:
            got = []
            for conv_id, *values in zip(*(batch[c].to_pylist() for c in ("conv_id", *fields))):
                if conv_id != whose:
                    whose, state = conv_id, start
                got.append(state)
                state = step(state, *values)
            yield pa.RecordBatch.from_arrays([batch["part"], batch["seg"], pa.array(got, kind)], ["part", "seg", out])

    kind = pa.int32() if isinstance(start, int) else pa.list_(pa.int64())
    order = [F.col("conv_id"), *((F.col(c) if forward else F.col(c).desc()) for c in ("part", "seg"))]
    src = rows.select("conv_id", "part", "seg", *fields).repartition("conv_id").sortWithinPartitions(*order)
    return src.mapInArrow(run, f"part int, seg long, {out} {'int' if isinstance(start, int) else 'array<long>'}")


def _before(after: list[int], costs: list[int]) -> list[int]:
    return [min(costs[4 * s + t] + after[t] for t in STATES) for s in STATES]


def _each_segment(rows: DataFrame, fields: list[str], name: str, kind: str, compute) -> DataFrame:
    """(conv_id, part, seg, ``compute`` of the segment's fields)."""
    arrow = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [compute(*values) for values in zip(*(batch[c].to_pylist() for c in fields))]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["part"], batch["seg"], pa.array(got, arrow)],
                                             ["conv_id", "part", "seg", name])

    conv = rows.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "part", "seg", *fields).mapInArrow(run, f"conv_id {conv}, part int, seg long, {name} {kind}")


SEGMENT_SCHEMA = ("part int, seg long, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, "
                  "cost long, first_turn long, last_turn long, turns_seen long, first_initial string, last_initial string, "
                  "audit string, roles array<string>, texts array<string>")


def repair_segments(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text",
                    segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Segments of conversations with their counts, audit and repaired messages (roles, texts)
    in order of (conv_id, part, seg); ``whole`` marks a conversation of one segment."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                blank(role_col).alias("role"), blank(text_col).alias("text"))
    segments = _segments(rows, segment_rows)
    ends = segments.groupBy("conv_id").agg(F.max(F.struct("part", "seg")).alias("end"), F.count(F.lit(1)).alias("n_segments"))
    many = stored(ends.where("n_segments > 1").select(F.col("conv_id").alias("__conv"), "end"), "repair-many")
    long_ones = (segments.join(many, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
                 .withColumn("last", F.struct("part", "seg") == F.col("end")).drop("end"))
    earlier = stored(_seen_earlier(long_ones), "repair-earlier")
    long_ones = long_ones.join(earlier, ["part", "seg"], "left")

    said = ["roles", "texts", "earlier"]
    costs = stored(_each_segment(long_ones, said, "costs", "array<long>",
                                 lambda r, t, e: matrix(messages_of(r, t, set(e or ())))), "repair-costs")
    after = stored(_fold(costs, ["costs"], list(FINISH), _before, "after", forward=False), "repair-after")
    known = long_ones.join(after, ["part", "seg"])

    def ends_of(roles, texts, seen, behind):
        messages = messages_of(roles, texts, set(seen or ()))
        out = []
        for state in STATES:
            for _, _, state in walk(messages, tuple(behind), state, False):
                pass
            out.append(state)
        return out

    maps = stored(_each_segment(known, [*said, "after"], "ends", "array<long>", ends_of), "repair-ends")
    start = _fold(maps, ["ends"], NONE, lambda state, to: to[state], "state", forward=True)
    placed = stored(long_ones.select("part", "seg", "earlier", "last").join(after, ["part", "seg"])
                    .join(start, ["part", "seg"]), "repair-states")
    conv = rows.schema["conv_id"].dataType.simpleString()
    return stored(segments.join(placed, ["part", "seg"], "left").mapInArrow(_emit, f"conv_id {conv}, {SEGMENT_SCHEMA}"),
                  "repair-edits")


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks each segment from its state and writes its repaired messages."""
    types = [pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 9, *[pa.string()] * 3, *[pa.list_(pa.string())] * 2]
    names = [f.split()[0] for f in SEGMENT_SCHEMA.split(", ")]
    for batch in batches:
        out = []
        for part, seg, turns, roles, texts, earlier, last, after, state in zip(
                *(batch[c].to_pylist() for c in ("part", "seg", "turns", "roles", "texts", "earlier", "last", "after", "state"))):
            whole = state is None
            messages = messages_of(roles, texts, set(earlier or ()))
            audit, said_by, said, cost = [], [], [], 0
            for letter, i, now in walk(messages, tuple(after or FINISH), state or NONE, whole or last):
                audit.append(letter)
                cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[letter]
                if letter != "D":
                    cost += CUT_OFF if i >= 0 and messages[i][1] == "truncated" else 0
                    said_by.append(roles[i] if letter == "K" else ROLE[now])
                    said.append(texts[i] if i >= 0 else "")
            flaws = [flaw for _, flaw in messages]
            known = [t for t in turns if t is not None]
            out.append((part, seg, whole, len(roles), *(flaws.count(f) for f in ("blank", "duplicate", "truncated")),
                        sum(a[0] + b[0] not in LEGAL_PAIRS for a, b in zip(messages, messages[1:])), cost,
                        known[0] if known else None, known[-1] if known else None, len(set(known)),
                        messages[0][0], messages[-1][0], "".join(audit), said_by, said))
        columns = list(zip(*out)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([batch["conv_id"], *(pa.array(c, t) for c, t in zip(columns, types))], ["conv_id", *names])


def repaired_messages(segments: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, part, seg, pos (order within them), role, text."""
    at = F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "m")
    return segments.select("conv_id", "part", "seg", at).select(
        "conv_id", "part", "seg", "pos", F.col("m.roles").alias("role"), F.col("m.texts").alias("text"))


REPORT_SCHEMA = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
                 "repaired_sha256 string")


def report(segments: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and REPORT_SCHEMA. Segments of long conversations
    pass one after the other through a task that holds counts and a running digest only."""
    conv = f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, "
    ordered = (segments.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg"))
    return (segments.where("whole").mapInArrow(_summaries, conv + REPORT_SCHEMA)
            .unionByName(ordered.mapInArrow(_summaries, conv + REPORT_SCHEMA)))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in REPORT_SCHEMA.split(", ")]
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    now, kind = None, None

    def rows(done):
        columns = list(zip(*((x["conv_id"], 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["turns"],
                              *(x[c] for c in counts), "".join(x["audit"]), x["sha"].hexdigest()) for x in done)))
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", *names])

    for batch in batches:
        kind, done = batch["conv_id"].type, []
        for r in batch.to_pylist():
            if now is None or now["conv_id"] != r["conv_id"] or r["whole"]:
                if now is not None:
                    done.append(now)
                now = {"conv_id": r["conv_id"], "low": None, "high": None, "turns": 0, "audit": [], "initial": None,
                       "sha": hashlib.sha256(), "said": False} | dict.fromkeys(counts, 0)
            for c in counts:
                now[c] += r[c]
            if now["initial"] is not None and now["initial"] + r["first_initial"] not in LEGAL_PAIRS:
                now["illegal"] += 1
            now["initial"] = r["last_initial"]
            if r["first_turn"] is not None:
                now["turns"] += r["turns_seen"] - (r["first_turn"] == now["high"])
                now["low"] = r["first_turn"] if now["low"] is None else now["low"]
                now["high"] = r["last_turn"]
            now["audit"].append(r["audit"])
            if r["roles"]:
                text = "\n".join(f"{role}:{said}" for role, said in zip(r["roles"], r["texts"]))
                now["sha"].update((("\n" if now["said"] else "") + text).encode())
                now["said"] = True
        if done:
            yield rows(done)
    if now is not None:
        yield rows([now])


def repair_report(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text",
                  segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    return report(repair_segments(conversations, conv_col, turn_col, role_col, text_col, segment_rows))


def damage(conversations: DataFrame) -> DataFrame:
    """Faults of all kinds for tests and the registered query, by a checksum of conversation
    and turn: rows dropped, emptied, without end marks, repeated, or said by the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.col("__kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("__text", "[.!?]", "")).otherwise(F.col("__text"))
    rows = conversations.select(
        "conv_id", "turn", text_of("role").alias("__role"), text_of("text").alias("__text"),
        F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20)).alias("__kind"))
    times = F.when(kind == 3, 2).otherwise(1)
    return (rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("__role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("__copy")).drop("__copy"))
