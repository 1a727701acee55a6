import hashlib

from transitrisk.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, example long, block long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 5, 6) for r in rows], SCHEMA)


ROWS = [
    (1, 0, "system", "</s>[INST] ok [/INST]"), (1, 1, "user", "a <|turn|> b"), (1, 2, "assistant", "\\<|end|>\\"),
    (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "tail\nline <"),
    (2, 0, "user", "no reply"), (3, 7, "assistant", "first |> \\\\ <<SYS>>"), (3, 7, "assistant", "first |> \\\\ <<SYS>>"),
    (3, None, None, "null turn é日😀"), (None, 0, "assistant", "null id"), (None, 1, "user", "x"),
]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda t: (t[0] is not None, t[0] or 0, t[1] or "", t[2] or ""))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    rows = ROWS + [(9, i, "assistant" if i % 3 else "user", f"turn {i} [INST]") for i in range(700)]
    got = chat.conversation_digest(chat.write_examples(conversations(spark, rows), block_turns=100), block_turns=64).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == brute(rows)


def test_examples_in_full(spark):
    turns = chat.format_turns(conversations(spark, ROWS), block_turns=2)
    full = {(r["conv_id"], r["example"]): r for r in chat.expand(turns).collect()}
    assert set(full) == {(1, 1), (1, 2), (3, 1), (3, 2), (None, 1)}
    r = full[1, 2]
    assert r["text"].startswith("<|turn|>system<|text|><\\/s>[\\INST] ok [\\/INST]<|end|>")
    assert r["text"].count("<|turn|>") == 5 and r["text"].endswith("<|turn|>assistant<|text|><|end|>")
    assert r["text"][r["loss_start"]:r["loss_end"]] == ""
    r = full[1, 1]
    assert r["text"][r["loss_start"]:r["loss_end"]] == "\\\\<\\|end|\\>\\\\"
    context = {(x["conv_id"], x["example"]): x["n_context_turns"] for x in turns.where("example is not null").collect()}
    assert context == {(1, 1): 2, (1, 2): 4, (3, 1): 1, (3, 2): 2, (None, 1): 0}


def test_escape_hides_controls(spark):
    text = "".join(chat.CONTROLS) + "<|><<|>>[[INST]]\\" + chat.TURN + chat.END
    df = spark.createDataFrame([(text,)], "t string").select(chat.escape("t").alias("e"))
    row = df.select("e", chat.unescape("e").alias("u")).first()
    assert row["u"] == text
    assert not any(c in row["e"] for c in chat.CONTROLS)


def test_empty(spark):
    assert chat.conversation_digest(chat.write_examples(conversations(spark, []))).count() == 0


def test_main_path_is_native(spark):
    plan = chat.conversation_digest(chat.format_turns(conversations(spark, ROWS)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_example_is_written(spark, monkeypatch):
    rows = ROWS + [(9, i, "assistant" if i % 3 else "user", f"turn {i} [INST]") for i in range(70)]
    written = {}
    stored = chat.stored
    monkeypatch.setattr(chat, "stored", lambda df, name, *a: written.setdefault(name, stored(df, name, *a)))
    back = chat.write_examples(conversations(spark, rows), example_turns=8, block_turns=16)
    turns = chat.format_turns(conversations(spark, rows))
    full = {(r["conv_id"], r["example"]): r for r in chat.expand(turns).collect()}
    got, spans = {}, {}
    for r in sorted((r for r in written["chat-examples"].collect() if r["example"] is not None), key=lambda r: r["block"]):
        key = r["conv_id"], r["example"]
        assert r["char_start"] == len(got.get(key, "")) and r["n_turns"] <= 8
        got[key] = got.get(key, "") + r["text"]
        if r["loss_start"] is not None:
            assert spans.setdefault(key, (r["loss_start"], r["loss_end"])) == (r["loss_start"], r["loss_end"])
    assert got == {k: r["text"] for k, r in full.items()} and (9, 46) in got
    assert spans == {k: (r["loss_start"], r["loss_end"]) for k, r in full.items()}
    assert sorted(map(str, back.collect())) == sorted(map(str, turns.select(back.columns).collect()))
