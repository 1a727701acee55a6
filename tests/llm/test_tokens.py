import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from transitrisk.llm import encoding, tokencounts, tokenfile

TEXTS = ["", "a  b", "a   b\n\n  c", " a\n", "\n \n a\n \n", "it's 'll  \n", "a\t\n b", "x  y", "<|endoftext|> a",
         "\x1c a!\x1c b", "日本 語\n\n\n 😀😀 b  ", "été. (foo). ñandú!! x's a.b,c ---.. 3.5,", "x" * 3000 + " y",
         "naïve café   z", "á. b", "ª. º, µ! ÿ; ×. ÷,"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(encoding.vocabulary_path())


def check(tokenizer, texts):
    ids, spans = (getattr(encoding.Encoder(encoding.vocabulary_path()), k)(texts) for k in ("ids", "spans"))
    for text, a, b in zip(texts, ids, spans):
        whole = tokenizer.encode(text, add_special_tokens=False)
        assert whole.ids == a.tolist(), repr(text)
        assert [list(o) for o in whole.offsets] == b.tolist(), repr(text)


def test_column_ids_equal_whole_texts(tokenizer):
    import pyarrow as pa
    rng = random.Random(8)
    parts = ["the", " The", "é", " ñandú", "\n", "\n\n", " ", "  ", "###", "'s", "3", "-", "日本", "\t", "\u2028", "\xa0", "×", "A\n", "\na", ".", "<|endoftext|>", "ß"]
    texts = [*TEXTS, None, *("".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(800))]
    encoder = encoding.Encoder(encoding.vocabulary_path())
    for size in (1, 7, len(texts)):
        for lo in range(0, len(texts), size):
            ids, starts = encoder.column_ids(pa.array(texts[lo:lo + size], pa.string()))
            want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts[lo:lo + size]]
            assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want


def test_pieces_equal_whole_texts(tokenizer):
    check(tokenizer, TEXTS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,'!abzAZéßñ09_-日😀 ́\x1c", max_size=30), max_size=4))
def test_pieces_equal_whole_texts_random(texts):
    from tokenizers import Tokenizer
    check(Tokenizer.from_file(encoding.vocabulary_path()), texts)


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(encoding, "MEMORY_PIECES", 3)
    check(tokenizer, TEXTS * 2)


def test_a_piece_is_remembered_when_met_again(tokenizer):
    import pyarrow as pa
    e = encoding.Encoder(encoding.vocabulary_path())
    for text, known in (("one two, 3x", set()), ("two one", set()), (" two 3x", {" 3x"})):
        ids, starts = e.column_ids(pa.array([text]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and not e.known_ids.learned
        assert set(e.known_ids) >= known
    assert "one" not in e.known_ids and not e.known_ids.older


def test_remembered_pieces_take_little_memory():
    import gc
    import tracemalloc

    import pyarrow as pa
    e, n = encoding.Encoder(encoding.vocabulary_path()), 40_000
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(100)) for i in range(n // 100)])
    e.column_ids(pa.array(["a b"]))
    gc.collect()
    tracemalloc.start()
    try:
        arrow = pa.total_allocated_bytes()
        want = e.column_ids(texts)[0].tolist()
        for _ in range(2):
            assert e.column_ids(texts)[0].tolist() == want
        del want
        gc.collect()
        used = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert len(list(e.known_ids)) >= n // 2 and used < 80 * n  # some 200 bytes a piece as Python objects


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("high", [1, 2, 50_257, 2 ** 32])
@pytest.mark.parametrize("percentile", [0, 50, 90, 100])
def test_blocks_round_trip(n, high, percentile):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, high, n).astype(np.uint32)
    ids[rng.random(n) < 0.05] = high - 1
    packed = tokenfile.pack_segment(ids, percentile=percentile)
    assert np.array_equal(tokenfile.unpack_segment(packed), ids)


def test_outliers_are_patched():
    ids = np.full(10_240, 7, np.uint32)
    ids[::256] = 50_000
    assert len(tokenfile.pack_segment(ids)) < len(ids)


def test_token_file(spark, docs, tokenizer):
    rng = random.Random(1)
    rows = [(i * 3, " ".join(rng.choice(TEXTS) for _ in range(4))) for i in rng.sample(range(500), 60)]
    rows += [(2, None), (None, "null id"), (4, "same"), (4, "same"), (5, "long " * 40_000)]
    got = tokenfile.read_tokens(tokenfile.write_tokens(docs(rows), segment_ids=500)).orderBy("start").collect()
    start, have = 0, {}
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    want = {}
    for i, t in rows:
        x = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append((len(x), zlib.crc32(x.tobytes())))
    assert have == want
    assert tokenfile.read_tokens(tokenfile.write_tokens(docs([]))).count() == 0


def brute_lines(tokenizer, text):
    """Character by character: the line of most of a token's characters, the earlier of equals."""
    line, lines = 0, []
    for c in text:
        lines.append(line)
        line += c == "\n"
    out = [0] * (line + 1)
    for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
        votes = lines[a:max(b, a + 1)]
        out[max(sorted(set(votes)), key=votes.count)] += 1
    return out


def test_attribution_against_brute_force(spark, docs, tokenizer):
    rows = list(enumerate([*TEXTS, None, "a\n\n\nb\n\n\n\nc", "one\ntwo\n"]))
    got = {}
    for r in tokencounts.attribute_tokens(docs(rows)).orderBy("id", "section").collect():
        got.setdefault(r["id"], []).append(int(r["n_tokens"]))
    assert got == {i: brute_lines(tokenizer, t or "") for i, t in rows}


def test_rules_fields_and_gaps():
    spans = np.array([[0, 4], [4, 8], [8, 12], [20, 22]])
    starts, ends = np.array([0, 5]), np.array([5, 12])
    assert [x.tolist() if hasattr(x, "tolist") else x for x in tokencounts.allocate(spans, starts, ends, "most")] == [[1, 2], [1, 1], 1]
    assert tokencounts.allocate(spans, starts, ends, "first")[0].tolist() == [2, 1]
    assert tokencounts.allocate(spans, starts, ends, "split")[0].tolist() == [1.25, 1.75]


def test_given_sections(spark):
    df = spark.sql("""SELECT 1L doc_id, 'alpha beta gamma' text, array(named_struct('name', 'b', 'start', 5, 'end', 10),
                      named_struct('name', 'a', 'start', 0, 'end', 5)) parts UNION ALL SELECT 2L, NULL, NULL""")
    got = tokencounts.attribute_tokens(df, sections_col="parts").orderBy("id", "section").collect()
    assert {r["name"] for r in got} == {"a", "b", None}
    total = sum(r["n_tokens"] for r in got)
    plain = sum(r["n_tokens"] for r in tokencounts.attribute_tokens(df).collect())
    assert total == plain
    with pytest.raises(ValueError):
        tokencounts.attribute_tokens(df, rule="other")
