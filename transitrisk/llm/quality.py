"""Line-first cleaning: rules judge each line, failing lines go, and a document
that loses too much of its text is rejected.

Line rules (a line without words is kept as it is and never judged):
    navigation   at least 3 separators (| » › • ·), one for every 4 words or more
    punctuation  as many symbols as words, or as many exclamation marks, of 3 words or more;
                 or 10 words and more without any sentence mark of any script
                 (Thai and Lao set spaces for marks, so their lines pass)
    boilerplate  fixed phrases of page furniture, as whole words, that hold a third
                 of the line's words or more

Document rules: fewer than 20 words; over 30 % of the words in repeated 8-word
windows; less than half of the words left after cleaning.

Defined results: null texts have no words and are rejected; ties and repeated
rows are judged one by one; there is no shuffle and no state across rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitrisk.llm.common import SPACED_WORD, small_batches, utf8, word_bounds, word_hashes

MIN_WORDS = 20
WINDOW_WORDS = 8
MAX_REPEAT_PERCENT = 30
MIN_LEFT_PERCENT = 50

# The character sets and phrases of the line rules.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
SENTENCE_MARKS = ".!?:;…"
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
               "sign in", "log in", "subscribe to", "click here", "enable javascript", "lorem ipsum", "skip to content")

# Sentence marks of other scripts (Unicode Sentence_Terminal), full-width, Arabic,
# Ethiopic and Tibetan marks, and the letters of Thai and Lao.
OTHER_SENTENCE_MARKS = (
    r"\u037E\u0589\u061B\u061D-\u061F\u06D4\u0700-\u0702\u07F9\u0837\u0839\u083D\u083E\u0964\u0965\u0E01-\u0EFF"
    r"\u0F08\u0F0D-\u0F12\u104A\u104B\u1362-\u1368\u166E\u1735\u1736\u17D4\u17D5\u1803\u1809\u1944\u1945"
    r"\u1AA8-\u1AAB\u1B5A\u1B5B\u1B5E\u1B5F\u1B7D-\u1B7F\u1C3B\u1C3C\u1C7E\u1C7F\u2024\u203C\u203D\u2047-\u2049"
    r"\u2CF9-\u2CFB\u2E2E\u2E3C\u2E53\u2E54\u3002\uA4FF\uA60E\uA60F\uA6F3\uA6F7\uA876\uA877\uA8CE\uA8CF\uA92F"
    r"\uA9C8\uA9C9\uAA5D-\uAA5F\uAAF0\uAAF1\uABEB\uFE12\uFE13-\uFE16\uFE19\uFE52\uFE54-\uFE57\uFF01\uFF0E\uFF1A"
    r"\uFF1B\uFF1F\uFF61\U00010A56\U00010A57\U00010F55-\U00010F59\U00010F86-\U00010F89\U00011047\U00011048"
    r"\U000110BE-\U000110C1\U00011141-\U00011143\U000111C5\U000111C6\U000111CD\U000111DE\U000111DF"
    r"\U00011238\U00011239\U0001123B\U0001123C\U000112A9\U0001144B\U0001144C\U000115C2\U000115C3"
    r"\U000115C9-\U000115D7\U00011641\U00011642\U0001173C-\U0001173E\U00011944\U00011946\U00011A42\U00011A43"
    r"\U00011A9B\U00011A9C\U00011C41\U00011C42\U00011EF7\U00011EF8\U00011F43\U00011F44\U00016A6E\U00016A6F"
    r"\U00016AF5\U00016B37\U00016B38\U00016B44\U00016E98\U0001BC9F\U0001DA88")
#: Boilerplate phrases fail a line when one word in so many, or more, is theirs.
LINE_WORDS_A_PHRASE_WORD = 3

_BOILERPLATE = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, BOILERPLATE)) + r")(?!\w)")
_SENTENCE_MARK = re.compile(f"[{re.escape(SENTENCE_MARKS)}{OTHER_SENTENCE_MARKS}]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def line_fails(line: str) -> str | None:
    """The rule a line fails, or None."""
    n = len(_WORDS.findall(line))
    if n == 0:
        return None
    separators = sum(map(line.count, SEPARATORS))
    if separators >= 3 and 4 * separators >= n:
        return "navigation"
    if n >= 3 and (sum(map(line.count, SYMBOLS)) >= n or line.count("!") >= n):
        return "punctuation"
    if n >= 10 and not _SENTENCE_MARK.search(line):
        return "punctuation"
    phrases = _BOILERPLATE.findall(line.translate(_ASCII_LOWER))
    if phrases and LINE_WORDS_A_PHRASE_WORD * sum(len(p.split(" ")) for p in phrases) >= n:
        return "boilerplate"
    return None


def clean(text: str) -> tuple[str, int, int]:
    """The text without failing lines, the number of them, and the words left."""
    lines = text.split("\n")
    kept = [line for line in lines if line_fails(line) is None]
    left = sum(len(_WORDS.findall(line)) for line in kept) if len(kept) < len(lines) else -1
    return "\n".join(kept), len(lines) - len(kept), left


def repeated_words(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW_WORDS) -> np.ndarray:
    """Per row the words that lie in a window of words found twice or more in the row."""
    n = np.diff(first)
    out = np.zeros(len(n), np.int64)
    step = np.uint64(0x9E3779B97F4A7C15)
    for i in np.flatnonzero(n > window):
        h = hashes[first[i]:first[i + 1]]
        windows = np.zeros(len(h) - window + 1, np.uint64)
        for k in range(window):
            windows = windows * step + h[k:len(h) - window + 1 + k]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            twice = np.zeros(len(windows), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            mark = np.zeros(len(h) + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(mark, at, 1)
            np.add.at(mark, at + window, -1)
            out[i] = int((np.cumsum(mark) > 0).sum())
    return out


MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "n_bad_lines long, n_words_left long, clean_text string, base_failed boolean, kept boolean")


def clean_documents(docs: DataFrame, text_col="text", keep: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """(*keep, measures of each document, its cleaned text, and the verdict ``kept``)."""
    names = [m.split()[0] for m in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches, "__text", 2 << 20):
            data, offsets = utf8(part["__text"])
            starts, ends, first = word_bounds(data, offsets, SPACED_WORD)
            n = np.diff(first)
            lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points up to a byte
            inside = lead[ends] - lead[starts]
            chars = np.concatenate([[0], np.cumsum(inside)])
            symbol = np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8))
            symbols = np.concatenate([[0], np.cumsum(symbol)])
            repeats = repeated_words(word_hashes(data, starts, ends), first)
            texts = [t or "" for t in part["__text"].to_pylist()]
            dups, bad, left, cleaned = [], [], [], []
            for text, words in zip(texts, n.tolist()):
                lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
                dups.append(len(lines) - len(set(lines)))
                kept_text, n_bad, n_left = clean(text)
                bad.append(n_bad)
                left.append(words if n_left < 0 else n_left)
                cleaned.append(kept_text if with_text else None)
            left_words = np.array(left, np.int64)
            failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
            kept = ~failed & (100 * left_words >= MIN_LEFT_PERCENT * n)
            values = [n, chars[first[1:]] - chars[first[:-1]], symbols[offsets[1:]] - symbols[offsets[:-1]],
                      np.array(dups, np.int64), repeats, np.array(bad, np.int64), left_words,
                      pa.array(cleaned, pa.string()), failed, kept]
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in keep), *(v if isinstance(v, pa.Array) else pa.array(v) for v in values)],
                [*keep, *names])

    src = docs.select(*keep, F.col(text_col).alias("__text"))
    kept_schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema if f.name != "__text")
    return src.mapInArrow(run, kept_schema + MEASURES)
