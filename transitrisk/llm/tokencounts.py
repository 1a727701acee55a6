"""Token counts by offset-mapped attribution.

A document is encoded once, whole. Its tokens' character spans are then joined
as intervals to the spans of its sections (or fields). A token inside one
section counts there; a token over a boundary is allocated by ``rule``:

    "most"   to the section that holds most of its characters, the earlier of equals
    "first"  to the section in which it begins
    "split"  to every section it touches, in proportion to its characters there

Defined results: a null or empty text has one empty section without tokens;
tokens outside all given sections are returned under a null section; equal
documents are counted separately.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitrisk.llm.common import small_batches
from transitrisk.llm.encoding import encoder, vocabulary_path

RULES = ("most", "first", "split")


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines, each with its line feed."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    starts = np.array([0, *ends], np.int64)
    return starts, np.array([*ends, len(text)], np.int64)


def allocate(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "most"):
    """Tokens per section, tokens that touch more than one section per
    section, and tokens outside. Sections are ordered and do not overlap."""
    n = len(starts)
    total, crossing = np.zeros(n), np.zeros(n, np.int64)
    if len(spans) == 0 or n == 0:
        return total, crossing, len(spans)
    a, b = spans[:, 0], np.maximum(spans[:, 1], spans[:, 0] + 1)
    first = np.searchsorted(ends, a, "right")        # first section that ends after the token's begin
    last = np.searchsorted(starts, b, "left") - 1    # last section that begins before its end
    one = first == last
    np.add.at(total, first[one], 1)
    outside = int((first > last).sum())
    for i in np.flatnonzero(first < last):
        touched = np.arange(first[i], last[i] + 1)
        part = np.minimum(ends[touched], b[i]) - np.maximum(starts[touched], a[i])
        touched, part = touched[part > 0], part[part > 0]
        if not len(touched):
            outside += 1
            continue
        if len(touched) > 1:
            crossing[touched] += 1
        if rule == "split":
            total[touched] += part / part.sum()
        else:
            total[touched[0] if rule == "first" else touched[np.argmax(part)]] += 1
    return total, crossing, outside


def attribute_tokens(docs: DataFrame, id_col="doc_id", text_col="text", sections_col: str | None = None,
                     rule: str = "most", vocabulary: str | None = None) -> DataFrame:
    """One row per document and section: (row, id, section, name, char_start, char_end,
    n_tokens, n_crossing). ``sections_col``: array<struct<name,start,end>>;
    by default the lines of the text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = encoder(path).spans
        for part in small_batches(batches, "__text", 1 << 21):
            texts = [t or "" for t in part["__text"].to_pylist()]
            given = part["__sections"].to_pylist() if sections_col else [None] * len(texts)
            rows, cols = [], [[] for _ in range(6)]
            for i, (text, spans, sections) in enumerate(zip(texts, spans_of(texts), given)):
                if sections_col:
                    sections = sorted((s for s in sections or [] if s), key=lambda s: s["start"])
                    starts = np.array([s["start"] for s in sections], np.int64)
                    ends = np.array([s["end"] for s in sections], np.int64)
                    labels = [s["name"] for s in sections]
                else:
                    starts, ends = line_sections(text)
                    labels = [None] * len(starts)
                total, crossing, outside = allocate(spans, starts, ends, rule)
                out = [list(range(len(starts))), labels, starts.tolist(), ends.tolist(), total.tolist(), crossing.tolist()]
                if outside:
                    for c, v in zip(out, (None, None, None, None, float(outside), 0)):
                        c.append(v)
                rows.extend([i] * len(out[0]))
                for c, v in zip(cols, out):
                    c.extend(v)
            take = pa.array(rows, pa.int64())
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part["row"].take(take), part["id"].take(take), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["row", "id", "section", "name", "char_start", "char_end", "n_tokens", "n_crossing"])

    more = [F.col(sections_col).alias("__sections")] if sections_col else []
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                      F.col(text_col).alias("__text"), *more)
    return src.mapInArrow(run, f"row long, id {src.schema['id'].dataType.simpleString()}, section long, name string, "
                               "char_start long, char_end long, n_tokens double, n_crossing long")
