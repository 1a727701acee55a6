"""Encoding whole texts with a public tokenizer of the `tokenizers` library.

Byte-level BPE never merges across a word's leading space nor from a letter
into punctuation, so a text is cut there and every distinct piece is encoded
once per task by the library. The ids equal those of the whole text; texts for
which the cut could differ (other white space, special-token strings) are
encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from transitrisk.llm.common import utf8, word_hashes

VOCABULARY = "byte_bpe_50k.json"
#: Pieces a worker remembers in each of two generations: when the younger is full it
#: becomes the older, and what is not used again goes (results do not change).
MEMORY_PIECES = 400_000
#: A piece is remembered when it is asked for again: most pieces of a long table are met once.
#: Bits that mark the pieces asked for, and how many are marked before all are cleared.
SEEN_BITS = 1 << 23
MOST_SEEN = 1 << 20
LONGEST_PIECE = 64

_PIECES = re.compile(r"[ \n]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,!?;: \n]|\Z)|[ \n]*[^ \n]+|[ \n]+\Z")
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
_SPACED_WORD = re.compile(r" [A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
_BARE_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _byte_letters() -> dict[int, str]:
    """The visible character that byte-level BPE writes for each byte."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


@lru_cache(maxsize=2)
def _load(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def encoder(path: str) -> "Encoder":
    """One encoder per worker process: tasks that follow each other share its memory."""
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def piece_cuts(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bytes at which the pieces of consecutive texts begin, and last the end. A piece is a run
    without blanks, with those before it; leading letters are cut from an ASCII byte behind
    them and from a single line feed before them. Texts marked ``whole`` are not cut inside."""
    if len(data) == 0:
        return np.zeros(1, np.int64)
    blank = _BLANK[data]
    text_start = np.zeros(len(data) + 1, bool)
    text_start[offsets] = True
    edge = text_start.copy()
    edge[1:-1] |= blank[1:] != blank[:-1]
    edges = np.flatnonzero(edge)
    runs = np.flatnonzero(~blank[edges[:-1]])
    begins, ends = edges[runs], edges[runs + 1]
    letter = _LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    lead = lead[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
    letter[lead] = letter[lead + 1] = True
    others = np.flatnonzero(~letter)
    before = np.cumsum(~letter, dtype=np.int32)  # at a letter: the others in front of it
    after = np.append(others, len(data))[before[begins] - ~letter[begins]]
    after = np.minimum(after, ends)  # first byte behind a run's leading letters
    split = (after > begins) & (after < ends)
    split[split] = data[after[split]] < 0x80  # no ASCII byte behind letters continues them
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    cut[after[split]] = True
    # a single line feed before a letter is a token of its own
    lines = begins[letter[begins] & (begins > 0) & ~text_start[begins]]
    lines = lines[data[lines - 1] == 0x0A]
    cut[lines[text_start[lines - 1] | ~blank[lines - 2]]] = True
    for i in np.flatnonzero(whole):
        cut[offsets[i] + 1:offsets[i + 1]] = False
    cut[offsets] = True
    return np.flatnonzero(cut)


_BLANK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x0A]] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _other_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text whether it holds a character of ``_OTHER_SPACE``."""
    single = np.zeros(256, bool)
    single[[0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20)]] = True
    found = [np.flatnonzero(single[data])]
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    padded = np.append(data, np.zeros(2, np.uint8))
    a, b, c = data[at], padded[at + 1], padded[at + 2]
    odd = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
           | (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (a == 0xE2) & (b == 0x81) & (c == 0x9F))
    found.append(at[odd])
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.concatenate(found), "right") - 1] = True
    return out


def _gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` (of ``sizes``, one after the other) that ``which`` names, joined."""
    first = np.cumsum(sizes, dtype=np.int64) - sizes
    n = sizes[which]
    end = np.cumsum(n, dtype=np.int64)
    return flat[np.repeat(first[which] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]


class _Memory(dict):
    """Encodings of pieces; an unknown one is encoded when it is asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}
        self.seen, self.n_seen = bytearray(SEEN_BITS // 8), 0

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is not None:
            self.keep(piece, found)
            return found
        found = self.encode(piece)
        if len(piece) <= LONGEST_PIECE and self.again(piece):
            self.keep(piece, found)
        return found

    def again(self, piece: str) -> bool:
        """Whether the piece was asked for before, as far as the marks tell."""
        at, bit = divmod(hash(piece) % SEEN_BITS, 8)
        if self.seen[at] >> bit & 1:
            return True
        if self.n_seen >= MOST_SEEN:
            self.seen, self.n_seen = bytearray(SEEN_BITS // 8), 0
        self.seen[at] |= 1 << bit
        self.n_seen += 1
        return False

    def keep(self, piece: str, found: bytes) -> None:
        if len(self) >= MEMORY_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = found


class _Pieces:
    """Pieces and their ids in a few long arrays: some 35 bytes a piece, where a string and
    a bytes object in a dictionary take 200 and lie scattered over the worker's memory."""

    def __init__(self, texts: pa.Array | None = None, ids=None, sizes=None):
        self.texts = pa.array([], pa.large_string()) if texts is None else texts
        self.ids = np.zeros(0, np.uint32) if ids is None else ids
        self.sizes = np.zeros(0, np.int32) if sizes is None else sizes

    def __len__(self) -> int:
        return len(self.texts)

    def __iter__(self) -> Iterator[str]:
        return iter(self.texts.to_pylist())

    def find(self, texts: pa.Array) -> np.ndarray:
        """The place of each text, -1 for an unknown one."""
        return pc.fill_null(pc.index_in(texts, value_set=self.texts), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def joined(self, other: "_Pieces") -> "_Pieces":
        return _Pieces(pa.concat_arrays([self.texts, other.texts]), np.concatenate([self.ids, other.ids]),
                       np.concatenate([self.sizes, other.sizes]))

    def taken(self, which: np.ndarray) -> "_Pieces":
        return _Pieces(self.texts.take(pa.array(which)), _gathered(self.ids, self.sizes, which), self.sizes[which])


class _KnownPieces:
    """The pieces a worker remembers, in two generations. ``learned`` holds those encoded for
    the batch at hand."""

    def __init__(self):
        self.young, self.older, self.learned = _Pieces(), _Pieces(), {}
        self.seen, self.n_seen = np.zeros(SEEN_BITS, bool), 0

    def __iter__(self) -> Iterator[str]:
        return iter(self.young)

    def find(self, texts: pa.Array) -> np.ndarray:
        """The place of each text, counted through the younger, then the older; -1 for an unknown one."""
        at = self.young.find(texts)
        rest = np.flatnonzero(at < 0)
        old = self.older.find(texts.take(pa.array(rest)))
        at[rest] = np.where(old < 0, -1, old + len(self.young))
        return at

    def again(self, texts: pa.Array) -> np.ndarray:
        """Whether each text was asked for before, as far as the marks tell."""
        data, offsets = utf8(texts)
        at = np.zeros(len(texts), np.int64)
        filled = np.flatnonzero(np.diff(offsets))
        at[filled] = (word_hashes(data, offsets[filled], offsets[filled + 1]) % np.uint64(SEEN_BITS)).astype(np.int64)
        found = self.seen[at]
        if self.n_seen >= MOST_SEEN:
            self.seen[:], self.n_seen = False, 0
        self.seen[at] = True
        self.n_seen += int((~found).sum())
        return found

    def keep(self, more: _Pieces) -> None:
        if len(self.young) + len(more) > MEMORY_PIECES:
            self.young, self.older = _Pieces(), self.young
        self.young = self.young.joined(more.taken(np.arange(MEMORY_PIECES)) if len(more) > MEMORY_PIECES else more)


class Encoder:
    """Encodes texts; a piece of text is given to the library once."""

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known_ids, self.known_spans = _KnownPieces(), _Memory(self._spans_of)

    def column_ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a column's texts, one after the other, and where each text's begin (and
        last the end). Pieces are dictionary-encoded, so a batch asks for each only once."""
        column = column.cast(pa.large_string())
        data, offsets = utf8(column)
        whole = _other_space(data, offsets)
        for special in self.special:
            whole |= pc.fill_null(pc.match_substring(column, special), False).to_numpy(zero_copy_only=False)
        cuts = piece_cuts(data, offsets, whole)
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        known, distinct = self.known_ids, pieces.dictionary
        at = known.find(distinct)
        old = np.flatnonzero(at >= len(known.young))
        new = np.flatnonzero(at < 0)
        at[new] = len(known.young) + len(known.older) + np.arange(len(new))
        found = self._encoded(distinct.take(pa.array(new)))
        every = known.young.joined(known.older).joined(found)
        which = at[pieces.indices.to_numpy()]
        ids = _gathered(every.ids, every.sizes, which)
        before = np.concatenate([[0], np.cumsum(every.sizes[which], dtype=np.int64)])
        short = np.flatnonzero(pc.utf8_length(found.texts).to_numpy() <= LONGEST_PIECE)
        met = short[known.again(found.texts.take(pa.array(short)))]
        known.keep(every.taken(np.concatenate([at[old], at[new[met]]])))
        pa.default_memory_pool().release_unused()  # else each worker holds on to what its largest batch took
        return ids, before[np.searchsorted(cuts, offsets)]

    def _encoded(self, texts: pa.Array) -> _Pieces:
        """Pieces met for the first time or forgotten, with their ids."""
        pieces = texts.to_pylist()
        self._learn(pieces)
        learned = self.known_ids.learned
        found = [learned[p] if p in learned else self._ids_of(p) for p in pieces]
        learned.clear()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return _Pieces(texts, np.frombuffer(b"".join(found), np.uint32), sizes.astype(np.int32))

    def _learn(self, pieces: list[str]) -> None:
        """Encodes the unknown words of a batch a thousand at a time: a word with its space is
        a pre-token of its own, and so are a bare word and the line feed set before it here."""
        learned = self.known_ids.learned
        new = [p for p in pieces if len(p) <= LONGEST_PIECE]
        for pattern, between in ((_SPACED_WORD, ""), (_BARE_WORD, "\n")):
            words = list(filter(pattern.match, new))
            for i in range(0, len(words), 1000):
                some = words[i:i + 1000]
                found = self.tokenizer.encode(between + between.join(some), add_special_tokens=False)
                word = np.array(found.word_ids)
                first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                ends = np.append(first[1:], len(word))
                step = 2 if between else 1
                if len(first) != step * len(some):
                    continue  # each is encoded alone when it is asked for
                ids = np.array(found.ids, np.uint32).tobytes()
                for piece, lo, hi in zip(some, (4 * first[step - 1::step]).tolist(), (4 * ends[step - 1::step]).tolist()):
                    learned[piece] = ids[lo:hi]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of every text."""
        ids, starts = self.column_ids(pa.array(texts, pa.large_string()))
        return [ids[a:b] for a, b in zip(starts, starts[1:])]

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """(n, 2) character offsets of every text's tokens, in order."""
        out = []
        for text in texts:
            pieces = self._pieces(text)
            got = list(map(self.known_spans.__getitem__, pieces))
            flat = np.frombuffer(b"".join(got), np.int32).reshape(-1, 2).astype(np.int64)
            at = np.cumsum([0, *map(len, pieces[:-1])])
            out.append(flat + np.repeat(at, [len(g) // 8 for g in got])[:, None] if got else flat)
        return out

    def _ids_of(self, piece: str) -> bytes:
        if not _WORD.match(piece):
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        # a plain word is one pre-token: the library's model takes it directly
        if piece.isascii():
            letters = _BYTE_LETTERS[0x20] + piece[1:] if piece[0] == " " else piece
        else:
            letters = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _spans_of(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).offsets, np.int32).tobytes()

    def _pieces(self, text: str) -> list[str]:
        if _OTHER_SPACE.search(text) or any(s in text for s in self.special):
            return [text]
        return _PIECES.findall(text)
