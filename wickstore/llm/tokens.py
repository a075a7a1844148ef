"""Token ids of whole texts from a tokenizer file, with a bounded memory of words inside each worker."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from tokenizers import Tokenizer

from wickstore.llm.text import SLICE_BYTES, filled, raw, slices

# How the two vocabularies cut a text into pre-tokens.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|[\s]+(?![^\s])|[\s]+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that libraries disagree on as white space.
UNCLEAR = re.compile("[\x1c-\x1f\x85]").search

#: Pieces and words of text that a worker remembers, about 30 bytes each, before it starts afresh.
MEMORY = 3_000_000


class Memory:
    """Ids of strings seen before, by two hashes of the string, in flat arrays."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint32)
        self.begins = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def rows(self, names: list[str], make: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Row of each name (``begins`` and ``sizes`` of its ids); ``make`` gives ids and sizes of new names."""
        digest, check = xxhash.xxh3_64_intdigest, xxhash.xxh32_intdigest
        keys = np.fromiter(map(digest, names), np.uint64, len(names))
        checks = np.fromiter(map(check, names), np.uint32, len(names))
        rows = np.searchsorted(self.keys, keys)
        at = np.minimum(rows, max(len(self.keys) - 1, 0))
        known = (self.keys[at] == keys) if len(self.keys) else np.zeros(len(names), bool)
        clash = known.copy()
        clash[known] = self.checks[at[known]] != checks[known]
        new = np.flatnonzero(~known)
        if clash.any() or len(np.unique(keys[new])) < len(new):
            self.clear()
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two strings of one batch share a 64-bit hash")
            return self.rows(names, make)
        if not len(new):
            return rows
        if self.keys.size and self.keys.size + len(new) > MEMORY:
            self.clear()
            return self.rows(names, make)
        ids, sizes = make([names[n] for n in new])
        begins = len(self.ids) + np.cumsum(sizes) - sizes
        order = np.argsort(keys[new])
        places = rows[new][order]
        self.keys = np.insert(self.keys, places, keys[new][order])
        self.checks = np.insert(self.checks, places, checks[new][order])
        self.begins = np.insert(self.begins, places, begins[order])
        self.sizes = np.insert(self.sizes, places, sizes[order])
        self.ids = np.concatenate([self.ids, ids])
        return np.searchsorted(self.keys, keys)


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class TextEncoder:
    """Ids of texts, the same as the tokenizer gives for the whole text without special tokens.

    A text is cut before each space that follows anything but white space, where no pre-token of these
    vocabularies ever reaches across; each distinct piece is then encoded once and remembered. Pieces with
    characters beyond U+024F, and texts with a space after other white space, with a space at an end or
    with the start of a special token, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.lower = self.tokenizer.normalizer is not None
        pattern = WORD_PATTERN if self.lower else BYTE_PATTERN
        self.cut = regex.compile(pattern).findall
        for name, ascii_only in ((r"\p{L}", "A-Za-z"), (r"\p{N}", "0-9"), (r"\s", r"\t-\r\x20")):
            pattern = pattern.replace(name, ascii_only)
        self.cut_ascii = re.compile(pattern).findall
        self.table = str.maketrans({chr(b): c for b, c in _byte_characters().items()})
        self.words, self.spaced, self.heads = Memory(), Memory(), Memory()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        table, tokenize = self.table, self.tokenizer.model.tokenize
        ids = [
            [t.id for t in tokenize(w.encode().decode("latin-1").translate(table))] for w in words
        ]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def _piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut: list[list[str]] = []
        odd: list[int] = []
        for n, piece in enumerate(pieces):
            if piece.isascii() and not UNCLEAR(piece):
                cut.append(self.cut_ascii(piece.lower() if self.lower else piece))
            elif max(piece) > "ɏ" or UNCLEAR(piece):
                cut.append([])
                odd.append(n)
            else:
                cut.append(self.cut(self.tokenizer.normalizer.normalize_str(piece) if self.lower else piece))
        names = list(chain.from_iterable(cut))
        rows = self.words.rows(list(dict.fromkeys(names)), self._word_ids) if names else np.zeros(0, int)
        place = {n: i for i, n in enumerate(dict.fromkeys(names))}
        rows = rows[np.fromiter(map(place.__getitem__, names), np.int64, len(names))]
        ids, ends = _gathered(self.words, rows)
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])
        return _replaced(ids, ends[first], {n: self.whole(pieces[n]) for n in odd})

    def _head_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._piece_ids(pieces)

    def _spaced_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._piece_ids([" " + p for p in pieces])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids start (one more at the end)."""
        odd = _odd(texts)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        parts = pc.split_pattern(plain, " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        encoded = parts.flatten().dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        names = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = self.spaced.rows(names, self._spaced_ids)[codes] if names else np.zeros(0, int)
        # the first piece of a text has no space before it
        heads, where = np.unique(codes[first[:-1]], return_inverse=True)
        head_rows = self.heads.rows([names[h] for h in heads], self._head_ids) if len(heads) else heads
        begins, sizes = self.spaced.begins[rows], self.spaced.sizes[rows].astype(np.int64)
        begins[first[:-1]] = len(self.spaced.ids) + self.heads.begins[head_rows][where]
        sizes[first[:-1]] = self.heads.sizes[head_rows][where]
        ids = np.concatenate([self.spaced.ids, self.heads.ids])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])]
        whole = {int(d): self.whole(texts[int(d)].as_py()) for d in np.flatnonzero(odd)}
        flat, sizes = _replaced(flat, ends[first], whole)
        return flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _gathered(memory: Memory, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of several rows of a memory in a row, and where each ends, from 0."""
    sizes = memory.sizes[rows].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return memory.ids[np.repeat(memory.begins[rows] - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _replaced(ids: np.ndarray, starts: np.ndarray, other: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes of runs of ids, some of them given anew."""
    if not other:
        return ids, np.diff(starts)
    runs = [other[n] if n in other else ids[a:b] for n, (a, b) in enumerate(zip(starts[:-1], starts[1:]))]
    return np.concatenate(runs), np.fromiter(map(len, runs), np.int64, len(runs))


def _odd(texts: pa.StringArray) -> np.ndarray:
    """Texts with a space after white space or at an end, or with the start of a special token."""
    data, offsets = raw(texts)
    odd = np.zeros(len(texts), bool)
    if not len(data):
        return odd
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)])
    at = np.flatnonzero(data == 32)
    one, two, three = padded[at + 2], padded[at + 1], padded[at]
    wide = (one >= 0x80) & (
        ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
        | ((three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF)))
        | ((three == 0xE2) & (two == 0x81) & (one == 0x9F))
        | ((three == 0xE1) & (two == 0x9A) & (one == 0x80))
        | ((three == 0xE3) & (two == 0x80) & (one == 0x80))
    )
    marks = at[(one <= 32) | wide]
    special = np.flatnonzero((data == 60) & (padded[4:] == 124))
    full = np.flatnonzero(np.diff(offsets))
    ends = full[(data[offsets[full]] == 32) | (data[offsets[full + 1] - 1] == 32)]
    odd[np.searchsorted(offsets, np.concatenate([marks, special]), side="right") - 1] = True
    odd[ends] = True
    return odd


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def encode_batches(path: str, batches, column: str = "text", limit: int = SLICE_BYTES):
    """Each slice of rows, of about ``limit`` bytes of text, with its ids and their starts."""
    encode = encoder(path).encode
    for batch in batches:
        for part in slices(batch, column, limit):
            ids, starts = encode(filled(part.column(column)))
            yield part, ids, starts
