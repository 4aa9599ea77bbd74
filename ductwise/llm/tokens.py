"""Byte-level BPE over Arrow batches of texts: every distinct unit of a batch is encoded once.

A *unit* is a stretch of text that the tokenizer's pattern can never match across: it ends before
a single space or newline that stands between two other characters.  Encoding units apart
therefore gives the ids of the whole text, and units seen before come from a bounded cache.
Texts with runs of white space are cut more carefully (``units``).
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct units that a worker keeps before it starts its cache anew.
CACHE_UNITS = 700_000
#: Pattern matches kept apart from their units (punctuation, numbers).
CACHE_MATCHES = 50_000
#: Fixed value: the one pattern that the cutting into units holds for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_RUNS = _SPACE + _SPACE + r"|\x00"
#: Full stops and commas that may belong to a longer match; where none are, each is a unit of its own.
_STOPS = r"(?:^|[^\p{L}\p{N}])[,.]|[,.][^ \n]"
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")


def units(text: str) -> list[str]:
    """Cut ``text`` before each single space or newline between two non-space characters."""
    return _SAFE.split(text)


def byte_table() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible Latin-1, else one from U+0100 on."""
    table, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            table.append(chr(b))
        else:
            table.append(chr(spare))
            spare += 1
    return table


_TO_CHARS = dict(enumerate(byte_table()))
_BLANK = _TO_CHARS[32]


class BatchEncoder:
    """ids of whole texts by a ``tokenizers`` file (or an own Tokenizer) of the byte-level kind; empty for null.

    ``pattern`` is the pre-tokenizer's pattern: its matches are given to the library's BPE model
    one by one, each once as long as the cache holds it.
    """

    def __init__(self, tokenizer, pattern: str, cache_units: int = CACHE_UNITS):
        import regex

        if pattern != PATTERN:
            raise ValueError("texts are cut into units that only this pattern never matches across: " + PATTERN)
        if isinstance(tokenizer, str):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer)
        self.model = tokenizer.model
        self.matches = regex.compile(pattern).findall
        self.cache_units = cache_units
        self._reset()

    def _reset(self):
        self.index: dict[str, int] = {}  # unit -> row; units without a leading space are marked by \0
        self.words: dict[str, list[int]] = {}
        self.pool = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _word(self, word: str) -> list[int]:
        chars = word.replace(" ", _BLANK) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_TO_CHARS)
        return [t.id for t in self.model.tokenize(chars)]

    def _known(self, keys: list[str]) -> np.ndarray:
        """The row of each unit; new ones are encoded."""
        rows = np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))
        fresh: list[int] = []
        sizes: list[int] = []
        words, index = self.words, self.index
        for i in np.flatnonzero(rows < 0).tolist():
            key = keys[i]
            if key in index:
                rows[i] = index[key]
                continue
            rows[i] = index[key] = len(index)
            before = len(fresh)
            if key.isalpha():
                fresh += self._word(" " + key)
            else:
                for word in self.matches(key[1:] if key[:1] == "\0" else key if key == "\n" else " " + key):
                    if word not in words:
                        words[word] = self._word(word)
                    fresh += words[word]
            sizes.append(len(fresh) - before)
        if sizes:
            new = np.array(sizes, np.int64)
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(new) - new])
            self.size = np.concatenate([self.size, new])
            self.pool = np.concatenate([self.pool, np.array(fresh, np.int32)])
        return rows

    def rows(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(row of each unit, number of units of each text) of an Arrow array of strings."""
        if len(self.index) > self.cache_units:
            self._reset()
        if len(self.words) > CACHE_MATCHES:
            self.words.clear()
        texts = pc.fill_null(texts, "")
        runs = pc.match_substring_regex(texts, _RUNS)
        odd = np.flatnonzero(runs.to_numpy(zero_copy_only=False))
        plain = pc.if_else(runs, "", texts) if len(odd) else texts
        stops = pc.replace_substring(pc.replace_substring(plain, ",", " \0,"), ".", " \0.")
        plain = pc.if_else(pc.match_substring_regex(plain, _STOPS), plain, stops)
        marked = pc.replace_substring(pc.binary_join_element_wise("\0", plain, ""), "\n", " \n \0")
        split = pc.split_pattern(marked, " ")
        pieces = split.flatten().dictionary_encode()
        found = self._known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())[pieces.indices.to_numpy()]
        counts = np.array(pc.list_value_length(split), np.int64)
        if len(odd):
            own = [["\0" + u for u in units(texts[i].as_py())] for i in odd.tolist()]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            at = (np.cumsum(counts) - counts)[odd]
            found = np.insert(found, np.repeat(at, sizes), self._known([u for x in own for u in x]))
            counts[odd] += sizes
        return found, counts

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, number of ids of each text)."""
        if not isinstance(texts, (pa.Array, pa.ChunkedArray)):
            texts = pa.array(texts, pa.string())
        found, counts = self.rows(texts)
        sizes = self.size[found]
        ids = spread(self.pool, self.start[found], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(ends)


def spread(pool: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[start[0]:start[0]+sizes[0]], pool[start[1]:...], ... as one array."""
    total = int(sizes.sum())
    if not total:
        return pool[:0]
    shift = start - (np.cumsum(sizes) - sizes)
    return pool[np.repeat(shift, sizes) + np.arange(total)]


_encoders: dict[str, BatchEncoder] = {}


def encoder(path: str, pattern: str) -> BatchEncoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path, pattern)
    return _encoders[path]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to the ids of each text."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
