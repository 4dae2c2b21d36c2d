"""Exact token ids of whole texts with a public tokenizer file, with each distinct word encoded once a worker.

The tokenizer cuts texts at white space before anything else, so a text's ids are those of its
white-space-separated chunks one after another.  Arrow splits a batch of texts, numbers the distinct
chunks, cuts punctuation off after letters and numbers the distinct pieces.  A worker keeps the ids
of pieces that it has met, up to ``CACHE`` of them, in arrays; of new ones, all that are letters are
encoded in one call, a line each, and the others one by one.
"""

from __future__ import annotations

import gc
import itertools
import os
import sys
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids one worker remembers, unless a single batch has more; the memory starts anew when it is full.
CACHE = 1_000_000
#: Characters of texts whose words are held at a time, but for a longer single text.
BATCH_CHARS = 8 << 20
#: Ends of chunks that the tokenizer's own splitting always parts from a preceding letter.
TAIL = ".,!?:;$%#*&|"
#: Texts that are not lower-cased beforehand: marks that combine with small letters only, special tokens.
AS_GIVEN = "[\u0300-\u036f]|<\\|"

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Ids of texts by a word-level BPE file whose last piece of a word ends in ``</w>``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model for lines of small ASCII letters, which need no normalizing.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.letter = _letter()
        self._forget()
        gc.freeze()

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text, without special tokens; None is the empty text."""
        return [ids for batch in _batches(texts) for ids in self._batch(batch)]

    def _batch(self, texts: list[str | None]) -> list[np.ndarray]:
        given = pa.array(texts, pa.large_string())
        given = pc.if_else(pc.match_substring_regex(given, AS_GIVEN), given, pc.ascii_lower(given))
        lists = pc.ascii_split_whitespace(given)
        chunks = lists.flatten().dictionary_encode()
        distinct = chunks.dictionary
        head = pc.utf8_rtrim(distinct, TAIL)
        head = pc.if_else(pc.match_substring_regex(head, f"{self.letter}$"), head, distinct)
        tail = _after(distinct, head)
        pieces = pa.concat_arrays([head, tail]).dictionary_encode()
        place = self._places(pieces.dictionary)
        # a chunk is its head and then its tail, which may be empty
        order = place[pieces.indices.to_numpy().reshape(2, -1).T.ravel()]
        ids, ends = _runs(self.ids, self.sizes, order)
        ids, ends = _runs(ids, np.diff(ends[::2]), chunks.indices.to_numpy())
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return np.split(ids, ends[np.cumsum(counts)])[:-1]

    def _forget(self) -> None:
        self.known, self.ids, self.sizes = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where among the known pieces each of the distinct pieces is, after learning new ones."""
        at = pc.index_in(pieces, value_set=self.known)
        if at.null_count and len(self.known) + at.null_count > CACHE:
            self._forget()
            at = pc.index_in(pieces, value_set=self.known)
        place = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            before = len(self.known)
            place[missing] = before + self._learn(pieces.take(pa.array(missing)))
        return place

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Append distinct pieces to the known ones, kind by kind; returns each one's place behind those known before."""
        small = pc.match_substring_regex(pieces, "^[a-z]+$").to_numpy(zero_copy_only=False).astype(bool)
        letters = pc.match_substring_regex(pieces, f"^{self.letter}+$").to_numpy(zero_copy_only=False).astype(bool) & ~small
        order, kinds = [], ((self._lines, self.letters, small), (self._lines, self.tokenizer, letters), (self._each, self.tokenizer, ~(small | letters)))
        for how, tokenizer, own in kinds:
            order.append(np.flatnonzero(own))
            named = pieces.take(pa.array(order[-1]))
            ids, sizes = how(tokenizer, named.to_numpy(zero_copy_only=False).tolist())
            self.known = pa.concat_arrays([self.known, named])
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        place = np.empty(len(pieces), np.int64)
        place[np.concatenate(order)] = np.arange(len(pieces))
        return place

    def _lines(self, tokenizer, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, encoded together, and how many each has; each ends at the id that closes a word."""
        if not pieces:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        ids = np.array(tokenizer.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(pieces) or stops[-1] != len(ids):
            return self._each(self.tokenizer, pieces)
        return ids, np.diff(stops, prepend=0)

    def _each(self, tokenizer, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any pieces, and how many each has."""
        done = [x.ids for x in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(done), "<u4"), np.fromiter(map(len, done), np.int64, len(done))


def _letter() -> str:
    """Pattern of a letter that normalizing keeps one letter; of the others some become a letter and a mark."""
    changed = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if not unicodedata.is_normalized("NFC", c) or len(c.lower()) > 1]
    return "[^\\P{L}" + "".join(c for c in changed if c.isalpha()) + "]"


def _runs(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs that ``order`` names, of ``ids`` cut into runs of ``sizes``, and the bounds of the runs made."""
    ends = np.concatenate([[0], np.cumsum(sizes[order])])
    return ids[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[order] - ends[:-1], sizes[order])], ends


def _after(whole: pa.Array, head: pa.Array) -> pa.Array:
    """What follows each ``head`` in its chunk, which it begins."""
    data = np.frombuffer(whole.buffers()[2], np.uint8) if whole.buffers()[2] else np.zeros(0, np.uint8)
    bounds = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + len(whole) + 1]
    sizes = np.diff(bounds) - pc.binary_length(head).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    own = data[np.arange(ends[-1]) + np.repeat(bounds[1:] - sizes - ends[:-1], sizes)]
    return pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(own))


def _batches(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
