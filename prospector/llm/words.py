"""Words of a batch of texts as numpy arrays: boundaries and 64-bit hashes, without a Python loop over words.

Works on the UTF-8 bytes of an Arrow column. A word is a longest run of word bytes inside one text; the word classes
below hold ASCII characters and treat every byte from 0x80 alike, so runs of bytes are runs of characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Word classes, as tables of 256 numbers: 0 is between words, and another number begins another word.
NOT_SPACE = bytes(0 if b == 0x20 or 0x09 <= b <= 0x0D else 1 for b in range(256))
#: Words (1) and runs of punctuation (2).
WORD_OR_MARK = bytes(0 if b == 0x20 or 0x09 <= b <= 0x0D else 1 if b >= 0x80 or chr(b).isalnum() else 2 for b in range(256))
ALNUM = bytes(1 if b >= 0x80 or chr(b).isalnum() and not chr(b).isupper() else 0 for b in range(256))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_K1, _K2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWERS = np.ones(1, np.uint64)
#: Bytes hashed at once.
HASH_BYTES = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    s = np.uint64(33)
    h = (h ^ (h >> s)) * _K1
    h = (h ^ (h >> s)) * _K2
    return h ^ (h >> s)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 64), _BASE)
        steps[0] = 1
        _POWERS = np.cumprod(steps)
    return _POWERS


def _sums(letters: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The polynomial of each word's bytes, the words standing one after another in letters."""
    at = np.zeros(len(length), np.int32)
    np.cumsum(length[:-1], out=at[1:])
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(at, length)
    return np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[place], at)


def _hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, a block of about HASH_BYTES at a time: what is as long as the text is one byte a byte."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, "right")))
        length = (ends[i:j] - starts[i:j]).astype(np.int32)
        if j == i + 1 and length[0] > HASH_BYTES:  # a long word, by parts
            total, power = np.uint64(0), np.ones(1, np.uint64)
            for a in range(int(starts[i]), int(ends[i]), HASH_BYTES):
                part = data[a : min(a + HASH_BYTES, int(ends[i]))]
                total = total + power * _sums(part, np.array([len(part)], np.int32))
                power = power * _powers(HASH_BYTES)[-1:] * _BASE
            out[i] = total[0]
        else:
            span = slice(starts[i], ends[j - 1])
            out[i:j] = _sums(data[span][inside[span]], length)
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _K2)


@dataclass
class Words:
    """starts, ends: byte positions in `data`; first[i]:first[i + 1] are the words of text i; offset: where each text begins."""

    data: bytes
    offset: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: pa.StringArray, kind: bytes = NOT_SPACE, lower: bool = True, hashed: bool = True) -> Words:
    offset = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = raw.slice(offset[0], offset[-1] - offset[0]).to_pybytes() if raw is not None else b""
    offset -= offset[0]
    if lower:
        data = data.translate(LOWER)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offset, none, none, np.zeros(len(offset), np.int64), none.astype(np.uint64))
    group = np.frombuffer(data.translate(kind), np.uint8)
    inside = group != 0
    edge = group[1:] != group[:-1]
    begins, closes = np.empty(n, np.bool_), np.empty(n, np.bool_)
    begins[0], closes[-1] = inside[0], inside[-1]
    np.logical_and(edge, inside[1:], out=begins[1:])
    np.logical_and(edge, inside[:-1], out=closes[:-1])
    heads = offset[:-1][np.diff(offset) > 0]  # a new text begins a new word
    begins[heads] = inside[heads]
    closes[heads[1:] - 1] = inside[heads[1:] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, offset)
    hashes = _hashes(np.frombuffer(data, np.uint8), inside, starts, ends) if hashed else np.zeros(0, np.uint64)
    return Words(data, offset, starts, ends, first, hashes)


def parts(text: bytes, kind: bytes, limit: int, overlap: int):
    """(part, number of its first words that the part before ends with) of a text: about `limit` bytes each, cut between words.

    Parts overlap by `overlap` words, so that every run of overlap + 1 words is in one of them. A part ends after a word, and
    where `overlap` words are longer than limit, it is as long as they are and one word more.
    """
    between = bytes(b for b in range(256) if not kind[LOWER[b]])
    stop = re.compile(b"[" + re.escape(between) + b"]")
    begin, again = 0, 0
    while True:
        end = begin + limit
        while True:
            found = stop.search(text, end)
            end = found.start() if found else len(text)
            part = text[begin:end].decode()
            w = words(pa.array([part]), kind, hashed=False)
            if end == len(text) or len(w.starts) > overlap:
                break
            end += limit
        yield part, again
        if end == len(text):
            return
        again = min(overlap, len(w.starts))
        begin = begin + int(w.starts[len(w.starts) - again]) if again else end


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words, and where each text's begin. A text of fewer words, but not none, has its whole sequence as one."""
    counts = w.counts
    h, n = w.hashes, len(w.hashes)
    folded = np.zeros(n, np.uint64)
    step = np.uint64(0x100000001B3)
    for i in range(size):
        folded[: n - i] = mix(folded[: n - i] * step + h[i:] + np.uint64(1)) if i < n else folded[:0]
    out_counts = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(out_counts, out=begin[1:])
    pos = np.repeat(w.first[:-1] - begin[:-1], out_counts) + np.arange(begin[-1])
    out = folded[pos]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        whole = np.full(len(short), n, np.uint64)
        for j in range(n):
            whole = mix(whole * step + h[w.first[short] + j])
        out[begin[short]] = whole
    return out, begin
