"""Texts as the bytes of an Arrow buffer: where words stand in it, and checksums of many stretches at once.

A word byte is what a table of 256 entries says it is; a word is a run of them inside one text. Nothing here looks at
characters: all bytes of a character beyond ASCII are word bytes, so that runs of bytes are runs of characters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is worked on alone.
PIECE = 1 << 22


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each, without a copy; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``buffer`` of consecutive texts of about ``size`` bytes together."""
    data, at = buffer(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


#: Digits, letters (A-Z as a-z) and all bytes beyond ASCII are word bytes and stand for themselves; others are 0.
FOLD = np.array([b if b >= 128 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of the texts of a piece: ``data`` is the folded bytes, ``starts`` and ``ends`` those of each word in them, ``first`` the number of words before each text (one entry more than texts)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, fold: np.ndarray = FOLD):
        self.data = fold[raw]
        inside = self.data != 0
        full = np.flatnonzero(at[1:] > at[:-1])
        opens, closes = inside.copy(), inside.copy()
        # A word begins or ends where inside differs from its neighbour, and at the edge of its text.
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        opens[at[:-1][full]] = inside[at[:-1][full]]
        closes[at[1:][full] - 1] = inside[at[1:][full] - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, at)

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


#: The checksum is the common reflected one; the table follows from its polynomial.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
OPEN = np.uint32(0xFFFFFFFF)
#: So many bytes of each stretch are taken in step with all others; what is left of longer ones is taken one by one.
STEPS = 64


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """States of the checksum after the bytes of each stretch; all stretches move on together, a byte a step."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, left, now = starts[order], -length[order], state[order]
    for k in range(min(STEPS, int(-left[0]) if len(left) else 0)):
        n = int(np.searchsorted(left, -k, side="left"))  # those longer than k come first
        some = now[:n]
        now[:n] = _CRC[(some ^ data[at[:n] + k]) & 0xFF] ^ (some >> 8)
    for j in range(int(np.searchsorted(left, -STEPS, side="left"))):
        rest = data[at[j] + STEPS : at[j] - left[j]]
        now[j] = zlib.crc32(rest, int(now[j] ^ OPEN)) ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return advance(np.full(len(starts), OPEN, np.uint32), data, starts, ends) ^ OPEN
