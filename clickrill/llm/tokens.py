"""Words of whole columns of texts at once, as 64-bit hashes, with NumPy.

A word's hash mixes its bytes (16 at most; a longer word is a keyed BLAKE2b digest), so words of 8 bytes or fewer and of
one length never share one. Equal words have equal hashes; what must hold the other way round is compared by bytes, or by
digests of bytes, where it matters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts of a chunk are hashed together; this many bytes, or one text if that is longer.
CHUNK = 1 << 19
_M64 = (1 << 64) - 1
_SPACE = [0x20, *range(0x09, 0x0E)]
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


class Alphabet:
    """Which bytes belong to words, and whether A-Z count as a-z."""

    def __init__(self, separators: list[int], lower: bool):
        self.is_word = np.ones(256, bool)
        self.is_word[separators] = False
        fold = bytes(range(256)).lower() if lower else bytes(range(256))
        self.fold = np.frombuffer(fold, np.uint8) if lower else None
        self.table = bytes(fold[i] if self.is_word[i] else 0x20 for i in range(256))

    def split(self, text: str | None) -> list[bytes]:
        """The words of one text, as bytes."""
        return (text or "").encode().translate(self.table).split()


SPACED = Alphabet(_SPACE, lower=False)
SPACED_LOWER = Alphabet(_SPACE, lower=True)
#: Words of 0-9, a-z and bytes beyond ASCII; upper-case letters count as lower-case ones.
ALNUM_LOWER = Alphabet([i for i in range(128) if not chr(i).isalnum()], lower=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of consecutive texts: starts and stops (bytes into data), hashes, and where each text's words begin (first).
    Hashes under another key are other ones: whoever doesn't know the key can't make words that share a hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet, key: int = 0):
        n = len(data)
        self.data, self.offsets = data, offsets
        w = alphabet.is_word[data]
        begin, end = w.copy(), w.copy()
        begin[1:] &= ~w[:-1]
        end[:-1] &= ~w[1:]
        inner = offsets[:-1][offsets[:-1] < n]
        begin[inner] = w[inner]
        last = offsets[1:][offsets[1:] > 0] - 1
        end[last] = w[last]
        self.starts, self.stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.folded = np.zeros(n + 24, np.uint8)
        self.folded[:n] = data if alphabet.fold is None else alphabet.fold[data]
        self.hashes = self._hash(key)
        self.first = np.searchsorted(self.starts, offsets)

    def _hash(self, key: int) -> np.ndarray:
        size = self.stops - self.starts
        at = np.ndarray(len(self.folded) - 7, "<u8", self.folded, strides=(1,))  # the 8 bytes from each place on
        low = at[self.starts] & _FIRST[np.minimum(size, 8)]
        high = at[self.starts + np.minimum(size, 8)] & _FIRST[np.clip(size - 8, 0, 8)]
        out = mix(low ^ mix((high ^ np.uint64(key & _M64)) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        long = np.flatnonzero(size > 16)
        if len(long):
            raw, secret = self.folded.tobytes(), (key & _M64).to_bytes(8, "little")
            out[long] = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=8, key=secret).digest() for a, b in zip(self.starts[long].tolist(), self.stops[long].tolist(), strict=True)]), "<u8")
        return out

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words with one space after each, and where each begins and ends in them."""
        size = self.stops - self.starts
        begin = np.cumsum(size + 1) - size - 1
        out = np.full(int((size + 1).sum()), 0x20, np.uint8)
        shift = np.repeat(begin - self.starts, size)
        at = np.arange(len(shift)) + np.repeat(self.starts - (np.cumsum(size) - size), size)
        out[at + shift] = self.folded[at]
        return out.tobytes(), begin, begin + size

    def digests(self, at: np.ndarray, length: int) -> list[bytes]:
        """128-bit BLAKE2b digests of the bytes of the windows of `length` words that start at the given words."""
        if not len(at):
            return []
        raw, begin, end = self.joined()
        blake = hashlib.blake2b
        return [blake(raw[a:b], digest_size=16).digest() for a, b in zip(begin[at].tolist(), end[at + length - 1].tolist(), strict=True)]

    def windows(self, length: int, seed: int = 0) -> np.ndarray:
        """Hashes of the windows of `length` words that start at each word; those that run past the last word of the
        column are missing, those that run past their text's end are there and mean nothing."""
        h, n = self.hashes, max(0, len(self.hashes) - length + 1)
        out, m = np.zeros(n, np.uint64), (0x9FB21C651E98DF25 + 2 * seed) & _M64 | 1
        with np.errstate(over="ignore"):
            for i in range(length):
                out = out * np.uint64(m) + h[i : i + n]
        return mix(out ^ np.uint64(seed * 0xD1B54A32D192ED03 & _M64))


def raw_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, uncopied unless it has nulls (which are empty), and where each text begins and ends."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, at, raw = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(at, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offsets


def chunks(texts: pa.Array, alphabet: Alphabet, key: int = 0, size: int | None = None) -> Iterator[tuple[int, int, Words]]:
    """(from, to, Words) for runs of the texts of about `size` bytes (CHUNK); a null text has no words."""
    size = size or CHUNK
    n = len(texts)
    if not n:
        return
    data, offsets = raw_texts(texts)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], alphabet, key)
        i = j
