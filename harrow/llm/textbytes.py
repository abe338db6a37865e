"""Vectorised word and shingle hashing over UTF-8 bytes, for use inside Arrow batches.

A word is a maximal run of ASCII digits, ASCII letters (folded to lower case) and bytes >= 0x80, that is
of matches of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z.
Work is done in windows of about ``WINDOW`` bytes that end between words, so memory follows the window
(or the longest single word), not the text.
"""

from __future__ import annotations

import numpy as np

WINDOW = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = True
_IS_WORD[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the SplitMix64 generator: a bijection on 64-bit words."""
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(n, WINDOW)
    if size not in _powers:
        if size > WINDOW:
            _powers.pop(max(_powers), None) if len(_powers) > 1 else None
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            t = np.full(size + 1, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def word_table(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of ``buf`` (uint8), in order. Hashes are 64-bit."""
    starts, ends, hashes = [], [], []
    at, n = 0, len(buf)
    while at < n:
        stop = min(n, at + WINDOW)
        low = _LOWER[buf[at:stop]]
        word = _IS_WORD[low]
        while stop < n and word[-1]:  # end between words, or widen to the end of a very long one
            gaps = np.flatnonzero(~word)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                stop = min(n, stop + WINDOW)
            low = _LOWER[buf[at:stop]]
            word = _IS_WORD[low]
        edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(first):
            up, down = _power_tables(len(low))
            total = np.zeros(len(low) + 1, dtype=np.uint64)
            np.cumsum(_BYTE[low] * up[: len(low)], out=total[1:])
            h = (total[last] - total[first]) * down[first]
            starts.append(first + at)
            ends.append(last + at)
            hashes.append(mix(h + (last - first).astype(np.uint64)))
        at = stop
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start in the text, end in the text, hash) of each word of the texts; null has no words."""
    parts = [t or b"" for t in texts]
    buf = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    begin = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in parts], out=begin[1:])
    start, end, h = word_table(buf)
    doc = np.searchsorted(begin, start, side="right") - 1
    return doc, start - begin[doc], end - begin[doc], h


def shingles_of(doc: np.ndarray, h: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each run of ``width`` words; a text of fewer words, but not none, is one run."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.zeros(n_docs + 1, dtype=np.int64)
    np.cumsum(count, out=first[1:])
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    of = np.repeat(np.arange(n_docs), runs)
    skipped = first[:-1] - (np.cumsum(runs) - runs)
    out = np.zeros(len(of), dtype=np.uint64)
    for a in range(0, len(of), WINDOW):  # memory beside the result follows the window
        own = of[a : a + WINDOW]
        at = np.arange(a, a + len(own)) + skipped[own]
        end = np.minimum(at + width, first[own + 1])
        total = np.zeros(len(own), dtype=np.uint64)
        for k in range(width):
            inside = at + k < end
            value = np.zeros(len(own), dtype=np.uint64)
            value[inside] = h[at[inside] + k]
            total = mix(total + value * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1) * inside)
        out[a : a + WINDOW] = total
    return of, out


def chunks(values: list[bytes | None], limit: int = WINDOW) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes in all; a longer text stands alone."""
    out, begin, size = [], 0, 0
    for i, v in enumerate(values):
        n = len(v) if v else 0
        if size and size + n > limit:
            out.append((begin, i))
            begin, size = i, 0
        size += n + 1
    if begin < len(values):
        out.append((begin, len(values)))
    return out
