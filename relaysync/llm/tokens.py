"""Words of whole texts as spans and 64-bit hashes, vectorised over bytes.

A word class is a table of 256 booleans (UTF-8 bytes), so it can hold ASCII
bytes one by one and all non-ASCII characters together.  Hashes are
polynomials over bytes, folded to lower case for A-Z, finalised by a mixer.
"""

from __future__ import annotations

import numpy as np

_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the sequence ``left`` followed by ``right``."""
    return mix(left * np.uint64(0xE7037ED1A0B428DB) + right)


def _byte_values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
    if lower:
        v[65:91] = v[97:123]
    return v


_LOWER, _EXACT = _byte_values(True), _byte_values(False)
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False

ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _CHUNK + 1)
        inv = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, dtype=np.uint64)]), dtype=np.uint64)
                      for b in (_BASE, inv)]
    return _powers


def word_spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray):
    """(start, end, row) of every word of the rows ``off`` delimits in ``buf``."""
    base, n = int(off[0]), int(off[-1] - off[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = is_word[buf[base: base + n]]
    rel = off - base
    edge = np.zeros(n + 1, dtype=bool)
    edge[rel] = True
    begins, ends = m.copy(), m.copy()
    begins[1:] &= ~m[:-1] | edge[1:-1]
    ends[:-1] &= ~m[1:] | edge[1:-1]
    s = np.flatnonzero(begins)
    e = np.flatnonzero(ends) + 1
    row = np.searchsorted(rel, s, side="right") - 1
    return s + base, e + base, row


def span_hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each (ordered) span's bytes."""
    out = np.empty(len(s), dtype=np.uint64)
    value, i = (_LOWER if lower else _EXACT), 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + _CHUNK, side="right")))
        lo, hi = int(s[i]), int(e[j - 1])
        power, inverse = _power_tables(hi - lo + 1)
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(value[buf[lo:hi]] * power[: hi - lo], out=total[1:])
        a, b = s[i:j] - lo, e[i:j] - lo
        out[i:j] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out


def text_hash(words: list[str]) -> np.ndarray:
    """Hashes of single words given as strings."""
    raw = [w.encode() for w in words]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return span_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), off[:-1], off[1:])
