"""Counts over one document, computed on its UTF-8 bytes.

Words are maximal runs of bytes other than space and 0x09 to 0x0D, which is what
``bytes.split()`` splits at.
"""

from __future__ import annotations

import numpy as np

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
# an odd multiplier per place of a window, so that a window's number depends on its order
_PLACE = np.array([pow(0x9E3779B97F4A7C15, j + 1, 2**64) for j in range(WINDOW)], np.uint64)


def code_points(raw: bytes) -> int:
    octets = np.frombuffer(raw, np.uint8)
    return len(raw) - int(np.count_nonzero((octets & 0xC0) == 0x80))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    named = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        named += (ids[j : j + n] ^ (ids[j : j + n] >> np.uint64(29))) * _PLACE[j]
    ordered = np.sort(named)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return 0
    hits = np.flatnonzero(np.isin(named, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def duplicate_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    count = 0
    for line in raw.split(b"\n"):
        if line in seen:
            count += 1
        elif line.strip():
            seen.add(line)
    return count


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    joined = b"".join(words)
    return (
        len(words),
        code_points(joined),
        len(joined) - len(joined.translate(None, SYMBOLS)),
        duplicate_lines(raw),
        repeated_words(words),
    )
