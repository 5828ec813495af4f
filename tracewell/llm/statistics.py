"""Per-document statistics that the quality operators learn from.

Only the text enters; ids, languages, sources and labels never do.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

SYMBOLS = b"#*$%&|<>"
NAMES = (
    "log_words", "word_bytes", "upper_share", "digit_share", "symbols_per_word", "marks_per_word",
    "stops_per_word", "foreign_share", "distinct_share", "short_share", "line_words", "repeated_lines",
    "repeated_words", "newline_share",
)
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_SYMBOL, _MARK, _STOP = (np.frombuffer(x, np.uint8) for x in (SYMBOLS, b"!?", b".,;:"))


def repeated_lines(text: bytes) -> tuple[int, int]:
    r"""(lines with a word that equal an earlier line, lines with a word) of \n-split lines."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines)), len(lines)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    windows = list(zip(*(words[k:] for k in range(width))))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    again = np.fromiter((counts[x] > 1 for x in windows), bool, n)
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def code_points(text: bytes) -> int:
    """Characters of UTF-8 bytes: those that do not continue another."""
    return int((np.frombuffer(text, np.uint8) & 0xC0 != 0x80).sum())


def features(text: bytes, words: list[bytes], n_repeated: int, dup_lines: int, n_lines: int) -> list[float]:
    """The values of NAMES; an empty text has all zeros."""
    if not words:
        return [0.0] * len(NAMES)
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, size = len(words), len(text)
    upper, letters = int(h[_UPPER].sum()), int(h[_UPPER].sum() + h[_LOWER].sum())
    inked = size - int(h[9:14].sum() + h[32])
    return [
        float(np.log1p(n)),
        inked / n,
        upper / max(1, letters),
        int(h[_DIGIT].sum()) / size,
        int(h[_SYMBOL].sum()) / n,
        int(h[_MARK].sum()) / n,
        int(h[_STOP].sum()) / n,
        int(h[128:].sum()) / size,
        len(set(words[:])) / n,
        sum(map(_SHORT, map(len, words))) / n,
        float(np.log1p(n / max(1, n_lines))),
        dup_lines / max(1, n_lines),
        n_repeated / n,
        int(h[10]) / size,
    ]


_SHORT = (4).__gt__


def document_features(text: bytes) -> list[float]:
    words = text.split()
    dup, lines = repeated_lines(text)
    return features(text, words, repeated_words(words), dup, lines)
