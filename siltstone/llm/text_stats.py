"""Statistics of one document, shared by the quality operators."""

from __future__ import annotations

from collections import Counter

import numpy as np

SYMBOLS = "#*$%&|<>"
WINDOW = 5
_SPACE = np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8)
_SYMBOL = np.frombuffer(SYMBOLS.encode(), dtype=np.uint8)

#: Order of the feature vector made by ``features``; the sign is the monotonic constraint
#: that the quality trees put on it (-1: a higher value never raises the verdict).
FEATURES: tuple[tuple[str, int], ...] = (
    ("log_words", 0),
    ("mean_word_chars", 0),
    ("symbols_per_word", -1),
    ("dup_line_share", -1),
    ("repeat_word_share", -1),
    ("upper_share", -1),
    ("bang_per_word", -1),
    ("digit_share", 0),
    ("letter_share", 1),
    ("distinct_word_share", 0),
    ("mean_line_words", 0),
    ("pipe_per_word", -1),
    ("end_mark_per_word", 0),
    ("short_word_share", 0),
)


def n_repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice, first occurrence included."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    twice = np.fromiter((counts[g] > 1 for g in grams), dtype=bool, count=len(grams))
    covered = np.zeros(len(words), dtype=bool)
    for i in range(window):
        covered[i : i + len(grams)] |= twice
    return int(covered.sum())


def base_stats(text: str | None) -> tuple[list[bytes], int, int, int, int, np.ndarray]:
    """(words, word_chars, n_symbols, n_dup_lines, n_repeat_words, byte counts); null is empty.

    Words are runs of bytes without ASCII white space.  One histogram of the UTF-8 bytes
    gives all counts of ASCII characters; code points are the bytes that continue no other.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    words = data.split()
    word_chars = len(text or "") - int(counts[_SPACE].sum())
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return words, word_chars, int(counts[_SYMBOL].sum()), dup, n_repeat_words(words), counts


def features(stats: tuple) -> list[float]:
    """Feature vector of ``FEATURES`` from ``base_stats``; lead bytes beyond ASCII count as letters."""
    words, word_chars, n_symbols, dup, repeat, counts = stats
    n = len(words)
    per_word, per_char = 1.0 / max(n, 1), 1.0 / max(word_chars, 1)
    lines = int(counts[10]) + 1
    upper = int(counts[65:91].sum())
    letters = upper + int(counts[97:123].sum()) + int(counts[0xC2:].sum())
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    return [
        float(np.log1p(n)),
        word_chars * per_word,
        n_symbols * per_word,
        dup / lines,
        repeat * per_word,
        upper * per_char,
        int(counts[33]) * per_word,
        int(counts[48:58].sum()) * per_char,
        letters * per_char,
        len(set(words)) * per_word,
        n / lines,
        int(counts[124]) * per_word,
        int(counts[33] + counts[46] + counts[63]) * per_word,
        int((lengths <= 3).sum()) * per_word,
    ]
