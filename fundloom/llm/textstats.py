"""Statistics of one text, in one pass over its words and lines. Used by the quality classifier and the quality rules."""

from __future__ import annotations

import numpy as np

#: Characters that count as symbols, and those that separate words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Fixed value: fewer words than this fail the base rules.
LEAST_WORDS = 50


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))


def repeated_words(ids: np.ndarray) -> int:
    """How many words are in a 3-word window that the text has twice or more."""
    if len(ids) < 3:
        return 0
    top = int(ids.max()) + 1
    pair = np.unique(ids[:-1] * top + ids[1:], return_inverse=True)[1]
    kind, times = np.unique(pair[:-1] * top + ids[2:], return_inverse=True, return_counts=True)[1:]
    at = np.flatnonzero(times[kind] > 1)
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text has none of anything."""
    return counted(text)[0]


def counted(text: str | None) -> tuple[tuple[int, int, int, int, int], list[bytes], list[str], np.ndarray]:
    text = text or ""
    words = text.encode().split()  # of bytes, split() takes exactly the six separators
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    ids = word_ids(words)
    chars = len(text) - sum(map(text.count, SPACES))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids)), words, lines, ids


#: The names of what features() returns, in order.
FEATURES = (
    "log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "commas", "stops", "bangs", "pipes", "unique",
    "short_words", "long_words", "line_words", "top_word", "ended_lines", "controls",
)


def features(text: str | None) -> tuple[list[float]]:
    text = text or ""
    (n, chars, symbols, dup, repeat), words, lines, ids = counted(text)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    kinds = np.bincount(raw, minlength=256)
    per = 1.0 / max(chars, 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    tally = np.bincount(ids) if n else np.zeros(1, dtype=np.int64)
    share = lambda x: float(x) / max(n, 1)
    return (
        [
            float(np.log1p(n)), chars / max(n, 1), symbols * per, dup / max(len(lines), 1), share(repeat), float(kinds[65:91].sum()) * per,
            float(kinds[48:58].sum()) * per, float(kinds[44]) * per, float(kinds[46]) * per, float(kinds[33]) * per, float(kinds[124]) * per,
            share((tally > 0).sum()), share((sizes <= 3).sum()), share((sizes >= 15).sum()), n / max(len(lines), 1), share(tally.max()),
            sum(line.rstrip(SPACES)[-1] in ".!?" for line in lines) / max(len(lines), 1), float(kinds[:9].sum() + kinds[14:32].sum()) * per,
        ],
    )
