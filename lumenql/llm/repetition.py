"""Quality rules on repetition: how much of a text lies inside repeated n-grams and lines.

Word n-grams of several lengths get 64-bit rolling hashes in numpy, each length from the one
before. For every length the rule is on the share of word characters that lie in later copies of
an n-gram; lines have two rules. The base counts (contracted) are exact: five-word windows with
equal hashes are compared word by word.

Defined results: a null or empty text has zeros everywhere, fails the base and is not kept.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import WORD, map_texts

# The published limits on the share of characters in duplicate n-grams, by n, and on duplicate lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.20
BASE_WINDOW = 5
_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_ngram_chars array<double>, dup_line_share double, dup_line_chars double"


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window of n words from one of ``starts``."""
    mark = np.zeros(size + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + n, -1)
    return np.cumsum(mark[:-1]) > 0


def groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions by hash then place, and for each whether it opens a new hash."""
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    return order, new


def measure(text: str | None) -> dict:
    """All output columns of one text."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    first_of: dict[str, int] = {}
    ids = np.fromiter((first_of.setdefault(w, len(first_of)) for w in words), np.int64, n)
    sizes = np.fromiter(map(len, words), np.int64, n)
    chars = int(sizes.sum())
    repeat, shares = 0, []
    mixed = ((ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLY) ^ np.uint64(0x5851F42D4C957F2D)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(1, max(NGRAM_LIMITS) + 1):
        if n < k:
            break
        h = h[: n - k + 1] * np.uint64(0xD6E8FEB86659FD93) + mixed[k - 1 :]
        if k == BASE_WINDOW or k in NGRAM_LIMITS:
            order, new = groups(h)
            if k == BASE_WINDOW and not new.all():
                same = np.all(ids[order[1:, None] + np.arange(k)] == ids[order[:-1, None] + np.arange(k)], axis=1)
                new[1:] = ~same
                twice = ~new
                twice[:-1] |= ~new[1:]
                repeat = int(covered(order[twice], k, n).sum())
            later = order[~new]
            shares.append(float(sizes[covered(later, k, n)].sum() / chars) if len(later) else 0.0)
            if not len(later):
                break  # no longer n-gram can occur twice
    shares += [0.0] * (len(NGRAM_LIMITS) - len(shares))
    seen: set[str] = set()
    dup_lines = dup_chars = lines = line_chars = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            lines += 1
            line_chars += len(line)
            if line in seen:
                dup_lines += 1
                dup_chars += len(line)
            seen.add(line)
    failed = n < 10 or 100 * repeat > 20 * n
    line_share, line_char_share = dup_lines / max(lines, 1), dup_chars / max(line_chars, 1)
    good = all(s <= limit for s, limit in zip(shares, NGRAM_LIMITS.values(), strict=True)) and line_share <= LINE_LIMIT and line_char_share <= LINE_CHARS_LIMIT
    return {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": sum(map(len, _SYMBOL.findall(text))),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat,
        "base_failed": failed,
        "kept": good and not failed,
        "dup_ngram_chars": shares,
        "dup_line_share": line_share,
        "dup_line_chars": line_char_share,
    }


def repetition(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and the measures of each row; dup_ngram_chars is in the order of NGRAM_LIMITS."""

    def make():
        def step(keys, texts):
            rows = [measure(t) for t in texts]
            return {key: keys} | {c.split()[0]: [r[c.split()[0]] for r in rows] for c in COLUMNS.split(", ")}

        return step

    return map_texts(docs, [key, "text"], make, f"{key} {docs.schema[key].dataType.simpleString()}, {COLUMNS}")
