"""Quality rules by repetition coverage.

Each text is measured on its own: rolling hashes of several n-gram lengths
(``words.window_hashes``) are sorted in numpy, n-grams that occur again mark the
words they cover, and the marked words' characters are summed. Lines are
compared whole. There is no shuffle; a row's result depends on its text alone.

Verdict (``kept``): false when the base rule fails, or when the repeated part of
the text (n-grams after their first occurrence, or lines after their first) holds
more than the given share of the word characters.

Defined cases: a null or blank text has no words, so the base rule fails. Repeated
rows give repeated results. A text's working memory is about 50 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from carelens.llm.words import covered, normalised, window_hashes, word_hashes, word_ranges

#: The symbols that are counted; the base rule's limits.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 10, 5, 20
#: Greatest allowed share of characters in repeats, by n-gram length; of lines.
LIMITS = {5: 0.15, 7: 0.13, 10: 0.10}
LINE_LIMIT = 0.20

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, "
          + "".join(f"repeat_chars_{n} double, " for n in LIMITS) + "dup_line_chars double")


def repeats(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows: which occur twice or more; which are a later occurrence."""
    ordered = np.sort(hashes)
    if not (ordered[1:] == ordered[:-1]).any():
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    later = np.zeros(len(hashes), bool)
    later[order[1:]] = same
    any_ = later.copy()
    any_[order[:-1]] |= same
    return any_, later


def measure(text: str | None, limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> tuple:
    """The columns of SCHEMA after doc_id, for one text."""
    raw = (text or "").encode("utf-8")
    joined = normalised(text)
    starts, ends = word_ranges(joined)
    n = len(starts)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)))
    chars = points[ends] - points[starts]
    word_chars = int(chars.sum())
    seen: set[bytes] = set()
    dup_lines = dup_line_bytes = line_bytes = 0
    for line in raw.split(b"\n"):
        if bare := b"".join(line.split()):
            line_bytes += len(bare)
            if line in seen:
                dup_lines += 1
                dup_line_bytes += len(bare)
            seen.add(line)
    words = word_hashes(joined, starts, ends)
    repeat_words, shares = 0, []
    for size in sorted({BASE_WINDOW, *limits}):
        windows = window_hashes(words, size)
        any_, later = repeats(windows)
        if size == BASE_WINDOW:
            repeat_words = int(covered(np.flatnonzero(any_), size, n).sum()) if any_.any() else 0
        if size in limits:
            share = float(chars[covered(np.flatnonzero(later), size, n)].sum()) / word_chars if later.any() else 0.0
            shares.append((share, limits[size]))
    lines = dup_line_bytes / line_bytes if line_bytes else 0.0
    base_failed = n < MIN_WORDS or 100 * repeat_words > BASE_PERCENT * n
    kept = not base_failed and lines <= line_limit and all(s <= most for s, most in shares)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return (n, word_chars, symbols, dup_lines, repeat_words, base_failed, kept, *(s for s, _ in shares), lines)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t) for t in batch.column(1).to_pylist()]
        columns = [batch.column(0), *(pa.array(list(c)) for c in zip(*rows, strict=True))] if rows else []
        if rows:
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of SCHEMA per row of docs."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_measured, SCHEMA)
