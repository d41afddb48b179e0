"""Quality rules on repetition: how much of a text lies inside n-grams and lines that the text has already had."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, grams, hashed, slices, utf8

#: n: the largest share of a text's word characters that may lie inside n-grams of words that repeat earlier ones.
LIMITS = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
#: The largest share of word characters in lines that repeat earlier ones, and of such lines.
LINE_CHARS, LINE_SHARE = 0.2, 0.5
#: The most symbols of SYMBOLS for each word.
SYMBOLS_A_WORD = 0.2
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

_LONG = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{c} long" for c in _LONG) + ", base_failed boolean, kept boolean, worst_gram_share double, dup_line_chars_share double, dup_line_share double"


def repeats(keys: np.ndarray, n: int, words: int, first: bool) -> np.ndarray:
    """Which of the words lie in an n-gram found before in the text; with `first`, in one found twice or more."""
    inside = np.zeros(words + 1, np.int64)
    if len(keys):
        _, at, back, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        again = count[back] > 1
        if not first:
            again[at] = False
        starts = np.flatnonzero(again)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + n, -1)
    return np.cumsum(inside[:-1]) > 0


def judged(text: bytes, memo: WordHash) -> tuple:
    words = text.split()
    n = len(words)
    chars = np.fromiter((len(w.decode()) for w in words), np.int64, n) if not text.isascii() else np.fromiter(map(len, words), np.int64, n)
    total = int(chars.sum())
    h = hashed(memo, words)
    seen: set[bytes] = set()
    dup_lines = lines = dup_chars = 0
    for line in text.split(b"\n"):
        if not line.split():
            continue
        lines += 1
        if line in seen:
            dup_lines += 1
            dup_chars += sum(len(w.decode()) for w in line.split())
        seen.add(line)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeat = int(repeats(grams(h, WINDOW), WINDOW, n, True).sum())
    failed = n < 20 or 100 * repeat > 30 * n
    worst, over = 0.0, False
    for k, most in LIMITS.items():
        share = float(chars[repeats(grams(h, k), k, n, False)].sum()) / max(total, 1)
        worst, over = max(worst, share), over or share > most
    line_chars, line_share = dup_chars / max(total, 1), dup_lines / max(lines, 1)
    over = over or line_chars > LINE_CHARS or line_share > LINE_SHARE or symbols > SYMBOLS_A_WORD * max(n, 1)
    return n, total, symbols, dup_lines, repeat, failed, not failed and not over, worst, line_chars, line_share


def judge(docs: DataFrame) -> DataFrame:
    """One row for each document: the counts, base_failed, and kept, which the coverage limits decide beyond base_failed.

    Coverage is measured in characters of words: those inside n-grams (n from 5 to 10) that came earlier in the text, found by
    rolling hashes, and those of lines that came earlier; symbols are held to 0.2 a word. Null and empty texts have no words
    and fail; rows that repeat are judged alike; other columns than doc_id and text are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 3
        for b in (s for batch in batches for s in slices(batch)):
            rows = [judged(t, memo) for t in utf8(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds[1:], strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
