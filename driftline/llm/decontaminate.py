"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The test items are the query set: they are held against all documents, in blocks of bounded size. Seeds are pairs of neighbouring
words. An alignment of an item of L words that scores LEAST has M matches and E edits with 2 M - E >= 2 LEAST L, hence at least
(2 * 2 * LEAST - 2) / 2 * L = 0.2 L more matches than edits; E edits leave at most E + 1 runs of matches, so at least 0.2 L - 1 of
the item's pairs stand in the passage, and what the edits shift stays within 0.8 L words. A first pass counts the documents that
hold each pair. The commonest pairs of an item, half of the number that must be there, are no seeds; a text in which fewer than
the other half of that number stand on diagonals as close as that holds no leak of the item. The rest is aligned, unless the passage
holds too few of the item's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keyed, slices, utf8

#: Scores of an alignment, and the least score of a leak as a share of the item aligned with itself.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.6
#: Items shorter than this are looked for word for word: too few words would be left to tell an edited copy by.
EDITED_WORDS = 8
#: Bytes of item text that are sent to the tasks at a time; more items take more passes.
BLOCK_BYTES = 16 << 20
#: Hits of a text that are held at a time; where it has more, its items are taken in parts.
MOST_HITS = 1 << 21

STRIP = b".,;:!?\"'()[]{}"
FOUND = "doc_id long, tkey long, item_id long, score double, first_word long, last_word long, item_words int"


class Words(dict):
    """bytes of a word -> its number among the items' words, or -1."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = n = self.known.get(word.lower().strip(STRIP) or word, -1)
        return n


class Items:
    """A block of items: words as numbers, and for each pair of neighbours the items and places that have it."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.known: dict[bytes, int] = {}
        self.words: list[tuple[int, np.ndarray]] = []
        for item, text in rows:
            own = [self.known.setdefault(w.lower().strip(STRIP) or w, len(self.known)) for w in (text or "").encode().split()]
            if own:
                self.words.append((item, np.array(own, np.int64)))
        sizes = np.array([len(w) for _, w in self.words], np.int64)
        self.singles = bool((sizes == 1).any())
        codes = [self.codes(w, len(w) == 1) for _, w in self.words]
        self.item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        self.place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        self.code = np.concatenate(codes) if codes else np.empty(0, np.int64)
        self.every = np.unique(self.code)
        short = sizes < EDITED_WORDS
        #: The least share of an item's own score, how many of its pairs must stand in a leak, and how far edits shift them.
        self.least = np.where(short, 1.0, LEAST)
        self.there = np.where(short, np.maximum(sizes - 1, 1), np.maximum(1, -(-sizes // 5) - 1))
        self.slack = np.where(short, 0, -(-4 * sizes // 5))
        self.bags = [np.unique(w, return_counts=True) for _, w in self.words]
        self.asked = self.there
        self.sort(np.arange(len(self.code)))

    def sort(self, rows: np.ndarray) -> None:
        order = rows[np.argsort(self.code[rows], kind="stable")]
        self.item, self.place, self.code = self.item[order], self.place[order], self.code[order]

    def rare(self, documents: np.ndarray) -> None:
        """Leaves out the commonest pairs of each item, by the number of documents that hold each of self.every."""
        often = documents[np.searchsorted(self.every, self.code)]
        order = np.lexsort((self.place, -often, self.item))
        first = np.searchsorted(self.item[order], self.item[order])
        common = self.there // 2
        self.asked = self.there - common
        self.sort(order[np.arange(len(order)) - first >= common[self.item[order]]])

    def codes(self, words: np.ndarray, single: bool = False) -> np.ndarray:
        """A number for each pair of known neighbours, or for each word, -1 for others. Words are fewer than 2**31, so numbers fit."""
        n = len(self.known) + 1
        if single:
            return np.where(words >= 0, words, -1)
        return np.where((words[:-1] >= 0) & (words[1:] >= 0), (words[:-1] + 1) * n + words[1:], -1)

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the text, and rows of this table, that have one pair; all of an item at once."""
        code = self.codes(words)
        at = np.flatnonzero(code >= 0)
        code = code[at]
        if self.singles:
            alone = np.flatnonzero(words >= 0)
            at, code = np.concatenate([at, alone]), np.concatenate([code, words[alone]])
        parts = [(0, len(self.words))]
        while parts:
            first, end = parts.pop()
            rows = np.arange(len(self.code)) if end - first == len(self.words) else np.flatnonzero((self.item >= first) & (self.item < end))
            own = self.code if len(rows) == len(self.code) else self.code[rows]
            lo, hi = np.searchsorted(own, code, "left"), np.searchsorted(own, code, "right")
            times = hi - lo
            if times.sum() > MOST_HITS and end - first > 1:
                parts += [(first, (first + end) // 2), ((first + end) // 2, end)]
                continue
            where = np.repeat(at, times)
            if len(where):
                yield where, rows[np.repeat(lo, times) + np.arange(len(where)) - np.repeat(np.cumsum(times) - times, times)]

    def near(self, where: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and diagonals, in order, of the hits that stand close to as many of their item as a leak has."""
        item = self.item[row]
        some = np.bincount(item, minlength=len(self.words)) >= self.asked
        keep = some[item]
        item, diagonal = item[keep], (where - self.place[row])[keep]
        order = np.lexsort((diagonal, item))
        item, diagonal = item[order], diagonal[order]
        # The hit that stands so many hits later, if it is of the item and close enough, bounds a group of enough hits.
        last = np.arange(len(item)) + self.asked[item] - 1
        end = np.minimum(last, len(item) - 1)
        dense = (last < len(item)) & (item[end] == item) & (diagonal[end] - diagonal <= self.slack[item])
        mark = np.zeros(len(item) + 1, np.int64)
        np.add.at(mark, np.flatnonzero(dense), 1)
        np.add.at(mark, end[dense] + 1, -1)
        inside = np.cumsum(mark[:-1]) > 0
        return item[inside], diagonal[inside]

    def enough(self, i: int, passage: np.ndarray) -> bool:
        """Whether a passage has as many of an item's words as a leak needs: each can match once, and nothing else scores."""
        least = self.least[i] * len(self.words[i][1])
        if len(passage) < least:
            return False
        kinds, times = self.bags[i]
        at = np.minimum(np.searchsorted(kinds, passage), len(kinds) - 1)
        held = np.bincount(at[kinds[at] == passage], minlength=len(kinds))
        return int(np.minimum(held, times).sum()) >= least


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment's score, and its first and last word in the passage."""
    n = len(passage)
    steps = GAP * np.arange(n + 1)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        gain = np.where(passage == w, MATCH, MISMATCH)
        across, down = score[:-1] + gain, score[1:] + GAP
        new = np.zeros(n + 1, np.int64)
        begin = np.arange(n + 1)
        new[1:] = np.maximum(np.maximum(across, down), 0)
        begin[1:] = np.where(new[1:] == 0, begin[1:], np.where(across >= down, start[:-1], start[1:]))
        # Gaps in the item: the best of all cells to the left, less the steps in between.
        lead = new - steps
        reach = np.maximum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == reach, np.arange(n + 1), 0))
        moved = reach + steps
        begin = np.where(moved > new, begin[source], begin)
        score, start = np.maximum(new, moved), begin
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(start[top]), top - 1)
    return best


def passages(doc_words: np.ndarray, items: Items) -> list[tuple[int, float, int, int, int]]:
    """(item, score, first word, last word, words of the item) of each leak in a text."""
    out = []
    for where, row in items.hits(doc_words):
        item, diagonal = items.near(where, row)
        if not len(item):
            continue
        # Seeds whose diagonals are close together speak for one passage, or for several in a row.
        ends = np.append(np.flatnonzero((np.diff(item) != 0) | (np.diff(diagonal) > items.slack[item[1:]])), len(item) - 1)
        starts = np.append(0, ends[:-1] + 1)
        found: dict[int, list[tuple]] = {}
        for i, least, most in zip(item[starts].tolist(), diagonal[starts].tolist(), diagonal[ends].tolist(), strict=True):
            number, words = items.words[i]
            slack = int(items.slack[i])
            spans = [(max(0, least - slack), min(len(doc_words), most + len(words) + slack))]
            while spans:
                lo, hi = spans.pop()
                if not items.enough(i, doc_words[lo:hi]):
                    continue
                score, a, z = align(words, doc_words[lo:hi])
                share = score / (MATCH * len(words))
                if share >= items.least[i]:
                    found.setdefault(i, []).append((number, share, lo + a, lo + z, len(words)))
                    spans += [(lo, lo + a), (lo + z + 1, hi)]
        for same in found.values():  # one passage may be seeded from several diagonals, which may cut it at an end
            kept: list[tuple] = []
            for x in sorted(same, key=lambda x: (-x[1], x[2], x[3])):
                if all(x[3] < y[2] or x[2] > y[3] for y in kept):
                    kept.append(x)
            out += kept
    return out


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items, so many bytes of their texts at a time."""
    block, size = [], 0
    for item, own in benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        if size > most:
            yield block
            block, size = [], 0
        block.append((item, own))
        size += len(own or "")
    yield block


def documents_with(text: DataFrame, items: Items) -> np.ndarray:
    """How many documents hold each pair of a block's items."""
    ready = text.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = ready.value
        memo, counts = Words(items.known), np.zeros(len(items.every) + 1, np.int64)
        for b in (s for batch in batches for s in slices(batch)):
            texts = [t.split() for t in utf8(b)]
            doc = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
            numbers = np.fromiter(map(memo.__getitem__, chain.from_iterable(texts)), np.int64, len(doc))
            code, of = items.codes(numbers), doc[:-1]
            code = np.where(of == doc[1:], code, -1)
            if items.singles:
                code, of = np.concatenate([code, numbers]), np.concatenate([of, doc])
            code, of = code[code >= 0], of[code >= 0]
            at = np.minimum(np.searchsorted(items.every, code), len(items.every) - 1)
            held = items.every[at] == code
            counts[: len(items.every)] += np.bincount(np.unique(of[held] * len(items.every) + at[held]) % len(items.every), minlength=len(items.every))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["pair", "n"])

    # A row for each pair of the block at most, whatever the number of documents.
    found = text.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(items.every), np.int64)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    ready.destroy()
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word, item_words: a row for each passage that repeats an item, edited or not.

    Words are compared without case and outer punctuation. Null and empty texts have no passage and null and empty items none to
    look for; items under EDITED_WORDS words are found word for word only; a text of any length is read whole; repeated documents are each reported; items that repeat are reported by each id; an empty table on
    either side gives no rows; other columns are ignored.
    """
    return keyed_leaks(docs, benchmark, block_bytes).drop("tkey")


def keyed_leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The leaks, and in tkey which text of a doc_id holds them."""
    spark = docs.sparkSession
    text = keyed(docs)
    out = None
    for block in blocks(benchmark, block_bytes):  # the query set, of which one block is held at a time
        items = Items(block)
        if not items.words:
            continue
        items.rare(documents_with(text, items))
        ready = spark.sparkContext.broadcast(items)

        def find(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            items = ready.value
            memo = Words(items.known)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
            for b in (s for batch in batches for s in slices(batch)):
                got = []
                for doc, key, t in zip(b.column("doc_id").to_pylist(), b.column("tkey").to_pylist(), utf8(b), strict=True):
                    words = t.split()
                    got += [(doc, key, *x) for x in passages(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)), items)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

        part = cut(text.mapInArrow(find, FOUND), "leaks")
        ready.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FOUND) if out is None else out
