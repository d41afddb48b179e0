"""Substring dedup by seed and extend.

Winnowing picks an anchor (a hash of a few words) for every window of a text, so that equal windows have equal anchors wherever
they stand. Documents meet on anchors that occur twice or more. Each occurrence is extended to both sides over all the windows
that chose it: if every occurrence of an anchor extends alike, all of these windows are repeats; otherwise the windows of one
text for each different extension are compared. What lies in a repeated window goes. Groups are counted, never paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, BASE_INVERSE, WordHash, cut, grams, hashed, keyed, mix, powers, slices, utf8

#: Words in a window, and words in an anchor.
WINDOW, ANCHOR = 35, 12


def runs(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors a text's windows choose: hash, first window and number of windows in a row that choose it."""
    if len(h) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    k = grams(h, anchor)
    span = window - anchor + 1
    chosen = np.lib.stride_tricks.sliding_window_view(k, span).argmin(axis=1) + np.arange(len(k) - span + 1)
    first = np.flatnonzero(np.diff(chosen, prepend=-1))
    return k[chosen[first]], first, np.diff(first, append=len(chosen))


def spans(h: np.ndarray, first: np.ndarray, count: np.ndarray, window: int, chosen: np.ndarray) -> np.ndarray:
    """A hash of all words that the windows of each run cover, and of where the anchor stands among them."""
    if not len(first):
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(BASE, len(h)), dtype=np.uint64)])
        last = first + count + window - 1
        body = (sums[last] - sums[first]) * powers(BASE_INVERSE, int(first.max()) + 1)[first]
        return mix(mix(body) ^ chosen ^ (count.astype(np.uint64) * np.uint64(BASE)))


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """anchor, span, doc_id, tkey, first, n: a row for every run of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in (s for batch in batches for s in slices(batch)):
            found = []
            for text in utf8(b):
                h = hashed(memo, text.split())
                k, first, count = runs(h, window, anchor)
                found.append((k, spans(h, first, count, window, k), first, count))
            times = [len(x[0]) for x in found]
            k, span, first, count = (np.concatenate(c) for c in zip(*found, strict=True))
            doc, key = (np.repeat(b.column(c).fill_null(0).to_numpy(zero_copy_only=False), times) for c in ("doc_id", "tkey"))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(span.view(np.int64)), pa.array(doc), pa.array(key), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], ["anchor", "span", "doc_id", "tkey", "first", "n"])

    return docs.mapInArrow(run, "anchor long, span long, doc_id long, tkey long, first int, n int")


def windows(docs: DataFrame, window: int) -> DataFrame:
    """Of texts with runs (arrays of first, n, and of the number of texts with the run's span): the windows' hashes with those numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for b in (s for batch in batches for s in slices(batch)):
            for text, found in zip(utf8(b), b.column("runs").to_pylist(), strict=True):
                w = grams(hashed(memo, text.split()), window)
                first, n, times, anchor, span = (np.array([r[c] for r in found], np.int64) for c in ("first", "n", "times", "anchor", "span"))
                at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(w[at].view(np.int64)), pa.array((at - np.repeat(first, n)).astype(np.int32)), *(pa.array(np.repeat(c, n)) for c in (times, anchor, span))], ["window", "delta", "times", "anchor", "span"])

    return docs.select("text", "runs").mapInArrow(run, "window long, delta int, times long, anchor long, span long")


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, tkey, parts: for each document with repeats, the ranges of words (start, end) that repeated windows cover.

    A null doc_id counts as 0 here. A document that the table holds several times, alike in id and text, repeats itself.
    """
    text = keyed(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))
    every = anchors(text, window, anchor)
    met = cut(every.groupBy("anchor").agg(F.count("*").alias("times"), F.min("span").alias("lo"), F.max("span").alias("hi")).filter("times > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("alike")), "seeds")
    seeds = cut(every.join(met, "anchor"), "occurrences")
    sure = seeds.filter("alike").select("doc_id", "tkey", "first", F.expr("first + n - 1").alias("last"))
    differ = seeds.filter("NOT alike")
    kinds = differ.groupBy("anchor", "span").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "tkey", "first", "n")).alias("of"))
    asked = kinds.select("anchor", "span", "times", "of.*").groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("first", "n", "times", "anchor", "span")).alias("runs"))
    # Rows of one document that repeat would be asked several times.
    texts = text.join(asked, ["doc_id", "tkey"]).dropDuplicates(["doc_id", "tkey"])
    shown = cut(windows(texts, window), "windows")
    again = shown.groupBy("window").agg(F.sum("times").alias("total")).filter("total > 1").select("window")
    hits = shown.join(again, "window").groupBy("anchor", "span").agg(F.sort_array(F.collect_set("delta")).alias("deltas"))
    found = differ.join(cut(hits, "extended"), ["anchor", "span"]).select("doc_id", "tkey", F.explode("deltas").alias("delta"), "first").select("doc_id", "tkey", (F.col("first") + F.col("delta")).alias("first"), (F.col("first") + F.col("delta")).alias("last"))
    ranges = sure.unionByName(found).select("doc_id", "tkey", F.struct(F.col("first").alias("start"), (F.col("last") + window).alias("end")).alias("part"))
    return ranges.groupBy("doc_id", "tkey").agg(F.collect_set("part").alias("parts"))


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every document, without the words in the ranges found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch)):
            rows = []
            for doc, text, parts in zip(b.column("own_id").to_pylist(), utf8(b), b.column("parts").to_pylist(), strict=True):
                words = text.split()
                inside = np.zeros(len(words) + 1, np.int64)
                if parts:
                    edges = np.array([(p["start"], p["end"]) for p in parts])
                    np.add.at(inside, edges[:, 0], 1)
                    np.add.at(inside, edges[:, 1], -1)
                keep = np.cumsum(inside[:-1]) == 0
                kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k] if parts else words)
                rows.append((doc, len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    text = keyed(docs).withColumn("own_id", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))
    return text.join(found, ["doc_id", "tkey"], "left").select("own_id", "text", "parts").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Every document without the words that windows cover which also start elsewhere.

    Null and empty texts have no words and stay as they are; rows equal in id and text count as repeats of each other; texts
    shorter than a window lose nothing; an empty table gives no rows; other columns than doc_id and text are ignored.
    """
    return remove(docs, cut(repeats(docs, window, anchor), "repeats"))
