"""Best-fit packing of documents into sequences: pattern packing by non-negative least squares.

The lengths' histogram has one row for each length, so it is of fixed size whatever the number of documents. The driver turns
it into a plan (which lengths share a sequence, how often); tasks then look up each piece's place in the plan by its rank
among the pieces of its length. No text is shuffled.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_count_partitions, slices, utf8
from .tokens import WordEncoder, encoder

#: Lengths are rounded up to this many classes for the fit; exact lengths are used in what follows it.
CLASSES = 256
#: Documents in a pattern at most.
PATTERN_DOCS = 3
#: Pieces of one length that one task ranks, on average.
RANKED_ROWS = 20_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document. A null or empty text is the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(WordEncoder, tokenizer).encode, np.asarray([end_id], "<u4").tobytes()
        for batch in (s for b in batches for s in slices(b)):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(utf8(batch)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def patterns(classes: int, docs: int = PATTERN_DOCS) -> list[tuple[int, ...]]:
    """All ways to fill a sequence with up to so many documents, as classes of lengths in descending order."""
    out = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if not left:
            out.append(head)
        elif len(head) < docs:
            most = min(left, head[-1] if head else left)
            for x in range(most, 0, -1):
                if x * (docs - len(head)) < left:
                    break
                grow((*head, x), left - x)

    grow((), classes)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    small = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        w = a.T @ (b - a @ x)
        w[on] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= small:
            break
        on[j] = True
        while True:
            at = np.flatnonzero(on)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min() > 0:
                break
            bad = s <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300))
            x[at] += step * (s - x[at])
            off = at[bad & (x[at] <= 1e-9)] if (bad & (x[at] <= 1e-9)).any() else at[bad][:1]
            x[off], on[off] = 0, False
            if not on.any():
                break
        x[:] = 0
        if on.any():
            x[at] = np.maximum(s, 0)
    return x


def plan(histogram: dict[int, int], size: int, classes: int = CLASSES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how many sequences hold just those) for all pieces of the histogram.

    Repeat counts of the patterns are fitted to the histogram of classes, rounded, and held to what is there; exact lengths,
    longest first, then take the patterns' places. What is left, longest first, goes where it leaves the least room; last, sequences
    with room are dissolved and packed again where that makes fewer of them.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    done: list[tuple[tuple[int, ...], int]] = []
    if size in left:
        done.append(((size,), left.pop(size)))
    classes = min(classes, size)
    step = -(-size // classes)
    classes = size // step
    queues: dict[int, list[list[int]]] = defaultdict(list)
    for n in sorted(left, reverse=True):
        queues[-(-n // step)].append([n, left[n]])
    have = {k: sum(c for _, c in q) for k, q in queues.items()}
    usable = [p for p in patterns(classes) if len(p) > 1 and all(k in have for k in p)]
    room: dict[int, list[list]] = defaultdict(list)  # by what is free: groups [lengths, count]
    if usable:
        rows = sorted(have)
        at = {k: i for i, k in enumerate(rows)}
        a = np.zeros((len(rows), len(usable)))
        for j, p in enumerate(usable):
            for k in p:
                a[at[k], j] += 1
        b = np.array([have[k] for k in rows], float)
        scale = max(b.max(), 1.0)
        # Rows of long documents weigh more: short ones that are left over fit anywhere.
        weight = np.sqrt(np.array(rows, float) / classes)
        x = nnls(a * weight[:, None], b / scale * weight) * scale
        for j in sorted(np.flatnonzero(x > 0), key=lambda j: -x[j]):
            p = usable[j]
            need = {k: p.count(k) for k in p}
            count = min(int(x[j] + 0.5), *(have[k] // m for k, m in need.items()))
            for k, m in need.items():
                have[k] -= m * count
            while count > 0:
                t = min([count, *(queues[k][0][1] // m for k, m in need.items())])
                taken = []
                if t:
                    for k, m in need.items():
                        taken += [queues[k][0][0]] * m
                        queues[k][0][1] -= m * t
                else:  # places of one class that straddle two lengths
                    t = 1
                    for k, m in need.items():
                        for _ in range(m):
                            taken.append(queues[k][0][0])
                            queues[k][0][1] -= 1
                            if not queues[k][0][1]:
                                queues[k].pop(0)
                for k in need:
                    while queues[k] and not queues[k][0][1]:
                        queues[k].pop(0)
                count -= t
                room[size - sum(taken)].append([tuple(taken), t])
    fill({n: c for q in queues.values() for n, c in q if c}, room, size)
    return tightened(done + [(g, c) for groups in room.values() for g, c in groups if c], size)


def fill(left: dict[int, int], room: dict[int, list[list]], size: int) -> None:
    """Puts pieces, longest first, where they leave the least room; room: by what is free, groups [lengths, count]."""
    frees = sorted(room)
    for n, count in sorted(left.items(), reverse=True):
        while count:
            i = bisect.bisect_left(frees, n)
            if i == len(frees):
                k = min(size // n, count)
                t = count // k
                group = [(n,) * k, t]
                free, count = size - n * k, count - t * k
            else:
                free = frees[i]
                old = room[free][-1]
                t = min(count, old[1])
                old[1] -= t
                if not old[1]:
                    room[free].pop()
                    if not room[free]:
                        del room[free]
                        frees.pop(i)
                group, count, free = [(*old[0], n), t], count - t, free - n
            if free not in room:
                bisect.insort(frees, free)
            room[free].append(group)


def tightened(made: list[tuple[tuple[int, ...], int]], size: int) -> list[tuple[tuple[int, ...], int]]:
    """The sequences, or fewer: those with more than some room are dissolved and packed again, down to ever less room; then those
    with room together with a small share of the full ones, those of the most pieces first. Most full patterns stay as fitted."""
    total = lambda groups: sum(c for _, c in groups)
    least = -(-sum(sum(g) * c for g, c in made) // size)
    for most, share in ((size // 4, 0), (size // 16, 0), (size // 64, 0), (size // 256, 0), (0, 0), *((0, 1 / k) for k in (256, 64, 16, 8, 4))):
        if total(made) <= least:
            break
        pool: dict[int, int] = defaultdict(int)
        stay = []
        more = int(total(made) * share)
        for g, c in sorted(made, key=lambda x: -len(x[0])):
            loose = c if size - sum(g) > most else min(c, more) if len(g) > 1 else 0
            if loose and size - sum(g) <= most:
                more -= loose
            for n in g:
                pool[n] += loose
            if c > loose:
                stay.append((g, c - loose))
        room: dict[int, list[list]] = defaultdict(list)
        fill({n: c for n, c in pool.items() if c}, room, size)
        made = min(made, stay + [(g, c) for groups in room.values() for g, c in groups if c], key=total)
    return made


def places(made: list[tuple[tuple[int, ...], int]], size: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by the first two: pieces of a length from that rank on go to the
    sequences from that number on."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, count in made:
        at = 0
        for n in lengths:
            rows.append((n, rank[n], sequence, at))
            rank[n] += count
            at += n
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Packs all documents into sequences of at most `size` tokens, as few as pattern packing finds.

    Result: one row for each piece, with sequence_id and offset. Only documents longer than `size` are cut. Null and empty texts
    hold the end id alone and are packed like others; rows that repeat are packed once each; an empty table gives no rows;
    other columns than doc_id and text are ignored. Pieces that equal each other in all columns may change places.
    """
    rows = cut(pieces(docs, tokenizer, size, end_id).withColumn("at", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    table = places(plan(counts, size), size)
    buckets = row_count_partitions(sum(counts.values()), RANKED_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "at"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "at")
    ranked = rows.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # a few rows for each length at most, whatever the input

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = shared.value.T
        key = length << 44 | first
        for b in batches:
            n, r = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            i = np.searchsorted(key, n << 44 | r, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[i] + r - first[i]), pa.array(offset[i])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(seat, f"{PIECE}, sequence_id long, offset long")
