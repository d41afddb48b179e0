"""Suffix-array dedup: bytes that a repeated string of a set length covers go, where it also starts in a document of smaller id.

Every string of that length has the least hash of its short grams as its code, so equal strings have equal codes wherever they
stand, and stretches of a text share one. Codes are counted over all documents first; only stretches whose code stands in two
documents or more are sent on, to shards by code, so that equal strings meet in one shard.

A shard is sorted by external induced sorting. The leftmost S-type suffixes (of which each has a larger one before it) are
named by the substrings between them and ranked from the reduced string of their names; ranks are asked only as deep as the
strings are long. From them the larger suffixes are induced in one sweep upwards and the smaller ones in one sweep downwards. Both
sweeps take suffixes from queues by first byte, with the length of the prefix that each shares with the one before it; a shared
prefix grows by one byte with each step to the left, as the least of all between. Queues that are too large for memory are kept
on disk until their byte is due.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, cut_clean, keyed, mix, portions, slices, utf8

#: Bytes of a string, and of the grams that give its code.
LENGTH, GRAM = 50, 24
#: Strings in a row of one stretch, at most.
STRETCH = 64
#: Bytes of text whose codes one task counts, and bytes of stretches in one shard.
PART_BYTES, SHARD_BYTES = 48_000_000, 8_000_000
#: Documents whose met stretches one task gathers.
BUCKET_ROWS = 20_000
#: Occurrences of a code beyond which its strings are dealt out one by one, by a hash of each.
HOT = 1 << 15
#: Bytes of queues that one sort holds in memory.
QUEUE_BYTES = 64 << 20
CODE_BYTES = 5
#: A null doc_id counts as the largest.
LAST = (1 << 63) - 1
#: Bytes of UTF-8 plus one are below this.
PAD = 0xFF


def gram_hashes(v: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from each place, by doubling."""
    with np.errstate(over="ignore"):
        part = mix(np.arange(256, dtype=np.uint64) + np.uint64(BASE))[v]
        out, have, width = None, 0, 1
        while have < n:
            if n & width:
                if out is None:
                    out = part
                else:
                    m = len(part) - have
                    out = out[:m] * np.uint64(pow(BASE, width, 1 << 64)) + part[have : have + m]
                have += width
            if have < n:
                part = part[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + part[width:]
                width *= 2
        out = out[: len(v) - n + 1]
        return (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def least_of(h: np.ndarray, span: int) -> np.ndarray:
    """The least of span entries from each place."""
    width = 1
    while width * 2 <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (span - width)], h[span - width :]) if span > width else h


def stretches(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch: text, first byte, strings that start in a row from there, and code; and the texts' own first bytes in a row."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    strings = np.maximum(sizes - length + 1, 0)
    if not strings.any():
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64), begin)
    code = least_of(gram_hashes(np.frombuffer(b"".join(texts), np.uint8), gram), length - gram + 1)
    text = np.repeat(np.arange(len(texts)), strings)
    at = np.arange(len(text)) - np.repeat(np.cumsum(strings) - strings, strings)  # within the text
    code = code[begin[text] + at]
    new = np.flatnonzero((at == 0) | np.append(True, code[1:] != code[:-1]))
    count = np.diff(new, append=len(code))
    pieces = -(-count // STRETCH)
    each = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(new, pieces) + each * STRETCH
    return text[start], at[start], np.minimum(np.repeat(count, pieces) - each * STRETCH, STRETCH), mix(code[start]), begin


class Queues:
    """For each byte the suffixes that wait for it, in order, each with what it shares with the one before. Too many go to disk."""

    def __init__(self, most: int):
        self.most, self.held = most, 0
        self.waiting: list[list] = [[] for _ in range(256)]
        self.file = None

    def put(self, byte: int, at: np.ndarray, shared: np.ndarray) -> None:
        self.waiting[byte].append((at, shared))
        self.held += at.nbytes + shared.nbytes
        if self.held > self.most:
            if self.file is None:
                self.file = tempfile.TemporaryFile(prefix="queues-")
            for parts in self.waiting:
                for i, part in enumerate(parts):
                    if isinstance(part[0], np.ndarray):
                        place = self.file.seek(0, 2)
                        self.file.write(part[0].tobytes())
                        self.file.write(part[1].tobytes())
                        parts[i] = (place, len(part[0]))
            self.held = 0

    def take(self, byte: int) -> tuple[np.ndarray, np.ndarray]:
        parts, self.waiting[byte] = self.waiting[byte], []
        for i, part in enumerate(parts):
            if isinstance(part[0], np.ndarray):
                self.held -= part[0].nbytes + part[1].nbytes
            else:
                self.file.seek(part[0])
                parts[i] = (np.frombuffer(self.file.read(4 * part[1]), np.int32), np.frombuffer(self.file.read(part[1]), np.uint8))
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.empty(0, np.int32), np.empty(0, np.uint8))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Sorter:
    """Induced sorting of the suffixes of t, bytes that 0 parts and ends; order and shared prefixes hold to depth bytes."""

    def __init__(self, t: np.ndarray, depth: int, most: int = QUEUE_BYTES):
        self.t, self.depth, self.most = t, depth, most
        n = len(t)
        padded = np.concatenate([t, np.zeros(depth + 16, np.uint8)])
        word = np.zeros(n + depth + 8, np.uint64)
        for k in range(8):  # the eight bytes from each place, the first one highest
            word <<= np.uint64(8)
            word |= padded[k : k + len(word)]
        self.word = word
        step = np.sign(t[1:].astype(np.int16) - t[:-1]).astype(np.int8)
        step = np.append(step, np.int8(-1))  # the end is smaller than all bytes
        known = np.where(step != 0, np.arange(n), n)
        known = np.minimum.accumulate(known[::-1])[::-1]
        self.small = step[known] > 0  # S-type
        self.small |= t == 0
        self.seeds = np.flatnonzero(self.small & np.append(False, ~self.small[:-1]))

    def names(self) -> np.ndarray:
        """For each seed how many have a smaller substring, up to and with the next seed. Of two that begin alike the longer is smaller."""
        s = self.seeds
        size = np.append(s[1:] - s[:-1] + 1, 1)
        size[self.t[s] == 0] = 1
        rank, of, c = np.zeros(len(s), np.int64), np.arange(len(s)), 0
        while len(of):
            part = self.word[np.minimum(s[of] + 8 * c, len(self.word) - 1)]
            left = np.clip(size[of] - 8 * c, 0, 8)
            fill = np.where(left >= 8, np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(left * 8, 63).astype(np.uint64))
            part = np.where(left == 0, np.uint64(0xFFFFFFFFFFFFFFFF), part | fill)
            of = of[refine(rank, of, part)]
            c += 1
            more = np.zeros(len(s), bool)  # ranks among which some substring goes on
            more[rank[of[size[of] > 8 * c]]] = True
            of = of[more[rank[of]]]
        return rank

    def ranks(self) -> np.ndarray:
        """The rank of each seed's suffix, by doubling over the reduced string; equal ranks agree in depth bytes or up to their end."""
        rank = self.names()
        ends, width = self.t[self.seeds] == 0, 1
        of = np.flatnonzero(~ends)
        while len(of) and 2 * width <= self.depth:
            again = np.zeros(len(rank) + 1, np.int64)
            again[rank[of] + 1] = 1
            times = np.bincount(rank[of], minlength=len(rank))
            of = of[times[rank[of]] > 1]
            if not len(of):
                break
            last = np.minimum(of + width, len(rank) - 1)
            gone = np.cumsum(ends)
            over = gone[last] - ends[last] > gone[of]  # the text ended before; what was compared held its end
            refine(rank, of, np.where(over, 0, rank[last]).astype(np.uint64))
            width *= 2
        return rank

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that pairs of suffixes have in common, depth at most."""
        out, of = np.zeros(len(a), np.uint8), np.arange(len(a))
        for k in range(0, self.depth, 8):
            differ = self.word[a[of] + k] ^ self.word[b[of] + k]
            same = differ == 0
            high = differ >> np.uint64(32)
            bits = np.frexp(np.where(high > 0, high, differ & np.uint64(0xFFFFFFFF)).astype(np.float64))[1] + 32 * (high > 0)
            lead = (64 - bits) // 8
            out[of] = np.minimum(self.depth, k + np.where(same, 8, lead))
            of = of[same]
            if not len(of):
                break
        return out

    def sweep(self, up: bool, blocks: Iterator, queues: Queues) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Induces from blocks of sources (byte, suffixes, shared, whether they are of the type that is induced) and from what it induces."""
        t = self.t
        carry = np.full(256, self.depth, np.uint8)
        for byte, sources in blocks:
            made_at, made_shared = [], []
            at, shared = queues.take(byte)
            if len(at):
                shared[0] = 0
            own = True
            while True:
                if own and not len(at):
                    own = False
                    at, shared = sources(made_at[-1][-1] if made_at else None)
                    if not len(at):
                        break
                if own:
                    made_at.append(at)
                    made_shared.append(shared)
                before = at - 1
                first = t[np.maximum(before, 0)]
                keep = (first >= byte if own else first > byte) if up else (first <= byte if own else first < byte)
                keep &= (before >= 0) & (first > 0)
                of = np.flatnonzero(keep)
                of = of[np.argsort(first[of], kind="stable")]
                to = first[of]
                edge = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(of) else of
                table = [shared]
                while 2 << len(table) - 1 <= len(shared):
                    half = 1 << len(table) - 1
                    table.append(np.minimum(table[-1][:-half], table[-1][half:]))
                low = np.empty(len(of), np.int64)
                low[1:] = of[:-1] + 1
                low[edge] = 0
                gained = range_least(table, low, of)
                gained[edge] = np.minimum(gained[edge], carry[to[edge]])
                carry = np.minimum(carry, table[-1].min())
                if len(of):
                    last = np.append(edge[1:] - 1, len(of) - 1)
                    rest = of[last] + 1
                    carry[to[edge]] = self.depth
                    some = rest < len(shared)
                    carry[to[edge][some]] = range_least(table, rest[some], np.full(some.sum(), len(shared) - 1))
                gained = np.minimum(gained.astype(np.int16) + 1, self.depth).astype(np.uint8)
                new_at, new_shared = at[:0], shared[:0]
                for b, lo, hi in zip(to[edge].tolist(), edge.tolist(), np.append(edge[1:], len(of)).tolist() if len(of) else [], strict=True):
                    if b == byte and own:
                        new_at, new_shared = before[of[lo:hi]], gained[lo:hi]
                    else:
                        queues.put(b, before[of[lo:hi]], gained[lo:hi])
                if not own:
                    break
                at, shared = new_at, new_shared
            yield byte, (np.concatenate(made_at) if made_at else np.empty(0, np.int32)), (np.concatenate(made_shared) if made_shared else np.empty(0, np.uint8))
        queues.close()

    def sorted(self, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, and what each shares with the one before. wanted: of each seed, whether anything is to be induced from it."""
        t, seeds = self.t, self.seeds
        rank = self.ranks()
        of = np.arange(len(seeds)) if wanted is None else np.flatnonzero(wanted)
        of = of[np.argsort(rank[of], kind="stable")]
        at = seeds[of].astype(np.int32)
        near = np.append(np.uint8(0), self.shared(at[:-1], at[1:])) if len(at) else np.empty(0, np.uint8)
        edges = np.searchsorted(t[at], np.arange(257))

        def upper(byte: int):
            def sources(last):
                lo, hi = edges[byte], edges[byte + 1]
                own, shared = at[lo:hi], near[lo:hi].copy()
                if len(own):
                    shared[0] = 0 if last is None else self.shared(np.array([last]), own[:1])[0]
                return own, shared

            return byte, sources

        large = {b: (x, y) for b, x, y in self.sweep(True, (upper(b) for b in range(256)), Queues(self.most))}

        def lower(byte: int):
            def sources(last):
                own, shared = large[byte]
                own = own[::-1]
                back = np.append(np.uint8(0), shared[:0:-1]) if len(own) else shared
                if len(own) and last is not None:
                    back[0] = self.shared(np.array([last]), own[:1])[0]
                return own, back

            return byte, sources

        small = {b: (x, y) for b, x, y in self.sweep(False, (lower(b) for b in range(255, -1, -1)), Queues(self.most))}
        out_at, out_shared = [], []
        for b in range(256):
            up, up_shared = large[b]
            down, down_shared = small[b]
            down, between = down[::-1], down_shared[:0:-1]
            if len(down):
                seam = self.shared(up[-1:], down[:1]) if len(up) else np.zeros(1, np.uint8)
                down_shared = np.concatenate([seam, between])
            out_at += [up, down]
            out_shared += [up_shared, down_shared]
        return np.concatenate(out_at), np.concatenate(out_shared)


def refine(rank: np.ndarray, of: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Splits ranks of the members of by key; every rank's members are all there or none. Gives the members' order."""
    order = np.lexsort((key, rank[of]))
    r, k = rank[of][order], key[order]
    group = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else order
    new = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))) if len(r) else order
    base = np.repeat(group, np.diff(group, append=len(r)))
    first = np.repeat(new, np.diff(new, append=len(r)))
    rank[of[order]] = r + first - base
    return order


def range_least(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least entry from lo to hi, both in; table[k] has the least of 2**k entries from each place."""
    out = np.empty(len(lo), np.uint8)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    for k in np.unique(level).tolist():
        of = np.flatnonzero(level == k)
        out[of] = np.minimum(table[k][lo[of]], table[k][hi[of] - (1 << k) + 1])
    return out


def packed(data: bytes) -> pa.Array:
    return pa.array([zstandard.ZstdCompressor(level=1).compress(data)], pa.binary())


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each part that has entries, their places in order."""
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)).tolist():
        yield p, order[edges[p] : edges[p + 1]]


def dealt(code: np.ndarray, parts: int) -> np.ndarray:
    return ((code >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def coded(texts: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """For each part the codes of the stretches that some documents have (CODE_BYTES each) and their numbers within their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in portions(batch, 1 << 21)):
            keys, once = np.unique(b.column("key").to_numpy(zero_copy_only=False), return_index=True)  # rows that repeat wholly count once
            found = utf8(b)
            text, _, _, code, _ = stretches([found[i] for i in once.tolist()], length, gram)
            number = (np.arange(len(text)) - np.searchsorted(text, text)).astype(np.uint32)
            short = code.view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES]
            for p, of in by_part(dealt(code, parts), parts):
                docs, times = np.unique(text[of], return_counts=True)
                row = [pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys[docs], times.astype(np.int32), short[of])), packed(number[of].tobytes())]
                yield pa.RecordBatch.from_arrays(row, ["part", "keys", "times", "codes", "numbers"])

    return texts.select("key", "text").mapInArrow(run, "part int, keys binary, times binary, codes binary, numbers binary").repartitionById(parts, F.col("part"))


def met(codes: DataFrame, buckets: int, hot: int) -> DataFrame:
    """For each bucket of documents the stretches whose code another document has too; the highest bit of a number marks codes of more than hot stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple]] = {}
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("part", "keys", "times", "codes", "numbers")), strict=True):
                by.setdefault(row[0], []).append(row[1:])
        while by:
            rows = list(zip(*by.popitem()[1], strict=True))
            key = np.repeat(np.frombuffer(b"".join(rows[0]), np.int64), np.frombuffer(b"".join(rows[1]), np.int32))
            number = np.frombuffer(b"".join(map(unpacked, rows[3])), np.uint32)
            code = np.zeros((len(number), 8), np.uint8)
            code[:, :CODE_BYTES] = np.frombuffer(b"".join(rows[2]), np.uint8).reshape(-1, CODE_BYTES)
            del rows
            code = code.reshape(-1).view(np.uint64)
            order = np.argsort(code)
            code, key, number = code[order], key[order], number[order]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            size = np.diff(first, append=len(code))
            several = np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)
            keep = np.repeat(several, size)
            number = np.where(np.repeat(size > hot, size), number | np.uint32(1 << 31), number)[keep]
            key = key[keep]
            for p, of in by_part(dealt(key.view(np.uint64), buckets), buckets):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), packed(key[of].tobytes()), packed(number[of].tobytes())], ["bucket", "keys", "numbers"])

    return codes.mapInArrow(run, "bucket int, keys binary, numbers binary").repartitionById(buckets, F.col("bucket"))


def gathered(answers: DataFrame) -> DataFrame:
    """key, numbers, n: for each document the stretches that were met, of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple]] = {}
        for b in batches:
            for bucket, keys, numbers in zip(*(b.column(c).to_pylist() for c in ("bucket", "keys", "numbers")), strict=True):
                by.setdefault(bucket, []).append((np.frombuffer(unpacked(keys), np.int64), np.frombuffer(unpacked(numbers), np.uint32)))
        while by:
            key, number = (np.concatenate(x) for x in zip(*by.popitem()[1], strict=True))
            order = np.argsort(key, kind="stable")
            key, number = key[order], number[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
            ends = np.append(first[1:], len(key))
            for at in range(0, len(first), 4096):
                lo, hi = first[at : at + 4096], ends[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(key[lo]), pa.array([number[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()), pa.array(hi - lo)], ["key", "numbers", "n"])

    return answers.mapInArrow(run, "key long, numbers binary, n long")


MEMBERS = np.dtype([("doc", "<i8"), ("tkey", "<i8"), ("start", "<u4"), ("stretch", "<u4")])


def sent(texts: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """part, bytes, counts, members: the different stretches that some documents have in a shard, strings in each, and who has them where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[dict[bytes, int], list[tuple]]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for p, (own, members) in held.items():
                counts = np.array([len(x) - length + 1 for x in own], np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), packed(b"".join(own)), pa.array([counts.tobytes()], pa.binary()), packed(b"".join(np.ascontiguousarray(np.array(members, MEMBERS)[c]).tobytes() for c in MEMBERS.names))], ["part", "bytes", "counts", "members"])
            held.clear()

        for b in (s for batch in batches for s in portions(batch, 1 << 21)):
            found = utf8(b)
            text, first, count, code, _ = stretches(found, length, gram)
            begin = np.searchsorted(text, np.arange(len(found)))
            keep, hot = np.zeros(len(text), bool), np.zeros(len(text), bool)
            for i, numbers in enumerate(b.column("numbers").to_pylist()):
                x = np.frombuffer(numbers, np.uint32)
                at = begin[i] + (x & np.uint32((1 << 31) - 1))
                keep[at] = True
                hot[at] = x >> np.uint32(31) > 0
            docs, tkeys = b.column("doc_id").to_pylist(), b.column("tkey").to_pylist()
            of = np.flatnonzero(keep)
            for i, at, n, p, alone in zip(text[of].tolist(), first[of].tolist(), count[of].tolist(), dealt(code[of], parts).tolist(), hot[of].tolist(), strict=True):
                for lo, hi in ((x, x + length) for x in range(at, at + n)) if alone else ((at, at + n + length - 1),):
                    stretch = found[i][lo:hi]
                    p = int.from_bytes(hashlib.blake2b(stretch, digest_size=8).digest(), "little") % parts if alone else p
                    own, members = held.setdefault(p, ({}, []))
                    members.append((docs[i], tkeys[i], lo, own.setdefault(stretch, len(own))))
                    size += hi - lo + 24
            if size > 24 << 20:
                yield from rows()
                size = 0
        yield from rows()

    return texts.select("doc_id", "tkey", "text", "numbers").mapInArrow(run, "part int, bytes binary, counts binary, members binary").repartitionById(parts, F.col("part"))


def removed(own: dict[bytes, int], members: np.ndarray, length: int, most: int) -> np.ndarray:
    """doc, tkey, start and end of what goes, from a shard's stretches and who has them: all that strings cover which also start in a lesser document."""
    sizes = np.array([len(x) for x in own], np.int64)
    counts = sizes - length + 1
    begin = np.cumsum(sizes + 1) - sizes - 1
    t = np.frombuffer(b"\0".join(x.translate(_SHIFT) for x in own) + b"\0", np.uint8)
    members = members[np.argsort(members["stretch"], kind="stable")]
    least = np.minimum.reduceat(members["doc"], np.searchsorted(members["stretch"], np.arange(len(own))))
    sorter = Sorter(t, length, most)
    stretch = np.searchsorted(begin, sorter.seeds, "right") - 1
    late = sorter.seeds - begin[stretch] >= counts[stretch]  # only the first seed behind a stretch's strings is needed
    wanted = ~late | ~np.append(False, late[:-1] & (stretch[1:] == stretch[:-1]))
    at, shared = sorter.sorted(wanted)
    base = np.cumsum(counts) - counts
    stretch = np.repeat(np.arange(len(own)), sizes + 1)[at]
    place = at - begin[stretch]
    use = np.flatnonzero(place < counts[stretch])
    common = np.minimum.reduceat(shared[: use[-1] + 1], np.append(0, use[:-1] + 1))
    group = np.flatnonzero(np.append(True, common[1:] < length))
    low = np.minimum.reduceat(least[stretch[use]], group)
    lowest = np.empty(counts.sum(), np.int64)
    lowest[base[stretch[use]] + place[use]] = np.repeat(low, np.diff(group, append=len(use)))
    n = counts[members["stretch"]]
    who = np.repeat(np.arange(len(members)), n)
    offset = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    gone = lowest[base[members["stretch"]][who] + offset] < members["doc"][who]
    first = np.flatnonzero(gone & np.append(True, ~gone[:-1] | (who[1:] != who[:-1])))
    last = np.flatnonzero(gone & np.append(~gone[1:] | (who[1:] != who[:-1]), True))
    out = np.empty(len(first), RANGES)
    who = who[first]
    for name in ("doc", "tkey"):
        out[name] = members[name][who]
    out["start"], out["end"] = members["start"][who] + offset[first], members["start"][who] + offset[last] + length
    return out


RANGES = np.dtype([("doc", "<i8"), ("tkey", "<i8"), ("start", "<u4"), ("end", "<u4")])
_SHIFT = bytes(min(c + 1, PAD) for c in range(256))


def decided(shards: DataFrame, buckets: int, length: int, most: int) -> DataFrame:
    """For each bucket of documents what goes, of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[tuple]] = {}
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("part", "bytes", "counts", "members")), strict=True):
                by.setdefault(row[0], []).append(row[1:])
        while by:
            own: dict[bytes, int] = {}
            every = []
            for text, counts, members in by.popitem()[1]:
                text, members = unpacked(text), unpacked(members)
                ends = np.cumsum(np.frombuffer(counts, np.uint8).astype(np.int64) + length - 1).tolist()
                number = np.array([own.setdefault(text[lo:hi], len(own)) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)])
                part = columns(members, MEMBERS)
                part["stretch"] = number[part["stretch"]]
                every.append(part)
            found = removed(own, np.concatenate(every), length, most)
            del own, every
            key = mix(found["doc"].astype(np.uint64) ^ mix(found["tkey"].astype(np.uint64)))
            for p, of in by_part(dealt(key, buckets), buckets):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), packed(b"".join(np.ascontiguousarray(found[of][c]).tobytes() for c in RANGES.names))], ["bucket", "ranges"])

    return shards.mapInArrow(run, "bucket int, ranges binary").repartitionById(buckets, F.col("bucket"))


def columns(data: bytes, kind: np.dtype) -> np.ndarray:
    """Rows of a kind, of which each column was written after the other."""
    out = np.empty(len(data) // kind.itemsize, kind)
    for c in kind.names:
        out[c] = np.frombuffer(data, kind[c], len(out), len(out) * kind.fields[c][1])
    return out


def by_document(answers: DataFrame) -> DataFrame:
    """doc_id, tkey, ranges: for each document pairs of first byte and end, of 32 bits each, that go, of all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for bucket, ranges in zip(b.column("bucket").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                by.setdefault(bucket, []).append(columns(unpacked(ranges), RANGES))
        while by:
            found = np.concatenate(by.popitem()[1])
            found = found[np.lexsort((found["start"], found["tkey"], found["doc"]))]
            new = np.flatnonzero(np.append(True, (found["doc"][1:] != found["doc"][:-1]) | (found["tkey"][1:] != found["tkey"][:-1]))) if len(found) else np.empty(0, np.int64)
            pairs = np.stack([found["start"], found["end"]], 1)
            ends = np.append(new[1:], len(found))
            for at in range(0, len(new), 4096):
                lo, hi = new[at : at + 4096], ends[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(found["doc"][lo]), pa.array(found["tkey"][lo]), pa.array([pairs[x:y].tobytes() for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())], ["doc_id", "tkey", "ranges"])

    return answers.mapInArrow(run, "doc_id long, tkey long, ranges binary")


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left, in a row) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in slices(batch)):
            out = []
            for doc, text, ranges in zip(b.column("own_id").to_pylist(), utf8(b), b.column("ranges").to_pylist(), strict=True):
                spans, kept = 0, text
                if ranges:
                    edge = np.frombuffer(ranges, np.uint32).reshape(-1, 2).astype(np.int64)
                    depth = np.cumsum(np.bincount(edge[:, 0], minlength=len(text) + 1) - np.bincount(edge[:, 1], minlength=len(text) + 1))[:-1]
                    gone = depth > 0
                    spans = int((gone & np.append(True, ~gone[:-1])).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((doc, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    text = keyed(docs).withColumn("own_id", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST)))
    return text.join(found, ["doc_id", "tkey"], "left").select("own_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, queue_bytes: int = QUEUE_BYTES, part_bytes: int = PART_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every document without the bytes that strings of this length cover which also start in a document of smaller doc_id.

    Texts are taken as UTF-8, whole, whatever their length; null and empty ones have no bytes; texts shorter than a string lose
    nothing. A null doc_id counts as the largest, and rows of one doc_id take nothing from one another, so rows that repeat wholly
    keep the same; an empty table gives no rows; other columns are ignored.
    """
    texts = keyed(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST))).withColumn("key", F.xxhash64("doc_id", "text"))
    rows, total = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = 1 + rows // BUCKET_ROWS
    same = cut_clean(gathered(met(coded(texts, 1 + total // part_bytes, length, gram), buckets, hot)), "met")
    asked = same.agg(F.sum("n")).first()[0] or 0
    own = texts.join(same.drop("n"), "key")
    shards = sent(own, 1 + asked * (length + (length - gram + 1) // 2) // shard_bytes, length, gram)
    return without(docs, cut_clean(by_document(decided(shards, buckets, length, queue_bytes)), "removed"))
