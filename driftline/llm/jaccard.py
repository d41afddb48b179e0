"""Jaccard join of documents on sets of word n-grams: a size-aware heavy-light join.

Small (light) sets meet on enumerated subsets of fixed size: where at most one element may be missing, a set of n elements is
listed under itself and under its n subsets of n - 1. Large (heavy) sets meet in inverted lists of single elements. Linked sets
share most of their elements, so they share one of their first few in any order that is the same for all sets; a set is listed
under those alone. The order is from rare to frequent, as a sketch that counts all elements of all documents tells them, which
keeps the lists short; its errors change the order and so the work, but no result. The size that divides light from heavy is the
one of least cost: enumerated subsets on the one hand, the measured lengths of the lists to be scanned on the other.

Lists are scanned, not paired. Each member is first held against the list's hub, its member that is in most lists: in a group
of edited copies that is the text that the others were made from. Only where a list still spans several components, members of
different components are held against each other where their sizes and short sketches do not rule a link out. Copies have one
node, so they are never expanded. All links between different sets are found; those inside a component may be left unchecked, as
they join nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, WordHash, cut, grams, hashed, keyed, mix, slices, spare, text_key, utf8
from .graph import components

#: Two sets link at this many hundredths of common among all elements.
SIMILARITY = 90
#: What a comparison with a member of an inverted list costs against the listing of a key.
SCAN_COST = 0.5
#: Counters of the sketch of element frequencies: of fixed size, whatever the input. Twice the counters, about a seventh off the noise in the frequencies.
COUNTERS = 1 << 20
#: The sketch is added up in so many pieces.
PIECES = 64
#: Bits of a short sketch, which lists carry, as 64-bit numbers.
SHORT = ("bits_0", "bits_1", "bits_2", "bits_3")
#: Up to so many ids of texts (24 bytes each) are sent to all executors to pick the texts; of more, the texts are shuffled.
SENT_ROWS = 500_000
#: Nodes that a task remembers in order to list copies once.
SEEN = 500_000


def shingles(memo: WordHash, text: bytes, n: int) -> np.ndarray:
    """The set of a text's n-grams of words, as sorted hashes; with fewer words, the whole sequence as one."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashed(memo, words)
    if len(h) < n:
        return mix(grams(h, len(h)) ^ np.uint64(len(h)))
    s = np.sort(grams(h, n))
    return s[np.append(True, s[1:] != s[:-1])]


def node_of(s: np.ndarray) -> int:
    """One number for a set, whatever its order (as a signed 64-bit integer)."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(BASE)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def far(a: int, b: int, percent: int) -> int:
    """In how many elements linked sets of these sizes may differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def light_limit(percent: int) -> int:
    """The largest size at which two linked sets differ in one element at most."""
    n = 1
    while far(n + 1, n + 1, percent) <= 1:
        n += 1
    return n


def prefix_length(n: int, percent: int) -> int:
    """Linked sets share an element among the first so many of either, in any one order: they have percent of it in common."""
    return n - -(-n * percent // 100) + 1


def load(counts: np.ndarray) -> float:
    """What a counter holds of elements other than the one that is looked up, on average."""
    return float(counts.sum(dtype=np.float64)) / len(counts)


class Lists:
    """Which keys a set is listed under. counts: how often the elements of each counter occur."""

    def __init__(self, percent: int, boundary: int, counts: np.ndarray | None = None):
        self.percent, self.boundary = percent, boundary
        self.counts = np.zeros(1, np.uint32) if counts is None else counts

    def prefix(self, s: np.ndarray) -> np.ndarray:
        """The rarest elements of a set; those of equal counters in the order of their hashes."""
        spread = mix(s)
        often = self.counts[(spread & np.uint64(len(self.counts) - 1)).astype(np.int64)].astype(np.uint64)
        rank = np.minimum(often, np.uint64((1 << 24) - 1)) << np.uint64(40) | spread >> np.uint64(24)
        n = prefix_length(len(s), self.percent)
        return s if n >= len(s) else s[np.lexsort((s, rank))[:n]]

    def heavy(self, s: np.ndarray) -> np.ndarray:
        return mix(self.prefix(s) ^ np.uint64(BASE))

    def light(self, s: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            each = mix(s ^ np.uint64(BASE))
            whole = each.sum(dtype=np.uint64)
            own = np.array([whole + np.uint64(len(s) << 50)], np.uint64)
            less = whole - each + np.uint64(len(s) - 1 << 50)
        return mix(np.concatenate([own, less if 100 * (len(s) - 1) >= self.percent * len(s) else less[:0]]) ^ np.uint64(0xA5A5))

    def keys(self, s: np.ndarray) -> np.ndarray:
        out = []
        if len(s) <= self.boundary:
            out.append(self.light(s))
        if 100 * len(s) >= self.percent * (self.boundary + 1):
            out.append(self.heavy(s))
        return np.concatenate(out)


def small_limit(percent: int) -> int:
    """Up to this size the boundary decides how a set is listed."""
    return 100 * (light_limit(percent) + 1) // percent + 1


def boundary(sizes: dict[int, tuple[int, float]], percent: int) -> int:
    """The largest light size, of all that enumeration is exact for, with the least cost.

    sizes: of each small size, how many sets there are and how long all the lists are, together, that they would be in as heavy ones.
    """
    light = {n: n + 1 if 100 * (n - 1) >= percent * n else 1 for n in range(1, light_limit(percent) + 1)}
    heavy = lambda n, c, long: c * prefix_length(n, percent) + SCAN_COST * long
    cost = lambda b: sum((c * light[n] if n <= b else 0) + (heavy(n, c, long) if 100 * n >= percent * (b + 1) else 0) for n, (c, long) in sizes.items())
    return min(range(light_limit(percent) + 1), key=lambda b: (cost(b), b))


def sets(text: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, tkey, node, size, sketch, short sketch and, of a small set, its elements, of every document; besides them rows
    with nothing but a piece of the sketch of element frequencies and its number, a few from each task."""
    names = ["doc_id", "tkey", "node", "size", "sketch", *SHORT, "small", "piece", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * len(SHORT), pa.binary(), pa.int32(), pa.binary()]
    most = small_limit(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = WordHash(), np.zeros(COUNTERS, np.uint32)
        for b in (s for batch in batches for s in slices(batch)):
            made = [shingles(memo, t, n) for t in utf8(b)]
            for s in made:  # a text's own elements are different from each other, but not always their counters
                np.add.at(counts, (mix(s) & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
            short = np.array([np.frombuffer(parities(s, 64 * len(SHORT)), np.int64) for s in made]).reshape(-1, len(SHORT))
            small = [s.tobytes() if 0 < len(s) <= most else None for s in made]
            cols = [b.column("doc_id"), b.column("tkey"), [node_of(s) for s in made], [len(s) for s in made], [sketch_of(s) for s in made], *short.T.copy(), small, [None] * len(made), [None] * len(made)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        held = [(i, piece.tobytes()) for i, piece in enumerate(np.split(counts, PIECES)) if piece.any()]
        if held:
            cols = [*[[None] * len(held)] * (len(names) - 2), [i for i, _ in held], [p for _, p in held]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return text.mapInArrow(run, "doc_id long, tkey long, node long, size long, sketch binary, " + ", ".join(f"{c} long" for c in SHORT) + ", small binary, piece int, counts binary")


def frequencies(made: DataFrame) -> np.ndarray:
    """The sketch of element frequencies, of COUNTERS entries. made: piece, counts of each task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, counts in zip(b.column("piece").to_pylist(), b.column("counts").to_pylist(), strict=True):
                held[piece] = held.get(piece, 0) + np.frombuffer(counts, np.uint32).astype(np.uint64)
        for piece, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], pa.binary())], ["piece", "counts"])

    # Some pieces in each task: tasks first add up what they have read, so that a piece's rows are as few as the tasks.
    some = made.mapInArrow(add, "piece int, counts binary").repartition(min(PIECES, 8), "piece").mapInArrow(add, "piece int, counts binary")
    out = np.zeros(COUNTERS, np.uint32)
    each = COUNTERS // PIECES
    for r in some.toLocalIterator():
        out[r["piece"] * each : (r["piece"] + 1) * each] = np.frombuffer(r["counts"], np.uint32)
    return out


def measured(small: DataFrame, percent: int, counts: Broadcast) -> dict[int, tuple[int, float]]:
    """Of each small size, how many sets there are, and the lengths of the lists that they would be in. small: node, small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(percent, 0, counts.value)
        noise = load(lists.counts)
        for b in batches:
            made = [np.frombuffer(x, np.uint64) for x in b.column("small").to_pylist()]
            long = [float(np.maximum(lists.counts[(mix(lists.prefix(s)) & np.uint64(COUNTERS - 1)).astype(np.int64)] - noise, 1).sum()) for s in made]
            yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in made], pa.int32()), pa.array(long, pa.float64())], ["size", "long"])

    rows = small.select("small").mapInArrow(run, "size int, long double").groupBy("size").agg(F.count("*").alias("n"), F.sum("long").alias("long"))
    return {r["size"]: (r["n"], r["long"]) for r in rows.collect()}  # a row for each small size


def listed(text: DataFrame, n: int, percent: int, boundary: int, counts: Broadcast) -> DataFrame:
    """node, keys (64 bits each) of the sets. Copies within a task are listed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, lists = WordHash(), set(), Lists(percent, boundary, counts.value)
        for b in (s for batch in batches for s in slices(batch)):
            nodes, keys = [], []
            for t in utf8(b):
                s = shingles(memo, t, n)
                node = node_of(s)
                if not len(s) or node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                nodes.append(node)
                keys.append(lists.keys(s).view(np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            of = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), of], ["node", "keys"])

    return text.select("text").mapInArrow(run, "node long, keys array<long>")


def parities(s: np.ndarray, bits: int) -> bytes:
    """Bits that each element with their place flips: the bits in which two such sketches differ are at most as many as the
    elements in which the sets do."""
    out = np.bincount((mix(s) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(out.astype(np.uint8)).tobytes()


def sketch_of(s: np.ndarray) -> bytes:
    """About one bit for each element."""
    return parities(s, max(64, 1 << max(len(s) - 1, 1).bit_length()))


def differ(a: bytes, b: bytes) -> int:
    """At least in how many elements the sets of two sketches differ."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x))) ^ x).sum())


def possible(pairs: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v), those that sizes and sketches do not rule out. sized: node, size, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("size_u", "size_v", "sketch_u", "sketch_v")]
            yield b.select(["u", "v"]).filter(pa.array([differ(x, y) <= far(m, n, percent) for m, n, x, y in zip(*cols, strict=True)], pa.bool_()))

    a, z = (sized.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "uv")
    near = F.least("size_u", "size_v") * 100 >= F.greatest("size_u", "size_v") * percent
    return pairs.join(a, "u").join(z, "v").filter(near).select("u", "v", "size_u", "size_v", "sketch_u", "sketch_v").mapInArrow(run, "u long, v long")


def linked(pairs: DataFrame, nodes: DataFrame, text: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (u, v), those whose sets link. nodes: node and, of a document that has its set, doc_id and tkey; only the texts of the pairs are read out of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, last, held = WordHash(), None, np.empty(0, np.uint64)
        for b in (s for batch in batches for s in slices(batch)):
            keep = []
            for u, one, two in zip(b.column("u").to_pylist(), utf8(b, "text_u"), utf8(b, "text_v"), strict=True):
                if u != last:
                    last, held = u, shingles(memo, one, n)
                other = shingles(memo, two, n)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = cut(ends.join(nodes, "node").select("node", F.col("doc_id").alias("d"), F.col("tkey").alias("t")), "wanted")
    few = F.broadcast(wanted) if wanted.count() <= SENT_ROWS else wanted
    texts = cut(text.join(few, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t"))).select("node", "text").dropDuplicates(["node"]), "texts")
    a = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u"))
    z = texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    return pairs.join(z, "v").join(a, "u").select("u", "v", "text_u", "text_v").mapInArrow(run, "u long, v long")


def classes(docs: DataFrame, n: int = 3, percent: int = SIMILARITY) -> DataFrame:
    """doc_id, tkey, n_shingles, component_id of every document.

    Null and empty texts have no set and are linked with nothing: their component is their own id. Rows with equal sets are one
    node, however many; a null id is never the least of a component with others; an empty table gives no rows.
    """
    return labelled(docs, n, percent).drop("component")


def labelled(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The classes, and in component a number for each component, which is null for texts without a set."""
    text = keyed(docs)
    made = cut(sets(text, n, percent), "sets")
    every = made.filter("piece IS NULL").drop("piece", "counts", "small")
    nodes = cut(every.filter("size > 0").groupBy("node", "size").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(F.xxhash64("doc_id", "tkey"), "doc_id", "tkey")).alias("of"), *(F.min(c).alias(c) for c in ("sketch", *SHORT))), "nodes")
    counts = docs.sparkSession.sparkContext.broadcast(frequencies(made.filter("piece IS NOT NULL").select("piece", "counts")))  # of COUNTERS entries
    light = boundary(measured(made.filter("small IS NOT NULL").select("node", "small").dropDuplicates(["node"]), percent, counts), percent)
    entries = cut(listed(text, n, percent, light, counts), "entries").select(F.explode("keys").alias("key"), "node")
    shared = entries.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("key")
    lists = cut(entries.join(shared, "key").distinct(), "lists")

    asked = cut(lists.groupBy("node").agg(F.count("*").alias("lists")).join(nodes, "node").select("node", "lists", "size", "sketch", *SHORT, "of.doc_id", "of.tkey"), "asked")
    ranked = lists.join(asked.select("node", "lists"), "node")
    hubs = ranked.groupBy("key").agg(F.max_by("node", "lists").alias("hub"))
    first = ranked.join(hubs, "key").filter("node <> hub").select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct()
    links = cut(linked(cut(possible(first, asked, percent), "pairs"), asked, text, n, percent), "links")
    joined = cut(components(links), "components")

    marked = lists.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = marked.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
    open_ = cut(marked.join(several, "key").join(asked.select("node", "size", *SHORT), "node"), "open")
    one, two = (open_.select("key", F.col("node").alias(c), F.col("component").alias(f"c{c}"), F.col("size").alias(f"size_{c}"), *(F.col(b).alias(f"{b}_{c}") for b in SHORT)) for c in "uv")
    apart = " + ".join(f"bit_count({b}_u ^ {b}_v)" for b in SHORT)
    near = f"100 * least(size_u, size_v) >= {percent} * greatest(size_u, size_v) AND {100 + percent} * ({apart}) <= {100 - percent} * (size_u + size_v)"
    rest = one.join(two, "key").filter(f"u < v AND cu <> cv AND {near}").select("u", "v").distinct()
    more = cut(linked(cut(possible(rest, asked, percent), "pairs"), asked, text, n, percent), "links")
    if not more.isEmpty():
        joined = cut(components(links.unionByName(more)), "components")
    named = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = cut(named.select("node", "size", "component").join(least, "component").select("node", "size", "component", "component_id"), "named")
    return every.join(named, ["node", "size"], "left").select("doc_id", "tkey", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, of documents that are the least of their component.

    Of a component's rows of the least id with different texts the one of the least text hash stays; rows equal in both are one
    document and stay or go together. Rows of different components never replace each other, also where they share an id or have
    none; null and empty texts are in no component and stay. Columns may have any names; an empty table stays empty.
    """
    d, t = spare(docs, "d", "t")
    kept = cut(labelled(docs, n, percent), "classes")
    first = kept.filter("n_shingles > 0 AND doc_id <=> component_id").groupBy("component", "doc_id").agg(F.min("tkey").alias("tkey")).drop("component")
    found = kept.filter("n_shingles = 0").select("doc_id", "tkey").distinct().unionByName(first).select(F.col("doc_id").alias(d), F.col("tkey").alias(t))
    return docs.join(cut(found, "kept"), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (text_key() == F.col(t)), "left_semi")
