"""Ranked search over an index of dual-sorted wavelet trees.

A shard holds the postings of some documents: all lists in a row, each by falling impact, as one sequence of document numbers in
a wavelet matrix. A list is an interval of the sequence; a step down the tree maps it to the documents of one half of the
numbers and leaves its order by impact, so the first entry bounds what the list can give to any document below. Searching keeps
nodes (ranges of document numbers with one interval for each of the item's terms), takes those of the highest bounds first, cuts
their intervals to both halves, and drops what can't reach the k-th score any more. At the bottom the bound is the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_path, portions, utf8

#: Results of an item.
TOP = 10
#: Terms with repeats in one shard; a longer document is a shard of its own.
SHARD_TERMS = 1_000_000
#: Nodes that one item expands at a time.
AT_ONCE = 24
#: Bytes of items' terms that are sent to the tasks at a time; more items take more passes over the index.
BLOCK_BYTES = 8 << 20
#: Entries of all items' nodes that are held at a time; where there would be more, the items are taken in parts.
MOST_ENTRIES = 1 << 22

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "docs array<long>, terms binary, starts binary, impacts binary, bits array<binary>, n_documents long, n_terms long"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def totals(docs: DataFrame) -> tuple[int, int]:
    """How many documents have terms, and how many terms, with repeats, they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(terms_of(t)) for t in utf8(b)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)]), pa.array([sum(n)])], ["documents", "terms"])

    found = docs.select("text").mapInArrow(run, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


class Number(dict):
    """term -> its number."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def impacts(tf: np.ndarray, n: np.ndarray, n_documents: int, n_terms: int) -> np.ndarray:
    """What a term gives to a document before its weight, for its occurrences among n terms."""
    m = 100 - 90 + (90 * n * n_documents) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def matrix(docs: np.ndarray, levels: int) -> list[np.ndarray]:
    """The bits of a wavelet matrix, a level each, from the highest bit of the document numbers."""
    out = []
    for level in range(levels):
        bit = (docs >> (levels - 1 - level)) & 1
        out.append(np.packbits(bit.astype(bool)))
        docs = np.concatenate([docs[bit == 0], docs[bit == 1]])
    return out


def built(ids: list[int | None], texts: list[list[bytes]], n_documents: int, n_terms: int) -> dict:
    number = Number()
    lengths = np.array([len(t) for t in texts], np.int64)
    term = np.fromiter((number[w] for t in texts for w in t), np.int64, int(lengths.sum()))
    pair, tf = np.unique(term << 32 | np.repeat(np.arange(len(texts)), lengths), return_counts=True)
    term, doc = pair >> 32, pair & 0xFFFFFFFF
    impact = impacts(tf, lengths[doc], n_documents, n_terms)
    order = np.argsort(term << 20 | (1 << 20) - 1 - impact, kind="stable")  # impacts stay below 2**20; documents stay in order
    starts = np.searchsorted(term, np.arange(len(number) + 1))
    levels = max(1, len(texts) - 1).bit_length()
    bits = matrix(doc[order], levels)
    return {"docs": ids, "terms": b" ".join(number), "starts": starts.astype(np.int32).tobytes(), "impacts": impact[order].astype(np.int32).tobytes(), "bits": [b.tobytes() for b in bits], "n_documents": n_documents, "n_terms": n_terms}


def index(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The shards of an index of all documents, a row each, written to the shared folder.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are lower-cased. Every row is a document,
    also where rows repeat or doc_id is null; null and empty texts have no terms; a text of any length is indexed whole; an empty
    table gives an index of no shards; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_documents, n_terms = totals(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        held: list[list[bytes]] = []
        size = 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(built(ids, held, n_documents, n_terms).values(), (pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.int64()), strict=True)], [c.split(" ")[0] for c in INDEX.split(", ")])
        for b in (s for batch in batches for s in portions(batch, 1 << 20)):
            for doc, text in zip(b.column("doc_id").to_pylist(), utf8(b), strict=True):
                held.append(terms_of(text))
                ids.append(doc)
                size += len(held[-1])
                if size >= shard_terms:
                    yield row()
                    ids, held, size = [], [], 0
        if ids:
            yield row()

    path = new_path(docs.sparkSession, "index")
    # Small row groups, so that a reader holds few shards at a time.
    texts.mapInArrow(run, INDEX).write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class Tree:
    """A shard, ready to be walked."""

    def __init__(self, docs: list[int | None], terms: bytes, starts: bytes, impact: bytes, bits: list[bytes]):
        self.docs, self.levels = docs, len(bits)
        self.number = {t: i for i, t in enumerate(terms.split(b" "))} if terms else {}
        self.starts = np.frombuffer(starts, np.int32).astype(np.int64)
        level = np.frombuffer(impact, np.int32)
        n = len(level)
        self.width = n + 1
        #: Of each level: how many ones stand before a place; where the ones of the next level begin; and the impacts in its order.
        self.ones = np.zeros((self.levels, n + 1), np.int32)
        self.zeros = np.zeros(self.levels, np.int64)
        self.impact = np.zeros((self.levels + 1, n + 1), np.int32)
        self.impact[0, :n] = level
        for k, packed in enumerate(bits):
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
            np.cumsum(bit, out=self.ones[k, 1:])
            self.zeros[k] = n - int(self.ones[k, n])
            level = np.concatenate([level[~bit], level[bit]])
            self.impact[k + 1, :n] = level
        self.ones, self.impact = self.ones.reshape(-1), self.impact.reshape(-1)


class Nodes:
    """Ranges of document numbers (item, level, the numbers' leading bits, bound), and the entries of each: intervals with weights."""

    def __init__(self, item: np.ndarray, level: np.ndarray, lead: np.ndarray, count: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, tree: Tree):
        self.item, self.level, self.lead, self.count, self.lo, self.hi, self.weight = item, level, lead, count, lo, hi, weight
        self.first = np.cumsum(count) - count
        gain = weight * tree.impact[np.repeat(level, count) * tree.width + lo]
        self.bound = np.add.reduceat(gain, self.first) if len(item) else np.empty(0, np.int64)

    def entries(self, of: np.ndarray) -> np.ndarray:
        count = self.count[of]
        return np.repeat(self.first[of], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)

    def some(self, of: np.ndarray) -> Nodes:
        out, at = Nodes.__new__(Nodes), self.entries(of)
        out.item, out.level, out.lead, out.count, out.bound = self.item[of], self.level[of], self.lead[of], self.count[of], self.bound[of]
        out.lo, out.hi, out.weight = self.lo[at], self.hi[at], self.weight[at]
        out.first = np.cumsum(out.count) - out.count
        return out

    @staticmethod
    def joined(a: Nodes, b: Nodes) -> Nodes:
        out = Nodes.__new__(Nodes)
        for name in ("item", "level", "lead", "count", "bound", "lo", "hi", "weight"):
            setattr(out, name, np.concatenate([getattr(a, name), getattr(b, name)]))
        out.first = np.cumsum(out.count) - out.count
        return out

    def halves(self, tree: Tree) -> Nodes:
        """The children that have entries left."""
        level = np.repeat(self.level, self.count)
        one_lo, one_hi = (tree.ones[level * tree.width + x].astype(np.int64) for x in (self.lo, self.hi))
        zeros = tree.zeros[level]
        lo, hi = np.concatenate([self.lo - one_lo, zeros + one_lo]), np.concatenate([self.hi - one_hi, zeros + one_hi])
        full, weight = lo < hi, np.concatenate([self.weight, self.weight])
        count = np.add.reduceat(full.astype(np.int64), np.concatenate([self.first, self.first + len(self.lo)]))
        some = count > 0
        both = lambda x: np.concatenate([x, x])[some]
        lead = np.concatenate([self.lead * 2, self.lead * 2 + 1])[some]
        return Nodes(both(self.item), both(self.level) + 1, lead, count[some], lo[full], hi[full], weight[full], tree)


class Best:
    """The k best documents of each item so far: those of the highest scores, of equal ones those of the least ids, null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.doc = (np.empty(0, np.int64) for _ in range(3))
        self.null = np.empty(0, bool)
        self.least = np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, docs: list[int | None]) -> None:
        null = np.array([d is None for d in docs], bool)
        self.item, self.score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        self.doc, self.null = np.concatenate([self.doc, np.array([d or 0 for d in docs], np.int64)]), np.concatenate([self.null, null])
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        self.item, self.score, self.doc, self.null = self.item[order], self.score[order], self.doc[order], self.null[order]
        full = order[:0] if not len(order) else np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.least[self.item[full]] = np.maximum(1, self.score[full])


def search(tree: Tree, items: np.ndarray, terms: list[bytes], weights: np.ndarray, best: Best) -> None:
    """Adds to best what the shard has for the items; items, terms and weights have an entry for each term of an item, in order of items."""
    number = np.array([tree.number.get(t, -1) for t in terms], np.int64)
    at = np.flatnonzero((number >= 0) & (weights > 0))
    if not len(at):
        return
    own, first, count = np.unique(items[at], return_index=True, return_counts=True)
    parts = [np.arange(len(own))]
    zero = np.zeros(len(own), np.int64)
    roots = Nodes(own, zero, zero, count, tree.starts[number[at]], tree.starts[number[at] + 1], weights[at], tree)
    while parts:
        part = parts.pop()
        if count[part].sum() * AT_ONCE * 4 > MOST_ENTRIES and len(part) > 1:
            parts += np.array_split(part, 2)
            continue
        nodes = roots.some(part)
        while len(nodes.item):
            live = np.flatnonzero(nodes.bound >= best.least[nodes.item])
            live = live[np.lexsort((-nodes.bound[live], nodes.item[live]))]
            item = nodes.item[live]
            soon = np.arange(len(item)) - np.searchsorted(item, item) < AT_ONCE
            made = nodes.some(live[soon]).halves(tree) if soon.any() else nodes.some(live[soon])
            end = made.level == tree.levels
            if end.any():
                best.add(made.item[end], made.bound[end], [tree.docs[d] for d in made.lead[end].tolist()])
                made = made.some(np.flatnonzero(~end))
            later = live[~soon]
            later = later[nodes.bound[later] >= best.least[nodes.item[later]]]
            nodes = Nodes.joined(nodes.some(later), made)


def frequencies(shards: DataFrame, terms: list[bytes]) -> dict[int, int]:
    """How many documents hold each of some terms, by its place among them."""
    asked = shards.sparkSession.sparkContext.broadcast(terms)  # of BLOCK_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {t: i for i, t in enumerate(asked.value)}
        held = np.zeros(len(wanted), np.int64)
        for b in batches:
            for words, starts in zip(b.column("terms").to_pylist(), b.column("starts").to_pylist(), strict=True):
                counts = np.diff(np.frombuffer(starts, np.int32))
                for i, t in enumerate(words.split(b" ") if words else ()):
                    if t in wanted:
                        held[wanted[t]] += counts[i]
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["term", "df"])

    return {r.term: r.df for r in shards.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their distinct terms, of BLOCK_BYTES at a time, or one item of more."""
    made: list[tuple[int | None, list[bytes]]] = []
    size = 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).orderBy("item_id", "text").toLocalIterator():
        terms = sorted(set(terms_of(bytes(r.text or b""))))
        if made and made[-1][0] == r.item_id:
            terms = sorted({*made[-1][1], *terms})
            size -= sum(len(t) + 40 for t in made.pop()[1])
        elif size > BLOCK_BYTES:
            yield made
            made, size = [], 0
        made.append((r.item_id, terms))
        size += sum(len(t) + 40 for t in terms)
    if made:
        yield made


def ranked(shards: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item by the sum of its terms' weights times impacts, over all shards.

    Each term counts once an item; texts that share an item_id are one item; an item without terms, or whose terms no document
    holds, has no rows; fewer than k rows come where fewer documents score above 0. Equal scores come by doc_id, null last.
    """
    spark = shards.sparkSession
    head = shards.select("n_documents").first()
    n_documents = head[0] if head else 0
    out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in blocks(items):
        terms = sorted({t for _, own in block for t in own})
        df, place = frequencies(shards, terms), {t: i for i, t in enumerate(terms)}
        weight = [math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))]
        flat = [place[t] for _, own in block for t in own]
        ready = spark.sparkContext.broadcast(([i for i, _ in block], np.repeat(np.arange(len(block)), [len(own) for _, own in block]), [terms[i] for i in flat], np.array([weight[i] for i in flat], np.int64)))

        def run(batches: Iterator[pa.RecordBatch], ready=ready) -> Iterator[pa.RecordBatch]:
            ids, own, words, weights = ready.value
            best = Best(len(ids), k)
            for b in batches:
                for i in range(b.num_rows):
                    search(Tree(*(b.column(c)[i].as_py() for c in ("docs", "terms", "starts", "impacts", "bits"))), own, words, weights, best)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.item.tolist()], pa.int64()), pa.array(best.doc, mask=best.null), pa.array(best.score)], ["item_id", "doc_id", "score"])

        out = out.unionByName(shards.select("docs", "terms", "starts", "impacts", "bits").mapInArrow(run, out.schema))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
