"""Collocations: word sequences that occur together far more often than their parts do apart.

Every task takes its documents in shards of bounded size and makes of each a generalised suffix automaton to a fixed depth: its
states are the sets of end positions that word sequences share, found by one sort of the shard's positions by the words that
end there, read backwards; a state's suffix link drops the first word. So each distinct sequence is met once a shard, with the
number of its end positions. A first pass sends short codes of the sequences to be counted over all shards. What reaches the
least count goes into a bit table of bounded size, with which a second pass sends only the sequences that can be frequent, as
words, so that the counts are exact whatever the codes and bits have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BASE, cut, mix, portions, utf8

#: Words in a phrase, at most, and occurrences that it needs.
MOST_WORDS, LEAST = 4, 30
#: A candidate goes if a longer one around it has this many hundredths of its occurrences.
COVERED = 80
#: Phrases of a language.
TOP = 2000
#: Words in one shard; a longer document is a shard of its own.
SHARD_WORDS = 500_000
#: Characters of text whose codes one task counts.
PART_CHARS = 8_000_000
#: Bits of a code within its part.
CODE_BITS = 40
#: Bits in the table of what may be frequent, at least and at most (32 MB). Beyond its size it passes more, and loses nothing.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28

_TABLE = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Ids(dict):
    """bytes of a word -> its number in the shard."""

    def __init__(self, shard: Shard, lang: int):
        super().__init__({b".": 0})
        self.shard, self.lang = shard, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.shard.words)
        self.shard.words.append(word)
        self.shard.lang.append(self.lang)
        return n


class Shard:
    """Words of some documents as numbers; 0 stands between pieces. The same word of two languages has two numbers."""

    def __init__(self) -> None:
        self.langs: list[str] = []
        self.ids: dict[str, Ids] = {}
        self.words: list[bytes] = [b"."]
        self.lang: list[int] = [-1]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        if lang not in self.ids:
            self.ids[lang] = Ids(self, len(self.langs))
            self.langs.append(lang)
        words = b".".join(texts).translate(_TABLE).replace(b".", b" . ").split()
        self.parts += [np.fromiter(map(self.ids[lang].__getitem__, words), np.uint32, len(words)), np.zeros(1, np.uint32)]
        self.size += len(words) + 1

    def codes(self) -> np.ndarray:
        """A hash of each word with its language."""
        seeds = [xxhash.xxh64_intdigest(x.encode()) for x in self.langs] + [0]
        return np.fromiter((xxhash.xxh64_intdigest(w, seeds[k]) for w, k in zip(self.words, self.lang, strict=True)), np.uint64, len(self.words))


def states(ids: np.ndarray, depth: int = MOST_WORDS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length, from 1: for each distinct sequence an end position, the number of end positions, and the number of its suffix.

    The suffix is the sequence without its first word, by number in the list of the length before. Sequences with as many end
    positions as their suffix are one state of the automaton with it.
    """
    n = len(ids)
    back, open_ = [ids], ids != 0
    lengths = open_.astype(np.int8)
    for j in range(1, depth):
        earlier = np.zeros(n, ids.dtype)
        earlier[j:] = ids[: max(0, n - j)]
        open_ = open_ & (earlier != 0)
        earlier[~open_] = 0
        lengths += open_
        back.append(earlier)
    at = np.flatnonzero(ids)
    keys = []
    for j in range(0, depth, 2):  # two words to a key; the words nearest to the end rule
        key = back[j][at].astype(np.uint64) << np.uint64(32)
        keys.append(key | back[j + 1][at].astype(np.uint64) if j + 1 < depth else key)
    at = at[np.lexsort(keys[::-1])]
    out, new = [], np.zeros(len(at), bool)
    new[:1] = True
    starts: np.ndarray = np.empty(0, np.int64)
    for j in range(depth):
        own = back[j][at]
        new[1:] |= own[1:] != own[:-1]
        first, above = np.flatnonzero(new), starts
        keep = lengths[at[first]] > j
        counts = np.diff(first, append=len(at))[keep]
        starts = first[keep]
        link = np.searchsorted(above, starts, "right") - 1 if j else np.full(len(starts), -1)
        out.append((at[starts], counts, link))
    return out


def sequence_codes(code: np.ndarray, ids: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    out = np.full(len(ends), np.uint64(length))
    with np.errstate(over="ignore"):
        for j in range(length - 1, -1, -1):
            out = mix(out * np.uint64(BASE) + code[ids[ends - j]])
    return out


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    shard = Shard()
    for b in (s for batch in batches for s in portions(batch, 1 << 20)):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), utf8(b), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            shard.add(lang, texts)
        if shard.size >= most:
            yield shard
            shard = Shard()
    if shard.size:
        yield shard


def placed(code: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part that counts a code, and the code within it."""
    rest = np.uint64(64 - CODE_BITS)
    return (code >> np.uint64(CODE_BITS)) * np.uint64(parts) >> rest, code & np.uint64((1 << CODE_BITS) - 1)


def marks(part: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(part << np.uint64(CODE_BITS) | code)


def tallies(texts: DataFrame, parts: int, depth: int, most: int) -> DataFrame:
    """part, counts: for each shard and part one row, of codes (CODE_BITS) and their occurrences (a byte, 255 at most)."""
    width = CODE_BITS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, most):
            ids, code = np.concatenate(shard.parts), shard.codes()
            found = states(ids, depth)
            every = np.concatenate([sequence_codes(code, ids, ends, j + 1) for j, (ends, _, _) in enumerate(found)])
            times = np.minimum(np.concatenate([c for _, c, _ in found]), 255)
            part, short = placed(every, parts)
            order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
            packed = np.empty((len(every), width + 1), np.uint8)
            packed[:, :width] = short[order].view(np.uint8).reshape(-1, 8)[:, :width]
            packed[:, width] = times[order]
            edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed[edges[p] : edges[p + 1]].tobytes()], pa.binary())], ["part", "counts"])

    return texts.mapInArrow(run, "part int, counts binary")


def frequent(counts: DataFrame, least: int) -> DataFrame:
    """mark of each code that reaches the least count over all shards."""
    width = CODE_BITS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for part, data in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                by.setdefault(part, []).append(np.frombuffer(data, np.uint8).reshape(-1, width + 1))
        while by:
            part, rows = by.popitem()
            code, times = np.zeros((sum(map(len, rows)), 8), np.uint8), np.concatenate([r[:, width] for r in rows])
            np.concatenate([r[:, :width] for r in rows], out=code[:, :width])
            code = code.reshape(-1).view(np.uint64)
            order = np.argsort(code)
            code = code[order]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            enough = np.add.reduceat(times[order], first, dtype=np.int64) >= least
            found = code[first[enough]]
            yield pa.RecordBatch.from_arrays([pa.array(marks(np.full(len(found), np.uint64(part)), found).view(np.int64))], ["mark"])

    return counts.mapInArrow(run, "mark long")


def bit_table(found: DataFrame) -> np.ndarray:
    """Bits that the marks set, two each. Its size is bounded, whatever the number of marks."""
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 32 * found.count():
        bits *= 2
    places = found.select(F.explode(F.array(F.expr(f"mark & {bits - 1}"), F.expr(f"shiftrightunsigned(mark, 32) & {bits - 1}"))).alias("at"))
    words = places.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def marked(table: np.ndarray, mark: np.ndarray) -> np.ndarray:
    last, out = np.uint64(len(table) * 64 - 1), np.ones(len(mark), bool)
    for at in (mark & last, (mark >> np.uint64(32)) & last):
        out &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def sequences(docs: DataFrame, depth: int = MOST_WORDS, least: int = LEAST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, words, phrase, n: every sequence of up to depth words with at least least occurrences in its language, and, as a
    phrase of no words, how many words the language has.

    Only A-Z are lower-cased; .,;:!? and line ends part pieces, spaces and tabs part words, and sequences stay within a piece.
    A null text is empty and has no words, a null lang is und; repeated rows count each time; a text of any length is read
    whole; an empty table gives no rows; other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = min(1 << 20, 1 + (texts.agg(F.sum(F.length("text"))).first()[0] or 0) // PART_CHARS)
    counted = tallies(texts, parts, depth, shard_words).repartitionById(parts, F.col("part"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(cut(frequent(counted, least), "frequent")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for shard in shards(batches, shard_words):
            ids, code = np.concatenate(shard.parts), shard.codes()
            names, lang, words = np.array(shard.langs, object), np.array(shard.lang), shard.words
            for j, (ends, counts, _) in enumerate(states(ids, depth)):
                keep = marked(table, marks(*placed(sequence_codes(code, ids, ends, j + 1), parts)))
                ends, counts = ends[keep], counts[keep]
                phrase = [b" ".join([words[i] for i in own]) for own in np.stack([ids[ends - k] for k in range(j, -1, -1)], 1).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(names[lang[ids[ends]]], pa.string()), pa.array(np.full(len(ends), j + 1, np.int32)), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(counts)], ["lang", "words", "phrase", "n"])
            total = np.bincount(lang[ids[ids > 0]], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.zeros(len(names), np.int32)), pa.array([""] * len(names)), pa.array(total)], ["lang", "words", "phrase", "n"])

    return texts.mapInArrow(run, "lang string, words int, phrase string, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter(f"words = 0 OR n >= {least}")


def collocations(found: DataFrame, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases, from the table of its sequences.

    A phrase of two words or more is cut where its parts' counts say least of it. Phrases that lie in a longer one with nearly as
    many occurrences go: of all longer ones, those of one word more have the most occurrences, and they are met over the links
    that drop a phrase's first or last word.
    """
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    single = found.select("lang", "phrase", "n")
    phrases = found.filter("words >= 2").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    links = phrases.filter("words >= 3").select("lang", "a", F.explode(F.array(F.expr("array_join(slice(w, 2, words - 1), ' ')"), F.expr("array_join(slice(w, 1, words - 1), ' ')"))).alias("phrase"))
    around = links.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = phrases.join(around, ["lang", "phrase"], "left").filter((F.coalesce(wide("longer"), F.lit(0)) * 100 < wide("a") * covered) | F.col("longer").isNull())
    cuts = alone.select("lang", "phrase", "a", "w", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("tail"))
    scored = cuts.join(single.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(single.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    scored = scored.withColumn("score", F.expr("(CAST(a AS decimal(20,0)) * 2000000) div (CAST(l AS decimal(20,0)) + r)").cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = found.filter("words = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame) -> DataFrame:
    """The best collocations of each language, see sequences() for how texts are read and collocations() for the choice.

    Phrases of equal score come by occurrences, then by their bytes. A language without frequent phrases has no rows.
    """
    return collocations(cut(sequences(docs), "sequences"))
