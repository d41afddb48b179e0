"""Line dedup by deletion neighbourhoods, in Spark's own expressions.

Two lines are alike if one becomes the other by inserting, deleting or replacing one word at most. Each line emits its variants
with one word deleted as hashed keys; lines with an equal variant meet. A key's group gives its earliest line only, so groups are
aggregated and never paired. Lines that share neither their first nor their last half with another line cannot have a partner,
and emit no variants. A line's variants are hashed out of sums over its words, not written out, so a very long line costs no more
for each word than a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut, keyed, spare, text_key

#: Shorter lines must be equal to be alike: one word is too much of them.
MIN_WORDS = 10


def _line(raw: Column) -> Column:
    """Words of the line, joined by single spaces."""
    odd = raw.startswith(" ") | raw.endswith(" ")
    for c in ("\t", "\r", "\x0b", "\f", "  "):
        odd = odd | raw.contains(c)
    return F.when(odd, F.btrim(F.regexp_replace(raw, "[ \\t\\r\\x0B\\f]+", " "))).otherwise(raw)


def _order() -> Column:
    """A line's place among all lines as one fixed-width number: doc_id, then line number, then 31 bits of the text's hash.

    Hash aggregation can hold its minimum in place, which it can't for a struct. Lines of documents without an id come before
    all others, spread by their text's hash.
    """
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(-(1 << 63)).cast("decimal(20,0)") - 1 - F.shiftrightunsigned("tkey", 2).cast("decimal(20,0)"))
    within = F.shiftleft(F.col("line_no").cast("long"), 31) + F.col("tkey").bitwiseAND((1 << 31) - 1)
    return (doc * F.lit(1 << 62).cast("decimal(19,0)") + within.cast("decimal(19,0)")).cast("decimal(38,0)")


def lines(text: DataFrame) -> DataFrame:
    """doc_id, tkey, line_no, line of every line with a word. text: doc_id, tkey, text."""
    split = text.select("doc_id", "tkey", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    worded = split.filter(F.btrim("raw", F.lit(" \t\r\x0b\f")) != "")
    return worded.select("doc_id", "tkey", "line_no", _line(F.col("raw")).alias("line"))


#: Hashes of a line's halves: two lines that are alike, with min_words or more words, share one. Odd numbers of words have two.
HALVES = ("first_0", "last_0", "first_1", "last_1")


#: Hashes of a word at its place. A line, with or without a word, is known by the XOR of its words' hashes, so that all of a
#: line's variants take time in proportion to its words; sums are kept for every BLOCK words.
HASHES, ZERO, BLOCK = {"a": "xxhash64", "b": "hash"}, {"a": "0L", "b": "0"}, 32


def _halves(min_words: int) -> list[Column]:
    out = []
    for name in HALVES:
        less = f"words DIV 2 - {name[-1]}"
        half = f"xxhash64('p', substring_index(line, ' ', {less}))" if name.startswith("first") else f"xxhash64('s', substring_index(line, ' ', -({less})))"
        out.append(F.expr(f"CASE WHEN words >= {min_words}{' AND words % 2 = 0' if name[-1] == '1' else ''} THEN {half} END").alias(name))
    return out


def _alike(a: str, b: str) -> Column:
    """Whether two arrays of words are one insertion, deletion or replacement apart at most."""
    cut_at = f"coalesce(nullif(array_position(zip_with({a}, {b}, (x, y) -> NOT (x <=> y)), true), 0), least(size({a}), size({b})) + 1)"
    tail = lambda x, skip: f"slice({x}, cut_at + {skip}, greatest(size({x}), 1))"
    body = f"({tail(a, 1)} = {tail(b, 1)} AND size({a}) = size({b})) OR ({tail(a, 1)} = {tail(b, 0)} AND size({a}) = size({b}) + 1) OR ({tail(a, 0)} = {tail(b, 1)} AND size({a}) + 1 = size({b}))"
    return F.expr(body.replace("cut_at", f"cast({cut_at} AS int)"))


def duplicates(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tkey, removed: the numbers, from 0, of each document's lines that are equal or alike to an earlier line.

    Two lines are alike if one edit of a word turns one into the other; lines of fewer than min_words words are alike only if
    they are equal, as one word would be more than a tenth of them. Earlier means of a smaller doc_id (none is the smallest), or
    the same one and a smaller number. A line goes if any earlier one is alike, whether or not that one stays. Lines without
    words never go.
    """
    text = keyed(docs)
    ordered = lines(text).select("doc_id", "tkey", "line_no", "line", _order().alias("o"))
    worded = ordered.withColumn("words", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    every = cut(worded.select("doc_id", "tkey", "line_no", "o", F.xxhash64("line").alias("h"), F.hash("line").alias("g"), *_halves(min_words)), "lines")

    # One row for each different line: its first place, how often it occurs, and the hashes of its halves.
    kinds = cut(every.groupBy("h", "g").agg(F.min("o").alias("first"), F.count("*").alias("times"), *(F.min(c).alias(c) for c in HALVES)), "kinds")
    sides = F.explode(F.array(*(F.struct(F.lit(c.startswith("first")).alias("is_first"), F.col(c).alias("key")) for c in HALVES))).alias("side")
    halves = kinds.select("h", "g", "first", sides).filter("side.key IS NOT NULL").select("h", "g", "first", "side.*")
    met = halves.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key")
    near = halves.join(met, "key", "left_semi").groupBy("h", "g", "first").agg(F.max("is_first").alias("same_first"), F.max(~F.col("is_first")).alias("same_last"))

    # Words of the first line of each kind that may have a partner.
    shown = ordered.select("o", "line", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))
    words = cut(shown.join(near, ["h", "g"]).filter("o = first").dropDuplicates(["h", "g"]).select("o", "same_first", "same_last", "line", F.split("line", " ").alias("words")), "words")

    # role 0 is met by lines with another word at the same place, 1 (the line itself) by 2 (the line without a word). Where lines
    # meet in a half, they differ in the other.
    hashed = words.select("o", "same_first", "same_last", *(F.expr(f"transform(words, (x, i) -> {h}(x, i + {shift}))").alias(f"{c}{name}") for c, h in HASHES.items() for name, shift in (("x", 0), ("y", -1))))
    summed = hashed.select("*", *(F.expr(f"zip_with({c}x, {c}y, (x, y) -> x ^ y)").alias(f"{c}d") for c in HASHES), *(F.expr(f"aggregate({c}{name}, {ZERO[c]}, (a, x) -> a ^ x)").alias(f"{c}{name}_all") for c in HASHES for name in "xy"))
    blocks = summed.select("*", *(F.expr(f"aggregate(sequence(0, size({c}d) DIV {BLOCK}), array({ZERO[c]}), (p, k) -> concat(p, array(aggregate(slice({c}d, k * {BLOCK} + 1, {BLOCK}), element_at(p, -1), (a, x) -> a ^ x))))").alias(f"{c}p") for c in HASHES))
    at = "sequence(CASE WHEN same_last THEN 0 ELSE n DIV 2 - 1 END, CASE WHEN same_first THEN n - 1 ELSE n - n DIV 2 END)"
    rest = lambda c: f"{c}y_all ^ {c}y[at] ^ aggregate(slice({c}d, at - at % {BLOCK} + 1, at % {BLOCK}), {c}p[at DIV {BLOCK}], (a, x) -> a ^ x)"
    lacking = blocks.withColumn("n", F.size("ad")).select("o", F.explode(F.expr(f"transform({at}, at -> struct(at, {rest('a')} AS a, {rest('b')} AS b))")).alias("v")).select("o", "v.*")
    variants = lacking.select("o", F.explode(F.array(
        F.struct(F.lit(0).alias("role"), F.xxhash64("a", "at").alias("a"), F.hash("b", "at").alias("b")),
        F.struct(F.lit(2).alias("role"), F.xxhash64("a").alias("a"), F.hash("b").alias("b")),
    )).alias("k")).select("o", "k.*")
    variants = cut(variants.unionByName(summed.select("o", F.lit(1).alias("role"), F.xxhash64("ax_all").alias("a"), F.hash("bx_all").alias("b"))), "variants")
    earliest = variants.groupBy("a", "b").agg(*(F.min(F.when(F.col("role") == r, F.col("o"))).alias(f"o{r}") for r in (0, 1, 2)), F.count("*").alias("n")).filter("n > 1").drop("n")
    partner = F.expr("CASE role WHEN 0 THEN o0 WHEN 1 THEN o2 ELSE o1 END")
    met = variants.join(earliest, ["a", "b"]).select("o", partner.alias("p")).filter("p < o").groupBy("o").agg(F.min("p").alias("p"))
    sides = met.join(words.select(F.col("o").alias("p"), F.col("words").alias("theirs")), "p").join(words.select("o", "words"), "o")
    fuzzy = sides.filter(_alike("words", "theirs")).select(F.col("o").alias("first"), F.lit(True).alias("fuzzy"))

    gone = kinds.select("h", "g", "first", "times").join(fuzzy, "first", "left").filter("fuzzy OR times > 1").select("h", "g", "first", F.coalesce("fuzzy", F.lit(False)).alias("fuzzy"))
    hits = every.select("doc_id", "tkey", "line_no", "o", "h", "g").join(gone, ["h", "g"]).filter(F.col("fuzzy") | (F.col("o") > F.col("first")))
    return hits.groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, removed (their numbers, joined by commas) of every document.

    Lines of fewer than min_words words go only if they equal an earlier one, longer ones also if they are alike to one (see
    `duplicates`). Null and empty texts have no lines; documents equal in id and text are one document and lose the same lines;
    documents without an id come first; an empty table gives no rows; other columns are ignored. A very long text is exploded
    into lines once, so it needs memory for itself alone.
    """
    split = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t\\r\\x0B\\f]"))
    counted = keyed(docs).select("doc_id", "tkey", F.size(split).cast("long").alias("n_lines"))
    of = duplicates(docs, min_words).select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), "removed")
    return counted.join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("t")), "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their columns, without the lines that are equal or alike to earlier ones (see `duplicates`).

    A document that loses all its lines goes; one that loses none stays as it is, n_chars included, also if its text is null or
    empty. Documents equal in id and text are one document and keep the same lines; of those that share an id, or have none,
    each loses its own lines. Columns may have any names; an empty table stays empty. n_chars, if there is one, follows the text.
    """
    d, t, gone, line = spare(docs, "d", "t", "gone", "line")
    found = duplicates(docs, min_words).select(F.col("doc_id").alias(d), F.col("tkey").alias(t), F.col("removed").alias(gone))
    with_lines = docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (text_key() == F.col(t)), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))
    out = with_lines.withColumn(line, F.when(F.col(gone).isNotNull(), F.array_join(kept, "\n"))).filter(F.col(gone).isNull() | F.col(line).rlike("[^ \\t\\n\\r\\x0B\\f]"))
    changed = {"text": F.col(line), "n_chars": F.length(line)}
    return out.select(*(F.when(F.col(gone).isNull(), F.col(column(c))).otherwise(changed[c].cast(kind)).alias(c) if c in changed else F.col(column(c)) for c, kind in docs.dtypes))
