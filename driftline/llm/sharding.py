"""Shards of near equal bytes: a k-d tree over metadata, cut at weighted medians.

Each node is cut along its widest dimension at the value that halves its bytes. Medians come from histograms that narrow on the
cut, so what the driver sees is of fixed size. All expressions are Spark's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_count_partitions

#: Metadata that the tree is built over; all come from the text, so equal texts fall together unless a cut must go through them.
DIMENSIONS = ("d_bytes", "d_lines", "d_script", "d_hash")
#: Bars of a histogram, and how far from its aim a cut may be, as a share of a node's bytes.
BARS, TOLERANCE = 1024, 5e-5
#: Rows that one task numbers, on average.
NUMBERED_ROWS = 50_000


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions as longs, and a number that tells rows apart; a null text counts as empty in all but its size of 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.length(text).alias("chars"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("breaks"))
    octaves = lambda c: F.floor(F.log2(c.cast("double") + 1) * 4096).cast("long")
    tie = F.shiftleft(F.col("text_crc32"), 31).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit(2**31 - 1)))
    return rows.select("doc_id", "size", "text_crc32", octaves(F.col("size")).alias("d_bytes"), octaves(F.col("breaks")).alias("d_lines"), F.floor((F.col("size") - 1 - F.col("chars")) * 100_000 / F.greatest(F.col("size"), F.lit(1))).cast("long").alias("d_script"), F.col("text_crc32").alias("d_hash"), tie.alias("tie"), F.monotonically_increasing_id().alias("at"))


def _table(spark, columns: str, rows: list[str]) -> DataFrame:
    """A few literal rows, one for each node; there are fewer nodes than shards."""
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({columns})"))


def _at(index: Column) -> Column:
    """A row's value on the dimension of that number; past the last come the ties."""
    return F.element_at(F.array(*DIMENSIONS, "tie"), index + 1)


def _halve(rows: DataFrame, first_half: dict[int, float], spans: dict[str, float]) -> dict[int, tuple[int, int, int | None]]:
    """For each node that has rows, (dimension, cut, cut among ties): rows up to it go left."""
    spark = rows.sparkSession
    rows = rows.join(_table(spark, "node", [f"({k})" for k in first_half]), "node")
    ends = rows.groupBy("node").agg(*(f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)), F.sum("size").alias("bytes")).collect()
    at = {}
    for r in ends:
        wide = [(r[f"max_{d}"] - r[f"min_{d}"]) / spans[d] for d in DIMENSIONS[:-1]]
        by = wide.index(max(wide)) if any(wide) else len(wide)  # the hash is no metadata: it is cut where nothing else differs
        d = DIMENSIONS[by]
        at[r["node"]] = {"by": by, "lo": r[f"min_{d}"], "hi": r[f"max_{d}"], "before": 0, "aim": r["bytes"] * first_half[r["node"]], "room": TOLERANCE * r["bytes"], "value": None, "cut": None}
    while open_ := {k: x for k, x in at.items() if x["cut"] is None}:
        # A row counts where its node still searches: on the dimension or, at one value of it, on the ties.
        state = [f"({k}, {x['by']}, {x['by'] if x['value'] is None else len(DIMENSIONS)}, {'CAST(NULL AS BIGINT)' if x['value'] is None else str(x['value']) + 'L'}, {x['lo']}L, {x['hi']}L, {max(1, -(-(x['hi'] - x['lo'] + 1) // BARS))}L)" for k, x in open_.items()]
        seen = rows.join(_table(spark, "node, by, on, only, lo, hi, width", state), "node").filter("only IS NULL" if all(x["value"] is None for x in open_.values()) else F.col("only").isNull() | (_at(F.col("by")) == F.col("only")))
        bars = seen.withColumn("v", _at(F.col("on"))).filter("v BETWEEN lo AND hi").withColumn("bar", F.expr("(v - lo) DIV width")).groupBy("node", "bar").agg(F.sum("size").alias("bytes"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        for k, x in open_.items():
            total, last = x["before"], None
            for r in sorted((r for r in bars if r["node"] == k), key=lambda r: r["bar"]):
                if total + r["bytes"] >= x["aim"]:
                    break
                total, last = total + r["bytes"], r["most"]
            short, over = x["aim"] - total, total + r["bytes"] - x["aim"]
            if over <= x["room"]:
                got = r["most"]
            elif short <= x["room"] and last is not None:
                got = last
            elif r["least"] < r["most"]:
                x.update(lo=r["least"], hi=r["most"], before=total)
                continue
            elif x["value"] is None:
                x.update(value=r["least"], lo=0, hi=2**63 - 1, before=total)
                continue
            else:
                got = r["most"] if over <= short or last is None else last
            x["cut"] = (x["by"], got, None) if x["value"] is None else (x["by"], x["value"], got)
    return {k: x["cut"] for k, x in at.items()}


def split(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null): shards of near equal bytes.

    Copies of a text share a shard unless a cut that is to halve the bytes goes through them; then their ids decide. Null and
    empty texts have size 1; rows equal in id and text stay together; an empty table gives no rows; other columns are ignored.
    A hot group of copies is divided by id, and slots are numbered in small buckets, over which rows that repeat wholly are spread,
    so no task holds a whole shard.
    """
    rows = cut(metadata(docs), "metadata")
    whole = rows.agg(F.count("*").alias("n"), *(f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max))).first()
    spans = {d: max(1, (whole[f"max_{d}"] or 0) - (whole[f"min_{d}"] or 0)) for d in DIMENSIONS}
    rows = rows.withColumn("node", F.lit(0))
    nodes = {0: (0, shards)}  # node: first shard, shards
    number = 1
    while whole["n"] and (wide := {k: n // 2 / n for k, (_, n) in nodes.items() if n > 1}):
        state = []
        for k, (by, value, tie) in _halve(rows, wide, spans).items():
            first, n = nodes[k]
            nodes |= {number: (first, n // 2), number + 1: (first + n // 2, n - n // 2)}
            state.append(f"({k}, {by}, {value}L, {f'{tie}L' if tie is not None else f'{2**63 - 1}L'}, {number}, {number + 1})")
            number += 2
        for k in wide:
            del nodes[k]
        if not state:
            break
        cuts = _table(rows.sparkSession, "node, by, value, upto, below, above", state)
        value = _at(F.col("by"))
        left = (value < F.col("value")) | ((value == F.col("value")) & (F.col("tie") <= F.col("upto")))
        moved = F.when(F.col("by").isNull(), F.col("node")).when(left, F.col("below")).otherwise(F.col("above"))
        rows = rows.join(cuts, "node", "left").withColumn("node", moved).drop("by", "value", "upto", "below", "above")
    placed = rows.join(_table(rows.sparkSession, "node, shard", [f"({k}, {first})" for k, (first, _) in nodes.items()] or ["(0, 0)"]), "node")
    buckets = row_count_partitions(whole["n"], NUMBERED_ROWS)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "at"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "at")
    numbered = placed.withColumn("k", F.row_number().over(within) - 1).join(base, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
