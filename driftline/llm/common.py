"""What the text operators share: where tables are cut, how documents are keyed, how words are cut and hashed."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most memoised words in one Python worker; beyond that the memo starts anew, which changes no result.
MEMO_WORDS = 300_000
#: Rows that Python code takes out of an Arrow batch at a time.
SLICE_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, only a session whose tasks share the
    driver's disk gets one in that disk's temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        at = context._jsc.sc().getCheckpointDir()
        if at.isDefined():
            named = at.get()
        elif context.master.split("[")[0] == "local":
            context.setCheckpointDir(named := tempfile.mkdtemp(prefix="driftline-"))
        else:
            raise ValueError("spark.checkpoint.dir names no folder; it must be one that the driver and all executors share")
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/driftline/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again, which ends its lineage there."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_clean(df: DataFrame, name: str) -> DataFrame:
    """As cut; the shuffle files behind df go as soon as it is written, where this Spark can do that."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, None)
    conf.set(key, "true")
    try:
        return cut(df, name)
    finally:
        conf.unset(key) if was is None else conf.set(key, was)


def column(name: str) -> str:
    """A column's name, quoted: it may hold dots."""
    return "`" + name.replace("`", "``") + "`"


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_key(text: str = "text") -> Column:
    """Together with doc_id it tells apart rows of one doc_id with different texts; rows equal in both are one document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and tkey; other columns, whatever their names, are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), text_key().alias("tkey"))


class WordHash(dict):
    """bytes -> 64-bit hash, memoised."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def portions(batch: pa.RecordBatch, most: int = 4 << 20, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Rows with so many bytes of text at a time, or one row of more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's texts as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: An odd number, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive entries of h, in order."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for j in range(1, n):
            out *= np.uint64(BASE)
            out += h[j : len(h) - n + 1 + j]
    return mix(out)


def hashed(memo: WordHash, words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def row_count_partitions(rows: int, per: int) -> int:
    return max(1, -(-rows // per))
