"""Token ids in Parquet files: a list column with dictionary pages, delta-encoded ids of documents, small pages with indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, portions, text_key, utf8
from .tokens import ByteEncoder, encoder

#: Row groups a reader can skip or split by, and pages small enough that the column indexes single out a few documents.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#row": "false",
}
_IDS = T.ArrayType(T.IntegerType(), containsNull=False)
ROW = T.StructType().add("row", T.LongType()).add("doc_id", T.LongType()).add("n_tokens", T.IntegerType()).add("ids", _IDS)
SCHEMA = T.StructType([T.StructField("shard", T.IntegerType()), *ROW.fields])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Writes shard, row, doc_id, n_tokens, ids in ascending doc_id order, a range of documents in each file.

    row counts a file's documents from 0: files by shard, and rows by row, are the order of all documents. Null and empty texts
    hold the end id alone; null ids come first; rows of one doc_id are ordered by their text's hash, and rows that are equal
    in both by where they were read, so that however many there are they can be spread over files; an empty table makes files
    without rows. Only doc_id and text are read of the table. A task holds a slice of texts and their ids at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, row = encoder(ByteEncoder, tokenizer).encode, np.asarray([end_id], "<u4").tobytes(), 0
        kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
        for b in (s for batch in batches for s in portions(batch)):
            made = [ids + end for ids in encode(utf8(b))]
            sizes = np.array([len(x) // 4 for x in made], np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), "<i4")), type=kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(made))), b.column("doc_id"), pa.array(sizes), ids], ROW.names)
            row += len(made)

    order = [F.col("doc_id").asc_nulls_first(), F.col("tkey"), F.col("at")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key().alias("tkey"), F.monotonically_increasing_id().alias("at"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(run, ROW).select(F.spark_partition_id().alias("shard"), *ROW.names).write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """shard, row, doc_id, n_tokens, ids; filters on doc_id skip row groups and pages, and unread columns cost nothing."""
    return spark.read.schema(SCHEMA).parquet(path)


def digest(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what the files hold; start counts in the files' own order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8)
            ends = 4 * ids.offsets.to_numpy().astype(np.int64)
            view = memoryview(values)
            sizes = np.diff(ends) // 4
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("shard", "row", "doc_id")), pa.array(sizes), pa.array([zlib.crc32(view[s:e]) for s, e in zip(ends, ends[1:], strict=False)], pa.int64())], ["shard", "row", "doc_id", "n_tokens", "ids_crc32"])

    rows = files.select("shard", "row", "doc_id", "ids").mapInArrow(run, "shard int, row long, doc_id long, n_tokens long, ids_crc32 long")
    # One row for each file is all that meets in one place.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = files.groupBy("shard").agg(F.sum(F.col("n_tokens").cast("long")).alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    upto = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0))).join(base, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the files in the shared folder, reads them again and returns what they hold, one row for each document."""
    spark = docs.sparkSession
    write(docs, path := new_path(spark, "token-ids"), tokenizer, end_id)
    return digest(read(spark, path))
