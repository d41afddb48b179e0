"""Source rows to relations. Faults are reported as issues beside the rows, never raised; file order is a column, row_no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.operators.guards import is_hhmm, minute_of

TRACK_HEADER = "track_id STRING, time STRING, lat STRING, lon STRING"
REPORT_SOURCES = ("official", "third_party")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A track CSV with row_no, the place of each row within its file: Spark keeps the order of one file's offsets."""
    rows = spark.read.schema(TRACK_HEADER).option("header", True).option("enforceSchema", False).csv(path)
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def finite(text: Column) -> Column:
    """The number that a text is, null for others, NaN and infinities."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def tracks(rows: DataFrame) -> DataFrame:
    """rows (row_no, track_id, time, lat, lon as text) with minute, lat_deg, lon_deg, fault and day.

    Faults in the order of their tests: time, number_parse, duplicate (of a track and time; the first row stays). Rows without
    a fault get the day: it begins anew whenever the clock of a track goes back in file order.
    """
    checked = rows.withColumns({"minute": minute_of(F.coalesce("time", F.lit(""))), "lat_deg": finite(F.col("lat")), "lon_deg": finite(F.col("lon"))})
    bad = F.when(F.col("minute").isNull(), "time").when(F.col("lat_deg").isNull() | F.col("lon_deg").isNull(), "number_parse")
    w = Window.partitionBy("track_id", "time", F.col("bad").isNull()).orderBy("row_no")
    marked = checked.withColumn("bad", bad).withColumn("fault", F.when(F.col("bad").isNotNull(), F.col("bad")).when(F.row_number().over(w) > 1, "duplicate")).drop("bad")
    order = Window.partitionBy("track_id", F.col("fault").isNull()).orderBy("row_no")
    back = (F.col("minute") < F.lag("minute").over(order)).cast("int")
    return marked.withColumn("back", F.coalesce(back, F.lit(0))).withColumn("day", F.when(F.col("fault").isNull(), F.sum("back").over(order))).drop("back")


def issues(rows: DataFrame, file: str, key: str, fault: str = "fault", severity: str = "error") -> DataFrame:
    """file, pointer, rule, severity of the rows with a fault."""
    return rows.filter(F.col(fault).isNotNull()).select(F.lit(file).alias("file"), F.col(key).cast("string").alias("pointer"), F.col(fault).alias("rule"), F.lit(severity).alias("severity"))


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, side: keys of either side that the other lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def reports(rows: DataFrame) -> DataFrame:
    """rows (row_no, time, source, text) with report_id by file order and fault: time, source or text."""
    fault = F.when(~is_hhmm(F.coalesce("time", F.lit(""))), "time").when(~F.coalesce(F.col("source"), F.lit("")).isin(*REPORT_SOURCES), "source").when(~F.length(F.coalesce("text", F.lit(""))).between(1, 2000), "text")
    return rows.withColumn("report_id", F.format_string("R%03d", F.col("row_no") + 1)).withColumn("fault", fault)
