"""The stream gives what the batch gives, whatever the batches."""

from driftline.operators import rules
from driftline.streaming import levels


def test_stream_is_the_batch(spark, tmp_path):
    rows = [(k, i, (i * 7 + k * 3) % 3) for k in range(5) for i in range(30)]
    schema = "track_id long, seq long, proposed int"
    for part in range(3):  # read in order of their times
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = levels.hysteresis(stream).writeStream.format("memory").queryName("steady").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    want = rules.hysteresis(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, spark.table("steady").collect())) == sorted(map(tuple, want))
