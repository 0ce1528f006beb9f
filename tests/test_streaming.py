import pytest
from pyspark.sql import functions as F

from apportion.operators.online import absolute, mass_schedule, online_layout, online_pass, start_state
from apportion.streaming.online import OnlineStream, start_online
from apportion.streaming.repeats import repeated_keys

HITS = "frag_id long, target_id long, w double"


def test_stream_equals_batches_and_survives_a_retry(spark, tmp_path):
    rows = [(f, t, 1.0 + (f * t) % 3) for f in range(1, 64) for t in {f % 5, (f * 3) % 7, 2}]
    targets = spark.createDataFrame([(t, 10.0, 0.005) for t in range(7)], "target_id long, eff_len double, alpha double")
    cuts = [(1, 15), (16, 31), (32, 63)]
    for i, (a, b) in enumerate(cuts):
        part = spark.createDataFrame([r for r in rows if a <= r[0] <= b], HITS)
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    snapshots = []
    handler = OnlineStream(spark, targets, f"{tmp_path}/state", on_snapshot=lambda n, s: snapshots.append(n))
    for i in range(3):
        stream = spark.readStream.schema(HITS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/{i}")
        start_online(stream, lambda df, _id, i=i: handler(df, i), f"{tmp_path}/ck{i}").awaitTermination()
    assert snapshots == [15, 31, 63]
    once = {r.target_id: r.mass for r in absolute(handler.load()[0]).collect()}
    frags = spark.range(1, 64).select(F.col("id").alias("frag_id"), F.col("id").alias("n"))
    layout = online_layout(spark.createDataFrame(rows, HITS), mass_schedule(frags, 0.85))
    want = {r.target_id: r.mass for r in absolute(online_pass(layout, start_state(targets))).collect()}
    assert once == pytest.approx(want)
    handler(spark.read.schema(HITS).parquet(f"{tmp_path}/in/2"), 2)
    assert {r.target_id: r.mass for r in absolute(handler.load()[0]).collect()} == pytest.approx(once)


def test_repeated_keys(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    assert [(r.k, r.copies) for r in repeated_keys(df, "k").collect()] == [("a", 2)]
