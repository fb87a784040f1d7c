import time

from pyspark.sql import functions as F

from concord.streaming.online import first_events, score_stream


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_items_are_scored_as_they_arrive(spark, tmp_path, make_items):
    make_items([[1.0, 0.1], [0.1, 1.0], [0.9, 0.0]]).write.parquet(str(tmp_path / "in"))
    centroids = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "label string, vec array<double>")
    stream = spark.readStream.schema("id long, vec array<double>").parquet(str(tmp_path / "in"))
    assert {r["id"]: r["label"] for r in drain(score_stream(stream, centroids), "scored")} == {0: "x", 1: "y", 2: "x"}


def test_first_event_per_subject(spark, tmp_path):
    rows = [(1, "2024-01-01 00:05:00", 7), (1, "2024-01-01 00:00:00", 9), (2, "2024-01-01 00:01:00", 4), (1, "2024-01-01 00:00:00", 8), (2, "2023-01-01 00:00:00", 5)]
    df = spark.createDataFrame(rows, "user int, t string, event int").select("user", F.to_timestamp("t").alias("ts"), "event")
    for i in range(len(rows)):  # one file per event, latest first for some
        df.filter(F.col("event") == rows[i][2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(first_events(stream, "user", "ts", ["event"]), "firsts", "complete")
    assert sorted((r["user"], str(r["ts"]), r["event"]) for r in got) == [(1, "2024-01-01 00:00:00", 8), (2, "2023-01-01 00:00:00", 5)]
