"""Streams with state: any arrival order, kills and restarts give what the batch gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kronoleaf.operators import sessions
from kronoleaf.streaming import jobs, places


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", places.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def photos():
    random.seed(3)
    start, rows = datetime(2025, 3, 1, 20, 0), []
    for i in range(160):
        at = start + timedelta(minutes=random.choice([5, 7, 20, 20, 95]) * (i // 4))
        lat, lon = random.choice([(35.0, 139.0), (35.001, 139.0), (35.02, 139.0), (None, None), (35.0, None)])
        rows.append((f"p{i % 4}", f"i{i:03d}", at, lat, lon))
    return sorted(rows, key=lambda r: (r[2], r[1]))


@pytest.mark.parametrize("seed", [1, 2])
def test_place_sessions_stream(rocksdb, tmp_path, seed):
    schema = "who string, id string, ts timestamp, lat double, lon double"
    rows = photos()
    want = sessions.place_sessions(rocksdb.createDataFrame(rows, schema), "who", "ts", "id").collect()
    # Rows come up to two hours out of order, in several files, and a last one moves the watermark past all.
    random.seed(seed)
    mixed = sorted(rows, key=lambda r: r[2] + timedelta(minutes=random.random() * 115))
    parts = [mixed[i : i + 40] for i in range(0, len(mixed), 40)] + [[("end", "z", datetime(2030, 1, 1), None, None)], [("end", "zz", datetime(2030, 1, 2), None, None)]]
    for i, part in enumerate(parts):
        rocksdb.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = rocksdb.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = places.place_sessions(stream, "who", "ts", "id", "2 hours")
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = [r for r in rocksdb.read.parquet(f"{tmp_path}/out").collect() if r.key != "end"]
    assert sorted((r.key, r.day, r.id, r.session) for r in got) == sorted((r.who, r.day, r.id, r.session) for r in want)
    assert max(r.session for r in want) > 3


def test_jobs_killed_and_restarted(spark, tmp_path):
    """A run that dies between and within batches ends as an undisturbed one; failed items are tried up to the limit."""
    schema = "item_id int, weight int"
    for i in range(4):
        spark.createDataFrame([(i * 10 + j, j) for j in range(10)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    items = spark.read.schema(schema).parquet(f"{tmp_path}/in/*")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    calls = []

    def work(batch, heal=False):
        bad = (F.col("weight") % 5 == 3) if not heal else (F.col("weight") == 8)
        return batch.select("item_id", F.when(bad, "failed").when(F.col("weight") == 9, "skipped").otherwise("success").alias("status"), F.when(bad, "boom").alias("error"))

    def dying(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return work(batch)

    log, check = f"{tmp_path}/log", f"{tmp_path}/cp"
    with pytest.raises(Exception, match="killed"):
        jobs.run(stream(), dying, log, check).awaitTermination(120)
    assert jobs.summary(items, jobs.states(spark, log)).first().status == "running"
    # What a batch left before it died is replaced.
    spark.createDataFrame([("5", "success", None, 1), ("999", "failed", "half written", 1)], jobs.LOG).write.parquet(f"{log}/batch=new-000000000001")
    jobs.run(stream(), dying, log, check).awaitTermination(120)
    jobs.run(stream(), dying, log, check).awaitTermination(120)
    got = {r.item_id: (r.status, r.attempts) for r in jobs.states(spark, log).collect()}
    assert got == {str(i): ("failed" if i % 5 == 3 else "skipped" if i % 10 == 9 else "success", 1) for i in range(40)}
    assert jobs.retry_failed(spark, items, lambda b: work(b, True), log, limit=3) == 2
    got = {r.item_id: (r.status, r.attempts) for r in jobs.states(spark, log).collect()}
    assert got["3"] == ("success", 2) and got["8"] == ("failed", 3) and got["0"] == ("success", 1)
    assert jobs.retry_failed(spark, items, work, log, limit=3) == 0
    assert tuple(jobs.summary(items, jobs.states(spark, log)).first()) == (40, 32, 4, 4, 0, "partial")
