import datetime as dt
import time

from pyspark.sql import functions as F

from veilcraft.operators import columns
from veilcraft.streaming import jobs as streams


def run(spark, stream, folder, sweep=False):
    query = streams.write_available(stream, f"{folder}/out", f"{folder}/state", sweep)
    if not query.awaitTermination(120):
        query.stop()
        raise AssertionError("the stream does not end")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_streamed_encryption_equals_batch(spark, cipher, tmp_path):
    source = spark.range(50).select(F.concat(F.lit("name "), F.col("id") % 7).alias("who"))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    done = run(spark, columns.encrypt_columns(stream, ["who"], cipher), tmp_path)
    want = columns.encrypt_columns(source, ["who"], cipher)
    assert sorted(r[0] for r in done.collect()) == sorted(r[0] for r in want.collect())


def stream_of(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(spark.read.parquet(str(folder)).schema).parquet(str(folder))


def test_jobs_expire_by_the_clock(spark, tmp_path):
    now = dt.datetime.now()
    ago = lambda seconds: now - dt.timedelta(seconds=seconds)
    rows = [("old", ago(1000)), ("older", ago(90000)), ("young", ago(500)), ("again", ago(2000)), ("again", ago(10)), (None, ago(5000)), ("timeless", None)]
    stream = streams.expired_jobs_stream(stream_of(spark, rows, "token string, created_at timestamp", tmp_path / "in"))
    with streams.timer_store(spark):
        gone = run(spark, stream, tmp_path, sweep=True)
    assert sorted(r["token"] for r in gone.collect()) == ["old", "older"]
    state = spark.read.format("statestore").option("stateVarName", "live").load(str(tmp_path / "state"))
    assert sorted(r["key"]["token"] for r in state.collect()) == ["again", "young"]  # live jobs only


def test_last_jobs_expire_without_newer_ones(spark, tmp_path):
    stream = streams.expired_jobs_stream(stream_of(spark, [(n, dt.datetime.now()) for n in range(5)], "token long, created_at timestamp", tmp_path / "in"), ttl_seconds=3)
    with streams.timer_store(spark):
        query = stream.writeStream.format("memory").queryName("gone_by_clock").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if spark.table("gone_by_clock").count() == 5:
                break
        assert sorted(r["token"] for r in spark.table("gone_by_clock").collect()) == [0, 1, 2, 3, 4]
    finally:
        query.stop()


def test_redemptions_meet_live_jobs_once(spark, tmp_path):
    at = lambda minute, second=0: dt.datetime(2024, 1, 1, 5 + minute // 60, minute % 60, second)
    jobs = stream_of(spark, [("a", at(0)), ("b", at(1)), ("c", at(2)), ("end", at(200))], "token string, created_at timestamp", tmp_path / "jobs")
    uses = [("a", 1, at(3)), ("a", 2, at(4)), ("b", 3, at(16)), ("c", 4, at(17, 1)), ("no", 5, at(5)), ("a", 6, at(30)), (None, 7, at(5)), ("b", 8, at(0)), ("end", 9, at(201))]
    used = stream_of(spark, uses, "token string, redemption_id int, redeemed_at timestamp", tmp_path / "used")
    served = run(spark, streams.first_redemptions_stream(jobs, used), tmp_path / "a").collect()
    assert sorted((r["token"], r["redemption_id"] in (1, 2, 3, 9)) for r in served) == [("a", True), ("b", True), ("end", True)]  # 900 s are alive, 901 are not
    refused = run(spark, streams.refused_redemptions_stream(jobs, used), tmp_path / "b").collect()
    assert sorted(r["redemption_id"] for r in refused) == [4, 5, 6, 7, 8]


def test_late_redemptions_are_refused(spark, tmp_path):
    at = lambda minute: dt.datetime(2024, 1, 1, 5 + minute // 60, minute % 60)
    kinds = "token string, created_at timestamp", "token string, redeemed_at timestamp"
    jobs = stream_of(spark, [("a", at(0)), ("z", at(200))], kinds[0], tmp_path / "jobs")
    used = stream_of(spark, [("z", at(201))], kinds[1], tmp_path / "used")
    query = streams.first_redemptions_stream(jobs, used)
    assert [r["token"] for r in run(spark, query, tmp_path).collect()] == ["z"]
    stream_of(spark, [("a", at(5)), ("z", at(202))], kinds[1], tmp_path / "used")  # in its time, but long after; and a second use
    assert [r["token"] for r in run(spark, query, tmp_path).collect()] == ["z"]


def test_repeated_columns_of_a_stream(spark, cipher, tmp_path):
    source = spark.range(20).select(F.concat(F.lit("name "), F.col("id") % 3).alias("who"))
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    done = run(spark, columns.encrypt_columns(stream, ["who"], cipher, repeated=["who"]), tmp_path)
    assert {r[0] for r in done.collect()} == {r[0] for r in columns.encrypt_columns(source, ["who"], cipher, repeated=["who"]).collect()}
