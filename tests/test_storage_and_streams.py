"""Appends are idempotent, and streams give what the batch operators give."""
from pyspark.sql import functions as F

from factloom import schemas
from factloom.operators import quality, refresh
from factloom.sources import sinks, tables
from factloom.streaming import feeds, state_log


def claims(spark, day, value):
    rows = spark.createDataFrame([(f"{i:09d}", value, f"2024-05-{day:02d} 10:00:00") for i in range(20)], "org_number string, value string, at string")
    return schemas.conform(rows, schemas.CLAIM, field=F.lit("legal_name"), state=F.lit("available")).withColumn("run_timestamp", F.lit(f"2024-05-{day:02d} 10:00:00").cast("timestamp"))


def test_a_rerun_adds_nothing_and_rewrites_nothing(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    sinks.append_snapshots(claims(spark, 1, "A"), path, spark)
    before = quality.partition_totals(tables.snapshots(spark, path), ["run_date"], ["org_number", "value"]).cache()
    assert before.count() == 1
    sinks.append_snapshots(claims(spark, 1, "A"), path, spark)
    sinks.append_snapshots(claims(spark, 2, "B"), path, spark)
    after = quality.partition_totals(tables.snapshots(spark, path), ["run_date"], ["org_number", "value"])
    assert after.agg(F.sum("rows")).first()[0] == 40
    assert quality.rewritten_partitions(before, after, ["run_date"]).count() == 0


def stream(spark, folder, schema, write, offsets):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    source.writeStream.foreachBatch(write).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()


def test_fold_over_several_batches(spark, tmp_path):
    events = spark.range(300).select((F.col("id") % 23).alias("key"), F.col("id").alias("seq"), F.when(F.col("id") % 7 < 3, "ACTIVE").otherwise("INACTIVE").alias("status"))
    folder = str(tmp_path / "events")
    for part in range(3):
        events.filter(F.floor(F.col("seq") / 100) == part).coalesce(1).write.mode("append").parquet(folder)
    path = str(tmp_path / "fold")
    stream(spark, folder, events.schema, feeds.upsert_fold(path, "key", ["seq"], buckets=4), str(tmp_path / "offsets"))
    active = F.col("status") == "ACTIVE"
    expected = {(r.key, r.seq) for r in feeds.fold_feed(events, "key", ["seq"], active).collect()}
    assert {(r.key, r.seq) for r in feeds.read_fold(spark, path, "key", ["seq"]).filter(active).collect()} == expected


def test_state_writes_by_the_batch_and_survives_a_broken_one(spark, tmp_path):
    path, expected, sizes = str(tmp_path / "state"), {}, []
    append = lambda rows, batch: state_log.append(spark.createDataFrame(rows, "k long, at long, v string"), batch, path, "k", ["at"], 4, 3)
    append([(k, 0, "first") for k in range(2000)], 0)
    for batch in range(1, 12):
        rows = [(k, batch, f"b{batch}") for k in range(batch, 40, 3)] + [(k, -1, "too old") for k in range(100, 110)]
        if batch in (4, 7):  # the run is written, the manifest is not
            spark.createDataFrame([(1, 99, "lost", 0)], "k long, at long, v string, bucket int").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/runs/{batch:012d}-0")
            assert {r.k: r.v for r in state_log.read_state(spark, path, "k", ["at"]).collect()} == {k: expected.get(k, "first") for k in range(2000)}
        append(rows, batch)
        if batch % 5 == 0:
            append(rows, batch)
        expected |= {k: v for k, at, v in rows if at > 0}
        assert {r.k: r.v for r in state_log.read_state(spark, path, "k", ["at"]).collect()} == {k: expected.get(k, "first") for k in range(2000)}
        sizes.append(sum(r.rows for r in state_log.live_runs(spark, path) if r.batch == batch and r.level == 0))
    assert max(sizes) < 60  # the large first run is not written again by small batches of its level
    assert len(list((tmp_path / "state" / "manifests").iterdir())) == 2
    assert len(list((tmp_path / "state" / "runs").iterdir())) <= 2 * 3 * 3 + 1


def test_diff_over_several_batches_and_a_repeated_batch(spark, tmp_path):
    snapshots = spark.range(120).select(
        (F.col("id") % 10).cast("string").alias("org_number"), F.timestamp_seconds(F.col("id") * 86400).alias("run_timestamp"), (F.col("id") % 4).cast("string").alias("status"))
    folder, state, out = (str(tmp_path / n) for n in ("snapshots", "state", "changes"))
    writer = feeds.snapshot_diff(state, out, ["status"])
    for part in range(3):
        batch = snapshots.filter(F.floor(F.datediff("run_timestamp", F.lit("1970-01-01").cast("date")) / 40) == part)
        writer(batch, part)
        writer(batch, part)
    expected = refresh.consecutive_changes(snapshots.withColumn("seg", F.lit(0)), "org_number", ["run_timestamp"], "seg", ["status"])
    key = lambda r: (r.org_number, r.run_timestamp, r.field, r.old, r.new)
    assert sorted(map(key, spark.read.parquet(out).collect())) == sorted(map(key, expected.collect()))


def test_daily_dedupe_streams(spark, tmp_path):
    fetches = spark.range(200).select((F.col("id") % 5).alias("url"), F.timestamp_seconds(F.col("id") * 3600).alias("at"))
    folder, out = str(tmp_path / "fetches"), str(tmp_path / "days")
    fetches.coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(fetches.schema).parquet(folder)
    days = feeds.daily_dedupe(source.withWatermark("at", "1 day"), ["url"], "at")
    days.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.url, r.day, r.fetches) for r in spark.read.parquet(out).collect()}
    assert got and got <= {(r.url, r.day, r.fetches) for r in feeds.daily_dedupe(fetches, ["url"], "at").collect()}
