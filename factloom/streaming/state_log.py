"""Keyed state as a log of runs: a batch appends its own last row per key, reading merges, compaction keeps the runs few.

A run is a folder of rows, one per key, split by a hash bucket of the key. A batch writes one run of level 0; when a level has
`fanout` runs they become one run of the next level, so a row is rewritten once per level and a batch writes in
proportion to its own rows, whatever the state holds. Which runs are live is a small table per batch, the manifest; it
is written last, so a batch that breaks off changes nothing, and a repeated batch starts from the manifest before
it and writes the same names again. Runs that neither of the last two manifests names are removed."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.ordered import latest

BUCKETS, FANOUT = 64, 4
_MANIFEST = "run string, level int, batch long, rows long"


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, path: str) -> list[str]:
    files, folder = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def _published(spark: SparkSession, path: str) -> list[int]:
    """Batches with a complete manifest, in order."""
    files, _ = _files(spark, path)
    done = [n for n in _names(spark, f"{path}/manifests") if files.exists(_files(spark, f"{path}/manifests/{n}/_SUCCESS")[1])]
    return sorted(int(n) for n in done)


def live_runs(spark: SparkSession, path: str, before: int | None = None) -> list:
    """The runs that make up the state (run, level, batch, rows): a few per level."""
    batches = [b for b in _published(spark, path) if before is None or b < before]
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/{batches[-1]:012d}").orderBy("run").collect() if batches else []


def read_runs(spark: SparkSession, path: str, runs: list, key: str, order: list[str]) -> DataFrame | None:
    if not runs:
        return None
    return latest(reduce(lambda a, b: a.unionByName(b), [spark.read.parquet(f"{path}/runs/{r.run}") for r in runs]), [key], order)


def read_state(spark: SparkSession, path: str, key: str, order: list[str], before: int | None = None) -> DataFrame | None:
    """The last row of every key with its `bucket`, or None when nothing was published yet (before a batch)."""
    return read_runs(spark, path, live_runs(spark, path, before), key, order)


def with_bucket(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def append(batch: DataFrame, batch_id: int, path: str, key: str, order: list[str], buckets: int = BUCKETS, fanout: int = FANOUT) -> None:
    """Publish the state after one more batch. Batches are numbered upwards; a number may be repeated after a failure."""
    spark = batch.sparkSession
    runs = live_runs(spark, path, before=batch_id)

    def write(rows: DataFrame, level: int):
        name = f"{batch_id:012d}-{level}"
        # rows of a bucket go to one task, so a run has one file a bucket
        rows.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/runs/{name}")
        return spark.createDataFrame([(name, level, batch_id, spark.read.parquet(f"{path}/runs/{name}").count())], _MANIFEST).first()

    runs.append(write(latest(with_bucket(batch, key, buckets), [key], order), 0))
    level = 0
    while len(full := [r for r in runs if r.level == level]) >= fanout:
        merged = write(read_runs(spark, path, full, key, order), level + 1)
        runs = [r for r in runs if r.level != level] + [merged]
        level += 1
    spark.createDataFrame([tuple(r) for r in runs], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{batch_id:012d}")
    _clean(spark, path, batch_id)


def _clean(spark: SparkSession, path: str, batch_id: int) -> None:
    """Remove what neither this manifest nor the one before it names: a reader of the last state may still be at work."""
    kept = [b for b in _published(spark, path) if b <= batch_id][-2:]
    named = {r.run for b in kept for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/{b:012d}").collect()}
    for folder, keep in (("manifests", {f"{b:012d}" for b in kept}), ("runs", named)):
        for name in _names(spark, f"{path}/{folder}"):
            if name not in keep and int(name[:12]) <= batch_id:
                files, at = _files(spark, f"{path}/{folder}/{name}")
                files.delete(at, True)
