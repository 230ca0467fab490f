"""Writers. Every write is an append or replaces whole partitions it owns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import schemas
from factloom.operators.joins import salted_join
from factloom.operators.ordered import first_wins, latest
from factloom.plans import envelope


def append_snapshots(claims: DataFrame, path: str, spark: SparkSession) -> None:
    """Append one run's claims, partitioned by run date. Claims whose (entity, run) is already there are left
    out, so a rerun adds nothing and rewrites nothing. `claims` carries run_timestamp."""
    dated = schemas.conform(claims, schemas.CLAIM).schema.names
    rows = claims.select(*dated, "run_timestamp").withColumn("run_date", F.to_date("run_timestamp"))
    if _exists(spark, path):
        days = rows.select("run_date").distinct()
        written = spark.read.parquet(path).join(days, "run_date", "left_semi").select("org_number", "run_timestamp").distinct()
        rows = rows.join(written, ["org_number", "run_timestamp"], "left_anti")
    rows.write.mode("append").partitionBy("run_date").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    envelope.json_lines(envelopes).write.mode("overwrite").text(path)


def write_slim(envelopes: DataFrame, path: str) -> None:
    envelope.slim_lines(envelopes).write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


# --- page store ---------------------------------------------------------------------------

def store_lookup(requests: DataFrame, store: DataFrame, url: str, bucket: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a page store keyed by (url, date bucket)."""
    kept = store.select(url, bucket, "html")
    return requests.join(kept, [url, bucket], "inner"), requests.join(kept, [url, bucket], "left_anti")


def store_put(store: DataFrame, fetched: DataFrame, url: str, bucket: str, load: str) -> DataFrame:
    """The store after a load: one row per (url, bucket), the latest load wins."""
    return latest(store.unionByName(fetched, allowMissingColumns=True), [url, bucket], [load])


def write_store_buckets(store: DataFrame, path: str, bucket: str) -> None:
    """Replace exactly the date buckets present in `store`."""
    store.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def fresh_today(fetches: DataFrame, url: str, at: str) -> DataFrame:
    """One fetch per URL and day: the first one."""
    return first_wins(fetches.withColumn("day", F.to_date(at)), [url, "day"], [at])
