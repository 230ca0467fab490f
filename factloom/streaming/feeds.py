"""Change feeds as streams: fold, dedupe and diff as records arrive.

Each function has a batch twin in the operators; on the same rows both give the same result."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions import fixed
from factloom.operators.joins import salted_join
from factloom.operators.ordered import latest
from factloom.operators.refresh import consecutive_changes
from factloom.streaming import state_log


# --- last event decides -------------------------------------------------------------------

def fold_feed(events: DataFrame, key: str, order: list[str], is_active: Column) -> DataFrame:
    """The keys whose last event is active, with that event (batch). One aggregate per key."""
    return latest(events.withColumn("_active", is_active), [key], order).filter("_active").drop("_active")


def changed_state(events: DataFrame, state: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The state after a batch of events: per key the later of what was known and what arrived."""
    return latest(state.unionByName(events, allowMissingColumns=True), [key], order)


def upsert_fold(path: str, key: str, order: list[str], buckets: int = state_log.BUCKETS, fanout: int = state_log.FANOUT):
    """A foreachBatch writer that keeps the last event per key as a log of runs (see `state_log`): a batch writes in proportion
    to its own events, and repeating it after a failure gives the same table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        state_log.append(batch, batch_id, path, key, order, buckets, fanout)

    return write


def read_fold(spark: SparkSession, path: str, key: str, order: list[str], before: int | None = None) -> DataFrame | None:
    """The last event of every key, or None when nothing was written yet."""
    state = state_log.read_state(spark, path, key, order, before)
    return None if state is None else state.drop("bucket")


# --- the modification window --------------------------------------------------------------

def stream_window(events: DataFrame, at: str, key: list[str], page: str, days: int = fixed.FEED_WINDOW_DAYS, max_pages: int = fixed.FEED_PAGE_CAP) -> DataFrame:
    """The stream form of `feed_window`: an event counts once, as long as it is less than `days` days behind the newest event
    seen up to the batch before the last; a later one is dropped by the watermark and counted (see `late_rows`). The page cap
    is a page's number, so it holds across batches."""
    recent = events.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(key)
    return recent.withColumn("truncated", F.col(page) >= max_pages)


def late_rows(query: StreamingQuery) -> int:
    """Events a stream dropped for coming too late, over the batches whose progress Spark still holds."""
    return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])


def feed_window(events: DataFrame, at: str, now: Column, page: str, days: int = fixed.FEED_WINDOW_DAYS, max_pages: int = fixed.FEED_PAGE_CAP) -> DataFrame:
    """The batch form: events modified in the last `days` days, with `truncated` on those beyond the page cap
    (flagged, not dropped)."""
    recent = events.filter(F.col(at) >= now - F.make_interval(days=F.lit(days)))
    return recent.withColumn("truncated", F.col(page) >= max_pages)


def window_report(window: DataFrame, page: str, is_active: Column) -> DataFrame:
    """One row: pages read, events, active events, and whether the page cap was reached."""
    return window.agg(
        F.count_distinct(page).alias("pages"), F.count(F.lit(1)).alias("events"), F.count_if(is_active).alias("active"),
        F.coalesce(F.max("truncated"), F.lit(False)).alias("truncated"),
    )


# --- once per day -------------------------------------------------------------------------

def daily_dedupe(fetches: DataFrame, key: list[str], at: str) -> DataFrame:
    """One row per key and calendar day, with its first and last time and count. Works on a stream: the day is
    a tumbling window and closes with the watermark."""
    return fetches.groupBy(*key, F.window(at, "1 day").alias("_w")).agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("fetches")
    ).select(*key, F.to_date("_w.start").alias("day"), "first_at", "last_at", "fetches")


# --- changes as snapshots arrive ----------------------------------------------------------

def snapshot_diff(state_path: str, changes_path: str, fields: list[str], key: str = "org_number", at: str = "run_timestamp"):
    """A foreachBatch writer that turns arriving snapshots (key, at, fields...) into typed change rows.

    The state is the last snapshot per key. A batch is compared in order with it and within itself by the
    two-level look-back, so a key that fills a batch is still many tasks. A repeated or older snapshot changes
    nothing, and a batch repeated after a failure overwrites its own output."""
    save = upsert_fold(state_path, key, [at])  # writes in proportion to the batch; the state's own rows stay where they are

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = batch.select(key, at, *fields).dropDuplicates([key, at])
        known = read_fold(spark, state_path, key, [at], before=batch_id)
        timeline = arrived
        if known is not None:
            last = known.select(key, F.col(at).alias("_last"))
            newer = salted_join(arrived, last, [key], "left").filter(F.col("_last").isNull() | (F.col(at) > F.col("_last"))).drop("_last")
            timeline = newer.unionByName(known.join(newer.select(key).distinct(), key, "left_semi").select(key, at, *fields))
        changes = consecutive_changes(timeline.withColumn("_segment", F.to_date(at)), key, [at], "_segment", fields)
        changes.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(changes_path)
        save(arrived, batch_id)

    return write
