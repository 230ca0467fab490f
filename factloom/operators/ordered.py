"""Order-dependent operators that hold up when one key owns a large share of the rows.

Picking one row per key is an aggregate, so it combines before the shuffle. Running totals, row
numbers and look-backs are done in two levels: rows are windowed inside (key, segment), one summary
row per (key, segment) is windowed inside the key, and the two are joined on (key, segment). `segment`
is any column that never decreases along the order (an hour of the timestamp, a block of an ordinal):
a key with a third of the table is then spread over as many tasks as it has segments. NULL keys and
NULL segments are keys and segments like any other, NULL first; the order must be total within a key."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.session import materialise


def _pick(df: DataFrame, keys: list[str], order: list, chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, "_row.*").select(*df.columns)


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The earliest row of each key. Keys group NULL with NULL."""
    return _pick(df, keys, order, F.min_by)


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    return _pick(df, keys, order, F.max_by)


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """The first `k` rows of each key. The filter on the row number lets Spark keep at most `k` rows
    per key and input partition before the shuffle."""
    numbered = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= k)
    return numbered.withColumnRenamed("_rank", rank) if rank else numbered.drop("_rank")


def _carried(df: DataFrame, keys: list[str], segment: str, summary: DataFrame, carried: list[str]) -> DataFrame:
    on = keys + [segment]
    side = summary.select(*[F.col(c).alias(f"_on_{i}") for i, c in enumerate(on)], *carried)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{i}")) for i, c in enumerate(on)])
    return df.join(side, same, "inner").drop(*[f"_on_{i}" for i in range(len(on))])


def running(
    df: DataFrame, keys: list[str], order: list, segment: str, kind: str, value: Column, out: str,
    include_current: bool = True,
) -> DataFrame:
    """Running `sum` or `max` of `value` along `order` within `keys`."""
    combine = {"sum": F.sum, "max": F.max}[kind]
    inside = W.partitionBy(*keys, segment).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    earlier = W.partitionBy(*keys).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    valued = df.withColumn("_v", value)
    summary = valued.groupBy(*keys, segment).agg(combine("_v").alias("_total"))
    summary = summary.withColumn("_before", combine("_total").over(earlier))
    scanned = _carried(valued.withColumn("_here", combine("_v").over(inside)), keys, segment, summary, ["_before"])
    if kind == "sum":
        result = F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(F.col("_here"), F.lit(0))
    else:
        result = F.greatest("_before", "_here")
    return scanned.withColumn(out, result).drop("_v", "_here", "_before")


def row_numbers(df: DataFrame, keys: list[str], order: list, segment: str, out: str, tasks: int | None = None) -> DataFrame:
    """1-based position of each row within its key (or within the table when `keys` is empty). `tasks` deals the rows of the keys
    over so many tasks, else it is the session's number."""
    if not keys:
        summary = _table_offsets(df.groupBy(segment).agg(F.count(F.lit(1)).alias("_n")), segment)
        scanned = _carried(df.withColumn("_here", F.row_number().over(W.partitionBy(segment).orderBy(*order))), keys, segment, summary, ["_before"])
        return scanned.withColumn(out, F.col("_before") + F.col("_here")).drop("_before", "_here")
    # (key, segment) as one struct: never NULL, and NULLs inside are equal, so the window, the summary and the join all deal
    # by it and the rows are shuffled once.
    placed = df.withColumn("_on", F.struct(*keys, segment))
    dealt = placed if tasks is None else placed.repartition(tasks, "_on")
    scanned = dealt.withColumn("_here", F.row_number().over(W.partitionBy("_on").orderBy(*order)))
    earlier = W.partitionBy(*[f"_on.{k}" for k in keys]).orderBy(f"_on.{segment}").rowsBetween(W.unboundedPreceding, -1)
    summary = placed.groupBy("_on").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    numbered = scanned.join(summary.select("_on", "_before").hint("merge"), "_on")
    return numbered.withColumn(out, F.col("_before") + F.col("_here")).drop("_on", "_before", "_here")


def _table_offsets(summary: DataFrame, segment: str) -> DataFrame:
    """(segment, _n) with `_before`, the rows of all smaller segments of the table: prefix sums inside ranges of segments, and
    over the ranges, which are as many as there are shuffle partitions. Written, so that a range keeps its number."""
    ranged = materialise(summary.repartitionByRange(segment).withColumn("_range", F.spark_partition_id()), "segments")
    before, starts = 0, []
    for r in ranged.groupBy("_range").agg(F.sum("_n").alias("n")).orderBy("_range").toLocalIterator():
        starts.append((r["_range"], before))
        before += r["n"]
    offsets = summary.sparkSession.createDataFrame(starts, "_range int, _start long")
    earlier = W.partitionBy("_range").orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumn("_in_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(offsets, "_range")
    return summed.withColumn("_before", F.col("_start") + F.col("_in_range")).select(segment, "_n", "_before")


def previous(df: DataFrame, keys: list[str], order: list, segment: str, columns: list[str], out: str) -> DataFrame:
    """The given columns of the row before, as a struct; NULL for the first row of a key."""
    row = F.struct(*columns)
    inside = W.partitionBy(*keys, segment).orderBy(*order)
    summary = df.groupBy(*keys, segment).agg(F.max_by(row, F.struct(*order)).alias("_last"))
    summary = summary.withColumn("_before", F.lag("_last").over(W.partitionBy(*keys).orderBy(segment)))
    scanned = _carried(df.withColumn("_here", F.lag(row).over(inside)), keys, segment, summary, ["_before"])
    return scanned.withColumn(out, F.coalesce("_here", "_before")).drop("_here", "_before")


def carry_forward(df: DataFrame, keys: list[str], order: list, segment: str, value: Column, out: str) -> DataFrame:
    """The last non-NULL `value` strictly before each row."""
    inside = W.partitionBy(*keys, segment).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*keys).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    valued = df.withColumn("_v", value)
    summary = valued.groupBy(*keys, segment).agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last")
    )
    summary = summary.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier))
    scanned = _carried(
        valued.withColumn("_here", F.last("_v", ignorenulls=True).over(inside)), keys, segment, summary, ["_before"]
    )
    return scanned.withColumn(out, F.coalesce("_here", "_before")).drop("_v", "_here", "_before")


def quantile_segments(df: DataFrame, ordinal: str, rows_per_segment: int, out: str, max_segments: int = 10_000) -> DataFrame:
    """A segment column for an ordinal with no natural one: approximate quantiles over all rows, so no
    (key, segment) group exceeds about `rows_per_segment` whatever the keys look like. Any boundaries
    give the same results; they only decide the balance. Runs one count and one quantile pass."""
    from pyspark.ml.feature import Bucketizer

    wanted = min(max_segments, df.count() // rows_per_segment + 1)
    if wanted < 2:
        return df.withColumn(out, F.lit(0))
    numeric = df.withColumn("_ordinal", F.col(ordinal).cast("double"))
    cuts = numeric.approxQuantile("_ordinal", [i / wanted for i in range(1, wanted)], 0.1 / wanted)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="_ordinal", outputCol="_bucket").transform(numeric)
    return bucketed.withColumn(out, F.col("_bucket").cast("int")).drop("_ordinal", "_bucket")


# --- operators built on them --------------------------------------------------------------

def chunk_numbers(df: DataFrame, order: list, segment: str, size: int, out: str = "chunk") -> DataFrame:
    """Consecutive chunks of `size` rows in input order."""
    numbered = row_numbers(df, [], order, segment, "_position")
    return numbered.withColumn(out, F.floor((F.col("_position") - 1) / size).cast("bigint")).drop("_position")


def admit_within_budget(
    df: DataFrame, keys: list[str], order: list, segment: str, cost: Column, limit: float, degrade_at: float,
) -> DataFrame:
    """Rows taken in order while the spend before them is under the limit. Adds the spend so far, the
    decision (`admitted` or `blocked`) and whether the row starts in the degrade zone."""
    spent = running(df, keys, order, segment, "sum", cost, "spent_before", include_current=False)
    return spent.withColumn(
        "decision", F.when(F.col("spent_before") < limit, "admitted").otherwise("blocked")
    ).withColumn("degrade", F.col("spent_before") >= limit * degrade_at)


def breaker(df: DataFrame, keys: list[str], order: list, segment: str, failed: Column, limit: int) -> DataFrame:
    """Skip everything after `limit` failures in a row. A skipped row cannot reset the count, so the
    first time a key reaches the limit decides. Adds `position`, `streak` and `skipped`.

    One pass inside (key, segment), then one summary per segment: its length, its leading run of failures, its last good
    row and its first own trip. Folded along the key's segments they say how many rows and failures come before a
    segment and where the key trips; joined back once, they complete every row."""
    inside = W.partitionBy(*keys, segment).orderBy(*order)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("_failed", failed).withColumn("_pos", F.row_number().over(inside))
    rows = rows.withColumn("_good", F.max(F.when(~F.col("_failed"), F.col("_pos"))).over(so_far))
    own = F.col("_good").isNotNull() & (F.col("_pos") - F.col("_good") >= limit)
    summary = rows.groupBy(*keys, segment).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(~F.col("_failed"), F.col("_pos"))).alias("_first_good"), F.max("_good").alias("_last_good"),
        F.min(F.when(own, F.col("_pos"))).alias("_own_trip"),
    )
    earlier = W.partitionBy(*keys).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    summary = summary.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    carry = F.col("_before") - F.coalesce(F.max(F.col("_before") + F.col("_last_good")).over(earlier), F.lit(0))
    summary = summary.withColumn("_carry", carry)
    leading = F.coalesce(F.col("_first_good") - 1, F.col("_n"))
    at_once = F.when(F.col("_carry") + leading >= limit, F.greatest(limit - F.col("_carry"), F.lit(1)))
    trip = F.col("_before") + F.least(F.when((leading > 0) & at_once.isNotNull(), at_once), F.col("_own_trip"))
    summary = summary.withColumn("_trip", F.min(trip).over(W.partitionBy(*keys)))
    scanned = _carried(rows, keys, segment, summary, ["_before", "_carry", "_trip"])
    position = F.col("_before") + F.col("_pos")
    streak = F.when(F.col("_good").isNull(), F.col("_carry") + F.col("_pos")).otherwise(F.col("_pos") - F.col("_good"))
    return scanned.withColumn("position", position).withColumn("streak", streak).withColumn(
        "skipped", F.coalesce(position > F.col("_trip"), F.lit(False))).drop("_failed", "_pos", "_good", "_before", "_carry", "_trip")
