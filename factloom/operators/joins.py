"""Join shapes that stay safe under hot keys.

No join here carries a broadcast hint: Spark broadcasts a side only when its measured size is under
`spark.sql.autoBroadcastJoinThreshold`, and shuffles otherwise. Where the large side is known to
have hot keys, `salted_join` spreads them first and never broadcasts."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.ordered import first_wins

SALTS = 16


def _salt(big: DataFrame, salts: int) -> Column:
    return F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")


def salts_of(big: DataFrame, salts: int = SALTS) -> Column:
    """Aggregate over rows of `big`: a bit for each salt that `salted_join` gives one of them. `salts` is at most 62."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), _salt(big, salts)))


def salted_join(
    big: DataFrame, lookup: DataFrame, on: list[str], how: str = "left", salts: int = SALTS, used: str | None = None
) -> DataFrame:
    """`big` joined to a table with few rows per key. Each row of `big` takes one of `salts` salts from
    its own content, each lookup row is repeated once per salt, so a hot key becomes `salts` keys. Spark estimates the
    repeated lookup by the size of the files it came from, many times too low, so it is merged and never collected.

    A lookup summed up from `big` itself knows which salts its key has: `used` names its column of `salts_of`, and the lookup is
    repeated for those only, never more rows than `big` has."""
    left = big.withColumn("_salt", _salt(big, salts))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    wanted = every if used is None else F.filter(every, lambda s: F.getbit(F.col(used), s) == 1)
    right = lookup.withColumn("_salt", F.explode(wanted))
    return left.join((right if used is None else right.drop(used)).hint("merge"), on + ["_salt"], how).drop("_salt")


def prefer(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `primary`, and those of `fallback` whose key the primary does not have."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def ranked_union(sources: list[DataFrame], keys: list[str], order: list, rank: str = "source_rank") -> DataFrame:
    """The best-ranked source per key, earlier sources first."""
    tagged = [df.withColumn(rank, F.lit(i)) for i, df in enumerate(sources)]
    return first_wins(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), keys, [rank, *order])


def fill_from(keys: DataFrame, sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Every key once, each column from the first source that has it."""
    out = keys.select(key).distinct()
    for i, source in enumerate(sources):
        out = out.join(source.select(key, *[F.col(c).alias(f"_{i}_{c}") for c in columns]), key, "left")
    return out.select(key, *[F.coalesce(*[F.col(f"_{i}_{c}") for i in range(len(sources))]).alias(c) for c in columns])


def required_rows(keys: DataFrame, key: str, fields: list[str], present: DataFrame, state: Column) -> DataFrame:
    """One row per (key, required field) that `present` does not have."""
    wanted = keys.select(key).distinct().withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))
    return wanted.join(present.select(key, "field").distinct(), [key, "field"], "left_anti").withColumn("state", state)


def one_per_input(inputs: DataFrame, results: DataFrame, key: str, state: str) -> DataFrame:
    """Exactly one row per input: a key without a result becomes a `failed` row."""
    unique = inputs.select(key).distinct()
    return unique.join(results, key, "left").withColumn(state, F.coalesce(F.col(state), F.lit("failed")))


def set_changes(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in one set and not the other, tagged `removed` or `added`. One aggregate, no join."""
    both = old.select(*columns).withColumn("_old", F.lit(1)).withColumn("_new", F.lit(0)).unionByName(
        new.select(*columns).withColumn("_old", F.lit(0)).withColumn("_new", F.lit(1))
    )
    sides = both.groupBy(*columns).agg(F.max("_old").alias("_old"), F.max("_new").alias("_new"))
    return sides.filter(F.col("_old") != F.col("_new")).select(
        *columns, F.when(F.col("_new") == 1, "added").otherwise("removed").alias("kind")
    )


def latest_before(events: DataFrame, moments: DataFrame, key: str, event_time: str, moment_time: str, columns: list[str]) -> DataFrame:
    """As-of lookup: for each moment the newest event of its key strictly earlier. The moments of a key
    are taken as one per key; the event side is reduced before the shuffle. Join on the key, keep
    earlier events, combine."""
    joined = salted_join(events.select(key, event_time, *columns), moments.select(key, moment_time), [key], "inner")
    earlier = joined.filter(F.col(event_time) < F.col(moment_time))
    found = earlier.groupBy(key, moment_time).agg(F.max_by(F.struct(event_time, *columns), F.struct(event_time, *columns)).alias("_e"))
    return moments.join(found, [key, moment_time], "left").select(*moments.columns, "_e.*")
