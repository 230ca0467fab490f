"""Seeded samples of keys."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import materialise

_DIGITS = 4  # of the hash: 65,536 buckets


def seeded_keys(df: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """`count` keys chosen by the seed alone, whatever the input order; all of them when there are fewer.

    The keys with the smallest hashes. How many there are per leading digits of the hash tells the bucket in which the last one
    lies: smaller buckets are taken whole, only that one is sorted, so a large sample is never brought together."""
    hashed = df.select(key).distinct().withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    keys = materialise(hashed.withColumn("_bucket", F.left("_hash", F.lit(_DIGITS))), "hashed-keys")
    before, last = 0, None
    for r in keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("_bucket").asc_nulls_last()).toLocalIterator():
        if before + r["n"] >= count:
            last = r["_bucket"]
            break
        before += r["n"]
    else:
        return keys.select(key).orderBy(key)
    edge = keys.filter(F.col("_bucket").eqNullSafe(F.lit(last))).orderBy(F.col("_hash").asc_nulls_last(), key).limit(count - before)
    whole = keys.filter("_bucket IS NOT NULL") if last is None else keys.filter(F.col("_bucket") < last)
    return whole.select(key).unionByName(edge.select(key)).orderBy(key)
