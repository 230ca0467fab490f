"""Provenance bookkeeping: claim order, numbered evidence, numbered sources, verbatim checks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.operators.joins import salted_join, salts_of
from factloom.operators.ordered import row_numbers


def field_rank(field: Column, fields: list[str] = fixed.CLAIM_FIELDS) -> Column:
    """Place of a field in the published order; unknown fields last."""
    table = F.create_map(*[F.lit(x) for i, f in enumerate(fields) for x in (f, i)])
    return F.coalesce(F.element_at(table, field), F.lit(len(fields)))


def numbered_by_first_use(
    rows: DataFrame, keys: list[str], source: list[str], order: list[str], out: str, segment_size: int = 1000, described: list[str] | None = None, together: bool = False
) -> DataFrame:
    """Number the distinct sources of each key 1, 2, 3... in the order they are first used, and give every
    row its number. The first use is an aggregate, the numbering scans (key, block of the ordinal), and a
    source much of a key cites is spread by the salted join. `order[0]` is a number. `rows` are read twice and have to be the
    same both times: a written table, or a plan without ties. `described` adds these columns of the first use as `first_use`.
    Rows that stand `together`, a key's few in one task, are read once and numbered where they are."""
    named = rows.withColumn("_id", F.to_json(F.struct(*source)))
    use = F.min(F.struct(*order, *(described or [])))
    kept = [*rows.columns, out]
    if together:
        placed = named.dropna(subset=keys).withColumn("_first", use.over(W.partitionBy(*keys, "_id")))
        found = placed.withColumn(out, F.dense_rank().over(W.partitionBy(*keys).orderBy("_first", "_id")).cast("bigint"))
    else:
        first = named.groupBy(*keys, "_id").agg(use.alias("_first"), salts_of(named).alias("_salts"))
        placed = first.withColumn("_block", F.floor(F.col(f"_first.{order[0]}") / segment_size))
        numbers = row_numbers(placed, keys, ["_first"], "_block", out).select(*keys, "_id", "_salts", out, *(["_first"] if described else []))
        found = salted_join(named, numbers, [*keys, "_id"], "inner", used="_salts")
    return found.select(*kept, *([F.struct(*[F.col(f"_first.{c}") for c in described]).alias("first_use")] if described else []))


def evidence_key(source: Column, content_hash: Column, span: Column, value: Column) -> Column:
    """What makes two claims share one evidence entry: source, hash and the span that supports the claim."""
    return F.struct(source.alias("source"), content_hash.alias("content_hash"), F.coalesce(span, value).alias("span"))


def span_checks(evidence: DataFrame, bodies: DataFrame, hash_column: str, span: str, body: str) -> DataFrame:
    """`evidence` with `verbatim`: the span occurs in the stored text with this hash; NULL when the text is
    not stored. A text can back much of the evidence, hence the salted join."""
    one_body = bodies.select(hash_column, body).dropDuplicates([hash_column])
    joined = salted_join(evidence, one_body, [hash_column], "left")
    return joined.withColumn("verbatim", F.contains(F.col(body), F.col(span))).drop(body)


def verbatim_shares(checked: DataFrame, by: list[str]) -> DataFrame:
    """Spans found, missing and unchecked per source class."""
    return checked.groupBy(*by).agg(
        F.count_if("verbatim").alias("found"), F.count_if(~F.col("verbatim")).alias("missing"), F.count_if(F.col("verbatim").isNull()).alias("unchecked")
    )
