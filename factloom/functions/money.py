"""Amounts and the words for how they moved."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AMOUNT = r"(?U)^\s*(-?[\d,]+)\s*([A-Z]{3})?\s*$"


def amount_text(amount: Column, currency: Column) -> Column:
    """`197,053,257 NOK`."""
    return F.trim(F.concat(F.format_number(amount, 0), F.lit(" "), F.coalesce(currency, F.lit(""))))


def accounts_line(revenue: Column, result: Column, currency: Column) -> Column:
    """`Revenue: ... ; Net result: ...`, each part only when the filing states it; empty when it states neither."""
    return F.concat_ws(
        "; ",
        F.concat(F.lit("Revenue: "), amount_text(revenue, currency)),
        F.concat(F.lit("Net result: "), amount_text(result, currency)),
    )


def accounts_text(revenue: Column, result: Column, currency: Column) -> Column:
    """`accounts_line`, NULL when the filing states neither part."""
    return F.nullif(accounts_line(revenue, result, currency), F.lit(""))


def amount(text: Column) -> Column:
    return F.replace(F.regexp_extract(text, _AMOUNT, 1), F.lit(","), F.lit("")).try_cast("bigint")


def currency(text: Column) -> Column:
    return F.when(text.rlike(_AMOUNT), F.regexp_extract(text, _AMOUNT, 2))


def _scaled(value: Column, divisor: float, places: int) -> Column:
    return F.replace(F.format_number(value / F.lit(divisor), places), F.lit(","), F.lit(""))


def short_number(value: Column, unit: Column) -> Column:
    """`197.1 m NOK`: rounded for reading, the cited claim keeps the exact figure."""
    size = F.abs(value)
    text = (
        F.when(size >= 1_000_000_000, F.concat(_scaled(value, 1e9, 2), F.lit(" bn")))
        .when(size >= 1_000_000, F.concat(_scaled(value, 1e6, 1), F.lit(" m")))
        .when(size >= 10_000, F.concat(_scaled(value, 1e3, 0), F.lit(" k")))
        .otherwise(F.format_number(value, 0))
    )
    return F.trim(F.concat(text, F.lit(" "), F.coalesce(unit, F.lit(""))))


def short_amount(text: Column) -> Column:
    return F.coalesce(short_number(amount(text), currency(text)), text)


def percent_change(now: Column, before: Column) -> Column:
    """Change on the earlier figure in percent; NULL on a zero base."""
    return F.try_divide(now - before, F.abs(before)) * 100
