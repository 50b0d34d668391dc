"""Scalar expressions on numbers and records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_digit(amount: Column) -> Column:
    """Leading significant digit; null for zero and null."""
    return F.nullif(F.regexp_extract(F.format_string("%.15e", F.abs(amount.cast("double"))), "^([1-9])", 1), F.lit("")).cast("int")


def canonical_json(fields: Mapping[str, tuple[Column, str]]) -> Column:
    """A record as JSON with sorted keys, numbers of six decimals, UTC times, nulls left out."""
    out = []
    for name in sorted(fields):
        c, kind = fields[name]
        if kind in ("double", "float", "decimal"):
            c = F.format_string("%.6f", c.cast("double"))
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        out.append(c.alias(name))
    return F.to_json(F.struct(*out), {"ignoreNullFields": "true"})


def money(amount: Column) -> Column:
    """Exact decimal from the written form of a number."""
    return amount.cast("string").try_cast("decimal(38,6)")
