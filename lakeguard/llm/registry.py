"""Queries of the llm operators, with SQL for those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("decontaminate", "toxicity", "simhash", "tokens", "ngram_lm", "html_text", "embeddings", "mixing", "quality", "substrings", "whitening", "periods", "suffixes")


def _gather(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        out |= getattr(import_module(f"lakeguard.llm.{module}"), name)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
