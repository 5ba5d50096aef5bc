"""All registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm import chat, decontaminate, html_extract, langid, mixing, ngram_lm, quality, secrets, simhash, tokens

MODULES = (mixing, chat, decontaminate, html_extract, langid, ngram_lm, quality, secrets, simhash, tokens)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.ORACLES
    return found
