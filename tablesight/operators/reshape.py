"""Structural hints executed: splitting multi-value and range cells, and the reports behind reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesight.functions import cells

_SPLIT = r"\s*[,;|]\s*"
_RANGE = r"^\s*(.+?)\s*(?:~| to )\s*(.+?)\s*$"


def split_multiselect(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Child table: one row per key and selected token."""
    tokens = F.posexplode(F.filter(F.split(F.trim(F.col(column)), _SPLIT), lambda x: x != ""))
    return df.select(*keys, tokens.alias("token_index", "token")).withColumn("token_index", F.col("token_index") + 1)


def multiselect_one_hot(df: DataFrame, keys: Sequence[str], column: str, tokens: Sequence[str]) -> DataFrame:
    """One 0/1 column per known token; a projection, so rows are neither multiplied nor shuffled."""
    have = F.split(F.trim(F.col(column)), _SPLIT)
    return df.select(*keys, *[
        F.coalesce(F.array_contains(have, t), F.lit(False)).cast("int").alias(f"{column}_{t.lower()}") for t in tokens])


def split_range(df: DataFrame, column: str) -> DataFrame:
    """Adds ``<column>_start`` and ``<column>_end`` (null where the cell is not a range)."""
    part = lambda i: F.when(F.col(column).rlike(_RANGE), F.regexp_extract(column, _RANGE, i))
    return df.withColumns({f"{column}_start": part(1), f"{column}_end": part(2)})


def range_review(df: DataFrame, column: str) -> DataFrame:
    """Rows whose range has a missing side or runs backwards."""
    start, end = (F.col(f"{column}_{s}") for s in ("start", "end"))
    backwards = cells.as_double(start) > cells.as_double(end)
    return df.filter(start.isNull() | end.isNull() | F.coalesce(backwards, F.lit(False)))


def unit_report(df: DataFrame, column: str) -> DataFrame:
    """How often each unit follows a number in the column."""
    unit = F.regexp_extract(cells.trimmed(F.col(column)), r"^[-+]?[0-9.]+\s*([A-Za-z★%]+)$", 1)
    return df.groupBy(unit.alias("unit")).agg(F.count(F.lit(1)).alias("n"))


def start_end_violations(df: DataFrame, start: str, end: str) -> DataFrame:
    ordered = F.col(start) <= F.col(end)
    return df.agg(F.count(ordered).alias("checked"), F.count_if(~ordered).alias("violations"))


def review_report(contract: DataFrame) -> DataFrame:
    """Open structural hints per run; confirmed scales and placed children have already lost theirs."""
    return contract.select("run_id", F.explode("structural_transform_hints").alias("hint")).groupBy("run_id", "hint").agg(
        F.count(F.lit(1)).alias("n_columns"))
