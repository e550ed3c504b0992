"""The column transform actions a contract may name, as Column -> Column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesight.functions import cells
from tablesight.plans.shared import left_join_lookup

DECIMAL = "decimal(38,9)"


def normalize_missing_tokens(c: Column) -> Column:
    return F.when(~cells.is_missing(c), c)


def cast_to_integer(c: Column) -> Column:
    """Whole numbers only; text with a fractional part becomes null rather than being cut."""
    exact = c.cast("string").try_cast(DECIMAL)
    return F.when(exact == F.floor(exact), exact.try_cast("bigint"))


def normalize_decimal_separator(c: Column) -> Column:
    """``1.234,50`` and ``3,5`` to a point; only a single comma after the last dot is a separator."""
    comma = c.rlike(r"^[-+]?[0-9.]*,[0-9]+$")
    return F.when(comma, F.regexp_replace(F.regexp_replace(c, r"\.", ""), ",", ".")).otherwise(c)


def normalize_category_tokens(c: Column) -> Column:
    return F.lower(F.regexp_replace(cells.trimmed(c), r"[\s_-]+", " "))


def extract_numeric_component(c: Column) -> Column:
    found = F.regexp_extract(c, r"[-+]?[0-9]*\.?[0-9]+", 0)
    return F.when(found != "", found)


def strip_unit_suffix(c: Column) -> Column:
    """Drop a unit behind a number; thousand and million suffixes scale the number instead."""
    number = F.regexp_extract(c, r"^[^0-9+-]*([-+]?[0-9]*\.?[0-9]+)", 1).try_cast(DECIMAL)
    scaled = F.when(c.rlike(r"[0-9]\s*[Kk]$"), (number * 1000).cast(DECIMAL)).when(c.rlike(r"[0-9]\s*M$"), (number * 1000000).cast(DECIMAL))
    plain = F.regexp_replace(c, r"([0-9])\s*[A-Za-z★%]+$", "$1")
    return F.coalesce(F.regexp_replace(scaled.cast("string"), r"\.?0+$", ""), plain)


def standardize_percent_scale(c: Column) -> Column:
    """``45%`` to 0.45; numbers without the sign are left alone."""
    text = cells.trimmed(c)
    share = F.regexp_replace(text, r"\s*%$", "").try_cast(DECIMAL) / 100
    return F.when(text.endswith("%"), share.cast("string")).otherwise(c)


ACTIONS: dict[str, Callable[[Column], Column]] = {
    "trim_whitespace": cells.trimmed,
    "normalize_missing_tokens": normalize_missing_tokens,
    "normalize_boolean_tokens": cells.as_boolean,
    "cast_to_string": lambda c: c.cast("string"),
    "cast_to_integer": cast_to_integer,
    "cast_to_decimal": lambda c: c.cast("string").try_cast(DECIMAL),
    "cast_to_date": cells.as_date,
    "cast_to_datetime": cells.as_datetime,
    "strip_numeric_formatting": cells.bare_number,
    "normalize_decimal_separator": normalize_decimal_separator,
    "lowercase_values": F.lower,
    "uppercase_values": F.upper,
    "titlecase_values": F.initcap,
    "normalize_category_tokens": normalize_category_tokens,
    "extract_numeric_component": extract_numeric_component,
    "strip_unit_suffix": strip_unit_suffix,
    "standardize_percent_scale": standardize_percent_scale,
}


def apply_actions(c: Column, actions: Sequence[str]) -> Column:
    """Chain the named actions in order."""
    for name in actions:
        c = ACTIONS[name](c)
    return c


def clean(df: DataFrame, plan: dict[str, Sequence[str]]) -> DataFrame:
    """Apply each column's actions; one projection, whatever the number of columns."""
    return df.withColumns({f"{name}": apply_actions(F.col(f"`{name}`"), actions) for name, actions in plan.items()})


def map_aliases(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Replace normalised category texts by their canonical spelling where an alias is known.

    ``aliases`` has alias and canonical.
    """
    keyed = df.withColumn("alias", normalize_category_tokens(F.col(column)))
    return left_join_lookup(keyed, aliases, ["alias"]).withColumn(column, F.coalesce("canonical", F.col(column))).drop("alias", "canonical")
