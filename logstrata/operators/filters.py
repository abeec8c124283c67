"""Row filters."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _members(value) -> list:
    return list(value) if isinstance(value, (list, set, tuple)) else [value]


def keep_rows(df: DataFrame, keep: Mapping | None) -> DataFrame:
    """Rows in which every named column equals its value, or one of its list of values."""
    for column, value in (keep or {}).items():
        df = df.filter(F.col(column).isin(_members(value)))
    return df


def except_rows(df: DataFrame, drop: Mapping | None) -> DataFrame:
    """Rows in which no named column has its value. A NULL differs from every value."""
    for column, value in (drop or {}).items():
        members = _members(value)
        if members:
            df = df.filter(F.col(column).isNull() | ~F.col(column).isin(members))
    return df


def has_value(df: DataFrame, attribute: str, value: Column | str) -> Column:
    """Element match in a list column, substring match in a text column."""
    value = value if isinstance(value, Column) else F.lit(value)
    if isinstance(df.schema[attribute].dataType, T.ArrayType):
        return F.array_contains(F.col(attribute), value)
    return F.contains(F.col(attribute), value)


def label_condition(df: DataFrame, attribute: str, value: Column | str, keep: bool = True,
                    drop_missing: bool = True) -> Column:
    """The condition of :func:`filter_issues` as a column; never NULL."""
    if attribute not in df.columns:
        return F.lit(not drop_missing)
    match = F.coalesce(has_value(df, attribute, value), F.lit(False))
    present = F.col(attribute).isNotNull() & (match if keep else ~match)
    return present if drop_missing else F.col(attribute).isNull() | present


def filter_issues(issues: DataFrame, attribute: str, value: Column | str, keep: bool = True,
                  drop_missing: bool = True) -> DataFrame:
    """Keep (or drop) the rows whose attribute holds the value.

    ``drop_missing`` decides about rows without the attribute, in either mode.
    """
    return issues.filter(label_condition(issues, attribute, value, keep, drop_missing))


def any_of(conditions: list[Column]) -> Column:
    """Some condition holds; of none, none does."""
    return reduce(lambda left, right: left | right, conditions) if conditions else F.lit(False)
