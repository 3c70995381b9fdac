"""Projections decided from the schema at plan time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, names: list[str], fill: str | None = None) -> DataFrame:
    """The named columns that exist, in that order; with fill, absent ones as NULL of that type."""
    here = set(df.columns)
    if fill is None:
        return df.select(*[quoted(n) for n in names if n in here])
    return df.select(*[quoted(n) if n in here else F.lit(None).cast(fill).alias(n) for n in names])


def containing(df: DataFrame, *parts: str) -> list[str]:
    return [c for c in df.columns if any(p.lower() in c.lower() for p in parts)]


def ending(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.lower().endswith(suffix.lower())]


def as_text(df: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[quoted(c) if c in but else quoted(c).cast("string").alias(c) for c in df.columns])


def stack(*frames: DataFrame, distinct: bool = False) -> DataFrame:
    """Rows of all frames by column name, NULL where a frame lacks a column. Types must agree; see as_text."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return rows.distinct() if distinct else rows
