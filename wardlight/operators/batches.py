"""Restriction by ids and windows for sources that are tables, and the cutting of ids and dates into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.requests import ID_KEYS
from ..plans.windows import bounds_of
from ..sources.storage import stored

#: Rows of a list that is sent to all tasks at most.
MOST_SENT = 100_000


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed. A short list is sent to all tasks, a longer one is joined by key."""
    few = ids.limit(MOST_SENT + 1).count() <= MOST_SENT
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def within(column: Column, bounds: object) -> Column:
    """Whether a date lies in bounds as requests write them: `{lo,hi}`, `>d`, `<d`; anything else bounds nothing and holds every row. NULL dates lie in no bounds."""
    b = bounds_of(bounds)
    low = F.lit(True) if b.low is None else (column > F.lit(b.low) if b.strict else column >= F.lit(b.low))
    high = F.lit(True) if b.high is None else (column < F.lit(b.high) if b.strict else column <= F.lit(b.high))
    return F.coalesce(low & high, F.lit(False))


def most_specific_id(columns: list[str], keys: tuple[str, ...] = ID_KEYS) -> Column:
    """Of a row's identifiers the most specific one that it has, as a column of the table with these columns."""
    return F.coalesce(*[F.col(k) for k in keys if k in columns], F.lit(None))


def period_starts(start: Column, end: Column, months: int = 1) -> Column:
    """Starts of month steps from start to end. A day that a month lacks runs over into the next, as day numbers do."""
    first = F.trunc(start, "MM")
    n = F.floor(F.months_between(F.trunc(end, "MM"), first) / months).cast("int")
    steps = F.when(start <= end, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(steps, lambda i: F.date_add(F.add_months(first, i * months), F.dayofmonth(start) - 1)), lambda d: (d >= start) & (d <= end))


def period_rows(df: DataFrame, keys: list[str], start: str, end: str, months: int = 1, end_inclusive: bool = True, overlap_days: int = 0) -> DataFrame:
    """(keys, period_start, period_end) of each row's window; row by row, so without a window function."""
    starts = period_starts(F.col(start), F.col(end), months)
    back = 1 if end_inclusive else 0
    rows = df.withColumn("_s", starts)
    ends = F.transform(F.col("_s"), lambda d, i: F.least(F.date_add(F.coalesce(F.date_sub(F.get(F.col("_s"), i + 1), back), F.col(end)), overlap_days), F.col(end)))
    return rows.select(*keys, F.inline(F.arrays_zip(F.col("_s").alias("period_start"), ends.alias("period_end"))))


def assign_windows(df: DataFrame, date_col: str, periods: DataFrame, days: int = 31) -> DataFrame:
    """Rows with each window (period_start, period_end) that holds their date.

    Windows and dates meet by bins of `days` days, an equality join, so neither side is sent or compared as a whole.
    """
    binned = F.floor(F.unix_date(F.col(date_col)) / days)
    spread = periods.withColumn("_bin", F.explode(F.sequence(F.floor(F.unix_date("period_start") / days), F.floor(F.unix_date("period_end") / days))))
    joined = df.withColumn("_bin", binned).join(spread, "_bin").where(F.col(date_col).between(F.col("period_start"), F.col("period_end")))
    return joined.drop("_bin")


def numbered(df: DataFrame, order: str, name: str = "place") -> DataFrame:
    """Adds the row's place, from 0, in that order. Runs jobs while the plan is made: ranges are written, then numbered in parallel; one count per range reaches the driver."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, order).withColumn("_range", F.spark_partition_id()))
    counts = {r["_range"]: r["n"] for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, {}
    for k in sorted(counts):
        offsets[k], before = before, before + counts[k]
    if not offsets:
        return ranged.withColumn(name, F.lit(0).cast("long")).drop("_range")
    base = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), F.col("_range"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn(name, (inside + base).cast("long")).drop("_range")


def chunked(ids: DataFrame, key: str, size: int) -> DataFrame:
    """Distinct non-null ids with the number, from 1, of their chunk of `size`, in the order of the ids."""
    return numbered(ids.select(key).where(F.col(key).isNotNull()).distinct(), key).withColumn("chunk", F.floor(F.col("place") / size) + 1).drop("place")
