"""Rows that lack a stay's identifier, linked to the stay that holds their instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted

#: Days of the bins by which instants and stays find each other.
BIN_DAYS = 7


def holding_stays(instants: DataFrame, stays: DataFrame, person: str = "PATID", instant: str = "DATEXAM", stay_id: str = "EVTID", start: str = "DATENT", end: str = "DATSORT", bin_days: int = BIN_DAYS) -> DataFrame:
    """(person, instant, stay id) of each distinct instant of a person that lies in a stay of theirs, both ends included.

    Of several stays the shortest, of equally long ones the least id. A stay without an end goes on to the last instant there
    is; one without a start, an id or a person holds nothing. Both sides meet by person and bin of days, so a person with a
    great many rows is dealt out over the bins, and what a bin's join finds is reduced to one row an instant before it is
    shuffled again.
    """
    seconds = bin_days * 86_400
    bin_of = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / seconds)
    points = instants.select(quoted(person).alias("who"), quoted(instant).cast("timestamp_ntz").alias("at")).where("who IS NOT NULL AND at IS NOT NULL").distinct()
    latest = instants.agg(F.max(quoted(instant).cast("timestamp_ntz"))).first()[0]
    spans = stays.select(quoted(person).alias("who"), quoted(stay_id).alias("stay"), quoted(start).cast("timestamp_ntz").alias("from"), F.coalesce(quoted(end).cast("timestamp_ntz"), F.lit(latest).cast("timestamp_ntz")).alias("to"))
    spans = spans.where("who IS NOT NULL AND stay IS NOT NULL AND from <= to").distinct()
    binned = spans.withColumn("bin", F.explode(F.sequence(bin_of(F.col("from")), bin_of(F.col("to")))))
    met = points.withColumn("bin", bin_of(F.col("at"))).join(binned, ["who", "bin"]).where(F.col("at").between(F.col("from"), F.col("to")))
    length = F.unix_micros(F.col("to").cast("timestamp")) - F.unix_micros(F.col("from").cast("timestamp"))
    best = met.groupBy("who", "at").agg(F.min(F.struct(length.alias("length"), "stay")).alias("best"))
    return best.select(F.col("who").alias(person), F.col("at").alias(instant), F.col("best.stay").alias(stay_id))


def with_stay_ids(rows: DataFrame, stays: DataFrame, person: str = "PATID", instant: str = "DATEXAM", stay_id: str = "EVTID", start: str = "DATENT", end: str = "DATSORT", bin_days: int = BIN_DAYS) -> DataFrame:
    """All rows, with the stay's id filled in where it is missing and a stay of the person holds the instant.

    Rows that have an id keep it; those that no stay holds, or that lack person or instant, keep NULL. Repeated rows repeat.
    """
    has = stay_id in rows.columns
    own: Column = quoted(stay_id) if has else F.lit(None).cast(stays.schema[stay_id].dataType)
    found = holding_stays(rows.where(own.isNull()), stays, person, instant, stay_id, start, end, bin_days).toDF("_who", "_at", "_stay")
    linked = rows.join(found, own.isNull() & (quoted(person) == F.col("_who")) & (quoted(instant).cast("timestamp_ntz") == F.col("_at")), "left")
    filled = F.coalesce(own, F.col("_stay")).alias(stay_id)
    return linked.select(*[filled if c == stay_id else quoted(c) for c in rows.columns], *([] if has else [filled]))
