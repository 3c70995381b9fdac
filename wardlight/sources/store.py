"""What was fetched, kept by days, so that windows that overlap across runs replace each other's rows instead of repeating them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.requests import Request, fallback_periods
from ..plans.windows import TIME_KEYS
from .fetch import Fetched, fetch

MANIFEST = "first date, last date, n_rows long, complete boolean, run string, at timestamp"


@dataclass(frozen=True)
class WindowStore:
    """Payloads of one module below a folder that all executors reach: data/day=…, and a manifest of the windows that were kept.

    A window replaces all rows of its days, also those of days on which it brought none. One that came in part replaces them as
    well, but isn't in the manifest as complete, so it stays due. Rows without a day can't be placed and are refused.
    """

    spark: SparkSession
    folder: str
    module: str
    time_key: str | None = None

    @property
    def _data(self) -> str:
        return f"{self.folder}/data"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, folder: str) -> bool:
        path, files = self._files()
        return files.exists(path(folder))

    def payloads(self) -> DataFrame:
        """payload, day of all that is kept."""
        if not self._there(self._data):
            return self.spark.createDataFrame([], "payload string, day date")
        return self.spark.read.schema("payload string, day date").parquet(self._data)

    def manifest(self) -> DataFrame:
        """A row per window that was kept, in the order of the runs."""
        folder = f"{self.folder}/manifest"
        if not self._there(folder):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(folder).orderBy("at", "first")

    def days_due(self, first: date, last: date) -> list[tuple[date, date]]:
        """The parts of a window that no complete window of the manifest covers."""
        covered = {(r["first"], r["last"]) for r in self.manifest().where("complete").select("first", "last").distinct().collect()}
        due: list[tuple[date, date]] = []
        at = first
        for a, b in sorted(covered):
            if b < at or a > last:
                continue
            if a > at:
                due.append((at, a - timedelta(days=1)))
            at = max(at, b + timedelta(days=1))
        return [*due, (at, last)] if at <= last else due

    def keep(self, payloads: DataFrame, first: date, last: date, complete: bool = True) -> int:
        """Replaces the rows of these days by the payloads; returns how many there are now. Writing the same again changes nothing.

        Days are written by dynamic partition overwrite and the manifest last, so a run that is lost halfway leaves its
        window due, and the next one writes it whole.
        """
        key = self.time_key or TIME_KEYS[self.module]
        day = F.to_date(F.substring(F.get_json_object("payload", f"$.{key}"), 1, 10))
        inside = F.col("day").between(F.lit(first), F.lit(last))
        rows = payloads.select("payload", day.alias("day"))
        rows = rows.select(F.when(inside, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit(f"not in {first} to {last}: "), "payload"))).alias("payload"), "day")
        rows.repartition("day", F.pmod(F.xxhash64("payload"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self._data)
        counts = {r["day"]: r["n"] for r in rows.groupBy("day").agg(F.count("*").alias("n")).collect()}
        path, files = self._files()
        for k in range((last - first).days + 1):
            if (gone := first + timedelta(days=k)) not in counts:
                files.delete(path(f"{self._data}/day={gone.isoformat()}"), True)
        n = sum(counts.values())
        told = self.spark.createDataFrame([(first, last, n, complete, uuid.uuid4().hex)], MANIFEST.rsplit(",", 1)[0]).withColumn("at", F.current_timestamp())
        told.write.mode("append").parquet(f"{self.folder}/manifest")
        return n

    def fetch_due(self, request: Request, transport: str, transport_options: dict | None = None, again: bool = False) -> list[Fetched]:
        """Fetches the parts of the request's window that aren't kept yet (with again: all of it) and keeps them, part by part."""
        spans = fallback_periods(request, "time")
        whole = spans[0][0], spans[-1][1]
        out = []
        for first, last in [whole] if again else self.days_due(*whole):
            got = fetch(self.spark, replace(request, start=first, end=last, mode="time"), transport, transport_options)
            self.keep(got.payloads, first, last, got.audit.where("NOT ok OR reason = 'partial'").isEmpty())
            out.append(got)
        return out
