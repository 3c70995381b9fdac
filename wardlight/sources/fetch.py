"""The public fetch: a request to lazy tables, with an audit of every batch."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labs import lab_table
from ..operators.links import triplets
from ..operators.stays import StayTables, stay_tables
from ..plans.requests import ID_KEYS, Request, overlap_of, resolve_mode
from .datasource import BackendSource
from .protocol import TOO_LARGE, FetchError
from .storage import stored

AUDIT = ["module", "batch_ids_key", "n_in", "ok", "n_out", "reason", "error"]
#: Schemas of what answers hold, where a caller gives none.
TRIPLETS = "eltExt array<string>, eltId array<string>, evtId array<string>, patId array<string>"


#: Reasons for which there is nothing to return.
FATAL = ("missing_time_window", "single_call_failed")


def overlapping(request: Request) -> bool:
    """Whether its periods share days."""
    mode, _ = resolve_mode(request)
    return overlap_of(request, mode) > 0 or not request.end_inclusive


@dataclass(frozen=True)
class Fetched:
    request: Request
    payloads: DataFrame  # payload: one JSON record a row
    audit: DataFrame

    def rows(self, schema: str) -> DataFrame:
        return self.payloads.select(F.from_json("payload", schema, {"primitivesAsString": "true"}).alias("r")).select("r.*")

    def documents(self, schema: str) -> DataFrame:
        return self.rows(schema).distinct()

    def links(self, schema: str = TRIPLETS) -> DataFrame:
        return triplets(self.rows(schema))

    def stays(self, schema: str, **how) -> StayTables:
        return stay_tables(self.rows(schema), **how)

    def labs(self, schema: str, **how) -> DataFrame:
        return lab_table(self.rows(schema), **how)


def scan_backend(spark: SparkSession, request: Request, transport: str, transport_options: dict | None = None, **options: str) -> DataFrame:
    """The lazy tagged scan of rows and audit records; each action asks the backend anew.

    Filters on ELTID, EVTID, PATID and day narrow what is asked for, where spark.sql.python.filterPushdown.enabled is on;
    where it is off, Spark applies them to all that comes.
    """
    spark.dataSource.register(BackendSource)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    named = {"request": request.to_json(), "transport": transport, "transport_options": json.dumps(transport_options or {}), "pushdown": pushes} | options
    scan = spark.read.format("ward_backend").options(**named).load()
    # Spark keeps what a filter narrowed for later plans of the same scan unless they push filters of their own: so all do.
    return scan.where("tag IS NOT NULL") if pushes == "true" else scan


def fetch(spark: SparkSession, request: Request, transport: str, transport_options: dict | None = None, count: str | None = None) -> Fetched:
    """Carries the request out, batch by batch on the executors, and writes what came back once.

    The tagged scan goes to the checkpoint folder, so that rows and audit are read from there: no batch is asked again,
    however many tables are made of it. Failed batches raise, warn or only stand in the audit, as the request says; a
    single call that failed, or was too large and has no window to be cut by, raises always. A single call that was too
    large is planned anew: the periods that take its place are dealt to all tasks, most_calls of the request at a time,
    and the call itself isn't asked again.
    """
    more = {"replan": "true"} | ({"count": count} if count else {})
    scanned = lambda asked: stored(scan_backend(spark, asked, transport, transport_options, **more).drop(*ID_KEYS, "day"))
    scan = scanned(request)
    if not scan.where(F.col("reason") == TOO_LARGE).isEmpty():
        scan = scanned(replace(request, mode="time", single_first=False))
    audit = scan.where("tag = 'audit'").orderBy("batch", "part").select(*AUDIT)
    if fatal := scan.where(F.col("reason").isin(*FATAL)).first():
        raise FetchError(f"{fatal['reason']}: {fatal['error']}")
    if request.on_failure != "audit":
        bad = scan.where("tag = 'audit' AND (NOT ok OR reason = 'partial')").agg(F.count("*"), F.min("error")).first()
        if bad[0]:
            text = f"{bad[0]} batches failed or are partial. One error: {bad[1]}"
            if request.on_failure == "raise":
                raise FetchError(text)
            warnings.warn(text, stacklevel=2)
    rows = scan.where("tag = 'row'")
    if overlapping(request):
        # The same source row comes with each window that holds it; as often as it comes with one of them, it stays.
        times = rows.groupBy("payload", "batch", "part").agg(F.count("*").alias("n")).groupBy("payload").agg(F.max("n").alias("n"))
        rows = times.select("payload", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return Fetched(request, rows.select("payload"), audit)


def fetch_stream(spark: SparkSession, request: Request, transport: str, transport_options: dict | None = None, as_of: str | None = None) -> DataFrame:
    """The tagged scan as a stream of the request's periods, each once it is over; rows and audit records, as the data source gives them.

    write it with a checkpointLocation: a query that is started again goes on after the last period that is done.
    """
    spark.dataSource.register(BackendSource)
    reader = spark.readStream.format("ward_backend").option("request", request.to_json()).option("transport", transport).option("transport_options", json.dumps(transport_options or {}))
    return (reader.option("as_of", as_of) if as_of else reader).load()
