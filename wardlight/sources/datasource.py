"""The backend as a Spark data source: batches dealt to input partitions, rows and audit records in one tagged scan."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, replace
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..plans.requests import ID_KEYS, Batch, Plan, Request, fallback_periods, narrowed, periods_between, plan, span_text
from ..plans.windows import TIME_KEYS
from .protocol import Audit, CallEnd, carry_out, day_of, load_transport

#: Rows have their payload, their identifiers and the day that the request goes by; audit records the rest.
SCHEMA = "tag string, batch int, part int, payload string, ELTID string, EVTID string, PATID string, day date, module string, batch_ids_key string, n_in int, ok boolean, n_out int, reason string, error string"


class BatchPartition(InputPartition):
    """Numbered batches that one task asks one after the other."""

    def __init__(self, number: int, batches: list[tuple[int, Batch]], whole: Plan):
        super().__init__(number)
        # A partition carries its own ids only.
        request = replace(whole.request, query={k: v for k, v in whole.request.query.items() if k != whole.id_key})
        self.batches, self.whole = batches, Plan(request, whole.mode, whole.time_key, whole.id_key, ())


def dealt(whole: Plan) -> list[BatchPartition]:
    """A partition per batch, or as many as the request lets ask at the same time."""
    numbered = list(enumerate(whole.batches))
    n = min(len(numbered), whole.request.most_calls or len(numbered))
    return [BatchPartition(k, numbered[k::n], whole) for k in range(n)]


class Asking:
    """What reading needs, in batches and as a stream: the request, the transport, and how a partition is read."""

    def __init__(self, options: dict):
        self.request = Request.from_json(options["request"])
        self.path, self.settings = options["transport"], json.loads(options.get("transport_options", "{}"))
        self.count, self.replan = options.get("count"), options.get("replan") == "true"
        self.ids: dict[str, set[str]] = {}
        self.low: date | None = None
        self.high: date | None = None

    def _wanted(self, ids: dict[str, str | None], day: date | None) -> bool:
        """Whether a row has what the pushed filters ask for."""
        if any(ids[key] not in wanted for key, wanted in self.ids.items()):
            return False
        return (self.low is None or day is not None and day >= self.low) and (self.high is None or day is not None and day <= self.high)

    def read(self, partition: BatchPartition) -> Iterator[tuple]:
        transport = load_transport(self.path, self.settings)
        count = load_transport(self.count) if self.count else None
        module, key = self.request.module, partition.whole.id_key
        filtered = bool(self.ids) or self.low is not None or self.high is not None
        for number, batch in partition.batches:
            part = 0  # of a batch: the calls that were answered, one after the other
            for found in carry_out(batch, partition.whole, transport, count, self.replan):
                if isinstance(found, CallEnd):
                    part += 1
                elif isinstance(found, Audit):
                    a = asdict(found)
                    if not filtered:  # an audit record has neither ids nor a day
                        yield ("audit", number, part, None, None, None, None, None, module, key, a["n_in"], a["ok"], a["n_out"], a["reason"], a["error"])
                    part += 1
                else:
                    own = {k: _text(found.get(k)) if isinstance(found, dict) else None for k in ID_KEYS}
                    day = day_of(found, partition.whole.time_key)
                    if self._wanted(own, day):
                        yield ("row", number, part, json.dumps(found, sort_keys=True), *own.values(), day, module, key, None, None, None, None, None)


def _text(value: object) -> str | None:
    return None if value is None or isinstance(value, (list, tuple, dict)) else str(value)


class BackendReader(Asking, DataSourceReader):
    def partitions(self) -> list[BatchPartition]:
        asked = narrowed(self.request, self.ids, self.low, self.high)
        return dealt(plan(asked)) if asked else []


class PushingReader(BackendReader):
    """The same, told of filters: Spark refuses readers that could be where its conf for that is off, hence apart."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Turns filters of ids and of the day into id lists and bounds of the request; strict bounds are asked for as closed
        ones and stay Spark's to apply, as does whatever else there is."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ID_KEYS and isinstance(f, (EqualTo, In)):
                wanted = {str(x) for x in (f.value if isinstance(f, In) else [f.value]) if x is not None}
                self.ids[name] = self.ids[name] & wanted if name in self.ids else wanted
            elif name == "day" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low or f.value, f.value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high or f.value, f.value)
                if isinstance(f, (GreaterThan, LessThan)):
                    yield f
            else:
                yield f


class PeriodStreamReader(Asking, DataSourceStreamReader):
    """The request's periods as a stream: an offset is the last day of the periods that are done.

    A period is due once its last day is over (by option `as_of`, else by today's date). Spark logs the offsets before it asks and when
    it has what they cover, so a query that is stopped goes on with the period after the last one, and asks none twice.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.as_of = options.get("as_of")

    def initialOffset(self) -> dict:
        return {"until": (fallback_periods(self.request, "time")[0][0] - timedelta(days=1)).isoformat()}

    def latestOffset(self) -> dict:
        today = date.fromisoformat(self.as_of) if self.as_of else date.today()
        due = [last for _, last in fallback_periods(self.request, "time") if last < today]
        return {"until": max(due).isoformat()} if due else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[BatchPartition]:
        spans = periods_between(self.request, date.fromisoformat(start["until"]), date.fromisoformat(end["until"]))
        key = self.request.time_key or TIME_KEYS[self.request.module]
        query = self.request.query
        return dealt(Plan(self.request, "time", key, None, tuple(Batch("period", query | {key: span_text(self.request, *span)}, periods=(span,)) for span in spans)))

    def commit(self, end: dict) -> None:
        """Nothing is held back for periods that are done."""


class BackendSource(DataSource):
    """spark.read.format("ward_backend").option("request", Request.to_json()).option("transport", "module:factory"), or spark.readStream."""

    @classmethod
    def name(cls) -> str:
        return "ward_backend"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BackendReader:
        return (PushingReader if self.options.get("pushdown") == "true" else BackendReader)(self.options)

    def streamReader(self, schema) -> PeriodStreamReader:
        return PeriodStreamReader(self.options)
