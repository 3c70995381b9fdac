"""Requests to row-limited backends, and how they are cut into batches."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, field, replace
from datetime import date, timedelta

from ..functions.text import LIMIT_WORDS, looks_like_id_list, split_ids
from .windows import TIME_KEYS, Bounds, NoWindow, bounds_of, periods, window_of

#: Identifiers from the most to the least specific.
ID_KEYS = ("ELTID", "EVTID", "PATID")
MODULES, KINDS, MODES, ON_FAILURE = ("doceds", "pmsi", "biol"), ("data", "idtriplets"), ("auto", "time", "ids"), ("raise", "warn", "audit")


@dataclass(frozen=True)
class Request:
    module: str
    kind: str = "data"
    query: dict = field(default_factory=dict)
    start: date | None = None
    end: date | None = None
    mode: str = "auto"
    step: str = "1 month"
    prefix: str = "{"
    suffix: str = "}"
    end_inclusive: bool = True
    overlap_days: int | None = None
    time_key: str | None = None
    id_key: str | None = None
    max_ids: int = 3500
    min_ids: int = 50
    max_out: int = 40_000
    single_first: bool | None = None
    time_fallback: bool = True
    drop_broader_ids: bool = False  # when fetching by ids; an id may then come with another broader one than was asked for
    most_calls: int | None = None  # batches that are asked at the same time; None: as many as the session has cores
    limit_pattern: str = LIMIT_WORDS
    on_failure: str = "warn"

    def __post_init__(self):
        for value, allowed in ((self.module, MODULES), (self.kind, KINDS), (self.mode, MODES), (self.on_failure, ON_FAILURE)):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")
        if self.max_ids < 1 or self.min_ids < 1:
            raise ValueError("max_ids and min_ids are at least 1")
        if self.most_calls is not None and self.most_calls < 1:
            raise ValueError("most_calls is at least 1")

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {k: v.isoformat() for k in ("start", "end") if (v := getattr(self, k))})

    @classmethod
    def from_json(cls, text: str) -> Request:
        raw = json.loads(text)
        return cls(**raw | {k: date.fromisoformat(raw[k]) for k in ("start", "end") if raw.get(k)})


def query_json(query: dict) -> str:
    """One-element lists are sent as their element."""
    return json.dumps({k: v[0] if isinstance(v, (list, tuple)) and len(v) == 1 else v for k, v in query.items() if v is not None})


def id_key_of(query: dict) -> str | None:
    """The most specific identifier that the query has."""
    return next((k for k in ID_KEYS if query.get(k) is not None), None)


def without_broader_ids(query: dict, key: str | None) -> dict:
    """The query without the identifiers that are broader than the one it is batched by."""
    broader = ID_KEYS[ID_KEYS.index(key) + 1 :] if key in ID_KEYS else ()
    return {k: v for k, v in query.items() if k not in broader}


@dataclass(frozen=True)
class Batch:
    """One unit of work of a task: a query as it is (with the periods that take its place if it asks too much), one period of
    it, or one chunk of ids."""

    kind: str
    query: dict
    ids: tuple[str, ...] = ()
    periods: tuple[tuple[date, date], ...] = ()  # first and last days
    missing: str | None = None  # why there are no periods


@dataclass(frozen=True)
class Plan:
    request: Request
    mode: str
    time_key: str
    id_key: str | None
    batches: tuple[Batch, ...]


def resolve_mode(request: Request) -> tuple[str, str | None]:
    key = request.id_key or id_key_of(request.query)
    if request.mode == "time":
        return "time", None
    if request.mode == "ids" or (key and looks_like_id_list(request.query.get(key))):
        return "ids", key
    return "time", None


def overlap_of(request: Request, mode: str) -> int:
    """Days by which its periods overlap."""
    return request.overlap_days if request.overlap_days is not None else int(mode == "time" and request.kind == "idtriplets")


def span_text(request: Request, first: date, last: date) -> str:
    """How the backend is asked for a period."""
    return f"{request.prefix}{first.isoformat()},{last.isoformat()}{request.suffix}"


def fallback_periods(request: Request, mode: str) -> list[tuple[date, date]]:
    """First and last days of the periods of the request's window; no window is an error."""
    key = request.time_key or TIME_KEYS[request.module]
    start, end = window_of(request.module, request.query, key, request.start, request.end)
    return [(p.start, p.end) for p in periods(start, end, request.step, end_inclusive=request.end_inclusive, overlap_days=overlap_of(request, mode))]


def strict_bounds(query: dict) -> dict[str, Bounds]:
    """Dates with a strict bound. Periods are closed, so what they return is held against these once more."""
    return {k: b for k, v in query.items() if (b := bounds_of(v)).strict}


def plan(request: Request) -> Plan:
    """Cuts a request into batches without asking the backend: a single call is a batch of its own, cut in its task if it must be."""
    mode, id_key = resolve_mode(request)
    time_key = request.time_key or TIME_KEYS[request.module]
    made = lambda *batches: Plan(request, mode, time_key, id_key, tuple(batches))
    # An explicit window bounds every call, also by ids.
    window = {time_key: span_text(request, request.start, request.end)} if request.start and request.end else {}
    if mode == "ids":
        if id_key is None or request.query.get(id_key) is None:
            raise ValueError("fetching by ids needs an identifier in the query")
        ids = tuple(dict.fromkeys(split_ids(request.query[id_key])))
        if not ids:
            raise ValueError(f"no ids in {id_key}")
        query = without_broader_ids(request.query, id_key) if request.drop_broader_ids else request.query
        base = {k: v for k, v in query.items() if k != id_key} | window
        return made(*[Batch("ids", base, ids[i : i + request.max_ids]) for i in range(0, len(ids), request.max_ids)])
    if request.module == "pmsi" and "RECDATE" in request.query:
        warnings.warn("stays have no RECDATE; use DATENT or DATSORT", stacklevel=2)
    query = request.query | window
    try:
        spans = fallback_periods(request, mode)
    except NoWindow as missing:
        return made(Batch("single", query, missing=str(missing)))
    if request.single_first if request.single_first is not None else request.mode != "time":
        return made(Batch("single", query, periods=tuple(spans)))
    return made(*[Batch("period", query | {time_key: span_text(request, *span)}, periods=(span,)) for span in spans])


def narrowed(request: Request, ids: dict[str, set[str]], low: date | None = None, high: date | None = None) -> Request | None:
    """The request for rows of these identifiers, and of days from low to high, alone; None if there can't be any.

    Ids and bounds that the request has itself stay in force. Bounds of one side are sent as strict ones of the day before or after.
    """
    query = dict(request.query)
    for key, wanted in ids.items():
        own = query.get(key)
        left = [x for x in dict.fromkeys(split_ids(own)) if x in wanted] if own is not None else sorted(wanted)
        if not left:
            return None
        query[key] = left
    if low is None and high is None:
        return replace(request, query=query)
    key = request.time_key or TIME_KEYS[request.module]
    own = Bounds(request.start, request.end) if request.start and request.end else bounds_of(query.get(key))
    step = timedelta(days=1 if own.strict else 0)
    lows, highs = [x for x in (low, own.low and own.low + step) if x], [x for x in (high, own.high and own.high - step) if x]
    first, last = max(lows, default=None), min(highs, default=None)
    if first and last:
        return replace(request, query=query, start=first, end=last) if first <= last else None
    query[key] = f">{(first - timedelta(days=1)).isoformat()}" if first else f"<{(last + timedelta(days=1)).isoformat()}"
    return replace(request, query=query)


def periods_between(request: Request, after: date, until: date) -> list[tuple[date, date]]:
    """The request's periods that end after the one day and until the other."""
    return [span for span in fallback_periods(request, "time") if after < span[1] <= until]
