"""What a backend must offer, and how one batch is carried out against it."""

from __future__ import annotations

import importlib
import json
import logging
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from typing import Protocol

from ..functions.text import limit_message, looks_like_id_list, split_ids
from ..operators.documents import document_rows, out_units
from ..plans.requests import Batch, Plan, Request, fallback_periods, id_key_of, query_json, span_text, strict_bounds
from ..plans.windows import NoWindow

log = logging.getLogger("wardlight.fetch")


class FetchError(RuntimeError):
    pass


class Transport(Protocol):
    """Answers (module, kind, query as JSON) with records, or a record whose member `error` says why not; may raise."""

    def __call__(self, module: str, kind: str, query: str) -> object: ...


@dataclass(frozen=True)
class Outcome:
    ok: bool
    value: object = None
    error: str | None = None


def is_limit(error: str | None, pattern: str) -> bool:
    return limit_message(error, pattern)


def ask(transport: Transport, module: str, kind: str, query: dict) -> Outcome:
    try:
        value = transport(module, kind, query_json(query))
    except Exception as e:  # a backend's failure is a result, not the task's
        return Outcome(False, error=str(e) or type(e).__name__)
    if isinstance(value, dict) and value.get("error"):
        error = value["error"]
        text = " ".join(str(x) for x in error if x) if isinstance(error, (list, tuple)) else str(error)
        if text:
            return Outcome(False, error=text)
    return Outcome(True, value)


def load_transport(path: str, options: dict | None = None) -> Transport:
    """module:factory, imported where it is needed; the factory gets the options."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)(options or {})


@dataclass(frozen=True)
class Audit:
    n_in: int
    ok: bool
    n_out: int | None
    reason: str
    error: str | None = None


Counter = Callable[[object], int]


def records(module: str, kind: str, value: object) -> list | None:
    """Rows of an answer; documents come in several wrappings, exams may be a record of records. None if it is no table."""
    if value is None:
        return []
    if module == "doceds" and kind == "data":
        return document_rows(value)
    if isinstance(value, dict):
        if kind == "idtriplets":
            return [value]
        return [v | {"BIOL_ID": k} if module == "biol" and isinstance(v, dict) else v for k, v in value.items() if v is not None]
    return [v for v in value if v is not None] if isinstance(value, (list, tuple)) else None


def day_of(row: object, key: str) -> date | None:
    try:
        return date.fromisoformat(str(row[key])[:10])
    except (KeyError, TypeError, ValueError):
        return None


def answered(request: Request, value: object) -> list | None:
    """Rows of an answer that lie in the strict bounds of the request; rows without such a date stay."""
    rows, strict = records(request.module, request.kind, value), strict_bounds(request.query)
    if not rows or not strict:
        return rows
    return [r for r in rows if all((day := day_of(r, k)) is None or b.holds(day) for k, b in strict.items())]


#: The audit's reason for an answer that was dropped.
DROPPED = "not_a_table"


def _told(request: Request, n_in: int, value: object, n_out: int | None, reason: str = "ok", error: str | None = None) -> Iterator[object]:
    """The rows of an answer and its audit; an answer that is no table is dropped, and the audit says so."""
    rows = answered(request, value)
    if rows is None:
        log.warning("a batch that is no table was dropped")
        yield Audit(n_in, False, 0, DROPPED, "the answer was no table")
        return
    yield from rows
    yield Audit(n_in, True, n_out, reason, error)


@dataclass(frozen=True)
class CallEnd:
    """What came before it is the answer of one call; the next rows are another's."""


#: The audit's reason for a single call that asked too much and is to be planned anew, as periods.
TOO_LARGE = "single_too_large"


@dataclass
class Tally:
    """What became of the pieces of a batch."""

    answered: int = 0
    n_out: int = 0
    errors: list[str] = field(default_factory=list)
    limit: bool = True  # whether all errors are refusals of size


Span = tuple[date, date]


def halves(ids: tuple[str, ...], span: Span, least_ids: int, end_inclusive: bool) -> list[tuple[tuple[str, ...], Span]]:
    """A rectangle of ids and days as two; none if it is a day of one id.

    Chunks above least_ids are halved by ids, others by days while they can, then by ids again.
    """
    first, last = span
    days = (last - first).days + end_inclusive
    if len(ids) > 1 and (len(ids) > least_ids or days <= 1):
        half = len(ids) // 2
        return [(ids[:half], span), (ids[half:], span)]
    if days <= 1:
        return []
    middle = first + timedelta(days=days // 2 - end_inclusive)
    return [(ids, (first, middle)), (ids, (middle + timedelta(days=1) if end_inclusive else middle, last))]


def _in_pieces(plan: Plan, transport: Transport, units: Counter, base: dict, id_key: str | None, pieces: list[tuple[tuple[str, ...], Span]]) -> Generator[object, None, Tally]:
    """Rows of rectangles of ids and days, piece by piece as they are answered; what is refused as too large is halved.

    A stack, depth first, so no more answers are held than one.
    """
    request, tally = plan.request, Tally()
    todo = pieces[::-1]
    while todo:
        ids, span = todo.pop()
        query = base | {plan.time_key: span_text(request, *span)} | ({id_key: " OR ".join(ids)} if ids else {})
        got = ask(transport, request.module, request.kind, query)
        limit = not got.ok and is_limit(got.error, request.limit_pattern)
        if got.ok and (rows := answered(request, got.value)) is not None:
            yield from rows
            yield CallEnd()
            tally.answered, tally.n_out = tally.answered + 1, tally.n_out + (units(got.value) or 0)
        elif limit and (parts := halves(ids, span, request.min_ids, request.end_inclusive)):
            todo += parts[::-1]
        else:
            tally.errors.append(f"{span_text(request, *span)}: {'the answer was no table' if got.ok else got.error}")
            tally.limit &= limit
    return tally


def _tallied(n_in: int, tally: Tally) -> Audit:
    errors = "; ".join(tally.errors) or None
    if not tally.answered:
        return Audit(n_in, False, None, "limit_error" if tally.limit else "backend_error", errors)
    return Audit(n_in, True, tally.n_out, "partial" if errors else "ok_time_fallback", errors)


def _asked(batch: Batch, plan: Plan, spans: Sequence[Span]) -> bool:
    """Whether the batch's own call had the only period that there is, so that it need not be asked again."""
    return len(spans) == 1 and batch.query.get(plan.time_key) == span_text(plan.request, *spans[0])


def carry_out(batch: Batch, plan: Plan, transport: Transport, count: Counter | None = None, replan: bool = False) -> Iterator[object]:
    """Yields the batch's rows and, as Audit, what became of it; between the answers of several calls, CallEnd.

    replan: a single call that asks too much is only said to, so that its periods can be dealt out; else they follow here.
    """
    request = plan.request
    units = count or (lambda value: out_units(request.module, value, request.kind))
    if batch.kind == "ids":
        yield from _carry_out_ids(batch, plan, transport, units)
        return
    got = ask(transport, request.module, request.kind, batch.query)
    log.info("batch %s: %s", batch.query.get(plan.time_key), "ok" if got.ok else got.error)
    limit = not got.ok and is_limit(got.error, request.limit_pattern)
    single = batch.kind == "single" and not _asked(batch, plan, batch.periods)
    if got.ok:
        yield from _told(request, 1, got.value, units(got.value))
    elif batch.missing:
        yield Audit(1, False, None, "missing_time_window", f"{batch.missing}; the single call failed: {got.error}")
    elif single and limit and replan:
        yield Audit(1, False, None, TOO_LARGE, got.error)
    elif single and limit:
        for span in batch.periods:
            yield from carry_out(Batch("period", batch.query | {plan.time_key: span_text(request, *span)}, periods=(span,)), plan, transport, count)
    elif batch.kind == "single" and not limit:
        yield Audit(1, False, None, "single_call_failed", got.error)
    elif limit:
        key = id_key_of(batch.query)
        ids = tuple(dict.fromkeys(split_ids(batch.query[key]))) if key and looks_like_id_list(batch.query[key]) else ()
        base = {k: v for k, v in batch.query.items() if not ids or k != key}
        if parts := halves(ids, batch.periods[0], max(len(ids), 1), request.end_inclusive):
            tally = yield from _in_pieces(plan, transport, units, base, key, parts)
            yield _tallied(1, tally)
        else:
            yield Audit(1, False, None, "limit_error", got.error)
    else:
        yield Audit(1, False, None, "backend_error", got.error)


class ChunkSizes:
    """How many ids the next call gets, from what earlier ones of the batch brought.

    An answer of n rows for k ids tells the rows to expect of an id, and the next chunk is packed to a share of what an answer may have.
    A refusal tells nothing but that so many ids were too many: the next chunk is half as large, and later ones stay under what
    was refused, coming nearer to it again with each answer.
    """

    PACKED = 0.9

    def __init__(self, request: Request, least: int, first: int):
        self.request, self.least, self.size, self.ceiling = request, least, first, float("inf")

    def answered(self, ids: int, n_out: int | None) -> None:
        wanted = self.PACKED * self.request.max_out * ids / n_out if n_out else 2 * ids
        self.ceiling += self.ceiling / 8
        self.size = int(max(self.least, min(wanted, self.request.max_ids, self.ceiling)))

    def too_many_rows(self, ids: int, n_out: int) -> None:
        self.size = int(max(self.least, min(ids - 1, self.PACKED * self.request.max_out * ids / n_out)))

    def refused(self, ids: int) -> None:
        self.size, self.ceiling = max(self.least, ids // 2), max(self.least, 3 * ids / 4)


def _carry_out_ids(batch: Batch, plan: Plan, transport: Transport, units: Counter) -> Iterator[object]:
    """Goes through a batch's ids in chunks of sizes that earlier answers suggest (ChunkSizes); chunks that fail or return too
    much are asked again as smaller ones, down to the request's smallest.

    A smallest chunk that is refused as too large is cut by periods and goes on as rectangles of ids and days; without a
    window it is made smaller still, down to single ids.
    """
    request = plan.request
    try:
        spans = fallback_periods(request, "ids") if request.time_fallback else []
    except (NoWindow, ValueError):
        spans = []
    sizes, at = ChunkSizes(request, request.min_ids, len(batch.ids)), 0
    while at < len(batch.ids):
        ids = batch.ids[at : at + sizes.size]
        query = batch.query | {plan.id_key: " OR ".join(ids)}
        got = ask(transport, request.module, request.kind, query)
        n_out = units(got.value) if got.ok else None
        limit = not got.ok and is_limit(got.error, request.limit_pattern)
        sizes.least = 1 if limit and request.time_fallback and not spans else request.min_ids
        if len(ids) > sizes.least and not got.ok:
            sizes.refused(len(ids))
            continue
        if len(ids) > sizes.least and n_out is not None and n_out > request.max_out:
            sizes.too_many_rows(len(ids), n_out)
            continue
        at += len(ids)
        if got.ok:
            sizes.answered(len(ids), n_out)
            yield from _told(request, len(ids), got.value, n_out)
        elif limit and spans:
            pieces = [(ids, span) for span in spans] if not _asked(batch, plan, spans) else halves(ids, spans[0], request.min_ids, request.end_inclusive)
            tally = yield from _in_pieces(plan, transport, units, batch.query, plan.id_key, pieces)
            yield _tallied(len(ids), tally) if pieces else Audit(len(ids), False, None, "limit_error", got.error)
        else:
            yield Audit(len(ids), False, None, "limit_error" if limit else "backend_error", got.error)
