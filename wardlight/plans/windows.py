"""Date bounds of requests and the periods they are cut into (plain Python, on the driver)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

#: The date that each module is fetched by.
TIME_KEYS = {"doceds": "RECDATE", "pmsi": "DATENT", "biol": "DATEXAM"}

#: How bounds are written, `{day,day}`, `>day` and `<day`.
_DAY = r"(\d{4}-\d{2}-\d{2})"


class NoWindow(ValueError):
    """The request has no usable time window."""


@dataclass(frozen=True)
class Bounds:
    low: date | None = None
    high: date | None = None
    strict: bool = False

    @property
    def closed(self) -> bool:
        return self.low is not None and self.high is not None and self.low <= self.high

    def holds(self, day: date) -> bool:
        if self.strict:
            return (self.low is None or day > self.low) and (self.high is None or day < self.high)
        return (self.low is None or day >= self.low) and (self.high is None or day <= self.high)


def _day(text: str) -> date | None:
    try:
        return date.fromisoformat(text)
    except ValueError:
        return None


def bounds_of(text: object) -> Bounds:
    """`{lo,hi}` is closed; `>d` and `<d` are open on one side and strict; anything else bounds nothing."""
    if text is None or isinstance(text, (list, tuple)):
        return Bounds()
    text = str(text).strip()
    if m := re.fullmatch(rf"\{{\s*{_DAY}\s*,\s*{_DAY}\s*\}}", text):
        return Bounds(_day(m[1]), _day(m[2]))
    if m := re.fullmatch(rf"([<>])\s*{_DAY}", text):
        return Bounds(low=_day(m[2]), strict=True) if m[1] == ">" else Bounds(high=_day(m[2]), strict=True)
    return Bounds()


def window_of(module: str, query: dict, time_key: str, start: date | None = None, end: date | None = None) -> tuple[date, date]:
    """The window to cut: explicit dates win; stays may take the missing side from their other date; others need both sides."""
    if start is not None and end is not None:
        if start > end:
            raise ValueError("start is after end")
        return start, end
    own = bounds_of(query.get(time_key))
    if module == "pmsi":
        if time_key not in ("DATENT", "DATSORT"):
            raise NoWindow(f"stays can't be fetched by {time_key}")
        if time_key == "DATENT":
            own = Bounds(own.low, own.high or bounds_of(query.get("DATSORT")).high)
        else:
            own = Bounds(own.low or bounds_of(query.get("DATENT")).low, own.high)
    elif module not in TIME_KEYS:
        raise NoWindow(f"unknown module {module}")
    if not own.closed:
        raise NoWindow(f"{module} needs bounds of {time_key}")
    return own.low, own.high


@dataclass(frozen=True)
class Period:
    start: date
    end: date
    text: str


def _starts(start: date, end: date, step: str) -> list[date]:
    m = re.fullmatch(r"\s*(\d+)?\s*(day|week|month|quarter|year)s?\s*", step)
    if not m or int(m[1] or 1) < 1:
        raise ValueError(f"not a step: {step!r}")
    n, unit = int(m[1] or 1), m[2]
    out, i = [], 0
    while True:
        if unit in ("day", "week"):
            at = start + timedelta(days=i * n * (7 if unit == "week" else 1))
        else:
            month = start.month - 1 + i * n * {"month": 1, "quarter": 3, "year": 12}[unit]
            # A day that the month lacks runs over into the next one.
            at = date(start.year + month // 12, month % 12 + 1, 1) + timedelta(days=start.day - 1)
        if at > end:
            return out
        out.append(at)
        i += 1


def periods(start: date, end: date, step: str = "6 months", sep: str = ",", prefix: str = "", suffix: str = "", end_inclusive: bool = True, overlap_days: int = 0) -> list[Period]:
    """Periods that cover start to end; each ends the day before the next starts, or on that day if ends are exclusive."""
    if overlap_days < 0:
        raise ValueError("overlap_days must not be negative")
    if start > end:
        return []
    starts = _starts(start, end, step)
    ends = [s - timedelta(days=1 if end_inclusive else 0) for s in starts[1:]] + [end]
    ends = [min(e + timedelta(days=overlap_days), end) for e in ends]
    return [Period(s, e, f"{prefix}{s.isoformat()}{sep}{e.isoformat()}{suffix}") for s, e in zip(starts, ends, strict=True)]
