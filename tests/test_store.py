import json
import os
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlight.plans.requests import Request
from wardlight.sources.store import WindowStore

FAKE = "row_backend:RowBackend"


def stays(n, version=1):
    return [{"ELTID": f"L{i}", "DATENT": (date(2024, 1, 1) + timedelta(days=i % 40)).isoformat(), "v": version} for i in range(n)]


def asked(first, last):
    return Request("pmsi", start=date.fromisoformat(first), end=date.fromisoformat(last), step="10 days")


def kept(store):
    return sorted(json.dumps(json.loads(r.payload), sort_keys=True) for r in store.payloads().collect())


def as_text(rows):
    return sorted(json.dumps(r, sort_keys=True) for r in rows)


def test_windows_replace_their_rows(spark, tmp_path):
    store, log = WindowStore(spark, f"{tmp_path}/store", "pmsi"), tmp_path / "log"
    log.mkdir()
    rows = stays(100) + stays(3)  # some come twice
    options = {"rows": rows, "log": str(log)}
    assert store.payloads().count() == 0 and store.days_due(date(2024, 1, 1), date(2024, 1, 3)) == [(date(2024, 1, 1), date(2024, 1, 3))]
    store.fetch_due(asked("2024-01-01", "2024-01-25"), FAKE, options)
    calls = len(os.listdir(log))
    store.fetch_due(asked("2024-01-01", "2024-01-25"), FAKE, options)
    assert len(os.listdir(log)) == calls == 3  # what is kept isn't asked for again
    store.fetch_due(asked("2024-01-15", "2024-02-09"), FAKE, options)  # overlaps the first run
    assert kept(store) == as_text(rows)
    store.fetch_due(asked("2024-01-10", "2024-01-30"), FAKE, options, again=True)
    assert kept(store) == as_text(rows)
    # What changed or went since is replaced in the window's days, and in those alone.
    newer = [r for r in stays(60, version=2) if r["DATENT"] != "2024-01-12"]
    store.fetch_due(asked("2024-01-11", "2024-01-13"), FAKE, {"rows": newer}, again=True)
    inside = lambda r: "2024-01-11" <= r["DATENT"] <= "2024-01-13"
    assert kept(store) == as_text([r for r in rows if not inside(r)] + [r for r in newer if inside(r)])
    told = store.manifest().collect()
    assert len(told) == 4 and len({r.run for r in told}) == 4 and all(r.complete for r in told)


def test_partial_windows_stay_due(spark, tmp_path):
    store = WindowStore(spark, f"{tmp_path}/store", "pmsi")
    rows = stays(40) + [{"ELTID": f"X{i}", "DATENT": "2024-01-05", "v": 1} for i in range(9)]
    with pytest.warns(UserWarning, match="partial"):
        store.fetch_due(asked("2024-01-01", "2024-01-10"), FAKE, {"rows": rows, "cap": 5})
    assert store.payloads().count() == 9 and store.days_due(date(2024, 1, 1), date(2024, 1, 10)) == [(date(2024, 1, 1), date(2024, 1, 10))]
    store.fetch_due(asked("2024-01-01", "2024-01-10"), FAKE, {"rows": rows})
    assert store.payloads().count() == 19 and store.days_due(date(2024, 1, 1), date(2024, 1, 10)) == []


def test_rows_outside_their_window_are_refused(spark, tmp_path):
    store = WindowStore(spark, f"{tmp_path}/store", "pmsi")
    for payload in ('{"DATENT": "2024-02-01"}', '{"ELTID": "no day"}'):
        with pytest.raises(Exception, match="not in 2024-01-01 to 2024-01-02"):
            store.keep(spark.createDataFrame([(payload,)], "payload string"), date(2024, 1, 1), date(2024, 1, 2))
    assert store.manifest().count() == 0
    assert store.keep(spark.createDataFrame([], "payload string"), date(2024, 1, 1), date(2024, 1, 2)) == 0
    assert store.days_due(date(2024, 1, 1), date(2024, 1, 3)) == [(date(2024, 1, 3), date(2024, 1, 3))]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 6)), max_size=3))
def test_days_due(spark, tmp_path_factory, windows):
    store = WindowStore(spark, str(tmp_path_factory.mktemp("store")), "biol")
    day = lambda k: date(2024, 1, 1) + timedelta(days=k)
    for a, n in windows:
        store.keep(spark.createDataFrame([], "payload string"), day(a), day(a + n))
    due = [d for a, b in store.days_due(day(0), day(25)) for d in range((a - day(0)).days, (b - day(0)).days + 1)]
    assert due == [d for d in range(26) if not any(a <= d <= a + n for a, n in windows)]
