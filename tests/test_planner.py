import json
import os
import pickle
import warnings
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlight.plans.requests import Request, id_key_of, narrowed, plan, query_json, resolve_mode, without_broader_ids
from wardlight.plans.windows import NoWindow, bounds_of, periods, window_of
from row_backend import RowBackend
from wardlight.sources.datasource import dealt
from wardlight.sources.fetch import fetch, scan_backend
from wardlight.sources.protocol import Audit, CallEnd, FetchError, carry_out, halves

D = date.fromisoformat
FAKE = "row_backend:RowBackend"


def rows(n, start="2024-01-01"):
    return [{"PATID": f"P{i}", "EVTID": f"E{i}", "ELTID": f"L{i}", "DATENT": (D(start) + timedelta(days=i % 90)).isoformat()} for i in range(n)]


def test_bounds():
    b = bounds_of(" { 2024-01-01 , 2024-01-31 } ")
    assert (b.low, b.high, b.strict) == (D("2024-01-01"), D("2024-01-31"), False)
    low, high = bounds_of(">2024-01-01"), bounds_of("< 2024-01-01")
    assert (low.low, low.high, low.strict) == (D("2024-01-01"), None, True) and high.high == D("2024-01-01")
    assert not low.holds(D("2024-01-01")) and low.holds(D("2024-01-02"))
    assert bounds_of("2024").low is None and bounds_of(None).high is None and bounds_of("{2024-02-30,2024-03-01}").low is None


def test_windows():
    q = {"DATENT": ">2024-01-01", "DATSORT": "<2024-02-01"}
    assert window_of("pmsi", q, "DATENT") == window_of("pmsi", q, "DATSORT") == (D("2024-01-01"), D("2024-02-01"))
    assert window_of("biol", {}, "DATEXAM", D("2024-01-01"), D("2024-01-02")) == (D("2024-01-01"), D("2024-01-02"))
    for module, query, key in (("doceds", {"RECDATE": ">2024-01-01"}, "RECDATE"), ("pmsi", {}, "OTHER"), ("biol", {}, "DATEXAM")):
        with pytest.raises(NoWindow):
            window_of(module, query, key)
    with pytest.raises(ValueError):
        window_of("biol", {}, "DATEXAM", D("2024-01-03"), D("2024-01-02"))


def test_periods():
    got = periods(D("2024-01-31"), D("2024-06-30"), "1 month", prefix="{", suffix="}")
    assert [p.start.isoformat() for p in got] == ["2024-01-31", "2024-03-02", "2024-03-31", "2024-05-01", "2024-05-31"]
    assert got[0].text == "{2024-01-31,2024-03-01}" and got[-1].end == D("2024-06-30")
    assert periods(D("2024-01-02"), D("2024-01-01")) == []
    assert [p.end for p in periods(D("2024-01-01"), D("2024-01-20"), "week", end_inclusive=False)] == [D("2024-01-08"), D("2024-01-15"), D("2024-01-20")]
    with pytest.raises(ValueError):
        periods(D("2024-01-01"), D("2024-01-02"), overlap_days=-1)


@settings(max_examples=60, deadline=None)
@given(st.dates(date(2000, 1, 1), date(2030, 1, 1)), st.integers(0, 900), st.sampled_from(["1 month", "2 weeks", "10 days", "1 year"]))
def test_inclusive_periods_cover_the_window_once(start, length, step):
    end = start + timedelta(days=length)
    days = [p.start + timedelta(days=i) for p in periods(start, end, step) for i in range((p.end - p.start).days + 1)]
    assert days == [start + timedelta(days=i) for i in range(length + 1)]


def test_ids_and_modes():
    assert id_key_of({"PATID": "1", "EVTID": "2"}) == "EVTID" and id_key_of({}) is None
    assert without_broader_ids({"ELTID": 1, "EVTID": 2, "PATID": 3, "x": 4}, "EVTID") == {"ELTID": 1, "EVTID": 2, "x": 4}
    assert json.loads(query_json({"a": ["x"], "b": ["x", "y"], "c": None})) == {"a": "x", "b": ["x", "y"]}
    assert resolve_mode(Request("pmsi", query={"PATID": "1 OR 2"})) == ("ids", "PATID")
    assert resolve_mode(Request("pmsi", query={"PATID": "1"})) == ("time", None)
    assert resolve_mode(Request("pmsi", query={"PATID": "1"}, mode="ids")) == ("ids", "PATID")
    r = Request("biol", start=D("2024-01-01"), end=D("2024-02-01"))
    assert Request.from_json(r.to_json()) == r
    with pytest.raises(ValueError):
        Request("other")
    with pytest.raises(ValueError):
        plan(Request("pmsi", mode="ids"))


def carried(request, backend):
    p = plan(request)
    found = [x for b in p.batches for x in carry_out(b, p, backend)]
    return [x for x in found if not isinstance(x, (Audit, CallEnd))], [x for x in found if isinstance(x, Audit)]


def test_splitting_conserves_ids():
    data = rows(700)
    got, audit = carried(Request("pmsi", query={"ELTID": " OR ".join(r["ELTID"] for r in data)}, max_ids=350), RowBackend({"rows": data, "cap": 200}))
    assert sorted(r["ELTID"] for r in got) == sorted(r["ELTID"] for r in data) and sum(a.n_in for a in audit) == 700 and all(a.ok for a in audit)
    got, audit = carried(Request("pmsi", query={"ELTID": [r["ELTID"] for r in data]}, max_out=100), RowBackend({"rows": data}))
    assert len(got) == 700 and max(a.n_out for a in audit) <= 100


def test_failing_chunks_reach_the_audit():
    data = rows(100)
    got, audit = carried(Request("pmsi", query={"ELTID": [r["ELTID"] for r in data]}), RowBackend({"rows": data, "fails": ["L3", "L80"]}))
    assert got == [] and [(a.n_in, a.reason) for a in audit] == [(50, "backend_error")] * 2
    q = {"ELTID": [r["ELTID"] for r in data], "DATENT": "{2024-01-01,2024-03-31}"}
    got, audit = carried(Request("pmsi", query=q | {"DATENT": "{2024-01-01,2024-03-31}"}, min_ids=100), RowBackend({"rows": data, "cap": 60}))
    assert len(got) == 100 and [a.reason for a in audit] == ["ok_time_fallback"]


def test_single_call_then_batches():
    data = rows(90)
    q = {"DATENT": "{2024-01-01,2024-03-30}"}
    for cap, audits in ((100, 1), (40, 3)):
        got, audit = carried(Request("pmsi", query=q), RowBackend({"rows": data, "cap": cap}))
        assert len(got) == 90 and [a.reason for a in audit] == ["ok"] * audits
    assert [b.kind for b in plan(Request("pmsi", query=q)).batches] == ["single"]
    assert [b.kind for b in plan(Request("pmsi", query=q, mode="time")).batches] == ["period"] * 3
    assert [a.reason for a in carried(Request("pmsi", query=q), lambda *_: {"error": "Connection refused"})[1]] == ["single_call_failed"]
    assert [a.reason for a in carried(Request("pmsi"), lambda *_: {"error": "too many"})[1]] == ["missing_time_window"]
    with pytest.warns(UserWarning, match="RECDATE"):
        plan(Request("pmsi", query=q | {"RECDATE": "x"}, mode="time"))


def test_ids_stay_in_the_window():
    data = rows(90)
    window = {"start": D("2024-01-10"), "end": D("2024-01-20")}
    inside = sorted(r["ELTID"] for r in data if "2024-01-10" <= r["DATENT"] <= "2024-01-20")
    by_ids, _ = carried(Request("pmsi", query={"ELTID": [r["ELTID"] for r in data], "PATID": "all"}, drop_broader_ids=True, **window), RowBackend({"rows": data}))
    by_time, _ = carried(Request("pmsi", mode="time", **window), RowBackend({"rows": data}))
    assert sorted(r["ELTID"] for r in by_ids) == sorted(r["ELTID"] for r in by_time) == inside


def test_broader_ids_are_dropped_or_kept():
    data = rows(4)
    q = {"ELTID": ["L1", "L2"], "PATID": "P1"}
    for drop, want in ((True, ["L1", "L2"]), (False, ["L1"]), (None, ["L1"])):
        got, _ = carried(Request("pmsi", query=q, **({} if drop is None else {"drop_broader_ids": drop})), RowBackend({"rows": data}))
        assert sorted(r["ELTID"] for r in got) == want


def test_strict_bounds_stay_strict():
    data = rows(90)
    q = {"DATENT": ">2024-01-10", "DATSORT": "<2024-03-01"}
    data = [r | {"DATSORT": r["DATENT"]} for r in data]
    inside = sorted(r["ELTID"] for r in data if "2024-01-10" < r["DATENT"] < "2024-03-01")
    for mode in ("time", "auto"):
        got, _ = carried(Request("pmsi", query=q, mode=mode), RowBackend({"rows": data}))
        assert sorted(r["ELTID"] for r in got) == inside


def test_dropped_batches_are_told():
    got, audit = carried(Request("doceds", start=D("2024-01-01"), end=D("2024-01-31"), mode="time"), lambda *_: "no table")
    assert got == [] and [(a.ok, a.n_out, a.reason) for a in audit] == [(False, 0, "not_a_table")]


def test_partitions_carry_their_own_ids():
    request = Request("pmsi", query={"ELTID": [f"L{i}" for i in range(1000)]}, max_ids=10)
    whole = plan(request)
    sizes = [len(pickle.dumps(x)) for x in dealt(whole)]
    assert len(sizes) == 100 and max(sizes) < 2000


def test_batches_are_dealt_to_few_tasks():
    request = Request("pmsi", query={"ELTID": [f"L{i}" for i in range(1000)]}, max_ids=10, most_calls=7)
    parts = dealt(plan(request))
    assert len(parts) == 7 and sorted(k for p in parts for k, _ in p.batches) == list(range(100))
    assert len(dealt(plan(Request("pmsi", query={"ELTID": ["L1", "L2"]}, most_calls=7)))) == 1
    with pytest.raises(ValueError, match="most_calls"):
        Request("pmsi", most_calls=0)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 9), st.integers(0, 40), st.integers(1, 5), st.booleans())
def test_halves_cover_a_rectangle_once(n, length, least, inclusive):
    ids, start = tuple(f"L{i}" for i in range(n)), D("2024-02-20")
    todo, cells = [(ids, (start, start + timedelta(days=length)))], []
    while todo:
        own, (a, b) = todo.pop()
        if parts := halves(own, (a, b), least, inclusive):
            todo += parts
        else:
            assert len(own) <= 1 and (b - a).days <= (0 if inclusive else 1)
            cells += [(x, a) for x in own or [None]]
    days = length + 1 if inclusive else max(length, 1)
    assert sorted(cells, key=str) == sorted(((x, start + timedelta(days=i)) for x in ids or [None] for i in range(days)), key=str)


def crowded(per_day, days=6, ids=4):
    """Rows of few ids and days: per_day of each id on each day."""
    return [{"PATID": f"P{i}", "EVTID": "E", "ELTID": f"L{i}", "DATENT": (D("2024-01-01") + timedelta(days=d)).isoformat(), "N": k} for i in range(ids) for d in range(days) for k in range(per_day)]


@pytest.mark.parametrize("mode", ["auto", "time"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_no_month_fits_but_nothing_is_lost(mode, inclusive):
    data = crowded(5)
    key = lambda rows: sorted((r["ELTID"], r["DATENT"], r["N"]) for r in rows)
    q = {"ELTID": [f"L{i}" for i in range(4)]}
    window = {"start": D("2024-01-01"), "end": D("2024-01-06")}
    for cap in (5, 7, 11, 40) if inclusive else (10, 23):
        got, audit = carried(Request("pmsi", query=q, mode=mode, end_inclusive=inclusive, **window), RowBackend({"rows": data, "cap": cap}))
        assert {*key(got)} == {*key(data)} and (not inclusive or len(got) == len(data))
        assert [a.reason for a in audit] == ["ok_time_fallback"] and all(a.ok for a in audit)
    # One day of one id has more rows than an answer may have: all else comes.
    heavy = data + [{**data[0], "N": 100 + k} for k in range(9)]
    got, audit = carried(Request("pmsi", query=q, mode=mode, **window), RowBackend({"rows": heavy, "cap": 6}))
    assert key(got) == key([r for r in heavy if (r["ELTID"], r["DATENT"]) != ("L0", "2024-01-01")])
    assert [(a.ok, a.reason) for a in audit] == [(True, "partial")] and "{2024-01-01,2024-01-01}" in audit[0].error


def test_ids_without_a_window_are_halved_to_one():
    data = crowded(2)
    got, audit = carried(Request("pmsi", query={"ELTID": [f"L{i}" for i in range(4)]}), RowBackend({"rows": data, "cap": 12}))
    assert len(got) == len(data) and [(a.n_in, a.reason) for a in audit] == [(1, "ok")] * 4
    got, audit = carried(Request("pmsi", query={"ELTID": [f"L{i}" for i in range(4)]}), RowBackend({"rows": data, "cap": 11}))
    assert got == [] and [(a.n_in, a.reason) for a in audit] == [(1, "limit_error")] * 4


def test_answers_stream_one_by_one():
    data, calls = crowded(5), []
    backend = RowBackend({"rows": data, "cap": 5})

    def counted(*asked):
        calls.append(asked)
        return backend(*asked)

    p = plan(Request("pmsi", query={"ELTID": [f"L{i}" for i in range(4)]}, start=D("2024-01-01"), end=D("2024-01-06")))
    rows = carry_out(p.batches[0], p, counted)
    next(rows)
    assert len(calls) < 8  # the first rows come long before the last call
    rest = len([*rows])
    assert rest > 100 and len(calls) == len({q for *_, q in calls})  # no call is asked twice


def test_a_large_single_call_is_dealt_out(spark, tmp_path):
    data = rows(90)
    log = tmp_path / "log"
    os.mkdir(log)
    request = Request("pmsi", query={"DATENT": "{2024-01-01,2024-03-30}"}, step="10 days")
    got = fetch(spark, request, FAKE, {"rows": data, "cap": 40, "log": str(log)})
    assert sorted(r["ELTID"] for r in got.rows("ELTID string").collect()) == sorted(r["ELTID"] for r in data)
    asked = [(log / f).read_text() for f in os.listdir(log)]
    assert len(asked) == 10 == len({*asked})  # the single call and nine periods, each once
    assert got.audit.count() == 9 and {r.reason for r in got.audit.collect()} == {"ok"}
    for most, tasks in ((None, 9), (2, 2)):
        again = Request("pmsi", query=request.query, step="10 days", mode="time", most_calls=most)
        scan = spark.read.format("ward_backend").option("request", again.to_json()).option("transport", FAKE).option("transport_options", json.dumps({"rows": data})).load()
        assert scan.rdd.getNumPartitions() == tasks and scan.where("tag = 'row'").count() == 90


def test_overlaps_return_rows_once(spark):
    data = rows(60) + rows(3)  # three rows come twice
    for how in ({"overlap_days": 3}, {"end_inclusive": False}):
        got = fetch(spark, Request("pmsi", start=D("2024-01-01"), end=D("2024-03-30"), mode="time", step="10 days", **how), FAKE, {"rows": data})
        assert sorted(r["ELTID"] for r in got.rows("ELTID string").collect()) == sorted(r["ELTID"] for r in data)
    with pytest.raises(FetchError, match="missing_time_window"):
        fetch(spark, Request("pmsi", on_failure="audit"), FAKE, {"rows": data, "cap": 10})


def test_fetch_by_ids_and_by_time_agree(spark, tmp_path):
    data = rows(300)
    log = tmp_path / "log"
    os.mkdir(log)
    options = {"rows": data, "cap": 120, "log": str(log)}
    schema = "PATID string, EVTID string, ELTID string, DATENT string"
    by_id = fetch(spark, Request("pmsi", query={"ELTID": [r["ELTID"] for r in data]}, max_ids=150), FAKE, options)
    main = by_id.stays(schema).main
    calls = len(os.listdir(log))
    assert main.count() == 300 and by_id.audit.count() == 4 and len(os.listdir(log)) == calls  # nothing is asked again
    by_time = fetch(spark, Request("pmsi", start=D("2024-01-01"), end=D("2024-03-30"), mode="time"), FAKE, options | {"cap": 150})
    key = lambda f: sorted(r.ELTID for r in f.stays(schema).main.collect())
    assert key(by_id) == key(by_time)
    links = fetch(spark, Request("pmsi", "idtriplets", start=D("2024-01-01"), end=D("2024-03-30"), mode="time"), FAKE, {"rows": data, "cap": 200})
    assert links.links().count() == 300


def test_fetch_reports_failures(spark):
    data = rows(60)
    request = lambda how: Request("pmsi", query={"ELTID": [r["ELTID"] for r in data]}, min_ids=30, on_failure=how)
    with pytest.raises(FetchError):
        fetch(spark, request("raise"), FAKE, {"rows": data, "fails": ["L1"]})
    with pytest.warns(UserWarning, match="1 batches failed"):
        got = fetch(spark, request("warn"), FAKE, {"rows": data, "fails": ["L1"]})
    assert sorted((r.ok, r.reason) for r in got.audit.collect()) == [(False, "backend_error"), (True, "ok")]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        fetch(spark, request("audit"), FAKE, {"rows": data, "fails": ["L1"]})


def test_narrowed():
    r = Request("pmsi", query={"PATID": "P1 OR P2", "DATENT": ">2024-01-05"})
    assert narrowed(r, {"PATID": {"P2", "P9"}}).query == {"PATID": ["P2"], "DATENT": ">2024-01-05"}
    assert narrowed(r, {"PATID": {"P9"}}) is None and narrowed(r, {"ELTID": {"b", "a"}}).query["ELTID"] == ["a", "b"]
    both = narrowed(r, {}, D("2024-01-01"), D("2024-01-31"))
    assert (both.start, both.end, both.query["DATENT"]) == (D("2024-01-06"), D("2024-01-31"), ">2024-01-05")
    assert narrowed(r, {}, high=D("2024-01-05")) is None
    assert narrowed(Request("pmsi"), {}, low=D("2024-01-02")).query == {"DATENT": ">2024-01-01"}
    assert narrowed(Request("pmsi"), {}, high=D("2024-01-02")).query == {"DATENT": "<2024-01-03"}
    own = narrowed(Request("biol", start=D("2024-01-01"), end=D("2024-02-01")), {}, D("2024-01-10"), D("2024-03-01"))
    assert (own.start, own.end) == (D("2024-01-10"), D("2024-02-01"))


FILTERS = [
    "ELTID IN ('L3', 'L40', 'none')",
    "ELTID = 'L7' AND tag = 'row'",
    "day >= DATE'2024-01-10' AND day < DATE'2024-01-20'",
    "day > DATE'2024-03-25' AND PATID <> 'P85'",
    "day = DATE'2024-02-02' OR ELTID = 'L1'",
    "day BETWEEN DATE'2024-01-05' AND DATE'2024-01-06' AND ELTID IN ('L4', 'L5', 'L80')",
    "ELTID = 'L1' AND ELTID = 'L2'",
    "day IS NULL",
]


@pytest.mark.parametrize("pushed", [True, False])
def test_filters_reach_the_backend(spark, tmp_path, pushed):
    data = rows(90) + [{"ELTID": "L200", "PATID": "P", "DATENT": None}]
    log = tmp_path / "log"
    log.mkdir()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", str(pushed).lower())
    try:
        request = Request("pmsi", start=D("2024-01-01"), end=D("2024-03-30"), mode="time")
        scan = scan_backend(spark, request, FAKE, {"rows": data, "log": str(log)})
        whole = spark.createDataFrame(scan.collect(), scan.schema)
        for text in FILTERS:
            for f in log.iterdir():
                f.unlink()
            got = scan.where(text)
            assert sorted(map(str, got.select("tag", "ELTID", "day").collect())) == sorted(map(str, whole.where(text).select("tag", "ELTID", "day").collect())), text
            asked = " ".join(f.read_text() for f in log.iterdir())
            if pushed and text.startswith("ELTID IN"):
                assert "L40" in asked and "ELTID IN" not in got._jdf.queryExecution().optimizedPlan().toString()
            if pushed and text.startswith("day >="):  # strict bounds are Spark's to apply
                assert "Filter (" in (shown := got._jdf.queryExecution().optimizedPlan().toString()) and "< 2024-01-20" in shown and ">= 2024-01-10" not in shown
            if pushed and text.startswith("day >="):
                assert "{2024-01-10,2024-01-20}" in asked and "2024-03" not in asked
            if pushed and "'L1' AND" in text:
                assert asked == ""
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def halving_calls(request, backend, ids):
    """Calls that halving alone takes."""
    todo, calls = [ids], 0
    while todo:
        own = todo.pop()
        got, calls = backend("pmsi", "data", json.dumps({"ELTID": " OR ".join(own)})), calls + 1
        if len(own) > request.min_ids and (isinstance(got, dict) or len(got) > request.max_out):
            todo += [own[len(own) // 2 :], own[: len(own) // 2]]
    return calls


@pytest.mark.parametrize("cap", [150, 10**6])
def test_chunks_learn_from_answers(cap):
    """Ids of one row each, then of 60: chunks are packed by what earlier ones brought, in fewer calls than halving takes."""
    data = [{"ELTID": f"L{i}", "DATENT": "2024-01-01", "n": k} for i in range(240) for k in range(1 if i < 200 else 20)]
    ids = [f"L{i}" for i in range(240)]
    request = Request("pmsi", query={"ELTID": ids}, min_ids=5, max_out=150)
    backend, calls = RowBackend({"rows": data, "cap": cap}), []

    def counted(*asked):
        calls.append(asked)
        return backend(*asked)

    got, audit = carried(request, counted)
    assert len(got) == len(data) and sum(a.n_in for a in audit) == 240 and all(a.ok and a.n_out <= 150 for a in audit)
    assert len(calls) < halving_calls(request, backend, ids) and len(calls) == len({q for *_, q in calls})
