import json
from datetime import date, timedelta

import pytest
import json

from wardlight.plans.requests import Request
from wardlight.sources.fetch import fetch_stream
from wardlight.streaming.payloads import diagnosis_stream, fresh, payload_stream, write_available


def test_available_payloads_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stay = {"PATID": "P1", "EVTID": "E1", "ELTID": "L1", "DALL": "01:A41 02:I10", "arrived": "2024-01-01T00:00:00Z"}
    (folder / "a.json").write_text("\n".join(json.dumps(s) for s in (stay, stay, stay | {"ELTID": "L2"})))
    schema = "PATID string, EVTID string, ELTID string, DALL string, arrived timestamp"
    rows = fresh(payload_stream(spark, str(folder), schema), ["ELTID"], "arrived")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    write_available(diagnosis_stream(rows.drop("arrived")), out, state).awaitTermination(120)
    assert spark.read.parquet(out).count() == 4
    (folder / "b.json").write_text(json.dumps(stay))
    write_available(diagnosis_stream(rows.drop("arrived")), out, state).awaitTermination(120)
    assert spark.read.parquet(out).count() == 4


def test_periods_as_a_stream(spark, tmp_path):
    """A query that is stopped and started again asks for each period once."""
    data = [{"ELTID": f"L{i}", "DATENT": (date(2024, 1, 1) + timedelta(days=i)).isoformat()} for i in range(60)]
    log = tmp_path / "log"
    log.mkdir()
    request = Request("pmsi", start=date(2024, 1, 1), end=date(2024, 2, 29), step="10 days", mode="time")

    def run(as_of, cap=1000):
        rows = fetch_stream(spark, request, "row_backend:RowBackend", {"rows": data, "log": str(log), "cap": cap}, as_of)
        query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()
        out = spark.read.parquet(f"{tmp_path}/out")
        asked = [json.loads(f.read_text())["DATENT"] for f in log.iterdir()]
        assert len(asked) == len({*asked})
        return sorted(r.ELTID for r in out.where("tag = 'row'").collect()), len(asked), out.where("tag = 'audit' AND ok").count()

    wanted = lambda days: sorted(r["ELTID"] for r in data[:days])
    assert run("2024-01-10") == ([], 0, 0)  # the first period's last day isn't over
    assert run("2024-01-25") == (wanted(20), 2, 2)
    assert run("2024-01-25") == (wanted(20), 2, 2)
    assert run("2024-03-05", cap=6) == (wanted(60), 2 + 4 * 3, 6)  # each larger period is halved


def test_streamed_periods_fail_loudly(spark, tmp_path):
    with pytest.raises(Exception, match="needs bounds"):
        query = fetch_stream(spark, Request("pmsi"), "row_backend:RowBackend").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/o").trigger(availableNow=True).start()
        query.awaitTermination()
