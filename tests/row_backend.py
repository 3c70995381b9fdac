"""A backend of rows in memory, with a row cap and injected failures."""

from __future__ import annotations

import json
import os
import time

from wardlight.functions.text import split_ids
from wardlight.plans.requests import ID_KEYS
from wardlight.plans.windows import Bounds, bounds_of


class RowBackend:
    """rows: flat records. cap: rows that one answer may have. fails: ids that break any call that holds them."""

    def __init__(self, options: dict):
        self.rows, self.cap = options.get("rows", []), options.get("cap", 40_000)
        self.fails, self.limits, self.log = set(options.get("fails", [])), set(options.get("limits", [])), options.get("log")

    def _holds(self, row: dict, key: str, wanted: object) -> bool:
        if wanted is None:
            return True
        if key in ID_KEYS:
            return str(row.get(key)) in split_ids(wanted)
        if (bounds := bounds_of(wanted)) != Bounds():
            return row.get(key) is not None and bounds.holds(type(bounds.low or bounds.high).fromisoformat(str(row[key])[:10]))
        return str(row.get(key)) == str(wanted)

    def __call__(self, module: str, kind: str, query: str) -> object:
        asked = json.loads(query)
        if self.log:
            with open(os.path.join(self.log, f"{os.getpid()}-{time.time_ns()}"), "w") as f:
                f.write(query)
        ids = {x for k in ID_KEYS for x in split_ids(asked.get(k))}
        if ids & self.fails:
            raise ConnectionError("Connection refused")
        found = [r for r in self.rows if all(self._holds(r, k, v) for k, v in asked.items())]
        if len(found) > self.cap or ids & self.limits and not any(str(v).startswith("{") for v in asked.values()):
            return {"error": "too many rows for one answer"}
        if kind == "idtriplets":
            return [{"eltId": [r["ELTID"] for r in found], "evtId": [r["EVTID"] for r in found], "patId": [r["PATID"] for r in found], "eltExt": [r["ELTID"] for r in found]}]
        return found
