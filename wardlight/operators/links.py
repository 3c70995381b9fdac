"""Identifier links: parallel lists of ids to distinct triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parallel(lists: dict[str, Column]) -> Column:
    """Array of structs of lists of equal length; a list of one is repeated, other mismatches fail the row's task.

    A NULL list counts as a list of one NULL.
    """
    sound = {k: F.coalesce(v, F.array(F.lit(None).cast("string"))) for k, v in lists.items()}
    n = F.greatest(*[F.size(v) for v in sound.values()]) if len(sound) > 1 else F.size(next(iter(sound.values())))
    fitted = {k: F.when(F.size(v) == n, v).when(F.size(v) == 1, F.array_repeat(F.get(v, F.lit(0)), n)).otherwise(F.raise_error(F.lit(f"{k}: lists of unlike lengths"))) for k, v in sound.items()}
    return F.arrays_zip(*[v.alias(k) for k, v in fitted.items()])


def triplets(links: DataFrame, element: str = "eltId", event: str = "evtId", patient: str = "patId", external: str | None = "eltExt") -> DataFrame:
    """Distinct (ELTID, EVTID, PATID)."""
    names = {"ELTID": element, "EVTID": event, "PATID": patient} | ({"_ext": external} if external and external in links.columns else {})
    rows = links.select(*[F.col(v).cast("array<string>").alias(k) for k, v in names.items()])
    flat = rows.select(F.inline(parallel({k: F.col(k) for k in names})))
    return flat.toDF(*names).select("ELTID", "EVTID", "PATID").distinct()
