"""Laboratory exams: nested results, or flat rows, to one table of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import as_wall_clock, clock_time
from .nested import DATES

#: An exam's own columns, in order.
EXAM = ["PATID", "EVTID", "ELTID", "BIOL_ID", "DATEXAM", "SEJUM", "SEJUF", "PATBD", "PATAGE", "PATSEX", "CSTE_LABO"]


def is_nested(exams: DataFrame) -> bool:
    kind = exams.schema["RESULTATS"].dataType if "RESULTATS" in exams.columns else None
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def from_map(exams: DataFrame, map_col: str) -> DataFrame:
    """Exams of a map from key to record; the key becomes BIOL_ID."""
    return exams.select(F.explode(map_col).alias("BIOL_ID", "exam")).select("BIOL_ID", "exam.*")


def from_list(exams: DataFrame, list_col: str) -> DataFrame:
    """Exams of an unnamed list; their place, from 1, becomes BIOL_ID."""
    return exams.select(F.posexplode(list_col).alias("place", "exam")).select((F.col("place") + 1).cast("string").alias("BIOL_ID"), "exam.*")


def results_of(exams: DataFrame, id_col: str = "BIOL_ID") -> DataFrame:
    """A row per result with the exam's columns; exams without results go. A result's column named like the exam's gets _RESULT."""
    typed = {f.name for f in exams.schema if f.name == "DATEXAM" and isinstance(f.dataType, DATES)}
    own = [(F.col(c) if c in typed else F.col(id_col if c == "BIOL_ID" else c).cast("string")).alias(c) if (id_col if c == "BIOL_ID" else c) in exams.columns else F.lit(None).cast("string").alias(c) for c in EXAM]
    fields = exams.schema["RESULTATS"].dataType.elementType.names
    taken = {c.lower() for c in EXAM} | {"heure_datexam"}
    names = [f"{f}_RESULT" if f.lower() in taken else f for f in fields]
    rows = F.transform("RESULTATS", lambda x: F.struct(*[x.getField(f).cast("string").alias(n) for f, n in zip(fields, names, strict=True)]))
    return exams.select(*own, F.inline(rows))


def lab_table(exams: DataFrame, zone: str | None = None, id_col: str = "BIOL_ID") -> DataFrame:
    """Results of nested exams, or flat rows as they are; DATEXAM becomes a timestamp and its clock time comes last."""
    had_date = "DATEXAM" in exams.columns
    rows = results_of(exams, id_col) if is_nested(exams) else exams
    if not had_date:
        return rows
    ts = as_wall_clock(F.col("DATEXAM"), rows.schema["DATEXAM"].dataType, zone)
    return rows.withColumns({"DATEXAM": ts, "HEURE_DATEXAM": clock_time(ts, F.col("DATEXAM"))})
