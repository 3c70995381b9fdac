"""Hospital stays: one payload row per stay, to the tables of stays, procedures and diagnoses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import as_wall_clock, clock_time
from ..functions.text import has_digit, token_code, token_kind
from .acts import VALUES, paired_columns, record_columns, unpivot
from .columns import containing, ending, pick, quoted
from .nested import flatten, flatten_json

#: The columns of the stay table and the identifying columns of a procedure, in order.
MAIN = ["PATID", "EVTID", "ELTID", "DATENT", "HEURE_DATENT", "DATSORT", "HEURE_DATSORT", "PATBD", "PATAGE", "PATSEX", "SEJDUR", "MODEENT", "MODESORT", "PMSISTATUT", "SEJUM", "SEJUF", "GHM", "SEVERITE", "SRC"]
ACT_IDS = ["PATID", "EVTID", "ELTID", "PATBD", "PATAGE", "PATSEX", "DATENT", "HEURE_DATENT", "DATSORT", "HEURE_DATSORT", "SEJDUR", "SEJUM", "SEJUF"]
RAW_TIMES = ["DATENT", "DATSORT"]
TIMES = ["DATENT", "HEURE_DATENT", "DATSORT", "HEURE_DATSORT"]


@dataclass(frozen=True)
class StayTables:
    main: DataFrame
    acts: DataFrame
    diagnoses: DataFrame


def prepare(stays: DataFrame, zone: str | None = None, collapse: str | None = None, widen: dict[str, int] | bool | None = None) -> DataFrame:
    """Flat rows with typed core columns: absent ones are NULL, so plans don't depend on the payload's shape. widen: as in flatten."""
    flat = flatten(stays, collapse, widen, dates=tuple(RAW_TIMES))
    core = dict.fromkeys([*MAIN, *ACT_IDS, "DALL"])
    here = {c: quoted(c) for c in flat.columns}
    raw = {k: here.get(k, F.lit(None).cast("string")) for k in RAW_TIMES}
    parsed = {k: as_wall_clock(v, flat.schema[k].dataType if k in here else T.StringType(), zone) for k, v in raw.items()}
    made = parsed | {f"HEURE_{k}": clock_time(parsed[k], raw[k]) for k in raw}
    columns = [made[c].alias(c) if c in made else here[c].alias(c) if c in here else F.lit(None).cast("string").alias(c) for c in core]
    return flat.select(*columns, *[here[c].alias(c) for c in here if c not in core])


def main_table(prepared: DataFrame) -> DataFrame:
    return pick(prepared, MAIN).distinct()


def act_table(prepared: DataFrame, pairing: str = "suffix") -> DataFrame:
    """Procedures from wide columns, arrays, and arrays or maps of records at any path, side by side; distinct rows.

    Other columns about acts ride along.
    """
    used = {c for g in paired_columns(prepared.columns, VALUES, pairing) for c in g.values()} | {*record_columns(prepared.schema), *ACT_IDS}
    riding = [c for c in containing(prepared, "ACTE", "UFPRO", "UFDEM") if c not in used]
    return unpivot(prepared, [*ACT_IDS, *riding], VALUES, pairing).distinct()


def diagnosis_table(prepared: DataFrame, tokens: str = "DALL") -> DataFrame:
    """A row per token with a digit; repeated stays repeat. An array of texts counts as their joined text."""
    ids = [quoted(c) for c in ending(prepared, "ID") if c != tokens]
    own = quoted(tokens)
    if isinstance(prepared.schema[tokens].dataType, T.ArrayType):
        own = F.array_join(own, " ").alias(tokens)
    return diagnoses(prepared.select(*ids, *TIMES, own), tokens)


def diagnoses(rows: DataFrame, tokens: str) -> DataFrame:
    token = rows.withColumn(tokens, F.explode(F.split(tokens, " "))).where(has_digit(F.col(tokens)))
    return token.withColumns({"diag": token_code(F.col(tokens)), "type_diag": token_kind(F.col(tokens))}).drop(tokens)


def stay_tables(stays: DataFrame, pairing: str = "suffix", zone: str | None = None, collapse: str | None = None, widen: dict[str, int] | bool | None = None, json_col: str | None = None) -> StayTables:
    """Three lazy tables over one prepared plan; persist the input first if all three are written.

    json_col: where the stays are JSON texts of a column, of any and unlike shapes; their leaves are found in the data.
    """
    prepared = prepare(flatten_json(stays, json_col) if json_col else stays, zone, collapse, widen)
    return StayTables(main_table(prepared), act_table(prepared, pairing), diagnosis_table(prepared))
