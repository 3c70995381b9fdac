"""Document batches of loosely typed backends, and the counting of what they returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import as_text, stack


def document_rows(batch: object) -> list[dict] | None:
    """Rows of a batch: a list of records, one of the usual wrappers around it, a list of such, or one record; else None."""
    if isinstance(batch, dict):
        for wrapper in ("data", "result", "value"):
            if isinstance(batch.get(wrapper), (list, dict)):
                return document_rows(batch[wrapper])
        if batch and all(isinstance(v, list) for v in batch.values()) and len({len(v) for v in batch.values()}) == 1:
            return [dict(zip(batch, row, strict=True)) for row in zip(*batch.values(), strict=True)]
        return [batch] if batch else []
    if isinstance(batch, (list, tuple)):
        if all(isinstance(x, dict) and not any(isinstance(v, (list, dict)) for v in x.values()) for x in batch):
            return [x for x in batch if x]
        parts = [document_rows(x) for x in batch]
        return [r for p in parts if p for r in p] if any(p is not None for p in parts) else None
    return None


def document_table(*batches: DataFrame) -> DataFrame:
    """Distinct documents of all batches, as text."""
    return stack(*[as_text(b) for b in batches], distinct=True)


def distinct_with_null(column: Column) -> Column:
    """Number of different values, NULL being one."""
    return F.count_distinct(column) + F.coalesce(F.max(column.isNull().cast("int")), F.lit(0))


def out_units(module: str, value: object, kind: str = "data") -> int:
    """How much a call returned: stays, exams, different documents or rows."""
    if value is None:
        return 0
    if kind == "idtriplets":
        return len(value) if isinstance(value, list) else 0
    if module == "doceds":
        rows = document_rows(value) or []
        return len({r["DOC_ID"] if "DOC_ID" in r else None for r in rows}) if any("DOC_ID" in r for r in rows) else len(rows)
    return len(value) if isinstance(value, (list, dict)) else 0
