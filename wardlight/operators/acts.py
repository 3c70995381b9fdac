"""Procedures from columns, arrays and records at any path to long rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import quoted

#: Names of what is recorded per procedure.
VALUES = ["CODEACTE", "DATEACTE", "UFPRO", "UFDEM", "NOMENCLATURE"]

#: A column and its type, by the path that names it.
Leaves = dict[str, tuple[Column, T.DataType]]


def paired_columns(columns: list[str], values: list[str], pairing: str) -> list[dict[str, str]]:
    """Which columns form one long row: those of one path and suffix, or the k-th of each value."""
    matched = [(m[2], (m[1], m[3]), c) for c in columns if (m := re.fullmatch(f"(.*?)({'|'.join(values)})(.*)", c))]
    if pairing == "suffix":
        groups: dict[tuple[str, str], dict[str, str]] = {}
        for value, around, c in matched:
            groups.setdefault(around, {})[value] = c
        return list(groups.values())
    if pairing != "position":
        raise ValueError("pairing is suffix or position")
    of = {v: [c for value, _, c in matched if value == v] for v in values}
    return [{v: cs[k] for v, cs in of.items() if k < len(cs)} for k in range(max((len(cs) for cs in of.values()), default=0))]


def _is_list(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType))


def holds_records(kind: T.DataType) -> bool:
    """Whether a value of this type may hold structs in arrays or maps."""
    if isinstance(kind, T.ArrayType):
        return isinstance(kind.elementType, T.StructType) or holds_records(kind.elementType)
    return isinstance(kind, T.MapType) and (isinstance(kind.valueType, T.StructType) or holds_records(kind.valueType))


def _names_a_value(kind: T.DataType, values: list[str]) -> bool:
    if isinstance(kind, T.StructType):
        return any(any(v in f.name for v in values) or _names_a_value(f.dataType, values) for f in kind)
    return isinstance(kind, (T.ArrayType, T.MapType)) and _names_a_value(kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType, values)


def record_columns(schema: T.StructType, values: list[str] = VALUES) -> list[str]:
    """Columns whose records, at any depth, name one of the values."""
    return [f.name for f in schema if holds_records(f.dataType) and _names_a_value(f.dataType, values)]


def _rows(leaves: Leaves, group: dict[str, str], values: list[str]) -> Column:
    """Array of long rows of one group of columns: one row, or where columns are arrays one for each place.

    Shorter arrays end in NULLs, as numbered columns would; a single value, or an array of one, stands at each place.
    """
    lists = {v: leaves[c][0].cast("array<string>") for v, c in group.items() if _is_list(leaves[c][1])}
    none = F.lit(None).cast("string")
    if not lists:
        return F.array(F.struct(*[(leaves[group[v]][0].cast("string") if v in group else none).alias(v) for v in values]))
    sizes = [F.coalesce(F.size(x), F.lit(0)) for x in lists.values()]
    n = F.greatest(*sizes, F.lit(1))

    def at(v: str, i: Column) -> Column:
        if v in lists:
            return F.get(lists[v], F.when(F.size(lists[v]) == 1, F.lit(0)).otherwise(i))
        return leaves[group[v]][0].cast("string") if v in group else none

    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(*[at(v, i).alias(v) for v in values]))


def _opened(path: str, column: Column, kind: T.DataType, leaves: Leaves) -> None:
    """Adds the leaves of a value, through its structs, to leaves; arrays and maps are leaves."""
    if not isinstance(kind, T.StructType):
        leaves[path] = column, kind
        return
    for field in kind:
        _opened(f"{path}.{field.name}" if path else field.name, column.getField(field.name), field.dataType, leaves)


def _all_rows(leaves: Leaves, values: list[str], pairing: str) -> Column | None:
    """Array of long rows of one record: of its own columns, then of the records in its arrays and maps, theirs included."""
    wide = {c: x for c, x in leaves.items() if not holds_records(x[1])}
    parts = [_rows(leaves, g, values) for g in paired_columns(list(wide), values, pairing)]
    parts += [made for c, (column, kind) in leaves.items() if c not in wide if (made := _of_records(column, kind, values, pairing)) is not None]
    return F.flatten(F.array(*parts)) if parts else None


def _of_records(column: Column, kind: T.DataType, values: list[str], pairing: str) -> Column | None:
    """Array of long rows of all records in an array or map, in their order (a map's in that of its entries)."""
    if not _names_a_value(kind, values):
        return None
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
    each: Callable[[Column], Column]
    if isinstance(inner, T.StructType):

        def each(x: Column) -> Column:
            own: Leaves = {}
            _opened("", x, inner, own)
            return _all_rows(own, values, pairing)

    else:

        def each(x: Column) -> Column:
            return _of_records(x, inner, values, pairing)

    # One array of NULL would make all of them NULL.
    lists = F.transform(F.coalesce(column if isinstance(kind, T.ArrayType) else F.map_values(column), F.array()), each)
    return F.flatten(F.filter(lists, lambda x: x.isNotNull()))


def unpivot(df: DataFrame, ids: list[str], values: list[str] = VALUES, pairing: str = "suffix") -> DataFrame:
    """(ids, values): a row per procedure that has any value, from numbered columns, arrays of values, and arrays or maps of
    records at any depth, side by side. One narrow pass, no self-union."""
    records = record_columns(df.schema, values)
    leaves = {f.name: (quoted(f.name), f.dataType) for f in df.schema if f.name in records or not holds_records(f.dataType)}
    rows, own = _all_rows(leaves, values, pairing), [quoted(c) for c in ids]
    if rows is None:
        return df.select(*own, *[F.lit(None).cast("string").alias(v) for v in values]).limit(0)
    return df.select(*own, F.inline(rows)).where(F.coalesce(*values).isNotNull())
