"""Flattening of nested payloads: of known type, with the schema as the plan, or of shapes that the data themselves tell."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import quoted

DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
#: Columns that arrays are spread into at most, all together; more fail with a message.
MOST_COLUMNS = 5000


class _Named:
    """Columns by name; a name that is taken, also but for case, gets the next free suffix _2, _3 …"""

    def __init__(self, taken: list[str] = ()):
        self.columns: dict[str, Column] = {}
        self.seen = {x.lower() for x in taken}

    def put(self, name: str, column: Column) -> None:
        own, n = name, 2
        while own.lower() in self.seen:
            own, n = f"{name}_{n}", n + 1
        self.seen.add(own.lower())
        self.columns[own] = column
        if len(self.columns) > MOST_COLUMNS:
            raise ValueError(f"over {MOST_COLUMNS} columns; keep long arrays as arrays")

    def select(self) -> list[Column]:
        return [c.alias(name) for name, c in self.columns.items()]


def _is_list(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType))


def _leaves(schema: T.StructType) -> list[tuple[str, Column, T.DataType]]:
    """(path, column, type) through all structs."""
    out = []

    def leaf(path: str, column: Column, kind: T.DataType) -> None:
        if not isinstance(kind, T.StructType):
            out.append((path, column, kind))
            return
        for x in kind:
            leaf(f"{path}.{x.name}", column.getField(x.name), x.dataType)

    for x in schema:
        leaf(x.name, quoted(x.name), x.dataType)
    return out


def widths(df: DataFrame, but: tuple[str, ...] = ()) -> dict[str, int]:
    """The longest array of scalars at each path, 1 at least: what flatten's widen needs. One aggregate over the data."""
    lists = [(path, c) for path, c, kind in _leaves(df.schema) if _is_list(kind) and path not in but]
    if not lists:
        return {}
    found = df.agg(*[F.max(F.size(c)).alias(f"n{i}") for i, (_, c) in enumerate(lists)]).first()
    return {path: max(1, n or 0) for (path, _), n in zip(lists, found, strict=True)}


def flatten(df: DataFrame, collapse: str | None = None, widen: dict[str, int] | bool | None = None, dates: tuple[str, ...] = ()) -> DataFrame:
    """One column per leaf, named by its path with dots, as text; arrays of structs stay as they are.

    Arrays of scalars stay arrays of text; collapse joins them by that separator; widen names, per path, into how many
    columns X1..Xn (X if n is 1) an array is spread instead, True measures the widths in the data first. Columns named in
    dates stay what they are if they are dates or timestamps. Names that clash, also but for case, get suffixes _2, _3 …
    """
    out, wide = _Named(), widths(df) if widen is True else widen or {}
    for path, column, kind in _leaves(df.schema):
        if _is_list(kind):
            texts = column.cast("array<string>")
            if path in wide:
                for i in range(wide[path]):
                    out.put(path if wide[path] == 1 else f"{path}{i + 1}", F.get(texts, F.lit(i)))
            else:
                out.put(path, F.array_join(texts, collapse) if collapse is not None else texts)
        elif isinstance(kind, (T.ArrayType, T.MapType, T.VariantType)) or path in dates and isinstance(kind, DATES):
            out.put(path, column)
        else:
            out.put(path, column.cast("string"))
    return df.select(*out.select())


@dataclass
class Shape:
    """What stands at one place of the values: scalars, objects with fields, arrays; unlike values make it several at once."""

    scalar: bool = False
    fields: dict[str, Shape] = field(default_factory=dict)
    element: Shape | None = None
    width: int = 0

    def __or__(self, other: Shape) -> Shape:
        names = {**self.fields, **other.fields}
        both = {n: self.fields[n] | other.fields[n] if n in self.fields and n in other.fields else x for n, x in names.items()}
        element = self.element | other.element if self.element and other.element else self.element or other.element
        return Shape(self.scalar or other.scalar, both, element, max(self.width, other.width))

    @property
    def mixed(self) -> bool:
        return self.scalar and bool(self.fields or self.element)


def _type_of(told: str | None) -> T.DataType | None:
    """The type that schema_of_variant_agg names; it writes OBJECT where types are written STRUCT."""
    if told is None:
        return None
    ddl = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], told)
    return T._parse_datatype_string(f"x {ddl}")[0].dataType


def _step(name: str) -> str | None:
    """How a variant path names a field; None for names that it can't."""
    quote = next((q for q in "'\"" if q not in name), None)
    return f"[{quote}{name}{quote}]" if quote and name else None


def _field(value: Column, name: str) -> Column:
    step = _step(name)
    if step:
        return F.try_variant_get(value, f"${step}", "variant")
    return F.get(F.map_values(F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, _: k == F.lit(name))), F.lit(0))


def _discovered(values: DataFrame) -> Shape:
    """The shape of the column v. Values of unlike kinds are looked at by kind, and so are places that are unlike inside."""
    told = F.schema_of_variant("v")
    is_object, is_array = told.startswith("OBJECT"), told.startswith("ARRAY")
    agg = lambda x: F.schema_of_variant_agg(F.when(x, F.col("v")))
    objects, arrays, scalars = values.agg(agg(is_object), agg(is_array), F.max(~is_object & ~is_array & (told != "VOID"))).first()

    def typed(kind: T.DataType | None, of: DataFrame) -> Shape:
        if isinstance(kind, T.VariantType):
            return _discovered(of)
        if isinstance(kind, T.StructType):
            return Shape(fields={x.name: typed(x.dataType, of.select(_field(F.col("v"), x.name).alias("v"))) for x in kind})
        if isinstance(kind, T.ArrayType):
            each = of.select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("v"))
            return Shape(element=typed(kind.elementType, each))
        return Shape(scalar=True)

    parts = [typed(_type_of(x), values.where(of)) for x, of in ((objects, is_object), (arrays, is_array)) if x not in (None, "VOID")]
    return reduce(Shape.__or__, parts, Shape(scalar=bool(scalars)))


def _arrays(shape: Shape) -> list[Shape]:
    """The places in a shape that hold arrays, in the order of _sizes."""
    below = [y for x in shape.fields.values() for y in _arrays(x)]
    return below + ([shape, *_arrays(shape.element)] if shape.element else [])


def _sizes(value: Column, shape: Shape) -> list[Column]:
    """For each place of _arrays the size of the longest array that this value has there."""
    found = [y for name, x in shape.fields.items() for y in _sizes(_field(value, name), x)]
    if shape.element:
        parts = F.try_variant_get(value, "$", "array<variant>")
        found.append(F.size(parts))
        below = lambda k: lambda x: _sizes(x, shape.element)[k]
        found += [F.array_max(F.transform(parts, below(k))) for k in range(len(_arrays(shape.element)))]
    return found


def shape_of(df: DataFrame, json_col: str) -> Shape:
    """The shape of all JSON texts of a column together, with the widths of its arrays, by aggregates over the data.

    Two passes where each place holds values of one kind, and one more for each place that doesn't. Malformed texts count as NULL.
    """
    values = df.select(F.try_parse_json(F.col(json_col)).alias("v")).where("v IS NOT NULL")
    shape = _discovered(values)
    arrays = _arrays(shape)
    if arrays:
        found = values.agg(*[F.max(n).alias(f"n{i}") for i, n in enumerate(_sizes(F.col("v"), shape))]).first()
        for place, n in zip(arrays, found, strict=True):
            place.width = n or 0
    return shape


def flatten_json(df: DataFrame, json_col: str, shape: Shape | None = None) -> DataFrame:
    """The other columns, and a column of text per leaf of the JSON texts, whatever their shapes: a.b, and X1..Xn for arrays.

    An array whose longest is of one element is X; a scalar where others hold an array is its first element, one where
    others hold an object is a column of the object's own name. Names that clash get suffixes _2, _3 … Leaves come
    in the order of their names, arrays' in that of their places. NULL, malformed texts and missing leaves give NULL; a
    shape without leaves no columns. shape: of shape_of, if it is known; else the data are looked at first.
    """
    shape = shape_of(df, json_col) if shape is None else shape
    kept = [c for c in df.columns if c != json_col]
    own_name = "v" + "_" * max(map(len, df.columns))
    out, parsed = _Named(kept), F.col(own_name)

    def scalar(value: Column, path: str, own: Shape) -> Column:
        text = F.try_variant_get(value, path, "string")
        if not own.mixed:
            return text
        told = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
        return F.when(~told.startswith("OBJECT") & ~told.startswith("ARRAY"), text)

    def put(name: str, value: Column, path: str, own: Shape, first: Column | None = None) -> None:
        """first: what stands here if the value is no array though others are."""
        called = name or json_col
        if own.scalar and not own.element:
            out.put(called, scalar(value, path, own) if first is None else F.coalesce(scalar(value, path, own), first))
        elif first is not None and not own.element:
            out.put(called, first)
        for key, x in own.fields.items():
            step = _step(key)
            put(f"{name}.{key}" if name else key, *((value, path + step) if step else (_field(F.try_variant_get(value, path, "variant"), key), "$")), x)
        if own.element:
            alone = scalar(value, path, own) if own.scalar else first
            width = max(own.width, 1)
            for i in range(width):
                put(called if width == 1 else f"{called}{i + 1}", value, f"{path}[{i}]", own.element, alone if i == 0 else None)

    put("", parsed, "$", shape)
    rows = df.select(*[quoted(c) for c in kept], F.try_parse_json(quoted(json_col)).alias(own_name))
    return rows.select(*[quoted(c) for c in kept], *out.select())


def json_leaves(df: DataFrame, json_col: str, fields: dict[str, str]) -> DataFrame:
    """Adds typed leaves of a JSON text: {column: path}, as text; NULL for malformed text."""
    value = F.try_parse_json(F.col(json_col))
    return df.withColumns({name: F.try_variant_get(value, path, "string") for name, path in fields.items()})


def unknown_leaves(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """(keep, key, value) for every top-level key of JSON objects whose keys aren't known beforehand."""
    parsed = df.select(*keep, F.try_parse_json(F.col(json_col)).alias("v"))
    return parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer())).select(*keep, "key", F.col("value").cast("string").alias("value"))
