"""Typed cells: one column form for values that may be text, flag, number or nested.

A cell is a struct (kind, text, number): kind 's' text, 'b' flag, 'n' number,
'o' anything else, 'z' present but empty; a NULL struct means the name is absent.
"""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

CELL = "struct<kind: string, text: string, number: double>"
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
DEPTH = 3


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _make(kind: str, text: Column, number: Column | None = None) -> Column:
    value = F.lit(None).cast("double") if number is None else number.cast("double")
    return F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"), value.alias("number"))


def _empty() -> Column:
    return _make("z", F.lit(None))


def cell(value: Column, kind: T.DataType) -> Column:
    """The cell of a typed column; lists give their first element, missing values 'z'."""
    if isinstance(kind, T.ArrayType):
        first = cell(F.get(value, F.lit(0)), kind.elementType)
        inner = F.when(F.get(value, F.lit(0)).isNotNull(), first).otherwise(_make("o", F.lit("None")))
        return F.when(F.size(value) > 0, inner).otherwise(_empty())
    if isinstance(kind, T.StringType):
        made = _make("s", value)
    elif isinstance(kind, T.BooleanType):
        made = _make("b", F.when(value, "True").otherwise("False"), value.cast("int"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(value.isNotNull() & ~F.isnan(value), _make("n", value, value)).otherwise(_empty())
    elif isinstance(kind, T.NumericType):
        made = _make("n", value, value)
    elif isinstance(kind, (T.StructType, T.MapType)):
        made = _make("o", F.to_json(value))
    else:
        made = _make("o", value)
    return F.when(value.isNotNull(), made).otherwise(_empty())


def literal_cells(text: Column, depth: int = DEPTH) -> Column:
    """Cells of a text that spells a Python dictionary, those ``depth`` levels down included; else NULL.

    Of a list ``messages`` the first content by role stands under ``messages/role``.
    """

    @pandas_udf(f"array<struct<name: string, cell: {CELL}>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _literal_cells(t, depth))

    return parse(text)


def _literal_cells(text: str | None, depth: int):
    try:
        value = ast.literal_eval(text) if text is not None else None
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    flat: dict = {}
    level = [value]
    for _ in range(depth):
        below = []
        for d in level:
            for name, v in d.items():
                if isinstance(v, str) and v.strip().startswith("{") and v.strip().endswith("}"):
                    try:
                        v = ast.literal_eval(v)
                    except (ValueError, SyntaxError):
                        pass
                flat.setdefault(str(name), v)
                if isinstance(v, dict):
                    below.append(v)
        level = below
    found = [{"name": name, "cell": _python_cell(v)} for name, v in flat.items()]
    spoken: dict = {}
    for m in flat["messages"] if isinstance(flat.get("messages"), (list, tuple)) else ():
        if isinstance(m, dict):
            spoken.setdefault(f"messages/{m.get('role')}", m.get("content"))
    return found + [{"name": name, "cell": _python_cell(v)} for name, v in spoken.items()]


def _python_cell(v) -> dict:
    if isinstance(v, list):
        v = v[0] if v else None
        if v is None:
            return {"kind": "z", "text": None, "number": None}
    if v is None or (isinstance(v, float) and v != v):
        return {"kind": "z", "text": None, "number": None}
    if isinstance(v, bool):
        return {"kind": "b", "text": str(v), "number": float(v)}
    if isinstance(v, (int, float)):
        return {"kind": "n", "text": str(v), "number": float(v)}
    return {"kind": "s" if isinstance(v, str) else "o", "text": str(v), "number": None}


def _variant_cell(value: Column) -> Column:
    """The cell of a VARIANT; a list gives its first element, whatever that holds."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, F.lit("$"), "string")
    number = F.try_variant_get(value, F.lit("$"), "double")
    plain = kind.startswith("STRING")
    return (
        F.when(kind == "VOID", _empty()).when(plain, _make("s", text))
        .when(kind == "BOOLEAN", _make("b", F.when(text == "true", "True").otherwise("False"), (text == "true").cast("int")))
        .when(number.isNull() | kind.startswith("OBJECT") | kind.startswith("ARRAY"), _make("o", text))
        .when(F.isnan(number), _empty()).otherwise(_make("n", text, number)))


def _variant_entries(value: Column) -> Column:
    return F.map_entries(F.try_variant_get(value, F.lit("$"), "map<string,variant>"))


def variant_cells(df: DataFrame, value: Column, name: str, depth: int = DEPTH) -> DataFrame:
    """``df`` with ``name``: the cells of a VARIANT object by field, those ``depth`` levels down included; NULL for other values.

    Fields of one object come in the order of their names, outer ones first. Of a list ``messages`` the first
    content by role stands under ``messages/role``.
    """
    levels = [f"{name}_{i}" for i in range(depth + 1)]
    df = df.withColumn(levels[0], _variant_entries(value))
    for above, level in zip(levels, levels[1:]):
        inner = F.filter(F.transform(above, lambda e: _variant_entries(e["value"])), lambda v: v.isNotNull())
        df = df.withColumn(level, F.flatten(inner))
    every = F.concat(*levels)

    def first_element(e: Column) -> Column:
        return F.try_variant_get(e["value"], F.lit("$[0]"), "variant")

    def one(e: Column) -> Column:
        listed = F.schema_of_variant(e["value"]).startswith("ARRAY")
        first = first_element(e)
        element = F.when(first.isNull(), _empty()).when(F.schema_of_variant(first) == "VOID", _make("o", F.lit("None"))).otherwise(_variant_cell(first))
        return F.struct(e["key"].alias("name"), F.when(listed, element).otherwise(_variant_cell(e["value"])).alias("cell"))

    turns = F.try_variant_get(F.get(F.filter(every, lambda e: e["key"] == "messages"), F.lit(0))["value"], F.lit("$"), "array<variant>")

    def spoken(role: str) -> Column:
        said = F.filter(turns, lambda m: F.try_variant_get(m, F.lit("$.role"), "string") == role)
        content = F.transform(F.slice(said, 1, 1), lambda m: F.struct(
            F.lit(f"messages/{role}").alias("name"), _variant_cell(F.try_variant_get(m, F.lit("$.content"), "variant")).alias("cell")))
        return F.coalesce(content, F.array().cast(f"array<struct<name: string, cell: {CELL}>>"))

    return df.withColumn(name, F.concat(F.transform(every, one), spoken("assistant"), spoken("user"))).drop(*levels)


def looks_like_dict(text: Column) -> Column:
    bare = strip(text)
    return bare.startswith("{") & bare.endswith("}")


Path = tuple[str, ...]


def _at(path: Path) -> Column:
    value = F.col(f"`{path[0]}`")
    for name in path[1:]:
        value = value.getField(name)
    return value


def _text_paths(kind: T.StructType, depth: int = DEPTH, above: Path = ()) -> list[Path]:
    """Text columns, and text fields of structs ``depth`` levels down."""
    out = [(*above, f.name) for f in kind.fields if isinstance(f.dataType, T.StringType)]
    for f in kind.fields:
        if depth > 1 and isinstance(f.dataType, T.StructType):
            out += _text_paths(f.dataType, depth - 1, (*above, f.name))
    return out


def dict_columns(df: DataFrame) -> list[Path]:
    """Text columns and fields in which some value is written like a dictionary (one pass)."""
    paths = _text_paths(df.schema)
    if not paths:
        return []
    found = df.agg(*[F.coalesce(F.bool_or(looks_like_dict(_at(path))), F.lit(False)).alias(f"c{i}")
                     for i, path in enumerate(paths)]).first()
    return [path for i, path in enumerate(paths) if found[f"c{i}"]]


class Cells:
    """Looks names up in a frame: own columns first, then fields of nested values.

    Fields only fill names the row does not have; the first nested value that holds
    a name wins. ``literal_columns`` are columns, or paths of fields, whose text may spell a dictionary.
    Maps and VARIANT objects have no fixed fields: their names are looked up in each row, after those of typed fields
    and spelled dictionaries, and within one object in the order of names.
    """

    def __init__(self, df: DataFrame, literal_columns: Sequence[str | Path] = ()):
        self.top = {f.name: f.dataType for f in df.schema.fields}
        paths = [(c,) if isinstance(c, str) else tuple(c) for c in literal_columns]
        self.spelled = {path: f"_literal{i}" for i, path in enumerate(p for p in paths if p[0] in self.top)}
        for path, name in self.spelled.items():
            text = F.when(looks_like_dict(_at(path)), _at(path))
            df = df.withColumn(name, literal_cells(text, DEPTH + 1 - len(path)))
        self.shapeless: list[tuple[Column, int]] = []
        self.nested: list[tuple[str, Column, T.DataType, Column]] = []
        for name, kind in self.top.items():
            self._walk(F.col(f"`{name}`"), kind, DEPTH)
        order = list(self.top)
        self.literals = [F.col(self.spelled[p]) for p in sorted(self.spelled, key=lambda p: (len(p), order.index(p[0])))]
        for i, (value, depth) in enumerate(self.shapeless):
            df = variant_cells(df, value, f"_shapeless{i}", depth)
            self.literals.append(F.col(f"_shapeless{i}"))
        self.df = df

    def _walk(self, value: Column, kind: T.DataType, depth: int) -> None:
        if isinstance(kind, T.VariantType) and depth:
            self.shapeless.append((value, depth - 1 + (depth == DEPTH)))
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) and depth:
            self.shapeless.append((F.to_variant_object(value), depth - 1))
        if depth == 0 or not isinstance(kind, T.StructType):
            return
        for field in kind.fields:
            self.nested.append((field.name, value.getField(field.name), field.dataType, value.isNotNull()))
        for field in kind.fields:
            self._walk(value.getField(field.name), field.dataType, depth - 1)

    def is_numeric(self, name: str) -> bool:
        """Whether a name is a column of numbers."""
        return isinstance(self.top.get(name), T.NumericType)

    def messages(self) -> Column | None:
        """The chat messages of a row: a column of that name, or else a field of a nested value."""
        def chat(kind: T.DataType) -> bool:
            return (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
                    and {"role", "content"} <= set(kind.elementType.fieldNames()))

        if "messages" in self.top:
            return F.col("messages") if chat(self.top["messages"]) else None
        found = [value for name, value, kind, _ in self.nested if name == "messages" and chat(kind)]
        return F.coalesce(*found) if found else None

    def __getitem__(self, name: str) -> Column | None:
        """The cell of a name (NULL where the row lacks it), or None if no row has it."""
        if name in self.top:
            return cell(F.col(f"`{name}`"), self.top[name])
        found = [F.when(present, cell(value, kind))
                 for field, value, kind, present in self.nested if field == name]
        found += [F.get(F.filter(cells, lambda c: c["name"] == name), F.lit(0))["cell"] for cells in self.literals]
        return F.coalesce(*found) if found else None

    def first(self, names: Sequence[str]) -> Column:
        """The first of the names with a usable value; NULL if there is none."""
        usable = [F.when(c["kind"] != "z", c) for c in (self[n] for n in names) if c is not None]
        return F.coalesce(*usable) if usable else F.lit(None).cast(CELL)

    def long_text(self, longer_than: int, excluded: Sequence[str]) -> Column:
        """The first long text in key order, fields of nested values after the columns."""
        parts = []
        for name, kind in self.top.items():
            if isinstance(kind, T.StringType) and name not in excluded:
                value = F.col(f"`{name}`")
                if (name,) in self.spelled:
                    value = F.when(F.col(self.spelled[(name,)]).isNull(), value)
                parts.append(F.when(F.length(value) > longer_than, value))
        seen = set(self.top)
        for name, value, kind, _ in self.nested:
            if isinstance(kind, T.StringType) and name not in excluded and name not in seen:
                parts.append(F.when(F.length(value) > longer_than, value))
        shut = list(excluded) + list(self.top)
        for cells in self.literals:
            long = F.filter(cells, lambda c: (c["cell"]["kind"] == "s") & (
                F.length(c["cell"]["text"]) > longer_than) & ~c["name"].isin(*shut))
            parts.append(F.get(long, F.lit(0))["cell"]["text"])
        return F.coalesce(*parts) if parts else F.lit(None).cast("string")
