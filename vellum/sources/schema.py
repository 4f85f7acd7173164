"""Declared fields: what a document may hold, and checks that name the place of an error."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = re.compile(r"^[a-zA-Z_][a-zA-Z_0-9]*$")
POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
TYPES = {
    "text": T.StringType(), "atom": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(),
    "float": T.FloatType(), "double": T.DoubleType(), "latlon": POINT, "datetime": T.TimestampType(),
}


class FieldError(ValueError):
    """An error with its place: ``fields > price > sort: reason``."""

    def __init__(self, place: list[str], reason: str):
        super().__init__(f"{' > '.join(place)}: {reason}")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    multi_valued: bool = False
    search: bool = False
    store: bool = False
    sort: bool = False
    group: bool = False
    highlight: bool = False
    facet: str = "no"
    date_format: str | None = None
    expression: str | None = None

    def check(self) -> None:
        at = ["fields", self.name]
        if not NAME.match(self.name) or self.name.endswith("_boost"):
            raise FieldError(at, "a name has letters, digits and _, begins with no digit and does not end with _boost")
        if self.type not in TYPES and self.type != "virtual":
            raise FieldError([*at, "type"], f"unknown type {self.type}; it must be one of {sorted([*TYPES, 'virtual'])}")
        if self.sort and self.type == "text":
            raise FieldError([*at, "sort"], "a text field cannot be sorted by")
        if self.group and (self.multi_valued or self.type == "datetime"):
            raise FieldError([*at, "group"], "a multi-valued field or a time cannot be grouped by")
        if self.highlight and self.type not in ("text", "atom"):
            raise FieldError([*at, "highlight"], "only text and atom fields can be highlighted")
        if self.type == "datetime" and not self.date_format:
            raise FieldError([*at, "dateTimeFormat"], "a time needs a format")
        if (self.type == "virtual") != (self.expression is not None):
            raise FieldError([*at, "expression"], "virtual fields have an expression, others none")
        if self.facet == "numericRange" and self.type not in ("int", "long", "float", "double"):
            raise FieldError([*at, "facet"], "ranges need a number")
        if self.facet not in ("no", "flat", "hierarchy", "numericRange", "sortedSetDocValues"):
            raise FieldError([*at, "facet"], f"unknown kind {self.facet}")
        if not (self.search or self.store or self.sort or self.group or self.highlight or self.facet != "no" or self.type in ("text", "atom", "virtual")):
            raise FieldError(at, "the field is used for nothing")

    def column(self) -> T.StructField:
        kind = T.ArrayType(T.StringType()) if self.facet == "hierarchy" else TYPES[self.type]
        return T.StructField(self.name, T.ArrayType(kind) if self.multi_valued else kind)


class Schema:
    """Fields by name; virtual ones are Spark SQL expressions over the others, in order."""

    def __init__(self, fields: list[Field]):
        self.fields: dict[str, Field] = {}
        for f in fields:
            f.check()
            if f.name in self.fields:
                raise FieldError(["fields", f.name], "the field is already registered")
            self.fields[f.name] = f

    def struct(self) -> T.StructType:
        return T.StructType([f.column() for f in self.fields.values() if f.type != "virtual"])

    def with_virtual(self, rows: DataFrame) -> DataFrame:
        for f in self.fields.values():
            if f.type == "virtual":
                rows = rows.withColumn(f.name, F.expr(f.expression).cast("double"))
        return rows
