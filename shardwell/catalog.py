"""Logical tables: fields, indexes (order and uniqueness, no trees), sharding, and where rows come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from .errors import SchemaError, UnsupportedCollationError

TREE = "TREE"
#: Collation of an index part to Spark's name for it; binary order needs none.
COLLATIONS = {"none": None, "binary": None, "unicode": "UNICODE", "unicode_ci": "UNICODE_CI_AI"}
SPARK_TYPES: dict[str, T.DataType] = {
    "unsigned": T.LongType(), "integer": T.LongType(), "number": T.DoubleType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(),
    "decimal": T.DecimalType(38, 15), "uuid": T.StringType(), "datetime": T.TimestampNTZType(), "interval": T.DayTimeIntervalType(), "any": T.VariantType(),
}


@dataclass(frozen=True)
class FieldDef:
    name: str
    type: str = "any"
    is_nullable: bool = False
    spark_type: T.DataType | None = None  # for map, array and whatever SPARK_TYPES lacks

    @property
    def data_type(self) -> T.DataType:
        return self.spark_type or SPARK_TYPES[self.type]

    def describe(self) -> dict:
        return {"name": self.name, "type": self.type} | ({"is_nullable": True} if self.is_nullable else {})


@dataclass(frozen=True)
class Part:
    field: str
    collation: str | None = None
    path: str | None = None  # inside a map or any field: "car_id.signed"
    is_nullable: bool | None = None  # None: as the field
    type: str | None = None  # of what the path leads to

    def __post_init__(self):
        if self.collation is not None and self.collation not in COLLATIONS:
            raise UnsupportedCollationError(f"Unsupported collation {self.collation!r}")


@dataclass(frozen=True)
class IndexDef:
    name: str
    parts: tuple[Part, ...]
    unique: bool = True
    type: str = TREE
    id: int = 0

    @classmethod
    def on(cls, name: str, *parts: str | Part, unique: bool = True, type: str = TREE) -> IndexDef:
        return cls(name, tuple(p if isinstance(p, Part) else Part(p) for p in parts), unique, type)


@dataclass(frozen=True)
class SpaceDef:
    """indexes by id; ids may have holes (dropped indexes), id 0 is the primary one."""

    name: str
    fields: tuple[FieldDef, ...]
    indexes: dict[int, IndexDef]
    sharding_key: tuple[str, ...] | None = None
    sharding_func: str | Callable | None = None
    bucket_field: str = "bucket_id"

    @classmethod
    def of(cls, name: str, fields, indexes, **more) -> SpaceDef:
        fields = tuple(f if isinstance(f, FieldDef) else FieldDef(*f) for f in fields)
        numbered = indexes.items() if isinstance(indexes, dict) else enumerate(indexes)
        return cls(name, fields, {k: replace(i, id=k) for k, i in numbered if i is not None}, **more)

    @property
    def primary(self) -> IndexDef | None:
        return self.indexes.get(0)

    def by_name(self, name: str) -> IndexDef | None:
        return next((i for _, i in sorted(self.indexes.items()) if i.name == name), None)

    def field(self, name: str) -> FieldDef | None:
        return next((f for f in self.fields if f.name == name), None)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def has_bucket(self) -> bool:
        return self.field(self.bucket_field) is not None

    def nullable(self, part: Part) -> bool:
        """A path may lead nowhere, so it is nullable unless the part says otherwise."""
        if part.is_nullable is not None:
            return part.is_nullable
        f = self.field(part.field)
        return True if part.path or f is None else f.is_nullable

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.data_type, True) for f in self.fields])

    @property
    def shard_by(self) -> tuple[str, ...]:
        return self.sharding_key or tuple(p.field for p in self.primary.parts)


@dataclass
class Catalog:
    spaces: dict[str, SpaceDef] = field(default_factory=dict)

    def add(self, space: SpaceDef) -> SpaceDef:
        self.spaces[space.name] = space
        return space

    def get(self, name: str, error=SchemaError) -> SpaceDef:
        if name not in self.spaces:
            raise error(f'Space "{name}" doesn\'t exist')
        return self.spaces[name]
