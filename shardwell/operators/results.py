"""Results and what is done to them on the client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from ..catalog import SpaceDef
from ..errors import FilterFieldsError, FlattenError, UnflattenError


def plain(value):
    """Variants and nested rows as Python values."""
    if hasattr(value, "toPython"):
        return value.toPython()
    return value.asDict(recursive=True) if hasattr(value, "asDict") else value


class Result:
    """Metadata and a lazy DataFrame; rows are fetched when asked for, `told` once of how many."""

    def __init__(self, metadata: list[dict], df: DataFrame | None = None, rows: list[tuple] | None = None, told: Callable[[int], None] | None = None):
        self.metadata, self.df, self._rows, self._told = metadata, df, rows, told

    def rows(self) -> list[tuple]:
        if self._rows is None:
            self._rows = [tuple(map(plain, r)) for r in self.df.collect()]
            if self._told:
                self._told(len(self._rows))
        return self._rows

    def objects(self) -> list[dict]:
        return [dict(zip((m["name"] for m in self.metadata), r, strict=True)) for r in self.rows()]

    def __iter__(self) -> Iterator[tuple]:
        return iter(self.rows())

    def __len__(self) -> int:
        return len(self.rows())


def metadata_of(space: SpaceDef, fields=None) -> list[dict]:
    out = []
    for name in fields if fields is not None else space.names:
        f = space.field(name)
        if f is None:
            raise FilterFieldsError(f'Space format doesn\'t contain field named "{name}"')
        out.append(f.describe())
    return out


def cut_rows(rows, metadata, fields) -> Result:
    """Keep the leading fields; they must be named as the metadata has them, in order."""
    if metadata is not None:
        for n, f in enumerate(fields):
            if n >= len(metadata) or metadata[n]["name"] != f:
                raise FilterFieldsError(f'Field names don\'t match to tuple metadata: "{f}"')
        metadata = metadata[: len(fields)]
    elif any(len(r) < len(fields) for r in rows):
        raise FilterFieldsError("Field names don't match to tuple metadata")
    return Result(metadata, rows=[tuple(r)[: len(fields)] for r in rows])


def cut_objects(objects, fields) -> list[dict]:
    return [{f: o.get(f) for f in fields if f in o} for o in objects]


def unflatten_rows(rows, metadata) -> list[dict]:
    if metadata is None:
        raise UnflattenError("Metadata is not provided")
    out = []
    for r in rows:
        for m, v in zip(metadata, r, strict=False):
            if v is None and not m.get("is_nullable"):
                raise UnflattenError(f"Field {m['name']} isn't nullable")
        out.append({m["name"]: v for m, v in zip(metadata, r, strict=False)})
    return out


def flatten(obj: dict, space: SpaceDef, bucket_id: int | None = None, skip_nullability_check: bool = False) -> tuple:
    """An object as a row in the order of the format; absent is None."""
    for k in obj:
        if space.field(k) is None:
            raise FlattenError(f'Object is specified in bad format: Unknown field "{k}" is specified')
    out = []
    for f in space.fields:
        value = obj.get(f.name)
        if f.name == space.bucket_field:
            value = value if bucket_id is None else bucket_id
        elif value is None and not f.is_nullable and not skip_nullability_check:
            raise FlattenError(f'Object is specified in bad format: Field "{f.name}" isn\'t nullable (set skip_nullability_check_on_flatten option to true to skip check)')
        out.append(value)
    return tuple(out)
