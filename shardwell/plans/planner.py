"""Which index orders a request, in which direction, over which key, with which fields, on which shard."""

from __future__ import annotations

import datetime as dt
import decimal
from dataclasses import dataclass

from ..catalog import TREE, IndexDef, Part, SpaceDef
from ..errors import FilterFieldsError, IndexTypeError, NoIndexesError, SelectError
from .conditions import DESCENDING, Condition


@dataclass(frozen=True)
class SelectPlan:
    space: SpaceDef
    conditions: tuple[Condition, ...]
    index: IndexDef
    scan: int | None  # number of the condition that the index serves, None: a residual filter like the others
    operator: str  # of the scan, before any turn
    descending: bool  # direction of the result
    backward: bool  # the last |first| rows before `after`
    key: tuple[Part, ...]  # scan key, then what the primary key adds
    fields: tuple[str, ...] | None  # with key fields added
    limit: int | None
    after: tuple | None  # values of key
    sharding_key: tuple | None


def scan_index(space: SpaceDef, conditions: list[Condition]) -> tuple[IndexDef, int | None]:
    """The first condition that some tree index serves, by index name before first field; else the primary index."""
    trees = [i for _, i in sorted(space.indexes.items()) if i.type == TREE]
    for n, c in enumerate(conditions):
        for fits in (lambda i: i.name == c.operand, lambda i: i.parts[0].field == c.operand):  # noqa: B023
            if found := next(filter(fits, trees), None):
                return found, n
    if space.primary is None:
        raise NoIndexesError(f'Space "{space.name}" has no indexes, space should have primary index')
    if space.primary.type != TREE:
        raise IndexTypeError("An index that matches specified conditions was not found: At least one of condition indexes or primary index should be of type TREE")
    return space.primary, None


def ordering_key(index: IndexDef, primary: IndexDef) -> tuple[Part, ...]:
    have = {p.field for p in index.parts}
    return index.parts + tuple(p for p in primary.parts if p.field not in have)


def enriched(space: SpaceDef, fields, key: tuple[Part, ...]) -> tuple[str, ...] | None:
    if fields is None:
        return None
    for f in fields:
        if space.field(f) is None:
            raise FilterFieldsError(f'Space format doesn\'t contain field named "{f}"')
    return tuple(fields) + tuple(dict.fromkeys(p.field for p in key if p.field not in fields))


def after_values(space: SpaceDef, key: tuple[Part, ...], fields: tuple[str, ...] | None, after) -> tuple | None:
    """Key values of a row given as dict, Row, or a sequence in the order of `fields` (else of the format)."""
    if after is None:
        return None
    named = after.asDict() if hasattr(after, "asDict") else after if isinstance(after, dict) else dict(zip(fields or space.names, after, strict=False))
    out = []
    for p in key:
        if p.field not in named:
            raise FilterFieldsError(f'Field "{p.field}" is missed in the after row')
        value = named[p.field]
        for step in (p.path or "").split(".") if p.path else ():
            if hasattr(value, "toPython"):
                value = value.toPython()
            value = value.asDict() if hasattr(value, "asDict") else value
            value = value.get(step) if isinstance(value, dict) else None
        out.append(value)
    return tuple(out)


def sharding_key(space: SpaceDef, conditions: list[Condition]) -> tuple | None:
    """All parts of the sharding key from equalities; an index's values don't replace what is there, a field's do."""
    if space.primary is None:
        return None
    found: dict[str, object] = {}
    for c in conditions:
        if c.operator != "==":
            continue
        if index := space.by_name(c.operand):
            for p, v in zip(index.parts, c.values, strict=False):
                if v is not None:
                    found.setdefault(p.field, v)
        elif space.field(c.operand) and c.values and c.values[0] is not None:
            found[c.operand] = c.values[0]
    key = tuple(found.get(f) for f in space.shard_by)
    return None if any(v is None for v in key) else key


_EXPECT = {
    "unsigned": (int,), "integer": (int,), "number": (int, float, decimal.Decimal), "double": (int, float), "string": (str,), "uuid": (str,), "boolean": (bool,),
    "decimal": (int, float, decimal.Decimal), "datetime": (dt.datetime, dt.date, str),
}


def check_key(space: SpaceDef, index: IndexDef, values: tuple) -> None:
    """Spark would cast a value of another type in silence."""
    if len(values) > len(index.parts):
        raise SelectError(f"Invalid key part count (expected [0..{len(index.parts)}], got {len(values)})")
    for n, (p, v) in enumerate(zip(index.parts, values, strict=False)):
        f = space.field(p.field)
        kind = p.type or ("any" if p.path or f is None else f.type)
        if v is None or kind not in _EXPECT:
            continue
        if not isinstance(v, _EXPECT[kind]) or (isinstance(v, bool) and kind != "boolean"):
            raise SelectError(f"Supplied key type of part {n} does not match index part type: expected {kind}")


def plan(space: SpaceDef, conditions: list[Condition], first: int | None = None, after=None, fields=None, bucket_id: int | None = None) -> SelectPlan:
    if not space.indexes:
        raise NoIndexesError(f'Space "{space.name}" has no indexes, space should have primary index')
    index, scan = scan_index(space, conditions)
    if space.primary is None:
        raise NoIndexesError(f'Space "{space.name}" has no indexes, space should have primary index')
    operator = conditions[scan].operator if scan is not None else ">="
    if scan is not None:
        check_key(space, index, conditions[scan].values)
    key = ordering_key(index, space.primary)
    names = enriched(space, fields, key)
    if first is not None and first < 0 and after is None:
        raise SelectError("Negative first should be specified only with after option")
    backward = first is not None and first < 0
    return SelectPlan(
        space, tuple(conditions), index, None if backward and operator != "==" else scan, operator, operator in DESCENDING, backward, key, names,
        None if first is None else abs(first), after_values(space, key, names, after), None if bucket_id is not None else sharding_key(space, conditions),
    )
