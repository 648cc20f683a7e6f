"""Predicates with index-order semantics: NULL is the smallest value and equals itself.

Only plain comparisons, IS [NOT] NULL, AND and OR are made, never NOT, so three-valued logic cannot
leak and Parquet filters are pushed down.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import COLLATIONS, Part, SpaceDef
from ..errors import GenFiltersError
from ..plans.conditions import Condition
from ..plans.planner import SelectPlan

_STEP = re.compile(r"\[(\d+)\]|\[\s*[\"']([^\"']*)[\"']\s*\]|\.?([A-Za-z_][A-Za-z0-9_]*)")


def path_steps(path: str) -> list[str | int]:
    out, at = [], 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise GenFiltersError(f"Failed to generate filters for specified conditions: bad path {path!r}")
        out.append(int(m[1]) if m[1] else m[2] if m[2] is not None else m[3])
        at = m.end()
    return out


def _variant_type(value) -> str:
    return "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "double"


def reach(column: Column, kind: T.DataType, steps: list[str | int], value, wanted: str | None = None) -> Column:
    """What a path leads to: struct and map members, parts of variants, or of JSON text. A path that leads nowhere is NULL."""
    for n, step in enumerate(steps):
        if isinstance(kind, T.StructType):
            if step not in kind.names:
                return F.lit(None)
            column, kind = column.getField(step), kind[step].dataType
        elif isinstance(kind, T.MapType):
            column, kind = column.getItem(step), kind.valueType
        elif isinstance(kind, T.ArrayType):
            column, kind = F.try_element_at(column, F.lit(step)), kind.elementType
        else:
            rest = "$" + "".join(f"[{s - 1}]" if isinstance(s, int) else f"['{s}']" for s in steps[n:])
            source = column if isinstance(kind, T.VariantType) else F.try_parse_json(column)
            return F.try_variant_get(source, rest, wanted or _variant_type(value))
    return column


class Operand:
    """A column to compare: its expression for a given value, and whether it may be NULL."""

    def __init__(self, space: SpaceDef, part: Part, collated: bool, steps: list[str | int] | None = None):
        self.space, self.part, self.field = space, part, space.field(part.field)
        self.steps = steps if steps is not None else (path_steps(part.path) if part.path else [])
        self.collation = COLLATIONS[part.collation] if collated and part.collation else None
        self.nullable = True if self.steps else space.nullable(part)

    def column(self, value=None) -> Column:
        wanted = {"unsigned": "bigint", "integer": "bigint", "string": "string", "number": "double"}.get(self.part.type or "")
        c = reach(F.col(f"`{self.field.name}`"), self.field.data_type, self.steps, value, wanted) if self.steps else F.col(f"`{self.field.name}`")
        return F.collate(c, self.collation) if self.collation else c

    def _lit(self, value) -> Column:
        if self.field.type == "datetime" and isinstance(value, str):
            return F.lit(value).cast("timestamp_ntz")
        if self.field.type == "decimal" and not self.steps:
            return F.lit(str(value)).cast(self.field.data_type)
        if self.field.type == "uuid":
            return F.lit(str(value).lower())
        return F.lit(value)

    def check(self, value) -> None:
        if self.field.type == "interval" and value is not None:
            raise GenFiltersError("Failed to generate filters for specified conditions: datetime interval conditions are not supported")

    def eq(self, v) -> Column:
        c = self.column(v)
        return c.isNull() if v is None else c == self._lit(v)

    def gt(self, v) -> Column:
        c = self.column(v)
        return c.isNotNull() if v is None else c > self._lit(v)

    def lt(self, v) -> Column:
        if v is None:
            return F.lit(False)
        c = self.column(v)
        return c.isNull() | (c < self._lit(v)) if self.nullable else c < self._lit(v)

    def ge(self, v) -> Column:
        return F.lit(True) if v is None else self.column(v) >= self._lit(v)

    def le(self, v) -> Column:
        c = self.column(v)
        if v is None:
            return c.isNull()
        return c.isNull() | (c <= self._lit(v)) if self.nullable else c <= self._lit(v)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def compare(operator: str, operands: list[Operand], values: tuple) -> Column:
    """Lexicographic comparison of the first len(values) operands."""
    if len(operands) == 1:
        return {"==": operands[0].eq, ">": operands[0].gt, "<": operands[0].lt, ">=": operands[0].ge, "<=": operands[0].le}[operator](values[0])
    equal = [o.eq(v) for o, v in zip(operands, values, strict=True)]
    if operator == "==":
        return _all(equal)
    last = len(operands) - 1
    # each place decides strictly after equal ones before it; the last also takes equality for >= and <=
    ways = []
    for n, (o, v) in enumerate(zip(operands, values, strict=True)):
        at = (o.gt if operator[0] == ">" else o.lt) if n < last or len(operator) == 1 else (o.ge if operator == ">=" else o.le)
        ways.append(_all([*equal[:n], at(v)]))
    return reduce(lambda a, b: a | b, ways)


def resolve(space: SpaceDef, condition: Condition) -> list[Operand]:
    """A residual condition's operands: an index by name keeps its collations, a field by name has none, else a path."""
    if index := space.by_name(condition.operand):
        return [Operand(space, p, collated=True) for p in index.parts[: len(condition.values)]]
    if space.field(condition.operand):
        return [Operand(space, Part(condition.operand), collated=False)]
    steps = path_steps(condition.operand)
    first = steps[0]
    if isinstance(first, int):
        if not 1 <= first <= len(space.fields):
            raise GenFiltersError(f"Failed to generate filters for specified conditions: no field {first}")
        name = space.fields[first - 1].name
    else:
        name = first
    if space.field(name) is None:
        raise GenFiltersError(f'Failed to generate filters for specified conditions: Space format doesn\'t contain field named "{condition.operand}"')
    return [Operand(space, Part(name), collated=False, steps=steps[1:])]


def condition_column(plan: SelectPlan, n: int) -> Column | None:
    c = plan.conditions[n]
    if not c.values:
        return None
    scan = n == plan.scan
    operands = [Operand(plan.space, p, collated=True) for p in plan.index.parts[: len(c.values)]] if scan else resolve(plan.space, c)
    values = c.values[: len(operands)]
    for o, v in zip(operands, values, strict=True):
        o.check(v)
    return compare(c.operator, operands, values)


def filter_column(plan: SelectPlan) -> Column | None:
    """All conditions, and the page's border."""
    parts = [p for n in range(len(plan.conditions)) if (p := condition_column(plan, n)) is not None]
    if plan.after is not None:
        beyond = "<" if plan.descending != plan.backward else ">"
        parts.append(compare(beyond, [Operand(plan.space, p, collated=True) for p in plan.key], plan.after))
    return _all(parts) if parts else None


def order_columns(plan: SelectPlan, reverse: bool = False) -> list[Column]:
    """Ascending puts NULLs first, descending last, as in index order."""
    down = plan.descending != reverse
    columns = [Operand(plan.space, p, collated=True).column() for p in plan.key]
    return [c.desc_nulls_last() if down else c.asc_nulls_first() for c in columns]
