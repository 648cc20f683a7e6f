"""Reads as lazy DataFrames: filter, order, limit, select."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..catalog import IndexDef, SpaceDef
from ..errors import BorderError, GetError
from ..functions.predicates import Operand, compare, filter_column, order_columns
from ..plans.planner import SelectPlan, ordering_key
from .results import Result, metadata_of


def filtered(plan: SelectPlan, df: DataFrame) -> DataFrame:
    wanted = filter_column(plan)
    return df if wanted is None else df.filter(wanted)


def run_select(plan: SelectPlan, df: DataFrame, ordered: bool = True, seen: Observation | None = None) -> DataFrame:
    """Rows in index order. A page before `after` is taken from its end, then turned round. seen: gets the number `n` of rows that the filters let through."""
    out = filtered(plan, df)
    if seen is not None:
        out = out.observe(seen, F.count(F.lit(1)).alias("n"))
    if plan.limit is not None:
        out = out.orderBy(*order_columns(plan, reverse=plan.backward)).limit(plan.limit)
        if plan.backward:
            out = out.orderBy(*order_columns(plan))
    elif ordered:
        out = out.orderBy(*order_columns(plan, reverse=plan.backward))
    names = plan.fields if plan.fields is not None else plan.space.names
    return out.select(*[F.col(f"`{n}`") for n in names])


def run_count(plan: SelectPlan, df: DataFrame) -> DataFrame:
    """One row `cnt`; nothing is sorted."""
    return filtered(plan, df).agg(F.count(F.lit(1)).alias("cnt"))


def run_get(space: SpaceDef, df: DataFrame, key: tuple, fields=None) -> DataFrame:
    parts = space.primary.parts
    if len(key) != len(parts):
        raise GetError(f"Invalid key part count in an exact match (expected {len(parts)}, got {len(key)})")
    metadata_of(space, fields)
    here = compare("==", [Operand(space, p, collated=True) for p in parts], key)
    return df.filter(here).limit(1).select(*[F.col(f"`{n}`") for n in (fields if fields is not None else space.names)])


def border_index(space: SpaceDef, index: str | int | None) -> IndexDef:
    if index is None:
        return space.primary
    found = space.indexes.get(index) if isinstance(index, int) else space.by_name(index)
    if found is None:
        raise BorderError(f'Index "{index}" of space "{space.name}" doesn\'t exist')
    return found


def run_border(space: SpaceDef, df: DataFrame, index: IndexDef, largest: bool, fields=None) -> DataFrame:
    """The row at one end of an index, NULL keys included; of equal keys the smallest or largest primary key."""
    metadata_of(space, fields)
    columns = [Operand(space, p, collated=True).column() for p in ordering_key(index, space.primary)]
    order = [c.desc_nulls_last() if largest else c.asc_nulls_first() for c in columns]
    return df.orderBy(*order).limit(1).select(*[F.col(f"`{n}`") for n in (fields if fields is not None else space.names)])


def result(space: SpaceDef, df: DataFrame, fields) -> Result:
    return Result(metadata_of(space, fields), df)
