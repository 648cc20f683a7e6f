"""Sharded tables on Spark behind one set of calls."""

from .catalog import Catalog, FieldDef, IndexDef, Part, SpaceDef
from .engine import Engine, ReadView, __version__
from .operators.results import Result
from .plans.conditions import MISSING

__all__ = ["MISSING", "Catalog", "Engine", "FieldDef", "IndexDef", "Part", "ReadView", "Result", "SpaceDef", "__version__"]
