"""Errors carry a class name and a text; batch calls return them as lists, single calls raise them."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of the engine. `class_name` tells the kind, `operation_data` the row of a batch item."""

    def __init__(self, text: str, *, class_name: str | None = None, operation_data=None):
        super().__init__(text)
        self.class_name = class_name or type(self).__name__
        self.text = text
        self.operation_data = operation_data

    def __str__(self) -> str:
        return f"{self.class_name}: {self.text}"

    def about(self, row) -> EngineError:
        self.operation_data = row
        return self


def kind(name: str, *bases: type) -> type[EngineError]:
    return type(name, bases or (EngineError,), {"__module__": __name__})


ParseConditionError = kind("ParseConditionError")
NoIndexesError = kind("NoIndexesError")
IndexTypeError = kind("IndexTypeError")
FilterFieldsError = kind("FilterFieldsError")
GenFiltersError = kind("GenFiltersError")
UnsupportedCollationError = kind("UnsupportedCollationError")
SelectError = kind("SelectError")
GetError = kind("GetError")
CountError = kind("CountError")
LenError = kind("LenError")
BorderError = kind("BorderError")
LocateError = kind("LocateError")
InsertError = kind("InsertError")
InsertManyError = kind("InsertManyError")
ReplaceError = kind("ReplaceError")
ReplaceManyError = kind("ReplaceManyError")
UpdateError = kind("UpdateError")
UpsertError = kind("UpsertError")
UpsertManyError = kind("UpsertManyError")
DeleteError = kind("DeleteError")
TruncateError = kind("TruncateError")
FlattenError = kind("FlattenError")
UnflattenError = kind("UnflattenError")
ParseOperationsError = kind("ParseOperationsError")
NotPerformedError = kind("NotPerformedError")
BucketIDError = kind("BucketIDError")
ShardingKeyError = kind("ShardingKeyError")
ShardingFuncError = kind("ShardingFuncError")
WrongShardingConfigurationError = kind("WrongShardingConfigurationError")
SchemaError = kind("SchemaError")
ReadviewError = kind("ReadviewError")
CfgError = kind("CfgError")
StatsError = kind("StatsError")
CommitConflictError = kind("CommitConflictError")
