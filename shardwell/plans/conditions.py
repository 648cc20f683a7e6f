"""Conditions as users write them: (operator, operand) or (operator, operand, value)."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ParseConditionError


class _Missing:
    """No value given, which is not the same as None."""

    _one = None

    def __new__(cls):
        cls._one = cls._one or super().__new__(cls)
        return cls._one

    def __repr__(self) -> str:
        return "MISSING"

    def __bool__(self) -> bool:
        return False


MISSING = _Missing()
OPERATORS = {"=": "==", "==": "==", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
DESCENDING = frozenset({"<", "<="})


@dataclass(frozen=True)
class Condition:
    operator: str
    operand: str
    values: tuple  # empty: MISSING


def _kind(x) -> str:
    return "nil" if x is None else {"bool": "boolean", "int": "number", "float": "number", "str": "string"}.get(type(x).__name__, type(x).__name__)


def parse(conditions) -> list[Condition]:
    if conditions is None:
        return []
    if not isinstance(conditions, (list, tuple)):
        raise ParseConditionError(f'Conditions should be table, got "{_kind(conditions)}"')
    out = []
    for n, c in enumerate(conditions, 1):
        if not isinstance(c, (list, tuple)):
            raise ParseConditionError(f'Each condition should be table, got "{_kind(c)}" (condition {n})')
        if len(c) not in (2, 3):
            raise ParseConditionError(f'Each condition should be {{"<operator>", "<operand>", <value>}} (condition {n})')
        operator, operand = c[:2]
        if not isinstance(operator, str):
            raise ParseConditionError(f'condition[1] should be string, got "{_kind(operator)}" (condition {n})')
        if operator not in OPERATORS:
            raise ParseConditionError(f'condition[1] "{operator}" isn\'t a valid condition operator, (condition {n})')
        if not isinstance(operand, str):
            raise ParseConditionError(f'condition[2] should be string, got "{_kind(operand)}" (condition {n})')
        value = c[2] if len(c) == 3 else MISSING
        values = () if value is MISSING else tuple(value) if isinstance(value, (list, tuple)) else (value,)
        while values and values[-1] is MISSING:
            values = values[:-1]
        out.append(Condition(OPERATORS[operator], operand, values))
    return out
