"""Leaves of the filter tree as Spark columns: the same rules for filter, where, having and scope."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.errors import InvalidQueryError
from quern.functions.text import matches
from quern.plans.language import Leaf

_DAY = re.compile(r"\d{4}-\d\d-\d\d\Z")
_COMPARE = {"eq": "__eq__", "neq": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def _moment(value: Any, on: str) -> datetime:
    try:
        if isinstance(value, datetime):
            when = value
        elif isinstance(value, date):
            when = datetime(value.year, value.month, value.day)
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            when = datetime.fromtimestamp(value / 1000, UTC)
        else:
            when = datetime.fromisoformat(str(value))
    except (ValueError, OverflowError):
        raise InvalidQueryError(f"filter: {value!r} is no date on {on}") from None
    return when.astimezone(UTC).replace(tzinfo=None) if when.tzinfo else when


def coerce(value: Any, kind: str, on: str) -> Any:
    """A literal of the field's type; what can't be one is refused here, before Spark would fail on it."""
    if isinstance(value, (list, tuple)):
        return [coerce(x, kind, on) for x in value]
    if value is None:
        return None
    if kind in ("datetime", "date"):
        return _moment(value, on)
    if kind in ("number", "integer"):
        if isinstance(value, bool):
            return int(value)
        if isinstance(value, str):
            try:
                return int(value) if re.fullmatch(r"[+-]?\d+", value.strip()) else float(value)
            except ValueError:
                raise InvalidQueryError(f"filter: {value!r} is no number on {on}") from None
        return value
    if kind == "boolean":
        if str(value).lower() in ("true", "1"):
            return True
        if str(value).lower() in ("false", "0"):
            return False
        raise InvalidQueryError(f"filter: {value!r} is no truth value on {on}")
    return value if isinstance(value, str) or kind not in ("string", "enum", "uuid", "json") else str(value)


def literal(value: Any, kind: str) -> Column:
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def condition(column: Column, leaf: Leaf, kind: str, *, whole_days: bool) -> Column:
    """The leaf on a column of a field type. ``whole_days``: a bare date on a datetime means the whole day."""
    op, value, on = leaf.op, leaf.value, leaf.on
    if op in ("is_null", "is_not_null"):
        return column.isNull() if op == "is_null" else column.isNotNull()
    if kind == "vector":
        raise InvalidQueryError(f"filter: {op} doesn't apply to the vector {on}")
    if op in ("contains", "startswith", "endswith", "matches"):
        if kind in ("number", "integer", "boolean", "datetime", "date"):
            raise InvalidQueryError(f"filter: {op} applies to text; {on} is {kind}")
        if op == "matches":
            return matches(column, str(value))
        text = str(value).replace("\\", "\\\\")
        return column.ilike({"contains": f"%{text}%", "startswith": f"{text}%", "endswith": f"%{text}"}[op])
    if kind == "datetime":
        column = column.cast("timestamp_ntz")
        if whole_days and isinstance(value, str) and _DAY.match(value) and op in _COMPARE:
            begin = _moment(value, on)
            end = begin + timedelta(days=1)
            begin, end = literal(begin, kind), literal(end, kind)
            return {"eq": (column >= begin) & (column < end), "neq": (column < begin) | (column >= end), "gt": column >= end, "gte": column >= begin, "lt": column < begin, "lte": column < end}[op]
    value = coerce(value, kind, on)
    if op in ("in", "nin"):
        if not value:
            return F.lit(op == "nin")
        found = column.isin([literal(x, kind) for x in value]) if len(value) else F.lit(False)
        return found if op == "in" else ~found
    if op == "between":
        return column.between(literal(value[0], kind), literal(value[1], kind))
    if op in _COMPARE:
        return getattr(column, _COMPARE[op])(literal(value, kind))
    raise InvalidQueryError(f"filter: {op} isn't allowed here")
