"""Filter dictionaries as columns.

{"lang": "en", "n": {"$gte": 3, "$lt": 9}, "source": {"$in": [...]}, "x": {"$ne": 1}}:
all conditions must hold. A missing field equals nothing, and so passes $ne only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


def number_of(value: Any) -> Any:
    """The bound of a range; ValueError if it is no number."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"a range needs a number, not {value!r}")
    return value


def _ranged(compare: Callable[[Column, Any], Column]) -> Callable[[Column, Any], Column]:
    return lambda col, value: F.coalesce(compare(col.try_cast("double"), number_of(value)), F.lit(False))


def _one_of(col: Column, values: Any) -> Column:
    if not isinstance(values, (list, tuple)):
        raise ValueError("$in needs a list")
    return F.coalesce(col.isin(*values), F.lit(False)) if values else F.lit(False)


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": lambda col, v: F.coalesce(col == F.lit(v), F.lit(False)),
    "$ne": lambda col, v: ~col.eqNullSafe(F.lit(v)),
    "$gt": _ranged(lambda c, v: c > v),
    "$gte": _ranged(lambda c, v: c >= v),
    "$lt": _ranged(lambda c, v: c < v),
    "$lte": _ranged(lambda c, v: c <= v),
    "$in": _one_of,
}


def compile_filter(filters: Mapping[str, Any] | None, field: Callable[[str], Column] = F.col, operators: Mapping[str, Callable[[Column, Any], Column]] = OPERATORS) -> Column | None:
    """One boolean column for the filters, None for none; field finds the column of a name, operators compare it.

    Raises ValueError for a bad field name, an unknown operator, a null, a bare
    list or an empty object.
    """
    parts: list[Column] = []
    for name, wanted in (filters or {}).items():
        if not FIELD.fullmatch(name):
            raise ValueError(f"bad field name {name!r}")
        if isinstance(wanted, Mapping):
            if not wanted:
                raise ValueError(f"no condition for {name}")
            conditions = wanted
        elif wanted is None or isinstance(wanted, (list, tuple)):
            raise ValueError(f"bad value for {name}")
        else:
            conditions = {"$eq": wanted}
        for op, value in conditions.items():
            if op not in operators:
                raise ValueError(f"unknown operator {op}")
            parts.append(operators[op](field(name), value))
    return reduce(lambda a, b: a & b, parts) if parts else None


def tenant_filter(filters: Mapping[str, Any] | None, field: str, tenant: str) -> dict[str, Any]:
    """The filters with the tenant's value in its field, whatever the caller gave there."""
    return {**(filters or {}), field: tenant}
