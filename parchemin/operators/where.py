"""Metadata filters given as nested dictionaries, compiled to one Catalyst predicate that reaches the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Comparison of each operator name.
COMPARISONS = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
    "$contains": lambda c, v: F.array_contains(c, v),
}


def compile_where(where: dict | None) -> Column:
    """Predicate of ``{"a": 1}``, ``{"a": {"$in": [..]}}``, ``{"$or": [..]}`` and ``{"$and": [..]}``; none or an empty one keeps all rows.

    As in SQL, a row whose column is null passes no comparison.
    """
    parts = []
    for name, value in (where or {}).items():
        if name in ("$and", "$or"):
            inner = [compile_where(x) for x in value]
            parts.append(reduce(lambda a, b: a & b if name == "$and" else a | b, inner) if inner else F.lit(name == "$and"))
        elif isinstance(value, dict):
            unknown = set(value) - set(COMPARISONS)
            if unknown:
                raise ValueError(f"unknown comparison {sorted(unknown)[0]}")
            parts.extend(COMPARISONS[op](F.col(name), operand) for op, operand in value.items())
        else:
            parts.append(F.col(name) == value)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def tags_or_public(tags: list[str], base: dict | None = None, source: str = "source", internal: str = "ENTREPRISE", column: str = "tags") -> dict:
    """Filter that keeps public rows and those internal ones that have any of the tags, within the base filter."""
    own = {"$or": [{source: {"$ne": internal}}, *({column: {"$contains": tag}} for tag in tags)]}
    return {"$and": [base, own]} if base else own
