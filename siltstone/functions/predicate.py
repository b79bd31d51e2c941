"""Compiles the JSON filter language to a Column.

Leaves are equality or ``$eq $ne $gt $gte $lt $lte $in $nin``; ``$and`` and ``$or`` nest.
A null never satisfies an ordering or ``$in``, but does satisfy ``$ne`` and ``$nin``.  Several
keys are joined by and; beside ``$and`` or ``$or`` they are ignored; unknown operators too.
The result never is null, so that it may be negated; it is spelled so that scans can use it.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def compile_filter(condition: dict | str | None) -> Column:
    """The Column of a filter; everything passes an empty one."""
    if isinstance(condition, str):
        condition = json.loads(condition)
    if not condition:
        return F.lit(True)
    for key, join, start in (("$and", and_, True), ("$or", or_, False)):
        if key in condition:
            return reduce(join, map(compile_filter, condition[key]), F.lit(start))
    return reduce(and_, (_leaf(F.col(f"`{k}`"), v) for k, v in condition.items()), F.lit(True))


def compile_equalities(condition: dict | None) -> Column:
    """The plainer filter of evaluations: ``$and`` and ``$or`` nest, everything else is equality, other ``$`` keys are ignored."""
    condition = condition or {}
    for key, join, start in (("$and", and_, True), ("$or", or_, False)):
        if key in condition:
            return reduce(join, map(compile_equalities, condition[key]), F.lit(start))
    return reduce(and_, (F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in condition.items() if not k.startswith("$")), F.lit(True))


def _leaf(c: Column, value) -> Column:
    if not isinstance(value, dict):
        return c.eqNullSafe(F.lit(value))
    tests = {
        "$eq": lambda v: c.eqNullSafe(F.lit(v)),
        "$ne": lambda v: ~c.eqNullSafe(F.lit(v)),
        "$gt": lambda v: c.isNotNull() & (c > v),
        "$gte": lambda v: c.isNotNull() & (c >= v),
        "$lt": lambda v: c.isNotNull() & (c < v),
        "$lte": lambda v: c.isNotNull() & (c <= v),
        "$in": lambda v: c.isNotNull() & c.isin(list(v)),
        "$nin": lambda v: c.isNull() | ~c.isin(list(v)),
    }
    return reduce(and_, (tests[k](v) for k, v in value.items() if k in tests), F.lit(True))


def one_of(**choices: list) -> dict:
    """A filter from lists of choices, as a form gives them: an empty list does not filter."""
    parts = [{k: v[0]} if len(v) == 1 else {k: {"$in": list(v)}} for k, v in choices.items() if v]
    return {} if not parts else parts[0] if len(parts) == 1 else {"$and": parts}


def route_question(category: Column, benchmark: Column, countries: Column, source: str = "benchmark") -> Column:
    """The filter column and value that a question implies, as struct(field, value), or null; ``source`` is the benchmark's."""
    none = F.lit(None).cast("struct<field:string,value:string>")
    return (
        F.when(category == "comparative", none)
        .when(benchmark & (F.size(countries) == 0), F.struct(F.lit("source").alias("field"), F.lit(source).alias("value")))
        .when(F.size(countries) == 1, F.struct(F.lit("country").alias("field"), countries[0].alias("value")))
    )


def key_of(route: Column) -> Column:
    """A route as one key ``field=value``, null where it is null."""
    return F.concat(route["field"], F.lit("="), route["value"])


def keys_of(**columns: Column) -> Column:
    """The keys that a row answers to: one for each field whose column is not null."""
    return F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in columns.items()]))
