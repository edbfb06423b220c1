"""Small helpers for DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that a running total walks at a time.
STRETCH = 256


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value worked out, and written into the plan, once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _walk(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(op(F.element_at(acc, -1), x)))))


def running(values: Column, op: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """array<bigint> -> its running totals under op. Stretches are walked one by one and then put on each other, so that
    an array of n values costs n times STRETCH steps and not n squared."""

    def together(walked):
        def put(before):
            return F.flatten(F.transform(walked, lambda part, k: F.when(k == 0, part).otherwise(F.transform(part, lambda x: op(F.element_at(before, k), x)))))

        return let(_walk(F.transform(walked, lambda part: F.element_at(part, -1)), op), put)

    def cut(v):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STRETCH).cast("int")), lambda k: F.slice(v, k * STRETCH + 1, F.lit(STRETCH)))
        long = let(F.transform(parts, lambda part: _walk(part, op)), together)
        return F.when(F.size(v) == 0, v).when(F.size(v) <= STRETCH, _walk(v, op)).otherwise(long)

    return let(values, cut)
