"""Binding helpers for higher-order expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A lambda that mentions an outer *expression* re-evaluates it for every element; a lambda
    *variable* is evaluated once.  Wrapping the value in a one-element array binds it.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def bisect(n: int, below: Callable[[Column], Column]) -> Column:
    """Number of leading places 0 .. n - 1 at which ``below`` holds (true, then false), in O(log n) lookups."""
    step, steps = 1, []
    while step <= n:
        steps.append(step)
        step *= 2
    if not steps:
        return F.lit(0)

    def advance(at: Column, s: Column) -> Column:
        return F.when((at + s <= n) & below(at + s - 1), at + s).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in reversed(steps)]), F.lit(0), advance)


def binary_search(bounds: Column, n: int, below: Callable[[Column], Column]) -> Column:
    """Number of leading elements of ``bounds`` (sorted, ``n`` of them) for which ``below`` holds."""
    return bisect(n, lambda i: below(F.get(bounds, i)))
