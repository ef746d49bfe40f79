"""Conditions on literal values that reach the file scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def any_of(column: str, values: Iterable) -> Column:
    """Whether a column equals one of the values, as equalities joined in pairs.

    Of a long list of values Spark pushes only the range from the smallest to the largest into
    Parquet; equalities are all pushed, so row groups between wanted values are skipped. The
    pairs keep the condition shallow.
    """
    tests = [F.col(column) == value for value in sorted(values)]
    if not tests:
        return F.lit(False)
    while len(tests) > 1:
        pairs = [a | b for a, b in zip(tests[::2], tests[1::2])]
        tests = pairs + tests[len(tests) - len(tests) % 2 :]
    return tests[0]
