"""Comparison of program outputs as Spark columns.

``nan`` equals no number, and ``1_000`` is no number; both are rejected on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, column, stripped

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MODES = ("exact", "token", "float")


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(column(c), SPACE), lambda x: x != "")


def lines(c: Column | str) -> Column:
    body = stripped(F.regexp_replace(column(c), "\r\n", "\n"))
    return F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, rf"{SPACE}$", ""))


def number(token: Column) -> Column:
    return F.when(token.rlike(NUMBER), token.try_cast("double"))


def _close(got: Column, want: Column, tolerance: Column) -> Column:
    a, b = tokens(got), tokens(want)
    near = lambda x, y: (x == y) | F.coalesce(F.abs(number(x) - number(y)) <= tolerance_of(y), F.lit(False))
    tolerance_of = lambda y: tolerance(F.abs(number(y)))
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, near), lambda x: F.coalesce(x, F.lit(False)))


def outputs_equal(got: Column | str, want: Column | str, mode: str = "token", absolute: float = 1e-6, relative: float = 1e-6) -> Column:
    """Whether two outputs agree: by lines, by tokens, or by tokens with numbers within the tolerance of the wanted one."""
    got, want = column(got), column(want)
    if mode == "exact":
        return lines(got) == lines(want)
    if mode == "token":
        return tokens(got) == tokens(want)
    if mode == "float":
        return _close(got, want, lambda size: F.greatest(F.lit(absolute), F.lit(relative) * size))
    raise ValueError(f"unknown comparison mode {mode!r}; expected one of {MODES}")


def outputs_equal_scaled(got: Column | str, want: Column | str, mode: str = "token", tolerance: float = 1e-6) -> Column:
    """The older rule: numbers within the tolerance times the wanted size, at least 1."""
    if mode != "float":
        return tokens(got) == tokens(want)
    return _close(column(got), column(want), lambda size: F.lit(tolerance) * F.greatest(F.lit(1.0), size))


def outputs_equal_by(got: Column | str, want: Column | str, mode: Column | str) -> Column:
    """The mode as a column; an unknown mode raises."""
    m = column(mode)
    chain = F.when(m == "exact", outputs_equal(got, want, "exact")).when(m == "token", outputs_equal(got, want, "token"))
    chain = chain.when(m == "float", outputs_equal(got, want, "float"))
    return chain.otherwise(F.raise_error(F.concat(F.lit("unknown comparison mode "), m)).cast("boolean"))
