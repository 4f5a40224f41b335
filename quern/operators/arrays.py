"""Array columns as vectors: ranges of them, differences, pairs and moves. Positions count from 0, ends are inclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _range(a: Column, start: int, end: int | None) -> Column:
    return F.slice(a, start + 1, F.size(a) - start if end is None else F.lit(end - start + 1))


def reduce_range(a: Column, f: Callable[[Column, Column], Column], initial: float = 0.0, start: int = 0, end: int | None = None) -> Column:
    """f folded over a range; backwards if start > end."""
    part = F.reverse(_range(a, end, start)) if end is not None and start > end else _range(a, start, end)
    return F.aggregate(part, F.lit(float(initial)), f)


def array_sum(a: Column, start: int = 0, end: int | None = None, initial: float = 0.0) -> Column:
    return reduce_range(a, lambda s, x: s + x, initial, start, end)


def average(a: Column, start: int = 0, end: int | None = None) -> Column:
    """Sum of the range divided by the length of the whole array."""
    return F.try_divide(array_sum(a, start, end), F.size(a))


def sum_squared(a: Column, start: int = 0, end: int | None = None) -> Column:
    return reduce_range(a, lambda s, x: s + x * x, 0.0, start, end)


def product(a: Column, start: int = 0, end: int | None = None) -> Column:
    return reduce_range(a, lambda s, x: s * x, 1.0, start, end)


def scale(a: Column, factor: float, start: int = 0, end: int | None = None) -> Column:
    last = F.size(a) if end is None else F.lit(end)
    return F.transform(a, lambda x, i: F.when((i >= start) & (i <= last), x * factor).otherwise(x))


def difference(a: Column, lag: int = 1) -> Column:
    """a[i + lag] - a[i]; lag entries fewer."""
    n = F.size(a) - lag
    return F.when(n <= 0, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(a, lag + 1, F.greatest(n, F.lit(0))), F.slice(a, 1, F.greatest(n, F.lit(0))), lambda x, y: x - y))


def nth_difference(a: Column, order: int, lag: int = 1) -> Column:
    for _ in range(order):
        a = difference(a, lag)
    return a


def second_difference(a: Column, lag: int = 1) -> Column:
    return nth_difference(a, 2, lag)


def pairs(a: Column) -> Column:
    """All pairs (x, y) of entries, the first before the second."""
    return F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.size(a)), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def swap(a: Column, i: int, j: int) -> Column:
    return F.transform(a, lambda x, k: F.when(k == i, F.get(a, F.lit(j))).when(k == j, F.get(a, F.lit(i))).otherwise(x))


def all_rows_swap(rows: Column, i: int, j: int) -> Column:
    """Columns i and j of an array of rows, swapped in every row."""
    return F.transform(rows, lambda r: swap(r, i, j))


def map_range(a: Column, f: Callable[[Column, Column], Column], start: int = 0, end: int | None = None) -> Column:
    """f(entry, position) of a range, backwards if start > end; an error for a range beyond the array."""
    whole = F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    part = F.reverse(_range(whole, end, start)) if end is not None and start > end else _range(whole, start, end)
    ends = [start] if end is None else [start, end]
    outside = F.lit(min(ends) < 0) | (F.size(a) <= max(ends))
    return F.when(outside, F.raise_error(F.lit("range beyond the array"))).otherwise(F.transform(part, lambda s: f(s["x"], s["i"])))


def nested(a: Column, depth: int, only: dict[int, list[int]] | None = None, level: int = 0) -> Column:
    """Entries of nested arrays, depth levels in all, in order; at a level in only, those at the positions it lists."""
    some = (only or {}).get(level)
    if some is not None:
        a = F.filter(a, lambda _, i: i.isin(*some))
    return a if level == depth - 1 else F.flatten(F.transform(a, lambda x: nested(x, depth, only, level + 1)))


def overlay(a: Column, b: Column, at: int = 0) -> Column:
    return F.transform(a, lambda x, k: F.coalesce(F.get(b, k - at), x))


def move(a: Column, start: int, end: int) -> Column:
    rest = F.filter(a, lambda x, k: k != start)
    return F.concat(F.slice(rest, 1, end), F.array(F.get(a, F.lit(start))), F.slice(rest, end + 1, F.size(a)))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def random(n: int, seed: int = 0) -> Column:
    return F.array(*(F.rand(seed + k) for k in range(n)))


def equals_nearly(a: Column, b: Column, places: int = 6) -> Column:
    same = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 10.0**-places * F.greatest(F.lit(1.0), F.abs(x))), lambda x: F.coalesce(x, F.lit(False)))
    return (F.size(a) == F.size(b)) & same


def find_sorted(a: Column, x: Column) -> Column:
    """Position of x in a sorted array, else minus the place where it would go in, minus 1."""
    below = F.size(F.filter(a, lambda y: y < x))
    return F.when(F.array_contains(a, x), below).otherwise(-below - 1)


def add_sorted(a: Column, x: Column) -> Column:
    return F.array_sort(F.array_append(a, x))


def median_as_given(a: Column) -> Column:
    """The middle entry, or the mean of the two middle ones, in the order given."""
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2
