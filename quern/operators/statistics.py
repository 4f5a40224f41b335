"""Vector statistics as aggregates and window columns over an ordered column.

Aggregates work on any grouping; window functions take the window's partition and order columns. Warm-up rows of moving
statistics are null unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scan import scan

# --- aggregates


def sum_(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))


def sum_with(f, x: Column) -> Column:
    return F.sum(f(x))


def range_(x: Column) -> Column:
    return F.max(x) - F.min(x)


def sample_variance(x: Column) -> Column:
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def sample_std(x: Column) -> Column:
    return F.sqrt(sample_variance(x))


def summary(x: Column) -> list[Column]:
    """avg, min, max, sum, range, population and sample variance and deviation, skew, median."""
    return [
        F.avg(x).alias("avg"), F.min(x).alias("min"), F.max(x).alias("max"), sum_(x).alias("sum"), range_(x).alias("range"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("std_dev"),
        sample_variance(x).alias("sample_variance"), sample_std(x).alias("sample_std_dev"), F.skewness(x).alias("skew"), F.median(x).alias("median"),
    ]


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r from mergeable sums, so it also runs as a streaming aggregate."""
    both = x.isNotNull() & y.isNotNull()
    x, y = (F.when(both, c.cast("double")) for c in (x, y))
    n, sx, sy = F.count(x), F.sum(x), F.sum(y)
    return F.try_divide(n * F.sum(x * y) - sx * sy, F.sqrt(n * F.sum(x * x) - sx * sx) * F.sqrt(n * F.sum(y * y) - sy * sy))


def pairwise(df: DataFrame, columns: list[str], f, name: str) -> DataFrame:
    """f of every pair of columns, one pass: rows (i, j, value) with i < j."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    one = df.agg(*(f(F.col(columns[i]), F.col(columns[j])).alias(f"p{i}_{j}") for i, j in pairs))
    return one.select(F.inline(F.array(*(F.struct(F.lit(columns[i]).alias("i"), F.lit(columns[j]).alias("j"), F.col(f"p{i}_{j}").alias(name)) for i, j in pairs))))


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    return pairwise(df, columns, F.covar_pop, "covariance")


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    return pairwise(df, columns, F.corr, "correlation")


def autocovariance(df: DataFrame, x: str, order: list[str], lag: int, by: list[str] = ()) -> DataFrame:
    """Sum of (x[i+lag]-mean)(x[i]-mean) / (n-1), and its ratio to that at lag 0, for each group by."""
    if not by:
        df, by = df.withColumn("__all", F.lit(0)), ["__all"]
    w = Window.partitionBy(*by)
    d = df.select(*by, *(c for c in order if c not in by), (F.col(x) - F.avg(x).over(w)).alias("d"))
    d = d.withColumn("e", F.lead("d", lag).over(w.orderBy(*order)))
    out = d.groupBy(*by).agg((F.sum(F.col("d") * F.col("e")) / (F.count("d") - 1)).alias("autocovariance"), F.try_divide(F.sum(F.col("d") * F.col("e")), F.sum(F.col("d") * F.col("d"))).alias("autocorrelation"))
    return out.drop("__all")


# --- window columns; w is ordered


def delta(x: Column, w: WindowSpec) -> Column:
    return x - F.coalesce(F.lag(x).over(w), F.lit(0))


def delta_normalised(x: Column, w: WindowSpec) -> Column:
    before = F.lag(x).over(w)
    return F.try_divide(x - before, before)


def difference(x: Column, w: WindowSpec, lag: int = 1, times: int = 1) -> Column:
    """times-th difference at lag; null where it has no predecessor."""
    signs = [1]
    for _ in range(times):
        signs = [a - b for a, b in zip([*signs, 0], [0, *signs])]
    return reduce(lambda a, b: a + b, ((x if k == 0 else F.lag(x, k * lag).over(w)) * s for k, s in enumerate(signs)))


def second_difference(x: Column, w: WindowSpec) -> Column:
    return F.lag(x).over(w) - 2 * x + F.lead(x).over(w)


def normalize(x: Column, w: WindowSpec) -> Column:
    """(x - mean) / range over the whole partition w, 0 if the range is."""
    r = F.max(x).over(w) - F.min(x).over(w)
    return F.when(r == 0, 0.0).otherwise(F.try_divide(x - F.avg(x).over(w), r))


def min_max(x: Column, w: WindowSpec) -> Column:
    """(x - min) / (max - min) over the whole partition w, 0 if there is no range."""
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(low == high, 0.0).otherwise(F.try_divide(x - low, high - low))


def skew_of_sums(x: Column) -> Column:
    """Skewness from raw moments, (m3 - 3 mean variance - mean^3) / deviation^3, mergeable and so fit for streams."""
    n, mean = F.count(x), F.avg(x)
    variance = F.sum(x * x) / n - mean * mean
    return F.try_divide(F.sum(x * x * x) / n - 3 * mean * variance - F.pow(mean, F.lit(3)), F.pow(variance, F.lit(1.5)))


def standardize(x: Column, w: WindowSpec) -> Column:
    return F.try_divide(x - F.avg(x).over(w), F.stddev_pop(x).over(w))


def moving(f, x: Column, w: WindowSpec, n: int, warm: bool = True) -> Column:
    """f over the last n rows; null until there are n if warm."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(F.lit(1)).over(frame) >= n, f(x).over(frame)) if warm else f(x).over(frame)


def moving_average(x: Column, w: WindowSpec, n: int) -> Column:
    return moving(F.avg, x, w, n)


def cumulative_average(x: Column, w: WindowSpec) -> Column:
    return F.avg(x).over(w.rowsBetween(Window.unboundedPreceding, 0))


def weighted_average(x: Column, w: WindowSpec, n: int) -> Column:
    """Weights n, n-1, ..., 1 from the current row back; missing rows are 0."""
    terms = (F.coalesce(F.lag(x, k).over(w) if k else x, F.lit(0.0)) * (n - k) for k in range(n))
    return reduce(lambda a, b: a + b, terms) / (n * (n + 1) / 2)


def exponential_average(df: DataFrame, x: str, by: list[str], order: list[str], factor: float, out: str = "ema") -> DataFrame:
    """s = factor * x + (1 - factor) * s per key, from the first value on; a null leaves it as it was."""

    def step(state: list, v: float | None) -> tuple:
        if v is not None:
            state[0] = v if state[0] is None else factor * v + (1 - factor) * state[0]
        return (state[0],)

    return scan(df, by, order, [x], lambda: [None], step, [out])


# --- points


def distance(a: Column, b: Column, columns: list[int] | None = None) -> Column:
    """Euclidean distance of arrays, of some positions only if given (0 of none); NaN for empty ones; an error for different
    lengths."""
    if columns is not None:
        return F.sqrt(reduce(lambda s, i: s + (F.get(a, F.lit(i)) - F.get(b, F.lit(i))) * (F.get(a, F.lit(i)) - F.get(b, F.lit(i))), columns, F.lit(0.0)))
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("points have different lengths"))).when(F.size(a) == 0, F.lit(float("nan"))).otherwise(F.sqrt(squares))


def distances(points: DataFrame, id_col: str, point: str, extreme: str | None = None, columns: list[int] | None = None) -> DataFrame:
    """Distances of all pairs (i < j), or those tying for the min or max, with their points. The number of pairs is the
    result's own size; for an extreme every task keeps only its own ties, so pairs are made once and never collected."""
    a = points.select(F.col(id_col).alias("i"), F.col(point).cast("array<double>").alias("p"))
    b = points.select(F.col(id_col).alias("j"), F.col(point).cast("array<double>").alias("q"))
    d = a.join(b, F.col("i") < F.col("j")).select("i", "j", distance(F.col("p"), F.col("q"), columns).alias("distance"), "p", "q")
    if not extreme:
        return d.select("i", "j", "distance")
    better = min if extreme == "min" else max

    def ties(batches):
        best, held = None, []
        for batch in batches:
            values = [v for v in batch.column("distance").to_pylist() if v is not None and v == v]
            if not values:
                continue
            here = better(values)
            if best is None or (here != best and better(here, best) == here):
                best, held = here, []
            if here == best:
                held.append(batch.filter(pc.equal(batch.column("distance"), best)))
        yield from held

    return d.mapInArrow(ties, d.schema).repartition(1).mapInArrow(ties, d.schema)


def farthest(v: Column) -> Column:
    """The largest entry of an array of arrays."""
    return F.array_max(F.flatten(v))


def pearson_results(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a pair of columns: i, j, r, the points that both have, and their sums, from which r can be carried on."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    made = []
    for a, b in pairs:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
        made.append(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), pearson(F.col(a), F.col(b)).alias("r"), F.count(x).alias("n"), F.sum(x).alias("sum_i"), F.sum(y).alias("sum_j"), F.sum(x * y).alias("sum_ij")).alias(f"{a}~{b}"))
    return df.agg(*made).select(F.inline(F.array(*(F.col(f"`{a}~{b}`") for a, b in pairs))))
