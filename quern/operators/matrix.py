"""Matrices as cells (i, j, v), counted from 0, and dense solvers for small ones.

Cell-wise work, products, norms and shapes are joins and aggregates, so they scale with the cells. Elimination,
determinants, inverses and decompositions run on a dense matrix of bounded size inside one task (see dense).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dense matrix has this many cells at most.
DENSE = 4_000_000


def from_rows(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "i int, j int, v double")


def from_arrays(df: DataFrame, row: str, values: str) -> DataFrame:
    return df.select(F.col(row).cast("int").alias("i"), F.posexplode(values).alias("j", "v"))


def create(spark: SparkSession, rows: int, columns: int, value: float = 0.0) -> DataFrame:
    i = spark.range(rows).select(F.col("id").cast("int").alias("i"))
    return i.select("i", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"), F.lit(float(value)).alias("v"))


def vector(n: int, value: float = 0.0) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def to_text(m: DataFrame, places: int = 6) -> DataFrame:
    """One line (i, line) per matrix row, for people."""
    return to_rows(m).select("i", F.array_join(F.transform("row", lambda v: F.format_string(f"%.{places}f", v)), " ").alias("line"))


def to_rows(m: DataFrame) -> DataFrame:
    """One row (i, row) per matrix row."""
    cells = F.array_sort(F.collect_list(F.struct("j", "v")))
    return m.groupBy("i").agg(F.transform(cells, lambda c: c["v"]).alias("row"))


def zipped(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """f of the cells of two matrices of one shape."""
    return a.join(b.withColumnRenamed("v", "w"), ["i", "j"]).select("i", "j", f(F.col("v"), F.col("w")).alias("v"))


def add(a, b):
    return zipped(a, b, lambda x, y: x + y)


def subtract(a, b):
    return zipped(a, b, lambda x, y: x - y)


def hadamard(a, b):
    return zipped(a, b, lambda x, y: x * y)


def inner_product(a, b):
    return hadamard(a, b).agg(F.sum("v").alias("value"))


def mapped(m: DataFrame, f: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """f(v, i, j) in every cell: scale, fill, identity, running sum, Vandermonde and the like."""
    return m.select("i", "j", f(F.col("v"), F.col("i"), F.col("j")).cast("double").alias("v"))


def scale(m, x):
    return mapped(m, lambda v, i, j: v * x)


def identity(m):
    return mapped(m, lambda v, i, j: F.when(i == j, 1.0).otherwise(0.0))


def running_sum(m):
    return mapped(m, lambda v, i, j: F.when(j <= i, 1.0).otherwise(0.0))


def zeroed(m, least=1e-6):
    return mapped(m, lambda v, i, j: F.when(F.abs(v) <= least, 0.0).otherwise(v))


def filled(m, x):
    return mapped(m, lambda v, i, j: F.lit(x))


def random(m, seed=0):
    return m.select("i", "j", F.rand(seed).alias("v"))


def set_cell(m, r, c, f):
    """f(v) in one cell: set, add, subtract, divide."""
    return mapped(m, lambda v, i, j: F.when((i == r) & (j == c), f(v)).otherwise(v))


def set_row(m, r, f):
    """f(v, j) in one row: set, multiply, divide."""
    return mapped(m, lambda v, i, j: F.when(i == r, f(v, j)).otherwise(v))


def fill(m, x, start, end, columns):
    """x in the cells whose flat position is from start to end."""
    return mapped(m, lambda v, i, j: F.when((i * columns + j).between(start, end), F.lit(float(x))).otherwise(v))


def index(i: Column, j: Column, columns: int) -> Column:
    """A cell's flat position."""
    return i * columns + j


def get(m, r, c):
    return m.where((F.col("i") == r) & (F.col("j") == c)).select("v")


def row(m, r):
    """A row as a vector (row)."""
    return to_rows(m.where(F.col("i") == r)).select("row")


def row_cells(m, r):
    return m.where(F.col("i") == r).select("j", "v")


def column_cells(m, c):
    return m.where(F.col("j") == c).select("i", "v")


def reduced(m, f: Callable[[Column, Column], Column], initial: float, r: int | None = None):
    """f(sum so far, cell) folded over all cells, or a row's, in order of rows and columns."""
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "v")))
    m = m if r is None else m.where(F.col("i") == r)
    rows = m.groupBy("i").agg(cells.alias("cells")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "cells"))), lambda s: s["cells"])).alias("cells"))
    return rows.select(F.aggregate("cells", F.lit(float(initial)), lambda s, x: f(s, x["v"])).alias("value"))


def swap_rows(m, a, b):
    return m.select(F.when(F.col("i") == a, b).when(F.col("i") == b, a).otherwise(F.col("i")).alias("i"), "j", "v")


def add_row_to_row(m, a, b, factor):
    source = m.where(F.col("i") == a).select("j", F.col("v").alias("w"))
    return m.join(source, "j", "left").select("i", "j", F.when(F.col("i") == b, F.col("v") + factor * F.col("w")).otherwise(F.col("v")).alias("v"))


def add_row(m, values, keep=None):
    """m with a row below; of more than keep rows the oldest go (a ring of rows)."""
    n = m.agg(F.coalesce(F.max("i") + 1, F.lit(0)).alias("n"))
    new = n.select(F.col("n").alias("i"), F.posexplode(F.array(*map(F.lit, map(float, values)))).alias("j", "v"))
    out = m.unionByName(new)
    if keep is None:
        return out
    out = out.crossJoin(F.broadcast(n)).withColumn("i", F.col("i") - F.greatest(F.lit(0), F.col("n") + 1 - keep)).where("i >= 0")
    return out.select("i", "j", "v")


def sub_matrix(m, r, c, rows, columns):
    return m.where(F.col("i").between(r, r + rows - 1) & F.col("j").between(c, c + columns - 1)).select((F.col("i") - r).alias("i"), (F.col("j") - c).alias("j"), "v")


def overlay(m, block, r, c):
    b = block.select((F.col("i") + r).alias("i"), (F.col("j") + c).alias("j"), F.col("v").alias("w"))
    return m.join(b, ["i", "j"], "left").select("i", "j", F.coalesce("w", "v").alias("v"))


def minor(m, r, c):
    """m without row r and column c."""
    return m.where((F.col("i") != r) & (F.col("j") != c)).select((F.col("i") - (F.col("i") > r).cast("int")).alias("i"), (F.col("j") - (F.col("j") > c).cast("int")).alias("j"), "v")


def reshape(m, columns, new_columns):
    at = F.col("i") * columns + F.col("j")
    return m.select(F.floor(at / new_columns).cast("int").alias("i"), (at % new_columns).cast("int").alias("j"), "v")


def transpose(m):
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def norm(m):
    return m.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("value"))


def trace(m):
    return m.where(F.col("i") == F.col("j")).agg(F.sum("v").alias("value"))


def diagonal(m):
    return m.where(F.col("i") == F.col("j")).select("i", "v")


def row_sum(m, r=None):
    return (m if r is None else m.where(F.col("i") == r)).groupBy("i").agg(F.sum("v").alias("value"))


def column_max(m, absolute=False):
    """Per column, the row and value of the largest cell; of equal ones the first row."""
    size = F.abs(F.col("v")) if absolute else F.col("v")
    best = F.max(F.struct(size.alias("s"), (-F.col("i")).alias("r"), F.col("v").alias("v"))).alias("b")
    return m.groupBy("j").agg(best).select("j", (-F.col("b.r")).alias("i"), F.col("b.v").alias("v"))


def find_in_column(m, c, predicate):
    return m.where((F.col("j") == c) & predicate(F.col("v"))).agg(F.coalesce(F.min("i"), F.lit(-1)).alias("value"))


def find_in_row(m, r, predicate):
    return m.where((F.col("i") == r) & predicate(F.col("v"))).agg(F.coalesce(F.min("j"), F.lit(-1)).alias("value"))


def lower_triangle(m):
    return m.where(F.col("j") <= F.col("i"))


def upper_triangle(m):
    return m.where(F.col("j") >= F.col("i"))


def is_square(m):
    return m.agg((F.max("i") == F.max("j")).alias("value"))


def is_symmetric(m, places=6):
    pairs = zipped(m, transpose(m), lambda x, y: F.abs(x - y))
    return pairs.agg(F.bool_and(F.col("v") <= 10.0**-places).alias("value"))


def nearly(x: Column, y: Column, places: int = 6) -> Column:
    """Whether two values are equal to so many places of their ratio."""
    return (x == y) | F.coalesce(F.round(F.try_divide(y, x), places) == 1, F.lit(False))


def equals_nearly(a, b, places=6):
    cells = a.join(b.withColumnRenamed("v", "w"), ["i", "j"], "full")
    return cells.agg(F.coalesce(F.bool_and(F.coalesce(F.abs(F.col("v") - F.col("w")) <= 10.0**-places * F.greatest(F.lit(1.0), F.abs(F.col("v"))), F.lit(False))), F.lit(True)).alias("value"))


def vandermonde(spark: SparkSession, xs: list[float], columns: int) -> DataFrame:
    x = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    return x.select("i", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"), "x").select("i", "j", F.pow("x", "j").alias("v"))


# --- dense


def dense(m: DataFrame, f: Callable[[np.ndarray], np.ndarray], most: int = DENSE) -> DataFrame:
    """f of the whole matrix in one task; a scalar result is the cell (0, 0). At most most cells, counted before they move."""
    if (n := m.count()) > most:
        raise ValueError(f"matrix of {n} cells is too large for a dense operation")

    def run(t):
        a = np.zeros((int(t["i"].max()) + 1, int(t["j"].max()) + 1))
        a[t["i"], t["j"]] = t["v"]
        out = np.atleast_2d(np.asarray(f(a), float))
        i, j = np.indices(out.shape)
        import pandas as pd

        return pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": out.ravel()})

    return m.groupBy().applyInPandas(run, "i int, j int, v double")


def _square(a: np.ndarray) -> np.ndarray:
    if a.shape[0] != a.shape[1]:
        raise ValueError("matrix is not square")
    return a


def determinant_by_cofactors(a: np.ndarray) -> float:
    a = _square(a)
    if len(a) == 1:
        return float(a[0, 0])
    return sum((-1) ** j * a[0, j] * determinant_by_cofactors(np.delete(a[1:], j, 1)) for j in range(len(a)) if a[0, j])


def adjoint(a: np.ndarray) -> np.ndarray:
    n = len(_square(a))
    signs = (-1.0) ** np.add.outer(np.arange(n), np.arange(n))
    minors = np.array([[np.linalg.det(np.delete(np.delete(a, i, 0), j, 1)) for j in range(n)] for i in range(n)])
    return (signs * minors).T


def inverse(a: np.ndarray) -> np.ndarray:
    return np.linalg.inv(_square(a))


def inverse_by_adjoint(a: np.ndarray) -> np.ndarray:
    det = np.linalg.det(_square(a))
    if abs(det) < 1e-12:
        raise ValueError("determinant is zero")
    return adjoint(a) / det


def echelon(a: np.ndarray, reduced: bool = True, least: float = 1e-9) -> np.ndarray:
    """Row echelon form with pivots 1, by partial pivoting; reduced: zeros above the pivots too."""
    a, r = a.astype(float).copy(), 0
    for c in range(a.shape[1]):
        if r == len(a):
            break
        p = r + int(np.abs(a[r:, c]).argmax())
        if abs(a[p, c]) <= least:
            continue
        a[[r, p]] = a[[p, r]]
        a[r] /= a[r, c]
        rows = np.arange(len(a)) != r if reduced else np.arange(len(a)) > r
        a[rows] -= np.outer(a[rows, c], a[r])
        r += 1
    return a


def forward_elimination(a: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """The augmented matrix [A | b] with zeros below A's diagonal, by partial pivoting; an error for a singular one."""
    a = a.astype(float).copy()
    for c in range(len(a)):
        p = c + int(np.abs(a[c:, c]).argmax())
        if abs(a[p, c]) <= least:
            raise ValueError("matrix is singular")
        a[[c, p]] = a[[p, c]]
        a[c + 1 :] -= np.outer(a[c + 1 :, c] / a[c, c], a[c])
    return a


def backward_substitution(a: np.ndarray) -> np.ndarray:
    """The solution of an upper-triangular augmented matrix, as a row."""
    n = len(a)
    x = np.zeros(n)
    for r in range(n - 1, -1, -1):
        x[r] = (a[r, n] - a[r, r + 1 : n] @ x[r + 1 :]) / a[r, r]
    return x


def solve(a: np.ndarray) -> np.ndarray:
    """The solution of the augmented matrix [A | b], as a row: elimination, then substitution."""
    return backward_substitution(forward_elimination(a))


def determinant_by_echelon(a: np.ndarray) -> float:
    """The product of the pivots, negated for every swap."""
    a, out = _square(a).astype(float).copy(), 1.0
    for c in range(len(a)):
        p = c + int(np.abs(a[c:, c]).argmax())
        if a[p, c] == 0:
            return 0.0
        if p != c:
            a[[c, p]], out = a[[p, c]], -out
        out *= a[c, c]
        a[c + 1 :] -= np.outer(a[c + 1 :, c] / a[c, c], a[c])
    return float(out)


def rank(a: np.ndarray) -> int:
    return int(np.linalg.matrix_rank(a, tol=1e-6))


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doolittle's L and U without pivoting; a pivot under 1e-6 is an error."""
    n = len(_square(a))
    lower, upper = np.eye(n), a.astype(float).copy()
    for k in range(n):
        if abs(upper[k, k]) < 1e-6:
            raise ValueError("zero pivot")
        lower[k + 1 :, k] = upper[k + 1 :, k] / upper[k, k]
        upper[k + 1 :] -= np.outer(lower[k + 1 :, k], upper[k])
    return lower, upper


# --- principal components and singular values: tall data, small columns


def gramian(df: DataFrame, columns: list[str], centred: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X (of deviations from the mean if centred), the means and the rows; columns^2 sums to the driver. Deviations are
    summed in a second pass, so that large means cost no digits."""
    k = len(columns)
    n, *mean = df.agg(F.count(F.lit(1)), *(F.avg(c) for c in columns)).first()
    mean = np.array([m or 0.0 for m in mean], float)
    x = [F.col(c) - F.lit(float(m)) if centred else F.col(c) for c, m in zip(columns, mean)]
    r = df.agg(*(F.sum(a * b) for i, a in enumerate(x) for b in x[i:])).first()
    g = np.zeros((k, k))
    g[np.triu_indices(k)] = [v or 0.0 for v in r]
    return g + np.triu(g, 1).T, mean, n


def deviations(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their means."""
    mean = df.agg(*(F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)))
    return df.crossJoin(F.broadcast(mean)).withColumns({c: F.col(c) - F.col(f"__m{i}") for i, c in enumerate(columns)}).drop(*(f"__m{i}" for i in range(len(columns))))


def covariances(df: DataFrame, columns: list[str], less: int = 1) -> np.ndarray:
    """Deviation scores over the rows less so many: 1 for a sample, 0 for all there is."""
    g, _, n = gramian(df, columns)
    return g / max(n - less, 1)


def principal_components(df: DataFrame, columns: list[str], top: int | None = None, places: int | None = None) -> list[dict]:
    """Eigenvalue (of the sample covariance), vector and explained share, largest first, the top ones if asked; a vector's
    largest entry is positive. Values have so many places if asked."""
    values, vectors = np.linalg.eigh(covariances(df, columns))
    out = []
    shown = (lambda x: float(x)) if places is None else (lambda x: round(float(x), places))
    for k in np.argsort(-values)[:top]:
        v = vectors[:, k] * np.sign(vectors[np.abs(vectors[:, k]).argmax(), k])
        out.append({"eigenvalue": shown(values[k]), "vector": [shown(x) for x in v], "explained": shown(values[k] / values.sum())})
    return out


def project(df: DataFrame, columns: list[str], components: list[dict]) -> DataFrame:
    """df with pc0, pc1, ...: deviations from the column means along each component."""
    mean = df.agg(*(F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)))
    out = df.crossJoin(F.broadcast(mean))
    for k, c in enumerate(components):
        out = out.withColumn(f"pc{k}", sum(((F.col(x) - F.col(f"__m{i}")) * w for i, (x, w) in enumerate(zip(columns, c["vector"]))), F.lit(0.0)))
    return out.drop(*(f"__m{i}" for i in range(len(columns))))


def _factor(df: DataFrame, columns: list[str]) -> np.ndarray:
    """R of X = QR: every task reduces its rows to columns^2 numbers, which reach the driver. Small singular values keep all
    their digits, which X'X halves."""
    k = len(columns)

    def part(batches):
        r = np.zeros((0, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            r = np.linalg.qr(np.vstack((r, x)), mode="r")
        i, j = np.indices(r.shape)
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(r.ravel(), pa.float64())], ["i", "j", "v"])

    def merge(t):
        import pandas as pd

        r = np.linalg.qr(t.pivot(index=["p", "i"], columns="j", values="v").to_numpy(), mode="r")
        i, j = np.indices(r.shape)
        return pd.DataFrame({"g": t["g"].iloc[0], "i": i.ravel(), "j": j.ravel(), "v": r.ravel()})

    parts = df.select(*(F.col(c).cast("double") for c in columns)).na.drop().mapInArrow(part, "i int, j int, v double").select(F.spark_partition_id().alias("p"), (F.spark_partition_id() % 64).alias("g"), "i", "j", "v")
    rows = parts.groupBy("g").applyInPandas(merge, "g int, i int, j int, v double").collect()
    held: dict[tuple, np.ndarray] = {}
    for x in rows:
        held.setdefault((x["g"], x["i"]), np.zeros(k))[x["j"]] = x["v"]
    return np.linalg.qr(np.vstack([held[p] for p in sorted(held)] or [np.zeros((1, k))]), mode="r")


def singular_values(df: DataFrame, columns: list[str]) -> tuple[list[float], list[list[float]]]:
    """Singular values, largest first, and the right singular vectors as rows; a vector's largest entry is positive."""
    _, values, vectors = np.linalg.svd(_factor(df, columns))
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return values.tolist(), (vectors * signs[:, None]).tolist()


def singular_value_decomposition(df: DataFrame, columns: list[str], least: float = 1e-12) -> tuple[DataFrame, list[float], list[list[float]]]:
    """(df with u0, u1, ..., the orthonormal columns; singular values; right singular vectors as rows): X = U S V."""
    values, vectors = singular_values(df, columns)
    scale_ = max(values, default=0.0) * least
    u = {f"u{k}": sum((F.col(c) * w for c, w in zip(columns, v)), F.lit(0.0)) / s if s > scale_ else F.lit(0.0) for k, (s, v) in enumerate(zip(values, vectors))}
    return df.withColumns(u), values, vectors


def reconstruct(df: DataFrame, columns: list[str], components: list[dict], means: list[float]) -> DataFrame:
    """The columns back from pc0, pc1, ... of project(): exact with all components, the best fit with fewer."""
    return df.select(*(sum((F.col(f"pc{k}") * c["vector"][i] for k, c in enumerate(components)), F.lit(means[i])).alias(x) for i, x in enumerate(columns)))
