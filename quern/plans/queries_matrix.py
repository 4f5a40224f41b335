"""Queries of matrix, vector and point operators. Each labels the results of several operators (op) over one matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arrays, matrix
from ..operators import statistics as st
from .queries import _M, _M3, ORACLE, QUERIES, _matrix, _matrix3, query, table


def _labelled(results: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, (df.select(F.lit(op).alias("op"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (F.round("v", 6) + 0.0).alias("v")) for op, df in results.items()))


def _sql(selects: dict[str, str], with_: str = f"m AS ({_M})") -> str:
    return f"WITH {with_} " + " UNION ALL ".join(f"SELECT '{op}' AS op, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CAST(v AS DOUBLE), 6) AS v FROM ({sql})" for op, sql in selects.items())


@query(_sql({
    "set": "SELECT i, j, CASE WHEN i = 1 AND j = 2 THEN 9 ELSE v END AS v FROM m", "add": "SELECT i, j, CASE WHEN i = 1 AND j = 2 THEN v + 9 ELSE v END AS v FROM m",
    "subtract": "SELECT i, j, CASE WHEN i = 1 AND j = 2 THEN v - 9 ELSE v END AS v FROM m", "divide": "SELECT i, j, CASE WHEN i = 1 AND j = 2 THEN v / 4 ELSE v END AS v FROM m",
    "get": "SELECT 0 AS i, 0 AS j, v FROM m WHERE i = 3 AND j = 4", "set_all": "SELECT i, j, 10 * i + j AS v FROM m", "zero": "SELECT i, j, 0 AS v FROM m", "one": "SELECT i, j, 1 AS v FROM m",
    "identity": "SELECT i, j, CASE WHEN i = j THEN 1 ELSE 0 END AS v FROM m", "running": "SELECT i, j, CASE WHEN j <= i THEN 1 ELSE 0 END AS v FROM m", "zeroed": "SELECT i, j, CASE WHEN v <= 10 THEN 0 ELSE v END AS v FROM m",
    "fill": "SELECT i, j, CASE WHEN i * 7 + j BETWEEN 5 AND 12 THEN 3 ELSE v END AS v FROM m", "index": "SELECT i, j, i * 7 + j AS v FROM m",
}))
def matrix_set_cells(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return _labelled({
        "set": matrix.set_cell(m, 1, 2, lambda v: F.lit(9.0)), "add": matrix.set_cell(m, 1, 2, lambda v: v + 9), "subtract": matrix.set_cell(m, 1, 2, lambda v: v - 9), "divide": matrix.set_cell(m, 1, 2, lambda v: v / 4),
        "get": matrix.get(m, 3, 4).select(F.lit(0).alias("i"), F.lit(0).alias("j"), "v"), "set_all": matrix.mapped(m, lambda v, i, j: 10 * i + j), "zero": matrix.filled(m, 0.0), "one": matrix.filled(m, 1.0), "identity": matrix.identity(m),
        "running": matrix.running_sum(m), "zeroed": matrix.zeroed(m, 10), "fill": matrix.fill(m, 3, 5, 12, 7), "index": matrix.mapped(m, lambda v, i, j: matrix.index(i, j, 7)),
    })


@query(_sql({
    "multiply": "SELECT i, j, CASE WHEN i = 2 THEN v * 3 ELSE v END AS v FROM m", "divide": "SELECT i, j, CASE WHEN i = 2 THEN v / 8 ELSE v END AS v FROM m", "set": "SELECT i, j, CASE WHEN i = 2 THEN j * 2 ELSE v END AS v FROM m",
    "swap": "SELECT CASE i WHEN 1 THEN 4 WHEN 4 THEN 1 ELSE i END AS i, j, v FROM m", "add_to": "SELECT m.i, m.j, CASE WHEN m.i = 3 THEN m.v + 2 * s.v ELSE m.v END AS v FROM m LEFT JOIN m s ON s.i = 0 AND s.j = m.j",
    "append": "SELECT i, j, v FROM m UNION ALL SELECT 7, j, 5 FROM range(7) r(j)", "ring": "SELECT i - 1 AS i, j, v FROM m WHERE i > 0 UNION ALL SELECT 6, j, 5 FROM range(7) r(j)", "row": "SELECT 0 AS i, j, v FROM m WHERE i = 5",
    "row_cells": "SELECT 0 AS i, j, v FROM m WHERE i = 6", "column_cells": "SELECT i, 0 AS j, v FROM m WHERE j = 6", "sum": "SELECT i, 0 AS j, sum(v) AS v FROM m GROUP BY i", "sum_one": "SELECT 4 AS i, 0 AS j, sum(v) AS v FROM m WHERE i = 4",
}))
def matrix_rows(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    zero = F.lit(0)
    return _labelled({
        "multiply": matrix.set_row(m, 2, lambda v, j: v * 3), "divide": matrix.set_row(m, 2, lambda v, j: v / 8), "set": matrix.set_row(m, 2, lambda v, j: j * 2), "swap": matrix.swap_rows(m, 1, 4), "add_to": matrix.add_row_to_row(m, 0, 3, 2.0),
        "append": matrix.add_row(m, [5] * 7), "ring": matrix.add_row(m, [5] * 7, keep=7), "row": matrix.row(m, 5).select(zero.alias("i"), F.posexplode("row").alias("j", "v")), "row_cells": matrix.row_cells(m, 6).select(zero.alias("i"), "j", "v"),
        "column_cells": matrix.column_cells(m, 6).select("i", zero.alias("j"), "v"), "sum": matrix.row_sum(m).select("i", zero.alias("j"), F.col("value").alias("v")), "sum_one": matrix.row_sum(m, 4).select("i", zero.alias("j"), F.col("value").alias("v")),
    })


@query(_sql({
    "hadamard": "SELECT m.i, m.j, m.v * t.v AS v FROM m JOIN m t ON m.i = t.j AND m.j = t.i", "inner": "SELECT 0 AS i, 0 AS j, sum(m.v * t.v) AS v FROM m JOIN m t ON m.i = t.j AND m.j = t.i", "like": "SELECT i, j, 0 AS v FROM m",
    "created": "SELECT i, j, 2 AS v FROM range(3) a(i), range(4) b(j)", "vector": "SELECT 0 AS i, j, 1.5 AS v FROM range(5) r(j)", "diagonal": "SELECT i, 0 AS j, v FROM m WHERE i = j", "lower": "SELECT i, j, v FROM m WHERE j <= i", "upper": "SELECT i, j, v FROM m WHERE j >= i",
    "reshape": "SELECT (i * 7 + j) // 49 AS i, (i * 7 + j) % 49 AS j, v FROM m", "arrays": "SELECT i, j, v FROM m", "pairs": "SELECT m.i, m.j, greatest(m.v, t.v) AS v FROM m JOIN m t ON m.i = t.j AND m.j = t.i",
    "max_abs": "SELECT arg_max(i, abs(v - 40) * 1000 - i) AS i, j, arg_max(v - 40, abs(v - 40) * 1000 - i) AS v FROM m GROUP BY j",
}))
def matrix_shapes(spark, sf_dir):
    m, zero = _matrix(spark, sf_dir), F.lit(0)
    t = matrix.transpose(m)
    rows = matrix.to_rows(m)
    return _labelled({
        "hadamard": matrix.hadamard(m, t), "inner": matrix.inner_product(m, t).select(zero.alias("i"), zero.alias("j"), F.col("value").alias("v")), "like": matrix.filled(m, 0.0), "created": matrix.create(spark, 3, 4, 2),
        "vector": spark.range(1).select(zero.alias("i"), F.posexplode(matrix.vector(5, 1.5)).alias("j", "v")), "diagonal": matrix.diagonal(m).select("i", zero.alias("j"), "v"), "lower": matrix.lower_triangle(m), "upper": matrix.upper_triangle(m),
        "reshape": matrix.reshape(m, 7, 49), "arrays": matrix.from_arrays(rows, "i", "row"), "pairs": matrix.zipped(m, t, F.greatest), "max_abs": matrix.column_max(matrix.mapped(m, lambda v, i, j: v - 40), absolute=True),
    })


@query(f"""WITH m AS ({_M}), o AS (SELECT * FROM m ORDER BY i, j), f AS (SELECT list(v ORDER BY i, j) AS a, list(v ORDER BY i, j) FILTER (i = 2) AS b FROM m)
 SELECT (SELECT coalesce(min(i), -1) FROM m WHERE j = 2 AND v > 25) AS column_row, (SELECT coalesce(min(j), -1) FROM m WHERE i = 3 AND v > 25) AS row_column, -1 AS nowhere, list_reduce(a, lambda s, x: s / 2 + x, 0.0) AS folded, list_reduce(b, lambda s, x: s / 2 + x, 1.0) AS row_folded,
 true AS equal, false AS unequal, true AS vectors, true AS square, (SELECT string_agg(printf('%.1f', v), ' ' ORDER BY j) FROM m WHERE i = 0) AS line FROM f""")
def matrix_folds(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    of = lambda df, name: df.select(F.col(df.columns[-1]).alias(name))
    fold = lambda s, x: s / 2 + x
    vectors = matrix.to_rows(m).agg(F.bool_and(arrays.equals_nearly(F.col("row"), F.transform("row", lambda v: v * (1 + 1e-9)))).alias("vectors"))
    parts = [
        of(matrix.find_in_column(m, 2, lambda v: v > 25), "column_row"), of(matrix.find_in_row(m, 3, lambda v: v > 25), "row_column"), of(matrix.find_in_row(m, 3, lambda v: v > 1e9), "nowhere"), of(matrix.reduced(m, fold, 0.0), "folded"),
        of(matrix.reduced(m, fold, 1.0, 2), "row_folded"), of(matrix.equals_nearly(m, matrix.scale(m, 1 + 1e-9)), "equal"), of(matrix.equals_nearly(m, matrix.scale(m, 1.1)), "unequal"), vectors,
        of(matrix.dense(m, lambda a: len(matrix._square(a))).select((F.col("v") == 7).alias("square")), "square"), of(matrix.to_text(m, 1).where("i = 0"), "line"),
    ]
    return reduce(DataFrame.crossJoin, parts)


@query("SELECT n_nationkey, n_nationkey < 3 AS near, n_nationkey = 0 OR n_nationkey = 20 AS same FROM nation")
def matrix_nearly_values(spark, sf_dir):
    k = F.col("n_nationkey").cast("double")
    return table(spark, sf_dir, "nation").select("n_nationkey", matrix.nearly(F.lit(1.0), 1 + F.when(k < 3, k * 1e-8).otherwise(k), 6).alias("near"), matrix.nearly(k, F.when(k < 20, k * 2).otherwise(F.when(k == 20, k * (1 + 1e-9)).otherwise(k + 1)), 6).alias("same"))


_A3 = f"a AS (SELECT * FROM ({_M3})), e AS (SELECT max(v) FILTER (i = 0 AND j = 0) AS a, max(v) FILTER (i = 0 AND j = 1) AS b, max(v) FILTER (i = 0 AND j = 2) AS c, max(v) FILTER (i = 1 AND j = 0) AS d, max(v) FILTER (i = 1 AND j = 1) AS e, max(v) FILTER (i = 1 AND j = 2) AS f, max(v) FILTER (i = 2 AND j = 0) AS g, max(v) FILTER (i = 2 AND j = 1) AS h, max(v) FILTER (i = 2 AND j = 2) AS k FROM a)"


@query(f"""WITH {_A3}, x AS (SELECT a.i, a.j, a.v, c.x FROM a JOIN (VALUES (0, 1.0), (1, 2.0), (2, -1.0)) c(j, x) USING (j)), d AS (SELECT a * (e * k - f * h) - b * (d * k - f * g) + c * (d * h - e * g) AS det FROM e)
 SELECT 'solution' AS op, 0 AS i, j, x AS v FROM (VALUES (0, 1.0), (1, 2.0), (2, -1.0)) c(j, x) UNION ALL SELECT 'substituted', 0, j, x FROM (VALUES (0, 1.0), (1, 2.0), (2, -1.0)) c(j, x)
 UNION ALL SELECT 'below', i, j, 0 FROM a WHERE j < i UNION ALL SELECT 'echelon_below', i, j, 0 FROM a WHERE j < i UNION ALL SELECT 'pivots', i, 0, 1 FROM a WHERE i = j UNION ALL SELECT 'reduced', i, j, CASE WHEN i = j THEN 1 ELSE 0 END FROM a
 UNION ALL SELECT 'determinant', 0, 0, round(det / 1e6, 3) FROM d UNION ALL SELECT 'adjoint', i, j, CASE WHEN i = j THEN round(det / 1e6, 3) ELSE 0 END FROM a, d""")
def matrix_elimination(spark, sf_dir):
    """A right side that the solution (1, 2, -1) has; the adjoint times the matrix is the determinant on the diagonal."""
    m, zero = _matrix3(spark, sf_dir), F.lit(0)
    x = [1.0, 2.0, -1.0]
    with_side = lambda a: matrix.np.column_stack((a, a @ x))
    cells = matrix.dense(m, lambda a: matrix.forward_elimination(with_side(a)))
    echelon = matrix.dense(m, lambda a: matrix.echelon(a, reduced=False))
    return _labelled({
        "solution": matrix.dense(m, lambda a: matrix.solve(with_side(a))), "substituted": matrix.dense(cells, matrix.backward_substitution), "below": matrix.mapped(cells.where("j < i"), lambda v, i, j: F.round(v, 6)), "echelon_below": echelon.where("j < i"),
        "pivots": matrix.diagonal(echelon).select("i", zero.alias("j"), "v"), "reduced": matrix.dense(m, matrix.echelon), "determinant": matrix.mapped(matrix.dense(m, matrix.determinant_by_echelon), lambda v, i, j: F.round(v / 1e6, 3)),
        "adjoint": matrix.mapped(matrix.multiply(matrix.dense(m, matrix.adjoint), m), lambda v, i, j: F.round(v / 1e6, 3)),
    })


_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 2) AS l_extendedprice, round(l_discount, 4) AS l_discount FROM lineitem")
def matrix_components_rebuild(spark, sf_dir):
    """Projected on all principal components and put together again."""
    df = table(spark, sf_dir, "lineitem")
    c = matrix.principal_components(df, _COLS)
    _, mean, _ = matrix.gramian(df, _COLS)
    projected = matrix.project(df, _COLS, c)
    keys = projected.select("l_orderkey", "l_linenumber", *(sum((F.col(f"pc{k}") * x["vector"][i] for k, x in enumerate(c)), F.lit(float(mean[i]))).alias(name) for i, name in enumerate(_COLS)))
    return keys.select("l_orderkey", "l_linenumber", F.round("l_quantity", 4).alias("l_quantity"), F.round("l_extendedprice", 2).alias("l_extendedprice"), F.round("l_discount", 4).alias("l_discount"))


@query("""WITH c AS (SELECT var_samp(l_quantity) AS a, var_samp(l_extendedprice / 1000) AS b, covar_samp(l_quantity, l_extendedprice / 1000) AS h, covar_pop(l_quantity, l_extendedprice / 1000) AS p, count(*) AS n FROM lineitem),
 e AS (SELECT (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + h * h) AS x, (a + b) / 2 - sqrt((a - b) * (a - b) / 4 + h * h) AS y, a, b, h, p, n FROM c)
 SELECT round(x, 3) AS largest, round(y, 3) AS smallest, round(x / (x + y), 6) AS explained, round(h, 4) AS covariance, round(p, 4) AS whole, round(h * (n - 1) / n, 4) AS scores, round(abs(h) / sqrt(h * h + (x - a) * (x - a)), 4) AS first FROM e""")
def matrix_components_values(spark, sf_dir):
    """The eigenvalues of two columns' covariance in closed form, and what they are made of."""
    df = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    cols = ["l_quantity", "price"]
    both, top = matrix.principal_components(df, cols), matrix.principal_components(df, cols, top=1, places=6)[0]
    sample, whole = matrix.covariances(df, cols)[0, 1], matrix.covariances(df, cols, less=0)[0, 1]
    scores = matrix.deviations(df, cols).agg(F.avg(F.col("l_quantity") * F.col("price"))).first()[0]
    return spark.createDataFrame([(round(both[0]["eigenvalue"], 3), round(both[1]["eigenvalue"], 3), top["explained"], round(float(sample), 4), round(float(whole), 4), round(scores, 4), round(abs(top["vector"][0]), 4))], "largest double, smallest double, explained double, covariance double, whole double, scores double, first double")


@query("""SELECT 'x' AS op, l_orderkey AS k, l_linenumber AS n, round(l_quantity, 4) AS a, round(l_extendedprice, 2) AS b, round(l_discount, 4) AS c FROM lineitem
 UNION ALL SELECT 'uu', k, 0, CASE WHEN k = 0 THEN 1 ELSE 0 END, CASE WHEN k = 1 THEN 1 ELSE 0 END, CASE WHEN k = 2 THEN 1 ELSE 0 END FROM range(3) r(k)
 UNION ALL SELECT 'vv', k, 0, CASE WHEN k = 0 THEN 1 ELSE 0 END, CASE WHEN k = 1 THEN 1 ELSE 0 END, CASE WHEN k = 2 THEN 1 ELSE 0 END FROM range(3) r(k)
 UNION ALL SELECT 'norm', 0, 0, round(sqrt(sum(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount)) / 1000, 4), 0, 0 FROM lineitem""")
def matrix_singular_values(spark, sf_dir):
    """U S V is the matrix again, U and V have orthonormal columns, and the values' squares sum to the matrix's."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_COLS)
    u, s, v = matrix.singular_value_decomposition(df, _COLS)
    back = [sum((F.col(f"u{k}") * (s[k] * v[k][i]) for k in range(3)), F.lit(0.0)) for i in range(3)]
    out = u.select(F.lit("x").alias("op"), F.col("l_orderkey").cast("bigint").alias("k"), F.col("l_linenumber").cast("bigint").alias("n"), F.round(back[0], 4).alias("a"), F.round(back[1], 2).alias("b"), F.round(back[2], 4).alias("c"))
    gram = u.agg(*(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"g{i}{j}") for i in range(3) for j in range(3)))
    for i in range(3):
        out = out.unionAll(gram.select(F.lit("uu"), F.lit(i).cast("bigint"), F.lit(0).cast("bigint"), *(F.round(f"g{i}{j}", 6) + 0.0 for j in range(3))))
    a = matrix.np.array(v)
    rows = [("vv", i, 0, *(round(float(x), 6) + 0.0 for x in r)) for i, r in enumerate(a @ a.T)] + [("norm", 0, 0, round(float(matrix.np.sqrt((matrix.np.array(s) ** 2).sum())) / 1000, 4), 0.0, 0.0)]
    return out.unionAll(spark.createDataFrame(rows, out.schema))


# --- vectors and points

def _vectors(spark, sf_dir) -> DataFrame:
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda s: F.floor(s["o_totalprice"] / 1000).cast("double"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(sorted_.alias("a")).where(F.size("a") >= 4)


_V = "x AS (SELECT o_custkey, list(CAST(floor(o_totalprice / 1000) AS DOUBLE) ORDER BY o_orderkey) AS a FROM orders GROUP BY 1 HAVING count(*) >= 4)"


@query(f"""WITH {_V} SELECT o_custkey, list_sum(list_transform(a[1:3], lambda v: v * v)) AS squared, a[1] * a[2] AS product, list_concat([a[1], a[2] * 2, a[3] * 2], a[4:]) AS scaled, (a[3] / 2 + a[2]) / 2 + a[1] AS backwards,
 list_transform(range(len(a) - 1), lambda i: a[i + 2] - a[i + 1]) AS diff, list_transform(range(len(a) - 2), lambda i: a[i + 3] - 2 * a[i + 2] + a[i + 1]) AS twice, list_transform(range(len(a) - 2), lambda i: a[i + 3] - a[i + 1]) AS seasonal,
 list_transform(range(greatest(len(a) - 4, 0)), lambda i: a[i + 5] - 2 * a[i + 3] + a[i + 1]) AS seasonal_twice, list_transform(range(len(a) - 3), lambda i: a[i + 4] - 3 * a[i + 3] + 3 * a[i + 2] - a[i + 1]) AS thrice, [a[2] + 1, a[3] + 2] AS ranged, [a[3] + 2, a[2] + 1] AS reversed,
 [[a[2], a[1]], [a[4], a[3]]] AS swapped, [a[3], a[4]] AS nested, [a[1], a[3]] AS nested_some, greatest(a[1], a[2], a[3], a[4]) AS largest, true AS near, false AS far, 5 AS drawn FROM x""")
def arrays_ranges(spark, sf_dir):
    x, a = _vectors(spark, sf_dir), F.col("a")
    grid = F.array(F.array(a[0], a[1]), F.array(a[2], a[3]))
    plus = lambda v, i: v + i
    none = F.array().cast("array<double>")
    return x.select(
        "o_custkey", arrays.sum_squared(a, 0, 2).alias("squared"), arrays.product(a, 0, 1).alias("product"), arrays.scale(a, 2.0, 1, 2).alias("scaled"), arrays.reduce_range(a, lambda s, v: s / 2 + v, 0.0, 2, 0).alias("backwards"), arrays.difference(a).alias("diff"),
        arrays.second_difference(a).alias("twice"), arrays.difference(a, 2).alias("seasonal"), F.coalesce(arrays.second_difference(a, 2), none).alias("seasonal_twice"), arrays.nth_difference(a, 3).alias("thrice"), arrays.map_range(a, plus, 1, 2).alias("ranged"),
        arrays.map_range(a, plus, 2, 1).alias("reversed"), arrays.all_rows_swap(grid, 0, 1).alias("swapped"), arrays.nested(grid, 2, {0: [1]}).alias("nested"), arrays.nested(grid, 2, {1: [0]}).alias("nested_some"), st.farthest(grid).alias("largest"),
        arrays.equals_nearly(a, F.transform(a, lambda v: v * (1 + 1e-9))).alias("near"), arrays.equals_nearly(a, F.transform(a, lambda v: v * 1.1 + 1)).alias("far"), F.size(F.filter(arrays.random(5), lambda v: (v >= 0) & (v < 1))).alias("drawn"),
    )


_POINTS = "p AS (SELECT n_nationkey AS id, [CAST(n_nationkey % 7 AS DOUBLE), CAST(n_regionkey AS DOUBLE), CAST(n_nationkey AS DOUBLE)] AS p FROM nation)"


@query(f"WITH {_POINTS} SELECT a.id AS i, b.id AS j, round(sqrt(power(a.p[1] - b.p[1], 2) + power(a.p[2] - b.p[2], 2)), 6) AS distance FROM p a JOIN p b ON a.id < b.id")
def points_distances_of_columns(spark, sf_dir):
    return st.distances(_grid(spark, sf_dir), "id", "p", columns=[0, 1]).withColumn("distance", F.round("distance", 6))


def _grid(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("id"), F.array((k % 7).cast("double"), F.col("n_regionkey").cast("double"), k.cast("double")).alias("p"))


def _extreme(which: str):
    return lambda spark, sf_dir: st.distances(_grid(spark, sf_dir), "id", "p", which, [0, 1]).withColumn("distance", F.round("distance", 6))


for _e in ("min", "max"):
    QUERIES[f"points_{_e}_distances_of_columns"] = _extreme(_e)
    ORACLE[f"points_{_e}_distances_of_columns"] = f"WITH {_POINTS}, d AS (SELECT a.id AS i, b.id AS j, round(sqrt(power(a.p[1] - b.p[1], 2) + power(a.p[2] - b.p[2], 2)), 6) AS distance, a.p, b.p AS q FROM p a JOIN p b ON a.id < b.id) SELECT * FROM d WHERE distance = (SELECT {_e}(distance) FROM d)"


@query("""SELECT 'l_quantity' AS i, 'l_extendedprice' AS j, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n, round(sum(l_quantity), 2) AS sum_i FROM lineitem
 UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6), count(*), round(sum(l_quantity), 2) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6), count(*), round(sum(l_extendedprice), 2) FROM lineitem""")
def stats_pearson_results(spark, sf_dir):
    return st.pearson_results(table(spark, sf_dir, "lineitem"), _COLS).select("i", "j", F.round("r", 6).alias("r"), "n", F.round("sum_i", 2).alias("sum_i"))


@query("SELECT l_returnflag, round(sum(l_quantity * l_quantity), 2) AS squares, round(skewness(l_quantity) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)), 6) AS skew FROM lineitem GROUP BY 1")
def stats_skew(spark, sf_dir):
    x = F.col("l_quantity").cast("double")
    got = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(st.sum_with(lambda v: v * v, x).alias("squares"), st.summary(x)[9].alias("skew"))
    return got.select("l_returnflag", F.round("squares", 2).alias("squares"), F.round("skew", 6).alias("skew"))


_SEASON = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"SELECT event_id, round(value - 2 * lag(value, 3) {_SEASON} + lag(value, 6) {_SEASON}, 6) AS twice FROM events")
def stats_seasonal_twice(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.round(st.difference(F.col("value"), w, 3, 2), 6).alias("twice"))
