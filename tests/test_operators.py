import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import arrays, decisions, indicators, learn, matrix
from quern.operators import statistics as st
from quern.operators.scan import scan
from quern.sources.typed import TypedStore


def one(df):
    return df.first()[0]


def cells(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["i"], {})[r["j"]] = r["v"]
    return [[out[i][j] for j in sorted(out[i])] for i in sorted(out)]


@pytest.mark.parametrize(("xs", "sd", "sample"), [([1], 0, 0), ([1, 2], 0.5, 0.7071067811865476), ([1, 2, 3], 0.8164965809277263, 1), ([1, 2, 3, 4], 1.118033988749895, 1.2909944487358056)])
def test_deviations(spark, xs, sd, sample):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").agg(*st.summary(F.col("x")))
    r = df.first()
    assert (r["std_dev"], r["sample_std_dev"]) == pytest.approx((sd, sample))


def test_differences(spark):
    df = spark.createDataFrame(enumerate([0.0, 0.0, 1.0, 3.0, 6.0]), "k int, x double")
    w = Window.orderBy("k")
    assert [r[0] for r in df.select(st.difference(F.col("x"), w)).collect()] == [None, 0, 1, 2, 3]
    assert [r[0] for r in df.select(st.second_difference(F.col("x"), w)).collect()] == [None, 1, 1, 1, None]


def test_autocovariance(spark):
    xs = [0.05, 0.01, -0.02, 0.03, -0.04, 0.06, 0.02, -0.01, -0.03, 0.04]
    r = st.autocovariance(spark.createDataFrame(enumerate(xs), "k int, x double"), "x", ["k"], 1).first()
    assert r["autocovariance"] == pytest.approx(-0.00046, abs=5e-5) and r["autocorrelation"] == pytest.approx(-0.38, abs=0.01)


def test_array_functions(spark):
    a = F.array(*(F.lit(float(x)) for x in (1, 2, 3, 4)))
    r = spark.range(1).select(arrays.array_sum(a, 1, 2), arrays.product(a, 1, 2), arrays.sum_squared(a, 1, 2), arrays.average(a), arrays.difference(a), arrays.swap(a, 0, 3), arrays.move(a, 0, 2), arrays.find_sorted(a, F.lit(2.5)), F.size(arrays.pairs(a)), arrays.last(a), arrays.equals_nearly(a, a), arrays.median_as_given(a)).first()
    assert list(r)[:4] == [5, 6, 13, 2.5]
    assert list(r)[4:] == [[1, 1, 1], [4, 2, 3, 1], [2, 3, 1, 4], -3, 6, 4, True, 2.5]


def test_distances(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0]), (3, [4.0])], "id int, p array<double>")
    assert sorted(map(tuple, st.distances(df, "id", "p").collect())) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 2, 1), (1, 3, 2), (2, 3, 1)]
    assert st.distances(df, "id", "p", "min").count() == 3
    assert math.isnan(one(spark.range(1).select(st.distance(F.array().cast("array<double>"), F.array().cast("array<double>")))))


A = [[1, 0, 2, -1], [3, 0, 0, 5], [2, 1, 4, -3], [1, 0, 5, 0]]
B = [[1, 2, -2], [1, -1, 2], [3, 2, 1]]


def test_dense(spark):
    assert one(matrix.dense(matrix.from_rows(spark, A), np.linalg.det).select("v")) == pytest.approx(30)
    assert matrix.determinant_by_cofactors(np.array(A, float)) == pytest.approx(30)
    want = [[1, 6 / 5, -2 / 5], [-1, -7 / 5, 4 / 5], [-1, -4 / 5, 3 / 5]]
    for f in (matrix.inverse, matrix.inverse_by_adjoint):
        assert np.allclose(cells(matrix.dense(matrix.from_rows(spark, B), f)), want)
    assert np.allclose(matrix.adjoint(np.array([[-3, 2, -5], [-1, 0, -2], [3, -4, 1.0]])), [[-8, 18, -4], [-5, 12, -1], [4, -6, 2]])
    assert np.allclose(matrix.solve(np.array([[3, 2, -4, 3], [2, 3, 3, 15], [5, -3, 1, 14.0]])), [3, 1, 2])
    rref = matrix.echelon(np.array([[0, 3, -6, 6, 4, -5], [3, -7, 8, -5, 8, 9], [3, -9, 12, -9, 6, 15.0]]))
    assert np.allclose(rref, [[1, 0, -2, 3, 0, -24], [0, 1, -2, 2, 0, -7], [0, 0, 0, 0, 1, 4]])
    low, up = matrix.lu(np.array(B, float))
    assert np.allclose(low @ up, B) and matrix.rank(np.array(A, float)) == 4
    with pytest.raises(ValueError, match="square"):
        matrix.inverse(np.ones((2, 3)))


def test_cells(spark):
    x, y = matrix.from_rows(spark, [[1, 0, 1], [2, 1, 1], [0, 1, 1], [1, 1, 2]]), matrix.from_rows(spark, [[1, 2, 1], [2, 3, 1], [4, 2, 2]])
    assert cells(matrix.multiply(x, y)) == [[5, 4, 3], [8, 9, 5], [6, 5, 3], [11, 9, 6]]
    assert one(matrix.norm(matrix.from_rows(spark, [[2, 3, -1], [0, -1, 4]]))) == pytest.approx(5.5677643628300215)
    assert cells(matrix.vandermonde(spark, [-1, 0, 0.5, 1], 5))[2] == [1, 0.5, 0.25, 0.125, 0.0625]
    m = matrix.from_rows(spark, [[1, 2], [3, 4]])
    assert cells(matrix.transpose(m)) == [[1, 3], [2, 4]] and cells(matrix.swap_rows(m, 0, 1)) == [[3, 4], [1, 2]]
    assert cells(matrix.add_row_to_row(m, 0, 1, -3)) == [[1, 2], [0, -2]] and cells(matrix.add_row(m, [5, 6], keep=2)) == [[3, 4], [5, 6]]
    assert cells(matrix.reshape(m, 2, 4)) == [[1, 2, 3, 4]] and cells(matrix.minor(m, 0, 0)) == [[4]]
    assert one(matrix.is_symmetric(m)) is False and one(matrix.equals_nearly(m, m)) is True and one(matrix.trace(m)) == 5
    assert one(matrix.find_in_column(m, 0, lambda v: v > 2)) == 1 and one(matrix.find_in_row(m, 0, lambda v: v > 9)) == -1


def test_components(spark):
    df = spark.createDataFrame([(40.0, 50.0, 60.0), (50.0, 70.0, 60.0), (80.0, 70.0, 90.0), (50.0, 60.0, 80.0)], "a double, b double, c double")
    pc = matrix.principal_components(df, ["a", "b", "c"])
    assert [p["eigenvalue"] for p in pc] == pytest.approx([520.0992658908312, 78.10455398035167, 18.462846795484058])
    assert matrix.singular_values(df, ["a", "b", "c"])[0] == pytest.approx([223.85445199527607, 17.366841363876695, 13.695880509722402])
    assert "pc2" in matrix.project(df, ["a", "b", "c"], pc).columns


def test_indicators(spark):
    up = [float(x) for x in range(1, 40)]
    ema = indicators.ema(3)
    assert [ema.add(x) for x in up[:5]] == [None, None, 2, 3, 4]
    one = indicators.Indicators()
    rows = [one.add(x + 1, x - 1, x) for x in up]
    assert rows[13][0] is None and rows[14][0] == pytest.approx(100 - 100 / 101) and rows[30][1] == pytest.approx(7) and rows[-1][2:] == pytest.approx((7, 0, 2))
    df = spark.createDataFrame([(t, k, x + 1, x - 1, x, 1.0) for t in "ab" for k, x in enumerate(up)], "ticker string, date int, high double, low double, close double, volume double")
    got = {(r["ticker"], r["date"]): r for r in indicators.with_indicators(df.repartition(5), text=True).collect()}
    assert got["a", 14]["rsi"] == got["b", 14]["rsi"] == "99.01" and got["a", 38]["atr"] == "2.0000" and got["b", 38]["obv"] == "38" and got["a", 48 - 38]["sma50"] is None


def test_scan_over_batches(spark):
    """A key's state goes on over batches, and starts anew with the next key."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame([(k, i, float(i) if i != 4 else None) for k in "xyz" for i in range(10)], "k string, i int, v double").repartition(4)
        got = {(r["k"], r["i"]): r["s"] for r in scan(df, ["k"], ["i"], ["v"], lambda: [0.0], lambda s, v: (s.__setitem__(0, s[0] + (v or 0.0)), s[0])[1:], ["s"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(got[k, i] == sum(range(i + 1)) - (4 if i >= 4 else 0) for k in "xyz" for i in range(10))
    assert scan(df.limit(0), ["k"], ["i"], ["v"], list, lambda s, v: (v,), ["s"]).collect() == []


# The decomposition of a known matrix.
U = [[-0.3913289321676804, 0.3487948014410755, 0.10448989927485411], [-0.4639397307294648, -0.34948424610207607, 0.7962721013609022], [-0.6197155556759748, -0.5188940242462491, -0.5888137410546312], [-0.4975683100363125, 0.6978194177691509, -0.0912742016622088]]
S = [223.85445199527607, 13.695880509722402, 17.366841363876695]


def test_decomposition(spark):
    df = spark.createDataFrame([(0, 40.0, 50.0, 60.0), (1, 50.0, 70.0, 60.0), (2, 80.0, 70.0, 90.0), (3, 50.0, 60.0, 80.0)], "k int, a double, b double, c double").repartition(3)
    u, s, v = matrix.singular_value_decomposition(df, ["a", "b", "c"])
    order = np.argsort(S)[::-1]
    assert s == pytest.approx([S[k] for k in order])
    got = np.array([[r[f"u{k}"] for k in range(3)] for r in u.orderBy("k").collect()])
    assert np.abs(got) == pytest.approx(np.abs(np.array(U)[:, order])) and got * s @ np.array(v) == pytest.approx(np.array([[40, 50, 60], [50, 70, 60], [80, 70, 90], [50, 60, 80]]))


def test_distances_of_columns(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0, 9.0]), (1, [2.0, 2.0, 1.0]), (2, [3.0, 3.0, 5.0]), (3, [4.0, 5.0, 0.0])], "id int, p array<double>")
    r = st.distances(df, "id", "p", "max", [0, 1]).collect()
    assert [(x["i"], x["j"], x["distance"], x["p"][:2], x["q"][:2]) for x in r] == [(0, 3, 5.0, [1.0, 1.0], [4.0, 5.0])]
    assert one(spark.range(1).select(st.distance(F.col("id"), F.col("id"), []))) == 0


def test_text_and_graph(spark):
    r = spark.range(1).select(learn.edit_distance(F.lit("atesggword"), F.lit("ateshhtword")), learn.edit_distance(F.lit(None), F.lit("abc"))).first()
    assert tuple(r) == (3, 3)
    docs = spark.createDataFrame([("d1", "Alpha Beta met Gamma and Deltas")], "id string, text string")
    nodes, edges = learn.knowledge_graph(docs, "id", "text")
    assert {x["id"] for x in nodes.collect()} >= {"d1", "Alpha", "Gamma", "Alpha Beta"} and edges.where("type = 'related_to'").count() > 0
    c = decisions.conditions(decisions.signals(F.lit("Is this 1 question?"), ["nothing"]))
    got = spark.range(1).select(decisions.tree(c)["reason"], decisions.posteriors(c)["retrieve"]).first()
    assert tuple(got) == (decisions.REASONS[4], pytest.approx(0.32 / 1.12))
    with pytest.raises(ValueError, match="not found"):
        learn.add_edges(spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([("d1", "nobody")], "src string, dst string"), nodes)


def test_logistic(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0), (0.0, 1.0, 1), (1.0, 0.0, 1), (1.0, 1.0, 1)], "a double, b double, y int")
    got = learn.predict(learn.fit(df, ["a", "b"], "y", l2=0.01), df).collect()
    assert [r["label_pred"] for r in got] == [0, 1, 1, 1] and all(0 <= r["proba"] <= 1 for r in got)
    with pytest.raises(ValueError, match="non-empty"):
        learn.fit(df.limit(0), ["a"], "y")
    with pytest.raises(ValueError, match="not fitted"):
        learn.predict(None, df)


def test_typed_store(spark):
    schema = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("name", T.StringType())])
    s = TypedStore(spark, schema, "Names").add({"id": 1, "name": "Ann"}, {"id": 2, "name": "bob"})
    assert [r["id"] for r in s.query([{"field": "name", "op": "starts with", "value": "AN"}]).collect()] == [1]
    assert [r["id"] for r in s.query(order_by="id", descending=True, limit=1).collect()] == [2]
    with pytest.raises(ValueError, match='Invalid field "id"'):
        s.add({"id": "x"})
    with pytest.raises(ValueError, match="Unknown operator"):
        s.query([{"field": "id", "op": "contains", "value": 1}])
    assert s.join(TypedStore(spark, schema, "other", s.df.limit(1)), "id", "FULL OUTER").columns == ["names.id", "names.name", "other.id", "other.name"]
