import pytest
from pyspark.sql import functions as F

from quern.streaming import realtime as rt


def test_step_and_measures():
    state = rt.step(None, [1.0, 2.0, 3.0, 4.0], 3)
    m = dict(zip([c.split()[0] for c in rt.RESULT.split(", ")], rt.measures("k", state, 3, 1.0)))
    assert (m["count"], m["avg"], m["median"], m["moving_avg"], m["delta"]) == (4, 2.5, 3, 3, 1) and m["outlier"]
    again = rt.step(rt.step(None, [1.0, 2.0], 3), [3.0, 4.0], 3)
    assert again[0] == state[0] and again[1:4] == pytest.approx(state[1:4]) and len(state[8]) <= 4
    far = rt.step(None, [1e9 + x for x in (1.0, 2.0, 3.0, 10.0)], 3)  # a large mean costs no digits
    assert far[2] == pytest.approx(50) and rt.measures("k", far, 3, 1.0)[11] == pytest.approx(rt.measures("k", rt.step(None, [1.0, 2.0, 3.0, 10.0], 3), 3, 1.0)[11], rel=1e-6)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, float(i * i % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k long, x double")
    df.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = rt.realtime(stream, "k", "x", "id").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    got = {r["key"]: (r["count"], r["sum"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {str(r["k"]): (r["n"], r["s"]) for r in df.groupBy("k").agg(F.count("x").alias("n"), F.sum("x").alias("s")).collect()}


def test_metrics_and_changes(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "up"), (2, "a", 3.0, "up"), (3, "a", 5.0, "down")], "t int, k string, x double, s string")
    last = rt.metrics(df, "k", ["t"], "x", 2).orderBy("t").collect()[-1]
    assert (last["avg"], last["moving_avg"], last["delta"], last["normalised"]) == pytest.approx((3, 4, 2, 0.5))
    assert [r["t"] for r in rt.state_changes(df, "k", ["t"], "s").orderBy("t").collect()] == [1, 3]
    assert rt.cross_normalised(rt.latest(rt.metrics(df, "k", ["t"], "x"), "k", "t")).first()["value"] == pytest.approx(0)


def test_median_outliers_at_ties(spark):
    """A key's second value is one deviation from the median: which side it falls to is that of the SQL, to the last digit."""
    import duckdb

    rows = [(2 * i + j, i, j, None if (i + j) % 41 == 0 else (i * 37 + j * 5003) % 12289 / 100) for i in range(400) for j in range(2 + i % 5)]
    df = spark.createDataFrame(rows, "id long, k long, t long, x double")
    got = sorted((r["k"], r["t"], r["median"]) for r in rt.median_outliers(df, "k", ["t"], "x", 1.0).collect())
    e = duckdb.connect()
    e.execute("CREATE TABLE e (id BIGINT, k BIGINT, t BIGINT, x DOUBLE)")
    e.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", rows)
    w = "OVER (PARTITION BY k ORDER BY t ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    sql = f"SELECT k, t, mid FROM (SELECT *, median(x) {w.format(2)} AS mid, stddev_pop(x) {w.format('UNBOUNDED')} AS sd FROM e) WHERE abs(x - mid) > sd ORDER BY k, t"
    assert len(got) > 200 and got == e.execute(sql).fetchall()


def test_rates(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:01",), ("2024-01-01 00:00:02",)], "ts string").select(F.col("ts").cast("timestamp"))
    got = rt.rates(df, "ts", spans=("10 seconds",))["10 seconds"]
    assert got.agg(F.max("n")).first()[0] == 2 and got.count() == 11
