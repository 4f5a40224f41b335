"""Named queries over the standard tables, one for each family of operators, and the SQL they are checked with.

Doubles that are sums of many values are rounded on both sides, as their last bits depend on the order of addition; to
places at which exact halves don't occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats, registry, text
from ..operators import arrays, indicators, learn, matrix
from ..operators import statistics as st
from ..sources.records import RecordStore
from ..sources.shared import shared_path
from ..sources.typed import TypedStore
from ..streaming import realtime as rt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def _store(spark: SparkSession, sf_dir: str, *names: str) -> RecordStore:
    store = RecordStore(spark)
    for n in names:
        store.tables[n] = table(spark, sf_dir, n)
    return store


def _sql(name: str, tables: str, dialect: str, oracle: str, **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: _store(spark, sf_dir, *tables.split()).sql(dialect, **options)
    ORACLE[name] = oracle


_R = "floor({} * 100 + 0.5) / 100"
_sql("sql_filter_project", "customer", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
_sql("sql_star", "region", "SELECT * FROM region ORDER BY r_name DESC", "SELECT * FROM region")
_sql("sql_order_limit", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_sql("sql_group_count", "orders", "SELECT o_orderstatus, COUNT(*) AS cnt FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS cnt FROM orders GROUP BY 1")
_sql("sql_aggregates", "part", "SELECT p_brand, MIN(p_size) AS lo, MAX(p_size) AS hi, SUM(p_size) AS total, AVG(p_size) AS mean, COUNT(p_size) AS n FROM part GROUP BY p_brand", f"SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi, CAST(sum(p_size) AS BIGINT) AS total, {_R.format('avg(p_size)')} AS mean, count(p_size) AS n FROM part GROUP BY 1")
_sql("sql_count_distinct", "lineitem", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1")
_sql("sql_having", "orders", "SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey HAVING cnt > 12", "SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY 1 HAVING count(*) > 12")
_sql("sql_global_aggregate", "lineitem", "SELECT COUNT(*) AS n, MAX(l_quantity) AS hi, MIN(l_quantity) AS lo FROM lineitem", "SELECT count(*) AS n, max(l_quantity) AS hi, min(l_quantity) AS lo FROM lineitem")
_sql("sql_predicates", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('building', 'MACHINERY') AND c_acctbal NOT BETWEEN 0 AND 3000 AND c_name LIKE 'customer%' AND NOT c_nationkey = 3", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') AND NOT (c_acctbal BETWEEN 0 AND 3000) AND c_name ILIKE 'customer%' AND NOT c_nationkey = 3")
_sql("sql_or_precedence", "part", "SELECT p_partkey FROM part WHERE p_size < 3 OR p_size > 48 AND p_retailprice > 1000", "SELECT p_partkey FROM part WHERE p_size < 3 OR p_size > 48 AND p_retailprice > 1000")
_sql("sql_is_null", "events", "SELECT event_id FROM events WHERE value IS NOT NULL AND user_id <> 7", "SELECT event_id FROM events WHERE value IS NOT NULL AND user_id <> 7")
_sql("sql_equals_ignoring_case", "customer", "SELECT COUNT(*) AS n FROM customer WHERE c_mktsegment = 'building'", "SELECT count(*) AS n FROM customer WHERE lower(c_mktsegment) = 'building'")
_sql("sql_parameters", "orders", "SELECT o_orderkey, :msg.payload.tag AS tag FROM orders WHERE o_totalprice >= :flow.least AND o_orderstatus = :global.status", "SELECT o_orderkey, 'big' AS tag FROM orders WHERE o_totalprice >= 300000 AND lower(o_orderstatus) = 'o'", params={"msg": {"payload": {"tag": "big"}}, "flow": {"least": 300000}, "global": {"status": "o"}})
for _how in ("INNER", "LEFT", "RIGHT", "FULL OUTER"):
    _sql(f"sql_join_{_how.split()[0].lower()}", "customer orders", f"SELECT c.c_custkey, o.o_orderkey FROM customer c {_how} JOIN orders o ON c.c_custkey = o.o_custkey", f'SELECT c.c_custkey AS "c.c_custkey", o.o_orderkey AS "o.o_orderkey" FROM customer c {_how} JOIN orders o ON c.c_custkey = o.o_custkey')
_sql(
    "sql_revenue_by_nation", "customer orders nation",
    "SELECT n.n_name AS nation, COUNT(*) AS orders, MAX(o.o_totalprice) AS largest FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice > 1000 GROUP BY n.n_name HAVING orders > 1 ORDER BY orders DESC",
    f"SELECT n_name AS nation, count(*) AS orders, {_R.format('max(o_totalprice)')} AS largest FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 1",
)


@query("SELECT e.event_id, e.value FROM events e WHERE e.value > 50 AND e.user_id < 40")
def records_predicates(spark, sf_dir):
    return RecordStore(spark).query(table(spark, sf_dir, "events"), {"value": lambda c: c > 50, "user_id": lambda c: c < 40}).select("event_id", "value")


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (1, 2)")
def records_positions(spark, sf_dir):
    return RecordStore(spark).query(table(spark, sf_dir, "region"), rows={"a": [0, 1, 2], "b": [1, 2, 3]}, position="r_regionkey").select("r_regionkey", "r_name")


@query("SELECT p_partkey FROM part WHERE lower(p_type) LIKE '%steel%' OR p_size >= 45")
def typed_rules(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    store = TypedStore(spark, df.schema, "part_store", df)
    return store.query([{"field": "p_type", "op": "contains", "value": "STEEL"}, {"field": "p_size", "op": ">=", "value": 45}], "OR").select("p_partkey")


@query('SELECT n_name AS "nations.n_name", r_name AS "regions.r_name" FROM nation LEFT JOIN region ON n_regionkey = r_regionkey')
def typed_join(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return TypedStore(spark, n.schema, "nations", n).join(TypedStore(spark, r.schema, "regions", r), "n_regionkey = r_regionkey", "LEFT").select("`nations.n_name`", "`regions.r_name`")


# --- statistics


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS avg, min(l_quantity) AS min, max(l_quantity) AS max, round(sum(l_quantity), 4) AS sum, max(l_quantity) - min(l_quantity) AS range, round(var_pop(l_quantity), 6) AS variance, round(stddev_pop(l_quantity), 6) AS std_dev, round(var_samp(l_quantity), 6) AS sample_variance, round(stddev_samp(l_quantity), 6) AS sample_std_dev, median(l_quantity) AS median, round(skewness(l_quantity) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)), 6) AS skew FROM lineitem GROUP BY 1")
def stats_summary(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*st.summary(F.col("l_quantity")))
    return df.withColumns({c: F.round(c, 4 if c == "sum" else 6) for c in ("avg", "sum", "variance", "std_dev", "sample_variance", "sample_std_dev", "skew")})


_WIN = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@query(f"""SELECT event_id, value - coalesce(lag(value) {_WIN}), 0) AS delta, CASE WHEN lag(value) {_WIN}) = 0 THEN NULL ELSE round((value - lag(value) {_WIN})) / lag(value) {_WIN}), 6) END AS delta_normalised,
  value - lag(value) {_WIN}) AS diff, value - lag(value, 3) {_WIN}) AS seasonal, round(value - 2 * lag(value) {_WIN}) + lag(value, 2) {_WIN}), 6) AS twice, round(lag(value) {_WIN}) - 2 * value + lead(value) {_WIN}), 6) AS second FROM events""")
def stats_differences(spark, sf_dir):
    w, x = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", st.delta(x, w).alias("delta"), F.round(st.delta_normalised(x, w), 6).alias("delta_normalised"), st.difference(x, w).alias("diff"), st.difference(x, w, 3).alias("seasonal"), F.round(st.difference(x, w, 1, 2), 6).alias("twice"), F.round(st.second_difference(x, w), 6).alias("second"))


@query(f"""SELECT event_id, round(CASE WHEN count(*) {_WIN} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 5 THEN avg(value) {_WIN} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 9) AS simple, round(avg(value) {_WIN} ROWS UNBOUNDED PRECEDING), 9) AS cumulative,
  round((3 * value + 2 * coalesce(lag(value) {_WIN}), 0) + coalesce(lag(value, 2) {_WIN}), 0)) / 6, 9) AS weighted FROM events""")
def stats_moving(spark, sf_dir):
    w, x = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(st.moving_average(x, w, 5), 9).alias("simple"), F.round(st.cumulative_average(x, w), 9).alias("cumulative"), F.round(st.weighted_average(x, w, 3), 9).alias("weighted"))


@query("""WITH RECURSIVE r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 e AS (SELECT event_id, user_id, k, value AS ema FROM r WHERE k = 1 UNION ALL SELECT r.event_id, r.user_id, r.k, 0.25 * r.value + 0.75 * e.ema FROM e JOIN r ON r.user_id = e.user_id AND r.k = e.k + 1)
 SELECT event_id, round(ema + 0.0000000031, 6) AS ema FROM e""")
def stats_exponential(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return st.exponential_average(df, "value", ["user_id"], ["ts", "event_id"], 0.25).select("event_id", F.round(F.col("ema") + 0.0000000031, 6).alias("ema"))


@query("""SELECT event_id, round(CASE WHEN max(value) OVER p = min(value) OVER p THEN 0 ELSE (value - avg(value) OVER p) / (max(value) OVER p - min(value) OVER p) END, 6) AS normalized,
 round((value - avg(value) OVER p) / nullif(stddev_pop(value) OVER p, 0), 6) AS standardized FROM events WINDOW p AS (PARTITION BY user_id)""")
def stats_normalised(spark, sf_dir):
    w, x = Window.partitionBy("user_id"), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(st.normalize(x, w), 6).alias("normalized"), F.round(st.standardize(x, w), 6).alias("standardized"))


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(covar_pop({a}, {b}), 4) AS covariance FROM lineitem" for a, b in _PAIRS))
def stats_covariance(spark, sf_dir):
    return st.covariance(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("covariance", F.round("covariance", 4))


@query(" UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b in _PAIRS))
def stats_correlation(spark, sf_dir):
    return st.correlation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("correlation", F.round("correlation", 6))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def stats_pearson(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(st.pearson(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


@query("""WITH d AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS d, ts, event_id FROM events), e AS (SELECT user_id, d, lead(d, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM d)
 SELECT user_id, round(sum(d * e) / nullif(count(d) - 1, 0), 5) AS autocovariance, round(sum(d * e) / nullif(sum(d * d), 0), 6) AS autocorrelation FROM e GROUP BY 1 HAVING count(*) > 1""")
def stats_autocovariance(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    some = df.groupBy("user_id").count().where("count > 1").select("user_id")
    out = st.autocovariance(df.join(some, "user_id", "left_semi"), "value", ["ts", "event_id"], 2, ["user_id"])
    return out.select("user_id", F.round("autocovariance", 5).alias("autocovariance"), F.round("autocorrelation", 6).alias("autocorrelation"))


def _points(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array("n_nationkey", "n_regionkey").alias("p"))


@query("SELECT a.n_nationkey AS i, b.n_nationkey AS j, round(sqrt(power(a.n_nationkey - b.n_nationkey, 2) + power(a.n_regionkey - b.n_regionkey, 2)), 6) AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def points_distances(spark, sf_dir):
    return st.distances(_points(spark, sf_dir), "id", "p").withColumn("distance", F.round("distance", 6))


for _e in ("min", "max"):
    QUERIES[f"points_{_e}_distances"] = lambda spark, sf_dir, e=_e: st.distances(_points(spark, sf_dir), "id", "p", e).select("i", "j", F.round("distance", 6).alias("distance"))
    ORACLE[f"points_{_e}_distances"] = f"WITH d AS ({ORACLE['points_distances']}) SELECT * FROM d WHERE distance = (SELECT {_e}(distance) FROM d)"


# --- arrays

_A = "SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS a FROM orders GROUP BY 1"


@query(f"WITH x AS ({_A}) SELECT o_custkey, round(list_sum(a), 2) AS total, round(list_sum(a[2:3]), 2) AS part, round(list_sum(a) / len(a), 1) AS mean, a[-1] AS last, len(a) * (len(a) - 1) // 2 AS n_pairs FROM x")
def arrays_folds(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda s: s["o_totalprice"]).alias("a"))
    c = F.col("a")
    return a.select("o_custkey", F.round(arrays.array_sum(c), 2).alias("total"), F.round(F.when(F.size(c) >= 2, arrays.array_sum(c, 1, 2)), 2).alias("part"), F.round(arrays.average(c), 1).alias("mean"), arrays.last(c).alias("last"), F.size(arrays.pairs(c)).cast("bigint").alias("n_pairs"))


@query(f"""WITH x AS ({_A}), l AS (SELECT o_custkey, a, list_sort(a) AS b, len(a) AS n FROM x WHERE len(a) >= 3)
 SELECT o_custkey, list_concat([a[3], a[2], a[1]], a[4:]) AS swapped, list_concat([a[2], a[3], a[1]], a[4:]) AS moved, list_concat([a[1], 1.0, 2.0], a[4:]) AS laid, CAST(0 AS INTEGER) AS found,
 CAST(-n - 1 AS INTEGER) AS absent, list_concat([-1e9], b) AS added, (a[(n + 1) // 2] + a[n // 2 + 1]) / 2 AS middle FROM l""")
def arrays_order(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda s: s["o_totalprice"]).alias("a")).where(F.size("a") >= 3)
    c, b = F.col("a"), F.array_sort("a")
    return a.select(
        "o_custkey", arrays.swap(c, 0, 2).alias("swapped"), arrays.move(c, 0, 2).alias("moved"), arrays.overlay(c, F.array(F.lit(1.0), F.lit(2.0)), 1).alias("laid"), arrays.find_sorted(b, F.array_min(c)).alias("found"),
        arrays.find_sorted(b, F.lit(1e12)).alias("absent"), arrays.add_sorted(c, F.lit(-1e9)).alias("added"), arrays.median_as_given(c).alias("middle"),
    )


# --- indicators: lineitem's parts as shares

_PRICES = "SELECT l_suppkey AS ticker, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k, l_extendedprice + 10 AS high, l_extendedprice - 10 AS low, l_extendedprice AS close, l_quantity AS volume FROM lineitem"


def _prices(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.row_number().over(w).cast("bigint").alias("k"), (x + 10).alias("high"), (x - 10).alias("low"), x.alias("close"), F.col("l_quantity").alias("volume"))


_F20, _F14 = ("(PARTITION BY ticker ORDER BY k ROWS BETWEEN {} PRECEDING AND CURRENT ROW)".format(n) for n in (19, 13))


@query(f"""WITH p AS ({_PRICES}) SELECT ticker, k, round(CASE WHEN k >= 20 THEN avg(close) OVER {_F20} END, 4) AS middle, round(CASE WHEN k >= 20 THEN avg(close) OVER {_F20} + 2 * stddev_pop(close) OVER {_F20} END, 2) AS upper,
 round(CASE WHEN k >= 14 THEN CASE WHEN max(high) OVER {_F14} = min(low) OVER {_F14} THEN 50 ELSE (close - min(low) OVER {_F14}) / (max(high) OVER {_F14} - min(low) OVER {_F14}) * 100 END END, 6) AS stoch_k FROM p""")
def indicators_windows(spark, sf_dir):
    w = Window.partitionBy("ticker").orderBy("k")
    c = F.col("close")
    upper, middle, _ = indicators.bollinger(c, w)
    return _prices(spark, sf_dir).select("ticker", "k", F.round(middle, 4).alias("middle"), F.round(upper, 2).alias("upper"), F.round(indicators.stochastic(F.col("high"), F.col("low"), c, w), 6).alias("stoch_k"))


@query(f"""WITH p AS ({_PRICES}), s AS (SELECT ticker, k, coalesce(sign(close - lag(close) OVER (PARTITION BY ticker ORDER BY k)), 0) * volume AS v FROM p) SELECT ticker, k, sum(v) OVER (PARTITION BY ticker ORDER BY k ROWS UNBOUNDED PRECEDING) AS obv FROM s""")
def indicators_obv(spark, sf_dir):
    return indicators.with_indicators(_prices(spark, sf_dir), date="k").select("ticker", "k", "obv")


_SMOOTHED = """s{0} AS (SELECT ticker, series, pos, n, a, s FROM (SELECT ticker, series, n, a, CAST(n AS BIGINT) AS pos, avg(x) AS s FROM {1} WHERE pos <= n GROUP BY ALL HAVING count(*) = n)
 UNION ALL SELECT s.ticker, s.series, x.pos, s.n, s.a, s.s + s.a * (x.x - s.s) FROM s{0} s JOIN {1} x ON x.ticker = s.ticker AND x.series = s.series AND x.pos = s.pos + 1)"""


@query(f"""WITH RECURSIVE p AS ({_PRICES}), m AS (SELECT *, close - lag(close) OVER w AS d, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM p WINDOW w AS (PARTITION BY ticker ORDER BY k)),
 x1 AS (SELECT ticker, 'e12' AS series, k AS pos, close AS x, 12 AS n, 2 / 13 AS a FROM m UNION ALL SELECT ticker, 'e26', k, close, 26, 2 / 27 FROM m UNION ALL SELECT ticker, 'gain', k - 1, greatest(d, 0), 14, 1 / 14 FROM m WHERE k > 1
  UNION ALL SELECT ticker, 'loss', k - 1, greatest(-d, 0), 14, 1 / 14 FROM m WHERE k > 1 UNION ALL SELECT ticker, 'atr', k, tr, 14, 1 / 14 FROM m),
 {_SMOOTHED.format(1, "x1")},
 x2 AS (SELECT f.ticker, 'signal' AS series, f.pos - 25 AS pos, f.s - g.s AS x, 9 AS n, 2 / 10 AS a FROM s1 f JOIN s1 g ON g.ticker = f.ticker AND g.pos = f.pos WHERE f.series = 'e12' AND g.series = 'e26'),
 {_SMOOTHED.format(2, "x2")}
 SELECT p.ticker, p.k, round(CASE WHEN l.s = 0 THEN 100 - 100 / 101 ELSE 100 - 100 / (1 + g.s / l.s) END, 6) AS rsi, round(x2.x + 1e-5, 3) AS macd, round(s2.s + 1e-5, 3) AS signal, round(t.s + 1e-5, 3) AS atr
 FROM p LEFT JOIN s1 g ON g.ticker = p.ticker AND g.series = 'gain' AND g.pos = p.k - 1 LEFT JOIN s1 l ON l.ticker = p.ticker AND l.series = 'loss' AND l.pos = p.k - 1
 LEFT JOIN s1 t ON t.ticker = p.ticker AND t.series = 'atr' AND t.pos = p.k LEFT JOIN x2 ON x2.ticker = p.ticker AND x2.pos = p.k - 25 LEFT JOIN s2 ON s2.ticker = p.ticker AND s2.pos = p.k - 25""")
def indicators_recursive(spark, sf_dir):
    """Prices' measures are shifted by 0.00001, as halves of a thousandth occur in them."""
    got, shifted = indicators.with_indicators(_prices(spark, sf_dir), date="k"), lambda c: F.round(F.col(c) + 1e-5, 3)
    return got.select("ticker", "k", F.round("rsi", 6).alias("rsi"), shifted("macd").alias("macd"), shifted("macdSignal").alias("signal"), shifted("atr").alias("atr"))


# --- matrices: l_linenumber x nation-like grids

_M = "SELECT CAST(l_suppkey % 7 AS INTEGER) AS i, CAST(l_partkey % 7 AS INTEGER) AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2"


def _matrix(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).cast("int").alias("i"), (F.col("l_partkey") % 7).cast("int").alias("j"))
    return df.agg(F.count(F.lit(1)).cast("double").alias("v"))


@query(f"WITH m AS ({_M}) SELECT a.i, b.j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.j = b.i GROUP BY 1, 2")
def matrix_multiply(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return matrix.multiply(m, m)


@query(f"WITH m AS ({_M}) SELECT m.i, m.j, m.v + t.v - 2 * m.v AS v FROM m JOIN m t ON m.i = t.j AND m.j = t.i")
def matrix_cells(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return matrix.subtract(matrix.add(m, matrix.transpose(m)), matrix.scale(m, 2.0))


@query(f"WITH m AS ({_M}) SELECT round(sqrt(sum(v * v)), 6) AS norm, (SELECT sum(v) FROM m WHERE i = j) AS trace FROM m")
def matrix_norm_trace(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return matrix.norm(m).select(F.round("value", 6).alias("norm")).crossJoin(matrix.trace(m).withColumnRenamed("value", "trace"))


@query(f"WITH m AS ({_M}) SELECT CAST(i - CASE WHEN i > 2 THEN 1 ELSE 0 END AS INTEGER) AS i, CAST(j - CASE WHEN j > 3 THEN 1 ELSE 0 END AS INTEGER) AS j, v FROM m WHERE i <> 2 AND j <> 3")
def matrix_minor(spark, sf_dir):
    return matrix.minor(_matrix(spark, sf_dir), 2, 3)


@query(f"WITH m AS ({_M}) SELECT j, arg_max(i, v * 1000 - i) AS i, max(v) AS v FROM m GROUP BY 1")
def matrix_column_max(spark, sf_dir):
    return matrix.column_max(_matrix(spark, sf_dir))


@query(f"WITH m AS ({_M}) SELECT i, j, CAST(i = j AS DOUBLE) AS v FROM m")
def matrix_inverse_times_self(spark, sf_dir):
    m = matrix.mapped(_matrix(spark, sf_dir), lambda v, i, j: F.when(i == j, v + 1000.0).otherwise(v))
    return matrix.mapped(matrix.multiply(m, matrix.dense(m, matrix.inverse)), lambda v, i, j: F.round(v, 6) + 0.0)


_M3 = f"SELECT i, j, v + CASE WHEN i = j THEN 1000 ELSE 0 END AS v FROM ({_M}) WHERE i < 3 AND j < 3"


def _matrix3(spark, sf_dir):
    """The first three rows and columns, with a diagonal that keeps them regular."""
    return matrix.mapped(matrix.sub_matrix(_matrix(spark, sf_dir), 0, 0, 3, 3), lambda v, i, j: F.when(i == j, v + 1000.0).otherwise(v))


@query(f"WITH m AS ({_M3}), c AS (SELECT max(v) FILTER (i = 0 AND j = 0) AS a, max(v) FILTER (i = 0 AND j = 1) AS b, max(v) FILTER (i = 0 AND j = 2) AS c, max(v) FILTER (i = 1 AND j = 0) AS d, max(v) FILTER (i = 1 AND j = 1) AS e, max(v) FILTER (i = 1 AND j = 2) AS f, max(v) FILTER (i = 2 AND j = 0) AS g, max(v) FILTER (i = 2 AND j = 1) AS h, max(v) FILTER (i = 2 AND j = 2) AS k FROM m) SELECT round(a * (e * k - f * h) - b * (d * k - f * g) + c * (d * h - e * g), 0) AS determinant, round(a * (e * k - f * h) - b * (d * k - f * g) + c * (d * h - e * g), 0) AS by_cofactors, CAST(3 AS DOUBLE) AS rank FROM c")
def matrix_determinants(spark, sf_dir):
    m = _matrix3(spark, sf_dir)
    one = lambda f, name: matrix.dense(m, f).select(F.round("v", 0).alias(name))
    return one(matrix.np.linalg.det, "determinant").crossJoin(one(matrix.determinant_by_cofactors, "by_cofactors")).crossJoin(one(matrix.rank, "rank"))


@query(f"WITH m AS ({_M3}) SELECT i, j, v AS lu, CAST(i = j AS DOUBLE) AS unit, CAST(i = j AS DOUBLE) AS reduced FROM m")
def matrix_factors(spark, sf_dir):
    """L times U is the matrix again, the inverse by the adjoint times it and its reduced echelon form the identity."""
    m, near = _matrix3(spark, sf_dir), lambda v, i, j: F.round(v, 6) + 0.0

    def again(a):
        lower, upper = matrix.lu(a)
        return lower @ upper

    lu = matrix.mapped(matrix.dense(m, again), near).withColumnRenamed("v", "lu")
    unit = matrix.mapped(matrix.multiply(m, matrix.dense(m, matrix.inverse_by_adjoint)), near).withColumnRenamed("v", "unit")
    return lu.join(unit, ["i", "j"]).join(matrix.mapped(matrix.dense(m, matrix.echelon), near).withColumnRenamed("v", "reduced"), ["i", "j"])


@query(f"WITH m AS ({_M}) SELECT m.i, m.j, CASE WHEN m.i BETWEEN 2 AND 3 AND m.j BETWEEN 1 AND 2 THEN b.v ELSE m.v END AS v FROM m LEFT JOIN m b ON b.i = m.i - 2 AND b.j = m.j - 1")
def matrix_blocks(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return matrix.overlay(m, matrix.sub_matrix(m, 0, 0, 2, 2), 2, 1)


@query("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, pow(i / 2 - 1, j) AS v FROM range(5) a(i), range(4) b(j)")
def matrix_vandermonde(spark, sf_dir):
    return matrix.vandermonde(spark, [-1.0, -0.5, 0.0, 0.5, 1.0], 4)


@query(f"WITH m AS ({_M}) SELECT true AS both, (SELECT bool_and(m.v = t.v) FROM m JOIN m t ON m.i = t.j AND m.j = t.i) AS alone, true AS square")
def matrix_symmetry(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    of = lambda x, name: x.withColumnRenamed("value", name)
    return of(matrix.is_symmetric(matrix.add(m, matrix.transpose(m))), "both").crossJoin(of(matrix.is_symmetric(m), "alone")).crossJoin(of(matrix.is_square(m), "square"))


@query("SELECT r_regionkey AS id, CAST(least(0, 0) AS INTEGER) AS depth, (SELECT max(x) FROM (SELECT min(c_acctbal) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey GROUP BY n_nationkey)) AS value FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey)")
def trees_minimax(spark, sf_dir):
    """Regions choose the nation whose least balance is largest."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    none = F.lit(None)
    of = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    used = n.join(c.select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_semi")
    roots = used.select(of("r", "n_regionkey").alias("id"), none.cast("string").alias("parent"), none.cast("double").alias("value")).distinct()
    nodes = roots.unionAll(used.select(of("n", "n_nationkey"), of("r", "n_regionkey"), none.cast("double"))).unionAll(c.select(of("c", "c_custkey"), of("n", "c_nationkey"), "c_acctbal"))
    return learn.tree_values(nodes, 2).select(F.substr("id", F.lit(2)).cast("int").alias("id"), F.lit(0).alias("depth"), "value")


# --- learning, text metrics, graphs


@query("SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def text_edit_distance(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")), n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))
    return a.join(b, F.col("i") < F.col("j")).select("a", "b", learn.edit_distance(F.col("a"), F.col("b")).alias("distance"))


def _graph(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nodes = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("region").alias("type"), F.col("r_name").alias("label")).unionAll(n.select(F.concat(F.lit("n"), "n_nationkey"), F.lit("nation"), "n_name"))
    return nodes, n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("in").alias("type"))


@query("SELECT 'node' AS what, 'nation' AS type, count(*) AS n FROM nation UNION ALL SELECT 'node', 'region', count(*) FROM region UNION ALL SELECT 'edge', 'in', count(*) FROM nation")
def graph_stats(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return learn.stats(learn.add_nodes(nodes, nodes), edges)


@query("SELECT 'n' || n_nationkey AS src, 'r2' AS dst, 'in' AS type FROM nation WHERE n_regionkey = 2")
def graph_edges_to(spark, sf_dir):
    return learn.edges_of(_graph(spark, sf_dir)[1], "r2", out=False)


@query("""WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS doc, 'term' AS kind, regexp_extract_all(text, '\\b[A-Z][a-z]{4,}\\b') AS l, 20 AS most FROM documents
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'concept', regexp_extract_all(text, '\\b[A-Z][a-z]+ [A-Z][a-z]+\\b'), 15 FROM documents),
 p AS (SELECT doc, kind, most, unnest(l) AS e, unnest(range(len(l))) AS pos FROM e),
 d AS (SELECT doc, kind, most, e, min(pos) AS pos FROM p GROUP BY ALL),
 r AS (SELECT doc, kind, e, row_number() OVER (PARTITION BY doc, kind ORDER BY pos) AS k FROM d QUALIFY k <= most),
 s AS (SELECT doc, e, row_number() OVER (PARTITION BY doc ORDER BY kind DESC, k) AS place FROM r QUALIFY place <= 10)
 SELECT doc AS src, e AS dst, CASE kind WHEN 'term' THEN 'contains_term' ELSE 'describes_concept' END AS type FROM r
 UNION SELECT a.e, b.e, 'related_to' FROM s a JOIN s b ON a.doc = b.doc AND a.place < b.place""")
def graph_build(spark, sf_dir):
    return learn.knowledge_graph(table(spark, sf_dir, "documents"), "doc_id", "text")[1]


# --- transforms


@query("SELECT c_custkey, upper(substr(c_name, 1, 1)) || substr(c_name, 2) AS cap, replace(replace(c_name, '#', '_'), '_', ' ') AS spaced, c_name || '!' AS app, substr(c_name, 1, 1) AS first, starts_with(c_name, 'Cust') AS starts, CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal > 5000 THEN 5000.0 ELSE c_acctbal END AS clamped, upper(c_mktsegment) AS up FROM customer")
def transforms_strings(spark, sf_dir):
    c, t = F.col("c_name"), text.transform
    return table(spark, sf_dir, "customer").select(
        "c_custkey", t("String", "Capitalize", c).alias("cap"), t("String", "Deunderscore", F.replace(c, F.lit("#"), F.lit("_"))).alias("spaced"), t("String", "Append", c, "!").alias("app"), t("String", "CharAt", c, 0).alias("first"),
        t("String", "StartsWith", c, "Cust").alias("starts"), t("Number", "RangeLimit", F.col("c_acctbal"), 0.0, 5000.0).alias("clamped"), t("String", "UpperCase", F.col("c_mktsegment")).alias("up"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' AS inside FROM orders")
def transforms_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.transform("Date", "ISODate", d).alias("iso"), text.transform("Date", "isBetween", d, F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz")).alias("inside"))


@query("SELECT n_nationkey, n_nationkey || ',' || n_name || ',' || n_regionkey AS line, n_name AS cell FROM nation")
def transforms_csv(spark, sf_dir):
    line = F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", line.alias("line"), formats.csv_cells(line)[1].alias("cell"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def transforms_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(text.transform("String", "JSON", F.col("props")), "$.k", "bigint").alias("k"))


@query("SELECT c_custkey, c_name AS name FROM customer")
def transforms_compression(spark, sf_dir):
    c = formats.compress(formats.compress(F.col("c_name"), "gzip"), "snappy")
    back = formats.decompress(formats.decompress(c, "snappy"), "gzip")
    return table(spark, sf_dir, "customer").select("c_custkey", F.decode(back, "UTF-8").alias("name"))


@query("SELECT s_suppkey, s_name AS name FROM supplier")
def transforms_avro(spark, sf_dir):
    schema = {"type": "record", "name": "s", "fields": [{"name": "name", "type": ["null", "string"]}]}
    a = formats.avro_to_json(formats.json_to_avro(F.to_json(F.struct(F.col("s_name").alias("name"))), schema), schema)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.get_json_object(a, "$.name").alias("name"))


@query("WITH t AS (SELECT o_custkey, unnest(list(o_orderkey ORDER BY o_orderkey)) AS value, unnest(range(count(*))) AS index FROM orders GROUP BY 1) SELECT o_custkey, CAST(index AS INTEGER) AS index, value FROM t")
def transforms_messages(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"))
    return formats.messages(a, "a")


@query("""SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS title,
 split_part(p_name, ' ', 1) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS camel, replace(p_name, ' ', '-') AS dashed, split_part(p_name, ' ', 2) AS second,
 '&lt;' || p_name || '&gt;' AS xml, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS parts, p_name AS trimmed, lower(p_brand) LIKE 'brand#13%' OR lower(p_brand) LIKE 'brand#5%' AS listed FROM part""")
def transforms_words(spark, sf_dir):
    c, t = F.col("p_name"), text.transform
    return table(spark, sf_dir, "part").select(
        "p_partkey", t("String", "Title", c).alias("title"), t("String", "Camelize", c).alias("camel"), t("String", "DelimiterOnCase", c, "-").alias("dashed"), t("String", "GetWord", c, 2).alias("second"),
        t("String", "XmlStringEncode", F.concat(F.lit("<"), c, F.lit(">"))).alias("xml"), t("String", "ArrayByDelimiter", c, " ").alias("parts"), t("String", "Trim", F.concat(F.lit(" \t"), c, F.lit("\n "))).alias("trimmed"),
        t("String", "StartsWithList", F.col("p_brand"), ["BRAND#5", "brand#13"], True).alias("listed"),
    )


@query("""SELECT c_custkey, c_custkey AS whole, c_acctbal AS real, c_acctbal AS number, c_acctbal BETWEEN 0 AND 1000 AS inside, greatest(least(c_custkey, 50), 10) AS clamped,
 nullif(c_nationkey, 3) AS other, coalesce(nullif(c_nationkey, 3), 99) AS filled FROM customer""")
def transforms_numbers(spark, sf_dir):
    t, text_of = text.transform, F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", t("String", "Integer", F.concat(F.col("c_custkey").cast("string"), F.lit("px"))).alias("whole"), t("String", "Float", F.concat(text_of, F.lit(" USD"))).alias("real"), t("String", "Number", text_of).alias("number"),
        t("Number", "isBetween", F.col("c_acctbal"), 0, 1000).alias("inside"), t("BigInt", "RangeLimit", F.col("c_custkey"), 10, 50).alias("clamped"), t("Object", "Nullif", F.col("c_nationkey"), 3).alias("other"),
        t("Object", "Coalesce", t("Object", "Nullif", F.col("c_nationkey"), 3), 99).alias("filled"),
    )


@query("""SELECT s_suppkey, s_name || '.tar.gz' AS base, '/data/n' || s_nationkey AS dir, '.gz' AS ext, '/data/n' || s_nationkey || '/' || s_name || '.tar.gz' AS normal, true AS absolute,
 '/data/n' || s_nationkey || '/x/' || s_name AS resolved, 'n' || s_nationkey || '/' || s_name AS joined FROM supplier""")
def transforms_paths(spark, sf_dir):
    folder = F.concat(F.lit("/data/n"), F.col("s_nationkey").cast("string"))
    path = F.concat(folder, F.lit("/"), "s_name", F.lit(".tar.gz"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", text.basename(path).alias("base"), text.dirname(path).alias("dir"), text.extname(path).alias("ext"), text.normalize_path(F.concat(F.lit("/data/./old/..//n"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name", F.lit(".tar.gz"))).alias("normal"),
        text.transform("path", "IsAbsolute", path).alias("absolute"), text.resolve_path(F.concat(F.lit("x/../x/"), "s_name"), "/data/n").alias("r"), folder.alias("f"), text.join_path(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), F.lit("./"), F.col("s_name")).alias("joined"),
    ).select("s_suppkey", "base", "dir", "ext", "normal", "absolute", F.concat("f", F.substr("r", F.lit(8))).alias("resolved"), "joined")


@query("SELECT n_nationkey, '<name>' || n_name || '</name>' AS xml, n_name AS xml_name, n_name AS xlsx_name, [CAST(n_nationkey AS DOUBLE), n_regionkey + 0.5] AS npy, n_name AS framed, n_name AS field, '<table><tr><td><![CDATA[' || n_name || ']]></td></tr></table>' AS html FROM nation")
def transforms_round_trips(spark, sf_dir):
    """XML, XLSX, npy, framed Avro and bitmap messages, each written and read back; a table of HTML."""
    a, schema = registry.apply, {"type": "record", "name": "r", "fields": [{"name": "name", "type": "string"}]}
    name, obj = F.col("n_name"), F.to_json(F.struct(F.col("n_name").alias("name")))
    xml = a("JSONToXML", obj)
    sheet = F.to_json(F.struct(F.array(F.array(F.lit("name")), F.array(name)).alias("s")))
    npy = F.to_json(F.struct(F.lit("<f8").alias("dataType"), F.array(F.lit(2)).alias("shape"), F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey") + 0.5).alias("dataVector")))
    framed = F.to_json(F.struct(F.lit(7).alias("schema"), F.struct(name.alias("name")).alias("data")))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", xml.alias("xml"), F.get_json_object(a("XMLToJSON", xml), "$.name").alias("xml_name"), F.get_json_object(a("XLSXToJSON", a("JSONToXLSX", sheet)), "$.s[1][0]").alias("xlsx_name"),
        a("npyToNumPyObject", a("JSONTonpy", npy))["dataVector"].alias("npy"), F.get_json_object(a("ConfluenceToJSON", a("JSONToConfluence", framed, schemas={7: schema}), schemas={7: schema}), "$.data.name").alias("framed"),
        F.get_json_object(a("ISO8385ToJSON", a("JSONToISO8385", obj, names={43: "name"}), names={43: "name"}), "$.name").alias("field"), a("ArrayToHTML", F.array(F.array(name))).alias("html"),
    )


# --- real time


@query(f"""SELECT event_id, count(value) {_WIN} ROWS UNBOUNDED PRECEDING) AS count, min(value) {_WIN} ROWS UNBOUNDED PRECEDING) AS min, max(value) {_WIN} ROWS UNBOUNDED PRECEDING) AS max, round(avg(value) {_WIN} ROWS UNBOUNDED PRECEDING), 9) AS avg,
 round(avg(value) {_WIN} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) AS moving_avg, value - lag(value) {_WIN}) AS delta FROM events""")
def realtime_metrics(spark, sf_dir):
    m = rt.metrics(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return m.select("event_id", "count", "min", "max", F.round("avg", 9).alias("avg"), F.round("moving_avg", 9).alias("moving_avg"), "delta")


@query(f"WITH z AS (SELECT event_id, (value - avg(value) {_WIN} ROWS UNBOUNDED PRECEDING)) / nullif(stddev_pop(value) {_WIN} ROWS UNBOUNDED PRECEDING), 0) AS z FROM events) SELECT event_id, round(z, 5) AS standardized FROM z WHERE abs(z) > 2")
def realtime_outliers(spark, sf_dir):
    m = rt.metrics(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return rt.outliers(m, 2.0).select("event_id", F.round("standardized", 5).alias("standardized"))


@query("SELECT event_type, min(value) AS min, max(value) AS max, max(value) - min(value) AS range, round(avg(value), 6) AS average, count(value) AS count FROM events GROUP BY 1")
def realtime_accumulated(spark, sf_dir):
    return rt.accumulated(table(spark, sf_dir, "events"), "value", ["event_type"]).withColumn("average", F.round("average", 6))


@query("WITH s AS (SELECT event_id, event_type, lag(event_type) OVER w AS b, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, event_type FROM s WHERE k = 1 OR event_type <> b")
def realtime_state_changes(spark, sf_dir):
    return rt.state_changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "event_type")


@query("""WITH w AS (SELECT ts, unnest([0, 1]) AS k FROM events), b AS (SELECT time_bucket(INTERVAL '5 minutes', ts) - k * INTERVAL '5 minutes' AS start FROM w) SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM b GROUP BY 1""")
def realtime_rates(spark, sf_dir):
    got = rt.rates(table(spark, sf_dir, "events"), "ts", spans=("10 minutes",), slide="5 minutes")["10 minutes"]
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


_LATEST = f"WITH m AS (SELECT event_id, user_id, value, value - lag(value) {_WIN}) AS delta, avg(value) {_WIN} ROWS UNBOUNDED PRECEDING) AS mean, max(value) {_WIN} ROWS UNBOUNDED PRECEDING) - min(value) {_WIN} ROWS UNBOUNDED PRECEDING) AS r, avg(value) {_WIN} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving FROM events), l AS (SELECT user_id, arg_max(struct_pack(value, delta, moving, n := CASE WHEN r > 0 THEN (value - mean) / r ELSE 0 END), event_id) AS s FROM m GROUP BY 1)"


def _latest(spark, sf_dir):
    return rt.latest(rt.metrics(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").withColumn("value", F.col("value").cast("double")), "user_id", "event_id")


@query(f"{_LATEST} SELECT user_id, round(s.n - (SELECT avg(s.n) FROM l), 6) AS value FROM l")
def realtime_cross_normalised(spark, sf_dir):
    return rt.cross_normalised(_latest(spark, sf_dir)).select("user_id", F.round("value", 6).alias("value"))


@query(f"{_LATEST} SELECT user_id, round(s.value + s.delta, 6) AS by_delta, round(2 * s.value - s.moving, 6) AS by_average FROM l")
def realtime_forecasts(spark, sf_dir):
    f = rt.forecasts(F.col("value"), F.col("delta"), F.col("moving_avg"), F.col("moving_delta"))
    return _latest(spark, sf_dir).select("user_id", F.round(f[0], 6).alias("by_delta"), F.round(f[2], 6).alias("by_average"))


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE value IS NOT NULL),
 g AS (SELECT user_id, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_pop(value) AS sd, max(value) FILTER (k = 1) AS x, median(value) FILTER (k <= 3) AS mid FROM r GROUP BY 1)
 SELECT CAST(user_id AS VARCHAR) AS key, n AS count, round(s, 4) AS sum, lo AS min, hi AS max, round(mean, 9) AS avg, round(mid, 9) AS median, sd > 0 AND abs(x - mean) > 3 * sd AS outlier FROM g""")
def realtime_stream(spark, sf_dir):
    """A stream over the events, be they a file or a folder of them, run to its end, as the table that it wrote."""
    source = f"{sf_dir}/events.parquet"
    schema, at = spark.read.parquet(source).schema, shared_path(spark, "stream")
    stream = spark.readStream.schema(schema).parquet(*_folder(spark, source))
    out = rt.realtime(stream, "user_id", "value", "event_id")
    kind = out.schema
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).outputMode("append").start(f"{at}/out")
    run.awaitTermination()
    got = spark.read.schema(kind).parquet(f"{at}/out")
    return got.select("key", "count", F.round("sum", 4).alias("sum"), "min", "max", F.round("avg", 9).alias("avg"), F.round("median", 9).alias("median"), "outlier")


def _folder(spark, path: str) -> list[str]:
    """What a stream reads: a folder as it is, a file by a pattern that only it has."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    one = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return [path.replace("events.parquet", "{events.parquet}")] if one else [path]
