"""Queries of decisions, learning, graphs, indicators, forecasts and control of real-time results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decisions as de
from ..operators import indicators, learn
from ..operators import statistics as st
from ..sources.shared import shared_path
from ..streaming import realtime as rt
from .queries import _LATEST, _PRICES, _SMOOTHED, _WIN, _folder, _graph, _latest, _prices, query, table

_T = """t AS (SELECT conv_id, turn, coalesce(text, '') AS t, regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+') AS w FROM conversations),
 s AS (SELECT conv_id, turn, t, CAST(length(t) AS INTEGER) AS length, CAST(len(w) AS INTEGER) AS word_count, CAST(len(regexp_extract_all(t, '[.!?]+')) AS INTEGER) AS sentence_count, contains(t, '?') AS has_question, contains(t, '!') AS has_exclamation, regexp_matches(t, '[0-9]') AS has_numbers,
  contains(lower(t), 'the') AND contains(lower(t), 'you') OR contains(lower(t), 'price') AS has_keywords, CASE WHEN length(t) = 0 THEN 0.0 ELSE CAST(len(regexp_extract_all(t, '[A-Z]')) AS DOUBLE) / length(t) END AS capital_ratio,
  CAST(len(list_filter(w, lambda x: length(x) > 6)) AS DOUBLE) / len(w) AS complexity, length(t) / 100 + len(w) / 10 AS estimated_cost FROM t)"""


def _signals() -> dict:
    s = de.signals(F.col("text"), ["price"])
    return s | {"has_keywords": s["has_keywords"] | (de.signals(F.col("text"), ["the"])["has_keywords"] & de.signals(F.col("text"), ["you"])["has_keywords"])}


@query(f"WITH {_T} SELECT conv_id, turn, length, word_count, sentence_count, has_question, has_exclamation, has_numbers, has_keywords, round(capital_ratio, 9) AS capital_ratio, round(complexity, 9) AS complexity, round(estimated_cost, 6) AS estimated_cost FROM s")
def text_signals(spark, sf_dir):
    s = _signals()
    places = {"capital_ratio": 9, "complexity": 9, "estimated_cost": 6}
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *((F.round(c, places[k]) if k in places else c).alias(k) for k, c in s.items()))


_C = f"""WITH RECURSIVE {_T}, c AS (SELECT *, length > 900 AS long, complexity > 0.35 AS complex, sentence_count > 9 OR complexity > 0.35 AS wordy, NOT has_question AND has_exclamation AS urgent, has_numbers AND word_count < 30 AS data FROM s),
 u AS (SELECT *, CASE WHEN long THEN 'clarify' WHEN has_keywords THEN 'retrieve' WHEN wordy THEN 'clarify' WHEN urgent THEN 'escalate' WHEN data THEN 'retrieve' ELSE 'answer' END AS action,
  CASE WHEN long THEN 'query too long (tree node 1)' WHEN has_keywords THEN 'contains keywords (tree node 2)' WHEN wordy THEN 'high complexity (tree node 3)' WHEN urgent THEN 'urgent pattern (tree node 4)' WHEN data THEN 'data query (tree node 5)' ELSE 'default answer (tree leaf)' END AS reason,
  CAST(0.5 AS DOUBLE) AS pa, CAST(0.2 AS DOUBLE) * CASE WHEN long THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN complex THEN 1.4::DOUBLE ELSE 1 END AS pc, CAST(0.2 AS DOUBLE) * CASE WHEN has_keywords THEN 1.8::DOUBLE ELSE 1 END * CASE WHEN data THEN 1.6::DOUBLE ELSE 1 END AS pr, CAST(0.1 AS DOUBLE) * CASE WHEN urgent THEN 2.0::DOUBLE ELSE 1 END AS pe FROM c),
 p AS (SELECT *, pa / (pa + pc + pr + pe) AS qa, pc / (pa + pc + pr + pe) AS qc, pr / (pa + pc + pr + pe) AS qr, pe / (pa + pc + pr + pe) AS qe FROM u)"""


def _conditions() -> dict:
    return de.conditions(_signals(), longest=900, sentences=9, complexity=0.35, words=30)


@query(f"{_C} SELECT conv_id, turn, action, reason, round(qa, 9) AS answer, round(qc, 9) AS clarify, round(qr, 9) AS retrieve, round(qe, 9) AS escalate, CASE WHEN qe >= greatest(qa, qc, qr) THEN 'escalate' WHEN qr >= greatest(qa, qc) THEN 'retrieve' WHEN qc >= qa THEN 'clarify' ELSE 'answer' END AS likeliest FROM p")
def text_decisions(spark, sf_dir):
    c = _conditions()
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", de.tree(c).alias("d"), de.posteriors(c).alias("p"))
    return got.select("conv_id", "turn", "d.*", *(F.round(F.col(f"p.{a}"), 9).alias(a) for a in de.ACTIONS), de.likeliest(F.col("p")).alias("likeliest"))


_ARG = "CASE WHEN {e} >= greatest({a}, {c}, {r}) THEN 3 WHEN {r} >= greatest({a}, {c}) THEN 2 WHEN {c} >= {a} THEN 1 ELSE 0 END"
_NEXT = {k: f"(p.q{k} * CASE WHEN abs(p.complexity - x.complexity) > 0.3 THEN 0.95::DOUBLE ELSE 1 END * CASE WHEN x.act = {i} THEN 1.1::DOUBLE ELSE 1 END)" for i, k in enumerate("acre")}


@query(f"""{_C}, x AS (SELECT conv_id, turn, complexity, {_ARG.format(a="qa", c="qc", r="qr", e="qe")} AS act, greatest(qa, qc, qr, qe) AS confidence FROM p WHERE turn = 0
 UNION ALL SELECT p.conv_id, p.turn, p.complexity, {_ARG.format(**_NEXT)}, greatest({", ".join(_NEXT.values())}) / ({" + ".join(_NEXT.values())}) FROM x JOIN p ON p.conv_id = x.conv_id AND p.turn = x.turn + 1)
 SELECT conv_id, turn, ['answer', 'clarify', 'retrieve', 'escalate'][act + 1] AS action, round(confidence, 9) AS confidence FROM x""")
def text_beliefs(spark, sf_dir):
    """Decisions that follow the one before in their conversation."""
    c, s = _conditions(), _signals()
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", de.posteriors(c).alias("p"), s["complexity"].alias("complexity"))
    return de.sequential(rows, "conv_id", "turn", "p", "complexity").select("conv_id", "turn", "action", F.round("confidence", 9).alias("confidence"))


@query(f"""{_C} SELECT conv_id, turn, CASE WHEN floor(complexity * 5) / 5 = 0 THEN '0' WHEN floor(complexity * 5) / 5 = 1 THEN '1' ELSE printf('%.1f', floor(complexity * 5) / 5) END || '_' || CASE WHEN length < 50 THEN 'short' WHEN length < 200 THEN 'medium' ELSE 'long' END || CASE WHEN has_keywords THEN '_kw' ELSE '_nokw' END || CASE WHEN has_question THEN '_quest' ELSE '_noquest' END AS state,
 CASE action WHEN 'answer' THEN 'response_generated' WHEN 'clarify' THEN 'clarification_requested' WHEN 'retrieve' THEN 'retrieval_initiated' ELSE 'escalated' END AS information, CASE action WHEN 'answer' THEN 'user receives answer' WHEN 'clarify' THEN 'user provides more context' WHEN 'retrieve' THEN 'knowledge base searched' ELSE 'human review required' END AS expected,
 CASE action WHEN 'answer' THEN 1 ELSE 2 END AS effects FROM u""")
def text_execution(spark, sf_dir):
    """The discrete state of a request and the log of its action, put together again from the four routes."""
    s = _signals()
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", de.state_of(s).alias("state"), de.tree(_conditions())["action"].alias("action"))
    routes = [r.withColumn("log", de.executed(F.lit(a))) for a, r in de.routed(got).items()]
    out = routes[0]
    for r in routes[1:]:
        out = out.unionAll(r)
    return out.select("conv_id", "turn", "state", F.col("log.state").alias("information"), F.col("log.expected").alias("expected"), F.size("log.effects").alias("effects"))


@query("SELECT conv_id, turn FROM conversations ORDER BY conv_id * 1000 + turn DESC LIMIT 100")
def text_diagnostics(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    return de.latest(c, "at").select("conv_id", "turn")


_FEEDBACK = "f AS (SELECT n_nationkey + 1 AS k, n_regionkey AS s, n_nationkey % 4 AS a, n_nationkey % 3 - 0.5::DOUBLE AS reward, (n_regionkey + 1) % 5 AS n FROM nation)"


def _policy(spark, sf_dir) -> de.Policy:
    n = table(spark, sf_dir, "nation")
    action = F.element_at(F.array(*map(F.lit, de.ACTIONS)), F.col("n_nationkey") % 4 + 1)
    feedback = n.select(F.col("n_regionkey").alias("state"), action.alias("action"), (F.col("n_nationkey") % 3 - 0.5).alias("reward"), ((F.col("n_regionkey") + 1) % 5).alias("next"), "n_nationkey")
    return de.Policy(spark.createDataFrame([], "state string, action string, q double")).learn(feedback, "n_nationkey")


_LEARNT = f"""WITH RECURSIVE {_FEEDBACK}, r AS (SELECT 0 AS k, list_transform(range(20), lambda i: 0.0::DOUBLE) AS q
 UNION ALL SELECT f.k, list_transform(q, lambda v, i: CASE WHEN i = f.s * 4 + f.a + 1 THEN v + 0.1 * (f.reward + 0.9 * list_max(q[f.n * 4 + 1 : f.n * 4 + 4]) - v) ELSE v END) FROM r JOIN f ON f.k = r.k + 1),
 z AS (SELECT q FROM r ORDER BY k DESC LIMIT 1)"""


@query(f"{_LEARNT} SELECT CAST(s AS VARCHAR) AS state, ['answer', 'clarify', 'retrieve', 'escalate'][a + 1] AS action, round(q[s * 4 + a + 1], 9) AS q FROM z, (SELECT DISTINCT s, a FROM f)")
def learning_values(spark, sf_dir):
    return _policy(spark, sf_dir).values.withColumn("q", F.round("q", 9))


@query(f"""{_LEARNT}, b AS (SELECT s, q[s * 4 + 1 : s * 4 + 4] AS v FROM z, (SELECT CAST(range AS INTEGER) AS s FROM range(5))) SELECT c_custkey, ['answer', 'clarify', 'retrieve', 'escalate'][list_position(v, list_max(v))] AS action,
 round(CASE WHEN list_sum(v) > 0 THEN list_max(v) / list_sum(v) ELSE 0.5 END, 9) AS confidence FROM customer JOIN b ON s = c_custkey % 5""")
def learning_policy(spark, sf_dir):
    requests = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 5).cast("string").alias("state"))
    return _policy(spark, sf_dir).best(requests, "state").select("c_custkey", "action", F.round("confidence", 9).alias("confidence"))


@query("SELECT o_orderkey, CAST(avg(CAST(o_totalprice > 150000 AS INT)) OVER w > 0.5 AS INTEGER) AS label_pred, round(avg(CAST(o_totalprice > 150000 AS INT)) OVER w, 4) AS proba, round(ln(avg(CAST(o_totalprice > 150000 AS INT)) OVER w / (1 - avg(CAST(o_totalprice > 150000 AS INT)) OVER w)), 3) AS decision FROM orders WINDOW w AS (PARTITION BY o_orderstatus)")
def logistic_regression(spark, sf_dir):
    """With an indicator for every group but one, the fitted probabilities are the groups' shares."""
    status = F.col("o_orderstatus")
    df = table(spark, sf_dir, "orders").select("o_orderkey", *((status == s).cast("double").alias(s) for s in ("F", "O")), (F.col("o_totalprice") > 150000).cast("int").alias("y"))
    got = learn.predict(learn.fit(df, ["F", "O"], "y", iterations=200, tol=1e-12), df)
    return got.select("o_orderkey", "label_pred", F.round("proba", 4).alias("proba"), F.round("decision", 3).alias("decision"))


# --- graphs


@query("SELECT 'n' || n_nationkey AS id, n_name AS label FROM nation WHERE n_nationkey < 7 UNION ALL SELECT 'x', 'NEW'")
def graph_nodes(spark, sf_dir):
    """Nodes of a type that a predicate holds for; of two nodes with an id the first one stays."""
    nodes, _ = _graph(spark, sf_dir)
    new = spark.createDataFrame([("x", "nation", "NEW"), ("n1", "nation", "OTHER")], "id string, type string, label string")
    return learn.nodes_of(learn.add_nodes(nodes, new), "nation", F.col("id").isin("x", *(f"n{i}" for i in range(7)))).select("id", "label")


@query("SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in' AS type FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'n3', 'n4', 'near'")
def graph_edges_from(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    new = spark.createDataFrame([("n3", "n4", "near"), ("n5", "n4", "near")], "src string, dst string, type string")
    return learn.edges_of(learn.add_edges(edges, new, nodes), "n3")


@query("""SELECT 'node' AS kind, '{"id":"r' || r_regionkey || '","type":"region","label":"' || r_name || '"}' AS json FROM region UNION ALL SELECT 'node', '{"id":"n' || n_nationkey || '","type":"nation","label":"' || n_name || '"}' FROM nation
 UNION ALL SELECT 'edge', '{"src":"n' || n_nationkey || '","dst":"r' || n_regionkey || '","type":"in"}' FROM nation""")
def graph_json(spark, sf_dir):
    return learn.graph_json(*_graph(spark, sf_dir))


# --- indicators: values move by what keeps exact halves from being rounded

_W = "OVER (PARTITION BY ticker ORDER BY k ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(f"""WITH RECURSIVE p AS ({_PRICES}), m AS (SELECT *, close - lag(close) OVER w AS d, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM p WINDOW w AS (PARTITION BY ticker ORDER BY k)),
 x1 AS (SELECT ticker, 'e12' AS series, k AS pos, close AS x, 12 AS n, 2 / 13 AS a FROM m UNION ALL SELECT ticker, 'e26', k, close, 26, 2 / 27 FROM m UNION ALL SELECT ticker, 'gain', k - 1, greatest(d, 0), 14, 1 / 14 FROM m WHERE k > 1
  UNION ALL SELECT ticker, 'loss', k - 1, greatest(-d, 0), 14, 1 / 14 FROM m WHERE k > 1 UNION ALL SELECT ticker, 'atr', k, tr, 14, 1 / 14 FROM m),
 {_SMOOTHED.format(1, "x1")},
 x2 AS (SELECT f.ticker, 'signal' AS series, f.pos - 25 AS pos, f.s - g.s AS x, 9 AS n, 2 / 10 AS a FROM s1 f JOIN s1 g ON g.ticker = f.ticker AND g.pos = f.pos WHERE f.series = 'e12' AND g.series = 'e26'),
 {_SMOOTHED.format(2, "x2")},
 st AS (SELECT ticker, k, close, CASE WHEN k >= 14 THEN CASE WHEN max(high) {_W.format(13)} = min(low) {_W.format(13)} THEN 50 ELSE (close - min(low) {_W.format(13)}) / (max(high) {_W.format(13)} - min(low) {_W.format(13)}) * 100 END END AS fast FROM p),
 w AS (SELECT ticker, k, CASE WHEN k >= 50 THEN avg(close) {_W.format(49)} END AS sma50, CASE WHEN k >= 200 THEN avg(close) {_W.format(199)} END AS sma200, CASE WHEN k >= 20 THEN avg(close) {_W.format(19)} + 2 * stddev_pop(close) {_W.format(19)} END AS upper, CASE WHEN k >= 20 THEN avg(close) {_W.format(19)} - 2 * stddev_pop(close) {_W.format(19)} END AS lower,
  CASE WHEN k >= 16 THEN avg(fast) {_W.format(2)} END AS slow FROM st)
 SELECT w.ticker, w.k, round(sma50 + 0.00013, 3) AS sma50, round(sma200 + 0.00013, 3) AS sma200, round(upper + 0.00013, 2) AS upper, round(lower + 0.00013, 2) AS lower, round(slow + 0.0000013, 4) AS slow, round(CASE WHEN l.s = 0 THEN 100 - 100 / 101 ELSE 100 - 100 / (1 + g.s / l.s) END + 0.0000013, 4) AS rsi, round(x2.x + 0.00013, 3) AS macd,
 round(x2.x - s2.s + 0.00013, 3) AS hist, round(t.s + 0.00013, 3) AS atr
 FROM w LEFT JOIN s1 g ON g.ticker = w.ticker AND g.series = 'gain' AND g.pos = w.k - 1 LEFT JOIN s1 l ON l.ticker = w.ticker AND l.series = 'loss' AND l.pos = w.k - 1
 LEFT JOIN s1 t ON t.ticker = w.ticker AND t.series = 'atr' AND t.pos = w.k LEFT JOIN x2 ON x2.ticker = w.ticker AND x2.pos = w.k - 25 LEFT JOIN s2 ON s2.ticker = w.ticker AND s2.pos = w.k - 25""")
def indicators_all(spark, sf_dir):
    moved = lambda c, by, places: F.round(F.col(c) + by, places)
    got = indicators.with_indicators(_prices(spark, sf_dir), date="k")
    return got.select(
        "ticker", "k", moved("sma50", 0.00013, 3).alias("sma50"), moved("sma200", 0.00013, 3).alias("sma200"), moved("bbUpper", 0.00013, 2).alias("upper"), moved("bbLower", 0.00013, 2).alias("lower"), moved("stochD", 0.0000013, 4).alias("slow"),
        moved("rsi", 0.0000013, 4).alias("rsi"), moved("macd", 0.00013, 3).alias("macd"), moved("macdHist", 0.00013, 3).alias("hist"), moved("atr", 0.00013, 3).alias("atr"),
    )


# --- real time


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CAST(value AS DOUBLE) AS v, value - lag(value) {_WIN}) AS d, row_number() {_WIN}) AS k FROM events),
 f AS (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS f, unnest([0, 1, 2]) AS i), s AS (SELECT user_id, i, f, k, v AS s, 1::DOUBLE AS w FROM e, f WHERE k = 1 UNION ALL SELECT s.user_id, s.i, s.f, e.k, e.v + (1 - s.f) * s.s, 1 + (1 - s.f) * s.w FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1),
 z AS (SELECT user_id, max(k) AS n, arg_max(v, k) AS v, arg_max(d, k) AS d FROM e GROUP BY 1), m AS (SELECT user_id, avg(d) AS md FROM (SELECT user_id, d, k, max(k) OVER (PARTITION BY user_id) AS n FROM e) WHERE k > n - 3 GROUP BY 1)
 SELECT user_id, round(v + d, 6) AS by_delta, round(v + md, 6) AS by_moving, round(2 * v - max(s.s / s.w) FILTER (i = 0), 6) AS by_ema0, round(2 * v - max(s.s / s.w) FILTER (i = 1), 6) AS by_ema1, round(2 * v - max(s.s / s.w) FILTER (i = 2), 6) AS by_ema2 FROM z JOIN m USING (user_id) JOIN s USING (user_id) WHERE s.k = n GROUP BY user_id, v, d, md""")
def realtime_smoothed_forecasts(spark, sf_dir):
    """Forecasts by the last and moving deltas and by the three smoothed values of the streaming state."""
    from ..operators.scan import scan

    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").cast("double").alias("value"))

    def step(state: list, v: float) -> tuple:
        state[0] = rt.step(state[0], [v], 3)
        return tuple(a / b for a, b in zip(state[0][-2], state[0][-1]))

    smoothed = scan(e, ["user_id"], ["ts", "event_id"], ["value"], lambda: [None], step, ["e0", "e1", "e2"])
    last = rt.latest(rt.metrics(smoothed, "user_id", ["ts", "event_id"], "value"), "user_id", "event_id")
    f = rt.forecasts(F.col("value"), F.col("delta"), F.col("moving_avg"), F.col("moving_delta"), [F.col("e0"), F.col("e1"), F.col("e2")])
    return last.select("user_id", *(F.round(f[i], 6).alias(n) for i, n in ((0, "by_delta"), (1, "by_moving"), (3, "by_ema0"), (4, "by_ema1"), (5, "by_ema2"))))


def _results(spark, sf_dir) -> DataFrame:
    return _latest(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), F.round("normalised", 9).alias("normalised"))


_R = f"{_LATEST}, r AS (SELECT CAST(user_id AS VARCHAR) AS key, round(s.n, 9) AS normalised FROM l)"


@query(f"""{_R} SELECT 'all' AS topic, key, normalised FROM r UNION ALL SELECT 'set', key, CASE WHEN key = '3' THEN 0.5 ELSE normalised END FROM r UNION ALL SELECT 'reset', key, CASE WHEN key = '3' THEN 0.5 ELSE normalised END FROM r WHERE key <> '4'
 UNION ALL SELECT 'cross', key, round(normalised - (SELECT avg(normalised) FROM r), 6) FROM r UNION ALL SELECT 'replaced', 'x', 1.0""")
def realtime_control(spark, sf_dir):
    c = rt.Control(_results(spark, sf_dir))
    one = lambda v, key="": spark.createDataFrame([(key, v)], "key string, normalised double")
    label = lambda topic, df: df.select(F.lit(topic).alias("topic"), "key", F.col(df.columns[1]).alias("normalised"))
    out = label("all", c.on("@stats")).unionAll(label("cross", c.on("@deltasCrossNormalised").withColumn("value", F.round("value", 6))))
    out = out.unionAll(label("set", c.on("@stats set 3", one(0.5)))).unionAll(label("reset", c.on("@stats reset 4")))
    c.on("@stats reset")
    return out.unionAll(label("replaced", c.on("@stats set", one(1.0, "x"))))


@query("SELECT event_id, place, place // 99 AS batch, place // 99 * 100 AS due FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place FROM events)")
def realtime_batches(spark, sf_dir):
    return rt.batched(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "place", "batch", "due")


@query(f"""WITH m AS (SELECT event_id, value, median(value) {_WIN} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS mid, stddev_pop(value) {_WIN} ROWS UNBOUNDED PRECEDING) AS sd FROM events) SELECT event_id, round(mid, 6) AS median FROM m WHERE abs(value - mid) > sd""")
def realtime_median_outliers(spark, sf_dir):
    return rt.median_outliers(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 1.0).select("event_id", F.round("median", 6).alias("median"))


@query("""WITH g AS (SELECT user_id, ts, sum(CASE WHEN ts - b < INTERVAL 1 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events))
 SELECT 'session' AS kind, user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s UNION ALL SELECT 'tumbling', user_id, strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H:%M:%S'), count(*) FROM events GROUP BY 2, 3""")
def realtime_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    label = lambda kind, df: df.select(F.lit(kind).alias("kind"), "user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
    return label("session", rt.sessions(e, "ts", "1 hour", ["user_id"])).unionAll(label("tumbling", rt.tumbling(e, "ts", "6 hours", ["user_id"])))


@query("SELECT user_id, count(value) AS n, round(corr(value, event_id), 6) AS r FROM events GROUP BY 1 HAVING count(*) > 2")
def realtime_pearson(spark, sf_dir):
    """Pearson's sums kept by a stream over the events, run to its end."""
    source, at = f"{sf_dir}/events.parquet", shared_path(spark, "pearson")
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(*_folder(spark, source))
    sums = stream.groupBy("user_id").agg(F.count("value").alias("n"), F.round(st.pearson(F.col("value"), F.col("event_id")), 6).alias("r"))
    run = sums.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{at}/out")).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out").where("n > 2")
