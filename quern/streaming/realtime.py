"""Keyed real-time metrics: the same measures over a finished table and over a stream, outliers, rates, state changes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACTORS = (0.25, 0.5, 0.75)


def metrics(df: DataFrame, key: str, order: list[str], value: str, term: int = 3) -> DataFrame:
    """Running and moving measures of every row: count, sum, min, max, range, avg, normalised, variance, deviation,
    standardised value, the same over the last term rows, the delta to the row before and its moving average."""
    w = Window.partitionBy(key).orderBy(*order)
    run, move = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1 - term, 0)
    x = F.col(value).cast("double")
    out = df.withColumn("delta", x - F.lag(x).over(w))
    out = out.withColumns({
        "count": F.count(x).over(run), "sum": F.sum(x).over(run), "min": F.min(x).over(run), "max": F.max(x).over(run), "avg": F.avg(x).over(run), "variance": F.var_pop(x).over(run), "std_dev": F.stddev_pop(x).over(run),
        "moving_avg": F.avg(x).over(move), "moving_std_dev": F.stddev_pop(x).over(move), "moving_delta": F.avg("delta").over(move),
    })
    r = F.col("max") - F.col("min")
    return out.withColumns({"range": r, "normalised": F.coalesce(F.try_divide(x - F.col("avg"), r), F.lit(0.0)), "standardized": F.coalesce(F.try_divide(x - F.col("avg"), F.col("std_dev")), F.lit(0.0)), "moving_standardized": F.coalesce(F.try_divide(x - F.col("moving_avg"), F.col("moving_std_dev")), F.lit(0.0))})


def outliers(df: DataFrame, k: float = 3.0, score: str = "standardized") -> DataFrame:
    return df.where(F.abs(F.col(score)) > k)


def median_outliers(df: DataFrame, key: str, order: list[str], value: str, k: float = 3.0, term: int = 3) -> DataFrame:
    """Rows whose value is more than k running deviations from the median of the key's last term rows.

    A key's second value is always one deviation from that median, so at k = 1 the last digit decides, there and in any other
    tie. The deviation is therefore Welford's update as DuckDB and most others write it, by the mean before and the mean after;
    Spark's own stddev_pop rounds otherwise.
    """
    from ..operators.scan import scan

    def step(state: list, x: float | None) -> tuple:
        n, mean, m2, recent = state
        recent = [*recent, x][-term:]
        if x is not None:
            n += 1
            after = mean + (x - mean) / n
            m2 += (x - mean) * (x - after)
            mean = after
        state[:] = n, mean, m2, recent
        some = sorted((v for v in recent if v is not None), key=lambda v: (v != v, v))
        half = len(some) - 1
        return (some[half // 2] + some[(half + 1) // 2]) / 2 if some else None, math.sqrt(m2 / n) if n else None

    made = scan(df, [key], order, [value], lambda: [0, 0.0, 0.0, []], step, ["__median", "__deviation"])
    out = made.withColumns({"median": F.col("__median"), "deviation": F.col("__deviation")}).where(F.abs(F.col(value).cast("double") - F.col("__median")) > k * F.col("__deviation"))
    return out.drop("__median", "__deviation")


def cross_normalised(latest: DataFrame, value: str = "normalised") -> DataFrame:
    """Each key's normalised value less the mean over keys; the mean is one broadcast row."""
    mean = latest.agg(F.avg(value).alias("__m"))
    return latest.crossJoin(F.broadcast(mean)).withColumn("value", F.col(value) - F.col("__m")).drop("__m")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def forecasts(last: Column, delta: Column, moving_avg: Column, moving_delta: Column, emas: list[Column] = (), delta_emas: list[Column] = ()) -> Column:
    """Naive forecasts: last value plus last, moving and smoothed deltas; twice the last value less smoothed values."""
    return F.array(last + delta, last + moving_delta, 2 * last - moving_avg, *(2 * last - e for e in emas), *(last + e for e in delta_emas))


STATE = "count long, mean double, m2 double, m3 double, sum double, min double, max double, last double, recent array<double>, ema array<double>, weight array<double>"
RESULT = "key string, count long, sum double, min double, max double, avg double, std_dev double, normalised double, standardized double, median double, moving_avg double, skewness double, delta double, ema array<double>, outlier boolean"


def step(state: tuple | None, values: list[float], term: int) -> tuple:
    """The state of a key after more values: mean and central moments by Welford's updates, which keep their digits where the
    mean is large; memory is bounded by term."""
    n, mean, m2, m3, s, low, high, last, recent, ema, weight = state or (0, 0.0, 0.0, 0.0, 0.0, math.inf, -math.inf, math.nan, [], [0.0] * len(FACTORS), [0.0] * len(FACTORS))
    recent, ema, weight = list(recent), list(ema), list(weight)
    for x in values:
        n += 1
        d = x - mean
        r = d / n
        t = d * r * (n - 1)
        mean += r
        m3 += t * r * (n - 2) - 3 * r * m2
        m2 += t
        s, low, high, last = s + x, min(low, x), max(high, x), x
        recent = [*recent, x][-(term + 1) :]
        for k, f in enumerate(FACTORS):
            ema[k], weight[k] = x + (1 - f) * ema[k], 1 + (1 - f) * weight[k]
    return n, mean, m2, m3, s, low, high, last, recent, ema, weight


def measures(key: str, state: tuple, term: int, k: float) -> tuple:
    n, avg, m2, m3, s, low, high, x, recent, ema, weight = state
    sd, r = math.sqrt(max(0.0, m2 / n)), high - low
    z = (x - avg) / sd if sd else 0.0
    window = recent[-term:]
    ordered = sorted(window)
    m = len(ordered)
    median = (ordered[(m - 1) // 2] + ordered[m // 2]) / 2
    skew = m3 / n / sd**3 if sd else 0.0
    delta = x - recent[-2] if len(recent) > 1 else None
    return key, n, s, low, high, avg, sd, (x - avg) / r if r else 0.0, z, median, sum(window) / m, skew, delta, [e / w for e, w in zip(ema, weight)], abs(z) > k


def realtime(stream: DataFrame, key: str, value: str, order: str, term: int = 3, k: float = 3.0) -> DataFrame:
    """A row per key and micro-batch with the key's measures so far, over a stream (or a table). Null values are skipped.

    Rows reach a key's function sorted by key; its frames are folded one by one, each in its own order.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = [t.dropna(subset=["value"])[["order", "value"]] for t in frames]
        t = rows[0] if len(rows) == 1 else pd.concat(rows)
        after = step(state.get if state.exists else None, t.sort_values("order", kind="stable")["value"].astype(float).tolist(), term)
        if after[0]:
            state.update(after)
            yield pd.DataFrame([measures(str(group[0]), after, term, k)], columns=[c.split()[0] for c in RESULT.split(", ")])

    rows = stream.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"), F.col(order).alias("order"))
    return rows.groupBy("key").applyInPandasWithState(run, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


class Control:
    """The keyed results that control topics ask for and set: a table by key, as the stream's sink has it."""

    def __init__(self, results: DataFrame, key: str = "key") -> None:
        self.results, self.key = results, key

    def on(self, topic: str, payload: DataFrame | None = None) -> DataFrame:
        """@stats: the results; @stats set [key]: payload instead of them, or of a key's; @stats reset [key]: without them,
        or without a key's; @deltasCrossNormalised: the normalised values less their mean, in order."""
        words = topic.strip().split(" ", 2)
        at = words[2] if len(words) > 2 else None
        others = self.results.where(~F.col(self.key).eqNullSafe(F.lit(at))) if at is not None else self.results.limit(0)
        if words == ["@stats"]:
            return self.results
        if words == ["@deltasCrossNormalised"]:
            return cross_normalised(self.results).select(self.key, "value").orderBy("value")
        if words[:2] == ["@stats", "reset"]:
            self.results = others
        elif words[:2] == ["@stats", "set"] and payload is not None:
            own = payload if at is None else payload.withColumn(self.key, F.lit(at).cast(self.results.schema[self.key].dataType))
            self.results = others.unionByName(own.select(*self.results.columns))
        else:
            raise ValueError(f'Unknown topic "{topic}"')
        return self.results


def batched(df: DataFrame, order: list[str], size: int = 99, millis: int = 100, pressed: Column | None = None) -> DataFrame:
    """df with place, batch and due (milliseconds): size messages every millis milliseconds, in order. While pressed holds for
    a message, nothing is sent for an interval before it. Places are counted per range of the order, then moved by the
    ranges before, so that no task numbers all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    w = Window.partitionBy("__part").orderBy(*order)
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    placed = ranged.withColumn("__k", F.row_number().over(w)).join(F.broadcast(before), "__part").withColumn("place", F.col("__before") + F.col("__k") - 1).drop("__part", "__k", "__before")
    batch = F.floor(F.col("place") / size)
    waits = F.lit(0) if pressed is None else F.sum(F.when(pressed, 1).otherwise(0)).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumns({"batch": batch, "due": (batch + waits) * millis})


def tumbling(events: DataFrame, ts: str, span: str, keys: list[str] = (), late: str = "10 minutes", aggregates: list[Column] | None = None) -> DataFrame:
    return sliding(events, ts, span, span, keys, late, aggregates)


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str] = (), late: str = "10 minutes", aggregates: list[Column] | None = None) -> DataFrame:
    """A row a session: events of the keys' values that follow each other within gap; late events are waited for."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late) if e.isStreaming else e
    return e.groupBy(F.session_window(ts, gap), *keys).agg(*(aggregates or [F.count(F.lit(1)).alias("n")])).select("session_window.start", "session_window.end", "*").drop("session_window")


def rates(events: DataFrame, ts: str, late: str = "10 minutes", spans: tuple[str, ...] = ("10 seconds", "60 seconds", "300 seconds"), slide: str = "1 second") -> dict[str, DataFrame]:
    """Counts of events over sliding windows, one table a span; late events are waited for."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late) if e.isStreaming else e
    return {s: e.groupBy(F.window(ts, s, slide)).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "n") for s in spans}


def sliding(events: DataFrame, ts: str, span: str, slide: str, keys: list[str] = (), late: str = "10 minutes", aggregates: list[Column] | None = None) -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late) if e.isStreaming else e
    return e.groupBy(F.window(ts, span, slide), *keys).agg(*(aggregates or [F.count(F.lit(1)).alias("n")])).select("window.start", "window.end", "*").drop("window")


def state_changes(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Rows whose state isn't that of the key's row before; a key's first row is one."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__before", F.lag(state).over(w)).withColumn("__first", F.row_number().over(w) == 1).where(F.col("__first") | ~F.col(state).eqNullSafe(F.col("__before"))).drop("__before", "__first")


def accumulated(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Incremental min, max, range, mean and count; also over a stream, in complete or update mode."""
    return df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), (F.max(value) - F.min(value)).alias("range"), F.avg(value).alias("average"), F.count(value).alias("count"))
