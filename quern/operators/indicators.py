"""Share indicators over ordered price rows per ticker. Plain windows where the formula allows, scans for recurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scan import scan


def sma(x: Column, w: WindowSpec, n: int) -> Column:
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(F.lit(1)).over(frame) >= n, F.avg(x).over(frame))


def bollinger(x: Column, w: WindowSpec, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """Upper, middle, lower band: mean and k population deviations."""
    frame = w.rowsBetween(1 - n, 0)
    full = F.count(F.lit(1)).over(frame) >= n
    mean, sd = F.avg(x).over(frame), F.sqrt(F.greatest(F.lit(0.0), F.var_pop(x).over(frame)))
    return F.when(full, mean + k * sd), F.when(full, mean), F.when(full, mean - k * sd)


def obv(close: Column, volume: Column, w: WindowSpec) -> Column:
    """On-balance volume from 0: volume signed by the close's move, summed. Needs two steps, see with_obv."""
    return F.coalesce(F.signum(close - F.lag(close).over(w)), F.lit(0.0)) * volume


def stochastic(high: Column, low: Column, close: Column, w: WindowSpec, n: int = 14) -> Column:
    """%K: where the close stands in the range of n rows; 50 if there is no range."""
    frame = w.rowsBetween(1 - n, 0)
    top, bottom = F.max(high).over(frame), F.min(low).over(frame)
    k = F.when(top == bottom, 50.0).otherwise(F.try_divide(close - bottom, top - bottom) * 100)
    return F.when(F.count(F.lit(1)).over(frame) >= n, k)


class Smoothed:
    """s += alpha (x - s), started by the mean of the first n values; None before."""

    __slots__ = ("alpha", "n", "seen", "value")

    def __init__(self, n: int, alpha: float):
        self.n, self.alpha, self.seen, self.value = n, alpha, 0, 0.0

    def add(self, x: float) -> float | None:
        self.seen += 1
        if self.seen > self.n:
            self.value += self.alpha * (x - self.value)
        else:
            self.value += x / self.n
        return self.value if self.seen >= self.n else None


def ema(n: int) -> Smoothed:
    return Smoothed(n, 2 / (n + 1))


class Indicators:
    """Relative strength, convergence with its signal and histogram, and average true range, a row at a time."""

    def __init__(self, n: int = 14, fast: int = 12, slow: int = 26, signal: int = 9):
        self.before: float | None = None
        self.gain, self.loss, self.range = (Smoothed(n, 1 / n) for _ in range(3))
        self.fast, self.slow, self.signal = ema(fast), ema(slow), ema(signal)

    def add(self, high: float, low: float, close: float) -> tuple:
        """rsi (a loss of 0 counts as a strength of 100), macd, its signal, their difference, atr."""
        strength = None
        true = high - low
        if self.before is not None:
            move = close - self.before
            gain, loss = self.gain.add(max(move, 0.0)), self.loss.add(max(-move, 0.0))
            if gain is not None:
                strength = 100 - 100 / (1 + (gain / loss if loss else 100.0))
            true = max(true, abs(high - self.before), abs(low - self.before))
        self.before = close
        fast, slow = self.fast.add(close), self.slow.add(close)
        line = fast - slow if slow is not None and fast is not None else None
        signal = self.signal.add(line) if line is not None else None
        return strength, line, signal, line - signal if signal is not None else None, self.range.add(true)


def with_indicators(df: DataFrame, ticker: str = "ticker", date: str = "date", high: str = "high", low: str = "low", close: str = "close", volume: str = "volume", text: bool = False) -> DataFrame:
    """df with all indicators, as doubles, or as fixed-decimal strings with text. A ticker's rows stay together."""
    w = Window.partitionBy(ticker).orderBy(date)
    c, v = F.col(close).cast("double"), F.col(volume).cast("double")
    upper, middle, lower = bollinger(c, w)
    out = df.withColumns({"sma50": sma(c, w, 50), "sma200": sma(c, w, 200), "bbUpper": upper, "bbMiddle": middle, "bbLower": lower, "__signed": obv(c, v, w), "stochK": stochastic(F.col(high).cast("double"), F.col(low).cast("double"), c, w)})
    frame = w.rowsBetween(-2, 0)
    out = out.withColumns({"obv": F.sum("__signed").over(w.rowsBetween(Window.unboundedPreceding, 0)), "stochD": F.when(F.count("stochK").over(w.rowsBetween(-2, 0)) >= 3, F.avg("stochK").over(w.rowsBetween(-2, 0)))}).drop("__signed")
    names = ("rsi", "macd", "macdSignal", "macdHist", "atr")
    out = scan(out, [ticker], [date], [high, low, close], Indicators, Indicators.add, list(names))
    if text:
        places = dict.fromkeys(("rsi", "stochK", "stochD"), 2) | {"obv": 0}
        out = out.withColumns({n: F.when(F.col(n).isNotNull(), F.format_string(f"%.{places.get(n, 4)}f", F.col(n))) for n in ("sma50", "sma200", "bbUpper", "bbMiddle", "bbLower", "obv", "stochK", "stochD", *names)})
    return out
