"""Deep comparison of values and of tables, with a relative tolerance."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPECIAL = {"Infinity": math.inf, "-Infinity": -math.inf, "NaN": math.nan}


def _value(v):
    return _SPECIAL.get(v, v) if isinstance(v, str) else v


def deep_equal(got, want, error_factor: float = 0.0) -> bool:
    """Whether got is want, level by level: numbers within error_factor of want's size, Infinity and NaN also as text."""
    got, want = _value(got), _value(want)
    if isinstance(want, dict):
        return isinstance(got, dict) and got.keys() == want.keys() and all(deep_equal(got[k], v, error_factor) for k, v in want.items())
    if isinstance(want, (list, tuple)):
        return isinstance(got, (list, tuple)) and len(got) == len(want) and all(deep_equal(a, b, error_factor) for a, b in zip(got, want))
    numbers = [isinstance(x, (int, float)) and not isinstance(x, bool) for x in (got, want)]
    if all(numbers):
        if math.isnan(want) or math.isnan(got):
            return math.isnan(want) and math.isnan(got)
        return got == want or (math.isfinite(got) and math.isfinite(want) and abs(got - want) <= error_factor * abs(want))
    return type(got) is type(want) and got == want


def matches(got: str, pattern: str) -> bool:
    return re.search(pattern, got) is not None


def differences(got: DataFrame, want: DataFrame, keys: list[str], error_factor: float = 0.0) -> DataFrame:
    """Rows of keys and column where two tables differ: values beyond the tolerance, or a row that only one has (column null)."""
    both = got.withColumn("__g", F.lit(True)).alias("g").join(want.withColumn("__w", F.lit(True)).alias("w"), keys, "full")
    checks = []
    for f in want.schema.fields:
        if f.name not in keys:
            a, b = F.col(f"g.`{f.name}`"), F.col(f"w.`{f.name}`")
            same = a.eqNullSafe(b)
            if f.dataType.typeName() in ("double", "float", "long", "integer"):
                same = same | F.coalesce(F.abs(a - b) <= F.abs(b) * error_factor, F.lit(False))
            checks.append(F.when(~same, F.lit(f.name)))
    alone = F.col("g.__g").isNull() | F.col("w.__w").isNull()
    found = F.when(alone, F.array(F.lit(None).cast("string"))).otherwise(F.array_compact(F.array(*checks)))
    return both.select(*keys, F.explode(found).alias("column"))
