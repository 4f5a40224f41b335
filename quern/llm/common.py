"""Small pieces that several operators share: written intermediates and their removal, edges to components."""

from __future__ import annotations

import contextlib
import contextvars
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path

#: Tables that the operator at work has written.
_SCRATCH: contextvars.ContextVar[list | None] = contextvars.ContextVar("scratch", default=None)


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage is cut, and a lost executor costs nothing that was written."""
    path = shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quern_path = path
    if (held := _SCRATCH.get()) is not None:
        held.append(out)
    return out


def forget(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch():
    """Deletes, at its end, all that was written within, but for what keep(df) was called with: tables that a result reads."""
    held: list[DataFrame] = []
    kept: list[str] = []
    outer = _SCRATCH.set(held)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._quern_path)
        return df

    try:
        yield keep
    finally:
        _SCRATCH.reset(outer)
        for df in held:
            if df._quern_path not in kept:
                forget(df)
            elif (above := _SCRATCH.get()) is not None:
                above.append(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b), as rows (node, component): component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until no edge changes, O(log^2 n) rounds. Each
    round keeps at most as many edges as before, is written to the shared folder, and takes minima that combine before
    the shuffle. Joins are sort-merge joins, which split hot nodes: files' sizes say too little of what a broadcast would
    hold. Nodes without edges don't appear. Null ends are dropped.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e = written(e, "edges")
    stamp = _stamp(e)
    while True:
        # large star: every neighbour above u points to the least of u's neighbourhood
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has an exchange of its own on either side and can split a hub's rows
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        # small star: neighbours at or below u, and u itself, point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        following = written(small.distinct(), "edges")
        after = _stamp(following)
        forget(e)
        forget(least)
        e = following
        if after == stamp:
            break
        stamp = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stamp(e: DataFrame) -> tuple:
    row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


TOKENIZERS = os.environ.get("QUERN_TOKENIZERS", "")


def vocabulary(name: str, folder: str = TOKENIZERS) -> str:
    """Path of a public tokenizer's file: in folder if given, else where the public_tokenizers package has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
