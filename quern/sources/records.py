"""A columnar record store over Parquet: infer or merge a schema, write, append, read, query."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import Plan, SqlError, run_sql


class RecordStore:
    """Files of records by path, and tables by name (in any case)."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name.lower()] = df
        df.createOrReplaceTempView(name.lower())

    def table(self, name: str, source: DataFrame | None = None) -> DataFrame:
        if name in ("?", "source") and source is not None:
            return source
        if name.lower() in self.tables:
            return self.tables[name.lower()]
        if "/" in name:
            return self.read(name)
        raise SqlError(f'Table "{name}" not found.')

    def frame(self, records) -> DataFrame:
        return records if isinstance(records, DataFrame) else self.spark.createDataFrame(records)

    def write(self, records, path: str, append: bool = False) -> dict:
        """Writes records; columns that only some have are null in the others. Returns what was written. The records are
        evaluated once: the counts are those of the files' footers."""
        df = self.frame(records)
        there = append and self.exists(path)
        before = self.metadata(path)["numRows"] if there else 0
        df.write.mode("append" if there else "overwrite").option("compression", "gzip").parquet(path)
        total = self.metadata(path)["numRows"]
        return {"filePath": path, "recordsWritten": total - before, "totalRecords": total, "schema": self.schema(path), "appended": there}

    def append(self, records, path: str) -> dict:
        return self.write(records, path, append=True)

    def exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def read(self, path: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(path)

    def schema(self, path: str) -> list[dict]:
        return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in self.read(path).schema.fields]

    def metadata(self, path: str) -> dict:
        df = self.read(path)
        m = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_modification_time")]
        files = df.select(*m).groupBy("file_path", "file_size", "file_modification_time").agg(F.count(F.lit(1)).alias("n"))
        r = files.agg(F.sum("file_size").alias("s"), F.sum("n").alias("n"), F.min("file_modification_time").alias("c"), F.max("file_modification_time").alias("m")).first()
        return {"fileSize": r["s"] or 0, "numRows": r["n"] or 0, "numColumns": len(df.columns), "created": r["c"], "modified": r["m"], "compression": "gzip", "version": 1}

    def query(self, df: DataFrame, where: Column | dict[str, Callable[[Column], Column]] | None = None, rows: dict[str, list[int]] | None = None, position: str | None = None, limit: int | None = None) -> DataFrame:
        """Rows that a predicate, or every predicate of a column, holds for; rows: positions that every list has."""
        if isinstance(where, dict):
            where = reduce(lambda a, b: a & b, (f(F.col(c)) for c, f in where.items()))
        if where is not None:
            df = df.where(F.coalesce(where, F.lit(False)))
        if rows is not None:
            wanted = sorted(set.intersection(*(set(v) for v in rows.values()))) if rows else []
            keep = self.spark.createDataFrame([(x,) for x in wanted], f"`{position}` bigint")
            df = df.join(keep, position, "left_semi")
        return df if limit is None else df.limit(limit)

    def sql(self, sql: str | Plan, source: DataFrame | str | None = None, params: dict | None = None, **options) -> DataFrame:
        source = self.read(source) if isinstance(source, str) else source
        return run_sql(sql, lambda name: self.table(name, source), params, **options)
