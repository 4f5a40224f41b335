"""Typed stores: a fixed schema, validated adds, rule queries and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = {"=": lambda c, v: c == v, "!=": lambda c, v: ~c.eqNullSafe(F.lit(v)), ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v}
_TEXT = {
    "=": lambda c, v: F.lower(c) == str(v).lower(), "!=": lambda c, v: ~F.lower(c).eqNullSafe(F.lit(str(v).lower())), "contains": lambda c, v: F.lower(c).contains(str(v).lower()),
    "starts with": lambda c, v: F.lower(c).startswith(str(v).lower()), "ends with": lambda c, v: F.lower(c).endswith(str(v).lower()),
}


def rule(field: T.StructField, op: str, value) -> Column:
    """A predicate of a field; strings compare without case."""
    table = _NUMBER if isinstance(field.dataType, T.NumericType) else _TEXT
    op = "!=" if op == "<>" else op
    if op not in table:
        raise ValueError(f'Unknown operator "{op}" for type "{field.dataType.simpleString()}"')
    c = F.col(f"`{field.name}`")
    return table[op](c if table is _NUMBER else c.cast("string"), value)


def rules(df: DataFrame, where: list[dict], logic: str = "AND") -> Column:
    fields = {f.name: f for f in df.schema.fields}
    parts = [rule(fields[r["field"]], r["op"], r["value"]) for r in where]
    return reduce((lambda a, b: a & b) if logic.upper() == "AND" else (lambda a, b: a | b), parts)


class TypedStore:
    def __init__(self, spark: SparkSession, schema: T.StructType, name: str, df: DataFrame | None = None) -> None:
        self.spark, self.schema, self.name = spark, schema, name.lower()
        self.df = df if df is not None else spark.createDataFrame([], schema)
        self.df.createOrReplaceTempView(self.name)

    def add(self, *records: dict) -> TypedStore:
        for r in records:
            for f in self.schema.fields:
                self._valid(f, r.get(f.name))
        self.df = self.df.unionByName(self.spark.createDataFrame([tuple(r.get(f.name) for f in self.schema.fields) for r in records], self.schema))
        self.df.createOrReplaceTempView(self.name)
        return self

    @staticmethod
    def _valid(f: T.StructField, value) -> None:
        kinds = {T.StringType: str, T.BooleanType: bool, T.IntegerType: int, T.LongType: int, T.DoubleType: (int, float), T.FloatType: (int, float)}
        ok = f.nullable if value is None else isinstance(value, kinds.get(type(f.dataType), object)) and not (isinstance(value, bool) and not isinstance(f.dataType, T.BooleanType))
        if not ok:
            raise ValueError(f'Invalid field "{f.name}": {value!r}')

    def query(self, where: list[dict] | None = None, logic: str = "AND", order_by: str | None = None, descending: bool = False, limit: int | None = None) -> DataFrame:
        df = self.df.where(rules(self.df, where, logic)) if where else self.df
        if order_by:
            df = df.orderBy(F.col(order_by).desc_nulls_last() if descending else F.col(order_by).asc_nulls_first())
        return df if limit is None else df.limit(limit)

    def join(self, other: TypedStore, on: str, how: str = "INNER", prefix: bool = True) -> DataFrame:
        """on: a field of both, or "left = right". Columns are named store.field with prefix."""
        left, _, right = (x.strip() for x in on.partition("="))
        name = lambda s, c: f"{s.name}.{c}" if prefix else c
        a = self.df.select(*(F.col(f"`{c}`").alias(name(self, c)) for c in self.df.columns))
        b = other.df.select(*(F.col(f"`{c}`").alias(name(other, c)) for c in other.df.columns))
        return a.join(b, a[f"`{name(self, left)}`"] == b[f"`{name(other, right or left)}`"], {"FULL OUTER": "full"}.get(how.upper(), how.lower().replace(" ", "_")))

    def size(self) -> int:
        return self.df.count()

    def some(self, predicate: Column) -> bool:
        return self.df.where(predicate).limit(1).count() > 0

    def every(self, predicate: Column) -> bool:
        return not self.some(~F.coalesce(predicate, F.lit(False)))

    def find(self, predicate: Column):
        return self.df.where(predicate).first()

    def sql(self, sql: str, params: dict | None = None, **options) -> DataFrame:
        """A statement over the store, by its name or as "?"."""
        from ..plans.dialect import SqlError, run_sql

        def table(name: str) -> DataFrame:
            if name.lower() in ("?", "source", self.name):
                return self.df
            raise SqlError(f'Table "{name}" not found.')

        return run_sql(sql, table, params, **options)

    def map(self, **columns: Column) -> DataFrame:
        return self.df.select(*(c.alias(k) for k, c in columns.items()))

    def filter(self, predicate: Column) -> DataFrame:
        return self.df.where(F.coalesce(predicate, F.lit(False)))

    def reduce(self, f, initial, column: str, order: str):
        """f(result so far, value) over a column, in order, as a table of one row (value): batches fold one after the other."""
        values = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("v")))), lambda s: s["v"])
        return self.df.agg(F.aggregate(values, F.lit(initial), f).alias("value"))

    def for_each(self, f) -> None:
        """f of every row, in the tasks that have them."""
        self.df.foreach(f)

    def serialize(self, avro_schema: dict, codec: str = "deflate") -> DataFrame:
        """Avro containers (column avro) of a batch of rows each."""
        import pyarrow as pa

        from ..functions.formats import avro_container

        def pack(batches):
            for b in batches:
                if len(b):
                    yield pa.RecordBatch.from_arrays([pa.array([avro_container(avro_schema, b.to_pylist(), codec)], pa.binary())], ["avro"])

        return self.df.mapInArrow(pack, "avro binary")

    def load(self, containers: DataFrame) -> TypedStore:
        """The store with the records of Avro containers (column avro) added."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        from ..functions.formats import avro_container_read

        kinds = to_arrow_schema(self.schema)

        def unpack(batches):
            for b in batches:
                for c in b.column(0):
                    yield pa.RecordBatch.from_pylist(avro_container_read(c.as_py())[1], kinds)

        return TypedStore(self.spark, self.schema, self.name, self.df.unionByName(containers.select("avro").mapInArrow(unpack, self.schema)))

    def from_csv(self, path: str) -> TypedStore:
        df = self.spark.read.schema(self.schema).csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="FAILFAST")
        return TypedStore(self.spark, self.schema, self.name, self.df.unionByName(df))
