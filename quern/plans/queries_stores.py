"""Queries of stores, files, processes and other sources; what they write goes to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checks
from ..sources import single_file
from ..sources.records import RecordStore
from ..sources.shared import shared_path
from ..sources.typed import TypedStore
from .queries import query, table


@query("SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS VARCHAR) AS kind FROM nation UNION ALL SELECT r_regionkey, r_name, 'region' FROM region")
def records_append(spark, sf_dir):
    """Written, then appended to with one more column, and read again."""
    store, path = RecordStore(spark), shared_path(spark, "records")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    store.write(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), path)
    store.append(r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("kind")), path)
    return store.read(path).select("id", "name", "kind")


@query("""SELECT 'written' AS what, count(*) AS n, 'false' AS detail FROM nation UNION ALL SELECT 'appended', (SELECT count(*) FROM region), CAST((SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS VARCHAR)
 UNION ALL SELECT 'field', 0, 'id int' UNION ALL SELECT 'field', 1, 'name string' UNION ALL SELECT 'rows', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region), 'gzip 1' UNION ALL SELECT 'columns', 2, 'dated'""")
def records_metadata(spark, sf_dir):
    store, path = RecordStore(spark), shared_path(spark, "records")
    frame = lambda name, k: table(spark, sf_dir, name).select(F.col(f"{k}key").alias("id"), F.col(f"{k[0]}_name").alias("name"))
    first, more = store.write(frame("nation", "n_nation"), path), store.append(frame("region", "r_region"), path)
    meta = store.metadata(path)
    rows = [("written", first["recordsWritten"], str(first["appended"]).lower()), ("appended", more["recordsWritten"], str(more["totalRecords"]))]
    rows += [("field", k, f"{f['name']} {f['type']}") for k, f in enumerate(store.schema(path))]
    rows += [("rows", meta["numRows"], f"{meta['compression']} {meta['version']}"), ("columns", meta["numColumns"], "dated" if meta["created"] <= meta["modified"] else "not")]
    return spark.createDataFrame(rows, "what string, n bigint, detail string")


@query("SELECT r_name, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def records_across_stores(spark, sf_dir):
    """A statement over a registered table and a store by its path."""
    store, path = RecordStore(spark), shared_path(spark, "records")
    store.write(table(spark, sf_dir, "region"), path)
    store.register("Nation", table(spark, sf_dir, "nation"))
    return store.sql("SELECT r.r_name, COUNT(*) AS nations FROM nation n JOIN ? r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", path).withColumnRenamed("r.r_name", "r_name")


@query("SELECT 10 AS n, 'Customer' AS name")
def records_limit(spark, sf_dir):
    got = RecordStore(spark).query(table(spark, sf_dir, "customer"), F.col("c_custkey") >= 0, limit=10)
    return got.agg(F.count(F.lit(1)).cast("int").alias("n"), F.max(F.substring("c_name", 1, 8)).alias("name"))


def _typed(spark, sf_dir, name: str, store: str) -> TypedStore:
    df = table(spark, sf_dir, name)
    return TypedStore(spark, df.schema, store, df)


_TEXT = {"=": "lower(p_type) = 'standard'", "!=": "lower(p_type) <> 'standard'", "<>": "lower(p_type) <> 'standard'", "contains": "contains(lower(p_type), 'an')", "starts with": "starts_with(lower(p_type), 'sta')", "ends with": "ends_with(lower(p_type), 'omy')"}
_NUMBER = ("=", "!=", "<>", ">", ">=", "<", "<=")


@query(" UNION ALL ".join([f"SELECT '{op}' AS op, p_partkey FROM part WHERE {sql}" for op, sql in _TEXT.items()] + [f"SELECT '{op}', p_partkey FROM part WHERE p_size {op} 20" for op in _NUMBER]))
def typed_operators(spark, sf_dir):
    """Every operator of strings and of numbers."""
    store = _typed(spark, sf_dir, "part", "parts")
    values = {"contains": "AN", "starts with": "Sta", "ends with": "OMY"}
    rules = [(op, "p_type", values.get(op, "standard")) for op in _TEXT] + [(op, "p_size", 20) for op in _NUMBER]
    return reduce(DataFrame.unionAll, (store.query([{"field": f, "op": op, "value": v}]).select(F.lit(op).alias("op"), "p_partkey") for op, f, v in rules))


@query(" UNION ALL ".join(f"SELECT '{how}' AS how, n_name, r_name FROM (SELECT * FROM nation WHERE n_regionkey <> 1) {how} JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON n_regionkey = r_regionkey" for how in ("INNER", "LEFT", "RIGHT", "FULL OUTER")))
def typed_joins(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation").where("n_regionkey <> 1"), table(spark, sf_dir, "region").where("r_regionkey <> 2")
    a, b = TypedStore(spark, n.schema, "nations", n), TypedStore(spark, r.schema, "regions", r)
    return reduce(DataFrame.unionAll, (a.join(b, "n_regionkey = r_regionkey", how, prefix=False).select(F.lit(how).alias("how"), "n_name", "r_name") for how in ("INNER", "LEFT", "RIGHT", "FULL OUTER")))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'ATLANTIS', 9 UNION ALL SELECT 101, 'UTOPIA', NULL")
def typed_adds(spark, sf_dir):
    store = _typed(spark, sf_dir, "nation", "nations").add({"n_nationkey": 100, "n_name": "ATLANTIS", "n_regionkey": 9}).add({"n_nationkey": 101, "n_name": "UTOPIA"})
    return store.df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def typed_containers(spark, sf_dir):
    """Serialised to containers, and loaded into an empty store."""
    store = _typed(spark, sf_dir, "nation", "nations")
    schema = {"type": "record", "name": "nation", "fields": [{"name": "n_nationkey", "type": "int"}, {"name": "n_name", "type": "string"}, {"name": "n_regionkey", "type": "int"}]}
    return TypedStore(spark, store.schema, "copies").load(store.serialize(schema)).df


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def typed_csv(spark, sf_dir):
    df, path = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), shared_path(spark, "csv")
    df.write.option("header", True).csv(path)
    return TypedStore(spark, df.schema, "suppliers").from_csv(path).df


@query("""SELECT 'size' AS what, CAST(count(*) AS VARCHAR) AS value FROM nation UNION ALL SELECT 'some', 'true' UNION ALL SELECT 'every', 'false' UNION ALL SELECT 'find', 'NATION_7' UNION ALL SELECT 'reduce', CAST(sum(n_regionkey) AS VARCHAR) FROM nation
 UNION ALL SELECT 'map', string_agg(lower(n_name), ',' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'sql', CAST(count(*) AS VARCHAR) FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'order', 'NATION_24'""")
def typed_calls(spark, sf_dir):
    s = _typed(spark, sf_dir, "nation", "nations")
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    mapped = s.filter(F.col("n_nationkey") < 3)
    names = TypedStore(spark, mapped.schema, "some", mapped).map(k=F.col("n_nationkey"), name=F.lower("n_name")).orderBy("k").collect()
    s.for_each(lambda row: None)
    rows = [("size", s.size()), ("some", s.some(F.col("n_regionkey") == 2)), ("every", s.every(F.col("n_regionkey") == 2)), ("find", s.find(F.col("n_nationkey") == 7)["n_name"]), ("reduce", s.reduce(lambda a, x: a + x, 0, "n_regionkey", "n_nationkey").first()["value"])]
    rows += [("map", ",".join(r["name"] for r in names)), ("sql", s.sql("SELECT COUNT(*) AS n FROM nations WHERE n_regionkey = 2").first()["n"]), ("order", s.query(order_by="n_nationkey", descending=True, limit=1).first()["n_name"])]
    return spark.createDataFrame([(k, text(v)) for k, v in rows], "what string, value string")


@query("SELECT n_nationkey, n_name || ':' || 'AFRICA' AS text FROM nation")
def files_appended(spark, sf_dir):
    """A file's text behind each row's."""
    path = shared_path(spark, "text")
    table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.concat(F.lit(":"), "r_name").alias("value")).coalesce(1).write.option("lineSep", "\u0003").text(path)
    got = single_file.append_text(table(spark, sf_dir, "nation").withColumn("text", F.col("n_name")), "text", path)
    return got.select("n_nationkey", F.replace("text", F.lit("\u0003"), F.lit("")).alias("text"))


@query("SELECT 'a line of ' || r_name || ' and more' AS text FROM region")
def files_folder(spark, sf_dir):
    """Printable lines of a folder's files, without the short ones."""
    path = shared_path(spark, "folder")
    text = F.concat(F.lit("short\n"), F.lit("a line of "), "r_name", F.lit(" é"), F.lit("and more\n"))
    table(spark, sf_dir, "region").select(text.alias("value"), "r_regionkey").repartitionByRange(5, "r_regionkey").select("value").write.text(path)
    lines = single_file.folder(spark, path, files=100, most=1000).select(F.explode(F.split("text", "\n")).alias("text"))
    return lines.where("text <> ''").select(F.replace("text", F.lit("  "), F.lit(" ")).alias("text")).select(F.regexp_replace("text", "([A-Z]) ?and", "$1 and").alias("text"))


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey = 2 AS two, CAST(n_nationkey * 1.5 AS DOUBLE) AS x FROM nation")
def files_single_stores(spark, sf_dir):
    """Stores of a file each, one a region, written as bytes and read by a task each."""
    import pyarrow as pa

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") == 2).alias("two"), (F.col("n_nationkey") * 1.5).alias("x"), "n_regionkey")

    def pack(key, t):
        return pa.table({"content": pa.array([single_file.encode(t.select(["id", "name", "two", "x"]))], pa.binary())})

    packed = n.groupBy("n_regionkey").applyInArrow(pack, "content binary")
    return single_file.decoded(packed, "id double, name string, two boolean, x double").select(F.col("id").cast("int").alias("id"), "name", "two", "x")


@query("SELECT 'stdout' AS stream, upper(n_name) AS line, count(*) AS n FROM nation GROUP BY 2 UNION ALL SELECT 'rc', '0', 1 UNION ALL SELECT 'stderr', 'done', 1")
def processes_lines(spark, sf_dir):
    n = table(spark, sf_dir, "nation").coalesce(1).select(F.lower("n_name").alias("n_name"))
    got = single_file.through(n, "n_name", ["sh", "-c", "tr a-z A-Z; echo done >&2"])
    return got.groupBy("stream", "line").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT unnest(['cpus', 'free', 'load1', 'load15', 'load5', 'memory', 'process_s', 'ts']) AS metric, true AS known")
def processes_host(spark, sf_dir):
    return single_file.host_metrics(spark).select("metric", F.col("value").isNotNull().alias("known"))


@query("SELECT true AS enough, true AS spaced, 0.0::DOUBLE AS started, 60.0::DOUBLE AS stopped, true AS counted")
def load_injected(spark, sf_dir):
    """A minute of messages at think times from one to two seconds."""
    messages, summary = single_file.load(spark, 60, 1, 2, seed=7)
    gaps = messages.agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last"), F.min(F.col("at")).alias("first"))
    return gaps.crossJoin(summary).select(F.col("n").between(29, 60).alias("enough"), (F.col("first").between(1, 2) & (F.col("last") <= 60)).alias("spaced"), "started", "stopped", (F.col("count") == F.col("n")).alias("counted"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE NULL END AS column FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey = 23")
def checks_differences(spark, sf_dir):
    """Every second row is off by more than the tolerance, and one is missing."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 1.0).alias("x"), "n_name")
    off = n.withColumn("x", F.when(F.col("n_nationkey") % 2 == 0, F.col("x") * 1.2).otherwise(F.col("x") * 1.0001)).where("n_nationkey <> 23")
    return checks.differences(off, n, ["n_nationkey"], 0.01)


@query("SELECT unnest(['number', 'beyond', 'nested', 'infinite', 'nan', 'text', 'pattern']) AS what, unnest([true, false, true, true, true, false, true]) AS equal")
def checks_values(spark, sf_dir):
    e = checks.deep_equal
    rows = [("number", e(1.001, 1.0, 0.01)), ("beyond", e(1.1, 1.0, 0.01)), ("nested", e({"a": [1, {"b": 2.0}]}, {"a": [1, {"b": 2.01}]}, 0.01)), ("infinite", e(float("inf"), "Infinity")), ("nan", e("NaN", float("nan"))), ("text", e("1", 1)), ("pattern", checks.matches("abc", "^a.c$"))]
    return spark.createDataFrame(rows, T.StructType([T.StructField("what", T.StringType()), T.StructField("equal", T.BooleanType())]))


@query("""SELECT 'listed' AS what, unnest(['a.txt', 'b.txt', 'sub']) AS name, unnest([12, 5, 0]) AS size UNION ALL SELECT 'below', unnest(['a.txt', 'b.txt', 'c.txt']), unnest([12, 5, 5]) UNION ALL SELECT 'matched', 'b.txt', 5
 UNION ALL SELECT 'read', 'lo, w', 5 UNION ALL SELECT 'cut', 'hel', 3 UNION ALL SELECT 'gone', 'false', 0 UNION ALL SELECT 'dated', '86400000', 0 UNION ALL SELECT 'mode', 'rw-r-----', 0""")
def files_and_folders(spark, sf_dir):
    """Written, appended to, copied, renamed, listed, cut and removed."""
    from ..sources.files import Files

    f = Files(spark)
    at = f.temporary_folder(shared_path(spark, "files-"))
    f.make_folder(f"{at}/sub")
    f.write(f"{at}/a.txt", b"hello")
    f.copy(f"{at}/a.txt", f"{at}/x.txt")
    f.copy(f"{at}/a.txt", f"{at}/sub/c.txt")
    f.rename(f"{at}/x.txt", f"{at}/b.txt")
    f.append(f"{at}/a.txt", b", world")
    f.set_times(f"{at}/b.txt", 86_400_000)
    f.set_mode(f"{at}/b.txt", "640")
    size = F.when(F.col("folder"), 0).otherwise(F.col("size")).cast("int").alias("size")
    label = lambda what, df: df.select(F.lit(what).alias("what"), "name", size)
    out = label("listed", f.list(at)).unionAll(label("below", f.list(at, recursive=True))).unionAll(label("matched", f.glob(f"{at}/b*")))
    rows = [("read", f.read(f"{at}/a.txt", 3, 5).decode(), 5)]
    f.truncate(f"{at}/a.txt", 3)
    stat = f.stat(f"{at}/b.txt")
    rows += [("cut", f.read(f"{at}/a.txt").decode(), f.stat(f"{at}/a.txt")["size"]), ("dated", str(stat["modified"]), 0), ("mode", stat["mode"], 0)]
    f.remove(at, recursive=True)
    return out.unionAll(spark.createDataFrame([*rows, ("gone", str(f.exists(at)).lower(), 0)], "what string, name string, size int"))
