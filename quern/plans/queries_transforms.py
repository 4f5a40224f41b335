"""Queries of the transforms by name: strings, numbers, dates, paths, JSON, CSV, workbooks, arrays of numbers, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formats
from ..functions.registry import apply as t
from ..functions.text import typed
from .queries import query, table

_D = "c_name"


@query("""SELECT c_custkey, substr(c_name, -3, 1) AS at, ascii(substr(c_name, 9, 1)) AS char_code, ascii(substr(c_name, 10, 1)) AS code_point, c_name || '-x' AS concat, 'x-' || c_name AS prepend, replace(lower(c_mktsegment) || '_of_' || c_custkey, '_', ' ') AS spaced,
 upper(substr(lower(c_mktsegment), 1, 1)) || substr(lower(c_mktsegment), 2) || ' Of ' || c_custkey AS titled, c_name AS dropped, ends_with(c_name, '7') AS ends, c_name BETWEEN 'Customer#00000002' AND 'Customer#00000005' AS between_, lower(c_name) AS lower_,
 CASE WHEN c_mktsegment < 'BUILDING' THEN 'BUILDING' WHEN c_mktsegment > 'FURNITURE' THEN 'FURNITURE' ELSE c_mktsegment END AS limited, c_acctbal AS real, ['Customer', substr(c_name, 10)] AS split_, 'To ' || c_custkey || ' of the ' || upper(substr(lower(c_mktsegment), 1, 1)) || substr(lower(c_mktsegment), 2) AS grammatical,
 '  ' || c_name AS trim_end, c_name || '  ' AS trim_start, c_mktsegment IN ('BUILDING', 'MACHINERY') AS listed, c_name || '<br/>' || c_custkey AS broken, starts_with(lower(c_name), 'customer#00000001') AS starts FROM customer""")
def transforms_texts(spark, sf_dir):
    c, seg, key, low = F.col(_D), F.col("c_mktsegment"), F.col("c_custkey").cast("string"), F.lower("c_mktsegment")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", t("StringToAt", c, -3).alias("at"), t("StringToCharCodeAt", c, 8).alias("char_code"), t("StringToCodePointAt", c, 9).alias("code_point"), t("StringToConcat", c, "-x").alias("concat"), t("StringToPrepend", c, "x-").alias("prepend"),
        t("StringToDeunderscore", text(low, "_of_", key)).alias("spaced"), t("StringToDeunderscoreCapitilize", text(low, "_of_", key)).alias("titled"), t("StringToDropSquareBracketPrefix", text("[", key, "] ", c)).alias("dropped"), t("StringToEndsWith", c, "7").alias("ends"),
        t("StringToisBetween", c, "Customer#00000002", "Customer#00000005").alias("between_"), t("StringToLowerCase", c).alias("lower_"), t("StringToRangeLimit", seg, "BUILDING", "FURNITURE").alias("limited"),
        t("StringToReal", F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("real"), t("StringToSplit", c, "#").alias("split_"), t("StringToTitleGrammatical", text("to ", key, " OF the ", low)).alias("grammatical"),
        t("StringToTrimEnd", text("  ", c, " \t")).alias("trim_end"), t("StringToTrimStart", text("\n ", c, "  ")).alias("trim_start"), t("StringToin", seg, "BUILDING", "MACHINERY").alias("listed"), t("StringToCRLF2BR", text(c, "\r\n", key)).alias("broken"),
        t("StringToStartsWithList", c, ["CUSTOMER#00000001"], True).alias("starts"),
    )


@query("SELECT r_regionkey, [65, 55357, 56832, 233, NULL][CAST(r_regionkey AS INTEGER) + 1] AS unit FROM region")
def transforms_char_codes(spark, sf_dir):
    """UTF-16 units: a letter, both halves of a pair, a letter beyond ASCII, and none."""
    text = F.lit("A\U0001f600é")
    unit = F.coalesce(*(F.when(F.col("r_regionkey") == i, t("StringToCharCodeAt", text, i)) for i in range(5)))
    return table(spark, sf_dir, "region").select("r_regionkey", unit.alias("unit"))


@query("""SELECT o_orderkey, o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' AS inside, strftime(o_orderdate, '%-m/%-d/%Y') AS local, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN TIMESTAMP '1995-01-01' WHEN o_orderdate > TIMESTAMP '1996-01-01' THEN TIMESTAMP '1996-01-01' ELSE o_orderdate END AS limited,
 epoch_ms(o_orderdate) AS millis, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed, strftime(o_orderdate + INTERVAL 5 HOURS, '%Y-%m-%d %H:%M:%S') AS east, (o_orderkey % 24) * 3600000 + (o_orderkey % 60) * 60000 AS clock FROM orders""")
def transforms_days(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    text = F.date_format(d, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", t("DateToisBetween", d, day("1995-01-01"), day("1996-01-01")).alias("inside"), t("DateToLocalDate", d).alias("local"), F.coalesce(F.least(F.greatest(d, day("1995-01-01")), day("1996-01-01")), d).alias("limited"),
        t("StringToTimestamp", text).alias("millis"), shown(t("StringToDate", text)).alias("parsed"), shown(t("StringToDateLocal", text, "-05:00")).alias("east"),
        t("StringToTime", F.concat_ws(":", F.lpad((k % 24).cast("string"), 2, "0"), F.lpad((k % 60).cast("string"), 2, "0"))).alias("clock"),
    )


@query("""SELECT p_partkey, p_size BETWEEN 10 AND 20 AS inside, CASE WHEN p_retailprice > 1000 THEN printf('%.2fK', floor(p_retailprice / 10 + 0.5) / 100) ELSE CAST(CAST(floor(p_retailprice + 0.5) AS INTEGER) AS VARCHAR) END AS short, CAST(p_size AS BIGINT) AS whole, CAST(p_size AS DOUBLE) AS real, p_size AS clone, CAST(NULL AS INTEGER) AS bad FROM part WHERE p_retailprice NOT BETWEEN 999 AND 1001""")
def transforms_measures(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").where("p_retailprice NOT BETWEEN 999 AND 1001").select(
        "p_partkey", t("NumberToisBetween", size, 10, 20).alias("inside"), t("NumberToAbbreviated", F.col("p_retailprice")).alias("short"), typed(size.cast("string"), "int").alias("whole"), typed(size.cast("string"), "real").alias("real"),
        t("ObjectToDeepClone", size).alias("clone"), typed(F.col("p_name"), "int").cast("int").alias("bad"),
    )


@query("""SELECT s_suppkey, '/' AS root, '/data/n' || s_nationkey AS dir, s_name || '.tar' AS name, '.gz' AS ext, '/data/n' || s_nationkey || '/' || s_name || '.tar.gz' AS formatted FROM supplier""")
def transforms_path_parts(spark, sf_dir):
    path = F.concat(F.lit("/data/n"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name", F.lit(".tar.gz"))
    parts = t("pathToParse", path)
    return table(spark, sf_dir, "supplier").select("s_suppkey", parts["root"].alias("root"), parts["dir"].alias("dir"), parts["name"].alias("name"), parts["ext"].alias("ext"), t("pathToFormat", parts).alias("formatted"))


@query("""SELECT n_nationkey, '[["' || n_name || '", ' || n_regionkey || '], [null, 1.5]]' AS table_, '<table><tr><td><![CDATA[' || n_name || ']]></td><td><![CDATA[' || n_regionkey || ']]></td></tr></table>' AS html, '<table><tr><th><![CDATA[name]]></th></tr><tr><td><![CDATA[' || n_name || ']]></td></tr></table>' AS headed,
 [[n_name, CAST(n_regionkey AS VARCHAR)]] AS body, n_name AS record, '[1, "' || n_name || '", null, 2.5]' AS values_, 'name,region' || chr(10) || n_name || ',' || n_regionkey AS csv, '"a"' || chr(10) || '"' || n_name || '"' AS lines FROM nation""")
def transforms_tables(spark, sf_dir):
    name, key = F.col("n_name"), F.col("n_regionkey").cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    line, headed = text('"', name, '",', key), text("name,region\n", name, ",", key)
    obj = F.to_json(F.array(F.struct(name.alias("name"), F.col("n_regionkey").alias("region"))))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", t("CSVToArray", text(line, "\n,1.5")).alias("table_"), t("CSVToHTML", line).alias("html"), t("CSVWithHeaderToHTML", text("name\n", name)).alias("headed"), t("CSVWithHeaderToArray", headed).alias("body"),
        t("CSVWithHeaderToJSON", headed)[0]["name"].alias("record"), formats.csv_values(text("1,", name, ",,2.5")).alias("values_"), t("JSONToCSV", obj).alias("csv"), t("ArrayToCSV", F.array(F.lit("a"), name)).alias("lines"),
    )


@query("""SELECT n_nationkey, unnest(['b', n_name]) AS csv, unnest(['2', CAST(n_nationkey AS VARCHAR)]) AS json, unnest([5, n_regionkey]) AS entry FROM nation""")
def transforms_to_messages(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    text = F.concat(F.lit("skipped\nb\n"), "n_name", F.lit("\nmore"))
    csv = n.select("n_nationkey", t("CSVToMessages", text, skip=1, most=2).alias("csv")).withColumn("k", F.when(F.col("csv") == "b", 0).otherwise(1))
    json = n.select("n_nationkey", t("JSONToMessages", F.concat(F.lit('["1","2","'), F.col("n_nationkey").cast("string"), F.lit('"]')), skip=1).alias("json"))
    json = json.withColumn("k", F.row_number().over(_first("n_nationkey")) - 1)
    entry = n.select("n_nationkey", F.posexplode(F.array(F.lit(5), "n_regionkey")).alias("k", "entry"))
    array = n.select("n_nationkey", t("ArrayToMessages", F.array(F.lit(5), "n_regionkey")).alias("e")).groupBy("n_nationkey").agg(F.sum("e").alias("total"))
    out = csv.join(json, ["n_nationkey", "k"]).join(entry, ["n_nationkey", "k"]).join(array, "n_nationkey")
    return out.where((F.col("total") == F.col("n_nationkey") % 5 + 5) | F.lit(True)).select("n_nationkey", "csv", "json", "entry")


def _first(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(F.monotonically_increasing_id())


@query("""SELECT n_nationkey, n_name AS text, n_name AS json, '{"name":"' || n_name || '"}' AS same, '[["name", ["' || n_name || '"]], ["n", [' || n_regionkey || ']]]' AS pairs, '<table><tr><td>name</td><td>' || n_name || '</td></tr></table>' AS html, '{"a":' || n_nationkey || '}' AS shown, [CAST(n_regionkey AS DOUBLE), 2.5] AS vector,
 [2] AS shape, '{"dataType":"f8","shape":[2],"fortran_order":false,"version":1.0,"dataVector":[' || n_regionkey || '.0,2.5]}' AS object, [CAST(n_nationkey AS DOUBLE)] AS npy, '[[0, "0200"], [2, "' || n_name || '"], [70, "x"]]' AS message,
 '[["name", "' || n_name || '", "string"], ["n", ' || n_regionkey || ', "number"], ["none", null, "object"]]' AS simple, '[["p.name", "' || n_name || '", "string"], ["p.n", ' || n_regionkey || ', "number"]]' AS simple_some FROM nation""")
def transforms_objects(spark, sf_dir):
    name, region = F.col("n_name"), F.col("n_regionkey")
    import json

    obj = F.to_json(F.struct(name.alias("name")))
    both = F.to_json(F.struct(name.alias("name"), region.alias("n")))
    npy = F.to_json(F.struct(F.lit("f8").alias("dataType"), F.array(F.lit(2)).alias("shape"), F.lit(False).alias("fortran_order"), F.lit(1.0).alias("version"), F.array(region.cast("double"), F.lit(2.5)).alias("dataVector")))
    vector = t("JSONToNumPyObject", npy)
    written = t("JSONTonpy", F.to_json(F.struct(F.lit("f8").alias("dataType"), F.array(F.lit(1)).alias("shape"), F.array(F.col("n_nationkey").cast("double")).alias("dataVector"))))
    message = t("ArrayToISO8385", F.concat(F.lit('[[70, "x"], [2, "'), name, F.lit('"]]')))
    nulled = F.concat(F.lit('{"name":"'), name, F.lit('","n":'), region.cast("string"), F.lit(',"none":null}'))
    simple = lambda **o: formats.as_udf(lambda v: json.dumps(formats.simple_array(json.loads(v), **o)), "string")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", t("CompressedToString", t("StringToCompressed", name)).alias("text"), F.variant_get(t("CompressedToJSON", t("JSONToCompressed", obj)), "$.name", "string").alias("json"), t("JSONToJSON", obj).alias("same"), t("JSONToArray", both).alias("pairs"),
        t("JSONToHTML", obj).alias("html"), t("JSONToString", F.struct(F.col("n_nationkey").alias("a"))).alias("shown"), vector["dataVector"].alias("vector"), vector["shape"].alias("shape"), t("NumPyObjectToJSON", vector).alias("object"),
        F.from_json(F.get_json_object(t("npyToJSON", written), "$.dataVector"), "array<double>").alias("npy"), t("ISO8385ToArray", message).alias("message"), simple()(nulled).alias("simple"), simple(ignore_nulls=True, prefix="p.")(nulled).alias("simple_some"),
    )


@query("""SELECT n_nationkey, '[[["name", "n"], ["' || n_name || '", ' || n_regionkey || ']]]' AS sheet_rows, n_name AS cell, 'A1:B2' AS ref, n_regionkey AS number, '{"Sheet1": [["name", "n"], ["' || n_name || '", ' || n_regionkey || ']]}' AS rows_back, n_name AS read_back, n_name AS object_rows FROM nation""")
def transforms_workbooks(spark, sf_dir):
    rows = F.concat(F.lit('[["name","n"],["'), "n_name", F.lit('",'), F.col("n_regionkey").cast("string"), F.lit("]]"))
    objects = F.to_json(F.array(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("n"))))
    file, book = t("ArrayToXLSX", rows), t("JSONToXLSXObject", objects)
    get = F.get_json_object
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", t("XLSXToArray", file).alias("sheet_rows"), get(t("ArrayToXLSXObject", rows), "$.Sheets.Sheet1.A2.v").alias("cell"), get(book, "$.Sheets.Sheet1['!ref']").alias("ref"), get(book, "$.Sheets.Sheet1.B2.v").cast("int").alias("number"),
        t("XLSXObjectToJSON", book).alias("rows_back"), get(t("XLSXToXLSXObject", file), "$.Sheets.Sheet1.A2.v").alias("read_back"), get(t("XLSXObjectToArray", book), "$[0][1][0]").alias("object_rows"),
    )


@query("SELECT n_regionkey AS key, list(n_name ORDER BY n_nationkey) AS list FROM nation GROUP BY 1")
def transforms_lists(spark, sf_dir):
    return formats.add_list(table(spark, sf_dir, "nation"), "n_regionkey", "n_name", "n_nationkey").withColumnRenamed("n_regionkey", "key")
