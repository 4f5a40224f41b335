"""Other sources and sinks: single-file column stores, text appended to rows, processes, host metrics, injected load."""

from __future__ import annotations

import gzip
import json
import os
import struct
import subprocess
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"PARQ"
_SQL = {"number": "double", "boolean": "boolean", "string": "string"}


def decode(data: bytes) -> tuple[dict, pa.Table]:
    """Metadata and columns of a store: magic, length and JSON metadata, then per column its length and gzip bytes.

    Numbers are little-endian doubles (NaN is null), booleans bytes, strings length and UTF-8; other columns are JSON.
    """
    if data[:4] != MAGIC:
        raise ValueError("Invalid format")
    size = struct.unpack_from("<I", data, 4)[0]
    meta, at = json.loads(data[8 : 8 + size]), 8 + size
    n, columns = meta["numRows"], {}
    for c in meta["columns"]:
        size = struct.unpack_from("<I", data, at)[0]
        raw = gzip.decompress(data[at + 4 : at + 4 + size])
        at += 4 + size
        if c["type"] == "number":
            x = np.frombuffer(raw, "<f8", n)
            column = pa.array(x, mask=np.isnan(x))
        elif c["type"] == "boolean":
            column = pa.array(np.frombuffer(raw, np.uint8, n).astype(bool))
        elif c["type"] == "string":
            values, k = [], 0
            for _ in range(n):
                length = struct.unpack_from("<I", raw, k)[0]
                values.append(raw[k + 4 : k + 4 + length].decode())
                k += 4 + length
            column = pa.array(values, pa.string())
        else:
            column = pa.array([None if v is None else json.dumps(v) for v in json.loads(raw)], pa.string())
        columns[c["name"]] = column
    return meta, pa.table(columns)


def encode(table: pa.Table) -> bytes:
    parts, columns = [], []
    for f, c in zip(table.schema, table.columns):
        values = c.to_pylist()
        if pa.types.is_boolean(f.type):
            kind, raw = "boolean", bytes(bool(v) for v in values)
        elif pa.types.is_integer(f.type) or pa.types.is_floating(f.type):
            kind, raw = "number", np.array([np.nan if v is None else v for v in values], "<f8").tobytes()
        elif pa.types.is_string(f.type):
            kind, raw = "string", b"".join(struct.pack("<I", len(b)) + b for b in ((v or "").encode() for v in values))
        else:
            kind, raw = "object", json.dumps(values).encode()
        packed = gzip.compress(raw, mtime=0)
        columns.append({"name": f.name, "type": kind, "length": len(packed)})
        parts.append(struct.pack("<I", len(packed)) + packed)
    meta = {"version": 1, "schema": {c["name"]: c["type"] for c in columns}, "numRows": len(table), "numColumns": len(columns), "compression": "gzip", "columns": columns}
    head = json.dumps(meta).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


def decoded(files: DataFrame, schema: str, column: str = "content") -> DataFrame:
    """Rows of stores (column, binary) with the columns of schema; a file is one task's, as the format has no blocks."""
    from pyspark.sql import types as T

    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def rows(batches):
        for b in batches:
            for content in b.column(0):
                yield from decode(content.as_buffer().to_pybytes())[1].select(names).to_batches()

    return files.select(column).mapInArrow(rows, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all stores under path that have the first one's columns."""
    files = spark.read.format("binaryFile").load(path).select("content")
    meta, _ = decode(bytes(files.first()["content"]))
    return decoded(files, ", ".join(f"`{c['name']}` {_SQL.get(c['type'], 'string')}" for c in meta["columns"]))


def append_text(df: DataFrame, column: str, path: str) -> DataFrame:
    """df with a text file's content behind column (files of a folder in order of their paths); it is one broadcast row."""
    files = df.sparkSession.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("f"), "value")
    more = files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "value"))), lambda s: s["value"]), "").alias("__more"))
    return df.crossJoin(F.broadcast(more)).withColumn(column, F.concat(column, "__more")).drop("__more")


def folder(spark: SparkSession, path: str, least: int = 10, most: int | None = None, files: int | None = None) -> DataFrame:
    """path and text of the text files of a folder: printable lines longer than least characters; the first files by path if
    asked, most characters of each if asked."""
    lines = F.filter(F.split(F.regexp_replace("value", r"[^\x20-\x7E\r\n]", ""), r"[\r\n]+"), lambda x: F.length(x) > least)
    out = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.array_join(lines, "\n").alias("text"))
    out = out if files is None else out.orderBy("path").limit(files)
    return out if most is None else out.withColumn("text", F.substring("text", 1, most))


def through(df: DataFrame, column: str, command: list[str], timeout: float | None = None) -> DataFrame:
    """What a process a partition says to the partition's values of column, one line a value: rows (stream, line) of its
    stdout and stderr as they come, and one of its return code (stream "rc"). A process that is silent and alive after
    timeout seconds is killed, its return code then negative. Values are written while lines are read, so neither is held."""

    def run(batches):
        import queue
        import threading

        process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True)
        said: queue.Queue = queue.Queue(10_000)

        def write() -> None:
            try:
                for b in batches:
                    for v in b.column(0).to_pylist():
                        if v is not None:
                            process.stdin.write(f"{v}\n")
                process.stdin.close()
            except BrokenPipeError:
                pass

        def read(name: str) -> None:
            for line in getattr(process, name):
                said.put((name, line.rstrip("\n")))
            said.put(None)

        readers = [threading.Thread(target=read, args=(n,), daemon=True) for n in ("stdout", "stderr")]
        writer = threading.Thread(target=write, daemon=True)
        for t in (*readers, writer):
            t.start()
        rows, open_, wait = [], 2, timeout
        while open_:
            try:
                got = said.get(timeout=wait)
            except queue.Empty:
                process.kill()
                wait = None
                continue
            if got is None:
                open_ -= 1
            else:
                rows.append(got)
            if len(rows) >= 1000:
                yield lines(rows)
                rows = []
        rows.append(("rc", str(process.wait())))
        yield lines(rows)

    def lines(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["stream", "line"])

    return df.select(F.col(column).cast("string")).mapInArrow(run, "stream string, line string")


def host_metrics(spark: SparkSession) -> DataFrame:
    """One sample of the driver's host: load, processors, memory, process time."""
    load = os.getloadavg()
    memory = {k: int(v.split()[0]) * 1024 for k, v in (x.split(":") for x in open("/proc/meminfo"))} if os.path.exists("/proc/meminfo") else {}
    sample = {"ts": time.time(), "load1": load[0], "load5": load[1], "load15": load[2], "cpus": float(os.cpu_count() or 0), "memory": float(memory.get("MemTotal", 0)), "free": float(memory.get("MemAvailable", 0)), "process_s": time.process_time()}
    return spark.createDataFrame([(k, v) for k, v in sample.items()], "metric string, value double")


def injected(spark: SparkSession, per_second: int) -> DataFrame:
    """A stream of numbered rows at a steady rate."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def load(spark: SparkSession, seconds: float, least: float, most: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(messages, summary) of a load of so many seconds: a message (id, at) after each think time, drawn from least to most
    seconds; the summary has their count, and when the load starts and stops. Times are seconds from the start."""
    if not 0 < least <= most:
        raise ValueError("think times must be positive, the least first")
    n = int(seconds / least) + 1
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    drawn = spark.range(n, numPartitions=1).select("id", (F.lit(float(least)) + F.rand(seed) * (most - least)).alias("think"))
    messages = drawn.select("id", F.sum("think").over(w).alias("at")).where(F.col("at") <= seconds)
    return messages, messages.agg(F.count(F.lit(1)).alias("count"), F.lit(0.0).alias("started"), F.lit(float(seconds)).alias("stopped"))
