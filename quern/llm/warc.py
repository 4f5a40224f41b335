"""WARC archives: written by Spark's own text writer, read back with boundary-chain verification.

A record ends with two line ends, so a text file whose line separator is CRLFCRLF, one row a record, is a WARC file. Read
with CRLFCRLF and a record's magic as line separator, an archive falls into fragments, from many tasks a file if it isn't
compressed, as a stream if it is. Each fragment with a header is a candidate that says where its successor starts. Chains
are followed inside the tasks' ranges, and from range to range by pointer jumping over tables; what the chain from the
file's start doesn't reach is no record, such as magic inside a payload.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from .common import scratch, table, written

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
LEAST = 100
RECORDS = 20_000
_MAGIC = "WARC/1."
_GAP = "\r\n\r\n"
_URN = "urn:quern:page:"


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, records: int = RECORDS, compression: str = "gzip", date: str = "1970-01-01T00:00:00Z") -> None:
    """One record a row: a response, or a revisit if a smaller id has an equal payload of at least least bytes.

    A null payload is empty, a null url leaves its header out, line ends in a url are percent-encoded. A null id is
    written as an empty one. Rows that repeat the smallest id of a payload are responses too. An empty table gives an
    archive without records. Only these columns are read, so others can't clash. A file holds what a task writes, records
    records at most, as one gzip stream unless compression is "none". The payloads move once, to meet the smallest id of
    their digest; a hot digest is split there.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumns({"n": F.octet_length("body"), "digest": F.sha2("body", 256)})
    first = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    rows = rows.join(first.hint("shuffle_hash"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    crlf = "\r\n"
    safe = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    name = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.coalesce(F.concat(F.lit(f"{crlf}WARC-Target-URI: "), safe), F.lit("")),
        F.lit(f"{crlf}WARC-Date: {date}{crlf}WARC-Record-ID: "), name("id"),
        F.lit(f"{crlf}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"{crlf}WARC-Refers-To: "), name("first"), F.lit(f"{crlf}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit(f"{crlf}WARC-Payload-Length: "), F.col("n").cast("string"),
        F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}Content-Length: "),
        F.when(revisit, F.lit(len(HTTP))).otherwise(F.col("n") + len(HTTP)).cast("string"), F.lit(crlf * 2),
    )
    value = F.concat(head, F.lit(HTTP), F.when(revisit, "").otherwise(F.col("body")))
    rows.select(value.alias("value")).write.option("lineSep", crlf * 2).option("maxRecordsPerFile", records).option("compression", compression).text(path)


_FIELDS = {
    "file": pa.string(), "block": pa.int64(), "at": pa.int64(), "to": pa.int64(), "record_id": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "record_type": pa.string(), "refers": pa.string(), "payload": pa.binary(), "digest_ok": pa.bool_(), "status": pa.string(),
}
_DDL = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean"}
_ROWS = ", ".join(f"{k} {_DDL[t]}" for k, t in _FIELDS.items())


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in _FIELDS.items()], list(_FIELDS))


def _bare(x: str | None) -> str | None:
    return x.strip("<>").removeprefix(_URN) if x is not None else None


def header_of(data: bytes) -> tuple[dict[str, str], int, int] | None:
    """(fields, where the block starts, where it ends) of a candidate, from the bytes behind its magic; none if it has no
    header that states a length. A header without its end was cut there, as its block begins with magic."""
    end = data.find(b"\r\n\r\n")
    end = len(data) if end < 0 else end
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines)}
    length = fields.get("content-length", "")
    return (fields, end + 4, end + 4 + int(length)) if re.fullmatch("[0-9]{1,15}", length) else None


def record_of(fields: dict[str, str], block: bytes | None, payloads: bool) -> dict:
    """A record's columns. Without its block (it spans fragments) its payload is still to come, status "spans"."""
    kind, said = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    row = {"record_id": _bare(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers": _bare(fields.get("warc-refers-to")), "status": "ok"}
    if kind == "revisit":
        length = fields.get("warc-payload-length", "")
        return row | {"payload_bytes": int(length) if length.isdigit() else None, "payload_digest": said or None, "digest_ok": True}
    if block is None:
        return row | {"payload_digest": said or None, "status": "spans"}
    body = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    digest = hashlib.sha256(body).hexdigest()
    return row | {"payload_bytes": len(body), "payload_digest": digest, "payload": body if payloads else None, "digest_ok": digest == said if said else None}


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where a task's range starts), data: what stands between separators, in order within a range."""
    text = spark.read.option("lineSep", _GAP + _MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"))


def _placed(batches):
    """(file, block, offset, first of its file, data) of fragments; offsets count from the first one of their range."""
    here, at = None, 0
    for batch in batches:
        for file, block, data in zip(*(batch.column(k) for k in ("file", "block", "data"))):
            key = file.as_py(), block.as_py()
            first = key != here and key[1] == 0
            if key != here:
                here, at = key, 0
            raw = data.as_buffer().to_pybytes()
            yield *key, at, first, raw
            at += len(raw) + len(_GAP) + len(_MAGIC)


def candidates(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """Candidates as rows of _FIELDS, with offsets from their range's start: at is that of their magic, to of their
    successor's. A row a range, of status "range", has its end in to."""

    def read(batches):
        rows, end, last = [], 0, None
        for file, block, at, first, data in _placed(batches):
            if last is not None and (file, block) != last:
                rows.append({"file": last[0], "block": last[1], "to": end, "status": "range"})
            last, end = (file, block), at + len(data) + len(_GAP) + len(_MAGIC)
            skip = len(_MAGIC) if first and data.startswith(_MAGIC.encode()) else 0
            found = header_of(data[skip:] if skip else data) if skip or not first else None
            if found:
                fields, start, stop = found
                whole = stop + skip <= len(data)
                row = record_of(fields, data[start + skip : stop + skip] if whole else None, payloads)
                begin = at if skip else at - len(_MAGIC)
                rows.append(row | {"file": file, "block": block, "at": begin, "to": at + skip + stop + len(_GAP)})
            if len(rows) >= 500:
                yield _batch(rows)
                rows = []
        if last is not None:
            rows.append({"file": last[0], "block": last[1], "to": end, "status": "range"})
        yield _batch(rows)

    return written(fragments(spark, path).mapInArrow(read, _ROWS), "warc-candidates")


def jumps(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Of sorted candidates: the index of each one's successor, or len(at)."""
    n = len(at)
    k = np.searchsorted(at, to)
    return np.append(np.where((k < n) & (at[np.minimum(k, n - 1)] == to), k, n), n) if n else np.zeros(1, np.int64)


def reachable(at: np.ndarray, to: np.ndarray, start: int = 0) -> np.ndarray:
    """Which of the sorted candidates the chain of successors from start reaches, by pointer jumping in O(log n) rounds."""
    n, jump = len(at), jumps(at, to)
    reach = np.zeros(n + 1, bool)
    reach[:n] = at == start
    while True:
        reach[jump[np.flatnonzero(reach)]] = True
        following = jump[jump]
        if (following == jump).all():
            return reach[:n]
        jump = following


def exits(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Where the chain from each sorted candidate leaves them: the offset behind its last one."""
    jump, n = jumps(at, to), len(at)
    last = np.append(np.arange(n), n)
    step = np.where(jump < n, jump, last)
    while True:
        following = step[step]
        if (following == step).all():
            return to[step[:n]]
        step = following


def entries(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, at) where the chain enters the ranges of files that have several: pointer jumping from the file's start, a
    round a doubling of the ranges passed. found: file, block, at, to."""
    several = ranges.groupBy("file").agg(F.count("*").alias("n")).where("n > 1")
    most = several.agg(F.max("n")).first()[0]
    start = found.where("at = 0").select("file", "at")
    if most is None:
        return start

    def leave(key, t):
        t = t.sort_by("at")
        out = exits(*(t[k].to_numpy() for k in ("at", "to")))
        return pa.table({"file": t["file"], "at": t["at"], "exit": pa.array(out, pa.int64())})

    jump = written(found.join(several.hint("merge"), "file", "left_semi").groupBy("file", "block").applyInArrow(leave, "file string, at bigint, exit bigint"), "warc-jumps")
    reach = start
    for _ in range(int(most - 1).bit_length()):
        after = reach.join(jump.hint("merge"), ["file", "at"]).select("file", F.col("exit").alias("at"))
        reach = written(reach.unionAll(after).distinct(), "warc-entries")
        double = jump.select("file", F.col("exit").alias("at"), F.col("exit").alias("e")).distinct().join(jump.hint("merge"), ["file", "at"]).select("file", F.col("e"), F.col("exit").alias("next")).distinct()
        jump = written(jump.join(double.hint("merge").withColumnRenamed("e", "exit"), ["file", "exit"], "left").select("file", "at", F.coalesce("next", "exit").alias("exit")), "warc-jumps")
    return reach


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under path: files of any size, as they are or compressed whole or record by record.

    Columns: record_id, url, payload_bytes, payload_digest, record_type, refers, payload (if asked for), digest_ok, status,
    file and at (the record's offset in its uncompressed bytes). payload_bytes and payload_digest of a response are taken
    from the bytes that were read, digest_ok says whether the digest is the one its header has; a revisit has its header's.
    What a header lacks is null. Bytes off the chain are no records; where the chain breaks before the file's end, a row of
    status "broken" says so, its at being where the next record should start. No file, or an empty one, no rows.

    No task holds more than a range's offsets and one record's bytes. Records whose payload has a separator are put together
    from their fragments by a second reading.
    """
    with scratch() as keep:
        all_ = candidates(spark, path, payloads)
        ranges = all_.where("status = 'range'").select("file", "block", "to")
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        ranges = keep(written(ranges.select("file", "block", F.coalesce(F.sum("to").over(before), F.lit(0)).alias("base"), F.max("block").over(Window.partitionBy("file")).alias("last"), "to"), "warc-ranges"))
        based = ranges.select("file", "block", "base", (F.col("base") + F.col("to")).alias("end"), (F.col("block") == F.col("last")).alias("final"))
        found = all_.where("status <> 'range'").join(based.hint("shuffle_hash"), ["file", "block"])
        found = found.withColumns({"at": F.col("at") + F.col("base"), "to": F.col("to") + F.col("base")}).drop("base")
        enter = entries(found.select("file", "block", "at", "to"), ranges).withColumn("entry", F.lit(True))
        found = found.join(enter.hint("merge"), ["file", "at"], "left").select(*_FIELDS, "end", "final", "entry")

        def on_chain(key, t):
            t = t.sort_by("at")
            at, to = (t[k].to_numpy() for k in ("at", "to"))
            start = np.flatnonzero(t["entry"].to_numpy(zero_copy_only=False) == True)  # noqa: E712
            if not len(start):
                return t.select(list(_FIELDS)).slice(0, 0)
            on = reachable(at, to, int(at[start[0]]))
            last, end, final = int(np.flatnonzero(on)[-1]), t["end"][0].as_py(), t["final"][0].as_py()
            # a range's end counts a separator, which the last one's hasn't; a file may end with or without the last gap
            over = int(to[last]) - (end - len(_GAP) - len(_MAGIC))
            stop = int(to[last]) if over <= len(_GAP) or not final else int(at[last])
            on[last] &= stop == to[last]
            out = t.select(list(_FIELDS)).filter(pa.array(on))
            if over not in (0, len(_GAP)) if final else over < len(_GAP):
                lost = _batch([{"file": key[0].as_py(), "block": key[1].as_py(), "at": stop, "status": "broken"}])
                out = pa.concat_tables([out, pa.Table.from_batches([lost])])
            return out

        kept = found.groupBy("file", "block").applyInArrow(on_chain, _ROWS)
        kept = keep(written(kept, "warc-records"))
        result = [c for c in _FIELDS if c not in ("block", "to")]
        out = kept.where("status <> 'spans'").select(*result)
        spans = kept.where("status = 'spans'")
        if spans.limit(1).count():
            out = out.unionAll(_together(spark, path, spans, ranges.select("file", "block", "base"), payloads).select(*result))
    return out


def _together(spark: SparkSession, path: str, spans: DataFrame, bases: DataFrame, payloads: bool) -> DataFrame:
    """Records whose payload has a separator: their fragments, read again and put together, a record a group."""

    def read(batches):
        rows = []
        for file, block, at, _, data in _placed(batches):
            rows.append((file, block, at, data))
            if len(rows) >= 500:
                yield parts(rows)
                rows = []
        yield parts(rows)

    def parts(rows):
        cols = list(zip(*rows)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["file", "block", "offset", "data"])

    def whole(key, t):
        t = t.sort_by("offset")
        data = (_GAP + _MAGIC).encode().join(x.as_buffer().to_pybytes() for x in t["data"].combine_chunks())
        data = data.removeprefix(_MAGIC.encode())
        fields, start, stop = header_of(data)
        row = record_of(fields, data[start:stop], payloads) if stop <= len(data) else {"status": "broken"}
        return pa.Table.from_batches([_batch([row | {"file": key[0].as_py(), "at": key[1].as_py()}])])

    files = spans.select("file").distinct()
    again = fragments(spark, path).join(F.broadcast(files), "file", "left_semi").mapInArrow(read, "file string, block bigint, offset bigint, data binary")
    again = again.join(bases.hint("shuffle_hash"), ["file", "block"]).withColumn("offset", F.col("offset") + F.col("base"))
    asked = spans.select("file", "at", "to")
    inside = (F.col("offset") >= F.col("at")) & (F.col("offset") < F.col("to"))
    return again.join(asked.hint("merge"), "file").where(inside).select("file", "at", "offset", "data").groupBy("file", "at").applyInArrow(whole, _ROWS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = shared_path(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    got = read_warc(spark, path, payloads=False)
    return got.select(F.expr("nullif(record_id, '')").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(kind).alias("refers_to"), "url", "digest_ok")


ORACLE = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to, d.url, true AS digest_ok
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest
"""
