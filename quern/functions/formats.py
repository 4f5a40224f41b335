"""Format transforms: JSON, CSV, HTML, XML, compressed bytes, npy, XLSX, Avro, framed Avro and bitmap messages.

Text formats are Spark expressions. Binary ones are plain Python codecs, applied by Arrow-batched UDFs (see as_udf).
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree as ET

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf


def as_udf(f: Callable, returns: str, kind: pa.DataType | None = None):
    """f of one value as a column function; null stays null."""
    kinds = {"binary": pa.binary(), "string": pa.string()}

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], kind or kinds[returns])

    return arrow_udf(run, returns)


# --- text formats


def _cells(line: str) -> list[str | None]:
    """Cells of a line: commas outside quotes part, quotes around a cell go, two inside are one, an empty cell is null."""
    if '"' not in line:
        return [x.strip() or None for x in line.split(",")]
    out, cell, quoted, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if quoted:
            if c != '"':
                cell.append(c)
            elif line[i + 1 : i + 2] == '"':
                cell.append(c)
                i += 1
            else:
                quoted = False
        elif c == '"' and not "".join(cell).strip():
            quoted, cell = True, []
        elif c == ",":
            out.append("".join(cell))
            cell = []
        else:
            cell.append(c)
        i += 1
    return [x.strip() or None for x in (*out, "".join(cell))]


def _udf_of(f, returns: str, kind: pa.DataType):
    return arrow_udf(lambda values: pa.array([None if v is None else f(v) for v in values.to_pylist()], kind), returns)


def csv_cells(line: Column) -> Column:
    """array<string> of a line's cells, in one pass over it; an empty line has none."""
    return _udf_of(lambda v: _cells(v) if v else [], "array<string>", pa.list_(pa.string()))(line)


def csv_values(line: Column) -> Column:
    """A line's cells as JSON, those that are numbers as numbers."""
    return as_udf(lambda v: json.dumps([_number(x) for x in _cells(v)] if v else []), "string")(line)


def _number(x: str | None):
    if x is None:
        return None
    try:
        v = float(x)
    except ValueError:
        return x
    return x if v != v or v in (float("inf"), float("-inf")) else int(v) if v.is_integer() and abs(v) < 2**53 else v


def csv_rows(text: Column) -> Column:
    """array<array<string>> of a text's lines that aren't empty."""
    return _udf_of(_lines, "array<array<string>>", pa.list_(pa.list_(pa.string())))(text)


def csv_table(text: Column) -> Column:
    """A text's lines as JSON rows, numbers as numbers."""
    return as_udf(lambda v: json.dumps([[_number(c) for c in r] for r in _lines(v)]), "string")(text)


def _lines(text: str) -> list[list[str | None]]:
    return [_cells(x) for x in re.split(r"[\r\n]+", text) if x]


def _records(text: str) -> list[dict]:
    head, *rows = _lines(text) or [[]]
    return [{h or "": v for h, v in zip(head, r)} for r in rows]


def csv_records(text: Column) -> Column:
    """array<map<string,string>> by the header line."""
    return _udf_of(lambda v: [list(r.items()) for r in _records(v)], "array<map<string,string>>", pa.list_(pa.map_(pa.string(), pa.string())))(text)


def _html(rows: list[list], header: bool) -> str:
    cell = lambda tag, v: f"<{tag}><![CDATA[{(v or '').replace(']]>', ']]]]><![CDATA[>')}]]></{tag}>"
    line = lambda i, r: "<tr>" + "".join(cell("th" if header and i == 0 else "td", v) for v in r) + "</tr>"
    return "<table>" + "".join(line(i, r) for i, r in enumerate(rows)) + "</table>"


def csv_html(text: Column, header: bool = False) -> Column:
    """A table of a text's lines; see html_table."""
    return as_udf(lambda v: _html(_lines(v), header), "string")(text)


def html_table(rows: Column, header: bool = False) -> Column:
    """Cells are character data; an end mark inside one is split over two sections."""
    data = lambda v: F.replace(F.coalesce(v.cast("string"), F.lit("")), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    cell = lambda tag: lambda v: F.concat(F.lit(f"<{tag}><![CDATA["), data(v), F.lit(f"]]></{tag}>"))
    line = lambda r, i: F.concat(F.lit("<tr>"), F.array_join(F.when((i == 0) & F.lit(header), F.transform(r, cell("th"))).otherwise(F.transform(r, cell("td"))), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, line), ""), F.lit("</table>"))


def array_of(df: DataFrame, column: str) -> Column:
    """A column that must hold arrays; an error for any other."""
    kind = df.schema[column].dataType.simpleString()
    if not kind.startswith("array<"):
        raise ValueError(f'"{column}" is no array but {kind}')
    return F.col(column)


def json_lines(array: Column) -> Column:
    """A line of JSON an entry; null entries are null lines."""
    one = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    return F.array_join(F.transform(array, one), "\n")


def to_csv_text(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """One string column csv per row, its columns in order of their names; see header()."""
    q = lambda c: F.when(c.rlike(r'["\r\n]') | c.contains(delimiter), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return df.select(F.array_join(F.array(*(q(F.col(f"`{c}`").cast("string")) for c in sorted(df.columns))), delimiter).alias("csv"))


def header(df: DataFrame, delimiter: str = ",") -> str:
    return delimiter.join(sorted(df.columns))


def messages(df: DataFrame, array: str, most: int = 1000, id_col: str | None = None) -> DataFrame:
    """A row an entry, numbered; an error for an array of more than most entries."""
    guarded = F.when(F.size(array_of(df, array)) > most, F.raise_error(F.lit("too many messages"))).otherwise(F.col(array))
    keep = [c for c in df.columns if c != array]
    out = df.select(*keep, F.posexplode(guarded).alias("index", "value"))
    return out if id_col is None else out.withColumn("message_id", F.concat_ws(":", F.col(id_col).cast("string"), "index"))


def xml_to_object(text: str):
    """{tag: value}: attributes as @_name, text beside them as #text, repeated children as lists."""

    def walk(e: ET.Element):
        out: dict = {f"@_{k}": v for k, v in e.attrib.items()}
        for child in e:
            value = walk(child)
            if child.tag in out:
                out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), value]
            else:
                out[child.tag] = value
        body = e.text or ""
        if not out:
            return body
        return ({"#text": body} if body.strip() else {}) | out

    root = ET.fromstring(text)
    return {root.tag: walk(root)}


def object_to_xml(value) -> str:
    def esc(s) -> str:
        return str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def one(tag: str, v) -> str:
        if isinstance(v, list):
            return "".join(one(tag, x) for x in v)
        if isinstance(v, dict):
            attrs = "".join(f' {k[2:]}="{esc(x)}"' for k, x in v.items() if k.startswith("@_"))
            inner = esc(v.get("#text", "")) + "".join(one(k, x) for k, x in v.items() if k != "#text" and not k.startswith("@_"))
            return f"<{tag}{attrs}>{inner}</{tag}>"
        return f"<{tag}>{'' if v is None else esc(v)}</{tag}>"

    return "".join(one(k, v) for k, v in value.items())


xml_to_json = lambda c: as_udf(lambda t: json.dumps(xml_to_object(t)), "string")(c)
json_to_xml = lambda c: as_udf(lambda t: object_to_xml(json.loads(t)), "string")(c)


def object_to_html(value) -> str:
    if isinstance(value, dict):
        return "<table>" + "".join(f"<tr><td>{k}</td><td>{object_to_html(v)}</td></tr>" for k, v in value.items()) + "</table>"
    if isinstance(value, list):
        return "<table>" + "".join(f"<tr><td>{object_to_html(v)}</td></tr>" for v in value) + "</table>"
    return "" if value is None else str(value)


def object_to_pairs(value):
    """[[key, pairs of the value], ...] at every level, an array's keys are its positions as strings; a scalar is [value]."""
    if isinstance(value, list):
        value = {str(i): v for i, v in enumerate(value)}
    return [[k, object_to_pairs(v)] for k, v in value.items()] if isinstance(value, dict) else [value]


def simple_array(value: dict, ignore_nulls: bool = False, prefix: str = "") -> list[list]:
    """[[key, value, type], ...] of an object's entries, those with a null left out if asked."""
    kind = lambda v: "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "object"
    return [[prefix + k, v, kind(v)] for k, v in value.items() if not (ignore_nulls and v is None)]


def add_list(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row a key with the list of its values, in order."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"]).alias("list"))


# --- compression

CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "gzip": (lambda b: gzip.compress(b, mtime=0), gzip.decompress),
    "zlib": (zlib.compress, zlib.decompress),
    "deflate": (lambda b: zlib.compress(b, wbits=-15), lambda b: zlib.decompress(b, wbits=-15)),
    "lzma": (lzma.compress, lzma.decompress),
}


_SNAPPY = pa.Codec("snappy")


def snappy_compress(data: bytes) -> bytes:
    return _SNAPPY.compress(data, asbytes=True)


def snappy_decompress(data: bytes) -> bytes:
    """Raw snappy; its length stands in front, seven bits a byte."""
    size = 0
    for k, b in enumerate(data):
        size |= (b & 127) << (7 * k)
        if b < 128:
            break
    return _SNAPPY.decompress(data, size, asbytes=True)


CODECS["snappy"] = (snappy_compress, snappy_decompress)


def compress(c: Column, codec: str = "gzip") -> Column:
    return as_udf(CODECS[codec][0], "binary")(c.cast("binary"))


def decompress(c: Column, codec: str = "gzip") -> Column:
    return as_udf(CODECS[codec][1], "binary")(c)


# --- arrays


def npy_write(values, dtype: str = "<f8", shape: list[int] | None = None, fortran: bool = False) -> bytes:
    out = io.BytesIO()
    a = np.array(values, dtype).reshape(shape or -1, order="F" if fortran else "C")
    np.lib.format.write_array(out, np.asfortranarray(a) if fortran else a, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def npy_read(data: bytes) -> dict:
    """{dataType, shape, fortran_order, version, dataVector}, the vector in stored order."""
    f = io.BytesIO(data)
    version = np.lib.format.read_magic(f)
    a = np.load(io.BytesIO(data), allow_pickle=False)
    fortran = a.flags.f_contiguous and not a.flags.c_contiguous
    return {"dataType": a.dtype.str.lstrip("<|>="), "shape": list(a.shape), "fortran_order": fortran, "version": float(f"{version[0]}.{version[1]}"), "dataVector": a.ravel(order="F" if fortran else "C").tolist()}


# --- workbooks


def xlsx_write(sheets: dict[str, list[list]] | list[list]) -> bytes:
    """A workbook of sheets of rows; numbers as numbers, the rest as inline strings."""
    if isinstance(sheets, list):
        sheets = {"Sheet1": sheets}
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{esc("" if v is None else v)}</t></is></c>'
    kind, part = "application/vnd.openxmlformats-officedocument.spreadsheetml", "application/vnd.openxmlformats-package.relationships+xml"
    n = len(sheets)
    files = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="{part}"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(n)) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{esc(s)}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, s in enumerate(sheets)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(n)) + "</Relationships>",
    }
    for k, rows in enumerate(sheets.values()):
        files[f"xl/worksheets/sheet{k + 1}.xml"] = f'<worksheet xmlns="{ns}"><sheetData>' + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def workbook(sheets: dict[str, list[list]] | list[list]) -> dict:
    """A workbook as an object: names of sheets, and per sheet its range and cells by address, each with type and value."""
    if isinstance(sheets, list):
        sheets = {"Sheet1": sheets}
    out: dict = {"SheetNames": list(sheets), "Sheets": {}}
    for name, rows in sheets.items():
        wide = max(map(len, rows), default=0)
        cells = {f"{_column(j)}{i + 1}": {"t": "b" if isinstance(v, bool) else "n" if isinstance(v, (int, float)) else "s", "v": v} for i, r in enumerate(rows) for j, v in enumerate(r) if v is not None}
        out["Sheets"][name] = {"!ref": f"A1:{_column(max(wide - 1, 0))}{max(len(rows), 1)}"} | cells
    return out


def workbook_rows(book: dict) -> dict[str, list[list]]:
    """Rows of each sheet of a workbook object; cells that aren't there are null."""
    out = {}
    for name in book["SheetNames"]:
        sheet = book["Sheets"][name]
        last = re.fullmatch(r"A1:([A-Z]+)([0-9]+)", sheet.get("!ref", "A1:A1"))
        wide = [_column(j) for j in range(_place(last[1]) + 1)]
        rows = [[sheet.get(f"{c}{i + 1}", {}).get("v") for c in wide] for i in range(int(last[2]))]
        out[name] = [] if rows == [[None]] else rows
    return out


def _column(j: int) -> str:
    out = ""
    j += 1
    while j:
        j, r = divmod(j - 1, 26)
        out = chr(65 + r) + out
    return out


def _place(name: str) -> int:
    j = 0
    for c in name:
        j = j * 26 + ord(c) - 64
    return j - 1


def xlsx_read(data: bytes) -> dict[str, list[list]]:
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet"):
            rows = []
            for r in ET.fromstring(z.read("xl/" + targets[s.get(rel)].removeprefix("/xl/"))).iter(f"{ns}row"):
                row: list = []
                for c in r:
                    if ref := re.match("[A-Z]+", c.get("r") or ""):
                        col = 0
                        for x in ref[0]:
                            col = col * 26 + ord(x) - 64
                        row += [None] * (col - 1 - len(row))
                    kind, v = c.get("t"), c.find(f"{ns}v")
                    if kind == "inlineStr":
                        row.append("".join(t.text or "" for t in c.iter(f"{ns}t")))
                    elif v is None:
                        row.append(None)
                    elif kind == "s":
                        row.append(shared[int(v.text)])
                    elif kind == "b":
                        row.append(v.text == "1")
                    elif kind in ("str", "e"):
                        row.append(v.text)
                    else:
                        f = float(v.text)
                        row.append(int(f) if f.is_integer() else f)
                rows.append(row)
            out[s.get("name")] = rows
    return out


# --- Avro


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _long(n: int) -> bytes:
    return _varint(n << 1 ^ n >> 63 if n >= 0 else (-n << 1) - 1)


def _matches(schema, v) -> bool:
    kind = schema["type"] if isinstance(schema, dict) else schema
    return {"null": v is None, "boolean": isinstance(v, bool), "string": isinstance(v, str), "bytes": isinstance(v, bytes), "array": isinstance(v, list), "enum": isinstance(v, str), "fixed": isinstance(v, bytes)}.get(kind, isinstance(v, dict) if kind in ("record", "map") else isinstance(v, (int, float)) and not isinstance(v, bool) and (kind not in ("int", "long") or float(v).is_integer()))


def avro_encode(schema, v) -> bytes:
    """A datum by an Avro schema; an error names what doesn't fit."""
    if isinstance(schema, list):
        for k, s in enumerate(schema):
            if _matches(s, v):
                return _long(k) + avro_encode(s, v)
        raise ValueError(f"Invalid value {v!r} for {schema}")
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return avro_encode(kind, v)
    if not _matches(schema, v):
        raise ValueError(f"Invalid value {v!r} for {kind}")
    if kind == "null":
        return b""
    if kind == "boolean":
        return bytes([v])
    if kind in ("int", "long"):
        return _long(int(v))
    if kind in ("float", "double"):
        return struct.pack("<f" if kind == "float" else "<d", v)
    if kind in ("string", "bytes"):
        b = v.encode() if kind == "string" else v
        return _long(len(b)) + b
    if kind == "fixed":
        return v
    if kind == "enum":
        return _long(schema["symbols"].index(v))
    if kind == "array":
        return (_long(len(v)) + b"".join(avro_encode(schema["items"], x) for x in v) if v else b"") + b"\0"
    if kind == "map":
        return (_long(len(v)) + b"".join(avro_encode("string", k) + avro_encode(schema["values"], x) for k, x in v.items()) if v else b"") + b"\0"
    parts = []
    for f in schema["fields"]:
        try:
            parts.append(avro_encode(f["type"], v.get(f["name"], f.get("default"))))
        except ValueError as e:
            raise ValueError(f'Invalid field "{f["name"]}": {e}') from None
    return b"".join(parts)


def avro_decode(schema, data: bytes, at: int = 0):
    """(datum, where it ends)."""

    def long(at: int) -> tuple[int, int]:
        n, at = _read_varint(data, at)
        return n >> 1 ^ -(n & 1), at

    if isinstance(schema, list):
        k, at = long(at)
        return avro_decode(schema[k], data, at)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, (dict, list)):
        return avro_decode(kind, data, at)
    if kind == "null":
        return None, at
    if kind == "boolean":
        return data[at] == 1, at + 1
    if kind in ("int", "long"):
        return long(at)
    if kind in ("float", "double"):
        n = 4 if kind == "float" else 8
        return struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0], at + n
    if kind in ("string", "bytes"):
        n, at = long(at)
        b = data[at : at + n]
        return (b.decode() if kind == "string" else b), at + n
    if kind == "fixed":
        return data[at : at + schema["size"]], at + schema["size"]
    if kind == "enum":
        k, at = long(at)
        return schema["symbols"][k], at
    if kind in ("array", "map"):
        items: list = []
        while True:
            n, at = long(at)
            if n == 0:
                return (items if kind == "array" else dict(items)), at
            if n < 0:
                n = -n
                _, at = long(at)
            for _ in range(n):
                if kind == "map":
                    k, at = avro_decode("string", data, at)
                    v, at = avro_decode(schema["values"], data, at)
                    items.append((k, v))
                else:
                    v, at = avro_decode(schema["items"], data, at)
                    items.append(v)
    out = {}
    for f in schema["fields"]:
        out[f["name"]], at = avro_decode(f["type"], data, at)
    return out, at


_SYNC = bytes(range(16))


def avro_container(schema, records: list[dict], codec: str = "null") -> bytes:
    meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
    body = b"".join(avro_encode(schema, r) for r in records)
    body = zlib.compress(body, wbits=-15) if codec == "deflate" else body
    return b"Obj\x01" + avro_encode({"type": "map", "values": "bytes"}, meta) + _SYNC + (_long(len(records)) + _long(len(body)) + body + _SYNC if records else b"")


def avro_container_read(data: bytes) -> tuple[dict, list[dict]]:
    if data[:4] != b"Obj\x01":
        raise ValueError("Invalid format")
    meta, at = avro_decode({"type": "map", "values": "bytes"}, data, 4)
    schema, at, out = json.loads(meta["avro.schema"]), at + 16, []
    while at < len(data):
        n, at = avro_decode("long", data, at)
        size, at = avro_decode("long", data, at)
        block = data[at : at + size]
        at += size + 16
        if meta.get("avro.codec") == b"deflate":
            block = zlib.decompress(block, wbits=-15)
        k = 0
        for _ in range(n):
            v, k = avro_decode(schema, block, k)
            out.append(v)
    return schema, out


def framed_encode(schema_id: int, schema, v) -> bytes:
    """Magic byte 0, schema id as four bytes, then the datum."""
    return b"\0" + struct.pack(">i", schema_id) + avro_encode(schema, v)


def framed_decode(schemas: dict[int, object], data: bytes) -> dict:
    if data[:1] != b"\0":
        raise ValueError("bad magic byte")
    k = struct.unpack(">i", data[1:5])[0]
    return {"schema": k, "data": avro_decode(schemas[k], data, 5)[0]}


def json_to_avro(c: Column, schema) -> Column:
    return as_udf(lambda t: avro_encode(schema, json.loads(t)), "binary")(c)


def avro_to_json(c: Column, schema) -> Column:
    return as_udf(lambda b: json.dumps(avro_decode(schema, b)[0]), "string")(c)


# --- bitmap messages: four digits of type, bitmaps of fields 1 to 64 and 65 to 128, then fields as length and text


def bitmap_encode(fields: list[tuple[int, str]], kind: str = "0200") -> bytes:
    bits = [k for k, _ in fields if k > 1]
    second = any(k > 64 for k in bits)
    mask = sum(1 << (128 - k) for k in bits) | (1 << 127 if second else 0)
    out = kind.encode() + mask.to_bytes(16, "big")[: 16 if second else 8]
    return out + b"".join(struct.pack(">H", len(v.encode())) + v.encode() for _, v in sorted((k, v) for k, v in fields if k > 1))


def bitmap_decode(data: bytes) -> list[tuple[int, str]]:
    second = data[4] & 128
    n = 16 if second else 8
    mask = int.from_bytes(data[4 : 4 + n], "big") << (0 if second else 64)
    at, out = 4 + n, [(0, data[:4].decode())]
    for k in range(2, 129):
        if mask >> (128 - k) & 1:
            size = struct.unpack(">H", data[at : at + 2])[0]
            out.append((k, data[at + 2 : at + 2 + size].decode()))
            at += 2 + size
    return out


def csv_line(text: str) -> list:
    """Cells of one line: numbers as numbers, empty cells null."""
    out: list = []
    for cell in next(csv.reader([text], skipinitialspace=True), []):
        try:
            out.append(None if cell == "" else float(cell) if re.search(r"[.eE]", cell) else int(cell))
        except ValueError:
            out.append(cell)
    return out
