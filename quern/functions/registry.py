"""Every transform by name, <source>To<target>, as f(column, **options) -> column. Binary formats run in Arrow-batched UDFs."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import formats as f
from .text import TRANSFORMS, transform


def _bytes_of(encode):
    return lambda c, **o: f.as_udf(lambda t: encode(json.loads(t), **o), "binary")(c)


def _text_of(decode):
    return lambda c, **o: f.as_udf(lambda b: json.dumps(decode(b, **o)), "string")(c)


def _rows(value):
    """Sheets of objects as sheets of rows under a header."""
    rows = lambda v: v if not v or isinstance(v[0], list) else [[*(h := list(dict.fromkeys(k for r in v for k in r)))], *([r.get(k) for k in h] for r in v)]
    return {k: rows(v) for k, v in value.items()} if isinstance(value, dict) else rows(value)


def _sheets(value):
    return f.xlsx_write(_rows(value))


def _messages(c, skip: int = 0, most: int | None = None):
    """An entry a row, without the first skip entries, most of them at most."""
    return F.explode(F.slice(c, skip + 1, (1 << 30) if most is None else most))


def _line(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _csv(value, delimiter: str = ","):
    """Objects: a header of all keys, sorted, and plain cells. Arrays: cells of JSON. Anything else: a line of JSON an entry."""
    if not isinstance(value, list):
        return _line(value)
    if not value or not isinstance(value[0], dict):
        return "\n".join(delimiter.join(map(_line, r)) if isinstance(r, list) else _line(r) for r in value)
    head = sorted({k for r in value if isinstance(r, dict) for k in r})
    cell = lambda v: "" if v is None else v if isinstance(v, str) and delimiter not in v and '"' not in v else _line(v)
    row = lambda r: delimiter.join(cell(r.get(k)) for k in head) if isinstance(r, dict) else delimiter * len(head) + _line(r)
    return "\n".join([delimiter.join(map(cell, head)), *map(row, value)])


def _json_text(fn):
    return lambda c, **o: f.as_udf(lambda t: fn(json.loads(t), **o), "string")(c)


_avro_in = lambda c, schema: f.json_to_avro(c, schema)
_framed_in = lambda c, schemas: f.as_udf(lambda t: (lambda v: f.framed_encode(v["schema"], schemas[v["schema"]], v["data"]))(json.loads(t)), "binary")(c)
_npy_in = _bytes_of(lambda v: f.npy_write(v["dataVector"], "<" + v["dataType"].lstrip("<|>="), v["shape"], v.get("fortran_order", False)))
_bitmap_names = lambda names: {k: n for n, k in names.items()}

REGISTRY = {
    "ArrayToCSV": lambda c: f.json_lines(c), "ArrayToHTML": lambda c: f.html_table(c), "ArrayToISO8385": _bytes_of(lambda v: f.bitmap_encode([(int(k), str(x)) for k, x in v])), "ArrayToMessages": _messages,
    "ArrayToXLSX": _bytes_of(_sheets), "ArrayToXLSXObject": _json_text(lambda v: json.dumps(f.workbook(_rows(v)))), "AVROToJSON": lambda c, schema: f.avro_to_json(c, schema), "BufferToCompressed": f.compress, "CompressedToBuffer": f.decompress,
    "CompressedToJSON": lambda c, codec="gzip": F.try_parse_json(F.decode(f.decompress(c, codec), "UTF-8")), "CompressedToString": lambda c, codec="gzip": F.decode(f.decompress(c, codec), "UTF-8"),
    "ConfluenceToJSON": lambda c, schemas: f.as_udf(lambda b: json.dumps(f.framed_decode(schemas, b)), "string")(c), "CSVToArray": f.csv_table, "CSVToCells": f.csv_rows, "CSVToHTML": f.csv_html,
    "CSVToMessages": lambda c, skip=0, most=None: _messages(F.filter(F.split(c, r"[\r\n]+"), lambda x: x != ""), skip, most), "CSVWithHeaderToArray": lambda c: F.slice(f.csv_rows(c), 2, 1 << 30), "CSVWithHeaderToHTML": lambda c: f.csv_html(c, True), "CSVWithHeaderToJSON": f.csv_records,
    "ISO8385ToArray": _text_of(f.bitmap_decode), "ISO8385ToJSON": lambda c, names=None: _text_of(lambda b: {(names or {}).get(k, str(k)): v for k, v in f.bitmap_decode(b)})(c), "JSONToArray": _json_text(lambda v: json.dumps(f.object_to_pairs(v))),
    "JSONToAVRO": _avro_in, "JSONToCompressed": f.compress, "JSONToConfluence": _framed_in, "JSONToCSV": _json_text(_csv), "JSONToHTML": _json_text(f.object_to_html),
    "JSONToISO8385": lambda c, names=None: _bytes_of(lambda v: f.bitmap_encode([(int(_bitmap_names(names or {}).get(k, k)), str(x)) for k, x in v.items()]))(c), "JSONToJSON": lambda c: c, "JSONToMessages": lambda c, skip=0, most=None: _messages(F.from_json(c, "array<string>"), skip, most),
    "JSONTonpy": _npy_in, "JSONToNumPyObject": lambda c: F.from_json(c, "dataType string, shape array<int>, fortran_order boolean, version double, dataVector array<double>"), "JSONToString": F.to_json, "JSONToXLSX": _bytes_of(_sheets),
    "JSONToXLSXObject": _json_text(lambda v: json.dumps(f.workbook(_rows(v)))), "JSONToXML": f.json_to_xml, "npyToJSON": _text_of(f.npy_read), "npyToNumPyObject": lambda c: REGISTRY["JSONToNumPyObject"](_text_of(f.npy_read)(c)), "NumPyObjectToJSON": F.to_json,
    "snappyToCompress": lambda c: f.compress(c, "snappy"), "snappyToUncompress": lambda c: f.decompress(c, "snappy"), "StringToCompressed": f.compress, "XLSXToArray": _text_of(lambda b: list(f.xlsx_read(b).values())), "XLSXObjectToArray": _json_text(lambda v: json.dumps(list(f.workbook_rows(v).values()))),
    "XLSXToJSON": _text_of(f.xlsx_read), "XLSXObjectToJSON": _json_text(lambda v: json.dumps(f.workbook_rows(v))), "XLSXToXLSXObject": _text_of(lambda b: f.workbook(f.xlsx_read(b))), "XMLToJSON": f.xml_to_json,
} | {f"{s}To{t}": (lambda c, *a, s=s, t=t: transform(s, t, c, *a)) for s, targets in TRANSFORMS.items() for t in targets}


def apply(name: str, c: Column, *arguments, **options) -> Column:
    if name not in REGISTRY:
        raise ValueError(f"No transform {name}")
    return REGISTRY[name](c, *arguments, **options)
