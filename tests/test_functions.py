import json

import pytest
from pyspark.sql import functions as F

from quern.functions import formats
from quern.functions.text import transform


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    ("source", "target", "x", "more", "want"),
    [
        ("String", "TitleGrammatical", "to be or not to be", (), "To Be or Not to Be"),
        ("String", "Title", "aBcd def", (), "ABcd Def"),
        ("String", "Camelize", "foo bar-baz", (), "fooBarBaz"),
        ("String", "DelimiterOnCase", "fooBar_baz  q", (), "foo-bar-baz-q"),
        ("String", "DelimiterOnCase", "HTMLPage É", (), "h-t-m-l-page-É"),
        ("String", "GetWord", "one two three", (2,), "two"),
        ("String", "GetWord", "one two three", (4,), ""),
        ("String", "XmlStringEncode", 'a<>"&c', (), "a&lt;&gt;&quot;&amp;c"),
        ("String", "Float", "1.5abc", (), 1.5),
        ("String", "Integer", "12px", (), 12),
        ("String", "Integer", "ff", (16,), 255),
        ("String", "Number", "", (), 0.0),
        ("String", "At", "abc", (-1,), "c"),
        ("String", "CharAt", "abc", (5,), ""),
        ("String", "DropSquareBracketPrefix", "[x] rest", (), "rest"),
        ("String", "ArrayByDelimiter", "a| b ||c", ("|",), ["a", "b", "c"]),
        ("String", "Trim", "  \t x  ", (), "x"),
        ("String", "DeunderscoreCapitilize", "ab_cd", (), "Ab Cd"),
        ("Number", "Abbreviated", 0.0, (), "0.00"),
        ("Number", "Abbreviated", 1.1234567, (), "1.12"),
        ("Number", "Abbreviated", 1001.0, (), "1.00K"),
        ("Number", "Abbreviated", 2011000.1, (), "2.01M"),
        ("Number", "Abbreviated", 2011002003004005.0, (), "2.01P"),
        ("Number", "RangeLimit", 5.0, (2.0, 4.0), 4.0),
        ("path", "Basename", "/a/b.txt", (), "b.txt"),
        ("path", "Extname", "/a/b.tar.gz", (), ".gz"),
        ("path", "Dirname", "/a/b.txt", (), "/a"),
        ("path", "Normalize", "/a/../b//./c", (), "/b/c"),
        ("path", "Normalize", "../x/..", (), ".."),
        ("path", "Resolve", "b/../c", ("/r",), "/r/c"),
        ("Object", "Nullif", "a", ("a",), None),
    ],
)
def test_transforms(spark, source, target, x, more, want):
    assert value(spark, transform(source, target, F.lit(x), *more)) == want


def test_unknown_transform():
    with pytest.raises(ValueError, match="No transform"):
        transform("String", "Nothing", None)


def test_csv(spark):
    assert value(spark, formats.csv_cells(F.lit('first,,"la,st"'))) == ["first", None, "la,st"]
    assert value(spark, formats.csv_records(F.lit("a,b\n1,2\n3,4"))) == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}]
    assert value(spark, formats.html_table(formats.csv_rows(F.lit("a\n1")), True)) == "<table><tr><th><![CDATA[a]]></th></tr><tr><td><![CDATA[1]]></td></tr></table>"
    assert value(spark, formats.html_table(F.array(F.array(F.lit("x]]>y"))))) == "<table><tr><td><![CDATA[x]]]]><![CDATA[>y]]></td></tr></table>"
    assert value(spark, formats.json_lines(F.array(F.lit('a"b'), F.lit("[c]")))) == '"a\\"b"\n"[c]"'
    assert value(spark, formats.json_lines(F.array(F.lit(1), F.lit(None)))) == "1\nnull"
    assert json.loads(value(spark, formats.csv_values(F.lit('1,,2,"x ""y"", z",1e2,-')))) == [1, None, 2, 'x "y", z', 100, "-"] and json.loads(value(spark, formats.csv_values(F.lit("")))) == []
    assert value(spark, formats.csv_cells(F.lit('"' + 'a,""' * 200_000 + '",b')))[1] == "b"
    assert formats.csv_line('a,,1,2.5,"x,y"') == ["a", None, 1, 2.5, "x,y"]


def test_simple_arrays():
    assert formats.simple_array({}) == [] and formats.simple_array({"a": 1, "b": "2", "c": None, "d": True}) == [["a", 1, "number"], ["b", "2", "string"], ["c", None, "object"], ["d", True, "boolean"]]
    assert formats.simple_array({"a": 1, "c": None}, ignore_nulls=True) == [["a", 1, "number"]]


def test_snappy():
    data = b"abcd" * 100_000 + b"x"
    packed = formats.snappy_compress(data)
    assert formats.snappy_decompress(packed) == data and len(packed) < len(data) // 10 and formats.snappy_decompress(formats.snappy_compress(b"")) == b""


def test_workbook_objects():
    book = formats.workbook({"s": [["a", None, 1.5], [True]], "none": []})
    assert book["Sheets"]["s"]["C1"] == {"t": "n", "v": 1.5} and book["Sheets"]["s"]["!ref"] == "A1:C2" and formats.workbook_rows(book) == {"s": [["a", None, 1.5], [True, None, None]], "none": []}


def test_messages_need_an_array(spark):
    with pytest.raises(ValueError, match="no array"):
        formats.messages(spark.createDataFrame([(1, "x")], "id int, a string"), "a")


def test_messages(spark):
    df = spark.createDataFrame([(1, [5, 6])], "id int, a array<int>")
    assert [tuple(r) for r in formats.messages(df, "a", id_col="id").collect()] == [(1, 0, 5, "1:0"), (1, 1, 6, "1:1")]
    with pytest.raises(Exception, match="too many"):
        formats.messages(df, "a", most=1).collect()


def test_xml():
    text = "<testTag testAttr='v'>body<subtag>a subtag value</subtag></testTag>"
    assert formats.xml_to_object(text) == {"testTag": {"#text": "body", "@_testAttr": "v", "subtag": "a subtag value"}}
    assert formats.object_to_xml({"name": "testname"}) == "<name>testname</name>"


@pytest.mark.parametrize("codec", sorted(formats.CODECS))
def test_codecs(codec):
    compress, decompress = formats.CODECS[codec]
    for data in (b"", b"abc", bytes(range(256)) * 400):
        assert decompress(compress(data)) == data


def test_snappy_copies():
    assert formats.snappy_decompress(bytes([8, 3 << 2]) + b"abcd" + bytes([(4 - 4) << 2 | 1, 4])) == b"abcdabcd"


def test_workbook_and_arrays():
    book = {"worksheet1": [[11, 12], [21, 22], [31, 32]], "worksheet2": [[11, "x<y"], [21, 2.5]]}
    assert formats.xlsx_read(formats.xlsx_write(book)) == book
    got = formats.npy_read(formats.npy_write([1, 2, 3, 4], "<f4", [2, 2]))
    assert got == {"dataType": "f4", "shape": [2, 2], "fortran_order": False, "version": 1.0, "dataVector": [1.0, 2.0, 3.0, 4.0]}


SCHEMA = {"type": "record", "name": "r", "fields": [{"name": "name", "type": "string"}, {"name": "n", "type": ["null", "long"]}, {"name": "xs", "type": {"type": "array", "items": "double"}}, {"name": "m", "type": {"type": "map", "values": "boolean"}}]}


def test_avro():
    row = {"name": "testname", "n": -7, "xs": [1.5, 2.5], "m": {"a": True}}
    for codec in ("null", "deflate"):
        assert formats.avro_container_read(formats.avro_container(SCHEMA, [row, row | {"n": None}], codec)) == (SCHEMA, [row, row | {"n": None}])
    assert formats.framed_decode({1: SCHEMA}, formats.framed_encode(1, SCHEMA, row)) == {"schema": 1, "data": row}
    with pytest.raises(ValueError, match='Invalid field "name"'):
        formats.avro_encode(SCHEMA, row | {"name": 5})


def test_bitmap():
    fields = [(2, "4111"), (39, "00"), (70, "x")]
    assert formats.bitmap_decode(formats.bitmap_encode(fields)) == [(0, "0200"), *fields]


def test_objects():
    assert formats.object_to_pairs({"a": 1, "b": {"c": 2}}) == [["a", [1]], ["b", [["c", [2]]]]]
    assert formats.object_to_pairs({"a": [5, None]}) == [["a", [["0", [5]], ["1", [None]]]]]
    assert formats.object_to_html({"a": [1]}) == "<table><tr><td>a</td><td><table><tr><td>1</td></tr></table></td></tr></table>"
    assert json.dumps(formats.xml_to_object("<a><b>1</b><b>2</b></a>")) == '{"a": {"b": ["1", "2"]}}'
