import json
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import registry
from quern.operators import learn
from quern.plans.dialect import SqlError
from quern.sources import single_file as sf
from quern.sources.records import RecordStore
from quern.sources.shared import shared_path
from quern.sources.typed import TypedStore


def test_column_store(spark, tmp_path):
    t = pa.table({"n": pa.array([1.0, None]), "b": [True, False], "s": ["é", "x"], "o": [[1], [2]]})
    (tmp_path / "a.store").write_bytes(sf.encode(t))
    got = sf.read_files(spark, f"file://{tmp_path}/a.store").collect()
    assert [tuple(r) for r in got] == [(1.0, True, "é", "[1]"), (None, False, "x", "[2]")]
    with pytest.raises(ValueError, match="Invalid format"):
        sf.decode(b"nothing")


def test_text_and_process(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a line long enough\nshort\n")
    df = spark.createDataFrame([("x",), ("y",)], "c string")
    assert sf.append_text(df, "c", f"file://{tmp_path}/t.txt").first()["c"].startswith("xa line")
    assert sf.folder(spark, f"file://{tmp_path}/t.txt").first()["text"] == "a line long enough"
    assert sorted(tuple(r) for r in sf.through(df.coalesce(1), "c", ["tr", "a-z", "A-Z"]).collect()) == [("rc", "0"), ("stdout", "X"), ("stdout", "Y")]
    assert [tuple(r) for r in sf.through(df.coalesce(1), "c", ["sh", "-c", "echo no >&2; exit 3"]).collect()] == [("stderr", "no"), ("rc", "3")]
    assert [tuple(r) for r in sf.through(df.coalesce(1), "c", ["sleep", "60"], timeout=0.5).collect()] == [("rc", "-9")]
    assert sf.host_metrics(spark).count() == 8


def test_avro_store(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    avro = {"type": "record", "name": "r", "fields": [{"name": "id", "type": ["null", "long"]}, {"name": "name", "type": ["null", "string"]}]}
    s = TypedStore(spark, schema, "people").add({"id": 1, "name": "a"}, {"id": 2, "name": None})
    back = TypedStore(spark, schema, "again").load(s.serialize(avro))
    assert sorted(map(tuple, back.df.collect())) == [(1, "a"), (2, None)] and back.size() == 2
    assert back.some(F.col("id") == 2) and not back.every(F.col("name") == "a") and back.find(F.col("id") == 1)["name"] == "a"


def test_csv_store(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,name\n 1, a \n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    assert [tuple(r) for r in TypedStore(spark, schema, "csv").from_csv(f"file://{tmp_path}/p.csv").df.collect()] == [(1, "a")]


@pytest.mark.parametrize(
    ("there", "back", "value", "options"),
    [
        ("ArrayToISO8385", "ISO8385ToArray", [[2, "41"], [39, "00"]], {}),
        ("JSONToXLSX", "XLSXToJSON", {"w": [[1, "a"], [2, "b"]]}, {}),
        ("JSONToAVRO", "AVROToJSON", {"name": "testname"}, {"schema": {"type": "record", "name": "r", "fields": [{"name": "name", "type": "string"}]}}),
        ("JSONToConfluence", "ConfluenceToJSON", {"schema": 1, "data": {"name": "t"}}, {"schemas": {1: {"type": "record", "name": "r", "fields": [{"name": "name", "type": "string"}]}}}),
        ("JSONTonpy", "npyToJSON", {"dataType": "f8", "shape": [2, 2], "fortran_order": False, "version": 1.0, "dataVector": [1.0, 2.0, 3.0, 4.0]}, {}),
        ("JSONToXML", "XMLToJSON", {"a": {"b": "1"}}, {}),
    ],
)
def test_round_trips(spark, there, back, value, options):
    c = registry.apply(back, registry.apply(there, F.lit(json.dumps(value)), **options), **options)
    got = json.loads(spark.range(1).select(c).first()[0])
    assert got == ([[0, "0200"], *value] if back == "ISO8385ToArray" else value)


def test_registry(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(registry.apply("JSONToCSV", F.lit('[{"b":1,"a":"x"},{"a":"y"}]'))) == "a,b\nx,1\ny,"
    assert one(registry.apply("JSONToCSV", F.lit('[["a",1],[null,"é"]]'))) == '"a",1\nnull,"é"'
    assert one(registry.apply("JSONToCSV", F.lit('[{"a":1},2]'))) == "a\n1\n,2"
    assert one(registry.apply("CSVWithHeaderToArray", F.lit("h\n1\n2"))) == [["1"], ["2"]]
    assert one(registry.apply("CompressedToString", registry.apply("StringToCompressed", F.lit("é")))) == "é"
    assert one(registry.apply("StringToTitle", F.lit("ab cd"))) == "Ab Cd" and len(registry.REGISTRY) > 100
    with pytest.raises(ValueError, match="No transform"):
        registry.apply("aTob", None)


def test_trees(spark):
    tree = [[3, 5], [2, 9], [0, 1]]
    assert learn.minimax(tree) == learn.alphabeta(tree) == 3
    rows = [(0, None, None), (1, 0, None), (2, 0, None), (3, 1, 3.0), (4, 1, 5.0), (5, 2, 2.0), (6, 2, 9.0)]
    assert learn.tree_values(spark.createDataFrame(rows, "id int, parent int, value double"), 2).first()["value"] == 3


def test_entry_without_training_data(tmp_path):
    """Without the llm folders and the pipeline everything else imports."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("__spark_entry__.py", "quern"):
        (shutil.copytree if os.path.isdir(f"{here}/{name}") else shutil.copy)(f"{here}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "quern" / "llm", ignore_errors=True)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert int(done.stdout) > 50
    (tmp_path / "tests").mkdir()
    for name in ("__init__.py", "conftest.py", "test_dialect.py"):
        shutil.copy(f"{here}/tests/{name}", tmp_path / "tests" / name)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-x", "-q"], cwd=tmp_path, capture_output=True, check=True, timeout=600)


def test_shared_path(spark):
    assert shared_path(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_ambiguous_names(spark):
    """A name that several tables have must be told apart."""
    store = RecordStore(spark)
    store.tables |= {"a": spark.createDataFrame([(1, "x")], "id int, name string"), "b": spark.createDataFrame([(1, "y")], "id int, name string")}
    with pytest.raises(SqlError, match="ambiguous"):
        store.sql("SELECT name FROM a JOIN b ON a.id = b.id")
    assert store.sql("SELECT b.name FROM a JOIN b ON a.id = b.id").first()[0] == "y"
