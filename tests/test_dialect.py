import pytest

from quern.plans.dialect import SqlError, parse_sql
from quern.sources.records import RecordStore


@pytest.fixture(scope="module")
def store(spark):
    s = RecordStore(spark)
    s.register("users", s.frame([{"id": 1.0, "name": "Alice"}, {"id": 2.0, "name": "Bob"}, {"id": 3.0, "name": "Charlie"}]))
    s.register("orders", s.frame([{"user_id": 1.0, "amount": 100.0}, {"user_id": 1.0, "amount": 200.0}, {"user_id": 2.0, "amount": 150.0}]))
    return s


@pytest.fixture(scope="module")
def people(store):
    rows = [(1.0, "a", 20.0, "eng"), (2.0, "b", 30.0, "hr"), (3.0, "c", 40.0, "eng"), (4.0, "d", 35.0, "hr")]
    return store.spark.createDataFrame(rows, "id double, name string, age double, dept string")


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT id, name FROM ? WHERE age > 30", [(3.0, "c"), (4.0, "d")]),
        ("SELECT age FROM ? ORDER BY age DESC LIMIT 2", [(40.0,), (35.0,)]),
        ("SELECT dept, COUNT(*) AS cnt FROM ? GROUP BY dept ORDER BY dept", [("eng", 2), ("hr", 2)]),
        ("SELECT AVG(age), MAX(age), MIN(age) FROM ?", [(31.25, 40.0, 20.0)]),
        ("SELECT name FROM ? WHERE dept = 'ENG' AND name != 'C' ORDER BY name", [("a",), ("c",)]),
        ("SELECT name FROM ? WHERE age = '20'", [("a",)]),
        ("SELECT name FROM ? WHERE age BETWEEN 25 AND 35 AND NOT dept LIKE 'E%' ORDER BY name", [("b",), ("d",)]),
        ("SELECT name FROM ? WHERE age > -1 AND (name IN ('A', 'b') OR age >= 40) ORDER BY name", [("a",), ("b",), ("c",)]),
        ("SELECT \"a1\" AS test, name FROM ? WHERE name = 'a'", [("a1", "a")]),
        ("SELECT dept, COUNT(DISTINCT name) AS n FROM ? GROUP BY dept HAVING n > 1 ORDER BY dept", [("eng", 2), ("hr", 2)]),
    ],
)
def test_select(store, people, sql, want):
    assert rows(store.sql(sql, people)) == want


@pytest.mark.parametrize(("how", "n"), [("INNER", 3), ("LEFT", 4), ("RIGHT", 3), ("FULL OUTER", 4)])
def test_joins(store, how, n):
    got = store.sql(f"SELECT u.name, o.amount FROM users u {how} JOIN orders o ON u.id = o.user_id")
    assert got.columns == ["u.name", "o.amount"] and got.count() == n


def test_parameters(store, people):
    p = {"msg": {"payload": {"minAge": 30}}, "global": {"dept": "eng"}}
    assert rows(store.sql("SELECT :msg.payload.minAge AS t, name FROM ? WHERE age >= :msg.payload.minAge AND dept = :global.dept", people, params=p)) == [(30, "c")]
    assert rows(store.sql("SELECT name FROM ? WHERE name = :msg.n", people, params={"msg": {"n": "Bob' OR 1=1 --"}})) == []
    with pytest.raises(SqlError, match="Parameter ':msg.x' not provided"):
        store.sql("SELECT name FROM ? WHERE age > :msg.x", people)


@pytest.mark.parametrize("bad", ["SELECT", "SELECT a FROM ? WHERE a", "SELECT a FROM ? WHERE a ~ 1", "SELECT a FROM ? LIMIT x", "SELECT a FROM ? extra words here"])
def test_bad_sql(bad):
    with pytest.raises(SqlError):
        parse_sql(bad)


def test_unknown_names(store, people):
    with pytest.raises(SqlError, match="not found"):
        store.sql("SELECT name FROM nowhere")
    with pytest.raises(SqlError, match="not found"):
        store.sql("SELECT nothing FROM ?", people)


def test_write_append_read(store, tmp_path):
    path = f"file://{tmp_path}/people"
    assert store.append([{"id": 5.0, "name": "Eve"}], path)["appended"] is False
    got = store.append([{"id": 6.0, "name": "Fay", "age": 1.0}], path)
    assert (got["recordsWritten"], got["totalRecords"], got["appended"]) == (1, 2, True)
    assert {f["name"] for f in store.schema(path)} == {"id", "name", "age"}
    assert store.metadata(path)["numRows"] == 2
    assert rows(store.sql("SELECT COUNT(*) AS n FROM ?", path)) == [(2,)]
