"""Training-data queries that SQL can express, held against it as the driver does."""

import os

import duckdb
import pytest

from quern.llm import licences
from quern.llm.queries import ORACLE, QUERIES

DIR = os.environ.get("QUERN_TEST_DIR", "/root/testdata/sf0.001")
AWKWARD = (None, "", " ", "İ K k CC BY cc by", "5 km/h and 5 kmx, in Berlin, 1.5% of Ärzte x", "é" * 60, "GNU General Public License version 2" * 3)


def held(spark, folder, name):
    df = QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}'")
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    rows = lambda got: sorted(repr([r[c] for c in sorted(cols)]) for r in got)
    got = rows(df.collect())
    assert got == rows(dict(zip(cols, r)) for r in cur.fetchall())
    return got


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_tables(spark, name):
    assert held(spark, DIR, name)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_awkward(spark, tmp_path, name):
    passage = "On Monday the train from Paris covers 120 km in 2 hours and stops 3 times before Lyon, so how many miles is it in all"
    texts = [*AWKWARD, *(sentence for _, sentence, _ in licences.TEMPLATES), ". ".join(sentence.upper() for _, sentence, _ in licences.TEMPLATES), passage, passage.replace("Paris", "Rome").replace("120", "95.5"), "x " + passage, passage]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    short = ["Who wrote Faust?", "7 7 7 7 7 7 7 7 7 7", "東京の首都は何ですか", "?!", "Compute 17 * 23 + 45 * 12 - 88 / 4 + 19", "12% of 40 € and 5 % more"]
    texts += [passage.replace("Paris", "Mary Ann").replace("2 hours", "30 min"), "say 3 times: " + passage.replace("from Paris", "from Bonn") + ". " + passage, *(f"so, {x} and" for x in short), "質問東京の首都は何ですか答え", "7 7 7 7 7 7 7 7 7"]
    items = [(1, passage), (2, passage.replace("Paris", "Nice")), (3, None), (None, passage), (4, passage.replace("3 times", "2 times")), *((10 + i, x) for i, x in enumerate(short))]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://a/{i}", t) for i, t in enumerate(texts)], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert held(spark, str(tmp_path), name)


def test_shuffled_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quern.llm.decontamination.ID_BYTES", -1)
    test_awkward(spark, tmp_path, "op5_decontamination")
