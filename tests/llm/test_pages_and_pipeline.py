import gzip
import hashlib
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontamination, html_text, queries, warc
from quern.llm.common import written

from . import plain

DIR = os.environ.get("QUERN_TEST_DIR", "/root/testdata/sf0.001")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class=sidebar><p>Side</p></div><article class="post"><h1>Head &amp; line</h1><p>One <b>two</b>th<i>ree</i>
four<br>five<p>Next &lt;p&gt; &eacute;<script>if (a<b) {"</p>"}</script></p><div class="ad banner">Buy</div><form><input value="q>r"><label>Name</label></form><!-- <p>no</p> -->
<ul><li>a<li>b</ul><section class="comments"><p>First!</p></section></article><aside>More</aside><footer>&copy; us</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id bigint, url string, html string, text string")


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nOne twothree four five\nNext <p> é\na\nb"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    assert html_text.main_text("plain words") == "plain words"
    assert html_text.main_text('<article><p>a <span class="ad">buy <span>now</span></span>b <a href=u>link</a>.<p>t<div id=comments><p>c</div></article>') == "a b link.\nt"
    assert html_text.main_text("<p>cut <b>off") == "cut off"
    assert html_text.main_text("<article><p>x</p>" + "<p>y z</p>" * 5000).count("\n") == 5000


def test_main_text_keeps_what_names_only_resemble():
    """Words that merely contain a name of furniture, ids of quotations, a form around the whole page, comments as articles."""
    article = "<h1>Head</h1><p>First line of it.</p>{}<p>Last line.</p>"
    for part, text in (
        ('<p class="share-price">Shares rose</p>', "Shares rose"), ('<section id="related-work"><p>Others</p></section>', "Others"), ('<div class="alert-levels">Red</div>', "Red"),
        ('<div class="search-engines"><p>Engines</p></div>', "Engines"), ('<blockquote id="share">Quoted</blockquote>', "Quoted"),
    ):
        want = f"Head\nFirst line of it.\n{text}\nLast line."
        assert html_text.main_text(f"<article>{article.format(part)}</article>") == want
        assert html_text.main_text(f"<body><div>{article.format(part)}</div></body>") == want
    for part in ('<div class="share-buttons">Share</div>', '<article class="c"><p>A reader</p></article>', '<section class="commentList"><p>A reader</p></section>', "<form><label>Mail</label></form>", '<div id="site-footer">us</div>'):
        assert html_text.main_text(f"<body><article>{article.format(part)}</article></body>") == "Head\nFirst line of it.\nLast line."
    assert html_text.main_text(f"<body><form method=post><input name=state><div class=widget>{article.format('')}</div></form></body>") == "Head\nFirst line of it.\nLast line."
    long = "<p>A reader's many words.</p>" * 30
    assert html_text.main_text(f"<body><div><h1>Head</h1><p>Text.</p></div><div class=comments>{long}</div></body>") == "Head\nText."


def expression(pages):
    return html_text.infer([(1, html_text.page_items(html_text.blocks(p))) for p in pages])


def test_wrapper_expression():
    items = expression(f"<body><div class=top>Brand</div><ul>{'<li>e</li>' * (k + 1)}</ul>{'<hr><em>x</em>' if k % 2 else ''}<div class=t><p>text {k}</p></div></body>" for k in range(6))
    by = {key: (digest is not None, n) for key, digest, n, _, _ in items}
    assert by["body>div.top"] == (True, 6) and by["(body>ul>li)+"] == (False, 6) and by["body"] == (True, 3) and by["body>div.t>p"] == (False, 6) and len(items) == 4
    assert html_text.fold(list("abbbcdcd")) == [("a", 0, 1), ("(b)+", 1, 4), ("(c\x1fd)+", 4, 8)]


def test_alignment_against_plain():
    """The expression holds every stream it was inferred from; each page is matched whole; constants are those of all its pages."""
    r = random.Random(1)
    for _ in range(40):
        streams = [[r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(r.randint(1, 6))]
        pages = [[html_text.Block(k, f"{k}{r.randint(0, 1)}", 0, False) for k in s] for s in streams]
        items = html_text.infer([(1, html_text.page_items(p)) for p in pages])
        for p in pages:
            assert plain.accepts([x[0] for x in items], [b.path for b in p]), (streams, items)
        e = html_text.Expression(json.dumps([len(pages), items]))
        for p in pages:
            assert all(item >= 0 for item, _, _ in e.places(tuple(b.path for b in p)))


def test_alignment_decides(spark, monkeypatch):
    """A template's text that stands at other places of the stream on every page is known by aligning them, only."""
    brand = "Read more of our stories in the evening"
    page = "<body>{}<p class=b>" + brand + "</p><div><p>Words of page {}, some of them its own and more than the template has, again {}</p></div></body>"
    rows = [(k, f"http://h.example/{k}", page.format("<h2>Extra</h2>" * (k % 3) + "<h3>More</h3>" * (k % 2), k, k)) for k in range(8)]
    got = [r["text"] for r in html_text.extract(pages(spark, rows)).sort("page_id").collect()]
    assert all(brand not in t and "Words of page" in t for t in got)

    def texts():
        wrapper = html_text.Expression(json.dumps([8, expression(h for _, _, h in rows)]))
        return [html_text.main_text(h, wrapper) for _, _, h in rows]

    assert texts() == got
    monkeypatch.setattr(html_text, "align", lambda a, b, pages: a)
    assert any(brand in t for t in texts())


def test_equal_pages_count_once(spark):
    """However the pages are dealt out: equal ones are one page of the host, and the result is the same."""
    page = "<body><div class=top>Site name</div><div><p>Words that are page {}'s own, longer than its template</p></div></body>"
    rows = [(k, "http://h.example/", page.format(k if k < 5 else 9)) for k in range(12)] + [(k, "http://two.example/", page.format(k % 2)) for k in range(12, 24)]
    got = []
    for n in (1, 8, 61):
        got.append(sorted((r["page_id"], r["text"]) for r in html_text.extract(pages(spark, rows).repartition(n)).collect()))
    assert got[0] == got[1] == got[2] and got[0][7] == (7, "Words that are page 9's own, longer than its template") and got[0][12][1].startswith("Site name")


def test_near_copies_keep_their_text(spark):
    article = "<body><article><h1>Head</h1>" + "".join(f"<p>The same paragraph {k} of all copies.</p>" for k in range(5)) + "<p>Copy {}</p></article></body>"
    got = html_text.extract(pages(spark, [(k, "http://h.example/", article.format(k)) for k in range(9)])).collect()
    assert all(r["text"].count("\n") == 6 for r in got)


def test_extract(spark):
    body = "<html><body><div class=top>Brand of the site</div><div class=body><p>Words of page {} and of no other</p><p>{} more</p></div></body></html>"
    rows = [(i, "http://h.example/" + str(i), body.format(i, "abcdefgh"[i])) for i in range(8)] + [(20, None, None), (21, "http://h.example/x", ""), (22, "http://other.example", PAGE), (22, "http://other.example", PAGE)]
    clash = pages(spark, rows).withColumn("wrapper_host", F.lit(1)).withColumn("Wrapper_Template", F.lit(2)).withColumn("host", F.lit(3))
    out = html_text.extract(clash)
    assert set(clash.columns) == set(out.columns)
    got = sorted((r["page_id"], r["text"]) for r in out.collect())
    assert got[0] == (0, "Words of page 0 and of no other\na more") and got[8:10] == [(20, ""), (21, "")] and got[10] == got[11] and got[10][1].startswith("Head")
    assert html_text.extract(pages(spark, rows).limit(0)).collect() == []
    before = html_text.BROADCAST
    html_text.BROADCAST = -1
    try:
        assert sorted((r["page_id"], r["text"]) for r in html_text.extract(clash).collect()) == got
    finally:
        html_text.BROADCAST = before


WEB = [(1, "http://a", "x" * 200), (2, "http://b\r\nX: y", "x" * 200), (3, None, None), (4, "u", "short"), (5, "u", "short"), (6, "u", "pay\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "z" * 99), (6, "u", "é" * 80), (7, "u", "x" * 200), (9, "u", "é" * 80)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc(spark, tmp_path, compression):
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages(spark, WEB), path, compression=compression, records=4)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(WEB) and all(r["digest_ok"] for r in got)
    by = {(r["record_id"], r["payload_digest"]): r for r in got}
    for i, _, body in WEB:
        data = (body or "").encode()
        r = by[str(i), hashlib.sha256(data).hexdigest()]
        want = {2: ("revisit", "1"), 7: ("revisit", "1"), 9: ("revisit", "6")}.get(i, ("response", None))
        assert (r["record_type"], r["refers"], r["payload_bytes"]) == (*want, len(data))
        assert r["payload"] is None if want[0] == "revisit" else bytes(r["payload"]) == data


def test_chain():
    at, to = np.array([0, 30, 60, 100, 140]), np.array([60, 60, 100, 140, 200])
    assert warc.reachable(at, to).tolist() == [True, False, True, True, True] and warc.reachable(at, to, 30).tolist() == [False, True, True, True, True]
    assert warc.exits(at, to).tolist() == [200] * 5 and warc.exits(at, np.array([30, 61, 100, 150, 200])).tolist() == [61, 61, 150, 150, 200]
    n = 1000
    assert warc.reachable(np.arange(n), np.arange(1, n + 1)).all() and not len(warc.reachable(np.zeros(0, int), np.zeros(0, int)))


def record(block, kind="response", more="", length=None):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{more}Content-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Records without an id or type, magic inside payloads, members a record, damage, and files without records."""
    inner = record(b"inner", more="WARC-Record-ID: <urn:x:in>\r\n")
    good = [record(b"one", "warcinfo"), record(b"HTTP/1.1 200 OK\r\n\r\nbody " + inner + b" rest", more="WARC-Record-ID: <urn:x:2>\r\nContent-Type: application/http\r\n"), record(b"", "metadata"), record(inner * 3, "resource")]
    (tmp_path / "a.warc").write_bytes(b"".join(good))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, good)))
    (tmp_path / "c.warc").write_bytes(good[0] + record(b"longer than said", length=4) + good[2])
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc").write_bytes(b"no archive " + good[0])
    (tmp_path / "f.warc").write_bytes(good[0] + record(b"cut", length=999)[:-4])
    (tmp_path / "g.warc").write_bytes(b"".join(good)[:-4])
    got = {}
    for r in warc.read_warc(spark, f"file://{tmp_path}").collect():
        got.setdefault(r["file"].rpartition("/")[2][0], []).append(r)
    for rows in got.values():
        rows.sort(key=lambda r: r["at"])
    payloads = [b"one", b"body " + inner + b" rest", b"", inner * 3]
    for name in "abg":
        rows = got[name]
        assert [r["payload"] for r in rows] == payloads and [r["status"] for r in rows] == ["ok"] * 4 and rows[1]["record_id"] == "urn:x:2" and rows[0]["record_id"] is None, name
        assert [r["at"] for r in rows] == np.cumsum([0, *map(len, good)])[:4].tolist()
    assert [r["status"] for r in got["c"]] == ["ok", "ok", "broken"] and [r["status"] for r in got["f"]] == ["ok", "broken"] and "d" not in got and "e" not in got


def test_a_file_of_many_tasks(spark, tmp_path):
    """An archive that is no stream is read in ranges; chains go on from range to range, over magic in payloads."""
    r = random.Random(9)
    blocks = [r.randbytes(r.randint(0, 3000)) + r.choice((b"", b"", b"\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\r\n" + b"x" * 40, record(b"y" * 5000))) for _ in range(200)]
    (tmp_path / "long.warc").write_bytes(b"".join(record(b, "resource", f"WARC-Record-ID: <urn:x:{i}>\r\n") for i, b in enumerate(blocks)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)
    try:
        assert warc.fragments(spark, f"file://{tmp_path}").rdd.getNumPartitions() > 5
        got = {int(r["record_id"].removeprefix("urn:x:")): r for r in warc.read_warc(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {i: bytes(r["payload"]) for i, r in got.items()} == dict(enumerate(blocks)) and {r["status"] for r in got.values()} == {"ok"}


def test_warc_without_pages_and_with_long_ones(spark, tmp_path):
    long = "é" * 3_000_000
    warc.write_warc(pages(spark, []), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").collect() == []
    clash = pages(spark, [(1, None, long), (2, None, long), (None, None, None)]).withColumnsRenamed({"text": "digest"}).withColumns({"n": F.lit(1), "first": F.lit(2), "body": F.lit(3), "id": F.lit(4)})
    warc.write_warc(clash, f"file://{tmp_path}/long")
    got = sorted((r["record_id"], r["payload_bytes"], r["record_type"], r["refers"]) for r in warc.read_warc(spark, f"file://{tmp_path}/long", payloads=False).collect())
    assert got == [("", 0, "response", None), ("1", 6_000_000, "response", None), ("2", 6_000_000, "revisit", "1")]


ITEM = "If Alice has 12 apples and gives 5 apples to Bob while 12 birds watch, how many apples are left with her now?"


def test_leaks(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, None), (4, "too short"), (None, ITEM + " x")], "item_id bigint, text string")
    rows = [
        (1, "Intro words here. " + ITEM + " And more."), (2, ITEM.replace("12", "77").replace("Alice", "Carol").replace("5", "9")), (3, "nothing of it"), (4, None), (5, ""), (None, ITEM), (7, ITEM.lower().replace("apples", "pears")), (1, "x"),
        (8, ITEM.replace("12 apples", "3 apples").replace("12 birds", "4 birds").replace("5", "6")), (9, ("filler and words " * 4000) + ITEM),
    ]
    got = {r["doc_id"]: r for r in decontamination.leaks(plain.documents(spark, rows), bench).collect()}
    assert set(got) == {1, 2, 9} and got[1]["item_id"] == 1 and got[1]["n_items"] == 2 and got[2]["consistency"] >= 0.8
    d = plain.documents(spark, rows)
    assert decontamination.leaks(d.limit(0), bench).collect() == [] == decontamination.leaks(d, bench.limit(0)).collect()
    assert decontamination.leaks(d, bench, most=0).count() == 3


NAMED = "On Monday a train leaves Paris and covers 120 km in 2 hours, then Alice boards it with 3 bags, so how far is it from Paris to Lyon?"


def test_leaks_of_other_parameters(spark):
    """Names of several words, other units, a re-numbered copy before the verbatim one; and values that don't agree."""
    bench = spark.createDataFrame([(1, NAMED), (2, ITEM)], "item_id bigint, text string")
    other = NAMED.replace("Alice", "Mary Ann Smith").replace("Paris", "New York").replace("120 km", "75.5 miles").replace("2 hours", "90 minutes")
    rows = [(1, other), (2, "It said: " + other + " " + NAMED), (3, NAMED.replace("from Paris", "from Berlin").replace("120 km", "7 km")), (4, ITEM.replace("12 birds", "13 birds") + " Then: " + ITEM), (5, ITEM.replace("Bob", "Robert James"))]
    got = {(r["doc_id"], r["item_id"]): r["consistency"] for r in decontamination.leaks(plain.documents(spark, rows), bench).collect()}
    assert got.keys() >= {(1, 1), (2, 1), (4, 2), (5, 2)} and got[2, 1] == 1.0 == got[4, 2]


def test_planted_recall(spark):
    """Re-parameterised items in other texts: nine of ten are found at least, and no text without one."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    name, number = (lambda: word().title()), (lambda: str(r.randint(2, 900)))
    items, rows = [], []
    for i in range(60):
        parts = [r.choice(("word", "word", "word", "word", "name", "number")) for _ in range(r.randint(14, 30))]
        literal = [word() for _ in parts]
        fill = lambda: " ".join({"word": w, "name": name(), "number": number()}[p] for p, w in zip(parts, literal))  # noqa: B023, E731
        items.append((i, fill()))
        rows.append((i, " ".join(word() for _ in range(50)) + " " + fill() + " " + " ".join(word() for _ in range(50))))
        rows.append((1000 + i, " ".join(word() for _ in range(150))))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(plain.documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert len({(i, i) for i in range(60)} & got) >= 54 and all(d == i for d, i in got)


def test_hot_windows(spark):
    """A phrase that many items begin with and every document has: documents with no more of an item are none's."""
    opening = "answer the question below with one of the options that follow it"
    items = [(i, f"{opening} {' '.join(f'w{i}x{k}' for k in range(20))}") for i in range(30)]
    rows = [(d, f"text {d} says {' '.join(opening.split()[:9])} other words z{d}") for d in range(200)] + [(900 + i, items[i][1]) for i in range(3)]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(plain.documents(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(900 + i, i) for i in range(3)}


SUMS = "What is the sum of 3 and 4? What is the sum of 5 and 6? Write both results down."
SEVENS = "take a number and double it once more so that we know 7 is what the whole of this gives 7"


def test_leaks_of_every_occurrence(spark):
    """Copies whose windows stand twice, behind another quotation, or belong to an item with other equal slots."""
    bench = spark.createDataFrame([(1, SUMS), (2, ITEM), (3, SEVENS), (4, SEVENS.replace("gives 7", "gives 3"))], "item_id bigint, text string")
    quoted = ITEM[: ITEM.index(" birds")].replace("12 apples", "3 apples").replace("while 12", "while 4") + " birds watch. "
    rows = [(1, SUMS), (2, quoted + ITEM), (3, SEVENS.replace("gives 7", "gives 3")), (4, SEVENS), (5, quoted + quoted), (6, "no item")]
    got = {(r["doc_id"], r["item_id"]): r["consistency"] for r in decontamination.leaks(plain.documents(spark, rows), bench).collect()}
    assert got.keys() == {(1, 1), (2, 2), (3, 3), (4, 3)} and set(got.values()) == {1.0}


def test_leaks_of_short_and_slot_rich_items(spark):
    """Items without a window of five literal tokens are found by their words, and no others are."""
    texts = ["Compute 17 * 23 + 45 * 12 - 88 / 4 + 19", "Add 12 and 7, then 5 and 9, then 4 and 8, then 3 and 2", "東京の首都は何ですか", "Who wrote Faust?", "7 7 7 7 7 7 7 7 7 7", "?!"]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    rows = [(i, f"some words, {t} 問 and more") for i, t in enumerate(texts)] + [(10 + i, t.replace("7", "6").replace("何", "誰").replace("Faust", "Emma")) for i, t in enumerate(texts)]
    rows += [(20, "質問東京の首都は何ですか答え"), (21, "7 7 7 7 7 7 7 7 7, 7 7 7 7 7 7 7 7 x"), (21, "7 7 7 7 7 7 7 7 7"), (22, None)]
    for most in (0, decontamination.BROADCAST):
        got = decontamination.leaks(plain.documents(spark, rows), bench, most=most).select("doc_id", "item_id", "coverage").collect()
        assert sorted(map(tuple, got)) == [*((i, i, 1.0) for i in range(5)), (20, 2, 1.0), (21, 4, 1.0)]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_leaks_plain(spark):
    """Every document that has an item's whole text, and no document that lacks every fourteen-word run of all items."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    items = spark.read.parquet(f"{DIR}/benchmark.parquet").collect()
    runs = {tuple(w[i : i + 14]) for b in items for w in [b["text"].lower().split()] for i in range(len(w) - 13)}
    whole = {d["doc_id"] for d in docs if any(b["text"] in (d["text"] or "") for b in items)}
    some = {d["doc_id"] for d in docs for w in [(d["text"] or "").lower().split()] if any(tuple(w[i : i + 8]) in {r[:8] for r in runs} for i in range(len(w) - 7))}
    got = {r["doc_id"] for r in decontamination.query(spark, DIR).collect()}
    assert whole <= got <= some | whole | got


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, DIR), name)
        assert after.columns == docs.columns and 0 < after.count() <= seen, name
        docs, seen = after, after.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == seen
    whole = corpus_pipeline.run(spark, DIR)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(*cols).collect())) == sorted(map(tuple, packed.select(*cols).collect()))


CLEAN = "The committee will publish its report on the river crossing next month, after a survey of the old bridge has shown how much of its stone can be kept and what the new deck should carry."


def test_pipeline_on_awkward_rows(spark):
    docs = plain.documents(spark, [*plain.awkward(), (None, CLEAN), (3, "a"), (70, CLEAN), (71, CLEAN), (71, CLEAN)], extra=False)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DIR), "stage")
    assert docs.agg(F.max("length")).first()[0] <= 1024 and sorted(r["doc_id"] or 0 for r in docs.select("doc_id").collect()) == [0, 70]


def test_pipeline_on_an_empty_table(spark):
    docs = plain.documents(spark, plain.awkward(), extra=False).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DIR), "stage")
    assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "pipeline"])
def test_queries_answer_every_row(spark, name):
    got = queries.QUERIES[name](spark, DIR)
    if name in ("op1_html_extraction", "op7_warc"):
        assert got.count() == spark.read.parquet(f"{DIR}/pages.parquet").count()
    elif name != "op5_decontamination":
        assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{DIR}/documents.parquet").count()
