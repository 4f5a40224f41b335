"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, the units behind them and names (runs of capitalised words inside a sentence) become typed placeholders,
everything else is lower-cased. Windows of canonical tokens are hash-joined between documents and benchmark items. Where a
document matches an item, the values in the slots must agree: equal values of the item stand for equal values of the
document, as in a re-parameterised question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table, written

#: Tokens in a window, and how many of them must be no placeholders.
WINDOW, LITERAL = 8, 5
#: A document leaks an item if so many of its windows match, or this share of them; and if slots agree to this share.
RUN, COVERAGE, CONSISTENT = 6, 0.5, 0.8
#: Benchmarks of up to this many windows are broadcast (16 bytes a window); larger ones are shuffled.
BROADCAST = 200_000
#: The ids of documents whose slots are compared are broadcast up to this many bytes, else their texts are shuffled.
ID_BYTES = 16 << 20
#: Private-use characters: a placeholder's type before it, and the end of a name.
_NAME, _NUMBER, _UNIT, _END = "\ue001", "\ue002", "\ue003", "\ue004"
_SIGNS = ("%", "€", "\\$")
UNITS = ("km/h", "mph", "km", "cm", "mm", "m", "kg", "mg", "g", "lb", "oz", "ml", "l", "s", "ms", "min", "h", "hz", "w", "kw", "v", "k", "c", "f", "usd", "eur", "dollars", "euros", "percent", "miles", "metres", "meters", "hours", "minutes", "seconds", "days", "years")
_CAPITALS = "\\p{Lu}[\\p{L}\\p{M}]*(?: \\p{Lu}[\\p{L}\\p{M}]*)*"
_DIGITS = f"{_NUMBER}\\p{{N}}+(?:[.,:]\\p{{N}}+)*"
_TOKEN = f"{_NAME}[^{_END}]*{_END}|{_DIGITS}|{_UNIT}(?:{'|'.join((*_SIGNS, *UNITS))})(?![\\p{{L}}\\p{{N}}])|{_UNIT}(?:{'|'.join(_SIGNS)})|[\\p{{L}}\\p{{M}}\\p{{N}}]+"

_UNSPACED = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}\\u30fc"
_WORD = f"[{_UNSPACED}]|\\p{{N}}+(?:[.,:]\\p{{N}}+)*|[\\p{{L}}\\p{{M}}\\p{{N}}&&[^{_UNSPACED}]]+"


def tokens(text: Column) -> Column:
    """Lower-case tokens; those of a slot begin with its type's mark. A name is a run of capitalised words that a small
    letter, comma or semicolon and a space stand before."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), _NAME + _NUMBER + _UNIT + _END, "")
    t = F.regexp_replace(t, f"(?<=[\\p{{Ll}},;] )({_CAPITALS})", f"{_NAME}$1{_END}")
    t = F.lower(F.regexp_replace(t, "(?<![\\p{L}\\p{N}])(?=\\p{N})", _NUMBER))
    t = F.regexp_replace(t, f"({_DIGITS}[ \\t-\\r]?)({'|'.join(_SIGNS)}|(?:{'|'.join(UNITS)})(?![\\p{{L}}\\p{{N}}]))", f"$1{_UNIT}$2")
    return F.regexp_extract_all(t, F.lit(_TOKEN), F.lit(0))


def canonical(words: Column) -> Column:
    """Tokens with placeholders: a slot's type, which is its first character."""
    return F.transform(words, lambda w: F.when(_slot(w), F.substring(w, 1, 1)).otherwise(w))


def _slot(w: Column) -> Column:
    return w.startswith(_NAME) | w.startswith(_NUMBER) | w.startswith(_UNIT)


def words(text: Column) -> Column:
    """Lower-case words and numbers as they stand; scripts without spaces by letter."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_WORD), F.lit(0))


def windows(canon: Column, size: int = WINDOW) -> Column:
    """Hashes of all windows of size tokens, by position."""
    n = F.size(canon)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(canon, i, size)))).otherwise(F.array().cast("array<bigint>"))


def _literals(window: Column) -> Column:
    return F.size(F.filter(window, lambda w: ~w.isin(_NAME, _NUMBER, _UNIT)))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, literal: int = LITERAL, run: int = RUN, coverage: float = COVERAGE, consistent: float = CONSISTENT, most: int = BROADCAST) -> DataFrame:
    """Pairs (id_col, item_id) of documents that contain an item's passage, with what was matched.

    Items with equal canonical tokens are one; the smallest id stands for them (n_items of them). An occurrence is all
    matched windows of an item at one offset in a document; it counts if its slots agree: the share of the item's slot
    values that stand for one value each there (1 without slots), for one of the items that are one, is consistent or
    more. n_matched counts the item's windows in all occurrences that count, coverage is their share, consistency the
    greatest of them. Items without a window of enough literal tokens (short ones, lists of numbers or names) match where
    all their words stand in a row; equal words are one item then, and coverage and consistency are 1.

    Texts without words and null ids match nothing. Whole texts are searched. Rows that repeat an id are one document, of
    which the row that matches best counts. Empty tables give an empty result. Other columns aren't read.
    """
    with scratch() as keep:
        items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), tokens(F.col(item_text)).alias("raw"))
        items = items.withColumn("canon", canonical(F.col("raw"))).where(F.size("canon") >= size)
        # a slot pattern has for every slot the place of its value's first one, and 0 for other tokens
        items = items.withColumn("pattern", F.transform("raw", lambda w: F.when(_slot(w), F.array_position("raw", w)).otherwise(F.lit(0)).cast("int")))
        items = items.groupBy("canon").agg(F.min("item").alias("item"), F.collect_set("pattern").alias("patterns"), F.countDistinct("item").alias("n_items"))
        placed = items.select("item", "n_items", "patterns", "canon", F.posexplode(windows(F.col("canon"), size)).alias("at", "h"))
        said = F.transform("patterns", lambda p: F.slice(p, F.col("at") + 1, size))
        placed = placed.where(_literals(F.slice("canon", F.col("at") + 1, size)) >= literal).select("item", "n_items", "at", "h", said.alias("said"))
        placed = written(placed, "item-windows")
        whole = placed.groupBy("item").agg(F.count("*").alias("n_windows"), F.first("n_items").alias("n_items"))
        whole = written(whole.withColumn("need", F.least(F.lit(run), F.greatest(F.lit(1), F.ceil(F.col("n_windows") * coverage).cast("int")))), "items")
        hashes = placed.join(whole, "item").groupBy("h").agg(F.min("need").alias("need"))
        if placed.count() <= most:
            hashes = F.broadcast(hashes)

        named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("t"))
        # canon has a projection of its own: windows() refers to it more than once, so Catalyst keeps it evaluated once a row
        hits = named.select("doc", "row", canonical(tokens(F.col("t"))).alias("canon")).select("doc", "row", F.posexplode(windows(F.col("canon"), size)).alias("pos", "h")).join(hashes, "h")
        hits = written(hits.select("doc", "row", "h", "pos", "need").distinct(), "hits")
        # windows meet items only in documents that have as many of them as the least of these items needs
        able = hits.groupBy("doc", "row").agg(F.countDistinct("h").alias("n"), F.min("need").alias("need")).where("n >= need").select("doc", "row")
        pairs = hits.join(written(able, "able"), ["doc", "row"]).join(placed.select("h", "item", "at"), "h").select("doc", "row", "item", "at", "pos", (F.col("pos") - F.col("at")).alias("offset"))
        enough = whole.select("item", "n_windows", "n_items", "need")
        reach = pairs.groupBy("doc", "row", "item").agg(F.countDistinct("at").alias("n")).join(enough, "item").where("n >= need").select("doc", "row", "item")
        pairs = written(pairs.join(written(reach, "reach"), ["doc", "row", "item"]).distinct(), "pairs")

        # slot values on both sides of the matched windows, occurrence by occurrence
        ids = pairs.select("doc").distinct()
        found = _again(named, ids).select("doc", "row", tokens(F.col("t")).alias("raw"))
        spoken = found.join(pairs.select("doc", "row", "pos").distinct(), ["doc", "row"]).select("doc", "row", "pos", F.slice("raw", F.col("pos") + 1, size).alias("here")).distinct()
        slotted = placed.where(F.exists("said", lambda p: F.exists(p, lambda v: v > 0))).select("item", "at", F.posexplode("said").alias("pattern", "said"))
        both = pairs.join(spoken, ["doc", "row", "pos"]).join(slotted, ["item", "at"])
        both = both.select("doc", "row", "item", "offset", "pattern", F.explode(F.arrays_zip("said", "here")).alias("z")).where("z.said > 0")
        both = both.groupBy("doc", "row", "item", "offset", "pattern", F.col("z.said").alias("said")).agg((F.min("z.here") == F.max("z.here")).cast("int").alias("one"))
        agree = both.groupBy("doc", "row", "item", "offset", "pattern").agg(F.avg("one").alias("consistency")).groupBy("doc", "row", "item", "offset").agg(F.max("consistency").alias("consistency"))
        counted = pairs.join(agree, ["doc", "row", "item", "offset"], "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).where(F.col("consistency") >= consistent)
        out = counted.groupBy("doc", "row", "item").agg(F.countDistinct("at").alias("n_matched"), F.max("consistency").alias("consistency"))
        out = out.groupBy("doc", "item").agg(F.max(F.struct("n_matched", "consistency")).alias("best")).join(enough, "item")
        out = out.select("doc", "item", "n_items", F.col("best.n_matched").alias("n_matched"), "n_windows", (F.col("best.n_matched") / F.col("n_windows")).alias("coverage"), F.col("best.consistency").alias("consistency"), "need")
        out = out.where("n_matched >= need").drop("need")

        # items without a window of enough literal tokens, by all their words
        rest = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), tokens(F.col(item_text)).alias("raw"), words(F.col(item_text)).alias("words"))
        rest = rest.select("item", "words", canonical(F.col("raw")).alias("canon")).where(F.size("words") > 0)
        literals = F.exists(F.sequence(F.lit(1), F.size("canon") - (size - 1)), lambda i: _literals(F.slice("canon", i, size)) >= literal)
        rest = rest.where(~F.when(F.size("canon") >= size, literals).otherwise(False))
        rest = rest.groupBy("words").agg(F.min("item").alias("item"), F.countDistinct("item").alias("n_items")).withColumn("size", F.least(F.size("words"), F.lit(size)))
        rest = written(rest.withColumn("h", F.xxhash64(F.slice("words", 1, F.col("size")))), "slot-rich-items")
        sizes = sorted(r["size"] for r in rest.select("size").distinct().collect())  # 1 to size
        if sizes:
            out = out.unionAll(_whole(named, rest, sizes, most))
        out = out.select(F.col("doc").alias(id_col), F.col("item").alias(item_id), "n_items", "n_matched", "n_windows", "coverage", "consistency")
        found = keep(written(out, "leaks"))
    return found


def _again(named: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of some documents, read again; their ids are broadcast while they are few."""
    few = (ids.agg(F.sum(F.octet_length(F.col("doc").cast("string")) + 16).alias("n")).first()["n"] or 0) <= ID_BYTES
    return named.join(F.broadcast(ids) if few else ids, "doc")


def _whole(named: DataFrame, items: DataFrame, sizes: list[int], most: int) -> DataFrame:
    """Documents and items whose words stand whole and in a row in them: their first words are looked up, then all compared."""
    firsts = items.select("size", "h").distinct()
    if items.count() <= most:
        firsts = F.broadcast(firsts)
    said = named.select("doc", "row", words(F.col("t")).alias("words"))

    def placed(n: int) -> Column:
        return F.transform(windows(F.col("words"), n), lambda h, i: F.struct(F.lit(n).alias("size"), h.alias("h"), i.alias("pos")))

    starts = F.concat(*map(placed, sizes))
    hits = written(said.select("doc", "row", F.explode(starts).alias("s")).select("doc", "row", "s.*").join(firsts, ["size", "h"]), "starts")
    found = _again(named, hits.select("doc").distinct()).select("doc", "row", words(F.col("t")).alias("said")).join(hits, ["doc", "row"]).join(items, ["size", "h"])
    found = found.where(F.slice("said", F.col("pos") + 1, F.size("words")) == F.col("words")).select("doc", "item", "n_items", (F.size("words") - F.col("size") + 1).cast("bigint").alias("n_matched")).distinct()
    return found.select("doc", "item", "n_items", "n_matched", F.col("n_matched").alias("n_windows"), F.lit(1.0).alias("coverage"), F.lit(1.0).alias("consistency"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak an item go, with all rows that repeat their id; rows without an id stay. Null and
    empty texts and empty tables leave nothing to remove."""
    gone = leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def _oracle_tokens(text: str) -> str:
    """tokens() without look-around, which RE2 lacks: what must stand before or after is taken along and put back."""
    marked = f"translate(coalesce({text}, ''), '{_NAME}{_NUMBER}{_UNIT}{_END}', '')"
    marked = f"regexp_replace({marked}, '([\\p{{Ll}},;] )({_CAPITALS})', '\\1{_NAME}\\2{_END}', 'g')"
    marked = f"lower(regexp_replace({marked}, '(^|[^\\p{{L}}\\p{{N}}])(\\p{{N}})', '\\1{_NUMBER}\\2', 'g'))"
    marked = f"regexp_replace({marked}, '({_DIGITS}[ \\t-\\r]?)({'|'.join(_SIGNS)})', '\\1{_UNIT}\\2', 'g')"
    marked = f"regexp_replace({marked}, '({_DIGITS}[ \\t-\\r]?)({'|'.join(UNITS)})([^\\p{{L}}\\p{{N}}]|$)', '\\1{_UNIT}\\2\\3', 'g')"
    return f"regexp_extract_all({marked}, '{_NAME}[^{_END}]*{_END}|{_DIGITS}|{_UNIT}(?:{'|'.join((*_SIGNS, *sorted(UNITS, key=len, reverse=True)))})|[\\p{{L}}\\p{{M}}\\p{{N}}]+')"


def _oracle_words(text: str) -> str:
    """words(), with unspaced letters set apart first, as RE2 has no intersections of classes."""
    unspaced = "[\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Thai}\\p{Lao}\\p{Khmer}\\p{Myanmar}\u30fc]"
    apart = f"regexp_replace(lower(coalesce({text}, '')), '({unspaced})', ' \\1 ', 'g')"
    return f"regexp_extract_all({apart}, '{unspaced}|\\p{{N}}+(?:[.,:]\\p{{N}}+)*|[\\p{{L}}\\p{{M}}\\p{{N}}]+')"


_SLOT = f"(left(w, 1) IN ('{_NAME}', '{_NUMBER}', '{_UNIT}'))"
_CANON = f"list_transform(raw, lambda w: CASE WHEN {_SLOT} THEN left(w, 1) ELSE w END)"
ORACLE = f"""
WITH i0 AS (SELECT item_id, {_oracle_tokens("text")} AS raw, {_oracle_words("text")} AS words FROM benchmark WHERE item_id IS NOT NULL),
i1 AS (SELECT item_id, raw, words, {_CANON} AS canon, list_transform(raw, lambda w: CASE WHEN {_SLOT} THEN list_position(raw, w) ELSE 0 END) AS pattern FROM i0),
i2 AS (SELECT *, list_transform(range(greatest(len(canon) - {WINDOW - 1}, 0)), lambda i: len(list_filter(canon[i + 1 : i + {WINDOW}], lambda w: NOT {_SLOT})) >= {LITERAL}) AS plain FROM i1),
items AS (SELECT min(item_id) AS item_id, canon, any_value(plain) AS plain, count(DISTINCT item_id) AS n_items, list(DISTINCT pattern) AS patterns FROM i2 WHERE list_contains(plain, true) GROUP BY canon),
placed AS (SELECT item_id, place, canon[place + 1 : place + {WINDOW}] AS h FROM (SELECT item_id, canon, plain, unnest(range(len(plain))) AS place FROM items) WHERE plain[place + 1]),
whole AS (SELECT item_id, count(*) AS n_windows FROM placed GROUP BY item_id),
d0 AS (SELECT row_number() OVER () AS r, doc_id, {_oracle_tokens("text")} AS raw, {_oracle_words("text")} AS words FROM documents WHERE doc_id IS NOT NULL),
d1 AS (SELECT r, raw, {_CANON} AS canon FROM d0 WHERE len(raw) >= {WINDOW}),
d2 AS (SELECT r, canon, unnest(range(len(canon) - {WINDOW - 1})) AS pos FROM d1),
pairs AS (SELECT DISTINCT r, item_id, place, pos - place AS off FROM d2 JOIN placed ON canon[pos + 1 : pos + {WINDOW}] = h),
covered AS (SELECT DISTINCT r, item_id, off, place + unnest(range({WINDOW})) AS tp FROM pairs),
patterns AS (SELECT item_id, unnest(patterns) AS pattern FROM items),
slots AS (SELECT c.r, item_id, off, pattern, pattern[tp + 1] AS said, raw[off + tp + 1] AS here FROM covered c JOIN patterns USING (item_id) JOIN d1 USING (r) WHERE pattern[tp + 1] > 0),
one AS (SELECT r, item_id, off, pattern, said, CAST(count(DISTINCT here) = 1 AS INT) AS one FROM slots GROUP BY ALL),
agree AS (SELECT r, item_id, off, max(consistency) AS consistency FROM (SELECT r, item_id, off, pattern, avg(one) AS consistency FROM one GROUP BY ALL) GROUP BY ALL),
counted AS (SELECT r, item_id, count(DISTINCT place) AS n_matched, max(coalesce(consistency, 1.0)) AS consistency FROM pairs LEFT JOIN agree USING (r, item_id, off) WHERE coalesce(consistency, 1.0) >= {CONSISTENT} GROUP BY ALL),
best AS (SELECT doc_id, item_id, max(struct_pack(n_matched, consistency)) AS b FROM counted JOIN d0 USING (r) GROUP BY ALL),
rest AS (SELECT min(item_id) AS item_id, words, count(DISTINCT item_id) AS n_items FROM i2 WHERE len(words) > 0 AND NOT list_contains(plain, true) GROUP BY words)
SELECT doc_id, item_id, n_items, b.n_matched AS n_matched, n_windows, b.n_matched / n_windows AS coverage, b.consistency AS consistency
FROM best JOIN whole USING (item_id) JOIN (SELECT item_id, n_items FROM items) USING (item_id) WHERE b.n_matched >= {RUN} OR b.n_matched / n_windows >= {COVERAGE}
UNION ALL SELECT DISTINCT doc_id, item_id, n_items, n_windows, n_windows, 1.0, 1.0 FROM d0 JOIN (SELECT *, CAST(greatest(len(words) - {WINDOW} + 1, 1) AS BIGINT) AS n_windows FROM rest) i
ON contains(' ' || array_to_string(d0.words, ' ') || ' ', ' ' || array_to_string(i.words, ' ') || ' ')
"""
