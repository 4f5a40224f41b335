"""Licence scans by a positional rare-token index, in DataFrame functions only.

The templates' words are the index: word to (template, position). Document frequencies over the whole corpus weigh them.
A template is a candidate where a file has one of its rarest words, of which there are so many that a file without any
can't reach the share, and its mandatory key phrase; all the file's postings of a candidate then vote for it at a relative
position, and the key phrase must stand at its place there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The share of a template's weight that must agree on a position.
SHARE = 0.5
# The phrases of the result's contract.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
# Well-known sentences of public licences (label, sentence, mandatory key phrase).
TEMPLATES = (
    ("agpl", "gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license", "attribution sharealike"),
    ("cc0", "cc0 1 0 universal public domain dedication no copyright", "public domain dedication"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies"),
    ("mit-named", "this project is licensed under the mit license", "mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("proprietary", "copyright all rights reserved unauthorized copying of this file is strictly prohibited proprietary and confidential", "proprietary and confidential"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
)
#: Lower-cases to k; another letter in its place keeps words of A-Z exact.
_KELVIN, _OTHER = "\u212a", "\ue000"


def postings() -> dict[str, list[tuple[int, int, bool]]]:
    """word: (template, position, whether it is of the key phrase there)."""
    out: dict[str, list[tuple[int, int, bool]]] = {}
    for t, (_, sentence, key) in enumerate(TEMPLATES):
        words, k = sentence.split(), key.split()
        first = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        for i, w in enumerate(words):
            out.setdefault(w, []).append((t, i, first <= i < first + len(k)))
    return out


def rarest(sentence: str, idf: dict[str, float], unseen: float) -> list[str]:
    """A template's rarest words, so many that a file with none of them can't reach SHARE of its weight."""
    words = sentence.split()
    total = sum(idf.get(w, unseen) for w in words)
    out: list[str] = []
    weight = 0.0
    for w in sorted(set(words), key=lambda w: (-idf.get(w, unseen), w)):
        if weight > (1 - SHARE + 1e-5) * total:
            break
        out.append(w)
        weight += words.count(w) * idf.get(w, unseen)
    return out


def words_of(text: Column) -> Column:
    """All words of a whole text. lower() also changes letters beyond ASCII, but neither where words end nor which words
    are those of the index or of BASE, once the one letter that becomes ASCII is out of the way."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(_KELVIN), F.lit(_OTHER))), F.lit(WORD), F.lit(0))


def _places(words: Column, phrase: str) -> Column:
    """Starts of phrase among words."""
    p = phrase.split()

    def here(i: Column) -> Column:
        out = F.get(words, i) == p[0]
        for k, w in enumerate(p[1:], 1):
            out = out & (F.coalesce(F.get(words, i + k), F.lit("")) == w)
        return out

    return F.when(F.array_contains(words, p[-1]), F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id_col, n_words, base places and labels, all labels, score.

    A null or empty text has no words, no labels and score 0. Long texts are read whole. Repeated rows are answered
    each. An empty table gives an empty result. Only id_col and text are read, so other columns can't clash. The score
    is 1 with a base place, else the largest share of a verified template's weight that agrees on a position; shares
    have six places, as the last digits of a sum depend on its order.
    """
    spark, index = docs.sparkSession, postings()
    phrases = [key.split() for _, _, key in TEMPLATES] + [p.split() for _, p in BASE]
    vocabulary = sorted(set(index) | {w for p in phrases for w in p})
    some = lambda words: F.array(*map(F.lit, words))
    w = docs.select(F.col(id_col).alias("id"), words_of(F.col(text)).alias("words"))
    w = w.select("id", F.size("words").cast("bigint").alias("n_words"), F.array_intersect("words", some(vocabulary)).alias("present"), "words")
    # without all words of a key phrase or of a base phrase a file has no label: only the others' words are kept
    hope = F.lit(False)
    for p in sorted({tuple(sorted(set(p))) for p in phrases}):
        hope = hope | (F.size(F.array_except(some(p), F.col("present"))) == 0)
    w = w.withColumn("words", F.when(hope, F.col("words")))
    s = written(w.select(F.monotonically_increasing_id().alias("row"), "*"), "licence-words")

    n = s.count()
    df = {r["w"]: r["n"] for r in s.select(F.explode("present").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    idf = {k: math.log(1 + n / df[k]) for k in index if k in df}
    base = {label: _places(F.col("words"), phrase) for label, phrase in BASE}
    based = s.select(
        "row", "id", "n_words", "words", *(F.coalesce(base[label], F.array().cast("array<int>")).alias(label) for label, _ in BASE),
    )
    starts = F.concat(*(F.col(f"`{label}`") for label, _ in BASE))
    based = based.select("row", "id", "n_words", F.size(starts).cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"), F.array_compact(F.array(*(F.when(F.size(F.col(f"`{label}`")) > 0, label) for label, _ in sorted(BASE)))).alias("base"))
    if not idf:
        found = based.withColumns({"labels": F.col("base"), "share": F.lit(0.0)})
    else:
        unseen = math.log(1 + n)
        line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
        lined = s.where(F.col("words").isNotNull()).select("row", "words", "present", line.alias("line"))
        candidate = [F.when(F.arrays_overlap("present", some(rarest(sentence, idf, unseen))) & F.contains("line", F.lit(f" {key} ")), t) for t, (_, sentence, key) in enumerate(TEMPLATES)]
        files = lined.select("row", "words", F.array_compact(F.array(*candidate)).alias("candidates")).where(F.size("candidates") > 0)
        at = files.select("row", "candidates", F.posexplode("words").alias("pos", "w")).where(F.col("w").isin(*idf))
        terms = spark.createDataFrame([(k, t, i, int(in_key), idf[k]) for k in idf for t, i, in_key in index[k]], "w string, t int, tpos int, in_key int, idf double")
        votes = at.join(F.broadcast(terms), "w").where(F.array_contains("candidates", F.col("t"))).groupBy("row", "t", (F.col("pos") - F.col("tpos")).alias("shift")).agg(F.sum("idf").alias("got"), F.sum("in_key").alias("keyed"))
        rules = [(t, label, len(key.split()), sum(idf.get(x, unseen) for x in sentence.split())) for t, (label, sentence, key) in enumerate(TEMPLATES)]
        known = spark.createDataFrame(rules, "t int, label string, key_size int, total double")
        sure = votes.join(F.broadcast(known), "t").where("keyed = key_size").withColumn("share", F.round(F.least(F.lit(1.0), F.col("got") / F.col("total")), 6)).where(F.col("share") >= SHARE)
        sure = sure.groupBy("row").agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
        found = based.join(sure, "row", "left").withColumn("labels", F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return found.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
t AS (SELECT r, w, pos, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2
      FROM (SELECT r, unnest(words) AS w, CAST(unnest(range(len(words))) AS BIGINT) AS pos FROM d) WINDOW o AS (PARTITION BY r ORDER BY pos)),
places AS (SELECT r, pos, b.label FROM t JOIN (VALUES {_values((label, *p.split(), *[""] * (3 - len(p.split()))) for label, p in BASE)}) AS b(label, a0, a1, a2)
           ON w = a0 AND w1 = a1 AND (a2 = '' OR w2 = a2)),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY r),
postings(w, template, tpos, in_key) AS (VALUES {_values((w, t, i, int(in_key)) for w, at in postings().items() for t, i, in_key in at)}),
templates(template, label, key_size) AS (VALUES {_values((t, label, len(key.split())) for t, (label, _, key) in enumerate(TEMPLATES))}),
counts AS (SELECT w, count(DISTINCT r) AS df FROM t SEMI JOIN postings USING (w) GROUP BY w),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT w, ln(1 + n / df) AS idf FROM counts, n),
votes AS (SELECT r, template, sum(idf) AS got, sum(in_key) AS keyed FROM t JOIN idf USING (w) JOIN postings USING (w) GROUP BY r, template, pos - tpos),
total AS (SELECT template, sum(coalesce(idf, ln(1 + n))) AS total FROM n, postings LEFT JOIN idf USING (w) GROUP BY template),
shares AS (SELECT r, label, round(least(1.0, got / total), 6) AS share FROM votes JOIN total USING (template) JOIN templates USING (template) WHERE keyed = key_size),
own AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS share FROM shares WHERE share >= {SHARE} GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN own USING (r)
"""
