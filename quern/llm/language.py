"""Language identification by compression: the language whose raw-content dictionary shrinks a text most wins."""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import table
from .quality import SLICE, string_slices

#: Bound on the sample that a dictionary is made of: documents a language, and characters of each one, from a place
#: anywhere in its whole text. Bytes of a dictionary, to which every sampled document gives an equal share.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 400, 256, 64 << 10
LEVEL = 6
#: A text is compressed in blocks of this many bytes, so that a dictionary's help doesn't fade in long texts.
BLOCK = 4096
#: A prediction is rejected if the runner-up needs less than this share more bytes than the winner.
MARGIN = 0.01
#: Anything but letters and marks: \\W and digits, and numbers that \\w takes for letters (superscripts, fractions, Roman
#: ones). These have classes of their own, as a class of characters of the first plane only is looked up at once.
_OTHER = re.compile(r"[\W\d_]+")
_FAR = re.compile("[\U00010000-\U0010ffff]")


def _numbers(first: int, last: int) -> re.Pattern:
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(first, last)) if unicodedata.category(c)[0] == "N" and not c.isalpha() and re.match(r"[^\W\d_]", c)) + "]")


_NUMBERS, _FAR_NUMBERS = _numbers(0x80, 0x10000), _numbers(0x10000, 0x20000)


def letters(text: str) -> bytes:
    """The whole text in lower case, with each run of anything but letters as one space."""
    text = text.lower()
    if not text.isascii():
        text = _NUMBERS.sub(" ", text)
        if _FAR.search(text):
            text = _FAR_NUMBERS.sub(" ", text)
    return _OTHER.sub(" ", text).encode("utf-8", "replace")


def dictionaries(train: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, size: int = DICT_BYTES) -> dict[str, bytes]:
    """Per language, raw dictionary content from a bounded sample: chars characters each of the docs rows with the least
    hashes of (id, lang), from places that the hashes choose.

    Rows with a null or blank text or a null language aren't taken; rows that repeat an id and language come in together.
    The rows that could be in the sample are found by a threshold on the hash, so that no language is sorted, and about
    three times the sample reaches the driver, in one job.
    """
    h = F.xxhash64(id_col, lang)
    start = F.pmod(F.xxhash64(h), F.greatest(F.lit(1), F.length(text) - chars + 1)).cast("int") + 1
    rows = train.where(F.col(lang).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(lang).alias("lang"), h.alias("h"), F.substring(text, start, F.lit(chars)).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    least = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(2**63 - 1, -(2**63) + 3 * docs * 2**63 // n))))
    got: dict[str, list] = {}
    for r in rows.where(F.col("h") <= least[F.col("lang")]).collect():
        got.setdefault(r["lang"], []).append((r["h"], r["text"]))
    out = {}
    for k, v in got.items():
        some = [letters(t) for _, t in sorted(v)[:docs]]
        out[k] = b" ".join(t[: max(64, size // len(some) - 1)] for t in some)[:size]
    return out


@functools.lru_cache(2)
def _compressors(items: tuple[tuple[str, bytes], ...], level: int):
    return [(k, zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)) for k, v in items]


def classify(text: str | None, items: tuple, level: int = LEVEL, block: int = BLOCK) -> tuple[str, float, bool]:
    """(language, score, rejected). The score is the margin to the runner-up, scaled: 0.5 at none, 1 at 10 % or more."""
    if not items or not text or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    data = letters(text)
    parts = [data[i : i + block] for i in range(0, len(data), block)]
    sizes = [(sum(len(c.compress(x)) for x in parts), k) for k, c in _compressors(items, level)]
    sizes.sort()
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    margin = (sizes[1][0] - sizes[0][0]) / max(1, sizes[0][0])
    return sizes[0][1], min(1.0, 0.5 + 5 * margin), margin < MARGIN


def language_id(docs: DataFrame, dicts: dict[str, bytes], text: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct column out (replaced if there): lang_pred, score, rejected (the margin is narrow). One scan, no
    shuffle.

    A null text, a text without letters, or no dictionaries at all: und, score 0, rejected. Ties go to the first
    language in code-point order. Texts are read whole, repeated rows answered each; an empty table gives an empty one;
    other columns pass through.
    """
    items = tuple(sorted(dicts.items()))

    def predict(texts: pa.Array) -> pa.Array:
        got = [classify(t, items) for i, j, _, _ in string_slices(texts, SLICE) for t in texts.slice(i, j - i).to_pylist()]
        lang, score, rejected = zip(*got) if got else ((),) * 3
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.array(score, float)), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    return docs.withColumn(out, arrow_udf(predict, "struct<lang_pred:string,score:double,rejected:boolean>")(F.col(text).cast("string")))


def held_out(id_col) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dicts = dictionaries(docs.where(~held_out("doc_id")))
    got = language_id(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), dicts)
    return got.select("doc_id", "held_out", "language.*")


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
