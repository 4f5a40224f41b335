"""Quality rules by tokeniser fertility.

A public byte-level vocabulary measures, for each whole text, the characters a token stands for, the share of tokens
that are fragments of a character (byte fallback) and the entropy of the token distribution. Bands per script reject.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import table, vocabulary

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WINDOW = 8
#: Bands per script: least and most characters a token, largest share of byte-fallback tokens, least normalised token
#: entropy. Entropy and characters a token say little about short texts: below MIN_TOKENS only the byte share counts.
BANDS = {
    "latin": (1.9, 7.5, 0.20, 0.45),
    "cyrillic": (0.8, 6.0, 0.45, 0.45),
    "greek": (0.6, 6.0, 0.55, 0.45),
    "cjk": (0.3, 3.0, 0.90, 0.45),
    "other": (0.2, 7.5, 0.97, 0.40),
}
MIN_TOKENS = 40
#: Beyond this many tokens the entropy of clean text hardly grows, so it is divided by no more than log2 of this.
FULL = 512
SLICE = 1 << 18
TYPE = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,kept:boolean,n_tokens:bigint,chars_per_token:double,byte_share:double,token_entropy:double,script:string>"

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_slices(texts: pa.Array, size: int):
    """(bytes, offsets) of consecutive runs of whole texts of about size bytes; null is empty."""
    a = texts.cast(pa.large_string()).fill_null("")
    if not len(a):
        return
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether its key occurs twice or more; whether it is the first of its key in sort order."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    twice, first = np.empty(len(s), bool), np.empty(len(s), bool)
    twice[order], first[order] = same[1:] | same[:-1], ~same[:-1]
    return twice, first


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the texts data[off[i]:off[i + 1]].

    Words and lines are compared by 64-bit hashes within a text.
    """
    n, size = len(off) - 1, len(data)
    zero = np.zeros(n, np.int64)
    if not size:
        return dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), zero)
    edge = np.zeros(size + 1, bool)
    edge[off] = True
    word = ~_SPACE[data]

    def per_text(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return c[off[1:]] - c[off[:-1]]

    before = np.concatenate(([False], word[:-1])) & ~edge[:-1]
    after = np.concatenate((word[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    up, down = _powers(max(SLICE * 2, 1 << size.bit_length()))
    h = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:size], out=h[1:])

    def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((h[b] - h[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    of_word = np.searchsorted(off, starts, "right") - 1
    w = hashed(starts, ends)
    repeat = zero
    if len(w) >= WINDOW:
        m = len(w) - WINDOW + 1
        key = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            key = key * np.uint64(0xF1357AEA2E62A9C5) + w[k : k + m]
        whole = np.flatnonzero(of_word[WINDOW - 1 :] == of_word[:m])
        twice, _ = _repeated(_mix(key[whole] + of_word[whole].astype(np.uint64) * _BASE))
        at = whole[twice]
        step = np.bincount(at, minlength=len(w) + WINDOW + 1) - np.bincount(at + WINDOW, minlength=len(w) + WINDOW + 1)
        covered = np.cumsum(step)[: len(w)] > 0
        repeat = np.bincount(of_word[covered], minlength=n)
    newline = data == 10
    first = np.unique(np.concatenate((off[:-1][off[:-1] < size], np.flatnonzero(newline)[np.flatnonzero(newline) + 1 < size] + 1)))
    last = np.concatenate((first[1:], [size]))
    last = last - (newline[last - 1] & (last > first))
    c = np.concatenate(([0], np.cumsum(word, dtype=np.int64)))
    full = c[last] > c[first]
    first, last = first[full], last[full]
    of_line = np.searchsorted(off, first, "right") - 1
    _, new = _repeated(_mix(hashed(first, last) + of_line.astype(np.uint64) * _BASE))
    return {
        "n_words": np.bincount(of_word, minlength=n),
        "word_chars": per_text(word & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_dup_lines": np.bincount(of_line[~new], minlength=n),
        "n_repeat_words": repeat,
    }


@functools.lru_cache(4)
def _encoding(name: str, folder: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(vocabulary(name, folder), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    part = np.zeros(max(ranks.values()) + 2, bool)
    for token, i in ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            part[i] = True
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), part


def script_of(data: np.ndarray) -> str:
    """The script that most of a text's letters have, told from the lead bytes of their UTF-8 forms."""
    if not len(data):
        return "other"
    c = np.bincount(data, minlength=256)
    ascii_letters = c[65:91].sum() + c[97:123].sum()
    latin = ascii_letters + c[0xC3:0xCA].sum()
    counts = {"latin": latin, "greek": c[0xCD:0xD0].sum(), "cyrillic": c[0xD0:0xD4].sum(), "cjk": c[0xE3:0xEE].sum(), "other": c[0xD4:0xE3].sum() + c[0xEE:0xF5].sum()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def fertility(text: str, data: np.ndarray, name: str = VOCABULARY, folder: str = "") -> tuple[int, float, float, float, str]:
    """Tokens, characters a token, byte-fallback share, token entropy (divided by that of min(n, FULL) equal tokens), script."""
    encoding, part = _encoding(name, folder)
    ids = encoding.encode_to_numpy(text, disallowed_special=())
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0, "other"
    c = np.bincount(ids) if n > 5000 else np.unique(ids, return_counts=True)[1]
    p = c[c > 0] / n
    h = float(-(p * np.log2(p)).sum())
    return n, len(text) / n, float(part[ids].mean()), h / np.log2(min(n, FULL)) if n > 1 else 1.0, script_of(data)


def in_bands(n: int, chars: float, share: float, entropy: float, script: str, bands: dict = BANDS) -> bool:
    low, high, byte, least = bands[script]
    return share <= byte and (n < MIN_TOKENS or (low <= chars <= high and entropy >= least))


def _scored(name: str, folder: str, bands: dict):
    def score(texts: pa.Array) -> pa.Array:
        cols: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        more: list[tuple] = []
        for i, j, data, off in string_slices(texts, SLICE):
            for k, v in base_counts(data, off).items():
                cols[k].append(v)
            for k, text in enumerate(texts.slice(i, j - i).to_pylist()):
                more.append(fertility(text or "", data[off[k] : off[k + 1]], name, folder))
        c = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in cols.items()}
        failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
        kept = ~failed & np.array([in_bands(*x, bands) for x in more], bool)
        n, chars, share, entropy, script = zip(*more) if more else ((),) * 5
        fields = [pa.array(v, pa.int64()) for v in c.values()] + [pa.array(failed), pa.array(kept, pa.bool_()), pa.array(n, pa.int64()), *(pa.array(x, pa.float64()) for x in (chars, share, entropy)), pa.array(script, pa.string())]
        return pa.StructArray.from_arrays(fields, [*c, "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "script"])

    return arrow_udf(score, TYPE)


def quality_rules(docs: DataFrame, text: str = "text", out: str = "quality_rules", vocab: str = VOCABULARY, folder: str = "", bands: dict | None = None) -> DataFrame:
    """docs with a struct column out: base counts, fertility measures, base_failed and kept. One scan, no shuffle.

    A null or empty text has no words, fails the base rule (under 20 words) and isn't kept. Repeated rows are judged
    each on its own, very long texts whole. An empty table gives an empty table. A column named out is replaced; other
    columns pass through.
    """
    return docs.withColumn(out, _scored(vocab, folder, bands or BANDS)(F.col(text).cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", "quality_rules.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go."""
    return quality_rules(docs, out="__quality").where("__quality.kept").select(*docs.columns)
