"""Personal data by weak supervision: labelling functions vote on candidate spans, EM weighs them, a classifier decides.

Candidates come from regular expressions, gazetteers and the words around them. Every labeller votes yes, no or nothing on
every candidate. The votes are counted over the whole corpus by pattern (a bounded number of patterns), EM estimates each
labeller's reliability and each kind's prior on those counts, and a logistic span classifier is trained on the resulting
probabilities, from the votes and from features of the span and of its context. Spans that the base patterns find always
stay. Every pattern is matched in time that is linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import forget, table, written
from .quality import SLICE, string_slices

KINDS = ("email", "ip", "card", "phone")
MORE = ("secret", "ssn", "iban", "passport", "birthdate", "person", "address")
ALL = (*KINDS, *MORE)
#: The classifier is fitted on about so many candidates, those with the least hashes; features are hashed to so many weights.
SAMPLE, WEIGHTS = 20_000, 4096
# The base patterns of the result's contract, in forms that are linear: what a match starts with is found first.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Gazetteers, parameters: given names, endings of streets, endings of hosts, countries with account numbers, words that are
#: no secrets.
NAMES = "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Emily Mark Anna Paul Laura Peter Maria Hans Sabine Klaus Ursula Wolfgang Monika Jean Marie Pierre Nathalie Michel Isabelle Carlos Carmen Jose Ana Luis Elena Antonio Lucia".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Boulevard Blvd Drive Way Square Court".split()
TLD = frozenset("com org net edu gov mil int io info biz co me app dev uk de fr es it nl eu us ca au ch at be pl se no dk fi pt ie cz hu ro gr jp cn in br mx ru za nz kr".split())
COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK".split())
COMMON = frozenset("password passwords token secret changeme example undefined required disabled".split())
# Candidates of the method's own.
_OWN = {
    "secret": re.compile(r"(?<![A-Za-z0-9_])(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[ \t]{0,2}[=:][ \t]{0,2}[\"']?([A-Za-z0-9+/_.-]{8,})"),
    "ssn": re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)(?![A-Za-z0-9])"),
    "passport": re.compile(r"(?i:passport|reisepass|passeport|pasaporte)[^A-Za-z0-9\n]{1,3}(?:(?i:no|number|nr|num)[.:# ]{1,3})?([A-Z0-9]{6,9})(?![A-Za-z0-9])"),
    "birthdate": re.compile(r"(?<![A-Za-z])(?i:born|dob|birthday|birthdate|date of birth|geboren|nacid[oa])[^0-9\n]{1,12}([0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4})(?![0-9])"),
    "person": re.compile(rf"(?<![A-Za-z])((?:{'|'.join(NAMES)})(?: [A-Z]\.)? [A-Z][a-z]+)(?![A-Za-z])"),
    "address": re.compile(rf"(?<![0-9A-Za-z])([0-9]{{1,5}} (?:[A-Z][a-z]+ ){{1,3}}(?:{'|'.join(STREETS)}))(?![A-Za-z])"),
}
_FIELD = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "call", "tel", "mobile", "fax"),
    "secret": ("password", "token", "secret", "key"), "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "bank"), "passport": ("passport", "travel"), "birthdate": ("birth", "born", "dob"),
    "person": ("name", "mr", "ms", "dr", "signed", "contact", "dear"), "address": ("address", "lives", "street", "home", "ship"),
}
#: The labellers' weights in the vote that EM starts from; a failed check outweighs two others.
FIRST = np.array([1, 3, 1, 1, 1, 1])
LABELLERS = ("pattern", "check", "gazetteer", "context", "variety", "shape")
_WORDISH = re.compile(r"[A-Za-z]+$")
_LETTERS, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


_NOT_DIGITS = {ord(c): None for c in " ().-+"}


def _only_digits(s: str) -> str:
    return s.translate(_NOT_DIGITS)


def emails(text: str):
    """(start, end) of addresses: around each @, the whole run before it that no match has, and a host after it."""
    at, free = text.find("@"), 0
    if at < 0:
        return
    back, n = text[::-1], len(text)
    while at >= 0:
        local = _LOCAL.match(back, n - at, n - free)
        if local and (host := _DOMAIN.match(text, at + 1)):
            free = host.end()
            yield n - local.end(), free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), sorted by start, then kind as listed: leftmost non-overlapping matches per kind that pass."""
    out = [(a, b, "email") for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def own_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates of the method's own; patterns that need a digit, or a sign, aren't tried on a text without any."""
    digit, sign = _DIGIT.search(text), "=" in text or ":" in text
    kinds = [k for k in _OWN if (sign if k == "secret" else k == "person" or digit)]
    return [(*m.span(1), kind) for kind in kinds for m in _OWN[kind].finditer(text)]


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _date(s: str) -> bool:
    a, b, c = (int(x) for x in re.split("[-/.]", s))
    day, month, year = (c, b, a) if a > 31 else (a, b, c)
    return 1 <= min(day, month) <= 12 and max(day, month) <= 31 and (1900 <= year <= 2030 or year < 100)


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """Votes of LABELLERS: 2 yes, 0 no, 1 nothing."""
    s = text[start:end]
    near = text[max(0, start - 40) : start].lower()
    digits = _only_digits(s)
    pattern = 2 if kind in (*KINDS, "ssn", "passport", "birthdate") else 1
    check = 1
    if kind == "card":
        check = 2 if luhn(digits) else 0
    elif kind == "iban":
        check = 2 if _iban(s) else 0
    elif kind == "ssn":
        check = 0 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 2
    elif kind == "secret":
        check = 2 if _DIGIT.search(s) and _LETTERS.search(s) else 0
    elif kind == "birthdate":
        check = 2 if _date(s) else 0
    elif kind == "passport":
        check = 2 if _DIGIT.search(s) else 0
    elif kind == "ip":
        check = 0 if any(len(p) > 1 and p[0] == "0" for p in s.split(".")) or s.startswith("0.") else 2
    gazetteer = 1
    if kind == "email":
        gazetteer = 2 if s.rpartition(".")[2].lower() in TLD else 1
    elif kind == "secret":
        gazetteer = 0 if s.lower() in COMMON or _WORDISH.match(s) else 2
    elif kind == "iban":
        gazetteer = 2 if s[:2] in COUNTRIES else 0
    elif kind in ("person", "address"):
        gazetteer = 2
    context = 2 if any(w in near for w in _FIELD[kind]) else 1
    variety = 2 if len(set(s)) >= 6 else 0
    after = text[end : end + 1]
    shape = 0 if (start and (text[start - 1].isalnum())) or after.isalnum() else 2
    return pattern, check, gazetteer, context, variety, shape


def code_of(kind: str, v: tuple[int, ...]) -> int:
    c = ALL.index(kind)
    for x in v:
        c = c * 3 + x
    return c


def decode(code: int) -> tuple[str, list[int]]:
    v = []
    for _ in LABELLERS:
        code, x = divmod(code, 3)
        v.append(x)
    return ALL[code], v[::-1]


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """EM for a naive-Bayes label model: P(span is personal) of each vote pattern.

    yes[k], no[k]: distribution of labeller k's votes given the truth, over all kinds; a prior a kind. Starts from the vote
    of the majority, in which a check counts as FIRST says; smoothed.
    """
    kind = np.array([ALL.index(decode(int(c))[0]) for c in codes], int)
    v = np.array([decode(int(c))[1] for c in codes]).reshape(-1, len(LABELLERS))
    p = np.clip(0.5 + 0.2 * ((v - 1) @ FIRST), 0.05, 0.95)
    for _ in range(rounds):
        total = np.bincount(kind, counts, len(ALL))
        prior = np.clip((np.bincount(kind, counts * p, len(ALL)) + 1) / (total + 2), 0.01, 0.99)[kind]
        log = np.log(prior / (1 - prior))
        for k in range(v.shape[1]):
            yes = np.array([(counts * p * (v[:, k] == x)).sum() for x in range(3)]) + [0.5, 1, 1.5]
            no = np.array([(counts * (1 - p) * (v[:, k] == x)).sum() for x in range(3)]) + [1.5, 1, 0.5]
            log += np.log(yes[v[:, k]] / yes.sum()) - np.log(no[v[:, k]] / no.sum())
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return p


_WORD = re.compile(r"[^\W\d_]+")
_SHAPE = ((re.compile("[A-Z]+"), "A"), (re.compile("[a-z]+"), "a"), (re.compile("[0-9]+"), "0"))


def features(text: str, start: int, end: int, kind: str, v: tuple[int, ...]) -> list[int]:
    """Hashed features of a candidate: its votes, its shape, length, digits and entropy, and the words and characters around."""
    s = text[start : min(end, start + 80)]
    shape = s[:40]
    for pattern, mark in _SHAPE:
        shape = pattern.sub(mark, shape)
    share = [s.count(c) / len(s) for c in set(s)]
    before = _WORD.findall(text[max(0, start - 32) : start].lower())[-2:]
    after = _WORD.findall(text[end : end + 24].lower())[:1]
    named = {
        "shape": shape[:16], "length": (end - start).bit_length(), "digits": sum("0" <= c <= "9" for c in s) * 4 // len(s), "entropy": int(-2 * sum(x * math.log2(x) for x in share)),
        "before": before[-1] if before else "", "before2": before[0] if len(before) > 1 else "", "after": after[0] if after else "", "left": text[start - 1] if start else "", "right": text[end : end + 1], "kind": "",
    } | {f"vote {name}": x for name, x in zip(LABELLERS, v)}
    return [zlib.crc32(f"{kind} {k} {x}".encode("utf-8", "surrogatepass")) % WEIGHTS for k, x in named.items()]


def train(rows: list[list[int]], labels: np.ndarray, weights: np.ndarray, rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """The span classifier's weights: logistic regression on EM's probabilities as soft labels, by gradient steps that
    adapt to each weight's own gradients."""
    w = np.zeros(WEIGHTS)
    if not rows:
        return w
    at, share = np.array(rows), weights / weights.sum()
    seen = np.zeros(WEIGHTS)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[at].sum(1), -30, 30)))
        g = np.bincount(at.ravel(), np.repeat(share * (p - labels), at.shape[1]), WEIGHTS) + decay * w
        seen += g * g
        w -= rate * g / (np.sqrt(seen) + 1e-8)
    return w


def probability(w: np.ndarray, row: list[int]) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[row].sum(), -30, 30))))


_FOUND = "struct<kind:string,start:int,end:int,base:boolean,code:int,features:array<int>>"
_FOUND_TYPE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32()), ("features", pa.list_(pa.int32()))])


def candidates_in(text: str | None) -> list[dict]:
    out = []
    if text:
        for base, spans in ((True, base_spans(text)), (False, own_spans(text))):
            for a, b, kind in spans:
                v = votes(text, a, b, kind)
                out.append({"kind": kind, "start": a, "end": b, "base": base, "code": code_of(kind, v), "features": features(text, a, b, kind, v)})
    return out


def _each(texts: pa.Array):
    """Texts in order, a slice of whole ones in Python at a time."""
    for i, j, _, _ in string_slices(texts, SLICE):
        yield from texts.slice(i, j - i).to_pylist()


def _candidates(texts: pa.Array) -> pa.Array:
    return pa.array([candidates_in(t) for t in _each(texts)], pa.list_(_FOUND_TYPE))


def candidates(docs: DataFrame, text: str = "text", out: str = "found") -> DataFrame:
    return docs.withColumn(out, arrow_udf(_candidates, f"array<{_FOUND}>")(F.col(text).cast("string")))


def classifier(found: DataFrame, column: str = "found", sample: int = SAMPLE) -> np.ndarray:
    """Weights trained on the votes on all candidates of the corpus, gathered as counts by pattern (11 * 3 ** 6 at most),
    and on the features of about sample candidates with the least hashes."""
    each = found.select(F.explode(column).alias("f")).select("f.code", "f.features", F.xxhash64("f").alias("h"))
    rows = each.groupBy("code").agg(F.count("*").alias("n")).collect()
    if not rows:
        return np.zeros(WEIGHTS)
    rows.sort(key=lambda r: r["code"])
    codes, counts = np.array([r["code"] for r in rows], np.int64), np.array([r["n"] for r in rows], float)
    sure = dict(zip(codes.tolist(), reliabilities(codes, counts)))
    n = int(counts.sum())
    if n > sample:
        each = each.where(F.col("h") <= -(2**63) + 2**64 * sample // n)
    some = each.groupBy("code", "features").agg(F.count("*").alias("n")).collect()  # equal ones are one with a weight
    some.sort(key=lambda r: (r["code"], r["features"]))
    return train([r["features"] for r in some], np.array([sure[r["code"]] for r in some]), np.array([r["n"] for r in some], float))


def accepted(found: list[dict], w: np.ndarray, least: float = 0.5) -> list[tuple[int, int, str]]:
    """Base spans, and the method's that the classifier accepts and that lie in no base span."""
    base = [(f["start"], f["end"], f["kind"]) for f in found if f["base"]]
    own = [(f["start"], f["end"], f["kind"]) for f in found if not f["base"] and probability(w, f["features"]) >= least]
    inside, k, reach = [], 0, -1
    for a, b, kind in sorted(own):  # base spans that start no later reach so far
        while k < len(base) and base[k][0] <= a:
            reach = max(reach, base[k][1])
            k += 1
        if b > reach:
            inside.append((a, b, kind))
    return sorted(base + inside, key=lambda x: (x[0], ALL.index(x[2]), x[1]))


_RESULT = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string,mean_score:double>"


def digest_of(found: list[dict], w: np.ndarray) -> dict:
    base = [x for x in found if x["base"]]
    text = ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in base)
    spans = ",".join(f"{k}:{a}:{b}" for a, b, k in accepted(found, w))
    score = float(np.mean([probability(w, x["features"]) for x in found])) if found else None
    return {f"n_{k}": sum(x["kind"] == k for x in base) for k in KINDS} | {"base_sha256": hashlib.sha256(text.encode()).hexdigest(), "spans": spans, "mean_score": score}


def _digest(w: np.ndarray):
    kind = pa.struct([*((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("mean_score", pa.float64())])
    return arrow_udf(lambda found: pa.array([digest_of(f or [], w) for f in found.to_pylist()], kind), _RESULT)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id_col and a struct personal with base counts, the base spans' digest, all spans and their mean score.

    A null or empty text has no spans (the digest is that of the empty string). Offsets are code points, ends exclusive.
    Very long texts are read whole, in time linear in their length; repeated rows are answered each; an empty table gives
    an empty result. Only id_col and text are read, so other columns can't clash. The candidates, not the texts, are
    written once to the shared folder and read twice.
    """
    found = written(candidates(docs.select(id_col, text)).select(id_col, "found"), "spans")
    return found.select(id_col, _digest(classifier(found))("found").alias("personal"))


def covered(text: str | None, w: np.ndarray) -> str | None:
    """A text with each accepted span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    found = candidates_in(text)
    if not found:
        return text
    parts, at = [], 0
    for a, b, k in accepted(found, w):
        if a >= at:
            parts += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with accepted spans covered; null and empty texts stay, repeated rows are each covered, other columns pass through."""
    found = written(candidates(docs.select(text)).select("found").where(F.size("found") > 0), "spans")
    w = classifier(found)
    forget(found)
    return docs.withColumn(text, arrow_udf(lambda texts: pa.array([covered(t, w) for t in _each(texts)], pa.string()), "string")(F.col(text).cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).select("doc_id", "personal.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: accepted spans are replaced by their kind; n_chars follows the text. Null texts and null counts stay;
    every row is kept, repeated ones and those without an id too; an empty table stays one."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
