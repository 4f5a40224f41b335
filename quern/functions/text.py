"""Scalar transforms of strings, numbers, dates and paths as Spark columns, and their registry by source and target."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stay small in a title.
SMALL = ("a", "an", "the", "and", "but", "or", "for", "nor", "as", "at", "by", "from", "in", "into", "of", "on", "onto", "to", "with", "yet", "so", "upon", "like", "over", "plus", "up", "down", "off", "near")


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


#: Marks before and after a word while a text is taken apart; private-use characters.
_START, _STOP = "\ue010", "\ue011"


def title(c: Column) -> Column:
    """The first letter of every word in upper case, the rest as it is. A word starts with a letter, digit or _."""
    marked = F.regexp_replace(c, r"(\w\S*)", f"{_START}$1")
    return F.array_join(F.transform(F.split(marked, _START), lambda x, i: F.when(i == 0, x).otherwise(capitalize(x))), "")


def title_grammatical(c: Column) -> Column:
    """Each word as in title(), small words in lower case, and the first letter of all in upper case."""
    marked = F.regexp_replace(c, r"(\p{L}+)", f"{_START}$1{_STOP}")

    def word(part: Column, i: Column) -> Column:
        w, rest = (F.split_part(part, F.lit(_STOP), F.lit(k)) for k in (1, 2))
        return F.when(i == 0, part).otherwise(F.concat(F.when(F.lower(w).isin(*SMALL), F.lower(w)).otherwise(capitalize(w)), rest))

    return capitalize(F.array_join(F.transform(F.split(marked, _START), word), ""))


def camelize(c: Column) -> Column:
    parts = F.split(F.lower(c), r"[^a-z0-9]+")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(capitalize(x))), "")


def delimiter_on_case(c: Column, delimiter: str = "-") -> Column:
    """Every capital A-Z in lower case behind a delimiter (the first character without one); runs of - _ and space are one delimiter."""
    safe = re.sub(r"([\\$])", r"\\\1", delimiter)
    parted = F.regexp_replace(c, "(?<!^)([A-Z])", f"{safe}$1")
    small = F.translate(parted, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(small, "[-_ ]+", safe)


def abbreviated(c: Column) -> Column:
    """Three significant digits and K, M, G, T or P, beyond 1000, 10^6, ... (exclusive)."""
    c = c.cast("double")

    def digits(v: Column) -> Column:
        a = F.abs(v)
        return F.when(a < 10, F.format_string("%.2f", v)).when(a < 100, F.format_string("%.1f", v)).otherwise(F.format_string("%.0f", v))

    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for e, s in ((15, "P"), (12, "T"), (9, "G"), (6, "M"), (3, "K")):
        out = out.when(F.abs(c) > 10.0**e, F.concat(digits(c / 10.0**e), F.lit(s)))
    return out.otherwise(digits(c))


def range_limit(c: Column, low, high) -> Column:
    """Clamped; null becomes low."""
    return F.coalesce(F.least(F.greatest(c, F.lit(low)), F.lit(high)), F.lit(low))


def number(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t == "", 0.0).otherwise(F.coalesce(t.try_cast("double"), F.lit(float("nan"))))


def parse_float(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double"), F.when(c.isNotNull(), float("nan")))


def parse_int(c: Column, radix: int = 10) -> Column:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    found = F.regexp_extract(F.lower(c), rf"^\s*([+-]?[{digits}]+)", 1)
    return F.when(found != "", F.conv(found, radix, -10).cast("bigint"))


def word(c: Column, n: int) -> Column:
    """The n-th word, from 1; "" if there is none."""
    return F.coalesce(F.try_element_at(F.split(c, r"\s+"), F.lit(n)), F.lit(""))


def split_clean(c: Column, delimiter: str) -> Column:
    return F.filter(F.transform(F.split(c, _quoted(delimiter)), lambda x: F.trim(x)), lambda x: x != "")


def _quoted(s: str) -> str:
    return r"\Q" + s.replace(r"\E", r"\E\\E\Q") + r"\E"


def char_at(c: Column, i: int) -> Column:
    return F.when(F.lit(i < 0) | (F.length(c) <= i), "").otherwise(F.substring(c, i + 1, 1))


def at(c: Column, i: int) -> Column:
    """Like char_at, but negative positions count from the end, and there may be none."""
    return F.nullif(F.when(F.length(c) + i >= 0, F.substring(c, i, 1)).otherwise("") if i < 0 else char_at(c, i), F.lit(""))


def code_point(c: Column, i: int) -> Column:
    return F.when(F.length(c) > i, F.ascii(F.substring(c, i + 1, 1)))


def char_code(c: Column, i: int) -> Column:
    """The UTF-16 unit at position i of the text's units; null behind its end."""
    units = F.encode(c, "UTF-16BE")
    pair = F.substring(F.hex(units), 4 * i + 1, 4)
    return F.when(F.length(pair) == 4, F.conv(pair, 16, 10).cast("int"))


def time_of(c: Column) -> Column:
    """Milliseconds since midnight of a text HH:mm[:ss[.fff]]; null for any other."""
    part = lambda k: F.regexp_extract(c, r"^([01]?\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(?:\.(\d{1,3}))?)?$", k)
    whole = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).cast("bigint"), F.lit(0))
    return F.when(part(1) != "", ((whole(1) * 60 + whole(2)) * 60 + whole(3)) * 1000 + F.rpad(part(4), 3, "0").cast("bigint"))


def date_local(c: Column, zone: str) -> Column:
    """The instant of a text without a zone, read in zone."""
    return F.to_utc_timestamp(F.try_to_timestamp(c), zone)


def drop_bracket_prefix(c: Column) -> Column:
    return F.when(c.startswith("["), F.coalesce(F.get(F.split(c, r"\] ", 2), F.lit(1)), c)).otherwise(c)


def xml_encode(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")), c)


def starts_with_any(c: Column, prefixes: list[str], ignore_case: bool = False) -> Column:
    c, prefixes = (F.lower(c), [p.lower() for p in prefixes]) if ignore_case else (c, prefixes)
    return reduce(lambda a, b: a | b, (c.startswith(p) for p in prefixes), F.lit(False))


def typed(c: Column, kind: str) -> Column:
    return c.try_cast({"real": "double", "number": "double", "int": "bigint", "integer": "bigint"}.get(kind, kind))


# --- paths


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)/*$", 1)


def dirname(c: Column) -> Column:
    d = F.regexp_replace(c, r"/*[^/]*/*$", "")
    return F.when(d != "", d).otherwise(F.when(c.startswith("/"), "/").otherwise("."))


def extname(c: Column) -> Column:
    return F.regexp_extract(basename(c), r"[^.](\.[^.]*)$", 1)


def normalize_path(c: Column) -> Column:
    """Without ., .. and repeated slashes, by a fold over the parts."""
    parts = F.filter(F.split(c, "/+"), lambda p: (p != "") & (p != "."))
    rooted = c.startswith("/")

    def step(acc: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(acc) > 0) & ~F.coalesce(F.try_element_at(acc, F.lit(-1)) == "..", F.lit(False))
        return F.when(up, F.slice(acc, 1, F.size(acc) - 1)).when((p == "..") & rooted, acc).otherwise(F.concat(acc, F.array(p)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    body = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"), F.when(c.rlike("[^/]/+$") & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(body == "", ".").otherwise(body)


def join_path(*parts: Column) -> Column:
    return normalize_path(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/"))


def resolve_path(c: Column, base: str = "/") -> Column:
    return F.regexp_replace(normalize_path(F.when(c.startswith("/"), c).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), c))), r"(.)/$", "$1")


def parse_path(c: Column) -> Column:
    base, ext = basename(c), extname(c)
    return F.struct(F.when(c.startswith("/"), "/").otherwise("").alias("root"), F.when(c.contains("/"), dirname(c)).otherwise("").alias("dir"), base.alias("base"), ext.alias("ext"), F.substring(base, F.lit(1), F.length(base) - F.length(ext)).alias("name"))


def format_path(c: Column) -> Column:
    return F.when(F.coalesce(c["dir"], F.lit("")) == "", c["base"]).when(c["dir"] == "/", F.concat(F.lit("/"), c["base"])).otherwise(F.concat_ws("/", c["dir"], c["base"]))


#: source -> target -> f(column, *arguments)
TRANSFORMS = {
    "String": {
        "Append": lambda c, s: F.concat(c, F.lit(s)), "Concat": lambda c, s: F.concat(c, F.lit(s)), "Prepend": lambda c, s: F.concat(F.lit(s), c), "ArrayByDelimiter": split_clean, "At": at,
        "Capitalize": capitalize, "Camelize": camelize, "CharAt": char_at, "CharCodeAt": char_code, "CodePointAt": code_point, "Date": lambda c: F.try_to_timestamp(c), "DateLocal": lambda c, zone="UTC": date_local(c, zone), "Time": time_of,
        "Timestamp": lambda c: F.unix_millis(F.try_to_timestamp(c)), "DelimiterOnCase": delimiter_on_case, "Deunderscore": lambda c: F.replace(c, F.lit("_"), F.lit(" ")),
        "DeunderscoreCapitilize": lambda c: title(F.replace(c, F.lit("_"), F.lit(" "))), "DropSquareBracketPrefix": drop_bracket_prefix, "EndsWith": lambda c, s: c.endswith(s), "Float": parse_float,
        "GetWord": word, "Integer": parse_int, "isBetween": lambda c, a, b: c.between(a, b), "JSON": lambda c: F.try_parse_json(c), "LowerCase": F.lower, "Number": number, "RangeLimit": range_limit, "Real": parse_float,
        "Split": lambda c, s: F.split(c, _quoted(s)), "StartsWith": lambda c, s: c.startswith(s), "Title": title, "TitleGrammatical": title_grammatical, "Trim": lambda c: F.regexp_replace(c, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", ""),
        "TrimEnd": lambda c: F.regexp_replace(c, r"[\s\u00a0\ufeff]+$", ""), "TrimStart": lambda c: F.regexp_replace(c, r"^[\s\u00a0\ufeff]+", ""), "UpperCase": F.upper, "XmlStringEncode": xml_encode,
        "CRLF2BR": lambda c: F.regexp_replace(c, r"\r?\n", "<br/>"), "in": lambda c, *v: c.isin(*v), "StartsWithList": starts_with_any,
    },
    "Number": {"Abbreviated": abbreviated, "isBetween": lambda c, a, b: c.between(a, b), "RangeLimit": range_limit},
    "BigInt": {"RangeLimit": range_limit, "Abbreviated": abbreviated},
    "Date": {"isBetween": lambda c, a, b: c.between(a, b), "ISODate": lambda c: F.date_format(c, "yyyy-MM-dd"), "LocalDate": lambda c: F.date_format(c, "M/d/yyyy"), "RangeLimit": range_limit},
    "Object": {"Coalesce": lambda c, v: F.coalesce(c, F.lit(v)), "DeepClone": lambda c: c, "Nullif": lambda c, v: F.nullif(c, F.lit(v))},
    "path": {"Basename": basename, "Dirname": dirname, "Extname": extname, "Format": format_path, "IsAbsolute": lambda c: c.startswith("/"), "Join": join_path, "Parse": parse_path, "Normalize": normalize_path, "Resolve": resolve_path},
}


def transform(source: str, target: str, c: Column, *arguments) -> Column:
    found = TRANSFORMS.get(source, {}).get(target)
    if found is None:
        raise ValueError(f"No transform from {source} to {target}")
    return found(c, *arguments)
