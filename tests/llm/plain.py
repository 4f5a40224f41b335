"""Plain versions of the operators' contracts, and awkward tables."""

import hashlib
import random
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows, extra=True):
    """(doc_id, text) rows as a table with further columns, one of them with a name that operators use."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, n_words int")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def awkward(seed=0, words=300):
    """Texts: null, empty, blank, short, repeated, near copies, odd white space, other scripts, and a very long one."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 7))) for _ in range(200)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared, long = text(60), text(words * 40)
    out = [None, "", "   \n\t ", "a", "A b", "日本語 の テキスト", "x" * 500, "ab " * 200, "one\ntwo\none\n\none", shared, shared, shared + " end", "start " + shared, long, long + "!", long]
    out += [text(r.randint(1, words)) for _ in range(20)]
    out += [out[k].replace(" ", " ", 1) for k in (20, 21)] + [out[22] + " tail", out[22].upper()]
    return list(enumerate(out))


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows, covered = {}, set()
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            covered.update(k for i in at for k in range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(values, far=2):
    """Smallest position that each value's links reach; values are (id, fingerprint)."""
    label = {i: i for i, _ in values}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, a) in enumerate(values):
        for j, b in values[:k]:
            if (a ^ b).bit_count() <= far:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: root(i) for i, _ in values}


def substrings(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


def licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    labels, at = set(), []
    for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")):
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def accepts(expression, stream):
    """Whether a union-free expression, all of whose items are optional, holds a stream: by trying every way."""

    def once(ways, field):
        out = {i + 1 for i in ways if i < len(stream) and stream[i] == field.rstrip("+")}
        return out | once(out, field) if field.endswith("+") and out else out

    ways = {0}
    for key in expression:
        unit = key[1:-2].split("\x1f") if key.endswith(")+") else [key]
        step = ways
        while step:
            for field in unit:
                step = once(step, field)
            step -= ways
            ways = ways | step
            if not key.endswith(")+"):
                break
    return len(stream) in ways


def _luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def personal(text):
    """Base spans (start, end, kind) by the patterns as they are written."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    kinds = list(rules)
    found = [(m.start(), m.end(), k) for k, (pattern, passes) in rules.items() for m in re.finditer(pattern, text) if passes(m[0])]
    return sorted(found, key=lambda x: (x[0], kinds.index(x[2])))


def fewest_bins(lengths, capacity):
    """The least number of bins, over all subsets: bins that are full, and what the open one holds."""
    best = [(0, capacity)] + [(len(lengths) + 1, 0)] * ((1 << len(lengths)) - 1)
    for held in range(1 << len(lengths)):
        bins, room = best[held]
        for k, n in enumerate(lengths):
            if not held >> k & 1:
                to = held | 1 << k
                best[to] = min(best[to], (bins, room + n) if room + n <= capacity else (bins + 1, n))
    return best[-1][0]


def language(text, dicts):
    """(language, size): the dictionary that makes the text's letters smallest, in blocks of 4096 bytes."""
    import unicodedata

    import zstandard

    if not any(c.isalpha() for c in text or ""):
        return "und", 0
    is_letter = [c.isalpha() or unicodedata.category(c)[0] == "M" and re.match(r"\w", c) for c in text.lower()]
    data = re.sub(" +", " ", "".join(c if x else " " for c, x in zip(text.lower(), is_letter))).encode()
    sizes = []
    for k, v in sorted(dicts.items()):
        size = 0
        for i in range(0, len(data), 4096):
            d = zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            size += len(zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[i : i + 4096]))
        sizes.append((size, k))
    return min(sizes)[::-1]


def shingles(text, k=5):
    words = WORD.findall(lower(text))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0
