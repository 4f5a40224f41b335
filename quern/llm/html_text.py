"""Main text of web pages by union-free wrappers, inferred by aligning the token streams of a host's pages.

A page is a stream of text fields, each named by the path of block elements around it. Tandem repeats fold into repeated
groups. The streams of one host's distinct pages are aligned into a union-free regular expression: what only some pages
have becomes optional, what comes several times in a row a repeated group, and a field whose text differs between pages
a slot. A page is then matched against its host's expression, and its text is what the expression calls content: slots
and repeated groups, without the template's constants, and without the fields that markup or names call furniture.
"""

from __future__ import annotations

import difflib
import hashlib
import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import table, written

#: A constant of the template stands on this share of a host's distinct pages and on this many at least.
SHARE, PAGES = 0.5, 4
#: An element named as furniture is content all the same if it holds this share of a host's text, and all its paragraphs
#: and headings.
MOST = 0.8
#: A list outside of articles is a menu if this share of its characters is in links.
LINKS = 0.8
#: A path beyond this many characters stands as its digest in those below it.
LONG = 400
#: An expression is inferred from so many slices of a host's classes, whatever the number of tasks.
SLICES = 16
#: Wrappers of up to this many bytes in all are broadcast, others are joined by host.
BROADCAST = 32 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|select|head|canvas|math|audio|video)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S | re.I,
)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr center".split())
_SPACE = frozenset(("br", "input", "img", "wbr"))
_VOID = frozenset("br input img wbr meta link col area base embed source track param".split())
_DROP = frozenset("nav footer aside button menu dialog fieldset".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_SHORT = frozenset(("p", *_HEADINGS, *"li dt dd tr td th option".split()))
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: A class or id names furniture if one of its words is the first kind and all others are the second.
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion promotions banner sidebar nav navbar navigation menu topbar breadcrumb breadcrumbs footer masthead cookie cookies notice notices notification notifications disclaimer paywall consent gdpr alert alerts popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments commentlist respond disqus replies widget widgets pagination pager copyright toolbar login search skip hidden".split()
)
_NEUTRAL = frozenset("site main top bottom left right page pages global primary secondary box boxes container wrapper wrap block section list area bar item items inner outer content post posts article articles entry blog user side sub foot header links link icons buttons button panel row col column group form by to more footer text title js id x".split())
_NAMES_SAY_NOTHING = frozenset(("blockquote", "pre", "code", "figure", "table", "thead", "tbody", "tr", "td", "th", *_HEADINGS))
_IDS = frozenset("div section ul ol aside span".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def named_furniture(name: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(name)]
    return any(w in _FURNITURE for w in words) and all(w in _FURNITURE or w in _NEUTRAL for w in words)


def _reads(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element's attributes make it furniture by markup (hidden, a role), and by its names."""
    hard = named = False
    if attrs and tag not in ("html", "body"):
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "class":
                named |= tag not in _NAMES_SAY_NOTHING and any(map(named_furniture, value.split()))
            elif name == "id":
                named |= tag in _IDS and named_furniture(value)
            elif name == "role":
                hard |= value.lower() in _ROLES
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDES.search(value)):
                hard = True
    return hard, named


def _label(tag: str, attrs: str) -> str:
    found = re.search(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", attrs, re.I) if attrs else None
    return f"{tag}.{'.'.join(sorted((found[1] or found[2] or found[3] or '').split()))}" if found else tag


class _Element:
    __slots__ = ("article", "articles", "chars", "hard", "heads", "label", "named", "parent", "tag")

    def __init__(self, tag: str, label: str, parent: _Element | None, hard: bool, named: bool):
        self.tag, self.label, self.parent, self.hard, self.named = tag, label, parent, hard, named
        self.article = tag == "article" or (parent is not None and parent.article)
        self.chars, self.articles, self.heads = 0, 0, 0  # characters, articles, main elements and first headings in it


class Block:
    """A text field: its path, with ! before elements named as furniture, its text, characters in links, and whether it is
    inside an article."""

    __slots__ = ("inside", "links", "path", "text")

    def __init__(self, path: str, text: str, links: int, inside: bool):
        self.path, self.text, self.links, self.inside = path, text, links, inside


def blocks(html: str) -> list[Block]:
    """The page's text fields in order, but for those that markup says are no part of its article.

    Furniture by markup: nav, aside, footer and the like, what is hidden or has such a role, a header outside of articles,
    an article inside an article (a reader's comment) and a form, unless it holds the page's heading or most of its text.
    Names say nothing of an element that holds the page's heading, or all of its articles and half of its text.
    """
    stack: list[_Element] = []
    found: list[tuple[_Element | None, str, int, bool]] = []
    buffer: list[str] = []
    unsure: list[_Element] = []
    main = in_link = links = articles = 0
    muted, depth = "", 0

    def flush() -> None:
        nonlocal links
        if buffer:
            text = "".join(buffer)
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            buffer.clear()
            if text:
                here = stack[-1] if stack else None
                found.append((here, text, min(links, len(text)), main > 0))
                if here is not None:
                    here.chars += len(text)
        links = 0

    def pop_to(k: int) -> None:
        nonlocal main
        while len(stack) > k:
            e = stack.pop()
            main -= e.tag in ("article", "main")
            if e.parent is not None:
                e.parent.chars += e.chars
                e.parent.articles += e.articles + (e.tag == "article")
                e.parent.heads += e.heads + (e.tag in ("main", "h1"))

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at and not muted:
            text = html[at : m.start()]
            buffer.append(text)
            if in_link and not text.isspace():
                links += len(text)
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                buffer.append(" ")
            continue
        tag, attrs = tag.lower(), m[4]
        if tag in _INLINE or tag in _VOID:
            if tag == "a":
                in_link = 0 if m[2] else 1
            if tag in _SPACE:
                buffer.append(" ")
            if muted:  # inside inline furniture, until its end
                depth += (tag == muted) * (-1 if m[2] else 1)
                muted = muted if depth else ""
            elif attrs and not m[2] and tag not in _VOID and tag != "a" and any(_reads(tag, attrs)):
                muted, depth = tag, 1
            continue
        muted = ""
        if m[2]:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
            continue
        flush()
        if stack and (stack[-1].tag == "p" or stack[-1].tag in _HEADINGS):
            pop_to(len(stack) - 1)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            for k in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[k].tag in ("ul", "ol", "dl", "table"):
                    break
                if stack[k].tag == tag:
                    pop_to(k)
                    break
        if tag in ("article", "main"):
            for k in range(len(stack)):
                if stack[k].tag in ("nav", "header"):  # left open
                    pop_to(k)
                    break
        articles += tag == "article"
        parent = stack[-1] if stack else None
        hard, named = _reads(tag, attrs)
        hard |= tag in _DROP or (tag == "header" and not main) or (tag == "article" and parent is not None and parent.article)
        if tag == "hr" or (attrs.endswith("/") and tag not in _SHORT):
            continue
        if tag in ("article", "main"):
            main += 1
        stack.append(_Element(tag, _label(tag, attrs), parent, hard, named))
        if named or tag == "form":
            unsure.append(stack[-1])
    if not muted and not html[at:].lstrip().startswith("<"):
        buffer.append(html[at:])
    flush()
    pop_to(0)
    whole = sum(len(x[1]) for x in found)
    for e in unsure:
        holds = e.heads > 0 or (articles > 0 and e.articles == articles and 2 * e.chars >= whole)
        e.named &= not holds
        e.hard |= e.tag == "form" and not holds and 2 * e.chars < whole
    paths: dict[int, str | None] = {}  # None: furniture

    def path_of(e: _Element | None) -> str | None:
        trail = []
        while e is not None and id(e) not in paths:
            trail.append(e)
            e = e.parent
        path = paths[id(e)] if e is not None else ""
        for e in reversed(trail):
            if path is not None and len(path) > LONG:
                path = "!" * (">!" in path or path[0] == "!") + _digest(path)
            path = None if path is None or e.hard else f"{path}>{'!' * e.named}{e.label}".lstrip(">")
            paths[id(e)] = path
        return path

    return [Block(path, text, n, inside) for e, text, n, inside in found if (path := path_of(e)) is not None]


# --- expressions: items [key, text digest or None for a slot, pages that have it, characters, characters in links]. A key
# is a field's path, "@" before those inside an article; a repeated group's key is "(k1 k2 ...)+", its fields' keys joined
# by a control character.

_SEP = "\x1f"


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def key_of(b: Block) -> str:
    return "@" * b.inside + re.sub(r"[()+\s\x1f]", "_", b.path)


def unit_of(key: str) -> tuple[str, ...]:
    """A group's fields, or the field itself. Fields that repeat inside a group of several end in +."""
    return tuple(key[1:-2].split(_SEP)) if key.endswith(")+") else (key,)


def group_key(unit) -> str:
    return f"({_SEP.join(unit)})+"


def _field(key: str) -> str | None:
    """The field of a plain or repeated one; none for a group of several."""
    unit = unit_of(key)
    return unit[0] if len(unit) == 1 else None


def fold(keys: list[str], longest: int = 6) -> list[tuple[str, int, int]]:
    """(key, first, last + 1) of the stream with tandem repeats of up to longest fields as groups, shortest groups first.
    Repeated fields may repeat inside a group of several."""
    out = [(k, i, i + 1) for i, k in enumerate(keys)]
    for n in range(1, longest + 1):
        tokens, out, i = out, [], 0
        bare = [_field(t[0]) for t in tokens]
        while i < len(tokens):
            unit = bare[i : i + n]
            j = i + n
            if len(unit) == n and None not in unit:
                while bare[j : j + n] == unit:
                    j += n
            if j > i + n and not (n > 1 and len(set(unit)) == 1):
                again = [any(t[0].endswith(")+") for t in tokens[i + k : j : n]) for k in range(n)]
                out.append((group_key(k + "+" * (x and n > 1) for k, x in zip(unit, again)), tokens[i][1], tokens[j - 1][2]))
                i = j
            else:
                out.append(tokens[i])
                i += 1
    return out


def units_in(keys) -> set[tuple[str, ...]]:
    """The groups among keys; of those that differ in inner repeats only, the one with all of them."""
    found: dict[tuple[str, ...], list[bool]] = {}
    for key in keys:
        if key.endswith(")+"):
            unit = unit_of(key)
            marks = found.setdefault(tuple(k.rstrip("+") for k in unit), [False] * len(unit))
            for i, k in enumerate(unit):
                marks[i] |= k.endswith("+")
    return {tuple(k + "+" * m for k, m in zip(unit, marks)) for unit, marks in found.items()}


def absorb(keys: list[str], units: set[tuple[str, ...]], always: list[bool] | None = None) -> list[tuple[str, int, int]]:
    """(key, first, last + 1): runs of a group's fields, be it once, are the group, so that a single one meets a repeated one.
    Fields that aren't always there are no part of a group of several, as that would need them all."""
    out, i = [], 0
    ordered = [(u, [k.rstrip("+") for k in u]) for u in sorted(units, key=lambda u: (-len(u), u))]
    bare = [_field(k) for k in keys]
    several = {k: [x.rstrip("+") for x in unit_of(k)] for k in set(keys) if _field(k) is None}
    while i < len(keys):
        for u, fields in ordered:
            j, n = i, len(u)
            while True:
                if bare[j : j + n] == fields and (n == 1 or always is None or all(always[j : j + n])) and all(n == 1 or x.endswith("+") or not keys[j + k].endswith(")+") for k, x in enumerate(u)):
                    j += n
                elif j < len(keys) and several.get(keys[j]) == fields:
                    j += 1
                else:
                    break
            if j > i:
                out.append((group_key(u), i, j))
                i = j
                break
        else:
            out.append((keys[i], i, i + 1))
            i += 1
    return out


def joined(items: list[list], key: str) -> list:
    """Items that a group absorbs, as one."""
    if len(items) == 1:
        return [key, items[0][1] if items[0][0] == key else None, *items[0][2:]]
    return [key, None, max(x[2] for x in items), sum(x[3] for x in items), sum(x[4] for x in items)]


def align(a: list[list], b: list[list], pages: tuple[int, int]) -> list[list]:
    """The union-free expression of both, which are of so many pages: common items counted, differing texts slots, the rest
    optional, groups repeated."""
    both = lambda x, y: [x[0], x[1] if x[1] == y[1] else None, x[2] + y[2], x[3] + y[3], x[4] + y[4]]
    if [x[0] for x in a] == [x[0] for x in b]:
        return [both(x, y) for x, y in zip(a, b)]
    units = units_in(x[0] for x in (*a, *b))
    if units:
        a, b = ([joined(x[i:j], key) for key, i, j in absorb([y[0] for y in x], units, [y[2] == n for y in x])] for x, n in zip((a, b), pages))
    keys = [x[0] for x in a], [x[0] for x in b]
    out: list[list] = []
    for op, i, j, k, n in difflib.SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
        if op == "equal":
            out += [both(x, y) for x, y in zip(a[i:j], b[k:n])]
        else:
            out += [list(x) for x in a[i:j]] + [list(x) for x in b[k:n]]
    return out


def page_items(found: list[Block]) -> list[list]:
    """A page's stream as an expression of its own."""
    items = []
    for key, i, j in fold([key_of(b) for b in found]):
        some = found[i:j]
        items.append([key, _digest(some[0].text) if not key.endswith(")+") else None, 1, sum(len(b.text) for b in some), sum(b.links for b in some)])
    return items


def infer(classes: list[tuple[int, list[list]]]) -> list[list]:
    """The expression of classes (pages, items) of pages with equal streams, from the commonest on; their order is settled
    by their content, so the result doesn't depend on how the pages were dealt out."""
    out: list[list] | None = None
    pages = 0
    for n, items in sorted(classes, key=lambda c: (-c[0], [x[0] for x in c[1]])):
        out = items if out is None else align(out, items, (pages, n))
        pages += n
    return out or []


def best_match(keys: list[str], counts: list[int], units: list[tuple[str, ...]], groups: list[bool], support: list[int]) -> list[int]:
    """For each run of equal fields the item that it is matched to, in order, or -1: the most runs, then the most support.

    Dynamic programming over the items. A field matches a run of one, a repeated field any run, a group of several its
    fields' runs, any number of times.
    """
    n = len(keys)
    places: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        places.setdefault(k, []).append(i)
    best, backs = [0] * (n + 1), []
    for unit, group, weight in zip(units, groups, support):
        fields = [k.rstrip("+") for k in unit]
        many = [k.endswith("+") or (group and len(unit) == 1) for k in unit]
        m, value = len(unit), (1 << 40) + weight
        back: dict[int, tuple[int, bool]] = {}  # end of a match: its start, and whether the group goes on before it
        inside: dict[int, int] = {}
        for i in places.get(fields[0], ()):
            if keys[i : i + m] == fields and all(x or counts[i + k] == 1 for k, x in enumerate(many)):
                on = inside.get(i, -1) > best[i]
                got = (inside[i] if on else best[i]) + value * m
                if m == 1 or got > inside.get(i + m, -1):
                    inside[i + m] = got
                    back[i + m] = i, on and m > 1
                    if m == 1 and on:  # a single field takes one run
                        inside[i + m] = best[i] + value
        now = list(best)
        won = set()
        for i in range(1, n + 1):
            if inside.get(i, -1) > now[i]:
                now[i] = inside[i]
                won.add(i)
            if now[i - 1] > now[i]:
                now[i] = now[i - 1]
                won.discard(i)
        backs.append((back, won, best, now))
        best = now
    out, i = [-1] * n, n
    for t in range(len(units) - 1, -1, -1):
        back, won, before, now = backs[t]
        while i and now[i] == now[i - 1] and now[i] > before[i]:  # a run that nothing takes
            i -= 1
        if i in won and now[i] > before[i]:
            on = True
            while on:
                start, on = back[i]
                out[start:i] = [t] * (i - start)
                i = start
    return out


def named_part(key: str) -> str:
    """The path down to the first element that is named as furniture, or nothing."""
    path = unit_of(key)[0].rstrip("+").removeprefix("@").split(">")
    return next((">".join(path[: k + 1]) for k, label in enumerate(path) if label.startswith("!")), "")


def last_tag(key: str) -> str:
    return key.rstrip("+").removeprefix("@").rpartition(">")[2].lstrip("!").partition(".")[0]


class Expression:
    """What extraction needs of a host's wrapper."""

    def __init__(self, text: str | None):
        self.pages, items = json.loads(text) if text else (0, [])
        self.shape = [unit_of(x[0]) for x in items], [x[0].endswith(")+") for x in items], [x[2] for x in items]
        total = sum(x[3] for x in items)
        constant = [x[1] is not None and x[2] >= max(PAGES, SHARE * self.pages) for x in items]
        if 2 * sum(x[3] for x, c in zip(items, constant) if c) > total:  # near copies: the pages' own text, no template
            constant = [False] * len(items)
        self.constant = [x[1] if c and not (x[0].startswith("@") and last_tag(x[0]) in _HEADINGS) else None for x, c in zip(items, constant)]
        parts = [named_part(x[0]) for x in items]
        held: dict[str, int] = {}
        for part, x in zip(parts, items):
            held[part] = held.get(part, 0) + x[3]
        other = any(not part and any(last_tag(k) in ("p", *_HEADINGS) for k in unit_of(x[0])) for part, x in zip(parts, items))
        self.furniture = [bool(part) and (other or held[part] < MOST * total) for part in parts]
        self.menu = [x[4] >= LINKS * x[3] and all(last_tag(k) != "p" for k in unit_of(x[0])) for x in items]
        self.seen: dict[tuple, list] = {}

    def places(self, keys: tuple[str, ...]) -> list[tuple[int, int, int]]:
        """(item or -1, first, last + 1) of a page's fields: the match of most fields, then of the commonest items."""
        got = self.seen.get(keys)
        if got is None:
            ends = [i for i in range(1, len(keys) + 1) if i == len(keys) or keys[i] != keys[i - 1]]
            starts = [0, *ends[:-1]]
            at = best_match([keys[i] for i in starts], [j - i for i, j in zip(starts, ends)], *self.shape) if keys else []
            got = list(zip(at, starts, ends))
            if len(self.seen) > 2000:
                self.seen.clear()
            self.seen[keys] = got
        return got

    def text_of(self, found: list[Block]) -> str:
        """The page's content: of articles where there is one, else of the whole page."""
        keys = tuple(key_of(b) for b in found)
        kept: list[tuple[bool, str]] = []
        for item, i, j in self.places(keys):
            for b in found[i:j]:
                if item >= 0:
                    if self.furniture[item] or (self.constant[item] is not None and self.constant[item] == _digest(b.text)):
                        continue
                    if self.menu[item] and not b.inside:
                        continue
                kept.append((b.inside, b.text))
        inside = any(x for x, _ in kept)
        return "\n".join(text for x, text in kept if x or not inside)


def main_text(html: str | None, wrapper: Expression | None = None) -> str:
    """A page's content by its host's wrapper; without one, by its own."""
    found = blocks(html or "")
    return (wrapper or Expression(json.dumps([1, page_items(found)]))).text_of(found)


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and template (JSON) of every host, inferred from all its distinct pages, however they are dealt out.

    Every page becomes a row of a few hundred bytes; equal pages of a host become one, then pages of equal streams one a
    task and one a slice (a class: texts that differ are slots). Classes align in SLICES slices by their streams' hash,
    whose expressions then align per host. So a task holds a slice's classes at most, never a host's pages.
    """

    def streams(batches):
        seen = set()
        for batch in batches:
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mark = hashlib.blake2b((page or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if (host, mark) not in seen:
                    seen.add((host, mark))
                    items = page_items(blocks(page or ""))
                    shape = int.from_bytes(hashlib.blake2b("\n".join(x[0] for x in items).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                    rows.append((host, mark, shape, json.dumps(items)))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.int64(), pa.string()))], ["host", "page", "shape", "items"])

    def gather(held: dict, host, shape, pages, items) -> None:
        old = held.get((host, shape))
        held[host, shape] = (pages, items) if old is None else (old[0] + pages, align(old[1], items, (old[0], pages)))

    def part(batches):
        held: dict = {}
        for batch in batches:
            for host, shape, items in zip(*(batch.column(k).to_pylist() for k in ("host", "shape", "items"))):
                gather(held, host, shape, 1, json.loads(items))
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[1] % SLICES for k in keys], pa.int32()), pa.array([json.dumps(held[k]) for k in keys], pa.string())], ["host", "shape", "slice", "state"])

    def merge(key, t):
        held: dict = {}
        for shape, state in zip(t["shape"].to_pylist(), t["state"].to_pylist()):
            gather(held, key[0].as_py(), shape, *json.loads(state))
        state = [sum(n for n, _ in held.values()), infer(list(held.values()))]
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "state": pa.array([json.dumps(state)], pa.string())})

    def finish(key, t):
        states = [json.loads(x) for x in t["state"].to_pylist()]
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "template": pa.array([json.dumps([sum(n for n, _ in states), infer(states)])], pa.string())})

    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html")).mapInArrow(streams, "host string, page binary, shape bigint, items string")
    parts = rows.dropDuplicates(["host", "page"]).select("host", "shape", "items").mapInArrow(part, "host string, shape bigint, slice int, state string")
    return parts.groupBy("host", "slice").applyInArrow(merge, "host string, state string").groupBy("host").applyInArrow(finish, "host string, template string")


def _fresh(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def extract(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of each page in column out (replaced if there).

    Null or empty html: empty text. A null url belongs to host "". Whole pages are read, repeated rows are answered
    each and count as one page of their host, other columns pass through whatever their names. White space inside a block
    is one space, blocks join by a line end. An empty table gives an empty one. One small row per host is written to the
    shared folder; these are broadcast while their size allows it, else joined by host.
    """
    host, template = _fresh("wrapper_host", pages.columns), _fresh("wrapper_template", pages.columns)
    w = written(wrappers(pages, url, html).select(F.col("host").alias(host), F.col("template").alias(template)), "wrappers")
    size = w.agg(F.sum(F.length(template) + F.length(host)).alias("n")).first()["n"] or 0
    known: dict[str, Expression] = {}

    def text(htmls: pa.Array, templates: pa.Array) -> pa.Array:
        got = []
        for h, t in zip(htmls.to_pylist(), templates.to_pylist()):
            if t not in known:
                if len(known) > 500:
                    known.clear()
                known[t] = Expression(t)
            got.append(main_text(h, known[t]))
        return pa.array(got, pa.string())

    by_host = pages.withColumn(host, host_of(F.col(url))).join(F.broadcast(w) if size <= BROADCAST else w.hint("merge"), host, "left")
    return by_host.withColumn(out, arrow_udf(text, "string")(F.col(html).cast("string"), F.col(template))).drop(host, template)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
