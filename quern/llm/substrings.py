"""Exact removal of repeated 50-byte strings: anchors find candidates, suffix arrays decide.

1. Every 50-byte window has one anchor: the leftmost of its 24-byte grams with the least hash. Equal windows have equal
   anchors, so windows need only be compared where anchors are equal. The windows of an anchor, taken together, are its
   context, a string of 50 to 76 bytes. A chunk of documents sends each distinct context once, for its least document.
2. Anchors are dealt out by hash, as packed arrays. An anchor whose whole context also stands in an earlier document is
   settled at once. Of the others those go on that share a node with another document: a node [a, b] is the set of windows
   that have a to b bytes before their gram. These all hold a bytes before it and 26 - b after it, its core; windows are
   equal only if their nodes' cores are.
3. The contexts of a core are sorted by a suffix array built by linear grouping (Baier, 2016). Neighbours in it that share
   50 bytes form a class, and the class's least document settles its windows. A core with more contexts than one task
   should sort is split by content: into the nodes of the halves of [a, b], whose cores are longer, down to single windows.
4. Removed windows meet the texts by document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import scratch, table, written
from .quality import _BYTE, _mix, _powers, string_slices

LENGTH, GRAM = 50, 24
REST = LENGTH - GRAM  # bytes of a window beside its gram
SPAN = REST + 1  # grams in a window, windows in a context
#: The first nodes: windows with LEFT bytes or more before their gram, and the others, with RIGHT or more after it.
LEFT, RIGHT = SPAN // 2, REST - SPAN // 2 + 1
SLICE = 1 << 18
#: Bytes of text whose equal contexts are sent once.
CHUNK = 8 << 20
#: Contexts of one core that one task sorts; those of a core that has more are split by content.
GROUP = 2000
#: Symbols that one suffix array covers, unless a single core has more.
BLOCK = 1 << 16
_U = np.uint64
_UNKNOWN = -2


def linear_grouping(text) -> list[int]:
    """The suffix array of a string of small integers, by Baier's linear grouping construction.

    Phase 1 sorts suffixes into groups by their longest Lyndon prefix. Groups are processed in descending order; each
    suffix finds its previous smaller one (the last before it in a lower group) by following such pointers, and the
    suffixes pointed to are split off to the upper end of their groups, those pointed to more often above the others.
    Phase 2 fills the groups in ascending order: whoever is emitted lets the chain of previous smaller suffixes before
    it take the next places in their groups. Nothing is renamed or sorted recursively.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    buckets: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        buckets.setdefault(c, []).append(i)
    sa: list[int] = []
    group, size = [0] * n, [0] * (n + 1)  # first place of a suffix's group; members by first place
    for c in sorted(buckets):
        at = len(sa)
        for i in buckets[c]:
            group[i] = at
        size[at] = len(buckets[c])
        sa += buckets[c]
    place = [0] * n
    for k, i in enumerate(sa):
        place[i] = k
    prev = [_UNKNOWN] * n
    end = n - 1
    while end >= 0:
        first = group[sa[end]]
        times: dict[int, int] = {}
        members = sa[first : end + 1]
        for s in members:
            if prev[s] != _UNKNOWN:
                continue
            p = s - 1
            trail = [s]  # members of this group that s passes on its way have the same previous smaller suffix
            while p >= 0 and group[p] >= first:
                if prev[p] == _UNKNOWN:
                    trail.append(p)
                    p -= 1
                else:
                    p = prev[p]
            for t in trail:
                prev[t] = p
        for s in members:
            p = prev[s]
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            most = max(times.values())
            if most == 1:
                rounds = [list(times)]
            else:
                rounds = [[] for _ in range(most)]
                for p, k in times.items():
                    rounds[most - k].append(p)
            for pointed in rounds:
                split: dict[int, int] = {}
                for p in pointed:
                    g = group[p]
                    gone = split.get(g, 0) + 1
                    split[g] = gone
                    to, at = g + size[g] - gone, place[p]
                    other = sa[to]
                    sa[to], sa[at] = p, other
                    place[p], place[other] = to, at
                for g, gone in split.items():
                    size[g] -= gone
                    new = g + size[g]
                    if gone and size[g]:
                        size[new] = gone
                        for k in range(new, new + gone):
                            group[sa[k]] = new
                    else:
                        size[g] = gone
        end = first - 1
    # phase 2
    out, taken, done = [0] * n, [0] * n, [False] * n

    def emit(s: int) -> None:
        while s >= 0 and not done[s]:
            g = group[s]
            out[g + taken[g]] = s
            taken[g] += 1
            done[s] = True
            s = prev[s]

    emit(n - 1)
    for k in range(n):
        s = out[k]
        if s > 0:
            emit(s - 1)
    return out


#: An anchor: hashes of its gram, its context and the cores of the first two nodes; document, first byte, windows after
#: the first, and the gram's place in the context.
FIELDS = (("gram", "<u8"), ("context", "<u8"), ("left", "<u4"), ("right", "<u4"), ("doc", "<i8"), ("at", "<u4"), ("more", "u1"), ("inner", "u1"))
GONE = FIELDS[4:7]


def packed(rows: dict[str, np.ndarray], fields=FIELDS) -> bytes:
    """Column by column, which compresses better than row by row."""
    return b"".join(rows[k].astype(t, copy=False).tobytes() for k, t in fields)


def unpacked(blobs, fields=FIELDS) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in fields)
    parts: dict[str, list] = {k: [np.zeros(0, t)] for k, t in fields}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for k, t in fields:
            parts[k].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(v) for k, v in parts.items()}


def taken(rows: dict[str, np.ndarray], which) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in rows.items()}


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The anchors of the texts data[off[i]:off[i + 1]]: their texts, and their FIELDS but doc."""
    size = len(data)
    none = np.zeros(0, np.int64), {k: np.zeros(0, t) for k, t in FIELDS}
    if size < LENGTH:
        return none
    up, down = _powers(max(1 << 19, 1 << size.bit_length()))
    h = np.zeros(size + 1, _U)
    np.cumsum(_BYTE[data] * up[:size], out=h[1:])
    g = _mix((h[GRAM:] - h[:-GRAM]) * down[: size - GRAM + 1])
    # leftmost least gram of the windows by doubling: spans of 1, 2, 4, 8, 16, then two of 16 that cover SPAN
    low, at = g, np.arange(len(g), dtype=np.int32)
    for step in (1, 2, 4, 8, SPAN - 16):
        a, b = low[:-step], low[step:]
        right = b < a
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, b, a)
    n = len(low)  # windows
    ok = np.ones(n, bool)
    lengths = np.diff(off)
    for i in np.flatnonzero(lengths > 0):  # a window ends within its text
        a = off[i + 1] - LENGTH + 1
        ok[max(a, off[i]) : min(off[i + 1], n)] = False
    if not ok.any():
        return none
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    stop = np.flatnonzero(ok & np.append(new[1:] | ~ok[1:], True)) + LENGTH
    text = np.searchsorted(off, first, "right") - 1
    gram = at[first].astype(np.int64)

    def core(before: int, after: int) -> np.ndarray:
        """Hashes of cores; 0 where a context is too short for one."""
        a, z = gram - before, gram + GRAM + after
        there = (a >= first) & (z <= stop)
        a, z = np.where(there, a, 0), np.where(there, z, 0)
        return np.where(there, (_mix((h[z] - h[a]) * down[a]) >> _U(32)).astype(np.uint32), np.uint32(0))

    span = (stop - first).astype(_U)
    rows = {
        "gram": low[first], "context": _mix((h[stop] - h[first]) * down[first] + _mix(span + _U(77))),
        "left": core(LEFT, 0), "right": core(0, RIGHT), "at": first - off[text], "more": stop - first - LENGTH, "inner": gram - first,
    }
    return text, rows


def runs(rows: dict[str, np.ndarray], *keys: str) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which those of equal keys stand together, and where each run of them starts in it."""
    n = len(rows[keys[0]])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = np.zeros(n, _U)
    for k in keys:
        mixed = _mix(mixed * _U(0x9E3779B97F4A7C15) + rows[k].astype(_U))
    order = np.argsort(mixed)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        v = rows[k][order]
        new[1:] |= v[1:] != v[:-1]
    return order, np.flatnonzero(new)


def earlier_in(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Which anchors have their whole context in a smaller document of these."""
    order, start = runs(rows, "gram", "context")
    late = np.zeros(len(order), bool)
    if len(order):
        doc = rows["doc"][order]
        late[order] = doc > np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(doc))))
    return late


def crowds(rows: dict[str, np.ndarray], core: str, there: np.ndarray) -> np.ndarray:
    """Per anchor, how many distinct contexts have its core (core 0: none); 0 if they are all of one document."""
    out = np.zeros(len(there), np.int64)
    at = np.flatnonzero(there)
    if not len(at):
        return out
    rows = taken(rows, at)
    order, start = runs(rows, "gram", core)
    length = np.diff(np.append(start, len(order)))
    doc = rows["doc"][order]
    several = np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)
    out[at[order]] = np.repeat(np.where(several, length, 0), length)
    return out


def _part(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed anchors of every chunk of documents, one row for each bucket of gram hashes; and the anchors that a smaller
    document of the chunk settles, one row for each bucket of documents, which are numbered from buckets on."""

    def pack(batches):
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush():
            rows = {k: np.concatenate([r[k] for r in held]) for k, _ in FIELDS}
            late = earlier_in(rows)
            for part, key, base, fields in ((taken(rows, ~late), "gram", 0, FIELDS), (taken(rows, late), "doc", buckets, GONE)):
                b = (_mix(part[key].astype(_U)) % _U(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                part, b = taken(part, order), b[order]
                cut = np.flatnonzero(np.diff(b, prepend=-1))
                ends = np.append(cut, len(b))
                blobs = [packed(taken(part, slice(i, j)), fields) for i, j in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(b[cut] + base, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "rows"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, off in string_slices(batch.column(1), SLICE):
                text, rows = anchors(data, off)
                if len(text):
                    held.append({k: rows[k].astype(t, copy=False) if k != "doc" else ids[i:j][text] for k, t in FIELDS})
                size += len(data)
                if held and size >= CHUNK:
                    yield from flush()
                    held.clear()
                    size = 0
        if held:
            yield from flush()

    return docs.mapInArrow(pack, "bucket int, rows binary")


_SPANS = "doc bigint, gram bigint, at array<int>, more array<int>, settled boolean, inner int, on_left int, on_right int"


def settle(rows: dict[str, np.ndarray]):
    """(settled anchors; anchors to ask, with the number of contexts that their two cores have, 0 for an unshared one)."""
    order, start = runs(rows, "gram")
    length = np.diff(np.append(start, len(order)))
    doc = rows["doc"][order]
    if len(order):  # a gram that one document has alone has nothing to meet
        order = order[np.repeat(np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start), length)]
    rows = taken(rows, order)
    late = earlier_in(rows)
    left = taken(rows, ~late)
    # equal contexts of one document are one
    seen, begin = runs(left, "gram", "context")
    one = seen[begin]
    kind = np.zeros(len(seen), np.int64)
    kind[seen] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(seen))))
    distinct = taken(left, one)
    inner, after = distinct["inner"].astype(int), LENGTH - GRAM + distinct["more"].astype(int) - distinct["inner"]
    on = [crowds(distinct, core, there) for core, there in (("left", inner >= LEFT), ("right", after >= RIGHT))]
    on = [x[kind] for x in on]
    ask = (on[0] > 0) | (on[1] > 0)
    return taken(rows, late), taken(left, ask), [x[ask] for x in on]


def _lists(rows: dict[str, np.ndarray], off: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(rows[k].astype(np.int32))) for k in ("at", "more")]


def _settled(rows: dict[str, np.ndarray]) -> pa.Table:
    """Settled anchors as rows of _SPANS, one a document."""
    rows = taken(rows, np.lexsort((rows["at"], rows["doc"])))
    cut = np.flatnonzero(np.append(True, rows["doc"][1:] != rows["doc"][:-1])) if len(rows["doc"]) else np.zeros(0, np.int64)
    n = len(cut)
    none = [pa.nulls(n, pa.int32())] * 3
    return pa.table([pa.array(rows["doc"][cut]), pa.nulls(n, pa.int64()), *_lists(rows, np.append(cut, len(rows["doc"]))), pa.array(np.ones(n, bool)), *none], names=[x.split()[0] for x in _SPANS.split(", ")])


def _asked(rows: dict[str, np.ndarray], on: list[np.ndarray]) -> pa.Table:
    n = len(rows["doc"])
    counts = [pa.array(np.minimum(x, 1 << 30).astype(np.int32)) for x in on]
    return pa.table([pa.array(rows["doc"]), pa.array(np.ascontiguousarray(rows["gram"]).view("<i8")), *_lists(rows, np.arange(n + 1)), pa.array(np.zeros(n, bool)), pa.array(rows["inner"].astype(np.int32)), *counts], names=[x.split()[0] for x in _SPANS.split(", ")])


def halves(a: int, b: int) -> list[tuple[int, int]]:
    m = (a + b) // 2
    return [(a, m), (m + 1, b)]


def node_of(text: bytes, gram: int, a: int, b: int) -> tuple[int, int, int] | None:
    """Where node [a, b] of a context lies in it, and the bytes before the core there; none if it has no such window."""
    start, stop = max(0, gram - b), min(len(text), gram + GRAM + REST - a)
    pre = gram - a - start
    if pre < 0 or stop < gram + GRAM + REST - b:
        return None
    return start, stop, pre


def classes(contexts: list[bytes], pre: list[int], cores: list[int]) -> list[list[tuple[int, int]]]:
    """Windows (context, start) that hold equal 50-byte strings, by a suffix array over all contexts. Only classes of
    windows of two contexts or more.

    Every window of a context holds its core, cores[k] bytes from pre[k] on, whole. So equal cores are one symbol of the
    sorted string, and windows are equal if their bytes before and after it are.
    """
    out: list[list[tuple[int, int]]] = []
    joined: list[int] = []
    of: list[int] = []
    base: list[int] = []
    symbol: dict[bytes, int] = {}
    for k, (c, i, n) in enumerate(zip(contexts, pre, cores)):
        base.append(len(joined))
        joined += [x + 1 for x in c[:i]]
        joined.append(symbol.setdefault(c[i : i + n], 257 + len(symbol)))
        joined += [x + 1 for x in c[i + n :]]
        joined.append(0)
        of += [k] * (len(joined) - base[-1])
    last = None
    for s in linear_grouping(joined):
        k = of[s]
        start = s - base[k]
        c = contexts[k]
        if start > pre[k] or start + LENGTH > len(c):
            continue
        window = c[start : start + LENGTH]
        if window == last:
            out[-1].append((k, start))
        else:
            out.append([(k, start)])
            last = window
    return [c for c in out if len(c) > 1]


_CONTEXT = "key bigint, doc bigint, a int, b int, pre int, at array<int>, text binary"
_NAMES = [x.split()[0] for x in _CONTEXT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary()]


def key_of(core: bytes, a: int, b: int) -> int:
    return xxhash.xxh64_intdigest(core, a * SPAN + b) - (1 << 63)


def split_nodes(text: bytes, gram: int, nodes: list[tuple[int, int]]):
    """(key, a, b, pre, first byte, bytes) of a context's nodes."""
    for a, b in nodes:
        if found := node_of(text, gram, a, b):
            start, stop, pre = found
            part = text[start:stop]
            yield key_of(part[pre : pre + LENGTH - b + a], a, b), a, b, pre, start, part


def _batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], _NAMES)


def sort_cores(batches):
    """Of rows of _CONTEXT that are sorted by key: windows that a smaller document has, as rows with their places in at."""
    block: list[list[tuple]] = []  # whole groups
    out: list[tuple] = []
    size = 0

    def run() -> None:
        rows = [r for g in block for r in g]
        block.clear()
        late: dict[int, list[int]] = {}
        for c in classes([r[6] for r in rows], [r[4] for r in rows], [LENGTH - r[3] + r[2] for r in rows]):
            least = min(rows[k][1] for k, _ in c)
            for k, start in c:
                if rows[k][1] > least:
                    late.setdefault(k, []).append(start)
        out.extend((None, rows[k][1], None, None, None, [x + s for s in starts for x in rows[k][5]], None) for k, starts in late.items())

    group: list[tuple] = []

    def close() -> None:
        nonlocal size
        if len(group) > 1:
            block.append(list(group))
            size += sum(len(r[6]) + 1 for r in group)
            if size >= BLOCK:
                run()
                size = 0
        group.clear()

    for batch in batches:
        for r in zip(*(batch.column(n).to_pylist() for n in _NAMES)):
            if group and r[0] != group[0][0]:
                close()
            group.append(r)
            if len(out) >= 5000:
                yield _batch(out)
                out.clear()
    close()
    run()
    yield _batch(out)


def split_cores(batches):
    """Rows of _CONTEXT as those of the halves of their nodes."""
    for batch in batches:
        out = []
        for _, doc, a, b, pre, at, text in zip(*(batch.column(n).to_pylist() for n in _NAMES)):
            for key, c, d, p, start, part in split_nodes(text, pre + a, halves(a, b)):
                out.append((key, doc, c, d, p, [x + start for x in at], part))
        yield _batch(out)


def removed_windows(docs: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (doc, at, more): runs of more + 1 windows from byte at on that an earlier document has. docs: doc, text."""
    spark = docs.sparkSession
    most = GROUP if most is None else most
    buckets = max(8, 4 * docs.rdd.getNumPartitions())

    def first_round(key, t):
        blobs = [x.as_buffer() for x in t.column("rows")]
        if key[0].as_py() >= buckets:
            return _settled(unpacked(blobs, GONE))
        late, ask, on = settle(unpacked(blobs))
        return pa.concat_tables([_settled(late), _asked(ask, on)])

    found = written(_part(docs, buckets).groupBy("bucket").applyInArrow(first_round, _SPANS), "anchors")
    settled = found.where("settled").select("doc", "at", "more")

    # the contexts of the others, cut out of their documents' texts: nodes whose cores are shared, halves of crowded ones
    asked = found.where("NOT settled").select("doc", F.col("at")[0].alias("at"), F.col("more")[0].alias("more"), "inner", "on_left", "on_right")
    asked = asked.groupBy("doc").agg(F.collect_list(F.struct("at", "more", "inner", "on_left", "on_right")).alias("asked"))

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, t, wanted in zip(*(batch.column(n).to_pylist() for n in ("doc", "text", "asked"))):
                data, own = t.encode(), {}
                for w in wanted:
                    text = data[w["at"] : w["at"] + w["more"] + LENGTH]
                    nodes = [x for n, ends in ((w["on_left"], (LEFT, REST)), (w["on_right"], (0, LEFT - 1))) if n for x in ([ends] if n <= most else halves(*ends))]
                    for key, a, b, pre, start, part in split_nodes(text, w["inner"], nodes):
                        own.setdefault((key, a, b, pre, part), []).append(w["at"] + start)
                rows += [(key, doc, a, b, pre, at, part) for (key, a, b, pre, part), at in own.items()]
                if len(rows) >= 5000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    contexts = written(docs.join(asked.hint("shuffle_hash"), "doc").select("doc", "text", "asked").mapInArrow(cut, _CONTEXT), "contexts")
    n = max(8, spark.sparkContext.defaultParallelism, buckets // 4)
    late = []
    while True:
        wide, single = contexts.where("a < b"), contexts.where("a = b")
        if single.limit(1).count():  # a node of one window: equal cores are equal windows
            first = written(single.groupBy("text").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("text", "first"), "first")
            late.append(single.join(first.hint("merge"), "text").where("doc > first").select("doc", "at"))
        # crowded cores never meet in a task: their rows are split where they are
        crowded = written(wide.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"), "crowded")
        more = crowded.limit(1).count() > 0
        few = wide.join(crowded.hint("merge"), "key", "left_anti").select(*_NAMES) if more else wide
        late.append(written(few.repartition(n, "key").sortWithinPartitions("key").mapInArrow(sort_cores, _CONTEXT).select("doc", "at"), "late"))
        if not more:
            break
        contexts = written(wide.join(crowded.hint("merge"), "key", "left_semi").select(*_NAMES).mapInArrow(split_cores, _CONTEXT), "contexts")
    for x in late:
        settled = settled.unionAll(x.select("doc", "at", F.transform("at", lambda _: F.lit(0)).alias("more")))
    return settled


def spans_of(n: int, at: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that windows from at to at + more cover."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.bincount(at, minlength=n + 1) - np.bincount(at + more + LENGTH, minlength=n + 1)
    covered = np.concatenate(([False], np.cumsum(step)[:n] > 0, [False]))
    edge = np.flatnonzero(covered[1:] != covered[:-1])
    return edge[::2], edge[1::2]


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256, spans (starts and ends of removed runs, in bytes).

    A null text is empty; texts of under 50 bytes keep every byte. Integer ids order documents; rows with a null id
    neither remove from others nor lose anything. Rows that repeat an id are one document's: they keep what no smaller
    id has. Texts are read whole. An empty table gives an empty result. Only id_col and text are read.
    """
    all_ = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    named = all_.where(F.col("doc").isNotNull()).withColumn("doc", F.col("doc").cast("bigint"))
    with scratch() as keep:
        windows = keep(written(removed_windows(named), "removed")).groupBy("doc").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("more")).alias("more"))

    def finish(texts: pa.Array, at: pa.Array, more: pa.Array) -> pa.Array:
        rows = []
        for t, a, m in zip(texts.to_pylist(), at, more):
            data = t.encode()
            a, m = (np.array(x.as_py() or [], np.int64) for x in (a, m))
            inside = a + m + LENGTH <= len(data)  # rows that repeat an id may differ in text
            first, stop = spans_of(len(data), a[inside], m[inside])
            digest, k = hashlib.sha256(), 0
            for i, j in zip(first.tolist(), stop.tolist()):
                digest.update(data[k:i])
                k = j
            digest.update(data[k:])
            rows.append((len(data), int((stop - first).sum()), len(first), digest.hexdigest(), first.tolist(), stop.tolist()))
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])

    done = arrow_udf(finish, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string,starts:array<int>,ends:array<int>>")
    joined = named.join(windows.hint("shuffle_hash"), "doc", "left").unionByName(all_.where(F.col("doc").isNull()).withColumn("doc", F.col("doc").cast("bigint")), allowMissingColumns=True)
    kind = docs.schema[id_col].dataType
    return joined.select(F.col("doc").cast(kind).alias(id_col), done("text", "at", "more").alias("r")).select(id_col, "r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Windows as hexadecimal text, as DuckDB has no slices of bytes.
ORACLE = """
WITH b AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS hx, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
w AS (SELECT doc_id, unnest(range(n_bytes - 49)) AS p, hx FROM b WHERE n_bytes >= 50),
s AS (SELECT doc_id, p, substr(hx, 2 * p + 1, 100) AS w FROM w),
f AS (SELECT w, min(doc_id) AS first_doc FROM s GROUP BY w HAVING min(doc_id) < max(doc_id)),
c AS (SELECT s.doc_id, s.p, lag(s.p) OVER (PARTITION BY s.doc_id ORDER BY s.p) AS before, lead(s.p) OVER (PARTITION BY s.doc_id ORDER BY s.p) AS after
      FROM s JOIN f ON s.w = f.w WHERE f.first_doc < s.doc_id),
g AS (SELECT doc_id, CAST(sum(least(50, p - coalesce(before, p - 50))) AS BIGINT) AS n_removed,
             CAST(count(*) FILTER (before IS NULL OR p - before > 50) AS BIGINT) AS n_spans FROM c GROUP BY doc_id),
k AS (SELECT doc_id, p + 50 AS a, after AS z, p FROM c WHERE after IS NULL OR after - p > 50
      UNION ALL SELECT doc_id, 0, p, -1 FROM c WHERE before IS NULL),
r AS (SELECT k.doc_id, string_agg(substr(b.hx, 2 * k.a + 1, 2 * (coalesce(k.z, b.n_bytes) - k.a)), '' ORDER BY k.p) AS kept
      FROM k JOIN b ON b.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT b.doc_id, b.n_bytes, coalesce(g.n_removed, 0) AS n_removed, coalesce(g.n_spans, 0) AS n_spans, sha256(unhex(coalesce(r.kept, b.hx))) AS kept_sha256
FROM b LEFT JOIN g ON g.doc_id = b.doc_id LEFT JOIN r ON r.doc_id = b.doc_id
"""
