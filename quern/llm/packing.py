"""Best-fit packing of token sequences by bin completion over the histogram of piece lengths.

Only counts by length reach the driver (at most capacity numbers). It solves the packing on them and returns slots: a
run of equal pieces, by their rank among the pieces of their length, goes to a run of equal bins.
"""

from __future__ import annotations

import base64
import functools
import itertools
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import table, vocabulary, written

CAPACITY, END = 1024, 2
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Branch-and-bound nodes at most; the best solution so far stands after that. Best fit ends branches of up to FEW pieces.
NODES, FEW = 10_000, 64

Bins = list[tuple[tuple[int, ...], int]]  # (lengths in the bin, how many such bins)


@functools.lru_cache(2)
def _encoding(name: str, folder: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(vocabulary(name, folder), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces_of(ids: np.ndarray, capacity: int = CAPACITY):
    """(piece, start, length, crc32) of a document's ids; only a longer one is cut, its first piece may be shorter."""
    n, data = len(ids), ids.astype("<u4").tobytes()
    start = 0
    cut = n % capacity or capacity
    k = 0
    while start < n:
        stop = cut if k == 0 else start + capacity
        yield k, start, stop - start, zlib.crc32(data[4 * start : 4 * stop])
        start, k = stop, k + 1


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, vocab: str = VOCABULARY, folder: str = "") -> DataFrame:
    """Pieces of every document, with the task (part) that cut them and their rank there among pieces as long."""

    def cut(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encoding = _encoding(vocab, folder)
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encoding.encode_to_numpy(t, disallowed_special=()) if t else np.zeros(0, np.uint32), np.uint32(end))
                for k, start, n, crc in pieces_of(ids, capacity):
                    at.append(i)
                    rows.append((k, start, n, crc, part, seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    names = [id_col, "piece", "start", "length", "ids_crc32", "part", "rank"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text).cast("string")).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint")


def best_fit(counts: Sequence[int], capacity: int) -> Bins:
    """Best-fit decreasing on counts by length: the first incumbent."""
    open_: dict[int, list[list]] = {}  # by what is left: [lengths, how many]
    for n in range(min(capacity, len(counts) - 1), 0, -1):
        left = int(counts[n])
        while left:
            room = next((r for r in range(n, capacity + 1) if open_.get(r)), None)
            if room is None:
                each = capacity // n
                if left >= each:
                    bins = left // each
                    open_.setdefault(capacity - n * each, []).append([(n,) * each, bins])
                    left -= bins * each
                else:
                    open_.setdefault(capacity - n * left, []).append([(n,) * left, 1])
                    left = 0
                continue
            group = open_[room].pop()
            m = min(left, group[1])
            if group[1] > m:
                open_[room].append([group[0], group[1] - m])
            open_.setdefault(room - n, []).append([(*group[0], n), m])
            left -= m
    return [(tuple(g), m) for groups in open_.values() for g, m in groups]


def bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that counts by length need at least: Martello and Toth's L2, over all thresholds k. Lengths above capacity - k
    are alone; the other large ones share with lengths of k to half, whose tokens beyond that room need bins of their own."""
    n, tokens = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * np.arange(capacity + 1))))
    k = np.arange(1, capacity // 2 + 1)
    half = capacity // 2
    alone, large = n[-1] - n[capacity - k + 1], n[capacity - k + 1] - n[half + 1]
    room = large * capacity - (tokens[capacity - k + 1] - tokens[half + 1])
    rest = tokens[half + 1] - tokens[k]
    return int(max((alone + large + np.maximum(0, -(-(rest - room) // capacity))).max(initial=0), -(-int(tokens[-1]) // capacity)))


def fillings(room: int, counts: np.ndarray):
    """The undominated fillings of room by counts by length, lazily: least waste first, then fewest items, then longest.

    One filling dominates another if its items could hold the other's, part by part. So a filling is passed over if an item
    that is left fits into its waste, or could take the place of one to three of its items.
    """
    have = np.flatnonzero(counts[: room + 1] > 0)
    have = have[have > 0]
    if not len(have):
        yield ()
        return
    left = np.concatenate(([0], np.cumsum(counts)))  # items shorter than
    shortest, longest = int(have[0]), int(have[-1])
    reach = 1  # sums of items, if there were any number of each
    for n in have.tolist():
        part, step = reach, n
        while step <= room:
            part |= part << step
            step *= 2
        reach = part & ((1 << (room + 1)) - 1)
    own = counts.tolist()

    def sums(total: int, items: int, most: int, used: dict[int, int]):
        """Multisets of so many items of at most most that make total, longest first."""
        if items == 1:
            if shortest <= total <= most and own[total] > used.get(total, 0):
                yield (total,)
            return
        for n in range(min(most, total - (items - 1) * shortest), -(-total // items) - 1, -1):
            if own[n] > used.get(n, 0) and reach >> (total - n) & 1:
                used[n] = used.get(n, 0) + 1
                for rest in sums(total - n, items - 1, n, used):
                    yield (n, *rest)
                used[n] -= 1

    def dominated(way: tuple[int, ...], waste: int) -> bool:
        for size in (1, 2, 3):
            for part in {x for x in itertools.combinations(way, size)}:
                low = sum(part) + (size == 1)
                high = min(sum(part) + waste, len(own) - 1)
                if low <= high and int(left[high + 1] - left[low]) > sum(low <= x <= high for x in way):
                    return True
        return False

    for total in range(room, 0, -1):
        if not reach >> total & 1:
            continue
        if room - total >= shortest and int(left[room - total + 1]) > total // shortest:
            return  # whatever is chosen now, an item fits beside it
        for items in range(-(-total // longest), total // shortest + 1):
            for way in sums(total, items, longest, {}):
                waste = room - total
                if int(left[waste + 1]) > sum(x <= waste for x in way):
                    continue
                if not dominated(way, waste):
                    yield way


def _order(way: tuple[int, ...]):
    return -sum(way), len(way), tuple(-x for x in way)


def bin_completion(counts: Sequence[int], capacity: int = CAPACITY, nodes: int = NODES) -> Bins:
    """Fewest bins for counts by length: complete the bin of the largest length in each undominated way, and bound.

    Equal bins are made as often as the counts allow first, then once less, and so on, so a node stands for many bins; bins
    of one largest length are made in the order of their fillings, so none is made twice. A branch dies once its bins and
    the bound of what is left reach the incumbent, which best fit starts; best fit also ends branches of few pieces. The
    search is complete; after nodes nodes the best so far is returned. The result doesn't depend on the machine.
    """
    left = np.zeros(capacity + 1, np.int64)
    left[: len(counts)] = counts
    left[0] = 0
    best = best_fit(left, capacity)
    most = sum(m for _, m in best)
    least = bound(left, capacity)
    bins: Bins = []

    def ways(now: np.ndarray, after):
        """(filling with the largest length, how many bins), from the best on."""
        top = int(np.flatnonzero(now)[-1])
        rest = now.copy()
        rest[top] -= 1
        for way in fillings(capacity - top, rest):
            if after is not None and _order(way) <= after:
                continue
            items = (top, *way)
            need = np.bincount(items, minlength=capacity + 1)
            held = np.flatnonzero(need)
            for m in range(int((now[held] // need[held]).min()), 0, -1):
                yield items, need, m, _order(way)

    stack = [(left, 0, ways(left, None))] if left.any() and most > least else []
    while stack and nodes:
        now, used, following = stack[-1]
        choice = next(following, None)
        if choice is None:
            stack.pop()
            if bins:
                bins.pop()
            continue
        nodes -= 1
        items, need, m, order = choice
        rest = now - m * need
        if not rest.any():
            if used + m < most:
                best, most = [*bins, (items, m)], used + m
                if most <= least:
                    break
            continue
        if used + m + bound(rest, capacity) >= most:
            continue
        if int(rest.sum()) <= FEW:
            end = best_fit(rest, capacity)
            total = used + m + sum(x for _, x in end)
            if total < most:
                best, most = [*bins, (items, m), *end], total
                if most <= least:
                    break
        bins.append((items, m))
        stack.append((rest, used + m, ways(rest, order if rest[items[0]] else None)))
    return best


def slots(bins: Bins) -> dict[str, np.ndarray]:
    """For ranks from..to of a length: each bins' worth goes to the bins from sequence on, copies a bin, from offset on."""
    rows, rank, sequence = [], {}, 0
    for items, m in bins:
        offset = 0
        for n in sorted(set(items), reverse=True):
            copies = items.count(n)
            at = rank.get(n, 0)
            rows.append((n, at, sequence, copies, offset))
            rank[n] = at + copies * m
            offset += copies * n
        sequence += m
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "copies", "offset"), cols))


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, vocab: str = VOCABULARY, folder: str = "") -> DataFrame:
    """Packs every document into sequences of at most capacity tokens; a row a piece, with its sequence and offset.

    A null or empty text is its end token alone. Texts are tokenised whole. Repeated rows and ids are packed each on
    its own. An empty table gives an empty result. Only id_col and text are read, so other columns can't clash.
    """
    spark = docs.sparkSession
    p = written(pieces(docs, id_col, text, capacity, end, vocab, folder), "pieces")
    counted = p.groupBy("length", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    s = slots(bin_completion(counts, capacity))
    key = s["length"] * (1 << 48) + s["rank"]

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = (x.to_numpy(zero_copy_only=False) for x in (length, rank))
        k = np.searchsorted(key, n * (1 << 48) + r, "right") - 1
        q = r - s["rank"][k]
        return pa.StructArray.from_arrays([pa.array(s["sequence"][k] + q // s["copies"][k]), pa.array(s["offset"][k] + q % s["copies"][k] * n)], ["sequence_id", "offset"])

    where = arrow_udf(place, "struct<sequence_id:bigint,offset:bigint>")
    ranked = p.join(base, ["length", "part"]).withColumn("at", where("length", F.col("rank") + F.col("base")))
    return ranked.select(id_col, "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the kept documents as packed pieces. A null or empty text is its end token; rows that repeat
    an id, or have none, are packed each; an empty table gives no piece."""
    return pack(docs)
