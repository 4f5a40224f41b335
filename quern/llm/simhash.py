"""SimHash near-duplicates linked by the generalised pigeonhole principle (GPH).

64 bits fall into m groups of correlated bits. If two fingerprints differ in at most tau bits, then for any thresholds
T_1..T_m with sum tau - m + 1 there is a group i in which they differ in at most T_i bits (T_i = -1: never probed).
Each fingerprint gets the thresholds that dynamic programming finds cheapest on counts of the candidates. Where even
these are many (dense families of near copies), fingerprints meet at the points one bit away from them instead: two
that differ in at most two bits share such a point, and a point has at most 65 fingerprints around it. Both ways are
exact, and neither makes pairs that grow with the square of a group.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from .common import components, scratch, table, written
from .quality import SLICE, string_slices

SHINGLE, TAU, GROUPS, SEED = 3, 2, 3, 42
#: Up to this many candidates the plain thresholds (0, 0, 0) can't be beaten: any other choice probes more keys.
PLAIN = 20
#: Beyond this cost (probes and candidates) a fingerprint takes the way over the points around it.
MOST = 130
_CHUNK = 1 << 16


def shingle_hashes(text: str, k: int = SHINGLE) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    h = xxhash.xxh64_intdigest
    return [h(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[k - 1 :])]


def bit_counts(hashes: list[int]) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[i : i + _CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint_of(text: str | None, k: int = SHINGLE) -> int:
    hashes = shingle_hashes(text or "", k)
    bits = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", k: int = SHINGLE) -> DataFrame:
    """docs with a signed 64-bit fingerprint of the whole text. Null and wordless texts have fingerprint 0."""
    f = arrow_udf(lambda texts: pa.array([fingerprint_of(t, k) for i, j, _, _ in string_slices(texts, SLICE) for t in texts.slice(i, j - i).to_pylist()], pa.int64()), "bigint")
    return docs.withColumn(out, f(F.col(text).cast("string")))


def correlation(fps: DataFrame, fp: str = "fp") -> np.ndarray:
    """Absolute correlations of the 64 bits over all fingerprints; only 64 x 64 sums reach the driver."""

    def count(batches):
        total = np.zeros((65, 65), np.float64)
        for batch in batches:
            b = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            b = np.concatenate((b, np.ones((len(b), 1), np.float32)), 1)
            total += b.T @ b
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel().astype(np.int64))], ["i", "j", "n"])

    m = np.zeros((65, 65))
    for r in fps.select(fp).mapInArrow(count, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        m[r["i"], r["j"]] = r["n"]
    n = max(m[64, 64], 1)
    p = m[64, :64] / n
    cov = m[:64, :64] / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return np.abs(cov / np.outer(sd, sd))


def bit_groups(corr: np.ndarray, m: int = GROUPS) -> list[list[int]]:
    """m groups of nearly equal size: each starts with the most correlated free bit and takes the bits closest to it."""
    free, groups = set(range(64)), []
    for g in range(m):
        size = 64 // m + (g < 64 % m)
        first = max(sorted(free), key=lambda b: sum(corr[b, x] for x in free if x != b))
        group = [first]
        free.discard(first)
        while len(group) < size:
            b = max(sorted(free), key=lambda b: sum(corr[b, x] for x in group))
            group.append(b)
            free.discard(b)
        groups.append(sorted(group))
    return groups


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _cheapest(costs: list[dict[int, Column]], total: int) -> Column:
    """Dynamic programming over the groups: struct(cost, t) of the cheapest thresholds that sum to total."""
    state = {0: F.struct(F.lit(0).cast("bigint").alias("cost"), F.array().cast("array<int>").alias("t"))}
    for cost in costs:
        ways: dict[int, list[Column]] = {}
        for s, best in state.items():
            for t, c in cost.items():
                ways.setdefault(s + t, []).append(F.struct((best["cost"] + c).alias("cost"), F.concat(best["t"], F.array(F.lit(t))).alias("t")))
        state = {s: w[0] if len(w) == 1 else F.array_min(F.array(*w)) for s, w in ways.items()}
    return state[total]


def links(fps: DataFrame, tau: int = TAU, m: int = GROUPS, plain: int = PLAIN, most: int = MOST) -> DataFrame:
    """Pairs (a, b) whose classes are those of all pairs of fps.fp (distinct) that differ in at most tau bits, 1 or 2, by m
    groups, tau + 1 of them.

    Every emitted pair is verified to differ in at most two bits, at tau = 1 in one. At tau = 2, pairs inside dense families
    may be left out where others connect the same fingerprints, so the connected components are exact.
    """
    if tau not in (1, 2) or m != tau + 1:
        raise ValueError("the way over points one bit away needs tau = 1 or 2, and a group more")
    groups = bit_groups(correlation(fps), m)
    masks = [_signed(sum(1 << b for b in g)) for g in groups]
    index = written(fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(k)).alias("key")) for i, k in enumerate(masks)))).alias("s")).select("fp", "s.*"), "signatures")
    freq = written(index.groupBy("g", "key").agg(F.count("*").alias("n")).where("n > 1"), "frequencies")
    counted = index.join(freq.hint("merge"), ["g", "key"])
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= tau

    seen = written(counted.groupBy("fp").agg(F.sum(F.col("n") - 1).alias("c"), *(F.max(F.when(F.col("g") == i, F.col("n"))).alias(f"n{i}") for i in range(m))), "costs")
    cold = seen.where(F.col("c") <= plain).select("fp")
    small = counted.where(F.col("n") <= plain + 1).select("g", "key", "fp")
    probe = small.join(cold.hint("merge"), "fp")
    pairs = probe.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b").hint("merge"), ["g", "key"]).where("a <> b").where(near("a", "b")).select("a", "b")

    # the others: counts at one bit in each group, then the cheapest thresholds
    warm = seen.where(F.col("c") > plain).select("fp", *(F.coalesce(F.col(f"n{i}"), F.lit(1)).alias(f"n{i}") for i in range(m)))
    if warm.limit(1).count() == 0:
        return pairs
    flips = [F.array(F.lit(0).cast("bigint"), *(F.lit(_signed(1 << b)) for b in g)) for g in groups]
    around = F.element_at(F.array(*flips), F.col("g") + 1)
    keys = index.join(warm.select("fp").hint("merge"), "fp").select("g", "key").distinct()
    near1 = keys.withColumn("flip", F.explode(around)).select("g", F.col("key").alias("own"), F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    cn1 = near1.join(freq.hint("merge"), ["g", "key"], "left").groupBy("g", "own").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n1")).withColumnRenamed("own", "key")
    cn1 = written(cn1, "neighbours")  # so that the join below has an exchange on either side and can split a hot key
    costs = index.join(warm.select("fp").hint("merge"), "fp").join(cn1.hint("merge"), ["g", "key"]).groupBy("fp").agg(*(F.max(F.when(F.col("g") == i, F.col("n1"))).alias(f"m{i}") for i in range(m)))
    choice = _cheapest([{-1: F.lit(0), 0: 1 + F.col(f"n{i}"), 1: F.lit(1 + len(groups[i])) + F.col(f"m{i}")} for i in range(m)], tau - m + 1)
    chosen = written(warm.join(costs.hint("merge"), "fp").select("fp", choice.alias("c")).select("fp", "c.*"), "thresholds")
    asked = chosen.where(F.col("cost") <= most).join(index.hint("merge"), "fp")
    t = F.element_at("t", F.col("g") + 1)
    asked = asked.withColumn("flip", F.explode(F.when(t == 1, around).when(t == 0, F.array(F.lit(0).cast("bigint"))))).select(F.col("fp").alias("a"), "g", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    target = index.join(freq.hint("merge"), ["g", "key"], "left").where(F.coalesce("n", F.lit(1)) <= most).select("g", "key", F.col("fp").alias("b"))
    pairs = pairs.unionAll(asked.join(target.hint("merge"), ["g", "key"]).where("a <> b").where(near("a", "b")).select("a", "b"))

    dense = chosen.where(F.col("cost") > most)
    if tau == 1:  # the points one bit away are the others, where they are fingerprints
        beside = dense.select(F.col("fp").alias("a"), F.explode(F.array(*(F.lit(_signed(1 << b)) for b in range(64)))).alias("flip"))
        met = beside.select("a", F.col("a").bitwiseXOR(F.col("flip")).alias("b")).join(fps.select(F.col("fp").alias("b")).hint("merge"), "b").select("a", "b")
        return pairs.unionAll(met)
    points = F.array(F.lit(0).cast("bigint"), *(F.lit(_signed(1 << b)) for b in range(64)))
    met = dense.select("fp", F.explode(points).alias("flip")).groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).agg(F.array_sort(F.collect_list("fp")).alias("all"))
    met = met.where(F.size("all") > 1).select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 64)).alias("b"))
    return pairs.unionAll(met)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """Per row: id_col, fp (signed) and component_id, the smallest id that links reach (2 or fewer differing bits).

    Equal fingerprints are one class and count once; a class is linked by its smallest id. Texts are read whole; null,
    empty and wordless ones have fingerprint 0 and are linked like any other. Repeated rows are answered each. A null id
    is answered too, but never names a component unless its class has no other. An empty table gives an empty result.
    Only id_col and text are read, so other columns can't clash.
    """
    with scratch() as keep:
        fp = keep(written(fingerprints(docs.select(id_col, text), text, "fp", k).select(id_col, "fp"), "fingerprints"))
        classes = written(fp.groupBy("fp").agg(F.min(id_col).alias("rep")), "classes")
        pairs = links(classes.select("fp")).distinct()
        reps = classes.where(F.col("rep").isNotNull())
        e = pairs.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra")).hint("merge"), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb")).hint("merge"), "b")
        named = components(e.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        labels = classes.join(named.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
        labels = keep(written(labels, "labels"))
    return fp.join(labels.hint("merge"), "fp").select(id_col, "fp", "component_id")


# --- near-duplicates by similarity: prefixes of shingles propose, all shingles decide

#: Words in a shingle, the least similarity of near-duplicates.
WORDS, SIMILAR = 5, 0.8
#: Share of all shingles, by hash, that are counted. It changes the work only: what a text has too few of is made up by others.
COUNTED = 0.5
#: Members of a group that are compared with each other in one piece.
BLOCK = 1000


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; those of a text without words are one of their own, so that such texts are equal."""
    return np.unique(np.array(shingle_hashes(text or "", k) or [0], "<u8"))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of shingle hashes; 1 of two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def leading(s: np.ndarray, similar: float = SIMILAR, counted: float = COUNTED) -> tuple[int, np.ndarray]:
    """(spare, hashes): all of the set's hashes in the counted share, and the least others where a prefix needs more.

    A text of n shingles shares ceil(similar n) of them at least with any similar text, so under any order of all shingles
    two similar texts share one among the first n - ceil(similar n) + 1 of each. The order has the counted share first, by
    frequency, then the others by hash; spare hashes, the last of them in that order, aren't in the prefix.
    """
    n = len(s)
    prefix = n - math.ceil(similar * n - 1e-9) + 1
    inside = n if counted >= 1 else int(np.searchsorted(s, np.uint64(int(counted * 2**64))))
    some = min(n, max(inside, prefix))
    return some - min(prefix, some), s[:some]


def sketch(s: np.ndarray) -> np.ndarray:
    """Counts of the hashes by their last bits, about as many counts as hashes: those of two sets differ by no more, in sum,
    than the sets do."""
    width = 1 << min(max(math.ceil(math.log2(max(len(s), 1))), 6), 12)
    return np.minimum(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width), 255).astype(np.uint8)


def close(sizes: np.ndarray, labels: np.ndarray, sides: np.ndarray, sketches: list[np.ndarray], one_side: bool, similar: float = SIMILAR):
    """Index pairs of unequal labels (and, unless one_side, unequal sides) whose sizes and sketches don't rule out similarity."""
    most = (1 - similar) / (1 + similar)
    widths = np.array([len(x) for x in sketches])
    for width in sorted(set(widths.tolist())):
        at = np.flatnonzero((widths == width) | (widths == 2 * width))  # sizes that similar allows (over 0.5) have these
        at = at[np.argsort(sizes[at], kind="stable")]
        n, label, side = sizes[at], labels[at], sides[at]
        counts = np.stack([sketches[i].astype(np.int16).reshape(-1, width).sum(0, dtype=np.int16) for i in at])
        ends = np.searchsorted(n, n / similar + 1e-6, "right")
        for i in np.flatnonzero(widths[at] == width):
            j = np.arange(i + 1, ends[i])
            j = j[(label[j] != label[i]) & (one_side | (side[j] != side[i]))]
            for part in (j[x : x + 4096] for x in range(0, len(j), 4096)):
                apart = np.abs(counts[part] - counts[i]).sum(1, dtype=np.int64)
                for m in part[apart <= most * (n[part] + n[i]) + 1e-6]:
                    yield at[i], at[m]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = WORDS, similar: float = SIMILAR, counted: float = COUNTED, block: int = BLOCK) -> DataFrame:
    """Per row with an id: id_col and component_id, the smallest id that links reach; texts are linked if they are equal or
    have at least similar (over 0.5) of their distinct shingles of k words in common. No link is lost.

    Equal texts are one, named by their smallest id. Texts that share a shingle of their prefixes (see leading) form a group:
    the rarest shingles come first, and those that one text alone has can't be shared, so few texts are in any. Each member
    is compared with the group's most shared one. What these links join needs no further comparison; members that they leave
    apart are compared in blocks, by sketches that rule out pairs and then by all shingles. So no pairs of a group of copies
    are made, but members that stay apart cost the square of their number, in sketches. Null, empty and wordless texts are
    similar. Rows that repeat an id are one document, of which the least text counts. An empty table gives an empty result.
    Only id_col and text are read, so other columns can't clash.
    """
    if not 0.5 < similar <= 1:
        raise ValueError("similar is over 0.5 and at most 1")
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(texts: pa.Array) -> pa.Array:
        rows = [leading(shingle_set(t, k), similar, counted) for i, j, _, _ in string_slices(texts, SLICE) for t in texts.slice(i, j - i).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].view("<i8") for r in rows], pa.list_(pa.int64()))], ["spare", "h"])

    def shingles(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, k).view("<i8") for i, j, _, _ in string_slices(texts, SLICE) for t in texts.slice(i, j - i).to_pylist()], pa.list_(pa.int64()))

    whole = lambda x: np.sort(x.values.to_numpy(zero_copy_only=False).view("<u8"))

    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similarity(whole(x), whole(y)) for x, y in zip(a, b)], pa.float64())

    def sketched(sets: pa.Array) -> pa.Array:
        return pa.array([sketch(whole(x)).tobytes() for x in sets], pa.binary())

    def apart(t: pa.Table) -> pa.Table:
        one = t.column("low")[0] == t.column("high")[0]
        sketches = [np.frombuffer(x, np.uint8) for x in t.column("sketch").to_pylist()]
        labels = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        found = list(close(t.column("n").to_numpy(), labels, t.column("own").to_numpy(), sketches, one, similar))
        ids = t.column("id").combine_chunks()
        return pa.table({"a": ids.take(pa.array([i for i, _ in found], pa.int64())), "b": ids.take(pa.array([j for _, j in found], pa.int64()))})

    with scratch() as keep:
        named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
        every = written(named.select("id", F.sha2("t", 256).alias("same")), "digests")
        one = written(every.groupBy("id").agg(F.min("same").alias("same")), "texts")
        if one.count() < every.count():
            named = named.withColumn("same", F.sha2("t", 256)).join(one.hint("merge"), ["id", "same"], "left_semi").dropDuplicates(["id", "same"]).select("id", "t")
        classes = written(one.groupBy("same").agg(F.min("id").alias("rep")), "classes")

        # shingles that more than one row has, then those that more than one text has
        # (a window, as a join would make the hashes twice; explode_outer, as explode's own filter would; no set is empty)
        hashes = named.select("id", arrow_udf(measure, "struct<spare:int,h:array<bigint>>")("t").alias("m")).select("id", "m.spare", F.explode_outer("m.h").alias("h"))
        many = hashes.withColumn("rows", F.count("*").over(Window.partitionBy("h"))).where("rows > 1").drop("rows")
        shared = written(many.join(classes.select(F.col("rep").alias("id")).hint("merge"), "id", "left_semi"), "shared")
        often = written(shared.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "frequencies")
        of = Window.partitionBy("id")
        ranked = shared.join(often.hint("merge"), "h").withColumns({"place": F.row_number().over(of.orderBy(F.desc("n"), F.desc("h"))), "all": F.count("*").over(of)})
        prefixes = written(ranked.where("place > spare").select("id", "h", (F.col("all") - F.col("spare")).alias("w")), "prefixes")

        # groups with the same members are one
        groups = prefixes.groupBy("h").agg(F.count("*").alias("c"), F.min(F.struct(-F.col("w"), "id")).alias("f"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("c > 1")
        groups = written(groups.groupBy("c", "f", "x", "y").agg(F.min("h").alias("h")).select("h", F.col("f.id").alias("first")), "groups")
        members = written(prefixes.join(groups.hint("merge"), "h").select("h", "id", "first"), "members")
        ids = written(members.select("id").distinct().join(one.hint("merge"), "id"), "compared")
        rows = named.withColumn("same", F.sha2("t", 256)).join(ids.hint("merge"), ["id", "same"], "left_semi")
        sets = written(rows.select("id", arrow_udf(shingles, "array<bigint>")("t").alias("s")), "shingles")

        def linked(pairs: DataFrame) -> DataFrame:
            scored = pairs.join(sets.withColumnsRenamed({"id": "a", "s": "x"}).hint("merge"), "a").join(sets.withColumnsRenamed({"id": "b", "s": "y"}).hint("merge"), "b")
            return written(scored.select("a", "b", arrow_udf(compare, "double")("x", "y").alias("similarity")).where(F.col("similarity") >= similar).select("a", "b"), "links")

        edges = linked(written(members.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), "pairs"))
        joined = written(components(edges), "joined")
        labelled = written(members.join(joined.withColumnRenamed("node", "id").hint("merge"), "id", "left").where("id <> first").select("h", "id", F.coalesce("component", "id").alias("label")), "labelled")
        open_ = written(labelled.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("c")).where("low <> high").select("h", F.ceil(F.col("c") / block).cast("int").alias("pieces")), "open")
        sketches = written(sets.select("id", F.size("s").alias("n"), arrow_udf(sketched, "binary")("s").alias("sketch")), "sketches")
        dealt = labelled.join(open_.hint("merge"), "h").withColumn("own", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
        dealt = dealt.join(sketches.hint("merge"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        dealt = dealt.select("h", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "label", "n", "sketch")
        more = dealt.groupBy("h", "low", "high").applyInArrow(apart, f"a {kind}, b {kind}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = edges.unionAll(linked(written(more, "pairs")))

        named_by = components(edges)
        label = classes.join(named_by.withColumnsRenamed({"node": "rep", "component": "c"}).hint("merge"), "rep", "left").select("same", F.coalesce("c", "rep").cast(kind).alias("component_id"))
        result = keep(written(one.join(written(label, "labels").hint("merge"), "same").select(F.col("id").alias(id_col), "component_id"), "components"))
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the
    smallest id stays. Rows without an id stay. Rows that repeat an id are one document, of which the row with the least
    text, then the least other columns (by their hashes) stays, whatever the order they are read in. An empty table stays one."""
    kept = near_duplicates(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    same, row = _fresh("same", docs.columns), _fresh("row", docs.columns)
    marked = docs.where(F.col("doc_id").isNotNull()).withColumns({same: F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256), row: F.xxhash64(*docs.columns)})
    least = marked.groupBy("doc_id").agg(F.min(F.struct(same, row)).alias("s")).select("doc_id", f"s.{same}", f"s.{row}")
    least = written(least.join(kept.hint("merge"), "doc_id", "left_semi"), "kept")
    named = marked.join(least.hint("merge"), ["doc_id", same, row], "left_semi").dropDuplicates(["doc_id", same, row])
    return named.select(*docs.columns).unionAll(docs.where(F.col("doc_id").isNull()))


def _fresh(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name
