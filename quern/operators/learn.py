"""Classifier, edit distance, graphs and game trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- logistic regression


def fit(df: DataFrame, features: list[str], label: str, iterations: int = 2000, l2: float = 0.0, tol: float = 1e-7, intercept: bool = True, threshold: float = 0.5):
    from pyspark import StorageLevel
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df = df.select(*dict.fromkeys([*features, label]))
    if df.limit(1).count() == 0:
        raise ValueError("X must be non-empty")
    if df.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in [*features, label]))).limit(1).count():
        raise ValueError("X and y must have the same number of values")
    assembled = VectorAssembler(inputCols=features, outputCol="__x")
    lr = LogisticRegression(featuresCol="__x", labelCol=label, maxIter=iterations, regParam=l2, tol=tol, fitIntercept=intercept, threshold=threshold)
    rows = assembled.transform(df).select("__x", label).persist(StorageLevel.DISK_ONLY)  # each iteration reads them
    try:
        return PipelineModel([assembled, lr.fit(rows)])
    finally:
        rows.unpersist()


def predict(model, df: DataFrame) -> DataFrame:
    """df with label_pred, proba (of class 1) and decision (the linear score)."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        raise ValueError("model is not fitted")
    out = model.transform(df)
    return out.withColumns({"label_pred": F.col("prediction").cast("int"), "proba": vector_to_array("probability")[1], "decision": vector_to_array("rawPrediction")[1]}).drop("__x", "prediction", "probability", "rawPrediction")


# --- texts


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


# --- graphs: nodes(id, type, label), edges(src, dst, type)


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """The first row of an id wins."""
    both = nodes.withColumn("__k", F.lit(0)).unionByName(new.withColumn("__k", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("id", "__k")]
    return both.groupBy("id").agg(F.min_by(F.struct(*rest), "__k").alias("s")).select("id", "s.*")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per node and edge type."""
    count = lambda df, what: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "type", "n")
    return count(nodes, "node").unionAll(count(edges, "edge"))


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with new ones; an error for an end that is no node."""
    ends = new.select(F.col("src").alias("id")).unionAll(new.select(F.col("dst").alias("id"))).distinct()
    missing = ends.join(nodes.select("id"), "id", "left_anti").first()
    if missing is not None:
        raise ValueError(f'Vertex "{missing["id"]}" not found')
    return edges.unionByName(new, allowMissingColumns=True)


def nodes_of(nodes: DataFrame, type: str | None = None, where: Column | None = None) -> DataFrame:  # noqa: A002
    """Nodes of a type, that a predicate holds for."""
    nodes = nodes if type is None else nodes.where(F.col("type") == type)
    return nodes if where is None else nodes.where(where)


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A line of JSON (kind, json) for each node and edge."""
    line = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json"))
    return line(nodes, "node").unionAll(line(edges, "edge"))


def edges_of(edges: DataFrame, node, out: bool = True) -> DataFrame:
    return edges.where(F.col("src" if out else "dst") == node)


#: Bounds of ASCII words; what \b means to letters beyond ASCII depends on the Java version.
_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
TERM, CONCEPT = f"{_BEFORE}[A-Z][a-z]{{4,}}{_AFTER}", f"{_BEFORE}[A-Z][a-z]+ [A-Z][a-z]+{_AFTER}"


def entities(text: Column, pattern: str, most: int) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), 1, most)


def knowledge_graph(docs: DataFrame, id_col: str, text: str, terms: int = 20, concepts: int = 15, paired: int = 10) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from texts: document to term and concept, and the first paired entities of a text to each other."""
    found = docs.select(F.col(id_col).cast("string").alias("doc"), entities(F.col(text), TERM, terms).alias("t"), entities(F.col(text), CONCEPT, concepts).alias("c"))
    typed = {"term": "contains_term", "concept": "describes_concept"}
    parts = [found.select("doc", F.explode(k[0]).alias("e"), F.lit(k).alias("type"), F.lit(edge).alias("edge")) for k, edge in typed.items()]
    links = reduce(DataFrame.unionAll, parts)
    nodes = links.select(F.col("e").alias("id"), "type").unionAll(found.select(F.col("doc").alias("id"), F.lit("document").alias("type")))
    nodes = nodes.groupBy("id").agg(F.min("type").alias("type"))
    some = F.slice(F.concat("t", "c"), 1, paired)
    related = found.withColumn("s", some).select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice(F.col("s"), i + 2, F.lit(paired)), lambda y: F.struct(x.alias("src"), y.alias("dst")))))).alias("p"))
    edges = links.select(F.col("doc").alias("src"), F.col("e").alias("dst"), F.col("edge").alias("type")).unionAll(related.select("p.src", "p.dst", F.lit("related_to").alias("type")))
    return nodes, edges.distinct()


# --- game trees: leaves are numbers, inner nodes lists


def minimax(node, largest: bool = True) -> float:
    return node if not isinstance(node, list) else (max if largest else min)(minimax(x, not largest) for x in node)


def alphabeta(node, largest: bool = True, low: float = float("-inf"), high: float = float("inf")) -> float:
    """minimax, without the branches that can't change it."""
    if not isinstance(node, list):
        return node
    best = float("-inf") if largest else float("inf")
    for x in node:
        value = alphabeta(x, not largest, low, high)
        best = max(best, value) if largest else min(best, value)
        low, high = (max(low, best), high) if largest else (low, min(high, best))
        if low >= high:
            break
    return best


def tree_values(nodes: DataFrame, depth: int, largest: bool = True) -> DataFrame:
    """minimax of a table of nodes (id, parent, value; the root's parent is null), level by level from below, at most depth levels."""
    level = nodes.where(F.col("parent").isNull()).select("id", "parent", "value", F.lit(0).alias("d"))
    all_ = level
    for d in range(1, depth + 1):
        level = nodes.join(level.select(F.col("id").alias("parent")), "parent").select("id", "parent", "value", F.lit(d).alias("d"))
        all_ = all_.unionAll(level)
    below = all_.where(F.col("d") == depth)
    for d in range(depth - 1, -1, -1):
        best = (F.max if (d % 2 == 0) == largest else F.min)("value").alias("best")
        here = all_.where(F.col("d") == d).join(below.groupBy(F.col("parent").alias("id")).agg(best), "id", "left")
        below = here.select("id", "parent", F.coalesce("best", "value").alias("value"))
    return below.select("id", "value")
