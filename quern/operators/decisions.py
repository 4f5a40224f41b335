"""Routing of requests: signals of a text, ordered rules, posteriors, decisions that follow a context, learnt values, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import scan

# Actions, the rules' reasons, what the likelihoods are multiplied by, logs of actions.
ACTIONS = ("answer", "clarify", "retrieve", "escalate")
REASONS = ("query too long (tree node 1)", "contains keywords (tree node 2)", "high complexity (tree node 3)", "urgent pattern (tree node 4)", "data query (tree node 5)", "default answer (tree leaf)")
LIKELIHOODS = {"long": ("clarify", 1.5), "keywords": ("retrieve", 1.8), "complex": ("clarify", 1.4), "urgent": ("escalate", 2.0), "data": ("retrieve", 1.6)}
PRIORS = {"answer": 0.5, "clarify": 0.2, "retrieve": 0.2, "escalate": 0.1}
LOGS = {
    "answer": ("response_generated", "user receives answer", ("system knowledge accessed",)),
    "clarify": ("clarification_requested", "user provides more context", ("user interaction initiated", "awaiting input")),
    "retrieve": ("retrieval_initiated", "knowledge base searched", ("knowledge retrieval started", "context altered")),
    "escalate": ("escalated", "human review required", ("escalation triggered", "information queued for review")),
}
#: A decision that repeats the context's last action gains, one after a jump of complexity loses.
SAME, MOVED, JUMP = 1.1, 0.95, 0.3


def signals(text: Column, keywords: list[str] = ()) -> dict[str, Column]:
    """Measures of a request's text; null is empty. Words are what single white-space runs part, be it nothing."""
    t = F.coalesce(text, F.lit(""))
    words, lower = F.split(t, r"\s+"), F.lower(t)
    n = F.size(words)
    return {
        "length": F.length(t), "word_count": n, "sentence_count": F.regexp_count(t, F.lit("[.!?]+")), "has_question": t.contains("?"), "has_exclamation": t.contains("!"),
        "has_numbers": t.rlike("[0-9]"), "has_keywords": reduce(lambda a, b: a | b, (lower.contains(k.lower()) for k in keywords), F.lit(False)),
        "capital_ratio": F.coalesce(F.try_divide(F.regexp_count(t, F.lit("[A-Z]")), F.length(t)), F.lit(0.0)), "complexity": F.size(F.filter(words, lambda w: F.length(w) > 6)) / n, "estimated_cost": F.length(t) / 100 + n / 10,
    }


def conditions(s: dict[str, Column], longest: int = 100, sentences: int = 3, complexity: float = 0.5, words: int = 5) -> dict[str, Column]:
    """What the rules and the likelihoods ask of signals()."""
    return {
        "long": s["length"] > longest, "keywords": s["has_keywords"], "complex": s["complexity"] > complexity, "wordy": (s["sentence_count"] > sentences) | (s["complexity"] > complexity),
        "urgent": ~s["has_question"] & s["has_exclamation"], "data": s["has_numbers"] & (s["word_count"] < words),
    }


def decide(rules: list[tuple[Column, str, str]], default: tuple[str, str]) -> Column:
    """struct(action, reason) of the first rule that holds."""
    made = lambda a, r: F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"))
    out = reduce(lambda w, x: w.when(x[0], made(x[1], x[2])), rules, F)
    return out.otherwise(made(*default))


def tree(c: dict[str, Column]) -> Column:
    """The rules over conditions(), in order; the last is the default."""
    order = (("long", "clarify"), ("keywords", "retrieve"), ("wordy", "clarify"), ("urgent", "escalate"), ("data", "retrieve"))
    return decide([(c[k], action, reason) for (k, action), reason in zip(order, REASONS)], ("answer", REASONS[-1]))


def posteriors(c: dict[str, Column], priors: dict[str, float] = PRIORS, likelihoods: dict[str, tuple[str, float]] = LIKELIHOODS) -> Column:
    """struct of each action's probability: its prior times the likelihoods of the conditions that hold, normalised."""
    scores = {a: reduce(lambda x, k: x * F.when(c[k], likelihoods[k][1]).otherwise(1.0), (k for k in likelihoods if likelihoods[k][0] == a), F.lit(float(p))) for a, p in priors.items()}
    total = reduce(lambda a, b: a + b, scores.values())
    return F.struct(*(F.when(total > 0, v / total).otherwise(F.lit(float(priors[a]))).alias(a) for a, v in scores.items()))


def likeliest(p: Column, actions: tuple[str, ...] = ACTIONS) -> Column:
    """The action of the greatest probability; of equal ones the last."""
    best = F.greatest(*(p[a] for a in actions))
    return reduce(lambda w, a: w.when(p[a] == best, a), reversed(actions), F)


def sequential(df: DataFrame, key: str, order: str, probabilities: str, complexity: str, actions: tuple[str, ...] = ACTIONS) -> DataFrame:
    """df with action and confidence: per key, in order, each row's probabilities are updated by the decision before it
    (times SAME for its action, times MOVED for all if complexity moved by over JUMP), normalised, and the greatest is
    taken, of equal ones the last. A key's first row is decided by its probabilities alone."""
    flat = df.select("*", *(F.col(f"{probabilities}.{a}").alias(f"__p{k}") for k, a in enumerate(actions)))

    def step(state: list, moved: float | None, *p: float) -> tuple:
        p = [x or 0.0 for x in p]
        if state[0] is not None:
            loss = MOVED if abs((moved or 0.0) - state[1]) > JUMP else 1.0
            q = [x * loss * (SAME if k == state[0] else 1.0) for k, x in enumerate(p)]
            total = sum(q)
            p = [x / total for x in q] if total > 0 else p
        best = max(range(len(p)), key=lambda k: (p[k], k))
        state[:] = [best, moved or 0.0]
        return best, p[best]

    out = scan(flat, [key], [order], [complexity, *(f"__p{k}" for k in range(len(actions)))], lambda: [None, 0.0], step, ["__at", "confidence"])
    named = F.element_at(F.array(*map(F.lit, actions)), F.col("__at").cast("int") + 1)
    return out.withColumn("action", named).drop("__at", *(f"__p{k}" for k in range(len(actions))))


def state_of(s: dict[str, Column]) -> Column:
    """A request's discrete state: complexity in fifths, length, keywords, question."""
    size = F.when(s["length"] < 50, "short").when(s["length"] < 200, "medium").otherwise("long")
    fifth = F.floor(s["complexity"] * 5) / 5
    return F.concat_ws("_", F.when(fifth == F.floor(fifth), F.floor(fifth).cast("string")).otherwise(fifth.cast("string")), size, F.when(s["has_keywords"], "kw").otherwise("nokw"), F.when(s["has_question"], "quest").otherwise("noquest"))


def q_update(q: Column, reward: Column, best_next: Column, alpha: float = 0.1, gamma: float = 0.9) -> Column:
    return q + alpha * (reward + gamma * best_next - q)


class Policy:
    """Values of actions by state (state, action, q), learnt from feedback (state, action, reward, next)."""

    def __init__(self, values: DataFrame) -> None:
        self.values = values

    def learn(self, feedback: DataFrame, order: str, alpha: float = 0.1, gamma: float = 0.9) -> Policy:
        """The policy after feedback in its order. Values of a state depend on those of the next, so feedback is one sequence,
        read in batches by one task; only the table of values is held there."""
        spark, known = feedback.sparkSession, [tuple(r) for r in self.values.select("state", "action", "q").collect()]
        names = ["state", "action", "reward", "next"]

        def run(batches):
            import pyarrow as pa

            q = {(s, a): v for s, a, v in known}
            for batch in batches:
                for s, a, r, n in zip(*(batch.column(c).to_pylist() for c in names)):
                    old = q.get((s, a), 0.0)
                    q[s, a] = old + alpha * (r + gamma * max((q.get((n, b), 0.0) for b in ACTIONS), default=0.0) - old)
            rows = list(q.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.float64())], ["state", "action", "q"])

        sequence = feedback.select(F.col("state").cast("string"), F.col("action").cast("string"), F.col("reward").cast("double"), F.col("next").cast("string").alias("next"), order)
        learnt = sequence.repartition(1).sortWithinPartitions(order).select(*names).mapInArrow(run, "state string, action string, q double")
        return Policy(spark.createDataFrame(learnt.collect(), learnt.schema))

    def best(self, requests: DataFrame, state: str, explore: float = 0.0, seed: int = 0) -> DataFrame:
        """requests with action and confidence: the best known action of their state, the first of equal ones; a random one
        with probability explore. The confidence is its share of all values, 0.5 if these sum to no more than 0."""
        q = {a: F.coalesce(F.max(F.when(F.col("action") == a, F.col("q"))), F.lit(0.0)).alias(a) for a in ACTIONS}
        table = self.values.groupBy(F.col("state").alias(state)).agg(*q.values())
        joined = requests.join(F.broadcast(table), state, "left").fillna(0.0, list(ACTIONS))
        best, total = F.greatest(*ACTIONS), reduce(lambda a, b: a + b, (F.col(a) for a in ACTIONS))
        taken = reduce(lambda w, a: w.when(F.col(a) == best, a), ACTIONS, F)
        drawn = F.element_at(F.array(*map(F.lit, ACTIONS)), F.floor(F.rand(seed + 1) * len(ACTIONS)).cast("int") + 1)
        action = F.when(F.rand(seed) < explore, drawn).otherwise(taken) if explore else taken
        return joined.withColumns({"action": action, "confidence": F.when(total > 0, best / total).otherwise(0.5)}).drop(*ACTIONS)


def executed(action: Column) -> Column:
    """struct(state, expected, effects): what an action's execution logs."""
    made = lambda a: F.struct(F.lit(LOGS[a][0]).alias("state"), F.lit(LOGS[a][1]).alias("expected"), F.array(*map(F.lit, LOGS[a][2])).alias("effects"))
    return reduce(lambda w, a: w.when(action == a, made(a)), LOGS, F)


def routed(decisions: DataFrame, action: str = "action") -> dict[str, DataFrame]:
    """A table an action."""
    return {a: decisions.where(F.col(action) == a) for a in ACTIONS}


def latest(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The last n decisions."""
    return df.orderBy(F.col(order).desc()).limit(n)
