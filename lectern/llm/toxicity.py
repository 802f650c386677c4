"""Toxic passages: maximal scoring segments of token log-odds, calibrated by extreme values.

Tokens get log-odds of the toxic against the other class, with a Dirichlet prior that
follows the corpus. Tokens that tell the classes apart carry their log-odds; all others
carry a small negative drift. A linear scan finds every maximal scoring segment of a text.
In texts of the other class the best segment of n tokens follows an extreme-value law
with rate lambda and constant K, so a segment's expected count is K n exp(-lambda S);
the segments that are unlikely by chance are reported, and a logistic curve over the
evidence of a text gives its score.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lectern.llm.common import id_and_text, id_crc, schema_of

TOKEN = re.compile(r"\w+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 0.05
    rate: float = 1.0
    constant: float = 1.0
    bias: float = -3.0
    slope: float = 1.0


def segments(at: list[int], values: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) in one pass.

    ``at`` and ``values`` are the places and weights of positive tokens; all other tokens
    weigh ``-drift``. Segments begin and end at positive tokens.
    """
    # First, last, sum before, sum through, and the stacked place of the last one with a smaller
    # sum before: what lies between is never looked at again, so the scan is linear.
    stack: list[tuple[int, int, float, float, int]] = []
    total, place = 0.0, -1
    for i, v in zip(at, values):
        total -= drift * (i - place - 1)
        before, place = total, i
        total += v
        first, left, right = i, before, total
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            first, left, below = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = below
        stack.append((first, i, left, right, j))
    return [(f, l, r - b) for f, l, b, r, _ in stack]


def evidence(text: str | None, model: Model) -> tuple[float, int, list[tuple[int, int, float]]]:
    """Largest -ln of a segment's expected count, tokens, and the segments with their evidence."""
    tokens = TOKEN.findall((text or "").lower())
    weights = model.weights
    at = [i for i, t in enumerate(tokens) if t in weights]
    if not at:
        return 0.0, len(tokens), []
    found = segments(at, [weights[tokens[i]] for i in at], model.drift)
    size = math.log(max(model.constant * len(tokens), 1e-9))
    scored = [(f, l, model.rate * s - size) for f, l, s in found]
    return max(0.0, max(e for _, _, e in scored)), len(tokens), scored


def probability(best: float, model: Model) -> float:
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, model.bias + model.slope * math.log1p(best)))))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, seed: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``sample_rows`` labelled documents outside the held-out fold.

    A document labelled more than once is toxic if any label says so. The sampled labels are
    broadcast: their number is bounded.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y")).dropna()
    known = known.filter(F.pmod(id_crc("__id"), F.lit(5)) != 0).groupBy("__id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(sample_rows)
    return docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 20_000,
    vocabulary: int = 20_000,
    prior_share: float = 0.01,
    least_z: float = 2.5,
    least_odds: float = 3.0,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Token weights, drift, extreme-value constants and the logistic curve.

    The Dirichlet prior weighs ``prior_share`` of the sample's tokens and follows their counts.
    Learns from a bounded sample of labelled rows (``sample_rows``); at most ``vocabulary``
    weights, those with the largest z, each of at least ``least_odds`` in log-odds. Without two classes the model finds nothing.
    """
    sample = labelled_sample(id_and_text(docs, id_col, text_col), labels, sample_rows, seed)

    def count(batches):
        for batch in batches:
            n: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                for t in TOKEN.findall((text or "").lower()):
                    n.setdefault(t, [0, 0])[y > 0] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.string()), *[pa.array([v[k] for v in n.values()], pa.int64()) for k in (0, 1)]], ["token", "n0", "n1"]
            )

    counts = sample.mapInArrow(count, "token string, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.persist()
    n0, n1 = (x or 0 for x in counts.agg(F.sum("n0"), F.sum("n1")).first())
    if not n0 or not n1:
        counts.unpersist()
        return Model()
    prior = prior_share * (n0 + n1)
    alpha = F.lit(prior_share) * (F.col("n0") + F.col("n1")) + 0.05
    odds = lambda n, all_n: F.log((F.col(n) + alpha) / (F.lit(float(all_n) + prior) - F.col(n) - alpha))
    delta = odds("n1", n1) - odds("n0", n0)
    z = delta / F.sqrt(1 / (F.col("n1") + alpha) + 1 / (F.col("n0") + alpha))
    scored = counts.select("token", "n0", "n1", delta.alias("w"), z.alias("z")).filter((F.col("z") >= least_z) & (F.col("w") >= least_odds))
    top = scored.orderBy(F.desc("z"), "token").limit(vocabulary).collect()
    counts.unpersist()
    model = Model(weights={r["token"]: r["w"] for r in top})
    clean = sum(r["n0"] * r["w"] for r in top) / n0
    model.drift = max(0.01, 2 * clean)  # scores fall on average in the other class
    # The rate solves E[exp(rate * score)] = 1 over tokens of the other class.
    shares = np.array([r["n0"] / n0 for r in top]) + 0.5 / n0
    values = np.array([r["w"] for r in top])

    def excess(rate: float) -> float:
        return float((shares * np.exp(rate * values)).sum() + max(0.0, 1 - shares.sum()) * math.exp(-rate * model.drift) - 1)

    low, high = 1e-4, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        low, high = ((low + high) / 2, high) if excess((low + high) / 2) < 0 else (low, (low + high) / 2)
    model.rate = max(low, 1e-3)

    def best(batches):
        for batch in batches:
            y, e, n = [], [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                top_score, tokens, _ = evidence(text, model)
                y.append(int(label > 0))
                e.append(top_score)
                n.append(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int64()), pa.array(e, pa.float64()), pa.array(n, pa.int64())], ["y", "e", "n"])

    # K by the method of moments: over texts of the other class, K * sum(n exp(-rate S)) = 1 each on average.
    rows = sample.mapInArrow(best, "y long, e double, n long").select("y", F.least(F.round("e", 2), F.lit(60.0)).alias("e")).groupBy("y", "e").count().collect()
    others = [(r["e"], r["count"]) for r in rows if not r["y"]]
    chance = sum(c * math.exp(-e) for e, c in others) / max(1, sum(c for _, c in others))
    shift = -math.log(max(chance, 1e-6))
    model.constant = math.exp(-shift) if chance < 1 else 1.0
    moved = [(r["y"], math.log1p(max(0.0, r["e"] + (shift if r["e"] else 0.0))), r["count"]) for r in rows]
    model.bias, model.slope = logistic(moved)
    return model


def logistic(rows: list[tuple[int, float, int]], ridge: float = 1e-3) -> tuple[float, float]:
    """Bias and slope of a logistic curve over (label, evidence, count), by Newton steps to convergence."""
    y, x, c = (np.array(v, dtype=float) for v in zip(*rows))
    design = np.stack([np.ones_like(x), x], 1)
    beta = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        gradient = design.T @ (c * (y - p)) - ridge * beta
        hessian = (design * (c * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def score(docs: DataFrame, model: Model, least_evidence: float = 3.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held out or not, score, prediction, and the significant toxic passages.

    ``passages`` are first and last token (from 0) and evidence, -ln of the count expected by
    chance, of every maximal segment with at least ``least_evidence``. Null and empty texts
    have no evidence and get the lowest score. Rows with null or repeated ids give a row
    each; an empty table gives none; other columns are left out.
    """
    named = id_and_text(docs, id_col, text_col)
    passage = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("evidence", T.DoubleType())]))
    schema = schema_of(named, "doc_id", score=T.DoubleType(), passages=passage)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("evidence", pa.float64())]))

    def run(batches):
        for batch in batches:
            scores, passages = [], []
            for text in batch.column("text").to_pylist():
                best, _, found = evidence(text, model)
                scores.append(probability(best, model))
                passages.append([{"first": f, "last": l, "evidence": e} for f, l, e in found if e >= least_evidence])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(passages, kind)], schema.names)

    scored = named.mapInArrow(run, schema)
    return scored.select(
        "doc_id", (F.pmod(id_crc(), F.lit(5)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"
    )


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents whose prediction is 0, with all their columns."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([probability(evidence(t, model)[0], model) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
