"""Logistic fits that leave out one unit each, for all units from one pass over the rows.

Gradient and curvature of the loss are sums over units. At a point shared by all fits (the
fit on everyone), the sums without a unit are the total minus the unit's own: one aggregate
gives every unit a Newton step. Leaving out one of many units moves a fit little, and how
far it can still be from its optimum has a bound (the loss is self-concordant: over a step
that moves no prediction by more than B, curvature changes by a factor of e^B at most).
Units whose bound is below the tolerance are done, which is all of them once units are many.
The others take further steps, whose gradients are summed for all of them in shared passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.functions.numeric import sigmoid
from lectern.operators import fold_fits
from lectern.session import cut_lineage


def _class_sums(rows: DataFrame, shared: np.ndarray) -> DataFrame:
    """Per unit and class: gradient, curvature, first and second moments and size, at the shared coefficients."""
    p = len(shared) - 1
    x = [F.lit(1.0), *[F.col(f"x{j}") for j in range(p)]]
    eta = sum((F.lit(float(b)) * c for b, c in zip(shared, x)), F.lit(0.0))
    chance = F.col("__p")
    sums = [F.sum((F.col("y") - chance) * c) for c in x]
    sums += [F.sum(chance * (1 - chance) * x[i] * x[j]) for i in range(p + 1) for j in range(i, p + 1)]
    sums += [F.sum(c) for c in x[1:]] + [F.sum(c * c) for c in x[1:]] + [F.count(F.lit(1)).cast("double")]
    return rows.withColumn("__p", sigmoid(eta)).groupBy("unit_key", "y").agg(F.array(*sums).alias("sums"))


def _first_steps(own: DataFrame, totals: np.ndarray, shared: np.ndarray, largest: np.ndarray, penalty: float, tolerance: float, kind: str) -> DataFrame:
    """Coefficients of every unit after one step, what further steps need, and how the unit stands."""
    p, q = len(shared) - 1, len(shared)
    upper = np.triu_indices(q)
    t = len(upper[0])
    reach = np.concatenate([[1.0], largest])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for unit, no, yes in zip(batch["unit_key"], batch["no"], batch["yes"]):
                left = [total - (0 if s is None else np.asarray(s, dtype=float)) for total, s in zip(totals, (no, yes))]
                sizes = [s[-1] for s in left]
                n = sum(sizes)
                if min(sizes) <= 0:
                    out.append((unit, None, None, None, None, None, "one_class"))
                    continue
                w = [n / (2 * size) for size in sizes]
                both = left[0] + left[1]
                mean = both[q + t : q + t + p] / n
                ridge = np.concatenate([[0.0], penalty * np.maximum(both[q + t + p : q + t + 2 * p] / n - mean**2, 0.0)])
                ridge[1:] = np.where(ridge[1:] > 1e-12 * np.maximum(mean**2, 1e-12), ridge[1:], 1.0)
                mixed = w[0] * left[0] + w[1] * left[1]
                hessian = np.zeros((q, q))
                hessian[upper] = hessian.T[upper] = mixed[q : q + t]
                inverse = np.linalg.pinv(hessian + np.diag(ridge))
                gradient = mixed[:q] - ridge * shared
                move = inverse @ gradient
                b = float(reach @ np.abs(move))
                factor = (np.expm1(b) - b) / b if b > 1e-8 else b / 2
                rest = np.exp(min(b, 700.0)) * factor * np.sqrt(max(gradient @ move, 0.0)) * np.sqrt(reach @ np.abs(inverse) @ reach)
                out.append((unit, list(shared + move), list(inverse.ravel()), list(ridge), w[0], w[1], "converged" if 2 * rest < tolerance else "open"))
            yield pd.DataFrame(out, columns=["unit_key", "coefficients", "inverse", "ridge", "w0", "w1", "status"])

    wide = own.groupBy("unit_key").agg(F.max(F.when(F.col("y") == 0, F.col("sums"))).alias("no"), F.max(F.when(F.col("y") == 1, F.col("sums"))).alias("yes"))
    return wide.mapInPandas(solve, f"unit_key {kind}, coefficients array<double>, inverse array<double>, ridge array<double>, w0 double, w1 double, status string")


def left_out_logistic(
    df: DataFrame, unit: str, outcome: str, predictors: Sequence[str], *, penalty: float = 1.0, tolerance: float = 1e-8, rounds: int = 100
) -> DataFrame:
    """``unit, coefficients, status`` of the ridge logistic fit on the rows of all other units.

    Classes are balanced and the penalty acts on predictors divided by their deviation, both over
    each fit's own training rows. Rows with a missing predictor, an outcome other than 0 and 1
    or no unit take no part. ``status``: ``converged``, ``moving`` (out of rounds) or
    ``one_class`` (no coefficients).
    """
    p = len(predictors)
    chosen = df.select(F.col(unit).alias("unit_key"), F.col(outcome).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(predictors)])
    rows = cut_lineage(chosen.where(F.col("y").isin(0.0, 1.0)).na.drop())
    kind = rows.schema["unit_key"].dataType.simpleString()
    placed = rows.select(F.lit(fold_fits.NOWHERE).alias("fold"), F.lit(fold_fits.NOWHERE).alias("unit"), F.col("y").cast("int").alias("y"), *[f"x{j}" for j in range(p)])
    everyone = fold_fits.fit(placed, predictors, fold_fits.Fits.grid([fold_fits.NOBODY]), [list(predictors)], penalty=penalty)
    slopes = everyone.raw[0, 1 : p + 1] / everyone.design.spread
    shared = np.concatenate([[everyone.raw[0, 0] - slopes @ everyone.design.centre], slopes])
    own = cut_lineage(_class_sums(rows, shared))
    by_class = {r["y"]: np.array(r["total"]) for r in own.groupBy("y").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(_width(p))]).alias("total")).collect()}
    totals = np.stack([by_class.get(c, np.zeros(_width(p))) for c in (0.0, 1.0)])
    largest = rows.agg(*[F.max(F.abs(f"x{j}")).alias(f"x{j}") for j in range(p)]).first()
    stepped = cut_lineage(_first_steps(own, totals, shared, np.array([largest[j] or 0.0 for j in range(p)]), penalty, tolerance, kind))
    opened = stepped.where("status = 'open'").drop("status").collect()  # units so few that the bound does not close them
    done = stepped.where("status <> 'open'").select(F.col("unit_key").alias(unit), "coefficients", "status")
    if not opened:
        return done
    finished = _further_steps(rows, opened, p, tolerance, rounds)
    return done.unionByName(rows.sparkSession.createDataFrame(finished, f"`{unit}` {kind}, coefficients array<double>, status string"))


def _width(p: int) -> int:
    q = p + 1
    return q + q * (q + 1) // 2 + 2 * p + 1


def _further_steps(rows: DataFrame, opened: Sequence, p: int, tolerance: float, rounds: int) -> list[tuple]:
    """Steps of all open units together, with the curvature of their first step, until none moves a coefficient's worth."""
    units = [r["unit_key"] for r in opened]
    number = {u: i for i, u in enumerate(units)}
    beta, ridge = np.array([r["coefficients"] for r in opened]), np.array([r["ridge"] for r in opened])
    inverse = np.array([r["inverse"] for r in opened]).reshape(len(units), p + 1, p + 1)
    w0, w1 = np.array([r["w0"] for r in opened]), np.array([r["w1"] for r in opened])
    moving = np.ones(len(units), dtype=bool)
    for _ in range(rounds):
        at = np.flatnonzero(moving)
        if not len(at):
            break
        now, no, yes = beta[at], w0[at], w1[at]

        def gradients(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            total = np.zeros((len(at), p + 1))
            for batch in batches:
                for part in fold_fits._blocks(batch, len(at)):
                    x = np.column_stack([np.ones(part.num_rows), *[part.column(f"x{j}").to_numpy(zero_copy_only=False) for j in range(p)]])
                    y = part.column("y").to_numpy(zero_copy_only=False)[:, None] == 1
                    mine = np.array([number.get(u, -1) for u in part.column("unit_key").to_pylist()])
                    weight = np.where(y, yes, no) * (mine[:, None] != at)
                    total += (weight * (y - 1.0 / (1.0 + np.exp(-np.clip(x @ now.T, -700, 700))))).T @ x
            return total

        step = np.einsum("uij,uj->ui", inverse[at], fold_fits._summed(rows, gradients, len(at)) - ridge[at] * now)
        beta[at] += step
        moving[at] = np.abs(step).max(axis=1) >= tolerance
    return [(u, b.tolist(), "moving" if m else "converged") for u, b, m in zip(units, beta, moving)]
