"""Linear models from sufficient statistics.

Rows are reduced to sums of products per key in one aggregation; everything
after that is p x p algebra on as many rows as there are keys. Leave-one-unit-out
fits are the total minus the unit's own sums: one pass, no refits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lectern.operators.resampling import bootstrap_weights
from lectern.operators.scalars import with_totals, zscored
from lectern.operators.sequence import exact_quantiles, unpivot_values
from lectern.session import cut_lineage

MAX_TERMS = 200


def dummy_columns(column: str, levels: Sequence[str], prefix: str | None = None) -> dict[str, Column]:
    """Drop-first indicators over the sorted training levels; unseen levels are all zero."""
    ordered = sorted(levels)
    name = prefix or column
    return {f"{name}_{v}": F.coalesce((F.col(column) == v), F.lit(False)).cast("double") for v in ordered[1:]}


def category_levels(df: DataFrame, column: str, limit: int = MAX_TERMS) -> list[str]:
    """Sorted levels of a categorical predictor; more than ``limit`` is an error, as each is a model term."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} levels")
    return found


def impute_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls replaced by the column's exact median over all rows."""
    long = unpivot_values(df, [], columns, "__f", "__v")
    found = exact_quantiles(long, ["__f"], "__v", {"__m": 0.5})
    wide = found.agg(*[F.max(F.when(F.col("__f") == c, F.col("__m"))).alias(f"__med_{c}") for c in columns])
    held = with_totals(df, wide)
    return held.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__med_{c}")) for c in columns}).drop(*[f"__med_{c}" for c in columns])


# --- sums of products -----------------------------------------------------------


def _pairs(q: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(q) for j in range(i, q)]


def moment_names(p: int) -> list[str]:
    """Column names of the sums for p predictors plus the intercept."""
    q = p + 1
    return [f"__xx{i}_{j}" for i, j in _pairs(q)] + [f"__xy{i}" for i in range(q)] + ["__yy"]


def moments(df: DataFrame, keys: Sequence[str], predictors: Sequence[str], outcome: str) -> DataFrame:
    """Sums of products per key over complete rows, intercept first. Combines map-side."""
    if len(predictors) > MAX_TERMS:
        raise ValueError("too many model terms")
    rows = df.select(*keys, *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(predictors, 1)], F.col(outcome).cast("double").alias("__y")).na.drop(
        subset=[f"__x{i}" for i in range(1, len(predictors) + 1)] + ["__y"]
    )
    terms = [F.lit(1.0)] + [F.col(f"__x{i}") for i in range(1, len(predictors) + 1)]
    sums = [F.sum(terms[i] * terms[j]) for i, j in _pairs(len(terms))]
    sums += [F.sum(t * F.col("__y")) for t in terms] + [F.sum(F.col("__y") * F.col("__y"))]
    return rows.groupBy(*keys).agg(*[s.alias(n) for s, n in zip(sums, moment_names(len(predictors)))])


def _unpack(batch: pd.DataFrame, p: int):
    q = p + 1
    upper = np.triu_indices(q)
    xx = np.zeros((len(batch), q, q))
    for k, (i, j) in enumerate(zip(*upper)):
        xx[:, i, j] = xx[:, j, i] = batch[f"__xx{i}_{j}"].to_numpy(dtype=float)
    xy = np.stack([batch[f"__xy{i}"].to_numpy(dtype=float) for i in range(q)], axis=1)
    return xx, xy


def solve_ridge(sums: DataFrame, keys: Sequence[str], p: int, alpha: float = 0.0, scaled: bool = True) -> DataFrame:
    """Coefficients per key, intercept free. ``scaled``: the penalty acts on predictors divided by their population SD."""
    kinds = dict(sums.dtypes)
    keys = list(keys)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["n double", "coefficients array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xx, xy = _unpack(batch, p)
            out = batch[keys].copy()
            out["n"] = xx[:, 0, 0]
            betas = []
            for a, b in zip(xx, xy):
                n = a[0, 0]
                spread = np.diag(a)[1:] / n - (a[0, 1:] / n) ** 2 if n > 0 else np.ones(p)
                weights = np.where(spread > 1e-12, spread, 1.0) if scaled else np.ones(p)
                penalty = np.diag(np.concatenate([[0.0], alpha * weights]))
                betas.append(list(np.linalg.lstsq(a + penalty, b, rcond=None)[0]) if n > 0 else None)
            out["coefficients"] = betas
            yield out

    return sums.mapInPandas(run, schema)


def prediction(predictors: Sequence[str], coefficients: str = "coefficients") -> Column:
    total = F.get(coefficients, F.lit(0))
    for i, c in enumerate(predictors, 1):
        total = total + F.get(coefficients, F.lit(i)) * F.col(c).cast("double")
    return total


# --- residuals -------------------------------------------------------------------


def fit_residuals(df: DataFrame, outcome: str, predictors: Sequence[str], out: str, alpha: float = 1.0) -> DataFrame:
    """In-sample ridge residual. The fit is one row and reaches the rows as a scalar."""
    fit = solve_ridge(moments(df, [], predictors, outcome), [], len(predictors), alpha).select("coefficients")
    held = with_totals(df, fit)
    return held.withColumn(out, F.col(outcome).cast("double") - prediction(predictors)).select(*df.columns, out)


def leave_one_out_moments(df: DataFrame, unit: str, predictors: Sequence[str], outcome: str) -> DataFrame:
    """Per unit: the sums over all other units.

    The per-unit sums are stored, as the total and every unit read them; the rows are reduced once.
    """
    own = cut_lineage(moments(df, [unit], predictors, outcome))
    names = moment_names(len(predictors))
    total = own.agg(*[F.sum(n).alias(f"__t{n}") for n in names])
    held = with_totals(own, total)
    return held.select(unit, F.col("__xx0_0").alias("n_test_rows"), *[(F.col(f"__t{n}") - F.col(n)).alias(n) for n in names])


def cross_fitted_residuals(
    df: DataFrame, unit: str, outcome: str, predictors: Sequence[str], out: str, alpha: float = 1.0
) -> DataFrame:
    """Residual of each unit's rows under the ridge fit on all other units.

    Rows with a missing predictor or outcome are left out of the fits and have a
    null residual; scale factors of the penalty come from each fold's own sums.
    """
    sums = leave_one_out_moments(df, unit, predictors, outcome)
    fits = solve_ridge(sums, [unit], len(predictors), alpha).drop("n")
    joined = df.join(fits, unit, "left")
    return joined.withColumn(out, F.col(outcome).cast("double") - prediction(predictors)).drop("coefficients")


def cross_fit_diagnostics(df: DataFrame, unit: str, outcome: str, predictors: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """Rows trained and tested per held-out unit. Training never holds the unit's rows by construction."""
    sums = leave_one_out_moments(df, unit, predictors, outcome)
    return sums.select(
        F.col(unit).alias("heldout_id"), F.lit(outcome).alias("outcome"),
        F.col("__xx0_0").cast("long").alias("n_train_rows"), F.col("n_test_rows").cast("long").alias("n_test_rows"),
        F.lit(len(predictors)).alias("n_predictors"), F.lit(False).alias("train_contains_heldout"),
        F.lit(bool(set(predictors) & set(forbidden))).alias("uses_reader_group"),
    )


def cross_fitted_binary_residuals(df: DataFrame, unit: str, outcome: str, predictors: Sequence[str], out: str, penalty: float = 1.0) -> DataFrame:
    """Residual of a 0/1 outcome under the balanced logistic fit on all other units, and ``<out>_status`` of that fit.

    Rows with a missing predictor or outcome are left out of the fits and have a null residual.
    """
    from lectern.functions.numeric import sigmoid
    from lectern.operators.left_out import left_out_logistic

    fits = left_out_logistic(df, unit, outcome, predictors, penalty=penalty).withColumnRenamed("status", f"{out}_status")
    residual = F.col(outcome).cast("double") - sigmoid(prediction(predictors))
    return df.join(fits, unit, "left").withColumn(out, residual).select(*df.columns, out, f"{out}_status")


# --- standard errors --------------------------------------------------------------


def _p_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _ols_rows(fit: DataFrame, predictors: Sequence[str], meat: DataFrame, factor: Column | None) -> DataFrame:
    q = len(predictors) + 1
    terms = ["intercept", *predictors]
    both = with_totals(fit, meat)
    both = both.withColumn("__factor", factor if factor is not None else F.lit(1.0))
    schema = "term string, estimate double, std_error double, z double, p_value double, ci_low double, ci_high double, n_obs long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                beta = np.asarray(row["coefficients"], dtype=float)
                bread = np.asarray(row["__inverse"], dtype=float).reshape(q, q)
                core = np.zeros((q, q))
                for i, j in _pairs(q):
                    core[i, j] = core[j, i] = row[f"__meat{i}_{j}"]
                se = np.sqrt(np.maximum(np.diag(bread @ core @ bread) * row["__factor"], 0.0))
                z = np.divide(beta, se, out=np.zeros_like(beta), where=se > 0)
                yield pd.DataFrame(
                    {
                        "term": terms, "estimate": beta, "std_error": se, "z": z, "p_value": [_p_value(v) for v in z],
                        "ci_low": beta - 1.959963984540054 * se, "ci_high": beta + 1.959963984540054 * se, "n_obs": int(row["n"]),
                    }
                )

    return both.mapInPandas(run, schema)


def _ols_fit(df: DataFrame, predictors: Sequence[str], outcome: str) -> DataFrame:
    """One row: n, coefficients, inverse of X'X (flattened)."""
    p = len(predictors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            xx, xy = _unpack(batch, p)
            inverse = np.linalg.pinv(xx[0])
            yield pd.DataFrame({"n": [xx[0, 0, 0]], "coefficients": [list(inverse @ xy[0])], "__inverse": [list(inverse.ravel())]})

    return moments(df, [], predictors, outcome).mapInPandas(run, "n double, coefficients array<double>, __inverse array<double>")


def _complete(df: DataFrame, predictors: Sequence[str], outcome: str, keep: Sequence[str] = ()) -> DataFrame:
    """Complete rows as doubles."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in [*predictors, outcome]]).na.drop(subset=[*predictors, outcome])


def ols_hc3(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """OLS with HC3 errors in two aggregations: normal equations, then leverage-weighted squares."""
    rows = _complete(df, predictors, outcome)
    fit = _ols_fit(rows, predictors, outcome)
    held = with_totals(rows, fit)
    terms = [F.lit(1.0)] + [F.col(c) for c in predictors]
    q = len(terms)
    leverage = F.lit(0.0)
    for i, j in _pairs(q):
        leverage = leverage + (1.0 if i == j else 2.0) * F.get("__inverse", F.lit(i * q + j)) * terms[i] * terms[j]
    error = F.col(outcome) - prediction(predictors)
    scored = held.withColumn("__u2", (error / (1.0 - leverage)) * (error / (1.0 - leverage)))
    meat = scored.agg(*[F.sum(terms[i] * terms[j] * F.col("__u2")).alias(f"__meat{i}_{j}") for i, j in _pairs(q)])
    return _ols_rows(fit, predictors, meat, None)


def ols_clustered(df: DataFrame, outcome: str, predictors: Sequence[str], cluster: str) -> DataFrame:
    """OLS with cluster-robust errors: score sums per cluster, then their outer products."""
    rows = _complete(df, predictors, outcome, [cluster])
    fit = _ols_fit(rows, predictors, outcome)
    held = with_totals(rows, fit).withColumn("__e", F.col(outcome) - prediction(predictors))
    meat, clusters = _cluster_meat(held, predictors, cluster)
    q = len(predictors) + 1
    g, n = F.col("__clusters"), F.col("n")
    return _ols_rows(fit, predictors, meat, g / (g - 1) * (n - 1) / (n - q))


def _cluster_meat(held: DataFrame, predictors: Sequence[str], cluster: str):
    terms = [F.lit(1.0)] + [F.col(c) for c in predictors]
    q = len(terms)
    scores = held.groupBy(cluster).agg(*[F.sum(t * F.col("__e")).alias(f"__s{i}") for i, t in enumerate(terms)])
    meat = scores.agg(
        F.count(F.lit(1)).alias("__clusters"),
        *[F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")).alias(f"__meat{i}_{j}") for i, j in _pairs(q)],
    )
    return meat, scores


def logistic_clustered(df: DataFrame, outcome: str, predictors: Sequence[str], cluster: str, iterations: int = 100) -> DataFrame:
    """Binomial GLM with cluster-robust errors: distributed Newton fit, then one sandwich pass.

    The complete rows are stored, as the steps, the curvature and the scores of clusters each read them.
    """
    from lectern.functions.numeric import sigmoid
    from lectern.operators.learning import fit_linear_classifiers

    rows = cut_lineage(_complete(df, predictors, outcome, [cluster])).withColumn("__one", F.lit(1))
    fitted = fit_linear_classifiers(rows, ["__one"], predictors, outcome, penalty=0.0, iterations=iterations)
    held = with_totals(rows, fitted.select("coefficients")).withColumn("__p", sigmoid(prediction(predictors)))
    held = held.withColumns({"__e": F.col(outcome) - F.col("__p"), "__w": F.col("__p") * (1 - F.col("__p"))})
    terms = [F.lit(1.0)] + [F.col(c) for c in predictors]
    q = len(terms)
    hessian = held.agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(F.col("__w") * terms[i] * terms[j]).alias(f"__h{i}_{j}") for i, j in _pairs(q)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                h = np.zeros((q, q))
                for i, j in _pairs(q):
                    h[i, j] = h[j, i] = row[f"__h{i}_{j}"]
                yield pd.DataFrame({"n": [row["n"]], "coefficients": [row["coefficients"]], "__inverse": [list(np.linalg.pinv(h).ravel())]})

    fit = with_totals(hessian, fitted.select("coefficients")).mapInPandas(run, "n double, coefficients array<double>, __inverse array<double>")
    meat, _ = _cluster_meat(held, predictors, cluster)
    g = F.col("__clusters")
    return _ols_rows(fit, predictors, meat, g / (g - 1) * (F.col("n") - 1) / (F.col("n") - q))


# --- association models ------------------------------------------------------------


def association_model(
    df: DataFrame, outcome: str, predictors: Sequence[str], unit: str, *, group: str | None = None,
    categorical: str | None = None, draws: int = 12, seed: int = 17, alpha: float = 1.0,
) -> DataFrame:
    """Ridge on z-scored predictors, optional group interactions and category dummies, with a unit bootstrap.

    The bootstrap reweights per-unit sums by how often a unit is drawn, so the
    rows are read once however many draws there are. z-scales stay those of the
    full data in every draw.
    """
    keep = [unit, outcome, *predictors, *([group] if group else []), *([categorical] if categorical else [])]
    base = zscored(df.select(*dict.fromkeys(keep)).where(F.col(outcome).isNotNull()), list(predictors))
    columns = [f"{p}_z" for p in predictors]
    added: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns}
    if group:
        g = F.coalesce(F.col(group).cast("double"), F.lit(0.0))
        added |= {f"{group}_main": g, **{f"{group}_x_{c}": g * F.coalesce(F.col(c), F.lit(0.0)) for c in columns}}
    if categorical:
        added |= dummy_columns(categorical, category_levels(df, categorical))
    terms = list(added)
    ready = base.withColumns(added)
    names = moment_names(len(terms))
    per_unit = cut_lineage(moments(ready, [unit], terms, outcome))
    whole = solve_ridge(per_unit.agg(*[F.sum(n).alias(n) for n in names]), [], len(terms), alpha, scaled=False)
    drawn = bootstrap_weights(per_unit, unit, draws, seed, names)
    redrawn = drawn.groupBy("iteration").agg(*[F.sum(F.col("weight") * F.col(n)).alias(n) for n in names])
    fits = solve_ridge(redrawn, ["iteration"], len(terms), alpha, scaled=False)

    def by_term(fit: DataFrame, keys: Sequence[str]) -> DataFrame:
        items = F.array(*[F.struct(F.lit(t).alias("term"), F.get("coefficients", F.lit(i)).alias("estimate")) for i, t in enumerate(["intercept", *terms])])
        return fit.select(*keys, "n", F.explode(items).alias("t")).select(*keys, "n", "t.*")

    spread = by_term(fits, ["iteration"])
    limits = exact_quantiles(spread, ["term"], "estimate", {"ci_low": 0.025, "ci_high": 0.975}, bars=2)
    b = F.col("estimate")
    errors = spread.groupBy("term").agg(
        F.stddev_samp(b).alias("std_error"), F.count(b).alias("n_bootstrap"),
        F.least(F.lit(1.0), 2 * F.least(F.avg((b <= 0).cast("int")), F.avg((b >= 0).cast("int")))).alias("p_value"),
    )
    point = by_term(whole, []).withColumnsRenamed({"n": "n_obs"})
    return point.join(errors, "term", "left").join(limits, "term", "left").select(
        F.lit(outcome).alias("outcome"), "term", "estimate", "std_error", "p_value", "ci_low", "ci_high", "n_bootstrap",
        F.col("n_obs").cast("long").alias("n_obs"), F.lit("ridge_linear_regression").alias("model_type"),
    )


def association_models(df: DataFrame, outcomes: Sequence[str], predictors: Sequence[str], unit: str, **options) -> DataFrame:
    """The same association model for several outcomes, stacked."""
    parts = [association_model(df, outcome, predictors, unit, **options) for outcome in outcomes]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- random intercept ----------------------------------------------------------------


def random_intercept(df: DataFrame, outcome: str, predictors: Sequence[str], unit: str, rounds: int = 3, points: int = 25) -> DataFrame:
    """Maximum-likelihood linear model with a random intercept per unit.

    With theta = var(unit) / var(error) the likelihood needs only per-unit sums.
    Each round evaluates a grid of thetas for all units in one aggregation and
    narrows the grid around the best.
    """
    p, q = len(predictors), len(predictors) + 1
    names = moment_names(p)
    sums = moments(df, [unit], predictors, outcome).persist()
    n = F.col("__xx0_0")
    low, high = 1e-4, 1e4
    best = None
    for _ in range(rounds):
        grid = np.geomspace(low, high, points)
        shrunk = sums.withColumn("theta", F.explode(F.array(*[F.lit(float(v)) for v in grid])))
        shrink = F.col("theta") / (1.0 + F.col("theta") * n)
        first = [F.col(f"__xx0_{i}") for i in range(q)]
        weighted = [F.sum(F.col(f"__xx{i}_{j}") - shrink * first[i] * first[j]).alias(f"__xx{i}_{j}") for i, j in _pairs(q)]
        weighted += [F.sum(F.col(f"__xy{i}") - shrink * first[i] * F.col("__xy0")).alias(f"__xy{i}") for i in range(q)]
        weighted.append(F.sum(F.col("__yy") - shrink * F.col("__xy0") * F.col("__xy0")).alias("__yy"))
        table = shrunk.groupBy("theta").agg(*weighted, F.sum(F.log1p(F.col("theta") * n)).alias("__logdet"), F.sum(n).alias("__n"), F.count(F.lit(1)).alias("__units"))
        tried = []
        for row in table.toPandas().to_dict("records"):  # one row per grid point
            a, b = np.zeros((q, q)), np.array([row[f"__xy{i}"] for i in range(q)])
            for i, j in _pairs(q):
                a[i, j] = a[j, i] = row[f"__xx{i}_{j}"]
            beta = np.linalg.lstsq(a, b, rcond=None)[0]
            rss = max(row["__yy"] - b @ beta, 1e-12)
            total = row["__n"]
            variance = rss / total
            loglik = -0.5 * (total * math.log(2 * math.pi * variance) + row["__logdet"] + total)
            tried.append((loglik, row["theta"], beta, variance, np.linalg.pinv(a) * variance, total, row["__units"]))
        best = max(tried, key=lambda r: r[0])
        step = (high / low) ** (1.0 / (points - 1))
        low, high = best[1] / step, best[1] * step
    sums.unpersist()
    loglik, theta, beta, variance, covariance, total, units = best
    se = np.sqrt(np.diag(covariance))
    rows = [
        (t, float(b), float(s), _p_value(b / s) if s > 0 else None, int(total), int(units), float(variance), float(theta * variance), float(loglik),
         "random_intercept_ml")
        for t, b, s in zip(["intercept", *predictors], beta, se)
    ]
    return df.sparkSession.createDataFrame(
        rows, "term string, estimate double, std_error double, p_value double, n_obs long, n_units long, residual_variance double, "
        "unit_variance double, log_likelihood double, model_type string",
    )


def mixed_effects(df: DataFrame, hypotheses: dict[str, dict], unit: str, minimum_units: int = 2) -> DataFrame:
    """One coefficient table over several named models; what cannot be fitted is a row with its reason.

    A model that fails falls back to OLS with HC3 errors.
    """
    schema = "hypothesis string, status string, reason string, model_type string, term string, estimate double, p_value double, n_obs long"
    spark = df.sparkSession
    parts = []

    def note(name, status, reason):
        return spark.createDataFrame([(name, status, reason, None, None, None, None, None)], schema)

    for name, spec in hypotheses.items():
        outcome, fixed = spec["outcome"], list(spec["fixed_effects"])
        bases = sorted({b for term in fixed for b in term.split(":")})
        missing = sorted({outcome, unit, *bases} - set(df.columns))
        if missing:
            parts.append(note(name, "skipped", f"missing_columns:{missing}"))
            continue
        products = {}
        for term in fixed:
            column = F.lit(1.0)
            for b in term.split(":"):
                column = column * F.col(b).cast("double")
            products[term.replace(":", "_x_")] = column
        rows = df.select(unit, F.col(outcome).cast("double").alias("__outcome"), *[c.alias(t) for t, c in products.items()]).na.drop()
        if rows.select(unit).distinct().limit(minimum_units).count() < minimum_units:
            parts.append(note(name, "skipped", "insufficient_complete_cases"))
            continue
        terms = list(products)
        try:
            fit, status, reason = random_intercept(rows, "__outcome", terms, unit), "complete", ""
        except np.linalg.LinAlgError as exc:
            fit, status, reason = ols_hc3(rows, "__outcome", terms).withColumn("model_type", F.lit("robust_ols_hc3")), "fallback_complete", str(exc)
        parts.append(
            fit.select(
                F.lit(name).alias("hypothesis"), F.lit(status).alias("status"), F.lit(reason).alias("reason"), "model_type", "term",
                "estimate", "p_value", "n_obs",
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
