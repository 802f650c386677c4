"""Queries over residuals, association models, grouped evaluation and decision tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lectern.operators import contracts, fold_fits, learning, linear, metrics, panel, participants, profiles, reports, splits
from lectern.plans import panels
from lectern.queries.evaluation import METRIC_FLOATS, metric_sql
from lectern.queries.readers import OVERLAP, exposed_readers
from lectern.queries.registry import Tables, query
from lectern.queries.sql import PANEL, sql_held_out, sql_newton, sql_slope, sql_training, with_panel

OUTCOME, X = "log_total_fixation_duration", "word_length_chars"


def complete_rows(t: Tables):
    return panels.word_level(t)


_FIT = f"""use AS (SELECT participant_id, word_id, {X}::DOUBLE AS x, {OUTCOME} AS y FROM word_level WHERE {OUTCOME} IS NOT NULL AND {X} IS NOT NULL)"""


@query(
    "m02_in_sample_residuals",
    with_panel(f""", {_FIT}, f AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS v, covar_pop(x, y) AS c FROM use),
b AS (SELECT c * n / (v * (n + 1)) AS b, my - c * n / (v * (n + 1)) * mx AS a FROM f)
SELECT participant_id, word_id, {OUTCOME} - (a + b * {X}) AS trt_residual FROM word_level, b"""),
    floats="trt_residual",
)
def in_sample_residuals(t: Tables):
    """Ridge (alpha 1, SD-scaled) residual of log TRT on word length."""
    return linear.fit_residuals(complete_rows(t), OUTCOME, [X], "trt_residual").select("participant_id", "word_id", "trt_residual")


_LEFT_OUT = f"""{_FIT}, own AS (SELECT participant_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM use GROUP BY 1),
tot AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM own),
lo AS (SELECT participant_id, own.n AS own_n, (tot.n - own.n)::DOUBLE AS n, tot.sx - own.sx AS sx, tot.sy - own.sy AS sy, tot.sxx - own.sxx AS sxx, tot.sxy - own.sxy AS sxy FROM own, tot),
fit AS (SELECT *, (sxy - sx * sy / n) / ((sxx / n - (sx / n) ** 2) * (n + 1)) AS b FROM lo),
crossfit AS (SELECT w.*, {OUTCOME} - (sy / n - b * sx / n + b * {X}) AS r FROM word_level w LEFT JOIN fit USING (participant_id))"""


@query("m04_cross_fitted_residuals", with_panel(f", {_LEFT_OUT} SELECT participant_id, word_id, r AS crossfit_trt_residual FROM crossfit"), floats="crossfit_trt_residual")
def cross_fitted_residuals(t: Tables):
    """Each reader's residual under the fit on all other readers."""
    out = linear.cross_fitted_residuals(complete_rows(t), "participant_id", OUTCOME, [X], "crossfit_trt_residual")
    return out.select("participant_id", "word_id", "crossfit_trt_residual")


@query(
    "m04_cross_fit_diagnostics",
    with_panel(f", {_LEFT_OUT} SELECT participant_id AS heldout_id, '{OUTCOME}' AS outcome, n::BIGINT AS n_train_rows, own_n AS n_test_rows, 1 AS n_predictors, false AS train_contains_heldout, false AS uses_reader_group FROM lo"),
)
def cross_fit_diagnostics(t: Tables):
    """Training and test sizes per held-out reader."""
    return linear.cross_fit_diagnostics(complete_rows(t), "participant_id", OUTCOME, [X], contracts.LEAKAGE_COLUMNS)


PREDICTORS = ["word_length_chars", "log_corpus_frequency", "lm_word_surprisal", "lm_word_entropy", "sentence_length_words", "word_position_in_sentence_norm", "vv_indicator"]


@query("m04_cross_fitted_many_predictors")
def cross_fitted_many(t: Tables):
    """Seven predictors and text dummies, median-imputed; mean squared residual per reader."""
    from lectern.session import cut_lineage

    raw = cut_lineage(complete_rows(t).select("participant_id", "text_id", OUTCOME, *PREDICTORS))
    rows = cut_lineage(linear.impute_medians(raw, PREDICTORS))  # medians, levels, sums and residuals each read the rows
    dummies = linear.dummy_columns("text_id", linear.category_levels(rows, "text_id"))
    out = linear.cross_fitted_residuals(rows.withColumns(dummies), "participant_id", OUTCOME, [*PREDICTORS, *dummies], "r")
    return out.groupBy("participant_id").agg(F.avg(F.col("r") * F.col("r")).alias("mean_squared_residual"), F.count("r").alias("rows"))


_SKIP_ON = ["word_length_chars", "log_corpus_frequency", "lm_word_surprisal", "sentence_length_words"]


def _left_out_skip(columns: list[str], name: str) -> str:
    """CTE ``<name>(participant_id, b0..)``: balanced logistic fits of skipping without each reader, refitted one by one."""
    z = ", ".join(f"{c}::DOUBLE AS z{i}" for i, c in enumerate(columns, 1))
    sd = ", ".join(f"stddev_pop(z{i}) AS s{i}" for i in range(1, len(columns) + 1))
    scaled = ", ".join(f"z{i} / s{i} AS z{i}" for i in range(1, len(columns) + 1))
    back = ", ".join(["b0", *[f"b{i} / s{i} AS b{i}" for i in range(1, len(columns) + 1)]])
    return f"""{name}_use AS MATERIALIZED (SELECT participant_id, skip AS y, {z} FROM word_level WHERE skip IN (0, 1) AND {" AND ".join(f"{c} IS NOT NULL" for c in columns)}),
{name}_all AS MATERIALIZED (SELECT r.fit, u.* FROM {name}_use AS u JOIN (SELECT DISTINCT participant_id AS fit FROM {name}_use) AS r ON r.fit <> u.participant_id),
{name}_sd AS MATERIALIZED (SELECT fit, count(*) AS n, sum(y) AS n1, {sd} FROM {name}_all GROUP BY fit),
{name}_tz AS MATERIALIZED (SELECT fit, y, n / (2.0::DOUBLE * CASE WHEN y = 1 THEN n1 ELSE n - n1 END) AS w, {scaled} FROM {name}_all JOIN {name}_sd USING (fit)),
{sql_newton(f'{name}_tz', len(columns), keys='fit', steps=7, name=f'{name}_coef')},
{name} AS (SELECT fit AS participant_id, {back} FROM {name}_coef JOIN {name}_sd USING (fit))"""


@query(
    "m03_m04_binary_residuals",
    f"""WITH RECURSIVE {PANEL}, {_left_out_skip(_SKIP_ON, 'lo')}
SELECT participant_id, avg(r) AS mean_skip_residual, stddev_samp(r) AS sd_skip_residual, count(r) AS rows, 'converged' AS status FROM (
  SELECT participant_id, skip - 1 / (1 + exp(-(b0 + {" + ".join(f"b{i} * {c}" for i, c in enumerate(_SKIP_ON, 1))}))) AS r FROM word_level JOIN lo USING (participant_id)) GROUP BY 1""",
    floats="mean_skip_residual sd_skip_residual",
)
def binary_residuals(t: Tables):
    """Skipping residuals under balanced logistic fits on all other readers."""
    out = linear.cross_fitted_binary_residuals(complete_rows(t), "participant_id", "skip", _SKIP_ON, "r")
    sums = [F.avg("r").alias("mean_skip_residual"), F.stddev_samp("r").alias("sd_skip_residual"), F.count("r").alias("rows"), F.max("r_status").alias("status")]
    return out.groupBy("participant_id").agg(*sums)


_SLOPES = {"surprisal": "lm_word_surprisal", "entropy": "lm_word_entropy", "word_length": "word_length_chars", "boundary_opacity": "prev_boundary_opacity_score"}
_R = "crossfit_trt_residual"
#: Residuals by the outcome they are of; skipping is the binary one.
_OUTCOMES = {
    "ffd": "log_ffd", "first_pass": "log_first_pass_duration", "go_past": "log_go_past_time", "total_fixation": "log_total_fixation_duration",
    "fixation_count": "fixation_count", "skipping": "skip",
}
_RESIDUALS = [f"crossfit_{n}_residual" for n in _OUTCOMES]


def _left_out_residual(name: str, outcome: str) -> str:
    """CTE ``res_<name>``: residuals of a continuous outcome on word length, fitted without the reader."""
    if outcome == "skip":
        return f"""{_left_out_skip([X], 'lo')},
res_{name} AS (SELECT participant_id, word_id, skip - 1 / (1 + exp(-(b0 + b1 * {X}))) AS crossfit_{name}_residual FROM word_level JOIN lo USING (participant_id))"""
    cte = _LEFT_OUT.replace(OUTCOME, outcome)
    for part in ("use", "own", "tot", "lo", "fit", "crossfit"):
        cte = re.sub(rf"\b{part}\b(?! JOIN)", f"{part}_{name}", cte)
    return f"{cte}, res_{name} AS (SELECT participant_id, word_id, r AS crossfit_{name}_residual FROM crossfit_{name})"


def _profile_sql(r: str) -> str:
    slopes = ", ".join(f"{sql_slope(r, c, 5)} AS {r}_{n}_slope" for n, c in _SLOPES.items())
    return f"""avg({r}) AS {r}_mean, stddev_samp({r}) AS {r}_sd, median({r}) AS {r}_median, {slopes},
  avg({r}) FILTER (WHERE prev_boundary_opacity_score = 3) - avg({r}) FILTER (WHERE prev_boundary_opacity_score IS DISTINCT FROM 3) AS {r}_high_opacity_cost,
  avg({r}) FILTER (WHERE vv_indicator = 1) - avg({r}) FILTER (WHERE vv_indicator = 0) AS {r}_vv_cost"""


@query(
    "a28_a29_residual_profiles",
    f"""WITH RECURSIVE {PANEL}, {", ".join(_left_out_residual(n, c) for n, c in _OUTCOMES.items())},
rs AS (SELECT * FROM word_level {" ".join(f"JOIN res_{n} USING (participant_id, word_id)" for n in _OUTCOMES)})
SELECT participant_id, {", ".join(_profile_sql(r) for r in _RESIDUALS)}, avg(word_length_chars) AS mean_word_length_exposure, avg(lm_word_surprisal) AS mean_surprisal_exposure FROM rs GROUP BY 1""",
    floats=" ".join([f"{r}_{s}" for r in _RESIDUALS for s in ("mean", "sd", "median", "high_opacity_cost", "vv_cost", *[f"{n}_slope" for n in _SLOPES])] + ["mean_word_length_exposure mean_surprisal_exposure"]),
)
def residual_profiles(t: Tables):
    """Cross-fitted residual profiles of each reader over six outcomes."""
    from lectern.session import cut_lineage

    rows = cut_lineage(complete_rows(t).select("participant_id", "word_id", *dict.fromkeys([*_OUTCOMES.values(), X, *_SLOPES.values(), "vv_indicator"])))
    largest = rows.groupBy("participant_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for name, outcome in _OUTCOMES.items():
        fit = linear.cross_fitted_binary_residuals if outcome == "skip" else linear.cross_fitted_residuals
        rows = fit(rows, "participant_id", outcome, [X], f"crossfit_{name}_residual")
    exposures = {"mean_word_length_exposure": "word_length_chars", "mean_surprisal_exposure": "lm_word_surprisal"}
    return profiles.residual_profiles(rows, "participant_id", _RESIDUALS, _SLOPES, exposures=exposures, parts=panels.tasks(t), largest=largest)


@query(
    "j16_combined_profiles",
    with_panel("""SELECT participant_id, mean_trt, mean_ffd, label, age FROM (SELECT participant_id, avg(TRT) AS mean_trt FROM word_level GROUP BY 1)
JOIN (SELECT participant_id, avg(FFD) AS mean_ffd FROM word_level GROUP BY 1) USING (participant_id) JOIN people USING (participant_id)"""),
    floats="mean_trt mean_ffd",
)
def combined_profiles(t: Tables):
    """Two profile tables beside selected reader columns."""
    rows = complete_rows(t)
    a = rows.groupBy("participant_id").agg(F.avg("TRT").alias("mean_trt"))
    b = rows.groupBy("participant_id").agg(F.avg("FFD").alias("mean_ffd"))
    return profiles.combine_profiles(a, b, panels.participants(t), "participant_id", ["label", "age", "no_such_column"])


_SIMPLE = f"""{_FIT}, m AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy FROM use),
e AS (SELECT participant_id, x - mx AS d, mx, sxx, n, y - my - sxy / sxx * (x - mx) AS e, 1 - 1 / n - (x - mx) ** 2 / sxx AS g FROM use, m)"""


@query(
    "m16_ols_hc3",
    with_panel(f""", {_SIMPLE}, s AS (SELECT sqrt(sum((d / sxx * e / g) ** 2)) AS b, sqrt(sum(((1 / n - mx * d / sxx) * e / g) ** 2)) AS a FROM e)
SELECT 'intercept' AS term, my - sxy / sxx * mx AS estimate, a AS std_error, n::BIGINT AS n_obs FROM m, s UNION ALL SELECT '{X}', sxy / sxx, b, n::BIGINT FROM m, s"""),
    floats="estimate std_error",
)
def ols_hc3(t: Tables):
    """OLS of log TRT on word length with HC3 errors."""
    return linear.ols_hc3(complete_rows(t), OUTCOME, [X]).select("term", "estimate", "std_error", "n_obs")


@query(
    "m17_clustered_ols",
    with_panel(f""", {_SIMPLE}, c AS (SELECT sum(d / sxx * e) AS b, sum((1 / n - mx * d / sxx) * e) AS a FROM e GROUP BY participant_id),
s AS (SELECT sqrt(sum(b ** 2) * count(*) / (count(*) - 1)) AS b, sqrt(sum(a ** 2) * count(*) / (count(*) - 1)) AS a FROM c)
SELECT 'intercept' AS term, my - sxy / sxx * mx AS estimate, a * sqrt((n - 1) / (n - 2)) AS std_error, n::BIGINT AS n_obs FROM m, s
UNION ALL SELECT '{X}', sxy / sxx, b * sqrt((n - 1) / (n - 2)), n::BIGINT FROM m, s"""),
    floats="estimate std_error",
)
def clustered_ols(t: Tables):
    """The same fit with reader-clustered errors."""
    return linear.ols_clustered(complete_rows(t), OUTCOME, [X], "participant_id").select("term", "estimate", "std_error", "n_obs")


def interaction_rows(t: Tables):
    """z-scored predictors, group interactions and text fixed effects."""
    from lectern.operators.scalars import zscored

    base = zscored(complete_rows(t).where("label IS NOT NULL"), ["word_length_chars", "lm_word_surprisal", "prev_boundary_opacity_score"])
    z = ["word_length_chars_z", "lm_word_surprisal_z", "prev_boundary_opacity_score_z"]
    dummies = linear.dummy_columns("text_id", linear.category_levels(base, "text_id"))
    rows = base.withColumns({**{f"group_x_{c}": F.col("label_num") * F.col(c) for c in z}, **dummies})
    return rows, ["label_num", *z, *[f"group_x_{c}" for c in z], *dummies]


@query("m17_confirmatory_interactions")
def confirmatory_interactions(t: Tables):
    """Group interactions with text fixed effects and reader-clustered errors."""
    rows, terms = interaction_rows(t)
    return linear.ols_clustered(rows, OUTCOME, terms, "participant_id")


@query("m18_clustered_logistic")
def clustered_logistic(t: Tables):
    """Skipping on word length and group with reader-clustered errors."""
    rows = complete_rows(t).where("label IS NOT NULL")
    return linear.logistic_clustered(rows, "skip", ["word_length_chars", "label_num"], "participant_id")


@query("m14_association_model")
def association_model(t: Tables):
    """Ridge association model with group interactions and reader bootstrap."""
    return linear.association_model(complete_rows(t), OUTCOME, ["word_length_chars", "lm_word_surprisal"], "participant_id", group="label_num", categorical="text_id")


@query("m15_association_model_set")
def association_model_set(t: Tables):
    """The segmentation model over three outcomes."""
    outcomes = ["log_ffd", "log_first_pass_duration", OUTCOME]
    return linear.association_models(complete_rows(t), outcomes, ["prev_boundary_opacity_score", "vv_indicator", "word_length_chars"], "participant_id")


@query("m19_random_intercept")
def random_intercept(t: Tables):
    """Mixed model hypotheses with a reader intercept, one of them not fittable."""
    hypotheses = {
        "length": {"outcome": "TRT", "fixed_effects": ["word_length_chars", "label_num", "word_length_chars:label_num"]},
        "regression": {"outcome": "regression_in", "fixed_effects": ["word_length_chars"]},
    }
    return linear.mixed_effects(complete_rows(t), hypotheses, "participant_id")


# --- grouped evaluation -----------------------------------------------------------

READER_FEATURES = ["mean_ffd", "mean_trt", "skipping_rate", "trt_sd", "length_sensitivity", "surprisal_sensitivity"]
GROUPS_OF_FEATURES = {
    "raw_gaze": ["mean_ffd", "mean_trt", "skipping_rate", "trt_sd"],
    "sensitivity": ["length_sensitivity", "surprisal_sensitivity"],
    "all": READER_FEATURES,
}
MODELS = ["logistic_regression", "linear_svm"]


def reader_table(t: Tables):
    """Reader aggregates computed once and stored, as every fit reads them."""
    from lectern.session import cut_lineage

    rows = panel.reader_means(complete_rows(t)).where("label IS NOT NULL")
    return cut_lineage(rows.select("participant_id", F.col("label").cast("int").alias("label"), *READER_FEATURES))


def five_folds(readers, k: int = 5):
    return splits.assign_grouped_folds(readers, "participant_id", "label", k, 17)


#: The reader table with its folds and ranks, and the fits of two splits of it.
_READERS = f"""rt AS MATERIALIZED (SELECT participant_id AS key, max(label) AS y, avg(FFD) AS mean_ffd, avg(TRT) AS mean_trt, avg(skip) AS skipping_rate, stddev_samp(TRT) AS trt_sd,
  {sql_slope('TRT', 'word_length_chars')} AS length_sensitivity, {sql_slope('TRT', 'lm_word_surprisal')} AS surprisal_sensitivity FROM word_level GROUP BY 1 HAVING max(label) IS NOT NULL)"""


def _placed(rows: str = "rt") -> str:
    """Folds and ranks of the keys of ``rows``."""
    return f"""kh AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('17|' || key)) - 1 AS i FROM (SELECT DISTINCT key, y FROM {rows})),
kn AS (SELECT greatest(2, least(5, sum(n), CASE WHEN count(*) > 1 THEN min(n) ELSE 1 END))::INT AS k FROM (SELECT count(*) AS n FROM kh GROUP BY y)),
kp AS MATERIALIZED (SELECT key, (i % k)::INT AS fold, (row_number() OVER (ORDER BY key) - 1)::INT AS unit FROM kh, kn)"""


_KFOLD = """SELECT 'participant_grouped_kfold' AS split, kp.fold, -2 AS unit, {rows}.* FROM {rows} JOIN kp USING (key)"""
_LOO = """SELECT 'leave_one_participant_out' AS split, -2 AS fold, kp.unit, rt.* FROM rt JOIN kp USING (key)"""
_KFITS = "SELECT DISTINCT 'k' || fold AS fit, 'participant_grouped_kfold' AS split, fold, -1 AS unit FROM kp"
_LFITS = "SELECT 'u' || unit AS fit, 'leave_one_participant_out' AS split, -1 AS fold, unit FROM kp"


def _evaluated(rows: str, fits: str, features: list[str], groups: dict, models: list[str] = MODELS, steps: int = 12) -> str:
    """CTEs from placed rows and fits to ``mt``, the metrics by model, split and group."""
    tasks = {"logistic_regression": ("logistic", steps), "linear_svm": ("hinge", 30)}
    fitted = ", ".join(sql_newton("tz", len(features), tasks[m][0], steps=tasks[m][1], name=f"coef_{m}") for m in models)
    held = " UNION ALL ".join(f"SELECT {m!r} AS model, ft.split AS split_name, g AS feature_group, y_true, y_score FROM ({sql_held_out('rw', features, groups, f'coef_{m}')}) JOIN ft USING (fit)" for m in models)
    return f"""rw AS MATERIALIZED ({rows}), ft AS MATERIALIZED ({fits}), {sql_training('rw', features, groups)}, {fitted}, pred AS MATERIALIZED ({held}),
{metric_sql('pred', 'model, split_name, feature_group')}"""


_FITS_OF = """SELECT mt.*, usable_folds, skipped_folds, 'complete' AS status, CASE WHEN skipped_folds = 0 THEN 'all_test_predictions_generated' ELSE 'some_folds_skipped' END AS fold_validity
FROM mt JOIN (SELECT split AS split_name, count(*) FILTER (WHERE n1 > 0 AND n1 < n)::INT AS usable_folds, count(*) FILTER (WHERE NOT (n1 > 0 AND n1 < n))::INT AS skipped_folds FROM ft JOIN sz USING (fit) GROUP BY 1) USING (split_name)"""

_BALANCED = """SELECT 'text_balanced_sensitivity_lopo' AS split, -2 AS fold, kb.unit, rt.* FROM rt JOIN kb USING (key)"""
_BFITS = "SELECT 'b' || unit AS fit, 'text_balanced_sensitivity_lopo' AS split, -1 AS fold, unit FROM kb"


@query(
    "m06_m09_grouped_evaluation",
    OVERLAP.replace("WITH", "WITH RECURSIVE", 1) + f""", {_READERS}, {_placed()}, kb AS MATERIALIZED (SELECT participant_id AS key, (row_number() OVER (ORDER BY participant_id) - 1)::INT AS unit FROM kept),
{_evaluated(" UNION ALL ".join([_KFOLD.format(rows="rt"), _LOO, _BALANCED]), " UNION ALL ".join([_KFITS, _LFITS, _BFITS]), READER_FEATURES, GROUPS_OF_FEATURES)} {_FITS_OF}""",
    floats=METRIC_FLOATS,
)
def grouped_evaluation(t: Tables):
    """Feature groups by linear models over three splits of readers: one metric row each, pooled over folds."""
    readers = reader_table(t)
    alike = participants.exposure_overlap(exposed_readers(t), "reader_group", ["n_words_read", "n_word_rows"])
    assigned = {
        "participant_grouped_kfold": five_folds(readers),
        "leave_one_participant_out": splits.assign_leave_one_out(readers, "participant_id"),
        "text_balanced_sensitivity_lopo": splits.assign_leave_one_out(alike, "participant_id"),
    }
    return learning.ablation_grid(readers, assigned, "participant_id", GROUPS_OF_FEATURES, "label", MODELS)


@query(
    "m20_leave_one_out_logistic",
    f"WITH RECURSIVE {PANEL}, {_READERS}, {_placed()}, {_evaluated(_LOO, _LFITS, READER_FEATURES, {'all': READER_FEATURES}, ['logistic_regression'])} SELECT * EXCLUDE (model, split_name) FROM mt",
    floats=METRIC_FLOATS,
)
def leave_one_out_logistic(t: Tables):
    """Leave-one-reader-out logistic regression on reader aggregates."""
    readers = reader_table(t)
    scored, _ = learning.cross_validate(readers, splits.assign_leave_one_out(readers, "participant_id"), "participant_id", READER_FEATURES, "label")
    return metrics.binary_metrics(scored, ["feature_group"])


_REMOVED = """SELECT 'k' || fold || 'u' || unit AS fit, 'r' AS split, fold, unit FROM (SELECT DISTINCT fold FROM kp), (SELECT unit FROM kp UNION ALL SELECT -1)"""


@query(
    "m12_influence_refits",
    f"""WITH RECURSIVE {PANEL}, {_READERS}, {_placed()}, rw AS MATERIALIZED (SELECT 'r' AS split, kp.fold, kp.unit, rt.* FROM rt JOIN kp USING (key)), ft AS MATERIALIZED ({_REMOVED}),
{sql_training('rw', READER_FEATURES, {'all': READER_FEATURES})}, {sql_newton('tz', len(READER_FEATURES), steps=10)},
pred AS MATERIALIZED (SELECT ft.unit AS removed, y_true, y_score FROM ({sql_held_out('rw', READER_FEATURES, {'all': []})}) JOIN ft USING (fit)), {metric_sql('pred', 'removed')}
SELECT kp.key AS removed_id, rt.y AS removed_label, mt.roc_auc, mt.pr_auc, mt.roc_auc - full_.roc_auc AS delta_roc_auc, 'complete' AS status
FROM mt JOIN kp ON kp.unit = removed JOIN rt USING (key), (SELECT roc_auc FROM mt WHERE removed = -1) AS full_""",
    floats="roc_auc pr_auc delta_roc_auc",
)
def influence_refits(t: Tables):
    """Grouped evaluation over five folds refitted without each reader, and the AUC change."""
    readers = reader_table(t)
    return learning.influence_refits(readers, five_folds(readers), "participant_id", READER_FEATURES, "label")


@query("m10_permutation_refits")
def permutation_refits(t: Tables):
    """A thousand label deals, the models of all five folds refitted for each."""
    readers = reader_table(t)
    return learning.permutation_refits(readers, five_folds(readers), "participant_id", READER_FEATURES, "label", permutations=1000)


@query(
    "m13_a30_coefficient_stability",
    f"""WITH RECURSIVE {PANEL}, {_READERS}, {_placed()}, rw AS MATERIALIZED ({_KFOLD.format(rows="rt")}), ft AS MATERIALIZED ({_KFITS}), {sql_training('rw', READER_FEATURES, GROUPS_OF_FEATURES)}, {sql_newton('tz', len(READER_FEATURES))},
cf AS (SELECT g AS feature_group, fit AS fold_id, unnest({[c for c in READER_FEATURES]!r}) AS feature, unnest([{', '.join(f'b{i}' for i in range(1, len(READER_FEATURES) + 1))}]) AS coefficient FROM coef)
SELECT feature_group, feature, avg(coefficient) AS mean_coefficient, stddev_samp(coefficient) AS sd_coefficient, count(fold_id) AS n_folds, avg((coefficient > 0)::INT) AS positive_rate, avg((coefficient < 0)::INT) AS negative_rate,
  greatest(avg((coefficient > 0)::INT), avg((coefficient < 0)::INT)) AS sign_stability, abs(avg(coefficient)) AS abs_mean_coefficient FROM cf
WHERE {" OR ".join(f"feature_group = {n!r} AND feature IN ({', '.join(map(repr, cols))})" for n, cols in GROUPS_OF_FEATURES.items())} GROUP BY 1, 2""",
    floats="mean_coefficient sd_coefficient positive_rate negative_rate sign_stability abs_mean_coefficient",
)
def coefficient_stability(t: Tables):
    """Coefficients per fold and their stability."""
    readers = reader_table(t)
    _, fitted = learning.cross_validate(readers, five_folds(readers), "participant_id", READER_FEATURES, "label", groups=GROUPS_OF_FEATURES)
    return reports.coefficient_stability(fold_fits.coefficient_rows(fitted, GROUPS_OF_FEATURES).where("status <> 'skipped'").drop("status"))


_COEF = with_panel(", cf AS (SELECT 'slopes' AS feature_group, participant_id AS fold_id, feature, coefficient FROM ("
    + " UNION ALL ".join(f"SELECT participant_id, '{f}' AS feature, {sql_slope('TRT', f, 5)} AS coefficient FROM word_level GROUP BY 1" for f in ("word_length_chars", "lm_word_surprisal", "log_corpus_frequency")) + ")) ")
_STABLE = """SELECT feature_group, feature, avg(coefficient) AS mean_coefficient, stddev_samp(coefficient) AS sd_coefficient, count(fold_id) AS n_folds,
  avg((coefficient > 0)::INT) AS positive_rate, avg((coefficient < 0)::INT) AS negative_rate, greatest(avg((coefficient > 0)::INT), avg((coefficient < 0)::INT)) AS sign_stability,
  abs(avg(coefficient)) AS abs_mean_coefficient FROM cf GROUP BY 1, 2"""


@query("a30_stability_summary", _COEF + _STABLE, floats="mean_coefficient sd_coefficient positive_rate negative_rate sign_stability abs_mean_coefficient")
def stability_summary(t: Tables):
    """Stability of per-reader slopes, with readers as folds."""
    features = ["word_length_chars", "lm_word_surprisal", "log_corpus_frequency"]
    wide = panel.group_slopes(complete_rows(t), "participant_id", "TRT", features, 5)
    long = wide.select(F.col("participant_id").alias("fold_id"), F.lit("slopes").alias("feature_group"), *[F.col(f"{f}_slope").alias(f) for f in features])
    long = long.unpivot(["fold_id", "feature_group"], features, "feature", "coefficient")
    return reports.coefficient_stability(long)


_WORD_FEATURES = ["FFD", "go_past_time", "lm_word_surprisal", "prev_boundary_opacity_score", "paragraph_cohesion"]


@query(
    "m01_fold_scaler",
    f"""WITH {PANEL}, wl AS MATERIALIZED (SELECT participant_id AS key, label AS y, {', '.join(_WORD_FEATURES)} FROM word_level WHERE label IS NOT NULL), {_placed('wl')},
lg AS (UNPIVOT (SELECT fold, {', '.join(f'{c}::DOUBLE AS {c}' for c in _WORD_FEATURES)} FROM wl JOIN kp USING (key)) ON {', '.join(_WORD_FEATURES)} INTO NAME feature VALUE v),
md AS (SELECT u.fold AS fold_id, feature, median(v) AS m, sum(v) AS s, sum(v * v) AS ss, count(v) AS c FROM lg JOIN (SELECT DISTINCT fold FROM kp) AS u ON lg.fold <> u.fold GROUP BY 1, 2),
nn AS (SELECT u.fold AS fold_id, count(*) AS n FROM wl JOIN kp USING (key) JOIN (SELECT DISTINCT fold FROM kp) AS u ON kp.fold <> u.fold GROUP BY 1)
SELECT fold_id, feature, m AS median, (s + m * (n - c)) / n AS mean, sqrt((ss + m * m * (n - c)) / n - ((s + m * (n - c)) / n) ** 2) AS sd FROM md JOIN nn USING (fold_id)""",
    floats="median mean sd",
)
def fold_scaler(t: Tables):
    """Median, mean and SD of word features, some missing, over the training rows of each fold."""
    rows = complete_rows(t).where("label IS NOT NULL").select("participant_id", "label", *_WORD_FEATURES)
    assigned = five_folds(rows)
    placed = fold_fits.fold_rows(rows, assigned.drop("label"), "participant_id", _WORD_FEATURES, "label")
    return fold_fits.scaler_rows(placed, _WORD_FEATURES, assigned.agg(F.max("__k")).first()[0])


@query("m05_tree_and_sparse_classifiers")
def tree_and_sparse_classifiers(t: Tables):
    """L1 logistic, random forest and boosted trees over two grouped folds."""
    readers = reader_table(t)
    scored = learning.ml_cross_validate(readers, five_folds(readers, 2), "participant_id", READER_FEATURES, "label", ["l1_logistic", "random_forest", "gradient_boosting"])
    return metrics.binary_metrics(scored, ["model"])


_GAZE = ["FFD", "GD", "TRT", "fixation_count", "skip", "refixation_count", "go_past_time"]
_LM = ["lm_word_surprisal", "lm_word_entropy"]
_FAMILIES = {"gaze": _GAZE, "lm": _LM, "gaze_lm": [*_GAZE, *_LM]}
_WIDE = {name: [f"{c}__{s}" for c in cols for s in ("mean", "sd")] for name, cols in _FAMILIES.items()}


@query(
    "m07_family_ladder",
    f"""WITH RECURSIVE {PANEL}, rt AS MATERIALIZED (SELECT participant_id AS key, max(label) AS y, {', '.join(f'avg({c}) AS {c}__mean, stddev_samp({c}) AS {c}__sd' for c in _FAMILIES["gaze_lm"])}
  FROM word_level WHERE label IS NOT NULL GROUP BY 1), {_placed()},
{_evaluated(" UNION ALL ".join([_KFOLD.format(rows="rt"), _LOO]), " UNION ALL ".join([_KFITS, _LFITS]), _WIDE["gaze_lm"], _WIDE)} {_FITS_OF}""",
    floats=METRIC_FLOATS,
)
def family_ladder(t: Tables):
    """Feature families by models and splits on per-reader means and SDs."""
    from lectern.session import cut_lineage

    rows = complete_rows(t).where("label IS NOT NULL")
    wide = cut_lineage(panel.wide_mean_sd(rows, ["participant_id"], _FAMILIES["gaze_lm"]))
    assigned = {"participant_grouped_kfold": five_folds(wide), "leave_one_participant_out": splits.assign_leave_one_out(wide, "participant_id")}
    return learning.ablation_grid(wide, assigned, "participant_id", _WIDE, "label", MODELS)


_LEXICAL = ["word_length_chars", "log_corpus_frequency", "sentence_length_words", "word_position_in_sentence_norm"]
_BOUNDARY = ["prev_boundary_opacity_score", "vv_indicator"]
WORD_SETS = {
    "gaze_only": _GAZE,
    "gaze_plus_lexical": [*_GAZE, *_LEXICAL],
    "gaze_plus_predictability": [*_GAZE, *_LM],
    "gaze_plus_boundaries": [*_GAZE, *_BOUNDARY],
    "gaze_plus_predictability_and_boundaries": [*_GAZE, *_LM, *_BOUNDARY],
    "all_features": [*_GAZE, *_LEXICAL, *_LM, *_BOUNDARY, "paragraph_cohesion", "local_semantic_drift"],
}


@query(
    "m21_word_ladder",
    f"""WITH RECURSIVE {PANEL}, wl AS MATERIALIZED (SELECT participant_id AS key, label AS y, {', '.join(WORD_SETS["all_features"])} FROM word_level WHERE label IS NOT NULL), {_placed('wl')},
{_evaluated(_KFOLD.format(rows="wl"), _KFITS, WORD_SETS["all_features"], WORD_SETS, ["logistic_regression"], steps=7)} SELECT * EXCLUDE (model, split_name) FROM mt""",
    floats=METRIC_FLOATS,
)
def word_ladder(t: Tables):
    """Nested word-level feature sets over five grouped folds of readers."""
    from lectern.session import cut_lineage

    every = WORD_SETS["all_features"]
    rows = cut_lineage(complete_rows(t).where("label IS NOT NULL").select("participant_id", "label", *every))  # read by folds and fits
    scored, _ = learning.cross_validate(rows, five_folds(rows).drop("label"), "participant_id", every, "label", groups=WORD_SETS)
    return metrics.binary_metrics(scored, ["feature_group"])
