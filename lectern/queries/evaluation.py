"""Queries over metrics and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.numeric import sigmoid
from lectern.operators import metrics, reports, resampling
from lectern.plans import panels, predictions
from lectern.queries.registry import Tables, query
from lectern.queries.sql import PANEL

PRED = """pred AS (SELECT 'P' || CASE WHEN s_suppkey < 10 THEN '0' ELSE '' END || s_suppkey AS participant_id, m AS model,
  CASE WHEN s_acctbal >= 6000 THEN 1 ELSE 0 END AS y_true, round(1 / (1 + exp(-((s_acctbal - 5000) / 4000 + ((s_suppkey * 7 + m * 13) % 11 - 5) / 2::DOUBLE))), 2) AS y_score
  FROM supplier, unnest([0, 1, 2]) AS u(m) WHERE s_acctbal >= 6000 OR s_acctbal <= 4000)"""


def metric_sql(source: str, keys: str, weight: str = "1") -> str:
    """Metrics of ``source`` (y_true, y_score) by comma-separated keys, from pair and threshold definitions."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""mc AS (SELECT {k}y_score AS s, sum({weight} * y_true)::DOUBLE AS pos, sum({weight} * (1 - y_true))::DOUBLE AS neg FROM {source} GROUP BY {k}s),
mr AS (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
  sum(pos) OVER ({part}ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tpc, sum(pos + neg) OVER ({part}ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS allc FROM mc),
ms AS (SELECT {k}sum(pos) AS P, sum(neg) AS N, sum(pos * (nb + neg / 2)) AS u, sum(CASE WHEN allc > 0 THEN pos * tpc / allc ELSE 0 END) AS ap, sum(pos * (1 - s) ** 2 + neg * s ** 2) AS sq, sum((pos + neg) * s) AS m,
  coalesce(sum(pos) FILTER (WHERE s >= 0.5), 0) AS tp, coalesce(sum(neg) FILTER (WHERE s >= 0.5), 0) AS fp FROM mr {'GROUP BY ' + keys if keys else ''}),
mt AS (SELECT {k}P + N AS n_predictions, CASE WHEN P > 0 AND N > 0 THEN u / (P * N) END AS roc_auc, CASE WHEN P > 0 AND N > 0 THEN ap / P END AS pr_auc,
  CASE WHEN P > 0 AND N > 0 THEN sq / (P + N) END AS brier_score, CASE WHEN P > 0 AND N > 0 THEN (tp / P + (N - fp) / N) / 2 END AS balanced_accuracy,
  CASE WHEN P > 0 AND N > 0 THEN (coalesce(2 * tp / nullif(2 * tp + fp + P - tp, 0), 0) + coalesce(2 * (N - fp) / nullif(2 * (N - fp) + (P - tp) + fp, 0), 0)) / 2 END AS macro_f1,
  m / (P + N) AS calibration_mean_predicted, P / (P + N) AS calibration_observed_rate FROM ms)"""


METRIC_FLOATS = "n_predictions roc_auc pr_auc brier_score balanced_accuracy macro_f1 calibration_mean_predicted calibration_observed_rate"


@query("k01_k06_reader_metrics", f"WITH {PRED}, {metric_sql('pred', 'model')} SELECT * FROM mt", floats=METRIC_FLOATS)
def reader_metrics(t: Tables):
    """All metrics per model over readers."""
    return metrics.binary_metrics(predictions.reader_scores(t), ["model"])


def word_scores(t: Tables):
    rows = panels.word_level(t).where("label IS NOT NULL AND TRT IS NOT NULL")
    return rows.select("participant_id", "text_id", F.col("label").alias("y_true"), F.round(sigmoid((F.col("TRT") - 300) / 60), 3).alias("y_score"))


_WORD = f"{PANEL}, pred AS (SELECT participant_id, text_id, label AS y_true, round(1 / (1 + exp(-(TRT - 300) / 60)), 3) AS y_score FROM word_level WHERE label IS NOT NULL AND TRT IS NOT NULL)"


@query("k01_k06_word_metrics_by_text", f"WITH {_WORD}, {metric_sql('pred', 'text_id')} SELECT * FROM mt", floats=METRIC_FLOATS)
def word_metrics(t: Tables):
    """Word-level metrics per text."""
    return metrics.binary_metrics(word_scores(t), ["text_id"])


@query(
    "k08_reader_averaged_metrics",
    f"WITH {_WORD}, mean AS (SELECT participant_id, max(y_true) AS y_true, avg(y_score) AS y_score FROM pred GROUP BY 1), {metric_sql('mean', '')} SELECT * FROM mt",
    floats=METRIC_FLOATS,
)
def reader_averaged(t: Tables):
    """Scores averaged per reader before the metrics."""
    return metrics.binary_metrics(metrics.averaged_scores(word_scores(t), [], "participant_id"), [])


@query("k07_calibration_line")
def calibration_line(t: Tables):
    """Calibration intercept and slope per model."""
    return metrics.calibration_line(predictions.reader_scores(t), ["model"])


@query(
    "m10_permutation_test",
    f"""WITH {PRED}, one AS (SELECT * FROM pred WHERE model = 0), {metric_sql('one', '').replace('mc AS', 'oc AS').replace('FROM mc', 'FROM oc').replace('mr AS', 'orr AS').replace('FROM mr', 'FROM orr').replace('ms AS', 'os AS').replace('FROM ms', 'FROM os').replace('mt AS', 'obs_m AS')},
dealt AS (SELECT iteration, y_score, (row_number() OVER (PARTITION BY iteration ORDER BY md5('41|' || iteration || '|' || participant_id)) <= (SELECT sum(y_true) FROM one))::INT AS y_true FROM one, unnest(range(0, 200)) AS u(iteration)),
{metric_sql('dealt', 'iteration')}
SELECT (SELECT roc_auc FROM obs_m) AS observed_roc_auc, count(roc_auc) AS n_permutations, count(*) FILTER (WHERE roc_auc >= (SELECT roc_auc FROM obs_m) - 1e-12) AS n_at_or_above,
  (count(*) FILTER (WHERE roc_auc >= (SELECT roc_auc FROM obs_m) - 1e-12) + 1) / (count(roc_auc) + 1)::DOUBLE AS permutation_p_value FROM mt""",
    floats="observed_roc_auc permutation_p_value",
)
def permutation_test(t: Tables):
    """Label permutation against fixed scores, 200 deals."""
    return resampling.permutation_test(predictions.one_model(t), "participant_id", 200, 41)


@query(
    "m11_bootstrap_interval",
    f"""WITH {PRED}, one AS (SELECT *, row_number() OVER (ORDER BY participant_id) - 1 AS r, count(*) OVER () AS n FROM pred WHERE model = 0),
{metric_sql('one', '').replace('mc AS', 'oc AS').replace('FROM mc', 'FROM oc').replace('mr AS', 'orr AS').replace('FROM mr', 'FROM orr').replace('ms AS', 'os AS').replace('FROM ms', 'FROM os').replace('mt AS', 'obs_m AS')},
picks AS (SELECT iteration, ('0x' || substr(md5('41|' || iteration || '|' || r), 1, 8))::BIGINT % n AS pick FROM one, unnest(range(0, 200)) AS u(iteration)),
boot AS (SELECT iteration, one.y_true, one.y_score FROM picks JOIN one ON pick = one.r), {metric_sql('boot', 'iteration')}
SELECT 'roc_auc' AS metric, (SELECT roc_auc FROM obs_m) AS observed, count(roc_auc) AS n_bootstrap, quantile_cont(roc_auc, 0.025) AS ci_low, quantile_cont(roc_auc, 0.975) AS ci_high FROM mt
UNION ALL SELECT 'pr_auc', (SELECT pr_auc FROM obs_m), count(pr_auc), quantile_cont(pr_auc, 0.025), quantile_cont(pr_auc, 0.975) FROM mt""",
    floats="observed ci_low ci_high",
)
def bootstrap_interval(t: Tables):
    """Percentile interval of the AUCs over 200 resamples of readers."""
    return resampling.bootstrap_interval(predictions.one_model(t), "participant_id", 200, 41)


@query(
    "a36_influence_audit",
    f"""WITH {PRED}, one AS (SELECT * FROM pred WHERE model = 0), c AS (SELECT sum(y_true) AS P, sum(1 - y_true) AS N FROM one),
u AS (SELECT sum(CASE WHEN a.y_score > b.y_score THEN 1 WHEN a.y_score = b.y_score THEN 0.5 ELSE 0 END)::DOUBLE AS U FROM one a JOIN one b ON a.y_true = 1 AND b.y_true = 0),
lost AS (SELECT x.participant_id, sum(CASE WHEN x.y_true = 1 THEN CASE WHEN x.y_score > z.y_score THEN 1 WHEN x.y_score = z.y_score THEN 0.5 ELSE 0 END
  ELSE CASE WHEN z.y_score > x.y_score THEN 1 WHEN x.y_score = z.y_score THEN 0.5 ELSE 0 END END)::DOUBLE AS l FROM one x JOIN one z ON x.y_true <> z.y_true GROUP BY 1),
d AS (SELECT one.participant_id, y_true, y_score, (y_score >= 0.5)::INT <> y_true AS misclassified, abs(y_true - y_score) AS absolute_error,
  (U - l) / nullif((P - y_true) * (N - (1 - y_true)), 0) AS leave_one_roc_auc, (U - l) / nullif((P - y_true) * (N - (1 - y_true)), 0) - U / (P * N) AS delta_roc_auc FROM one JOIN lost USING (participant_id), c, u)
SELECT *, coalesce(round(abs(delta_roc_auc), 9) >= (SELECT round(quantile_cont(abs(delta_roc_auc), 0.9), 9) FROM d), false) AS high_leverage_flag FROM d""",
    floats="y_score absolute_error leave_one_roc_auc delta_roc_auc",
)
def influence_audit(t: Tables):
    """Errors, leave-one-out AUC change and high-leverage flags of readers."""
    return reports.influence_audit(predictions.one_model(t), "participant_id")


_BIN = "CASE WHEN y_score <= 0.2 THEN '(0, 0.2]' WHEN y_score <= 0.4 THEN '(0.2, 0.4]' WHEN y_score <= 0.6 THEN '(0.4, 0.6]' WHEN y_score <= 0.8 THEN '(0.6, 0.8]' ELSE '(0.8, 1]' END"


@query(
    "a35_calibration_bins",
    f"""WITH {PRED}, one AS (SELECT * FROM pred WHERE model = 0)
SELECT 'overall' AS probability_bin, count(*) AS n, avg(y_score) AS mean_predicted, avg(y_true) AS observed_rate, avg((y_true - y_score) ** 2) AS brier_score FROM one
UNION ALL SELECT {_BIN}, count(*), avg(y_score), avg(y_true), NULL FROM one GROUP BY 1""",
    floats="mean_predicted observed_rate brier_score",
)
def calibration_bins(t: Tables):
    """Predicted against observed by bin, with the overall row."""
    return reports.calibration_bins(predictions.one_model(t))


@query(
    "a37_exposure_sensitivity",
    f"""WITH {PANEL}, {PRED}, c AS (SELECT participant_id, count(*) AS n_word_rows, count(DISTINCT word_id) AS n_words_read FROM panel GROUP BY 1),
j AS (SELECT y_score, abs(y_true - y_score) AS e, n_word_rows, n_words_read, comprehension_score FROM pred LEFT JOIN c USING (participant_id) LEFT JOIN people USING (participant_id) WHERE model = 0)
"""
    + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, count({v}) AS n, CASE WHEN count({v}) >= 3 AND min({v}) < max({v}) THEN corr({v}, y_score) END AS corr_with_score, CASE WHEN count({v}) >= 3 AND min({v}) < max({v}) THEN corr({v}, e) END AS corr_with_abs_error FROM j"
        for v in ("n_word_rows", "n_words_read", "comprehension_score")
    ),
    floats="corr_with_score corr_with_abs_error",
)
def exposure_sensitivity(t: Tables):
    """Correlation of exposures with scores and errors."""
    from lectern.operators.participants import reading_counts

    exposures = reading_counts(panels.collapsed(t)).join(panels.participants(t).select("participant_id", "comprehension_score"), "participant_id", "full")
    return reports.exposure_sensitivity(predictions.one_model(t), exposures, "participant_id", ["n_word_rows", "n_words_read", "comprehension_score"])
