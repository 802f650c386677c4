"""Queries over catalogues, rankings, gates and summary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lectern.functions import names
from lectern.operators import catalog, contracts, linear, metrics, panel, profiles, reports
from lectern.plans import panels, predictions
from lectern.queries.evaluation import METRIC_FLOATS, PRED, _WORD, metric_sql
from lectern.queries.models import X, OUTCOME, _SLOPES, _R
from lectern.queries.readers import GROUPS, grouped_readers
from lectern.queries.registry import Tables, query
from lectern.queries.sql import PANEL, sql_slope, with_panel


@query("p36_column_catalogue")
def column_catalogue(t: Tables):
    """Meaning and completeness of every modelling column."""
    return catalog.catalogue(
        {"word_level": (panels.word_level(t), "word"), "word_features": (panels.word_features(t), "word"), "participants": (panels.participants(t), "reader")}
    )


_FAM = {"mean_ffd": "raw_gaze", "skipping_rate": "raw_gaze", "word_observation_count": "exposure_count", "surprisal_sensitivity": "predictability", "length_sensitivity": "covariate_or_other"}


@query(
    "p37_feature_families",
    with_panel(f""", agg AS (SELECT avg(FFD) AS mean_ffd, avg(skip) AS skipping_rate, count(*) AS word_observation_count, {sql_slope('TRT', 'lm_word_surprisal')} AS surprisal_sensitivity,
  {sql_slope('TRT', 'word_length_chars')} AS length_sensitivity FROM word_level GROUP BY participant_id) """)
    + " UNION ALL ".join(f"SELECT '{c}' AS feature_name, count(*) AS rows, count(*) - count({c}) AS missing, '{f}' AS feature_family FROM agg" for c, f in _FAM.items()),
)
def feature_families(t: Tables):
    """Family of reader features from their names, with completeness."""
    rows = panel.reader_aggregates(panels.word_level(t)).select(*_FAM)
    found = catalog.column_profile(rows, "readers")
    return found.select("feature_name", "rows", "missing", names.feature_family("feature_name", rows.columns).alias("feature_family"))


def reader_profiles(t: Tables):
    rows = panels.word_level(t)
    aggregates = panel.reader_aggregates(rows)
    residual = linear.cross_fitted_residuals(rows, "participant_id", OUTCOME, [X], _R)
    exposures = {"mean_word_length_exposure": "word_length_chars", "mean_surprisal_exposure": "lm_word_surprisal", "mean_entropy_exposure": "lm_word_entropy", "vv_boundary_exposure_rate": "vv_indicator"}
    second = profiles.residual_profiles(residual, "participant_id", [_R], _SLOPES, exposures=exposures)
    return profiles.combine_profiles(aggregates, second, panels.participants(t), "participant_id", ["age", "comprehension_score"])


@query("m08_a38_feature_groups")
def feature_groups(t: Tables):
    """Size, exposure and permission of each reader feature group."""
    rows = reader_profiles(t)
    groups = catalog.reader_feature_groups(rows.columns)
    return catalog.feature_group_summary(catalog.feature_group_metadata(rows, groups))


@query(
    "o03_best_row",
    f"WITH {PRED}, {metric_sql('pred', 'model')} SELECT model, roc_auc FROM mt WHERE roc_auc IS NOT NULL ORDER BY CASE WHEN model IN (1, 2) THEN 0 ELSE 1 END, roc_auc DESC, model LIMIT 1",
    floats="roc_auc",
)
def best_row(t: Tables):
    """Best model, preferred ones first."""
    found = metrics.binary_metrics(predictions.reader_scores(t), ["model"]).select("model", "roc_auc")
    return reports.best_row(found, F.col("model").isin(1, 2), "roc_auc", ["model"])


_BY_PARA = _WORD.replace("SELECT participant_id, text_id, label AS y_true", "SELECT participant_id, paragraph_id, label AS y_true")


@query(
    "o04_top_metric_rows",
    f"WITH {_BY_PARA}, {metric_sql('pred', 'paragraph_id')} SELECT paragraph_id, roc_auc, pr_auc FROM mt ORDER BY roc_auc DESC NULLS LAST, paragraph_id LIMIT 5",
    floats="roc_auc pr_auc",
)
def top_metric_rows(t: Tables):
    """Five best paragraphs by AUC."""
    from lectern.functions.numeric import sigmoid

    rows = panels.word_level(t).where("label IS NOT NULL AND TRT IS NOT NULL").select(
        "paragraph_id", F.col("label").alias("y_true"), F.round(sigmoid((F.col("TRT") - 300) / 60), 3).alias("y_score")
    )
    return reports.top_rows(metrics.binary_metrics(rows, ["paragraph_id"]).select("paragraph_id", "roc_auc", "pr_auc"), "roc_auc", 5, ["paragraph_id"])


_CAND = f"""WITH {PRED}, {metric_sql('pred', 'model')}, cand AS (SELECT CASE model WHEN 0 THEN 'primary' WHEN 1 THEN 'primary_calibrated' ELSE 'stable_only' END AS candidate, model + 3 AS n_features, roc_auc, 'passed' AS decision_gate_status FROM mt)"""


def candidates(t: Tables):
    found = metrics.binary_metrics(predictions.reader_scores(t), ["model"])
    name = F.when(F.col("model") == 0, "primary").when(F.col("model") == 1, "primary_calibrated").otherwise("stable_only")
    kind = F.when(F.col("model") == 0, "primary").when(F.col("model") == 1, "recalibrated").otherwise("subset")
    return found.select(name.alias("candidate"), kind.alias("kind"), (F.col("model") + 3).alias("n_features"), "roc_auc", F.lit("passed").alias("decision_gate_status"))


@query(
    "o05_candidate_ranking",
    _CAND + """ SELECT *, n_features::DOUBLE + CASE WHEN candidate = 'primary' THEN 0 WHEN candidate LIKE '%calibrated%' THEN 10 ELSE 2 END AS complexity_rank,
  abs(roc_auc - (SELECT roc_auc FROM cand WHERE candidate = 'primary')) <= 0.01 AS within_negligible_auc_gain FROM cand""",
    floats="roc_auc complexity_rank",
)
def candidate_ranking(t: Tables):
    """Candidates ranked by gate, complexity and AUC."""
    return reports.rank_candidates(candidates(t), "kind", {"primary": 0, "subset": 2, "recalibrated": 10}, "primary")


@query(
    "v11_locked_metrics",
    f"WITH {PRED}, {metric_sql('pred', 'model')} SELECT model, roc_auc, coalesce(abs(roc_auc - 0.85) <= 0.05, false) AS matches FROM mt",
    floats="roc_auc",
)
def locked_metrics(t: Tables):
    """Models whose AUC lies within tolerance of a locked value."""
    found = metrics.binary_metrics(predictions.reader_scores(t), ["model"])
    return found.select("model", "roc_auc", contracts.within_tolerance(F.col("roc_auc"), F.lit(0.85), 0.05).alias("matches"))


@query(
    "v12_decision_gates",
    f"""WITH {PRED}, {metric_sql('pred', 'model')}, f AS (SELECT (SELECT roc_auc FROM mt WHERE model = 0) AS a0, (SELECT roc_auc FROM mt WHERE model = 1) AS a1,
  (SELECT count(*) FROM pred WHERE model = 0) AS n, (SELECT count(DISTINCT participant_id) FROM pred WHERE model = 0) AS u),
g AS (SELECT unnest(['auc_above_limit', 'first_beats_second', 'one_prediction_per_reader']) AS gate, unnest([a0 > 0.7, a0 > a1, n = u]) AS passed FROM f)
SELECT gate, passed, (SELECT bool_and(passed) FROM g) AS all_passed FROM g""",
)
def decision_gates(t: Tables):
    """Gates over one row of facts."""
    scores = predictions.reader_scores(t)
    found = metrics.binary_metrics(scores, ["model"])
    facts = found.agg(F.max(F.when(F.col("model") == 0, F.col("roc_auc"))).alias("a0"), F.max(F.when(F.col("model") == 1, F.col("roc_auc"))).alias("a1"))
    first = scores.where("model = 0").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("participant_id").alias("u"))
    from lectern.operators.scalars import with_totals

    tests = {"auc_above_limit": F.col("a0") > 0.7, "first_beats_second": F.col("a0") > F.col("a1"), "one_prediction_per_reader": F.col("n") == F.col("u")}
    return reports.decision_gates(with_totals(facts, first), tests)


_INTER = {"lm_word_surprisal": "main explanatory support", "word_length_chars": "secondary support", "prev_boundary_opacity_score": "secondary interpretability support"}


@query(
    "m22_interaction_synthesis",
    with_panel(", s AS (" + " UNION ALL ".join(f"SELECT '{f}' AS interaction, {sql_slope('TRT', f, 5)} AS b FROM word_level GROUP BY participant_id" for f in [*_INTER, "log_corpus_frequency"]) + f"""),
c AS (SELECT interaction, avg(b) AS estimate, stddev_samp(b) / sqrt(count(b)) AS std_error FROM s GROUP BY 1), p AS (SELECT *, exp(-((estimate / std_error) ** 2) / 2) AS p_value FROM c)
SELECT *, CASE WHEN estimate > 0 THEN 'positive' WHEN estimate < 0 THEN 'negative' ELSE 'zero' END AS direction, coalesce(p_value < 0.05, false) AS survives_controls,
  CASE interaction {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _INTER.items())} END AS paper_role FROM p WHERE interaction <> 'log_corpus_frequency'"""),
    floats="estimate std_error p_value",
)
def interaction_synthesis(t: Tables):
    """Mean reader slopes as focus terms with direction, survival and role."""
    features = [*_INTER, "log_corpus_frequency"]
    wide = panel.group_slopes(panels.word_level(t), "participant_id", "TRT", features, 5)
    long = wide.select(*[F.col(f"{f}_slope").alias(f) for f in features]).unpivot([], features, "interaction", "b")
    terms = long.groupBy("interaction").agg(F.avg("b").alias("estimate"), (F.stddev_samp("b") / F.sqrt(F.count("b"))).alias("std_error"))
    z = F.col("estimate") / F.col("std_error")
    return reports.synthesize_interactions(terms.withColumn("p_value", F.exp(-z * z / 2)), _INTER)


@query(
    "m23_stress_comparison",
    f"WITH {PRED}, {metric_sql('pred', 'model')} SELECT *, CASE model WHEN 0 THEN 'sensitivity' WHEN 2 THEN 'exposure_only' END AS role FROM (SELECT model::VARCHAR AS model, * EXCLUDE (model) FROM mt WHERE model IN (0, 2))".replace("CASE model WHEN 0 THEN 'sensitivity' WHEN 2", "CASE model WHEN '0' THEN 'sensitivity' WHEN '2'"),
    floats=METRIC_FLOATS,
)
def stress_comparison(t: Tables):
    """Metric rows of two families in their roles."""
    found = metrics.binary_metrics(predictions.reader_scores(t), ["model"]).withColumn("model", F.col("model").cast("string"))
    return reports.metric_subset(found, {"0": "sensitivity", "2": "exposure_only"}, "model")


@query(
    "m24_summary_tables",
    f"""WITH {PANEL}{GROUPS}, w AS (SELECT prev_boundary_type_orth AS k, count(*)::DOUBLE AS n FROM lex GROUP BY 1)
SELECT 'dataset' AS summary_table, unnest(['participants_total', 'word_rows']) AS item, unnest([(SELECT count(*) FROM people), (SELECT count(*) FROM panel)])::DOUBLE AS value
UNION ALL SELECT 'labels', reader_group, count(*)::DOUBLE FROM labelled GROUP BY 2 UNION ALL SELECT 'boundaries', k, n FROM w""",
    floats="value",
)
def summary_tables(t: Tables):
    """Dataset, label and boundary summaries in one long table."""
    counts = reports.table_summary({"participants_total": panels.participants(t), "word_rows": panels.collapsed(t)})
    dataset = counts.select(F.lit("dataset").alias("summary_table"), F.col("table_name").alias("item"), F.col("rows").cast("double").alias("value"))

    def counted(df, column, name):
        return df.groupBy(F.col(column).alias("item")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("summary_table"), "item", "value")

    parts = [dataset, counted(grouped_readers(t), "reader_group", "labels"), counted(panels.word_features(t), "prev_boundary_type_orth", "boundaries")]
    return reduce(DataFrame.unionByName, parts)


@query(
    "m24_robustness_rows",
    f"""WITH {PRED}, {metric_sql('pred', 'model')} SELECT 'metrics' AS summary_table, unnest(['roc_auc', 'pr_auc', 'brier_score']) AS item, unnest([roc_auc, pr_auc, brier_score]) AS value FROM mt WHERE model = 0""",
    floats="value",
)
def robustness_rows(t: Tables):
    """Headline metrics as summary rows."""
    found = metrics.binary_metrics(predictions.one_model(t), []).select("roc_auc", "pr_auc", "brier_score")
    return reports.summary_items("metrics", found)
