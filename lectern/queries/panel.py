"""Queries over the observation panel: collapse, joins, reader aggregates, scalar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import ids, numeric
from lectern.operators import joins, panel
from lectern.operators.scalars import zscored
from lectern.plans import panels
from lectern.queries.registry import Tables, query
from lectern.queries.sql import sql_slope, with_panel
from lectern.session import cut_lineage

MEASURES = "FFD GD TRT go_past_time fixation_count refixation_count"


@query("a01_p09_p10_collapse_duplicates", with_panel("SELECT * FROM panel"), floats=MEASURES)
def collapse(t: Tables):
    """One row per (reader, word), measures averaged."""
    return panels.collapsed(t)


_DERIVED = "label_num fixated log_ffd log_first_pass_duration log_go_past_time log_total_fixation_duration log_fixation_count"


@query(
    "j01_j04_p11_word_level_table",
    with_panel("""SELECT participant_id, word_id, text_id, sentence_id, paragraph_id, word_length_chars, lm_word_surprisal, label, sex,
  label_num, vv_indicator, fixated, log_ffd, log_first_pass_duration, log_go_past_time, log_total_fixation_duration, log_fixation_count FROM word_level"""),
    floats="lm_word_surprisal " + _DERIVED,
)
def word_level_table(t: Tables):
    """Panel joined to word and reader tables under many-to-one contracts, with derived columns."""
    return panels.word_level(t).select(
        "participant_id", "word_id", "text_id", "sentence_id", "paragraph_id", "word_length_chars", "lm_word_surprisal",
        "label", "sex", "label_num", "vv_indicator", *_DERIVED.split()[1:],
    )


@query(
    "j13_v08_join_report",
    with_panel("""SELECT (SELECT count(*) FROM panel) AS base_rows, count(*) AS joined_rows, greatest((SELECT count(*) FROM panel) - count(*), 0) AS row_loss,
  greatest(count(*) - (SELECT count(*) FROM panel), 0) AS row_gain, count(*) - count(DISTINCT (participant_id, word_id)) AS duplicate_keys,
  avg((lm_word_surprisal IS NULL)::INT) AS missing_lm_rate, avg((upos IS NULL)::INT) AS missing_parser_rate,
  avg((paragraph_cohesion IS NULL)::INT) AS missing_embedding_rate FROM word_level"""),
    floats="missing_lm_rate missing_parser_rate missing_embedding_rate",
)
def join_report(t: Tables):
    """Loss, gain, duplicates and missing rates of the wide join."""
    families = {"lm": F.col("lm_word_surprisal"), "parser": F.col("upos"), "embedding": F.col("paragraph_cohesion")}
    return joins.join_report(panels.collapsed(t), panels.word_level(t), ["participant_id", "word_id"], families)


@query(
    "j02_j03_source_cross_check",
    """WITH s AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS total, count(*) AS n FROM lineitem GROUP BY 1),
m AS (SELECT abs(o_totalprice - total) AS d1, abs(o_totalprice - o_totalprice) AS d2 FROM orders JOIN s ON o_orderkey = k)
SELECT 'price' AS metric, count(d1) AS compared_rows, count(*) FILTER (WHERE d1 <= 1e-6) AS matching_rows, max(d1) AS max_abs_diff FROM m
UNION ALL SELECT 'same_price', count(d2), count(*) FILTER (WHERE d2 <= 1e-6), max(d2) FROM m""",
    floats="max_abs_diff",
    digits=3,
)
def source_cross_check(t: Tables):
    """Order totals against the sum of their lines, and against themselves."""
    left = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_totalprice").alias("same_price"))
    right = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("total"))
    right = right.join(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("copy")), "k")
    return joins.cross_check(left, right, ["k"], {"price": "total", "same_price": "copy"})


@query(
    "j02_inner_on_unique_keys",
    """WITH a AS (SELECT l_suppkey AS s, l_partkey AS p, min(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_suppkey AS s, l_partkey AS p, min(l_tax) AS x, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
SELECT a.s, a.p, q, x FROM a JOIN b ON a.s = b.s AND a.p = b.p WHERE a.n = 1 AND b.n = 1""",
    floats="q x",
)
def inner_on_unique_keys(t: Tables):
    """Join restricted to (reader, word) pairs seen once on both sides."""
    a = t.lineitem.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_quantity").alias("q"))
    b = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_tax").alias("x"))
    return joins.inner_on_unique_keys(a, b, ["s", "p"])


@query(
    "j05_join_at_finest_key",
    with_panel(""", para AS (SELECT paragraph_id, avg(word_length_chars) AS word_length_chars_extra FROM lex GROUP BY 1)
SELECT participant_id, count(*) AS rows, sum(word_length_chars_extra) AS paragraph_length_sum FROM word_level JOIN para USING (paragraph_id) GROUP BY 1"""),
    floats="paragraph_length_sum",
    digits=4,
)
def join_at_finest_key(t: Tables):
    """A paragraph-level table joins on paragraph, as it has no finer key."""
    extra = panels.word_features(t).groupBy("paragraph_id").agg(F.avg("word_length_chars").alias("word_length_chars"))
    joined = joins.join_at_finest_key(panels.word_level(t), extra, ["word_id", "sentence_id", "paragraph_id"])
    return joined.groupBy("participant_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("word_length_chars_extra").alias("paragraph_length_sum")
    )


@query("j07_semi_join", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join(t: Tables):
    """Documents that have a label."""
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id"), "doc_id", "left_semi")


@query("j08_anti_join", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(t: Tables):
    """Documents without a label."""
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels.select("doc_id"), "doc_id", "left_anti")


@query(
    "j10_w02_aggregate_and_join_back",
    with_panel("""SELECT participant_id, word_id, TRT - avg(TRT) OVER (PARTITION BY word_id) AS trt_against_word_mean,
  count(*) OVER (PARTITION BY word_id) AS readers_of_word FROM panel"""),
    floats="trt_against_word_mean",
)
def aggregate_and_join_back(t: Tables):
    """Word means joined back to the panel: the aggregate combines map-side, unlike a window over a hot word."""
    base = panels.collapsed(t).select("participant_id", "word_id", "TRT")
    per_word = base.groupBy("word_id").agg(F.avg("TRT").alias("m"), F.count(F.lit(1)).alias("readers_of_word"))
    joined = base.join(per_word, "word_id", "left")
    return joined.select("participant_id", "word_id", (F.col("TRT") - F.col("m")).alias("trt_against_word_mean"), "readers_of_word")


@query(
    "j11_join_to_first_right_row",
    """SELECT s_suppkey, s_name, l_orderkey, l_linenumber, l_partkey FROM supplier LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) ON l_suppkey = s_suppkey AND k = 1""",
)
def join_to_first(t: Tables):
    """Each reader with the first line only."""
    lines = t.lineitem.select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    out = joins.many_to_first(t.supplier.select("s_suppkey", "s_name"), lines, ["s_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"])
    return out.drop("l_shipdate")


@query(
    "j12_join_and_coalesce",
    """SELECT d.doc_id, d.lang, coalesce(l.quality, CASE WHEN n_chars > 2000 THEN 1 END) AS quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def join_and_coalesce(t: Tables):
    """Label columns win over the ones derived from the text length."""
    base = t.documents.select("doc_id", "lang", F.when(F.col("n_chars") > 2000, 1).alias("quality"))
    return joins.join_and_coalesce(base, t.labels, ["doc_id"], prefer="right")


@query(
    "a06_a07_reader_aggregates",
    with_panel(f"""SELECT participant_id, max(label) AS label, avg(FFD) AS mean_ffd, avg(GD) AS mean_gd, avg(TRT) AS mean_trt, avg(skip) AS skipping_rate,
  avg(refixation_count) AS refixation_rate, avg(go_past_time) AS mean_go_past_time, stddev_samp(TRT) AS trt_sd, count(word_id) AS word_observation_count,
  {sql_slope('TRT', 'word_length_chars')} AS length_sensitivity, {sql_slope('TRT', 'log_corpus_frequency')} AS frequency_sensitivity,
  {sql_slope('TRT', 'lm_word_surprisal')} AS surprisal_sensitivity, {sql_slope('TRT', 'lm_word_entropy')} AS entropy_sensitivity,
  median(FFD) AS median_ffd, median(GD) AS median_gd, median(TRT) AS median_trt, quantile_cont(TRT, 0.9) AS trt_q90 FROM word_level GROUP BY 1"""),
    floats="mean_ffd mean_gd mean_trt skipping_rate refixation_rate mean_go_past_time trt_sd length_sensitivity frequency_sensitivity "
    "surprisal_sensitivity entropy_sensitivity median_ffd median_gd median_trt trt_q90",
)
def reader_aggregates(t: Tables):
    """Reader-level gaze profile. Means and quantiles read the panel, so it is stored."""
    columns = [
        "participant_id", "word_id", "label", "FFD", "GD", "TRT", "skip", "refixation_count", "go_past_time",
        "word_length_chars", "log_corpus_frequency", "lm_word_surprisal", "lm_word_entropy",
    ]
    return panel.reader_aggregates(cut_lineage(panels.word_level(t).select(*columns)))


@query(
    "a08_group_slopes",
    with_panel(f"""SELECT participant_id, {sql_slope('log_total_fixation_duration', 'word_length_chars', 5)} AS word_length_chars_slope,
  {sql_slope('log_total_fixation_duration', 'prev_boundary_opacity_score', 5)} AS prev_boundary_opacity_score_slope FROM word_level GROUP BY 1"""),
    floats="word_length_chars_slope prev_boundary_opacity_score_slope",
)
def group_slopes(t: Tables):
    """Slopes with at least five pairs."""
    return panel.group_slopes(panels.word_level(t), "participant_id", "log_total_fixation_duration", ["word_length_chars", "prev_boundary_opacity_score"], 5)


_A09 = ["FFD", "GD", "TRT", "fixation_count", "skip", "refixation_count", "go_past_time", "lm_word_surprisal", "lm_word_entropy"]


@query(
    "a09_a10_wide_mean_sd",
    with_panel("SELECT participant_id, text_id, " + ", ".join(f'avg({c}) AS "{c}__mean", stddev_samp({c}) AS "{c}__sd"' for c in _A09) + ", max(label) AS label FROM word_level GROUP BY 1, 2"),
    floats=" ".join(f"{c}__mean {c}__sd" for c in _A09),
)
def wide_mean_sd(t: Tables):
    """Mean and SD of the gaze and predictability families per reader and text."""
    rows = panels.word_level(t)
    # log_* and derived columns are outside both families' lists and patterns
    columns = panel.family_columns(rows, ["gaze", "lm_surprisal_entropy"])
    return panel.wide_mean_sd(rows, ["participant_id", "text_id"], columns)


# --- scalar columns -----------------------------------------------------------


@query(
    "p01_p02_p22_id_tokens",
    """SELECT l_suppkey, l_partkey, l_suppkey::VARCHAR AS cleaned, 'P' || lpad(l_suppkey::VARCHAR, greatest(2, length(l_suppkey::VARCHAR))::INTEGER, '0') AS participant_id,
  upper(l_returnflag || 'x') AS other_id, 'P' || lpad(l_suppkey::VARCHAR, greatest(2, length(l_suppkey::VARCHAR))::INTEGER, '0') || '::' || l_partkey AS pair_key
FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem)""",
)
def id_tokens(t: Tables):
    """Tokens written in several raw forms come out the same."""
    pairs = t.lineitem.select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    raw = F.concat(F.lit(' "'), F.col("l_suppkey").cast("string"), F.lit('.0" '))
    token = ids.clean_token(F.regexp_replace(raw, '"', ""))
    reader = ids.normalize_participant(F.concat(F.lit("p00"), F.col("l_suppkey")))
    return pairs.select(
        "l_suppkey", "l_partkey", token.alias("cleaned"), reader.alias("participant_id"),
        ids.normalize_participant(F.concat("l_returnflag", F.lit("x"))).alias("other_id"),
        ids.composite_key(reader, F.col("l_partkey").cast("string")).alias("pair_key"),
    )


@query(
    "p03_stable_ids",
    """SELECT DISTINCT o_orderpriority[1:1] || '_p' || o_orderkey || '_s' || l_linenumber || '_w' || l_partkey AS word_id,
  o_orderpriority[1:1] || '_p' || o_orderkey AS paragraph_id, 'P' || CASE WHEN l_suppkey < 10 THEN '0' ELSE '' END || l_suppkey AS participant_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def stable_ids(t: Tables):
    """Concatenated ids from four order columns."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("text", F.substring("o_orderpriority", 1, 1))
    named = ids.with_stable_ids(lines, "text", "o_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return named.select("word_id", "paragraph_id", "participant_id").distinct()


@query(
    "p04_label_vocabulary",
    """SELECT event_type, user_id % 4 AS form, (CASE WHEN user_id % 4 IN (0, 2) THEN 1 WHEN user_id % 4 = 1 THEN 0 END)::INTEGER AS label, count(*) AS n FROM events GROUP BY ALL""",
)
def label_vocabulary(t: Tables):
    """Labels written as words parse to 1 / 0 / null."""
    forms = F.array(F.lit(" Yes"), F.lit("CONTROL"), F.lit("1.0"), F.lit("maybe"))
    rows = t.events.select("event_type", (F.col("user_id") % 4).alias("form"))
    parsed = rows.withColumn("label", ids.parse_label(F.get(forms, F.col("form").cast("int"))))
    return parsed.groupBy("event_type", "form", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p05_p06_numeric_coercion",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN NULL ELSE value END AS parsed, value AS with_comma FROM events""",
    floats="parsed with_comma",
)
def numeric_coercion(t: Tables):
    """Bad numbers become null; decimal commas are read."""
    text = F.col("value").cast("string")
    mixed = F.when(F.col("event_id") % 3 == 1, F.concat(text, F.lit("d"))).otherwise(text)
    return t.events.select(
        "event_id", numeric.to_number(mixed).alias("parsed"), numeric.to_number_decimal_comma(F.replace(text, F.lit("."), F.lit(","))).alias("with_comma")
    )


@query(
    "p09_measure_mapping",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS TRT, l_quantity AS fixation_count, NULL::DOUBLE AS landing_position,
  (l_quantity = 0)::INTEGER AS skip, greatest(l_quantity - 1, 0) AS refixation_count FROM lineitem""",
    floats="TRT fixation_count landing_position refixation_count",
    digits=2,
)
def measure_mapping(t: Tables):
    """Source columns mapped to measures, an absent source to nulls."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    mapped = panel.map_measures(t.lineitem, {"TRT": "l_extendedprice", "fixation_count": "l_quantity"}, {"landing_position": "no_such_column"})
    return mapped.select(*keys, "TRT", "fixation_count", "landing_position", "skip", "refixation_count")


@query(
    "p23_first_present_column",
    "SELECT p_partkey, p_name AS word FROM part",
)
def first_present_column(t: Tables):
    """Schema variants resolve to the first known name."""
    return t.part.select("p_partkey", F.col(ids.first_present(t.part, ["word", "word_form", "p_name"])).alias("word"))


@query(
    "p27_zscores",
    """SELECT p_partkey, (p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part) AS p_size_z,
  (p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part) AS p_retailprice_z, 0.0::DOUBLE AS constant_z FROM part""",
    floats="p_size_z p_retailprice_z constant_z",
)
def zscores(t: Tables):
    """z-scores, with a constant column going to zero."""
    base = t.part.withColumn("constant", F.lit(3.0))
    return zscored(base, ["p_size", "p_retailprice", "constant"]).select("p_partkey", "p_size_z", "p_retailprice_z", "constant_z")


@query(
    "p28_p29_design_columns",
    """WITH z AS (SELECT o_orderkey, o_orderpriority, (o_orderkey % 2)::DOUBLE AS g, (o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders) AS o_totalprice_z FROM orders)
SELECT o_orderkey, o_totalprice_z, g * o_totalprice_z AS g_x_o_totalprice_z, (o_orderpriority LIKE '2%')::DOUBLE AS "level_2", (o_orderpriority LIKE '3%')::DOUBLE AS "level_3",
  (o_orderpriority LIKE '4%')::DOUBLE AS "level_4", (o_orderpriority LIKE '5%')::DOUBLE AS "level_5" FROM z""",
    floats="o_totalprice_z g_x_o_totalprice_z level_2 level_3 level_4 level_5",
)
def design_columns(t: Tables):
    """z-scored predictor, its interaction with a group, and drop-first dummies with fixed training levels."""
    from lectern.operators.linear import dummy_columns

    base = t.orders.select("o_orderkey", "o_totalprice", F.substring("o_orderpriority", 1, 1).alias("level"), (F.col("o_orderkey") % 2).cast("double").alias("g"))
    scored = zscored(base, ["o_totalprice"])
    dummies = dummy_columns("level", ["1", "2", "3", "4", "5"])
    return scored.withColumns(dummies).select("o_orderkey", "o_totalprice_z", (F.col("g") * F.col("o_totalprice_z")).alias("g_x_o_totalprice_z"), *dummies)


@query(
    "p33_scores_and_logits",
    """SELECT event_id, 1 / (1 + exp(-(value - 10) / 5)) AS probability,
  ln(least(greatest(1 / (1 + exp(-(value - 10) / 5)), 1e-6), 1 - 1e-6) / least(greatest(1 - 1 / (1 + exp(-(value - 10) / 5)), 1e-6), 1 - 1e-6)) AS logit FROM events""",
    floats="probability logit",
    digits=5,
)
def scores_and_logits(t: Tables):
    """Sigmoid of a margin and its clipped logit."""
    p = numeric.sigmoid((F.col("value") - 10) / 5)
    return t.events.select("event_id", p.alias("probability"), numeric.logit(p).alias("logit"))


@query(
    "p34_p35_signs_and_categories",
    """SELECT event_id, CASE WHEN value > 10 THEN 'positive' WHEN value < 10 THEN 'negative' ELSE 'zero' END AS sign,
  CASE WHEN v IS NULL THEN 'blocked_by_data_quality' WHEN v >= 0.75 AND NOT p > 0.1 THEN 'strong_signal' WHEN v >= 0.65 AND NOT p > 0.1 THEN 'promising_signal' WHEN v >= 0.55 THEN 'weak_signal' ELSE 'not_supported' END AS category
FROM (SELECT *, CASE WHEN event_id % 10 > 0 THEN (event_id % 100) / 100::DOUBLE END AS v, (event_id % 7) / 30::DOUBLE AS p FROM events)""",
)
def signs_and_categories(t: Tables):
    """Sign classes and threshold ladder with p-value downgrade."""
    v = F.when(F.col("event_id") % 10 > 0, (F.col("event_id") % 100) / 100.0)
    p = (F.col("event_id") % 7) / 30.0
    return t.events.select(
        "event_id", numeric.sign_class(F.col("value") - 10).alias("sign"),
        numeric.threshold_category(v, 0.75, 0.65, 0.55, p).alias("category"),
    )
