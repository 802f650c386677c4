"""Queries over readers: labels, samples, quality flags, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import audits, flags, participants, splits
from lectern.operators.sequence import by_rows
from lectern.plans import panels
from lectern.queries.registry import Tables, query
from lectern.queries.sql import PANEL, with_panel, with_people
from lectern.session import cut_lineage

GROUPS = """, labelled AS (SELECT *, CASE WHEN label IS NULL THEN 'uncertain' WHEN label = 1 THEN 'dyslexia_labeled' ELSE 'typical_control' END AS reader_group,
  label AS reader_group_binary, label_provenance AS label_source, CASE WHEN label IS NULL THEN 'unknown' ELSE 'project_metadata' END AS diagnostic_provenance,
  CASE WHEN label IS NULL THEN 'unknown' ELSE 'medium' END AS label_confidence, label IS NOT NULL AS include_primary_analysis, label IS NOT NULL AS include_sensitivity_analysis FROM people)"""


def grouped_readers(t: Tables):
    return participants.reader_groups(panels.participants(t))


@query("p24_a16_reader_labels", f"WITH {PANEL}{GROUPS}, c AS (SELECT participant_id, count(*) AS n_word_rows, count(DISTINCT word_id) AS n_words_read, count(DISTINCT text_id) AS n_texts FROM panel GROUP BY 1) SELECT labelled.*, n_word_rows, n_words_read, n_texts FROM labelled LEFT JOIN c USING (participant_id)", floats="comprehension_score")
def reader_labels(t: Tables):
    """Reader label table with reading counts."""
    return grouped_readers(t).join(participants.reading_counts(panels.collapsed(t)), "participant_id", "left")


@query(
    "a17_label_report_missing",
    with_people("""SELECT unnest(['age', 'sex', 'comprehension_score']) AS field, unnest([count(*) - count(age), count(*) - count(sex), count(*) - count(comprehension_score)]) AS missing,
  unnest([avg((age IS NULL)::INT), avg((sex IS NULL)::INT), avg((comprehension_score IS NULL)::INT)]) AS missing_rate FROM people"""),
    floats="missing_rate",
)
def label_report_missing(t: Tables):
    """Missing reader metadata."""
    return audits.missing_fields(panels.participants(t), ["age", "sex", "comprehension_score"])


@query(
    "a17_label_report_groups",
    f"""WITH {PANEL}{GROUPS}, c AS (SELECT participant_id, count(*) AS n FROM panel GROUP BY 1)
SELECT reader_group, sex, count(*) AS participants, avg(age) AS mean_age, avg(comprehension_score) AS mean_comprehension, avg(n) AS mean_word_rows, sum(n)::BIGINT AS total_word_rows
FROM labelled LEFT JOIN c USING (participant_id) GROUP BY 1, 2""",
    floats="mean_age mean_comprehension mean_word_rows",
)
def label_report_groups(t: Tables):
    """Size, age, score and reading volume by group and sex; null sex kept as a group."""
    rows = grouped_readers(t).join(participants.reading_counts(panels.collapsed(t)), "participant_id", "left")
    return rows.groupBy("reader_group", "sex").agg(
        F.count("participant_id").alias("participants"), F.avg("age").alias("mean_age"),
        F.avg("comprehension_score").alias("mean_comprehension"), F.avg("n_word_rows").alias("mean_word_rows"),
        F.sum("n_word_rows").alias("total_word_rows"),
    )


@query("f01_exclude_listed", with_panel("SELECT participant_id, word_id, TRT FROM panel WHERE participant_id NOT IN ('P14', 'P03') AND text_id <> '5'"), floats="TRT")
def exclude_listed(t: Tables):
    """Listed readers and texts removed."""
    return participants.exclude_listed(panels.collapsed(t), ["P14", "P03"], ["5"]).select("participant_id", "word_id", "TRT")


@query(
    "f02_class_aware_sample",
    with_people(""", known AS (SELECT participant_id, label FROM people WHERE label IS NOT NULL),
seat AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY participant_id) AS k FROM known),
rest AS (SELECT * FROM seat WHERE k > 1 ORDER BY participant_id LIMIT 3)
SELECT participant_id, label, 'class' AS seat FROM seat WHERE k <= 1 UNION ALL SELECT participant_id, label, 'fill' FROM rest"""),
)
def class_aware_sample(t: Tables):
    """One reader per class, then three more by id."""
    return participants.class_aware_sample(panels.participants(t), 5, 1)


@query(
    "f03_limited_sample",
    with_panel(""", r AS (SELECT DISTINCT participant_id FROM panel ORDER BY 1 LIMIT 8), s AS (SELECT * FROM panel WHERE participant_id IN (SELECT * FROM r)),
pop AS (SELECT text_id FROM (SELECT text_id, count(DISTINCT participant_id) AS n FROM s GROUP BY 1) ORDER BY n DESC, text_id LIMIT 2),
cov AS (SELECT DISTINCT participant_id FROM s WHERE text_id IN (SELECT * FROM pop)),
add AS (SELECT DISTINCT text_id FROM (SELECT participant_id, text_id, dense_rank() OVER (PARTITION BY participant_id ORDER BY text_id) AS k FROM s WHERE participant_id NOT IN (SELECT * FROM cov)) WHERE k <= 2)
SELECT participant_id, text_id, count(*) AS rows FROM s WHERE text_id IN (SELECT * FROM pop UNION SELECT * FROM add) GROUP BY 1, 2"""),
)
def limited_sample(t: Tables):
    """First eight readers, two most-read texts, coverage kept."""
    rows = participants.limit_sample(panels.collapsed(t).select("participant_id", "text_id", "word_id"), 8, 2)
    return rows.groupBy("participant_id", "text_id").agg(F.count(F.lit(1)).alias("rows"))


@query("f04_hash_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('17|' || o_orderkey) LIMIT 500")
def hash_sample(t: Tables):
    """A repeatable sample of exactly 500 orders."""
    return participants.hash_sample(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], 500, 17)


@query(
    "f05_w11_length_budget",
    """WITH r AS (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words_before FROM documents)
SELECT doc_id, n_chars, words_before, least(n_chars, 250000 - words_before) AS words_taken FROM r WHERE words_before < 250000""",
)
def length_budget(t: Tables):
    """Leading documents within a total length, the last in part."""
    return participants.word_budget(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", 250000, by_rows("doc_id", 64))


@query(
    "f07_x06_sensitivity_sets",
    with_people("""SELECT participant_id, 'without_reader' AS reader_set FROM people WHERE participant_id <> 'P32'
UNION ALL SELECT participant_id, 'strong_or_unspecified_provenance' FROM people WHERE NOT regexp_matches(label_provenance, '(?i)weak|self')"""),
)
def sensitivity_sets(t: Tables):
    """Reader sets without one reader and without weak provenance."""
    return participants.sensitivity_sets(panels.participants(t), "P32")


@query("f08_complete_cases", with_panel("SELECT participant_id, word_id FROM word_level WHERE TRT IS NOT NULL AND lm_word_surprisal IS NOT NULL AND age IS NOT NULL"))
def complete_cases(t: Tables):
    """Rows complete on outcome and predictors."""
    return panels.word_level(t).na.drop(subset=["TRT", "lm_word_surprisal", "age"]).select("participant_id", "word_id")


@query(
    "f09_prepare_participants",
    """WITH n AS (SELECT c_custkey, 'P' || lpad((c_custkey % 120)::VARCHAR, greatest(2, length((c_custkey % 120)::VARCHAR))::INT, '0') AS participant_id, (CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal < 0 THEN 0 END)::INTEGER AS label FROM customer),
o AS (SELECT DISTINCT 'P' || CASE WHEN l_suppkey < 10 THEN '0' ELSE '' END || l_suppkey AS participant_id FROM lineitem)
SELECT participant_id, c_custkey, label FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY c_custkey) AS k FROM n WHERE participant_id <> 'P14' AND participant_id IN (SELECT * FROM o)) WHERE k = 1""",
)
def prepare_participants(t: Tables):
    """Reader rows from a raw register with repeats, kept when observed."""
    raw = t.customer.select(
        "c_custkey", F.concat(F.lit("p"), F.col("c_custkey") % 120).alias("subj"),
        F.when(F.col("c_acctbal") > 5000, "yes").when(F.col("c_acctbal") < 0, "control").alias("raw_label"),
    )
    observed = panels.observations(t).select("participant_id")
    out = participants.prepare_participants(raw, observed, "subj", "raw_label", ["c_custkey"])
    return out.select("participant_id", "c_custkey", "label")


_COUNTS = ", c AS (SELECT participant_id, count(*) AS n_word_rows, count(DISTINCT word_id) AS n_words_read, count(DISTINCT text_id) AS n_texts FROM panel GROUP BY 1), exposed AS (SELECT labelled.*, c.* EXCLUDE (participant_id) FROM labelled JOIN c USING (participant_id))"
OVERLAP = f"""WITH {PANEL}{GROUPS}{_COUNTS},
rg AS (SELECT reader_group, min(n_words_read) AS a, max(n_words_read) AS b, min(n_word_rows) AS c, max(n_word_rows) AS d FROM exposed WHERE reader_group <> 'uncertain' GROUP BY 1),
lim AS (SELECT count(*) AS g, max(a) AS a, min(b) AS b, max(c) AS c, min(d) AS d FROM rg),
kept0 AS (SELECT exposed.* FROM exposed, lim WHERE reader_group <> 'uncertain' AND g >= 2 AND n_words_read BETWEEN a AND b AND n_word_rows BETWEEN lim.c AND lim.d),
ok AS (SELECT count(*) >= 2 AND min(n) >= 3 AS ok FROM (SELECT reader_group, count(*) AS n FROM kept0 GROUP BY 1)),
kept AS (SELECT kept0.* FROM kept0, ok WHERE ok)"""


def exposed_readers(t: Tables):
    counts = participants.reading_counts(panels.collapsed(t))
    return grouped_readers(t).join(counts, "participant_id").where("reader_group <> 'uncertain'")


@query("f10_exposure_overlap", f"{OVERLAP} SELECT participant_id, reader_group, n_words_read, n_word_rows FROM kept")
def exposure_overlap(t: Tables):
    """Readers inside the exposure range shared by both groups."""
    return participants.exposure_overlap(exposed_readers(t), "reader_group", ["n_words_read", "n_word_rows"]).select(
        "participant_id", "reader_group", "n_words_read", "n_word_rows"
    )


def quality_rows(t: Tables):
    """Modelling rows with labels, quality flags and a stand-in boundary label version."""
    rows = participants.reader_groups(panels.word_level(t)).withColumns(
        {
            "reader_group": F.when(F.col("recording_batch") != "ASIA", F.col("reader_group")),
            "segmentation_label_version": F.when(F.col("prev_boundary_type_orth") != "unknown", "v1"),
        }
    )
    return flags.quality_labels(rows)


QUALITY = (
    PANEL
    + """, q0 AS (SELECT *, CASE WHEN recording_batch <> 'ASIA' THEN CASE WHEN label IS NULL THEN 'uncertain' WHEN label = 1 THEN 'dyslexia_labeled' ELSE 'typical_control' END END AS reader_group,
  CASE WHEN prev_boundary_type_orth <> 'unknown' THEN 'v1' END AS segmentation_label_version FROM word_level),
q AS (SELECT *, TRT IS NULL AND FFD IS NULL AND GD IS NULL AS gaze_missing, reader_group IS NULL AS participant_label_missing, segmentation_label_version IS NULL AS segmentation_label_missing,
  lm_word_surprisal IS NULL AS lm_missing, upos IS NULL AS parser_missing, 'surface_heuristic_fallback' AS parser_status, paragraph_cohesion IS NULL AND local_semantic_drift IS NULL AS embedding_missing,
  age IS NULL OR sex IS NULL OR comprehension_score IS NULL AS participant_metadata_missing,
  label IS NOT NULL AND reader_group IS NOT NULL AND segmentation_label_version IS NOT NULL AS include_primary_analysis,
  label IS NOT NULL AND reader_group IS NOT NULL AS include_sensitivity_analysis,
  concat_ws(';', CASE WHEN reader_group IS NULL THEN 'participant_label_missing' END, CASE WHEN segmentation_label_version IS NULL THEN 'segmentation_label_missing' END) AS exclusion_reason FROM q0)
"""
)
_FLAGS = list(flags.FLAGS)


@query("p25_p26_f06_quality_labels", f"WITH {QUALITY} SELECT participant_id, word_id, {', '.join(_FLAGS)}, include_primary_analysis, include_sensitivity_analysis, exclusion_reason FROM q")
def quality_labels(t: Tables):
    """Row flags, inclusion and exclusion reasons."""
    return quality_rows(t).select("participant_id", "word_id", *_FLAGS, "include_primary_analysis", "include_sensitivity_analysis", "exclusion_reason")


@query(
    "x01_grouped_folds",
    with_people(""", h AS (SELECT participant_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('17|' || participant_id)) - 1 AS i FROM people WHERE label IS NOT NULL),
k AS (SELECT greatest(2, least(5, sum(n), CASE WHEN count(*) > 1 THEN min(n) ELSE 1 END))::INT AS k FROM (SELECT count(*) AS n FROM h GROUP BY label))
SELECT 'participant_grouped_kfold' AS split_name, f::INT AS fold_id, CASE WHEN i % k = f THEN 'test' ELSE 'train' END AS split_role, participant_id, label FROM h, k, unnest(range(0, k)) AS u(f)"""),
)
def grouped_folds(t: Tables):
    """Stratified grouped folds in md5 order."""
    return splits.grouped_folds(panels.participants(t), "participant_id", "label")


@query(
    "x02_j14_leave_one_reader_out",
    with_people(""", r AS (SELECT participant_id, (row_number() OVER (ORDER BY participant_id) - 1)::INT AS i FROM people)
SELECT 'leave_one_participant_out' AS split_name, a.i AS fold_id, CASE WHEN a.i = b.i THEN 'test' ELSE 'train' END AS split_role, b.participant_id FROM r a, r b"""),
)
def leave_one_reader_out(t: Tables):
    """One fold per reader."""
    return splits.leave_one_out(panels.participants(t), "participant_id")


@query(
    "x03_leave_one_text_out",
    """WITH r AS (SELECT x AS text_id, (row_number() OVER (ORDER BY x) - 1)::INT AS i FROM (SELECT DISTINCT o_orderpriority AS x FROM orders))
SELECT 'leave_one_text_out' AS split_name, a.i AS fold_id, CASE WHEN a.i = b.i THEN 'test' ELSE 'train' END AS split_role, b.text_id FROM r a, r b""",
)
def leave_one_text_out(t: Tables):
    """One fold per text."""
    return splits.leave_one_out(t.orders.select(F.col("o_orderpriority").alias("text_id")), "text_id", "leave_one_text_out")


def all_splits(t: Tables, **options):
    counts = cut_lineage(participants.reading_counts(panels.collapsed(t)))  # read by rows and counts: the panel is built once
    return splits.split_labels(grouped_readers(t), counts, **options)


SPLITS = (
    PANEL
    + GROUPS
    + """, r AS (SELECT participant_id, (row_number() OVER (ORDER BY participant_id) - 1)::INT AS i FROM people),
h AS (SELECT participant_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('17|' || participant_id)) - 1 AS i FROM people WHERE label IS NOT NULL),
k AS (SELECT greatest(2, least(5, sum(n), CASE WHEN count(*) > 1 THEN min(n) ELSE 1 END))::INT AS k FROM (SELECT count(*) AS n FROM h GROUP BY label)),
parts AS (SELECT 'leave_one_participant_out' AS split_name, a.i AS fold_id, CASE WHEN a.i = b.i THEN 'test' ELSE 'train' END AS split_role, b.participant_id FROM r a, r b
  UNION ALL SELECT 'participant_grouped_kfold', f::INT, CASE WHEN i % k = f THEN 'test' ELSE 'train' END, participant_id FROM h, k, unnest(range(0, k)) AS u(f)
  UNION ALL SELECT 'sensitivity_exclude_uncertain_labels', 0, CASE WHEN reader_group = 'uncertain' THEN 'exclude' ELSE 'include' END, participant_id FROM labelled),
nrows AS (SELECT participant_id, count(*) AS n FROM panel GROUP BY 1),
d AS (SELECT parts.*, reader_group, coalesce(n, 0) AS n FROM parts LEFT JOIN labelled USING (participant_id) LEFT JOIN nrows USING (participant_id)),
fc AS (SELECT split_name, fold_id, count(*) FILTER (WHERE split_role IN ('train', 'include')) AS n_train_participants, count(*) FILTER (WHERE split_role = 'test') AS n_test_participants,
  count(*) FILTER (WHERE split_role IN ('train', 'include') AND reader_group = 'dyslexia_labeled') AS n_train_dyslexia_labeled,
  count(*) FILTER (WHERE split_role IN ('train', 'include') AND reader_group = 'typical_control') AS n_train_typical_control,
  count(*) FILTER (WHERE split_role = 'test' AND reader_group = 'dyslexia_labeled') AS n_test_dyslexia_labeled,
  count(*) FILTER (WHERE split_role = 'test' AND reader_group = 'typical_control') AS n_test_typical_control,
  coalesce(sum(n) FILTER (WHERE split_role IN ('train', 'include')), 0)::BIGINT AS n_train_word_rows, coalesce(sum(n) FILTER (WHERE split_role = 'test'), 0)::BIGINT AS n_test_word_rows,
  true AS split_valid, '' AS skip_reason FROM d GROUP BY 1, 2)
"""
)


@query("x04_a31_split_labels", f"WITH {SPLITS} SELECT d.split_name, d.fold_id, split_role, participant_id, reader_group, fc.* EXCLUDE (split_name, fold_id), split_role IN ('train', 'test', 'include') AS include_in_fold, 17 AS split_seed, 'split_policy_v1' AS split_version FROM d JOIN fc ON d.split_name = fc.split_name AND d.fold_id = fc.fold_id")
def split_labels(t: Tables):
    """All splits with counts and validity."""
    return all_splits(t)


@query("a31_fold_counts", f"WITH {SPLITS} SELECT * FROM fc")
def fold_counts(t: Tables):
    """Counts per fold, from one row per reader and split."""
    readers = grouped_readers(t)
    counts = participants.reading_counts(panels.collapsed(t))
    folds = splits.compact_folds(readers).join(readers.select("participant_id", "reader_group"), "participant_id", "left")
    return splits.compact_fold_counts(folds.join(counts.select("participant_id", "n_word_rows"), "participant_id", "left"))


@query(
    "x05_exposure_balanced_splits",
    f"""{OVERLAP}, r AS (SELECT participant_id, reader_group, (row_number() OVER (ORDER BY participant_id) - 1)::INT AS i FROM kept)
SELECT 'text_balanced_sensitivity_lopo' AS split_name, a.i AS fold_id, CASE WHEN a.i = b.i THEN 'test' ELSE 'train' END AS split_role, b.participant_id, b.reader_group FROM r a, r b""",
)
def exposure_balanced_splits(t: Tables):
    """Leave-one-out among readers with overlapping exposure."""
    out = splits.exposure_balanced_leave_one_out(exposed_readers(t), ["n_words_read", "n_word_rows"])
    return out.select("split_name", "fold_id", "split_role", "participant_id", "reader_group")


@query(
    "u02_union_of_split_tables",
    f"""WITH {SPLITS}, x AS (SELECT split_name, fold_id, split_role, participant_id, fc.n_test_participants FROM d JOIN fc USING (split_name, fold_id) WHERE split_name = 'participant_grouped_kfold'
  UNION ALL SELECT 'leave_one_text_out', 0, 'test', participant_id, NULL FROM people) SELECT * FROM x""",
)
def union_of_split_tables(t: Tables):
    """Union of tables with different columns, the missing one null."""
    base = all_splits(t, names=[splits.GROUPED]).select("split_name", "fold_id", "split_role", "participant_id", "n_test_participants")
    extra = panels.participants(t).select(
        F.lit("leave_one_text_out").alias("split_name"), F.lit(0).alias("fold_id"), F.lit("test").alias("split_role"), "participant_id"
    )
    return splits.with_extra_splits(base, extra)
