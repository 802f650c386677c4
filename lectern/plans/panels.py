"""Order lines as an observation panel: supplier = reader, part = word, priority = text.

The measures are stated functions of the line, its part and the reader's label,
so that slopes and group differences are not zero.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from lectern.functions.ids import normalize_participant
from lectern.functions.numeric import refixations, skip_flag
from lectern.operators.joins import dealt, many_to_one
from lectern.operators.panel import add_derived_columns, collapse_duplicates

WORD_COLUMNS = [
    "word_length_chars", "log_corpus_frequency", "lm_word_surprisal", "lm_word_entropy", "sentence_length_words",
    "word_position_in_sentence_norm", "prev_boundary_type_orth", "prev_boundary_opacity_score",
    "paragraph_cohesion", "local_semantic_drift", "lm_alignment_status", "lm_alignment_warning", "upos",
]


#: Lines a task sorts or groups at once, about: some 100 bytes each, so a task's memory does not grow with the table.
LINES_A_TASK = 250_000


def tasks(t) -> int | None:
    """How many tasks the lines are dealt over; none where the cores are enough."""
    found = math.ceil(t.lineitem.count() / LINES_A_TASK)
    return found if found > t.spark.sparkContext.defaultParallelism else None


def _label(balance):
    return F.when(balance >= 6000, 1).when(balance <= 4000, 0)


def participants(t) -> DataFrame:
    """Reader dimension: label with an uncertain band, metadata with gaps."""
    key = F.col("s_suppkey")
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return t.supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        normalize_participant(F.concat(F.lit("p"), key)).alias("participant_id"),
        _label(F.col("s_acctbal")).alias("label"),
        F.when(key % 7 != 0, (18 + key % 50).cast("int")).alias("age"),
        F.when(key % 11 != 0, F.when(key % 2 == 0, "F").otherwise("M")).alias("sex"),
        F.when(key % 13 != 0, 0.5 + (key % 50) / 100.0).alias("comprehension_score"),
        F.when(key % 9 == 0, "self report").when(key % 5 == 0, "weak screening").otherwise("formal").alias("label_provenance"),
        F.col("r_name").alias("recording_batch"),
    )


def word_features(t) -> DataFrame:
    """Word dimension with lexical, predictability, boundary and paragraph columns, some missing."""
    key = F.col("p_partkey")
    kinds = F.array(*[F.lit(k) for k in ("C#C", "C#V", "V#C", "V#V")])
    known = key % 13 != 0
    scored = key % 29 != 0
    return t.part.select(
        F.concat(F.lit("w"), key).alias("word_id"),
        F.floor(key / 10).alias("sentence_id"),
        F.floor(key / 50).alias("paragraph_id"),
        F.col("p_name").alias("word_form"),
        F.col("p_size").alias("word_length_chars"),
        F.log1p((key % 97).cast("double")).alias("log_corpus_frequency"),
        F.when(scored, (key % 17) / 2.0).alias("lm_word_surprisal"),
        F.when(scored, 1 + (key % 11) / 4.0).alias("lm_word_entropy"),
        (5 + key % 23).cast("int").alias("sentence_length_words"),
        ((key % 10) / 9.0).alias("word_position_in_sentence_norm"),
        F.when(known, F.get(kinds, (key % 4).cast("int"))).otherwise("unknown").alias("prev_boundary_type_orth"),
        F.when(known, (key % 4).cast("int")).alias("prev_boundary_opacity_score"),
        F.when(F.floor(key / 50) % 3 != 0, (key % 7) / 10.0).alias("paragraph_cohesion"),
        F.when(F.floor(key / 50) % 3 != 0, 1 - (key % 7) / 10.0).alias("local_semantic_drift"),
        F.when(scored, "ok").otherwise("error").alias("lm_alignment_status"),
        F.when(key % 31 == 0, "non_special_token_unassigned").alias("lm_alignment_warning"),
        F.when(key % 37 != 0, "NOUN").alias("upos"),
    )


def observations(t, parts: int | None = None) -> DataFrame:
    """Raw observations: several lines can hold the same (reader, word) pair."""
    quantity, price = F.col("l_quantity"), F.floor("l_extendedprice")
    lines = (
        t.lineitem.join(dealt(t.orders.select("o_orderkey", "o_orderpriority"), ["o_orderkey"], parts), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(dealt(t.part.select("p_partkey", "p_size"), ["p_partkey"], parts), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier.select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    seen = ~((F.col("l_returnflag") == "N") & (F.floor(quantity) % 7 == 0))
    ffd = 120.0 + price % 150
    gd = ffd + 2.5 * F.col("p_size")
    burden = 1 + 0.5 * F.coalesce(_label(F.col("s_acctbal")), F.lit(0))
    trt = gd + 4.0 * ((F.col("l_partkey") % 17) / 2.0) * burden + quantity
    fixations = F.when(
        ~((F.col("l_linestatus") == "F") & (F.floor(quantity) % 5 == 0)), (F.floor(quantity) % 4).cast("double")
    )
    return lines.select(
        normalize_participant(F.concat(F.lit("p"), F.col("l_suppkey"))).alias("participant_id"),
        F.concat(F.lit("w"), F.col("l_partkey")).alias("word_id"),
        F.substring("o_orderpriority", 1, 1).alias("text_id"),
        "l_orderkey",
        "l_linenumber",
        F.when(seen, ffd).alias("FFD"),
        F.when(seen, gd).alias("GD"),
        F.when(seen, trt).alias("TRT"),
        F.when(F.col("l_returnflag") != "R", trt + F.col("l_discount") * 1000).alias("go_past_time"),
        fixations.alias("fixation_count"),
    ).withColumns({"skip": skip_flag("fixation_count"), "refixation_count": refixations("fixation_count")})


def collapsed(t) -> DataFrame:
    """One row per (reader, word)."""
    parts = tasks(t)
    return collapse_duplicates(
        observations(t, parts), ["participant_id", "word_id"], ["l_orderkey", "l_linenumber"],
        drop=["l_orderkey", "l_linenumber"], flags=["skip"], parts=parts,
    )


def word_level(t) -> DataFrame:
    """The modelling table: panel with word and reader columns, derived columns added."""
    parts = tasks(t)
    full = many_to_one(collapsed(t), word_features(t), ["word_id"], "word table", parts)
    full = many_to_one(full, participants(t), ["participant_id"], "reader table", parts)
    return add_derived_columns(full, label="label")
