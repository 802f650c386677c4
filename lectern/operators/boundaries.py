"""Boundary labels between neighbouring words and their summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import fixed_values as fv
from lectern.functions.numeric import interval_labels, ratio, right_closed_bin
from lectern.functions.orthography import add_boundary_columns
from lectern.operators.sequence import ordered_features

#: Key of a sentence; its words come from one text cell, so a plain window over it is small.
SENTENCE = ("text_id", "p", "s")


def boundary_table(
    words: DataFrame,
    sentence: Sequence[str] = SENTENCE,
    order: Sequence[str] = ("w",),
    word: str = "word_form",
    chunk: Column | None = None,
    include_initial: bool = True,
    vowels: str = fv.VOWELS,
    paragraph_start: Column | None = None,
) -> DataFrame:
    """One row per word: the boundary to the word before it in its sentence.

    ``paragraph_start`` tells the first word of a paragraph and adds
    ``is_paragraph_initial_boundary``.

    A ``prev_word`` column already on the rows (the tokeniser provides it) is
    used as is; otherwise the neighbour is looked up in order.
    """
    base = words
    if "prev_word" not in base.columns:
        base = ordered_features(
            base, sentence, order, chunk=chunk, previous={"prev_word": word, "prev_word_id": "word_id"}
        )
    elif "prev_word_id" not in base.columns:
        base = base.withColumn(
            "prev_word_id", F.when(F.col("prev_word").isNotNull(), F.concat("sentence_id", F.lit("_w"), F.col("w") - 1))
        )
    initial = F.col("prev_word_id").isNull()
    labelled = base.withColumn("is_sentence_initial_boundary", initial)
    if paragraph_start is not None:
        labelled = labelled.withColumn("is_paragraph_initial_boundary", initial & paragraph_start)
    labelled = add_boundary_columns(labelled, "prev_word", word, "is_sentence_initial_boundary", vowels)
    return labelled if include_initial else labelled.where(~F.col("is_sentence_initial_boundary"))


def neighbour_boundaries(boundaries: DataFrame, sentence: Sequence[str] = SENTENCE, order: Sequence[str] = ("w",), chunk: Column | None = None) -> DataFrame:
    """Boundary before and boundary after each word: the latter is the next row's own."""
    parts = {"type": "orth_boundary_type", "score": "boundary_opacity_score", "class": "boundary_opacity_class"}
    placed = ordered_features(
        boundaries, sentence, order, chunk=chunk, following={f"next_boundary_{k}": c for k, c in parts.items()}
    )
    return placed.withColumnsRenamed({c: f"prev_boundary_{k}" for k, c in parts.items()})


def sentence_summary(boundaries: DataFrame, by: Sequence[str] = ("text_id", "paragraph_id", "sentence_id")) -> DataFrame:
    """Boundary counts, rates and opacity per sentence, and the vowel rates of its words.

    Boundaries and words are the same rows, so one aggregation serves both.
    """
    inner = ~F.col("is_sentence_initial_boundary")
    kind, score = F.col("orth_boundary_type"), F.when(inner, F.col("boundary_opacity_score"))
    counts = {t: F.count_if(inner & (kind == t)) for t in fv.BOUNDARY_SCORES}
    n = F.greatest(F.count_if(inner), F.lit(1))
    vowel_ends = counts["C#V"] + counts["V#C"] + counts["V#V"]
    return boundaries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_words"),
        F.count_if(inner).alias("n_boundaries"),
        *[c.alias("n_" + t.replace("#", "_hash_")) for t, c in counts.items()],
        ratio(counts["V#V"], n).alias("sentence_vv_boundary_rate"),
        ratio(vowel_ends, n).alias("sentence_v_boundary_rate"),
        F.avg(score).alias("sentence_mean_boundary_opacity"),
        F.max(score).cast("double").alias("sentence_max_boundary_opacity"),
        F.avg(F.col("starts_with_vowel").cast("int")).alias("sentence_vowel_initial_word_rate"),
        F.avg(F.col("ends_with_vowel").cast("int")).alias("sentence_vowel_final_word_rate"),
        F.avg("within_word_vowel_run_max").alias("sentence_mean_within_word_vowel_run"),
        F.max("within_word_vowel_run_max").alias("sentence_max_within_word_vowel_run"),
    )


LENGTH_EDGES = [0.0, 5.0, 10.0, 20.0, 40.0, float("inf")]
LENGTH_LABELS = interval_labels(LENGTH_EDGES)


def by_sentence_length(sentences: DataFrame) -> DataFrame:
    """Mean opacity and V#V rate per sentence-length bin."""
    label = right_closed_bin("n_words", LENGTH_EDGES, LENGTH_LABELS)
    return sentences.groupBy(label.alias("sentence_length_bin")).agg(
        F.count(F.lit(1)).alias("sentences"),
        F.avg("sentence_mean_boundary_opacity").alias("mean_opacity"),
        F.avg("sentence_vv_boundary_rate").alias("vv_rate"),
    )


def top_words_at(boundaries: DataFrame, kind: str = "V#V", k: int = 20) -> DataFrame:
    """The k forms seen most often on either side of a boundary type; ties by form."""
    sides = boundaries.where((F.col("orth_boundary_type") == kind)).select(
        F.explode(F.array("prev_word", "word_form")).alias("word")
    )
    return sides.groupBy("word").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "word").limit(k)


#: Rows a task holds while it looks for the first of each group.
HELD = 100_000


def _first_in_task(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """At least the first k rows of each group among a task's rows, batch by batch: nothing is sorted but a batch and what is held."""

    def first(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(order, "ascending")], null_placement="at_start"))
        codes = rows.column(group).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        by_group = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(codes[by_group]) != 0])
        rank = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
        return rows.take(pa.array(by_group[rank < k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = first(rows if held is None else pa.concat_tables([held, rows]))
            if held.num_rows > HELD:  # many groups: the shuffle sees to them
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return df.mapInArrow(run, df.schema)


def examples_per_group(df: DataFrame, group: str, order: str, k: int, columns: Sequence[str]) -> DataFrame:
    """The first k rows of each group in order.

    For groups and orders of plain types a task holds the first k rows of each group and
    no others; otherwise Spark limits each group inside every task, which sorts its rows, for
    a rank filter up to 1000 rows. A larger k is ranked over salts first, so a task holds a
    share of a group, and then at most 64 k rows.
    """
    df = df.select(*dict.fromkeys([group, order, *columns]))
    kinds = dict(df.dtypes)
    if k > 1000:
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(order, *columns), F.lit(64)))
        first = F.row_number().over(Window.partitionBy(group, "__salt").orderBy(order))
        df = salted.withColumn("__k", first).where(F.col("__k") <= k).drop("__salt", "__k")
    elif {kinds[group], kinds[order]} <= PLAIN:
        df = _first_in_task(df, group, order, k)
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return ranked.where(F.col("__k") <= k).select(*columns)


#: Types that Arrow orders as Spark does.
PLAIN = {"string", "int", "bigint", "smallint", "tinyint", "date"}
