"""Positions, offsets and roll-ups along the text hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.numeric import ratio, to_number
from lectern.functions.tokens import lix
from lectern.operators.sequence import ordered_features


#: Keys of the units. A unit's words come from one text cell, which a single task
#: has already held when it split the text: plain windows over them are bounded by
#: a cell. Hash partitioning on the paragraph also serves the sentence windows, so
#: both units share one shuffle when the paragraph comes first.
SENTENCE = ("text_id", "p", "s")
PARAGRAPH = ("text_id", "p")


def add_positions(words: DataFrame, unit: str, key: Sequence[str], order: Sequence[str], chunk: Column | None = None) -> DataFrame:
    """0-based index, unit length and relative position (0 for a single word).

    Pass a ``chunk`` for units that are not bounded by a text cell.
    """
    placed = ordered_features(
        words, key, order, chunk=chunk, index=f"word_index_in_{unit}", size=f"{unit}_length_words"
    )
    relative = F.coalesce(ratio(F.col(f"word_index_in_{unit}"), F.col(f"{unit}_length_words") - 1), F.lit(0.0))
    return placed.withColumn(f"word_position_in_{unit}_norm", relative)


def add_offsets(
    words: DataFrame, unit: str, key: Sequence[str], order: Sequence[str], word: str = "word_form", chunk: Column | None = None
) -> DataFrame:
    """Character span of each word when the unit's words are joined by one blank."""
    start, length = f"word_start_in_{unit}", F.length(F.coalesce(F.col(word), F.lit("")))
    placed = ordered_features(words, key, order, chunk=chunk, running={start: length + 1})
    return placed.withColumn(f"word_end_in_{unit}", F.col(start) + length)


def joined_text(word: str, order: Sequence[str]) -> Column:
    """Ordered text of a group as an aggregate. The result is one cell, so its group is one cell's size."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(word).alias("__word"))))
    return F.array_join(F.transform(items, lambda x: x["__word"]), " ")


def sentences_of(words: DataFrame) -> DataFrame:
    """Sentence table: text, word count, mean word length."""
    return words.groupBy("text_id", "paragraph_id", "sentence_id").agg(
        joined_text("word_form", ["w"]).alias("sentence_text"),
        F.count("word_id").alias("sentence_length_words"),
        F.avg(F.length("word_form")).alias("mean_word_length_chars"),
    )


def paragraphs_of(words: DataFrame) -> DataFrame:
    """Paragraph table with its number of sentences."""
    return words.groupBy("text_id", "paragraph_id").agg(
        joined_text("word_form", ["s", "w"]).alias("paragraph_text"),
        F.count("word_id").alias("paragraph_length_words"),
        F.countDistinct("sentence_id").alias("sentence_count"),
        F.avg(F.length("word_form")).alias("mean_word_length_chars"),
    )


def _mean_length(tokens: Column) -> Column:
    chars = F.aggregate(tokens, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return chars / F.size(tokens)


def sentence_table(sentences: DataFrame, keep: Sequence[str | Column]) -> DataFrame:
    """What ``sentences_of`` gives, from a row per sentence with its ``tokens`` in order: no shuffle."""
    tokens = F.col("tokens")
    return sentences.where(F.size(tokens) > 0).select(
        *keep,
        F.array_join(tokens, " ").alias("sentence_text"),
        F.size(tokens).cast("long").alias("sentence_length_words"),
        _mean_length(tokens).alias("mean_word_length_chars"),
    )


def paragraph_table(paragraphs: DataFrame, keep: Sequence[str | Column]) -> DataFrame:
    """What ``paragraphs_of`` gives, from a row per paragraph with the ``tokens`` of each piece: no shuffle."""
    tokens = F.flatten("pieces")
    held = paragraphs.select(*keep, tokens.alias("tokens"), F.size(F.filter("pieces", lambda x: F.size(x) > 0)).cast("long").alias("sentence_count"))
    words = F.col("tokens")
    kept = [c for c in held.columns if c not in ("tokens", "sentence_count")]
    return held.where(F.size(words) > 0).select(
        *kept,
        F.array_join(words, " ").alias("paragraph_text"),
        F.size(words).cast("long").alias("paragraph_length_words"),
        "sentence_count",
        _mean_length(words).alias("mean_word_length_chars"),
    )


def sentence_readability(words: DataFrame, long_word: Column, by: Sequence[str] = ("text_id", "paragraph_id", "sentence_id")) -> DataFrame:
    """Words, long words and LIX of each sentence, in one aggregation."""
    counted = words.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sentence_length_words"), F.sum(long_word.cast("int")).alias("lix_long_word_count")
    )
    return counted.withColumn("lix_component", lix(F.col("sentence_length_words"), F.col("lix_long_word_count")))


def paragraph_readability(sentences: DataFrame) -> DataFrame:
    """Mean LIX and longest sentence per paragraph; stacked on the sentence aggregate."""
    return sentences.groupBy("text_id", "paragraph_id").agg(
        F.avg("lix_component").alias("mean_lix_component"),
        F.max("sentence_length_words").alias("max_sentence_length_words"),
        F.count(F.lit(1)).alias("sentence_count"),
        F.sum("sentence_length_words").alias("paragraph_length_words"),
    )


def text_readability(paragraphs: DataFrame) -> DataFrame:
    """Text-level roll-up of the paragraph table."""
    return paragraphs.groupBy("text_id").agg(
        F.count("paragraph_id").alias("paragraph_count"),
        F.sum("sentence_count").alias("sentence_count"),
        F.sum("paragraph_length_words").alias("word_count"),
        F.avg("paragraph_length_words").alias("mean_paragraph_length_words"),
        F.avg("mean_lix_component").alias("mean_lix_component"),
    )


def unit_positions(units: DataFrame, parent: Sequence[str], order: Sequence[str], name: str, chunk: Column | None = None) -> DataFrame:
    """0-based position of a unit inside its parent."""
    return ordered_features(units, parent, order, chunk=chunk, index=name)


def stable_order(df: DataFrame, first: Sequence[str], numeric: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    """Sort with id tokens compared as numbers, nulls last: one range-partitioned sort."""
    keys = [F.col(c).asc_nulls_last() for c in first]
    keys += [to_number(c).asc_nulls_last() for c in numeric]
    keys += [F.col(c).asc_nulls_last() for c in last]
    return df.orderBy(*keys)
