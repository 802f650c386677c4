"""Vowel / consonant structure of words and of the boundaries between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import fixed_values as fv


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip_non_letters(token: Column | str) -> Column:
    """Drop leading and trailing characters that are not letters; null gives ``''``."""
    text = F.coalesce(_col(token).cast("string"), F.lit(""))
    return F.regexp_replace(text, r"^\P{L}+|\P{L}+$", "")


def letter_class(char: Column | str, vowels: str = fv.VOWELS) -> Column:
    """``V``, ``C``, ``other`` or ``unknown`` (no character)."""
    col = _col(char)
    return (
        F.when(F.coalesce(col, F.lit("")) == "", "unknown")
        .when(col.rlike(f"^[{vowels}]$"), "V")
        .when(col.rlike(r"^\p{L}$"), "C")
        .otherwise("other")
    )


def first_char(stripped: Column) -> Column:
    return F.when(stripped != "", F.substring(stripped, 1, 1))


def last_char(stripped: Column) -> Column:
    return F.when(stripped != "", F.substring(stripped, -1, 1))


def leading_vowels(stripped: Column, vowels: str = fv.VOWELS) -> Column:
    return F.length(F.regexp_extract(stripped, f"^[{vowels}]*", 0))


def trailing_vowels(stripped: Column, vowels: str = fv.VOWELS) -> Column:
    return F.length(F.regexp_extract(stripped, f"[{vowels}]*$", 0))


def longest_vowel_run(stripped: Column, vowels: str = fv.VOWELS) -> Column:
    runs = F.regexp_extract_all(stripped, F.lit(f"[{vowels}]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def map_fixed(value: Column, table: dict) -> Column:
    """Small closed mapping; anything outside it is null."""
    (key, out), *rest = table.items()
    ladder = F.when(value == key, out)
    for key, out in rest:
        ladder = ladder.when(value == key, out)
    return ladder


def edge_class(char: Column, vowels: str = fv.VOWELS) -> Column:
    """Class of the first or last character of a stripped token: a letter, or nothing at all."""
    return F.when(F.coalesce(char, F.lit("")) == "", "unknown").when(F.contains(F.lit(vowels), char), "V").otherwise("C")


def add_boundary_columns(
    df: DataFrame, previous: str, word: str, initial: str, vowels: str = fv.VOWELS
) -> DataFrame:
    """Columns describing the boundary between a word and the one before it.

    Sentence-initial rows have type ``unknown`` yet keep their vowel run. The
    columns are built in stages, so that each pattern runs once per row.
    """
    stripped = df.withColumns({"prev_word_normalized": strip_non_letters(previous), "word_normalized": strip_non_letters(word)})
    before, after = F.col("prev_word_normalized"), F.col("word_normalized")
    edged = stripped.withColumns(
        {
            "orth_prev_final_cv": edge_class(F.substring(before, -1, 1), vowels),
            "orth_word_initial_cv": edge_class(F.substring(after, 1, 1), vowels),
        }
    )
    left, right = F.col("orth_prev_final_cv"), F.col("orth_word_initial_cv")
    kind = (
        F.when(F.col(initial) | (left == "unknown") | (right == "unknown"), "unknown")
        .when((left == "other") | (right == "other"), "other")
        .otherwise(F.concat(left, F.lit("#"), right))
    )
    run = F.when(left == "V", trailing_vowels(before, vowels)).otherwise(0) + F.when(right == "V", leading_vowels(after, vowels)).otherwise(0)
    typed = edged.withColumns({"orth_boundary_type": kind, "vocoid_run_cross_boundary": run})
    return typed.withColumns(
        {
            "boundary_opacity_score": boundary_score("orth_boundary_type"),
            "boundary_opacity_class": F.coalesce(map_fixed(F.col("orth_boundary_type"), fv.BOUNDARY_CLASSES), F.lit("unknown")),
        }
    )


def boundary_score(kind: Column | str) -> Column:
    return map_fixed(_col(kind), fv.BOUNDARY_SCORES)


def fallback_vocoid(kind: Column | str) -> Column:
    """Vowel-run stand-in when no boundary table carries the measured one."""
    return map_fixed(_col(kind), fv.BOUNDARY_VOCOIDS)


def add_word_vowels(df: DataFrame, word: str, vowels: str = fv.VOWELS) -> DataFrame:
    """Per-word vowel counts, ratio and shape flags."""
    base = df if "word_normalized" in df.columns else df.withColumn("word_normalized", strip_non_letters(word))
    norm = F.col("word_normalized")
    counted = base.withColumns(
        {
            "word_initial_cv_orth": edge_class(F.substring(norm, 1, 1), vowels),
            "word_final_cv_orth": edge_class(F.substring(norm, -1, 1), vowels),
            "within_word_vowel_run_max": longest_vowel_run(norm, vowels),
            "word_vowel_count": F.regexp_count(norm, F.lit(f"[{vowels}]")),
            "__letters": F.regexp_count(norm, F.lit(r"\p{L}")),
        }
    )
    v, n = F.col("word_vowel_count"), F.col("__letters")
    return counted.withColumns(
        {
            "starts_with_vowel": F.col("word_initial_cv_orth") == "V",
            "ends_with_vowel": F.col("word_final_cv_orth") == "V",
            "word_vowel_ratio": F.try_divide(v.cast("double"), n.cast("double")),
            "has_vowel": v > 0,
            "only_vowels": (n > 0) & (v == n),
            "only_consonants": (n > 0) & (v == 0),
        }
    ).drop("__letters")
