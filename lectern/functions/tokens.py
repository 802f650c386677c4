"""Surface, syllable and heuristic part-of-speech features of a word form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from lectern.functions import fixed_values as fv


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


@F.pandas_udf(StringType())
def nfc(words: pd.Series) -> pd.Series:
    """Unicode NFC form; null counts as the empty string. The one step Spark has no builtin for."""
    return words.fillna("").str.normalize("NFC")


def with_nfc(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the NFC form of a column. Pure-ASCII text is normal already and stays clear of Python.

    The two kinds of rows are separate branches: a ``CASE`` would send every row to Python.
    """
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return df.where(plain).withColumn(out, text).unionByName(df.where(~plain).withColumn(out, nfc(text)))


def syllables(word: Column | str, vowels: str = fv.VOWELS) -> Column:
    """Vowel clusters, at least one, zero for the empty word."""
    col = _col(word)
    clusters = F.regexp_count(col, F.lit(f"[{vowels}]+"))
    return F.when(F.coalesce(col, F.lit("")) == "", 0).otherwise(F.greatest(F.lit(1), clusters))


def syllable_source(word: Column | str) -> Column:
    return F.when(F.coalesce(_col(word), F.lit("")) == "", "empty").otherwise("vowel_cluster_fallback")


def characters(text: Column | str) -> Column:
    """Array of the code points of a text."""
    return F.regexp_extract_all(_col(text), F.lit("(?s)."), F.lit(0))


def surface_features(
    df: DataFrame,
    word: str = "word_form",
    stop_words: tuple[str, ...] = fv.STOP_WORDS,
    compound_linker: str = "s",
    long_from: int = fv.LONG_WORD_CHARS,
    compound_from: int = fv.COMPOUND_CHARS,
) -> DataFrame:
    """Punctuation, case, digit, hyphen, length and word-list flags of a word column."""
    base = df.withColumn("normalized_word", F.trim(F.coalesce(F.col(word), F.lit(""))))
    form, lower = F.col("normalized_word"), F.lower("normalized_word")
    base = base.withColumns({"lowercase_form": lower, "word_length_chars": F.length(word)})
    low, size = F.col("lowercase_form"), F.col("word_length_chars")
    hyphens = F.regexp_count(form, F.lit("-"))
    return base.withColumns(
        {
            "has_punctuation": form.rlike(r"[^\p{L}\p{N}_\s]"),
            "is_punctuation_only": form.rlike(r"^[^\p{L}\p{N}_]+$"),
            "is_capitalized": form.rlike(f"^[{fv.CAPITALS}]"),
            "is_all_caps": form.rlike(f"^[{fv.CAPITALS}]+$"),
            "has_digit": form.rlike(r"\p{Nd}"),
            "hyphen_count": hyphens,
            "unique_char_count": F.size(F.array_distinct(characters(low))),
            "compound_proxy": (size >= compound_from) | (hyphens > 0) | low.contains(compound_linker),
            "function_word_flag": low.isin(*stop_words),
            "long_word_lix_component": (size >= long_from).cast("int"),
        }
    )


def ends_with_any(word: Column, suffixes: tuple[str, ...]) -> Column:
    return word.rlike("(" + "|".join(suffixes) + ")$")


def heuristic_pos(word: Column | str) -> Column:
    """Word lists first, then verb endings, then capitals; everything else is a noun."""
    form = _col(word)
    low = F.lower(form)
    first = F.substring(form, 1, 1)
    return (
        F.when(low.isin(*fv.ADPOSITIONS), "ADP")
        .when(low.isin(*fv.STOP_WORDS), "SCONJ")
        .when(low.isin(*fv.NEGATIONS), "PART")
        .when(ends_with_any(low, fv.VERB_SUFFIXES), "VERB")
        .when(first.rlike(r"^\p{Lu}"), "PROPN")
        .otherwise("NOUN")
    )


def pos_flags(df: DataFrame, word: str = "word_form") -> DataFrame:
    """Part of speech, its flags, word-list flags and the constant parse columns."""
    low = F.lower(F.col(word))
    tagged = df.withColumn("upos", heuristic_pos(word))
    pos = F.col("upos")
    return tagged.withColumns(
        {
            "lemma": low,
            "xpos": pos,
            "morph_features": F.lit(""),
            "dep_rel": F.lit("unknown"),
            "dep_head_position": F.lit(-1),
            "dependency_distance": F.lit(0),
            "is_root": F.lit(False),
            "is_finite_verb": pos == "VERB",
            "is_noun_or_proper": pos.isin("NOUN", "PROPN"),
            "is_pronoun": low.isin(*fv.PRONOUNS),
            "is_function_word": low.isin(*fv.STOP_WORDS),
            "is_negation": low.isin(*fv.NEGATIONS),
            "is_coordination": low.isin(*fv.COORDINATORS),
            "subordinate_clause_proxy": low.isin(*fv.SUBORDINATORS),
            "parser_backend": F.lit("surface_heuristic"),
        }
    )


def lix(words: Column, long_words: Column) -> Column:
    """Length plus the percentage of long words; zero for an empty unit."""
    share = F.try_divide(100.0 * F.coalesce(long_words, F.lit(0)), words.cast("double"))
    return F.coalesce(words + share, F.lit(0.0))
