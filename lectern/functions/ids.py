"""Identifier tokens and hierarchical keys as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.fixed_values import NEGATIVE_LABELS, POSITIVE_LABELS


def clean_token(value: Column | str) -> Column:
    """Null to ``''``; blanks and double quotes stripped; ``12.0`` becomes ``12``."""
    text = F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(""))
    text = F.when(text == "NaN", "").otherwise(text)
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    text = F.regexp_replace(text, r'^"+|"+$', "")
    return F.regexp_replace(text, r"^(-?\d+)\.0$", "$1")


def normalize_participant(value: Column | str) -> Column:
    """``p1`` and ``001`` become ``P01``; other tokens are upper-cased."""
    token = F.upper(clean_token(value))
    digits = F.regexp_extract(token, r"^P?0*(\d+)$", 1)
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return F.when(digits != "", F.concat(F.lit("P"), padded)).otherwise(token)


def require_columns(df: DataFrame, columns: list[str], what: str = "table") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns {missing}")


def with_stable_ids(
    df: DataFrame,
    text: str,
    paragraph: str,
    sentence: str,
    word: str,
    participant: str | None = None,
) -> DataFrame:
    """Add ``text_id``, ``paragraph_id``, ``sentence_id``, ``word_id`` (and ``participant_id``)."""
    require_columns(df, [text, paragraph, sentence, word] + ([participant] if participant else []), "id source")
    text_id = clean_token(text)
    paragraph_id = F.concat(text_id, F.lit("_p"), clean_token(paragraph))
    sentence_id = F.concat(paragraph_id, F.lit("_s"), clean_token(sentence))
    word_id = F.concat(sentence_id, F.lit("_w"), clean_token(word))
    added = {"text_id": text_id, "paragraph_id": paragraph_id, "sentence_id": sentence_id, "word_id": word_id}
    if participant:
        added["participant_id"] = normalize_participant(participant)
    return df.withColumns(added)


def parse_label(value: Column | str) -> Column:
    """Label vocabulary to 1 / 0 / null."""
    token = F.lower(clean_token(value))
    return F.when(token.isin(*POSITIVE_LABELS), 1).when(token.isin(*NEGATIVE_LABELS), 0)


def composite_key(*parts: Column | str) -> Column:
    """``participant::word`` style key."""
    return F.concat_ws("::", *parts)


def first_present(df: DataFrame, candidates: list[str]) -> str:
    """The first candidate column that ``df`` has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {candidates} is a column")
