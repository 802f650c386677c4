"""Text tables to words: the stimulus hierarchy text > paragraph > sentence > word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.sources.readers import spread_small_scan

#: A sentence runs up to and including its closing marks.
SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+"
TOKEN = r"[^ \t\r\n\f]+"


def _all(text: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def sentences_from_texts(
    texts: DataFrame, text_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per piece of a line, with its whitespace tokens: no shuffle.

    What concerns one sentence is worked out in this row, before its words are exploded. A
    piece without a token is kept with no tokens.
    """
    texts = spread_small_scan(texts.select(text_id, text, *keep), text_id)
    lines = texts.select(
        F.col(text_id).cast("string").alias("text_id"), *keep, F.posexplode(F.split(text, "\n")).alias("p", "line")
    )
    sentences = lines.select("text_id", *keep, (F.col("p") + 1).alias("p"), F.posexplode(_all("line", SENTENCE)).alias("s", "sentence"))
    return sentences.select("text_id", *keep, "p", (F.col("s") + 1).alias("s"), _all("sentence", TOKEN).alias("tokens"))


def split_lines(texts: DataFrame, text_id: str, text: str, *keep: str) -> DataFrame:
    """One row per line, with the tokens of each of its ``pieces``, where the text is."""
    lines = texts.select(*keep, F.col(text_id).cast("string").alias("text_id"), F.posexplode(F.split(text, "\n")).alias("p", "line"))
    pieces = F.transform(_all("line", SENTENCE), lambda x: _all(x, TOKEN))
    return lines.select(*keep, "text_id", (F.col("p") + 1).alias("p"), pieces.alias("pieces"))


def paragraphs_from_texts(texts: DataFrame, text_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line, with the tokens of each of its ``pieces``: no shuffle."""
    return split_lines(spread_small_scan(texts.select(text_id, text), text_id), text_id, text)


def paragraph_id() -> Column:
    return F.concat_ws("_p", "text_id", "p")


def sentence_id() -> Column:
    return F.concat("text_id", F.lit("_p"), "p", F.lit("_s"), "s")


def word_id() -> Column:
    return F.concat("text_id", F.lit("_p"), "p", F.lit("_s"), "s", F.lit("_w"), "w")


def words_from_texts(
    texts: DataFrame, text_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per whitespace token, exploded inside its row: no shuffle.

    ``p``, ``s`` and ``w`` are 1-based ordinals of line, sentence and token. The
    neighbours in the sentence come from the token array already at hand.
    """
    tokens = sentences_from_texts(texts, text_id, text, keep)
    placed = tokens.select("*", F.posexplode("tokens").alias("w", "word_form"))
    return placed.select(
        "text_id",
        *keep,
        "p",
        "s",
        (F.col("w") + 1).alias("w"),
        paragraph_id().alias("paragraph_id"),
        sentence_id().alias("sentence_id"),
        F.concat("text_id", F.lit("_p"), "p", F.lit("_s"), "s", F.lit("_w"), F.col("w") + 1).alias("word_id"),
        "word_form",
        F.get("tokens", F.col("w") - 1).alias("prev_word"),
        F.get("tokens", F.col("w") + 1).alias("next_word"),
        F.size("tokens").alias("tokens_in_sentence"),
    )


#: No line, sentence or token of a text shorter than this has a greater number.
SHORT = 1 << 20


def _first_places(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """``first_occurrences`` of texts shorter than ``SHORT`` under whole numbers: minima of numbers only, so forms are hashed and never sorted."""
    tokens = sentences_from_texts(texts, text_id, text)
    number = F.col("text_id").cast("long")
    place = (F.col("p").cast("long") * SHORT + F.col("s")) * SHORT + F.col("w") + 1
    placed = tokens.select("text_id", "p", "s", F.posexplode("tokens").alias("w", "word_form")).select("word_form", number.alias("number"), place.alias("place"))
    order = F.col("number").cast("decimal(20,0)") * F.lit(SHORT**3).cast("decimal(19,0)") + F.col("place").cast("decimal(20,0)")
    first = placed.groupBy("word_form").agg(F.min_by("number", order).alias("number"), F.min_by("place", order).alias("place"))
    bits = SHORT.bit_length() - 1
    part = lambda k: (F.shiftright("place", k * bits) % SHORT).cast("int")
    return first.select("word_form", F.col("number").cast("string").alias("text_id"), part(2).alias("p"), part(1).alias("s"), part(0).alias("w"))


def first_occurrences(texts: DataFrame, text_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word_form, word_id, text_id`` of the first token of each form, in the order of texts by number, lines, sentences and tokens; texts without a number come last."""
    from lectern.operators.joins import first_per_key

    columns = ["word_form", "text_id", "p", "s", "w"]
    order = [F.col("text_id").isNull(), F.col("text_id").cast("long"), "p", "s", "w"]
    every = lambda df: first_per_key(words_from_texts(df, text_id, text).select(*columns), ["word_form"], order)
    if texts.schema[text_id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        found = every(texts)
    else:
        short = F.length(text) < SHORT
        found = _first_places(texts.where(short), text_id, text).unionByName(every(texts.where(~short)))
        found = first_per_key(found, ["word_form"], order)
    return found.select("word_form", word_id().alias("word_id"), "text_id")


def words_from_turns(turns: DataFrame) -> DataFrame:
    """Conversations as a corpus: paragraph = conversation, sentence = turn."""
    tokens = turns.select(
        F.col("conv_id").cast("string").alias("paragraph_id"),
        F.col("turn").cast("int").alias("s"),
        F.concat_ws("_t", "conv_id", "turn").alias("sentence_id"),
        F.posexplode(_all("text", TOKEN)).alias("w", "word_form"),
    )
    return tokens.withColumns(
        {"w": F.col("w") + 1, "word_id": F.concat("sentence_id", F.lit("_w"), F.col("w") + 1)}
    )


def vocabulary(words: DataFrame, word: str = "word_form") -> DataFrame:
    """Distinct forms with their token counts: lexical features are computed once per form."""
    return words.groupBy(word).agg(F.count(F.lit(1)).alias("tokens"))
