"""Corpus statistics of word forms. Everything runs on the vocabulary, not on tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions.numeric import ratio
from lectern.session import cut_lineage

POS_TAGS = ("ADP", "NOUN", "PART", "PROPN", "SCONJ", "VERB")


def lowercase_form(word: str) -> Column:
    """The form that lexical columns are counted by; none without a letter or digit."""
    return F.when(F.col(word).rlike(r"[\p{L}\p{Nd}]"), F.lower(word))


def frequencies(forms: DataFrame, word: str = "lowercase_form", tokens: str = "tokens") -> DataFrame:
    """Corpus frequency, its log1p and the dense rank of the frequency.

    The rank is taken over the distinct counts only: N tokens hold at most
    sqrt(2N) distinct counts, so that one window stays small at any scale.
    """
    counts = forms.groupBy(word).agg(F.sum(tokens).alias("corpus_frequency"))
    ranks = counts.select("corpus_frequency").distinct()
    ranks = ranks.withColumn(
        "frequency_rank", F.dense_rank().over(Window.orderBy(F.col("corpus_frequency").desc())).cast("long")
    )
    return counts.join(ranks, "corpus_frequency").select(
        word, "corpus_frequency", F.log1p("corpus_frequency").alias("log_corpus_frequency"), "frequency_rank"
    )


def grams(word: Column | str, n: int) -> Column:
    """Character n-grams of a word; empty array for shorter words."""
    col = F.col(word) if isinstance(word, str) else word
    starts = F.when(F.length(col) >= n, F.sequence(F.lit(1), F.length(col) - (n - 1)))
    return F.coalesce(F.transform(starts, lambda i: F.substring(col, i, F.lit(n))), F.array().cast("array<string>"))


def mean_gram_frequency(
    forms: DataFrame, n: int, name: str, word: str = "lowercase_form", tokens: str = "tokens"
) -> DataFrame:
    """Mean corpus count of a form's n-grams; 0 for forms shorter than n.

    Counts come from forms weighted by their tokens, so a frequent word costs
    one row, not one per occurrence. The weighted forms are stored: the corpus is read once.
    An outer join keeps the exploded grams, which Spark takes for no larger than the stored
    forms, from ever being the side that is broadcast; a form's grams lie in one task, so
    their mean combines before the shuffle.
    """
    forms = cut_lineage(forms.groupBy(word).agg(F.sum(tokens).alias("__t")))
    pieces = forms.select(word, "__t", F.explode_outer(grams(word, n)).alias("__gram"))
    counts = pieces.where(F.col("__gram").isNotNull()).groupBy("__gram").agg(F.sum("__t").alias("__count"))
    counted = pieces.drop("__t").join(counts, "__gram", "left")
    return counted.groupBy(word).agg(F.coalesce(F.avg("__count"), F.lit(0.0)).alias(name))


def neighbourhood(forms: DataFrame, length: str = "word_length_chars", word: str = "lowercase_form") -> DataFrame:
    """Distinct forms of equal length, minus one."""
    sizes = forms.select(length, word).distinct().groupBy(length).agg(F.count(F.lit(1)).alias("__n"))
    return sizes.select(length, F.greatest(F.col("__n") - 1, F.lit(0)).alias("orthographic_neighborhood_proxy"))


def pos_profile(tagged: DataFrame, unit: str, tag: str, tags: tuple[str, ...] = POS_TAGS) -> DataFrame:
    """Tag counts and proportions per unit: a pivot over a known tag set, as one aggregation."""
    counted = tagged.groupBy(unit).agg(
        F.count(F.lit(1)).alias("sentence_length_words"),
        *[F.count_if(F.col(tag) == p).alias(f"upos_count_{p.lower()}") for p in tags],
    )
    return counted.withColumns(
        {
            f"upos_prop_{p.lower()}": ratio(F.col(f"upos_count_{p.lower()}"), F.col("sentence_length_words"))
            for p in tags
        }
    )
