"""Per-word surprisal and next-word entropy, with a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lectern.operators.scalars import with_totals
from lectern.session import cut_lineage


ALPHA = 0.5
#: A model of more pairs is not broadcast; words are then looked up in a hash table of its part and not sorted.
MANY_PAIRS = 200_000


def pair_counts(words: DataFrame, word: str = "word_form", previous: str = "prev_word") -> DataFrame:
    """Stored counts of (previous, word), those without a previous word included: the corpus is read once."""
    return cut_lineage(words.groupBy(previous, word).agg(F.count(F.lit(1)).alias("pair_count")))


def contexts(counts: DataFrame, word: str = "word_form", previous: str = "prev_word", alpha: float = ALPHA) -> DataFrame:
    """Smoothed mass and next-word entropy of each previous word, from pair counts.

    Contexts keep their unseen mass in closed form: (V - k) words of probability alpha / (n + alpha V) each.
    """
    pairs = counts.where(F.col(previous).isNotNull())
    size = counts.agg(F.countDistinct(word).alias("__v"))
    smoothed = F.col("pair_count") + alpha
    found = pairs.groupBy(previous).agg(
        F.sum("pair_count").alias("__n"), F.count(F.lit(1)).alias("__k"), F.sum(smoothed * F.ln(smoothed)).alias("__s")
    )
    found = with_totals(found, size)
    mass, entropy = _context_scores(F.col("__n"), F.col("__k"), F.col("__s"), F.col("__v"), alpha)
    return found.select(previous, mass.alias("__mass"), entropy.alias("entropy"))


def _context_scores(n: Column, k: Column, s: Column, size: Column, alpha: float) -> tuple[Column, Column]:
    mass, unseen = n + alpha * size, size - k
    # -sum p ln p over seen words, with p = (count + alpha) / mass, plus the unseen words' share
    seen = F.ln(mass) * (n + alpha * k) / mass - s / mass
    return mass, seen - unseen * (alpha / mass) * F.ln(alpha / mass)


def context_scores(forms: DataFrame, alpha: float = ALPHA) -> list[Column]:
    """``mass`` and ``entropy`` of rows with a form's sums ``n, k, s`` over the words after it; ``forms`` has a row for every form."""
    size = forms.agg(F.count(F.lit(1)).alias("v")).scalar()
    mass, entropy = _context_scores(F.col("n"), F.col("k"), F.col("s"), size, alpha)
    return [mass.alias("mass"), entropy.alias("entropy")]


def pair_surprisal(alpha: float = ALPHA) -> Column:
    """Surprisal of a pair beside its context's mass."""
    return F.ln("__mass") - F.ln(F.col("pair_count") + alpha)


def bigram_model(words: DataFrame, word: str = "word_form", previous: str = "prev_word", alpha: float = ALPHA) -> DataFrame:
    """Smoothed bigram scores: surprisal of each (previous, word) and entropy after each previous word."""
    counts = pair_counts(words, word, previous)
    scored = counts.where(F.col(previous).isNotNull()).join(contexts(counts, word, previous, alpha), previous)
    scored = scored.select(previous, word, "pair_count", pair_surprisal(alpha).alias("surprisal"), "entropy")
    return scored.hint("shuffle_hash") if counts.count() > MANY_PAIRS else scored


def attach_scores(words: DataFrame, model: DataFrame, word: str = "word_form", previous: str = "prev_word") -> DataFrame:
    """Scores on every word; sentence-initial words have none. A frequent pair is AQE's to split."""
    return words.join(model.drop("pair_count"), [previous, word], "left")


def sentence_sums(sentences: DataFrame) -> DataFrame:
    """Words, scored words and their scores per ``sentence_id``, from rows that hold the ``scores`` of a sentence's words; ids may repeat."""
    known = F.filter("scores", lambda x: x["surprisal"].isNotNull())
    total = lambda c: F.aggregate(F.col("known"), F.lit(0.0), lambda a, x: a + x[c])
    rows = sentences.where(F.size("scores") > 0).withColumn("known", known)
    scored = F.size("known")
    rows = rows.select(
        "sentence_id", F.size("scores").alias("words"), scored.alias("scored"),
        F.when(scored > 0, total("surprisal")).alias("surprisal"), F.when(scored > 0, total("entropy")).alias("entropy"),
    )
    return rows.groupBy("sentence_id").agg(
        F.sum("words").alias("words"), F.sum("scored").alias("scored_words"), F.sum("surprisal").alias("sum_surprisal"),
        F.try_divide(F.sum("entropy"), F.sum("scored")).alias("mean_entropy"),
    )


def score_with(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Plug in any batch scorer (a causal language model, say): Arrow batches in, Arrow batches out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return df.mapInPandas(run, schema)
