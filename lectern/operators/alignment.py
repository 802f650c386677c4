"""Tokenizer spans against word spans: overlap assignment, roll-up, validation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Characters per position block: spans only meet spans that share a block.
BLOCK = 64


def _block(position: Column) -> Column:
    return F.floor(position / BLOCK)


def _blocks(start: str, end: str):
    """Blocks a span touches; a single null block for an empty span, which then meets nothing."""
    real = F.col(end) > F.col(start)
    return F.when(real, F.sequence(_block(F.col(start)), _block(F.col(end) - 1))).otherwise(F.array(F.lit(None).cast("long")))


def align_tokens(tokens: DataFrame, words: DataFrame, context: str = "context_id") -> DataFrame:
    """Give each token the word it overlaps most; first word on ties; null when none.

    ``tokens``: context, ``token_ord``, ``token_start``, ``token_end``.
    ``words``: context, ``ord``, ``word_id``, ``start``, ``end``.
    The overlap is an equi join on (context, block of characters) plus the range
    condition, so a long context never meets itself in full. A pair counts only
    in the block where its overlap begins. Outer rows keep unmatched tokens, so
    one join and one aggregation do.
    """
    rest = [c for c in tokens.columns if c not in (context, "token_ord")]
    t = tokens.withColumn("__block", F.explode(_blocks("token_start", "token_end")))
    spans = words.where(F.col("end") > F.col("start"))
    w = spans.select(
        F.col(context).alias("__context"), F.col("ord").alias("__ord"), F.col("word_id").alias("__word"), F.col("start").alias("__start"),
        F.col("end").alias("__end"), F.explode(_blocks("start", "end")).alias("__wblock"),
    )
    begin = F.greatest(F.col("token_start"), F.col("__start"))
    meets = (
        (F.col(context) == F.col("__context"))
        & (F.col("__block") == F.col("__wblock"))
        & (F.col("token_start") < F.col("__end"))
        & (F.col("__start") < F.col("token_end"))
        & (_block(begin) == F.col("__block"))
    )
    met = t.join(w, meets, "left")
    overlap = F.least(F.col("token_end"), F.col("__end")) - begin
    rank = F.when(F.col("__word").isNotNull(), F.struct(overlap.alias("o"), (-F.col("__ord")).alias("first")))
    best = met.groupBy(context, "token_ord").agg(
        F.any_value(F.struct(*rest)).alias("__rest"), F.max_by("__word", rank).alias("word_id")
    )
    return best.select(context, "token_ord", *[F.col(f"__rest.{c}").alias(c) for c in rest], "word_id")


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values of all lists of a batch and the first place of each list, with the end as one more."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _numbers(values: pa.Array) -> np.ndarray:
    return values.cast(pa.int64()).to_numpy(zero_copy_only=False)


def _like(first: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)


def joined_starts(lengths: Column) -> Column:
    """Where each word of an array begins when the words are joined by one blank, from their lengths."""

    @F.arrow_udf("array<int>")
    def starts(sizes: pa.Array) -> pa.Array:
        values, first = _lists(sizes)
        before = np.concatenate([[0], np.cumsum(_numbers(values) + 1)])
        own = before[:-1] - np.repeat(before[first[:-1]], np.diff(first))
        return _like(first, pa.array(own, pa.int32()))

    return starts(lengths)


def best_covers(word_start: Column, word_end: Column, token_start: Column, token_end: Column) -> Column:
    """Per token of a row the place (from 0) of the word it overlaps most; first word on ties; null when none.

    All four are arrays of a context's row; its words come in order and do not overlap. Both
    lists are sorted, so a search finds each token's first and last word: no join, no shuffle.
    """

    @F.arrow_udf("array<int>")
    def covers(ws: pa.Array, we: pa.Array, ts: pa.Array, te: pa.Array) -> pa.Array:
        (starts, first), (ends, _), (begins, tokens), (stops, _) = _lists(ws), _lists(we), _lists(ts), _lists(te)
        starts, ends, begins, stops = (_numbers(x) for x in (starts, ends, begins, stops))
        row, words = np.repeat(np.arange(len(ts)), np.diff(tokens)), np.repeat(np.arange(len(ws)), np.diff(first))
        # Every row gets its own stretch of one common axis.
        reach = 1 + max((int(np.abs(x).max()) for x in (starts, ends, begins, stops) if len(x)), default=0)
        axis = lambda x, r: x + 2 * reach * r
        lo = np.maximum(np.searchsorted(axis(ends, words), axis(begins, row), side="right"), first[row])
        hi = np.minimum(np.searchsorted(axis(starts, words), axis(stops, row), side="left"), first[row + 1])
        met = np.where(stops > begins, np.maximum(hi - lo, 0), 0)
        token = np.repeat(np.arange(len(row)), met)
        group = np.cumsum(met) - met
        place = np.arange(len(token)) - group[token] + lo[token]
        overlap = np.minimum(stops[token], ends[place]) - np.maximum(begins[token], starts[place])
        held = np.flatnonzero(met)
        found = np.full(len(row), -1, dtype=np.int64)
        if len(held):
            best = np.zeros(len(row), dtype=np.int64)
            best[held] = np.maximum.reduceat(overlap, group[held])
            least = np.minimum.reduceat(np.where(overlap == best[token], place, len(starts)), group[held])
            found[held] = np.where(best[held] > 0, least - first[row[held]], -1)
        return _like(tokens, pa.array(found, pa.int32(), mask=found < 0))

    return covers(word_start, word_end, token_start, token_end)


SCORES = "subword_count long, scored_subword_count long, word_surprisal double, word_entropy double, word_entropy_onset double"


def scores_in_row(n_words: Column, assigned: Column, real: Column, scored: Column, nll: Column, entropy: Column) -> Column:
    """What ``word_scores`` gives, as an array of one struct a word, from arrays over the tokens of a row in their order."""

    @F.arrow_udf(f"array<struct<{SCORES.replace(' ', ':').replace(',:', ',')}>>")
    def scores(n: pa.Array, to: pa.Array, is_real: pa.Array, is_scored: pa.Array, loss: pa.Array, spread: pa.Array) -> pa.Array:
        words = np.concatenate([[0], np.cumsum(_numbers(n))])
        places, tokens = _lists(to)
        row = np.repeat(np.arange(len(n)), np.diff(tokens))
        known = pc.is_valid(places).to_numpy(zero_copy_only=False)
        word = np.where(known, words[row] + pc.fill_null(places, 0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        flag = lambda x: pc.fill_null(_lists(x)[0], False).to_numpy(zero_copy_only=False) & known
        counted = lambda which: np.bincount(word[which], minlength=words[-1])
        on, scoring = flag(is_real), flag(is_scored)
        columns = [pa.array(counted(on), pa.int64()), pa.array(counted(scoring), pa.int64())]
        numbers = {}
        for name, x in (("loss", loss), ("spread", spread)):
            values = _lists(x)[0]
            there = pc.is_valid(values).to_numpy(zero_copy_only=False) & scoring
            numbers[name] = values, counted(there), np.bincount(word[there], pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)[there], words[-1])
        _, held, total = numbers["loss"]
        columns.append(pa.array(total, pa.float64(), mask=held == 0))
        values, held, total = numbers["spread"]
        columns.append(pa.array(total / np.maximum(held, 1), pa.float64(), mask=held == 0))
        at = np.flatnonzero(scoring)
        owner, first = np.unique(word[at], return_index=True)
        onset = np.full(words[-1], -1, dtype=np.int64)
        onset[owner] = at[first]
        columns.append(values.take(pa.array(onset, pa.int64(), mask=onset < 0)))
        return _like(words, pa.StructArray.from_arrays(columns, [c.split()[0] for c in SCORES.split(", ")]))

    return scores(n_words, assigned, real, scored, nll, entropy)


def word_scores(assigned: DataFrame, words: DataFrame, context: str = "context_id") -> DataFrame:
    """Token scores summed or averaged to words.

    The first token of a context has no left context, so it counts as a subword
    but is never scored. Words without a scored token have null scores.
    """
    scored = F.col("token_ord") > 0
    per_word = assigned.where(F.col("word_id").isNotNull()).groupBy(context, "word_id").agg(
        F.count_if(F.col("token_end") > F.col("token_start")).alias("subword_count"),
        F.count_if(scored).alias("scored_subword_count"),
        F.sum(F.when(scored, F.col("nll"))).alias("word_surprisal"),
        F.avg(F.when(scored, F.col("entropy"))).alias("word_entropy"),
        F.min_by(F.when(scored, F.col("entropy")), F.when(scored, F.col("token_ord"))).alias("word_entropy_onset"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("subword_count", "scored_subword_count")}
    return words.select(context, "word_id").join(per_word, [context, "word_id"], "left").withColumns(zero)


def _word_side(context: str, text: str) -> list[str | Column]:
    """Counts that a context's text and the ``spans`` beside it tell."""
    spans, size = F.col("spans"), F.length(text)

    def bad(x):
        outside = (x["start"] < 0) | (x["end"] < x["start"]) | (x["end"] > size)
        cut = F.substring(F.col(text), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))
        return outside | (x["word_form"].isNotNull() & (cut != x["word_form"]))

    def squeeze(c):
        return F.trim(F.regexp_replace(c, r"\s+", " "))

    rebuilt = F.array_join(F.transform(spans, lambda x: F.coalesce(x["word_form"], F.lit(""))), " ")
    return [
        context,
        F.size(spans).cast("long").alias("word_count"),
        F.size(F.filter(spans, lambda x: F.coalesce(x["word_id"], F.lit("")).isin("", "nan"))).cast("long").alias("missing_ids"),
        F.size(F.filter(spans, bad)).cast("long").alias("span_errors"),
        (squeeze(rebuilt) == squeeze(F.col(text))).alias("reconstructed_text_matches"),
    ]


def validate_alignment(
    assigned: DataFrame, words: DataFrame, texts: DataFrame, context: str = "context_id", text: str = "text"
) -> DataFrame:
    """Per context: counts, problems and a status, from three aggregations joined on the context.

    A context's text is one cell, so the spans gathered beside it are of the same size.
    """
    size = F.length(text)
    row = F.struct("ord", "word_id", "start", "end", "word_form")
    per_context = words.groupBy(context).agg(F.array_sort(F.collect_list(row)).alias("spans"))
    held = texts.select(context, text).join(per_context, context)
    word_side = held.select(*_word_side(context, text))
    ids = words.groupBy(context, "word_id").agg(F.count(F.lit(1)).alias("n"))
    duplicates = ids.groupBy(context).agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.count(F.lit(1)).alias("distinct_ids"))
    real = F.col("token_end") > F.col("token_start")
    token_side = assigned.join(texts.select(context, size.alias("__size")), context, "left").groupBy(context).agg(
        F.count(F.lit(1)).alias("token_count"),
        F.count_if(real & F.col("word_id").isNull()).alias("unassigned_tokens"),
        F.count_if(real & ((F.col("token_start") < 0) | (F.col("token_end") > F.col("__size")))).alias("outside_tokens"),
        F.countDistinct(F.when(real, F.col("word_id"))).alias("covered_words"),
    )
    joined = word_side.join(duplicates, context).join(token_side, context, "left")
    return _report(
        joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("token_count", "unassigned_tokens", "outside_tokens", "covered_words")}), context
    )


def validate_in_rows(rows: DataFrame, context: str = "context_id", text: str = "text") -> DataFrame:
    """What ``validate_alignment`` gives, from a row per context: ``text``, ``spans`` and ``tokens`` in order, and ``assigned``."""
    tokens, ids = F.col("tokens"), F.transform("spans", lambda x: x["word_id"])
    placed = F.transform(tokens, lambda x, i: F.struct(x["token_end"].alias("b"), x["token_start"].alias("a"), F.get("assigned", i).alias("at")))
    real = F.filter(placed, lambda x: x["b"] > x["a"])
    held = rows.withColumns({"__ids": ids, "__real": real})
    counted = lambda test: F.size(F.filter("__real", test)).cast("long")
    names = F.transform(F.filter("__real", lambda x: x["at"].isNotNull()), lambda x: F.get("__ids", x["at"]))
    once = F.array_distinct("__ids")
    repeated = F.filter(once, lambda i: F.size(F.filter("__ids", lambda x: x.eqNullSafe(i))) > 1)
    counts = held.select(
        *_word_side(context, text),
        F.when(F.size(once) < F.size("__ids"), F.size(repeated)).otherwise(0).cast("long").alias("duplicate_ids"),
        F.size(once).cast("long").alias("distinct_ids"),
        F.size(tokens).cast("long").alias("token_count"),
        counted(lambda x: x["at"].isNull()).alias("unassigned_tokens"),
        counted(lambda x: (x["a"] < 0) | (x["b"] > F.length(text))).alias("outside_tokens"),
        F.size(F.array_distinct(names)).cast("long").alias("covered_words"),
    )
    return _report(counts, context)


def _report(counts: DataFrame, context: str) -> DataFrame:
    """Problems and status of each context from its counts."""
    joined = counts.withColumn("zero_subword_words", F.col("distinct_ids") - F.col("covered_words"))

    def noted(test, label):
        return F.when(test, label)

    counted = lambda name, label: noted(F.col(name) > 0, F.concat(F.lit(label + ":"), F.col(name).cast("string")))
    errors = F.array_compact(
        F.array(
            counted("missing_ids", "missing_word_ids"),
            counted("duplicate_ids", "duplicate_word_ids"),
            noted(~F.col("reconstructed_text_matches"), F.lit("reconstructed_text_mismatch")),
            counted("span_errors", "invalid_word_spans"),
            counted("zero_subword_words", "zero_subword_words"),
        )
    )
    warnings = F.array_compact(
        F.array(
            noted(F.col("unassigned_tokens") > 0, F.lit("non_special_token_unassigned")),
            noted(F.col("outside_tokens") > 0, F.lit("token_offset_outside_text")),
        )
    )
    status = F.when(F.size(errors) > 0, "error").when(F.size(warnings) > 0, "warning").otherwise("ok")
    return joined.select(
        context, "word_count", "token_count", "missing_ids", "duplicate_ids", "span_errors", "unassigned_tokens",
        "zero_subword_words", "reconstructed_text_matches", errors.alias("errors"), warnings.alias("warnings"),
        status.alias("status"),
    )
