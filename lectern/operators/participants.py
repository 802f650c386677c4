"""Reader dimension: preparation, group labels, filters and class-aware samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lectern.functions import fixed_values as fv
from lectern.functions.hashing import md5_bucket, md5_hex
from lectern.functions.ids import normalize_participant, parse_label
from lectern.operators.joins import first_per_key
from lectern.operators.sequence import ordered_features


def exclude_listed(
    df: DataFrame,
    participants: Sequence[str] = fv.DEFAULT_EXCLUDED_PARTICIPANTS,
    texts: Sequence[str] = fv.DEFAULT_EXCLUDED_TEXTS,
    participant: str = "participant_id",
    text: str = "text_id",
) -> DataFrame:
    """Drop listed readers and texts; rows with a null id stay, as they match no list entry."""
    keep = F.lit(True)
    if participants:
        keep = keep & ~F.coalesce(F.col(participant).isin(*participants), F.lit(False))
    if texts:
        keep = keep & ~F.coalesce(F.col(text).cast("string").isin(*texts), F.lit(False))
    return df.where(keep)


def prepare_participants(
    raw: DataFrame, observed: DataFrame, id_column: str, label_column: str, order: Sequence[str],
    excluded: Sequence[str] = fv.DEFAULT_EXCLUDED_PARTICIPANTS,
) -> DataFrame:
    """Normalised ids and labels, restricted to observed readers, the first row per reader."""
    named = raw.withColumns({"participant_id": normalize_participant(id_column), "label": parse_label(label_column)})
    kept = exclude_listed(named, excluded, ()).join(observed.select("participant_id").distinct(), "participant_id", "left_semi")
    return first_per_key(kept, ["participant_id"], order)


def reader_groups(df: DataFrame, label: str = "label") -> DataFrame:
    """Group names, binary label, provenance and confidence defaults, inclusion flags."""
    value = F.col(label)
    group = F.when(value.isNull(), "uncertain").when(value == 1, "dyslexia_labeled").otherwise("typical_control")
    known = value.isNotNull()
    source = F.coalesce(F.col("label_provenance"), F.lit("project_metadata")) if "label_provenance" in df.columns else F.lit("project_metadata")
    return df.withColumns(
        {
            "reader_group": group,
            "reader_group_binary": F.when(value == 1, 1).when(known, 0),
            "label_source": source,
            "diagnostic_provenance": F.when(known, "project_metadata").otherwise("unknown"),
            "label_confidence": F.when(known, "medium").otherwise("unknown"),
            "include_primary_analysis": known,
            "include_sensitivity_analysis": known,
        }
    )


def reading_counts(panel: DataFrame, by: str = "participant_id", word: str = "word_id", text: str = "text_id") -> DataFrame:
    """Rows, distinct words and distinct texts per reader; null readers are dropped.

    Rows are first reduced to (reader, word, text), so both distinct counts work on keys that spread.
    """
    cells = panel.where(F.col(by).isNotNull()).groupBy(by, word, text).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(by).agg(
        F.sum("n").alias("n_word_rows"), F.countDistinct(word).alias("n_words_read"), F.countDistinct(text).alias("n_texts")
    )


def class_aware_sample(
    readers: DataFrame, size: int, per_class: int, label: str = "label", key: str = "participant_id"
) -> DataFrame:
    """The ``per_class`` lowest ids of each class, then the lowest remaining ids up to ``size``.

    Each part is a bounded top-n, so no class is gathered. A class with too few readers is an error.
    """
    if size < 2 * per_class:
        raise ValueError("the sample is smaller than two classes of the wanted size")
    known = readers.where(F.col(label).isNotNull()).select(key, label)
    seats = [known.where(F.col(label) == c).orderBy(key).limit(per_class) for c in (1, 0)]
    chosen = seats[0].unionByName(seats[1])
    rest = known.join(chosen.select(key), key, "left_anti").orderBy(key).limit(size - 2 * per_class)
    sample = chosen.withColumn("seat", F.lit("class")).unionByName(rest.withColumn("seat", F.lit("fill")))
    sizes = chosen.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    short = sizes.agg(((F.count(F.lit(1)) == 2) & (F.min("n") >= per_class)).alias("enough")).scalar()
    return sample.where(F.assert_true(short, "a class has too few readers").isNull())


def hash_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """Exactly n rows (all when fewer), the smallest by md5(seed | keys): repeatable and engine-neutral.

    Counts of the leading digest digits (4096 buckets) tell the last bucket that
    is needed; only rows up to it are ordered, so the table is not shuffled.
    """
    hashed = df.withColumn("__h", md5_hex(F.lit(seed), *[F.col(k) for k in keys])).withColumn("__b", md5_bucket(F.col("__h")))
    counts = hashed.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    upto = counts.withColumn("__cum", F.sum("__c").over(Window.orderBy("__b")))
    last = upto.agg(F.coalesce(F.min(F.when(F.col("__cum") >= n, F.col("__b"))), F.max("__b")).alias("__last"))
    return hashed.where(F.col("__b") <= last.scalar()).orderBy("__h").limit(n).select(*df.columns)


def limit_sample(panel: DataFrame, readers: int, texts: int, reader: str = "participant_id", text: str = "text_id") -> DataFrame:
    """First readers by id; texts read by most of them; texts added until every reader is covered."""
    from lectern.operators.boundaries import examples_per_group

    kept_readers = panel.select(reader).distinct().orderBy(reader).limit(readers)
    rows = panel.join(kept_readers, reader, "left_semi")
    pairs = rows.select(reader, text).distinct()
    popular = pairs.groupBy(text).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), text).limit(texts).select(text)
    covered = pairs.join(popular, text, "left_semi").select(reader).distinct()
    uncovered = pairs.join(covered, reader, "left_anti")
    added = examples_per_group(uncovered, reader, text, texts, [text]).distinct()
    return rows.join(popular.unionByName(added).distinct(), text, "left_semi")


def word_budget(df: DataFrame, order: str, length: str, budget: int, chunk) -> DataFrame:
    """Leading rows until the length budget is spent; the last row counts in part."""
    if budget <= 0:
        raise ValueError("the budget must be positive")
    size = F.coalesce(F.col(length), F.lit(1))
    run = ordered_features(
        df.withColumn("__all", F.lit(1)), ["__all"], [order], chunk=chunk, running={"words_before": size}
    ).drop("__all")
    return run.where(F.col("words_before") < budget).withColumn("words_taken", F.least(size, F.lit(budget) - F.col("words_before")))


def weak_provenance(column: str = "label_provenance"):
    """Provenance that mentions a weak or self-reported label."""
    return F.coalesce(F.col(column).rlike("(?i)weak|self"), F.lit(False))


def sensitivity_sets(readers: DataFrame, dropped: str, key: str = "participant_id") -> DataFrame:
    """Named reader sets for sensitivity runs: without one reader, and without weak provenance."""
    sets = F.array_compact(
        F.array(
            F.when(~F.col(key).eqNullSafe(dropped), "without_reader"),
            F.when(~weak_provenance(), "strong_or_unspecified_provenance"),
        )
    )
    return readers.select(key, F.explode(sets).alias("reader_set"))


def exposure_overlap(
    readers: DataFrame, group: str, exposures: Sequence[str], key: str = "participant_id", minimum: int = 3
) -> DataFrame:
    """Readers inside the range that all groups share on every exposure; empty when groups are too few or small."""
    from lectern.operators.scalars import with_totals

    ranges = readers.groupBy(group).agg(
        *[F.min(e).alias(f"lo_{e}") for e in exposures], *[F.max(e).alias(f"hi_{e}") for e in exposures]
    )
    shared = ranges.agg(
        F.count(F.lit(1)).alias("__groups"),
        *[F.max(f"lo_{e}").alias(f"__lo_{e}") for e in exposures],
        *[F.min(f"hi_{e}").alias(f"__hi_{e}") for e in exposures],
    )
    inside = F.col("__groups") >= 2
    for e in exposures:
        inside = inside & F.col(e).between(F.col(f"__lo_{e}"), F.col(f"__hi_{e}"))
    kept = with_totals(readers, shared).where(inside).select(*readers.columns)
    sizes = kept.groupBy(group).agg(F.countDistinct(key).alias("n"))
    enough = sizes.agg((F.count(F.lit(1)) >= 2).alias("__two"), (F.min("n") >= minimum).alias("__min"))
    return with_totals(kept, enough).where(F.col("__two") & F.col("__min")).select(*readers.columns)
