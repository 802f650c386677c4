"""Cross-validation folds as tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lectern.functions.hashing import md5_bucket, md5_hex
from lectern.operators.participants import exposure_overlap
from lectern.operators.scalars import with_totals
from lectern.operators.sequence import ordered_features, sampled_chunks
from lectern.session import cut_lineage

LEAVE_ONE_OUT, GROUPED, SENSITIVITY = "leave_one_participant_out", "participant_grouped_kfold", "sensitivity_exclude_uncertain_labels"


def _roles(assigned: DataFrame, folds) -> DataFrame:
    """One row per unit and fold: tested in its own fold, trained on in the others.

    The n x k table is the result asked for; it is emitted from each unit's row
    (an exploded sequence), not by a join.
    """
    grid = assigned.withColumn("fold_id", F.explode(F.sequence(F.lit(0), (folds - 1).cast("int"))))
    return grid.withColumn("split_role", F.when(F.col("fold_id") == F.col("__fold"), "test").otherwise("train"))


def _spread(units: DataFrame, key: str) -> DataFrame:
    """Rows that are exploded next, dealt over all cores: by their own size they would share one task."""
    return units.repartition(4 * units.sparkSession.sparkContext.defaultParallelism, key)


def usable_folds(units: DataFrame, label: str, k: int) -> DataFrame:
    """One row: at most ``k`` folds, at most the smallest class, at least two."""
    sizes = units.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    smallest = F.when(F.count(F.lit(1)) > 1, F.min("n")).otherwise(1)
    return sizes.agg(F.greatest(F.lit(2), F.least(F.lit(k), F.sum("n"), smallest)).cast("int").alias("__k"))


def assign_grouped_folds(units: DataFrame, key: str, label: str, k: int, seed: int) -> DataFrame:
    """Stratified round-robin fold of each unit, in md5 order inside its class.

    The order is chunked by digest prefix: two classes would otherwise mean two tasks.
    """
    unique = units.select(key, label).distinct().where(F.col(label).isNotNull())
    hashed = unique.withColumn("__h", md5_hex(F.lit(seed), F.col(key)))
    ranked = ordered_features(hashed, [label], ["__h"], chunk=md5_bucket(F.col("__h")), index="__i")
    held = with_totals(ranked, usable_folds(unique, label, k))
    return held.select(key, label, "__k", F.pmod("__i", "__k").cast("int").alias("__fold"))


def grouped_folds(units: DataFrame, key: str, label: str, k: int = 5, seed: int = 17) -> DataFrame:
    """Train / test table of stratified grouped folds."""
    placed = _roles(assign_grouped_folds(units, key, label, k, seed), F.col("__k"))
    return placed.select(F.lit("participant_grouped_kfold").alias("split_name"), "fold_id", "split_role", key, label)


def assign_leave_one_out(units: DataFrame, key: str) -> DataFrame:
    """Fold of each unit = rank of its key. The compact form: train is everyone else.

    Chunked at sampled keys, so ids that begin alike don't share a task.
    """
    unique = units.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__all", F.lit(1))
    placed = sampled_chunks(unique, key, "__cut")
    ranked = ordered_features(placed, ["__all"], [key], chunk=F.col("__cut"), index="__i", size="__n")
    return ranked.select(key, F.col("__i").cast("int").alias("__fold"), "__n")


def leave_one_out(units: DataFrame, key: str, name: str = "leave_one_participant_out") -> DataFrame:
    """Full train / test table with one fold per unit."""
    placed = _roles(_spread(assign_leave_one_out(units, key), key), F.col("__n"))
    return placed.select(F.lit(name).alias("split_name"), "fold_id", "split_role", key)


def fold_counts(splits: DataFrame, key: str = "participant_id", group: str = "reader_group", rows: str = "n_word_rows") -> DataFrame:
    """Units, classes and rows per fold and role, and whether train and test are disjoint."""
    train, test = F.col("split_role").isin("train", "include"), F.col("split_role") == "test"
    per_unit = splits.groupBy("split_name", "fold_id", key).agg(
        F.max(train.cast("int")).alias("__tr"), F.max(test.cast("int")).alias("__te"),
        *[F.count_if(role & (F.col(group) == g)).alias(f"__{n}_{g}") for n, role in (("train", train), ("test", test))
          for g in ("dyslexia_labeled", "typical_control")],
        *[F.sum(F.when(role, F.coalesce(F.col(rows), F.lit(0))).otherwise(0)).alias(f"__{n}_rows") for n, role in (("train", train), ("test", test))],
    )
    counts = per_unit.groupBy("split_name", "fold_id").agg(
        F.sum("__tr").alias("n_train_participants"),
        F.sum("__te").alias("n_test_participants"),
        *[F.sum(f"__{n}_{g}").alias(f"n_{n}_{g}") for n in ("train", "test") for g in ("dyslexia_labeled", "typical_control")],
        F.sum("__train_rows").alias("n_train_word_rows"),
        F.sum("__test_rows").alias("n_test_word_rows"),
        F.sum(F.col("__tr") * F.col("__te")).alias("__overlap"),
    )
    valid = F.col("__overlap") == 0
    return counts.withColumns(
        {"split_valid": valid, "skip_reason": F.when(valid, "").otherwise("participant_overlap_between_train_and_test")}
    ).drop("__overlap")


def compact_folds(readers: DataFrame, k: int = 5, seed: int = 17) -> DataFrame:
    """The splits of ``split_labels`` with a row per reader and split: ``split_name, fold_id, fold_rule, participant_id``.

    ``all_but``: the reader is tested in this fold and trained on in every other fold of the
    split. ``include`` and ``exclude``: in or out of a fold that tests nobody.
    """
    known = readers.where(F.col("reader_group_binary").isNotNull())
    named = lambda name, rule: [F.lit(name).alias("split_name"), F.col("__fold").alias("fold_id"), rule.alias("fold_rule"), "participant_id"]
    tested = F.lit("all_but")
    singles = assign_leave_one_out(readers, "participant_id").select(*named("leave_one_participant_out", tested))
    grouped = assign_grouped_folds(known, "participant_id", "reader_group_binary", k, seed).select(*named("participant_grouped_kfold", tested))
    rule = F.when(F.col("reader_group") == "uncertain", "exclude").otherwise("include")
    certain = readers.withColumn("__fold", F.lit(0)).select(*named("sensitivity_exclude_uncertain_labels", rule))
    return singles.unionByName(grouped).unionByName(certain)


def compact_fold_counts(folds: DataFrame, key: str = "participant_id", group: str = "reader_group", rows: str = "n_word_rows") -> DataFrame:
    """What ``fold_counts`` gives, from compact folds: training is the split's total minus the fold's own.

    Its rows grow with the units and not with units times folds. A unit under more than one
    fold is tested in each and trained on in each, so those folds are not valid. Rows without
    a fold or a key are left out.
    """
    named = folds.where(F.col("fold_id").isNotNull() & F.col(key).isNotNull())
    units = named.groupBy("split_name", key).agg(
        F.collect_set(F.struct("fold_id", "fold_rule")).alias("__in"), F.max(group).alias("__g"), F.max(F.coalesce(F.col(rows), F.lit(0))).alias("__rows"),
    )
    once = F.size("__in") == 1
    placed = units.select("split_name", "__g", "__rows", once.alias("__once"), F.posexplode("__in").alias("__at", "f"))
    placed = placed.select("*", F.col("f.fold_id").alias("fold_id"), F.col("f.fold_rule").alias("__rule"))
    tests, plain = F.col("__rule") == "all_but", F.col("__rule") == "include"
    measures = {"participants": F.lit(1), "word_rows": F.col("__rows")}
    measures |= {g: (F.col("__g") == g).cast("int") for g in ("dyslexia_labeled", "typical_control")}
    held = lambda test, m: F.sum(F.when(test, F.coalesce(m, F.lit(0))).otherwise(0)).cast("long")
    own = placed.groupBy("split_name", "fold_id").agg(
        *[held(tests, m).alias(f"n_test_{n}") for n, m in measures.items()],
        *[held(tests & F.col("__once"), m).alias(f"__own_{n}") for n, m in measures.items()],
        *[held(plain, m).alias(f"__plain_{n}") for n, m in measures.items()],
        *[held(tests & (F.col("__at") == 0), m).alias(f"__first_{n}") for n, m in measures.items()],
        F.count_if(tests & ~F.col("__once")).alias("__overlap"),
    )
    totals = own.groupBy("split_name").agg(*[F.sum(f"__first_{n}").alias(f"__all_{n}") for n in measures])
    valid = F.col("__overlap") == 0
    return own.join(totals, "split_name").select(
        "split_name", "fold_id",
        *[(F.col(f"__all_{n}") - F.col(f"__own_{n}") + F.col(f"__plain_{n}")).alias(f"n_train_{n}") for n in measures],
        *[f"n_test_{n}" for n in measures],
        valid.alias("split_valid"), F.when(valid, "").otherwise("participant_overlap_between_train_and_test").alias("skip_reason"),
    )


def _linear_splits(readers: DataFrame, k: int, seed: int, names: Sequence[str]) -> list[DataFrame]:
    """Rows of the wanted splits whose folds are few."""
    parts = []
    if GROUPED in names:
        known = readers.where(F.col("reader_group_binary").isNotNull())
        parts.append(grouped_folds(known, "participant_id", "reader_group_binary", k, seed).drop("reader_group_binary"))
    if SENSITIVITY in names:
        role = F.when(F.col("reader_group") == "uncertain", "exclude").otherwise("include")
        parts.append(readers.select(F.lit(SENSITIVITY).alias("split_name"), F.lit(0).alias("fold_id"), role.alias("split_role"), "participant_id"))
    return parts


def split_labels(
    readers: DataFrame, rows_per_reader: DataFrame, k: int = 5, seed: int = 17,
    names: Sequence[str] = (LEAVE_ONE_OUT, GROUPED, SENSITIVITY),
) -> DataFrame:
    """The named splits of the readers in one table, each row with its fold's counts and validity.

    Leave-one-out has n x n rows, as it is the table asked for. Its counts come from one row a
    reader and are stored, and its rows are exploded last: none of them is moved or aggregated.
    """

    def dressed(rows: DataFrame) -> DataFrame:
        named = rows.join(readers.select("participant_id", "reader_group"), "participant_id", "left")
        return named.join(rows_per_reader.select("participant_id", "n_word_rows"), "participant_id", "left")

    columns = ["split_name", "fold_id", "split_role", "participant_id", "reader_group"]
    parts = []
    if LEAVE_ONE_OUT in names:
        units = dressed(assign_leave_one_out(readers, "participant_id").withColumns({"split_name": F.lit(LEAVE_ONE_OUT)}))
        units = cut_lineage(units)
        counts = compact_fold_counts(units.withColumns({"fold_id": F.col("__fold"), "fold_rule": F.lit("all_but")}))
        rows = _roles(_spread(units, "participant_id"), F.col("__n")).select(*columns)
        parts.append(rows.join(cut_lineage(counts), ["split_name", "fold_id"], "left"))
    few = _linear_splits(readers, k, seed, names)
    if few:
        rows = dressed(reduce(DataFrame.unionByName, few))
        parts.append(rows.select(*columns).join(fold_counts(rows), ["split_name", "fold_id"], "left"))
    return reduce(DataFrame.unionByName, parts).withColumns(
        {
            "include_in_fold": F.col("split_role").isin("train", "test", "include"),
            "split_seed": F.lit(seed),
            "split_version": F.lit("split_policy_v1"),
        }
    )


def exposure_balanced_leave_one_out(readers: DataFrame, exposures: Sequence[str], seed: int = 41) -> DataFrame:
    """Leave-one-out over the readers whose exposure ranges overlap across groups; groups are joined before the rows are exploded."""
    kept = exposure_overlap(readers, "reader_group", exposures)
    units = assign_leave_one_out(kept, "participant_id").join(kept.select("participant_id", "reader_group"), "participant_id")
    return _roles(_spread(units, "participant_id"), F.col("__n")).select(
        "participant_id", F.lit("text_balanced_sensitivity_lopo").alias("split_name"), "fold_id", "split_role", "reader_group",
        F.lit(True).alias("include_in_fold"), F.lit(True).alias("split_valid"), F.lit("").alias("skip_reason"),
        F.lit(seed).alias("split_seed"), F.lit("text_balanced_overlap_v1").alias("split_version"),
    )


def with_extra_splits(splits: DataFrame, extra: DataFrame) -> DataFrame:
    """Union of split tables that differ in columns; what is missing becomes null."""
    return splits.unionByName(extra.select(*[c for c in extra.columns if c in splits.columns]), allowMissingColumns=True)
