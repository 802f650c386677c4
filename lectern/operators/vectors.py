"""Sentence and paragraph vectors: encoders, distances, cohesion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions.numeric import cosine_distance
from lectern.operators.sequence import ordered_features


def hashed_bag_of_words(df: DataFrame, tokens: str, out: str = "vector", dimensions: int = 256) -> DataFrame:
    """Unit-length hashed bag-of-words of a token array: the built-in encoder, JVM-side."""
    counts = HashingTF(inputCol=tokens, outputCol="__tf", numFeatures=dimensions).transform(df)
    unit = Normalizer(inputCol="__tf", outputCol="__unit").transform(counts)
    return unit.withColumn(out, vector_to_array("__unit")).drop("__tf", "__unit")


def encode_with(df: DataFrame, encoder: Callable[[pd.Series], list], id_column: str, text: str) -> DataFrame:
    """Plug in any batch text encoder."""
    id_type = dict(df.dtypes)[id_column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({id_column: batch[id_column], "vector": list(encoder(batch[text]))})

    return df.select(id_column, text).mapInPandas(run, f"{id_column} {id_type}, vector array<float>")


def previous_distance(
    df: DataFrame, vector: str, order: Sequence[str], chunk: Column, reset_by: str | None = None,
    out: str = "distance_to_previous",
) -> DataFrame:
    """Cosine distance to the vector before; ``reset_by`` starts anew per unit, None runs through the table."""
    keyed, keys = (df, [reset_by]) if reset_by else (df.withColumn("__all", F.lit(1)), ["__all"])
    placed = ordered_features(keyed, keys, order, chunk=chunk, previous={"__before": vector})
    return placed.withColumn(out, cosine_distance(F.col(vector), F.col("__before"))).drop("__before", "__all")


def centroids(df: DataFrame, unit: str, vector: str) -> DataFrame:
    """Mean vector per unit over all coordinates: averages combine map-side.

    A coordinate's mean is over the vectors that have it; a null unit is a unit.
    """
    cells = df.select(unit, F.posexplode(vector).alias("__at", "__x"))
    means = cells.groupBy(unit, "__at").agg(F.avg(F.col("__x").cast("double")).alias("__x"))
    ordered = F.sort_array(F.collect_list(F.struct("__at", "__x")))
    return means.groupBy(unit).agg(F.transform(ordered, lambda c: c["__x"]).alias("centroid"))


def unit_distance(df: DataFrame, units: DataFrame, unit: str, vector: str, unit_vector: str, out: str = "distance_to_unit") -> DataFrame:
    """Cosine distance of each vector to its unit's vector."""
    joined = df.join(units.select(unit, unit_vector), unit, "left")
    return joined.withColumn(out, cosine_distance(F.col(vector), F.col(unit_vector))).drop(unit_vector)


def cohesion(df: DataFrame, unit: str, distance: str) -> DataFrame:
    """Cohesion (1 - mean adjacent distance) and drift per unit; null for a single vector."""
    drift = F.avg(distance)
    return df.groupBy(unit).agg(
        (1.0 - drift).alias("paragraph_cohesion"), drift.alias("local_semantic_drift"), F.count(F.lit(1)).alias("sentence_count_embedded")
    )
