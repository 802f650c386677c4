"""Global shuffle of records into shards by an external shuffle in two passes.

Pass one scatters the records uniformly, by a seeded hash of their place in the input,
into as many buckets as make each one fit in memory. Pass two shuffles each bucket by
Fisher-Yates and writes it. Read bucket after bucket, the records are in uniformly random
order; dealing that order out in turn keeps the shards' row counts at most one apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from lectern.llm.common import parts_for
from lectern.session import cut_lineage

#: Bytes of text that a bucket holds on average, and the least number of buckets.
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 64
#: Offsets are one row of two numbers a bucket; up to so many (some 2 MB) they are broadcast.
BROADCAST_BUCKETS = 100_000


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniformly random order of n rows, the same whenever the bucket is worked on again."""
    draw = np.random.default_rng([seed & 0x7FFFFFFF, bucket])
    order = np.arange(n)
    for i, j in zip(range(n - 1, 0, -1), draw.integers(0, np.arange(n, 1, -1)).tolist()):
        order[i], order[j] = order[j], order[i]
    return order


def shuffled(docs: DataFrame, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text") -> tuple[DataFrame, int]:
    """The number of buckets, and the records of ``docs`` with ``__bucket`` and ``__place``, written in shuffled order.

    Equal rows and null ids are scattered like any others, since the hash is of a row's place
    in the input. Records keep all their columns.
    """
    size = record_size(F.col(f"`{text_col}`"))
    total = docs.agg(F.sum(size)).first()[0] or 0
    n = parts_for(total, bucket_bytes, LEAST_BUCKETS)
    dealt = docs.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in dealt.schema] + [T.StructField("__place", T.LongType())])

    def shuffle(rows: pa.Table) -> pa.Table:
        order = fisher_yates(rows.num_rows, seed, rows.column("__bucket")[0].as_py())
        return rows.take(pa.array(order)).append_column("__place", pa.array(np.arange(rows.num_rows)))

    return cut_lineage(dealt.groupBy("__bucket").applyInArrow(shuffle, schema)), n


def shards(
    docs: DataFrame, n_shards: int = 8, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text"
) -> DataFrame:
    """All records with ``__shard`` and ``__slot``: random order, counts at most one apart.

    Null texts are records of size 1. Empty tables give no rows. Columns of ``docs`` are kept
    whatever their names, but for the ones this module adds, which start with two underscores.
    """
    written, n = shuffled(docs, seed, bucket_bytes, text_col)
    counts = written.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    offsets = running_offsets(counts)
    if n <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    placed = written.join(offsets, "__bucket").withColumn("__at", F.col("__start") + F.col("__place"))
    dealt = placed.withColumns({"__shard": (F.col("__at") % n_shards).cast("int"), "__slot": F.floor(F.col("__at") / n_shards)})
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns], "__shard", "__slot")


def running_offsets(counts: DataFrame) -> DataFrame:
    """Rows before each bucket; sums within runs of 1,024 buckets, then over the runs."""
    grouped = counts.withColumn("__run", F.floor(F.col("__bucket") / 1024))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__run").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = grouped.groupBy("__run").agg(F.sum("__n").alias("__in_run"))
    first = F.coalesce(F.sum("__in_run").over(W.orderBy("__run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("__run", first.alias("__first"))
    return grouped.withColumn("__before", before).join(runs, "__run").select("__bucket", (F.col("__first") + F.col("__before")).alias("__start"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; its rows are read in order by ``__slot``."""
    sharded.repartition("__shard", F.floor(F.col("__slot") / 100_000)).sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(path)
