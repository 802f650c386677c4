"""Ordered operators that survive a key holding a large share of all rows.

A plain window over a hot key puts all of its rows in one task. These
operators cut each key into chunks along its order, work inside the chunks in
parallel, reduce every chunk to one summary row, accumulate the few summaries,
and add them back:

    rows --(key, chunk)--> local window
    rows --(key, chunk)--> summaries --(key)--> running summaries
    local window  join  running summaries  on (key, chunk)

``chunk`` must not decrease along ``order`` inside a key, e.g. an integer order
column divided by the chunk size. Null keys and null chunks count as values, the first in
order, and no row is dropped. Without a
``chunk`` a plain window is used: right when groups are known to be small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of one chunk when the order column counts rows.
CHUNK_ROWS = 1 << 16

_CHUNK = "__chunk"


def sampled_chunks(df: DataFrame, order: str, name: str, cuts: int = 255) -> DataFrame:
    """``df`` with a chunk number that follows ``order``, cut at the values of a uniform sample.

    The sample is ``cuts`` rows of least hash, so chunks hold about equally many values
    however alike they begin; equal values share a chunk, nulls come first.
    """
    sample = df.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order), order).limit(cuts)
    packed = sample.agg(F.array_sort(F.collect_list(order)).alias("__edges")).scalar()
    held = df.withColumn("__edges", packed)
    return held.withColumn(name, F.size(F.filter("__edges", lambda e: e < F.col(order)))).drop("__edges")


def by_rows(order: Column | str, size: int = CHUNK_ROWS) -> Column:
    """Chunk number of a non-negative integer order column."""
    return F.floor((F.col(order) if isinstance(order, str) else order) / size).cast("long")


def ordered_features(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    *,
    chunk: Column | None = None,
    index: str | None = None,
    size: str | None = None,
    running: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ordered columns per key.

    ``index``: 0-based position; ``size``: rows of the key; ``running``: sum of
    an expression over the rows strictly before; ``totals``: its sum over the
    key; ``previous`` / ``following``: value of a column in the neighbour row.
    """
    keys, order = list(keys), [F.col(o) if isinstance(o, str) else o for o in order]
    running, totals = dict(running or {}), dict(totals or {})
    previous, following = dict(previous or {}), dict(following or {})
    if chunk is None:
        return _plain(df, keys, order, index, size, running, totals, previous, following)

    # One struct of keys and chunk places windows, summaries and the join alike; nulls in it are values like others.
    parts = {k: f"k{i}" for i, k in enumerate(keys)}
    rows = df.withColumn(_CHUNK, F.struct(*[F.col(k).alias(n) for k, n in parts.items()], chunk.alias("c")))
    rank = F.struct(*order)
    summary: dict[str, Column] = {"__n": F.count(F.lit(1))}
    summary |= {f"__run_{k}": F.sum(v) for k, v in running.items()}
    summary |= {f"__tot_{k}": F.sum(v) for k, v in totals.items()}
    summary |= {f"__last_{k}": F.max_by(F.struct(v), rank) for k, v in previous.items()}
    summary |= {f"__first_{k}": F.min_by(F.struct(v), rank) for k, v in following.items()}
    chunks = rows.groupBy(_CHUNK).agg(*[c.alias(n) for n, c in summary.items()])

    own = [F.col(_CHUNK).getField(n) for n in parts.values()]
    ordered = Window.partitionBy(*own).orderBy(F.col(_CHUNK).getField("c"))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*own)
    carried = [F.col(_CHUNK)]
    carried.append(F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base_n"))
    carried.append(F.sum("__n").over(whole).alias("__size"))
    carried += [F.coalesce(F.sum(f"__run_{k}").over(before), F.lit(0)).alias(f"__base_{k}") for k in running]
    carried += [F.sum(f"__tot_{k}").over(whole).alias(f"__all_{k}") for k in totals]
    carried += [F.lag(f"__last_{k}").over(ordered).alias(f"__prev_{k}") for k in previous]
    carried += [F.lead(f"__first_{k}").over(ordered).alias(f"__next_{k}") for k in following]
    offsets = chunks.select(*carried)

    local = Window.partitionBy(_CHUNK).orderBy(*order)
    local_before = local.rowsBetween(Window.unboundedPreceding, -1)
    inner: dict[str, Column] = {}
    if index:
        inner["__rn"] = F.row_number().over(local) - 1
    inner |= {f"__in_{k}": F.coalesce(F.sum(v).over(local_before), F.lit(0)) for k, v in running.items()}
    inner |= {f"__lag_{k}": F.lag(F.struct(v)).over(local) for k, v in previous.items()}
    inner |= {f"__lead_{k}": F.lead(F.struct(v)).over(local) for k, v in following.items()}
    # The rows lie by key and chunk, sorted, after their window: merged there, only the summaries move.
    # Neither side is broadcast on a guess of its size. Rows without a window are never the broadcast side.
    joined = rows.withColumns(inner).join(offsets.hint("merge"), _CHUNK) if inner else rows.join(offsets, _CHUNK, "left")

    result: list[Column] = [F.col(c) for c in df.columns]
    if index:
        result.append((F.col("__rn") + F.col("__base_n")).cast("long").alias(index))
    if size:
        result.append(F.col("__size").cast("long").alias(size))
    result += [(F.col(f"__in_{k}") + F.col(f"__base_{k}")).alias(k) for k in running]
    result += [F.col(f"__all_{k}").alias(k) for k in totals]
    result += [F.coalesce(f"__lag_{k}", f"__prev_{k}").getField(v).alias(k) for k, v in previous.items()]
    result += [F.coalesce(f"__lead_{k}", f"__next_{k}").getField(v).alias(k) for k, v in following.items()]
    return joined.select(*result)


def _plain(df, keys, order, index, size, running, totals, previous, following) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy(*order)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    added: dict[str, Column] = {}
    if index:
        added[index] = (F.row_number().over(ordered) - 1).cast("long")
    if size:
        added[size] = F.count(F.lit(1)).over(whole)
    added |= {k: F.coalesce(F.sum(v).over(before), F.lit(0)) for k, v in running.items()}
    added |= {k: F.sum(v).over(whole) for k, v in totals.items()}
    added |= {k: F.lag(v).over(ordered) for k, v in previous.items()}
    added |= {k: F.lead(v).over(ordered) for k, v in following.items()}
    return df.withColumns(added)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], bars: int = 64
) -> DataFrame:
    """Exact, linearly interpolated quantiles per key without gathering a key in one task.

    Equal values are counted first (map-side combine). A mergeable sketch of the
    distinct values then cuts each key into ``bars`` bars of about equally many
    values, whatever the shape of the distribution; the bar counts tell which
    bars hold the wanted ranks, and only the values inside those are ordered.
    The sketch only places the cuts, so its error cannot reach the result.
    """
    if not keys:
        one = exact_quantiles(df.withColumn("__one", F.lit(1)), ["__one"], value, probabilities, bars)
        return one.drop("__one")
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(
        F.count(F.lit(1)).alias("__c")
    )
    cuts = F.percentile_approx("__v", [i / bars for i in range(1, bars)], 1000) if bars > 1 else F.array().cast("array<double>")
    ranges = counts.groupBy(*[F.col(k).alias(f"__r_{k}") for k in keys]).agg(cuts.alias("__cuts"), F.sum("__c").alias("__n"))
    bar = F.size(F.filter("__cuts", lambda cut: cut < F.col("__v")))
    matched = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    placed = counts.join(ranges, matched).select(*keys, "__v", "__c", "__n", bar.alias("__bar"))
    bars = placed.groupBy(*keys, "__bar").agg(F.sum("__c").alias("__bc"), F.max("__n").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__bar").rowsBetween(Window.unboundedPreceding, -1)
    bars = bars.withColumn("__base", F.coalesce(F.sum("__bc").over(upto), F.lit(0)))
    ranks = F.array(
        *[
            r
            for p in probabilities.values()
            for r in (
                F.floor((F.col("__n") - 1) * F.lit(p)).cast("long"),
                F.ceil((F.col("__n") - 1) * F.lit(p)).cast("long"),
            )
        ]
    )
    wanted = F.exists(ranks, lambda r: (r >= F.col("__base")) & (r < F.col("__base") + F.col("__bc")))
    kept = bars.where(wanted).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bar").alias("__kbar"), "__base")
    on = [F.col("__bar") == F.col("__kbar")] + [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    inside = placed.join(kept, on).select(*keys, "__v", "__c", "__n", "__bar", "__base")
    within = Window.partitionBy(*keys, "__bar").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__base") + F.coalesce(F.sum("__c").over(within), F.lit(0))
    inside = inside.withColumn("__start", start)

    def at(rank: Column) -> Column:
        hit = (rank >= F.col("__start")) & (rank < F.col("__start") + F.col("__c"))
        return F.max(F.when(hit, F.col("__v")))

    picked = []
    for name, p in probabilities.items():
        spot = (F.col("__n") - 1) * F.lit(p)
        picked += [
            at(F.floor(spot)).alias(f"__a_{name}"),
            at(F.ceil(spot)).alias(f"__b_{name}"),
            F.max(spot - F.floor(spot)).alias(f"__f_{name}"),
        ]
    found = inside.groupBy(*keys).agg(*picked)
    return found.select(
        *keys,
        *[
            (F.col(f"__a_{n}") + (F.col(f"__b_{n}") - F.col(f"__a_{n}")) * F.col(f"__f_{n}")).alias(n)
            for n in probabilities
        ],
    )


def unpivot_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Long form (keys, name, value) of numeric columns in one pass."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), name, value
    )
