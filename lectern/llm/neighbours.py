"""Approximate nearest neighbours by cosine: NN-descent, then greedy search of its graph.

NN-descent starts from random neighbours and betters them: what is near a vector's
neighbour is likely near the vector. Each round joins vectors' neighbours, in both
directions, with their own vectors and compares them with one another, block by block, where
one of the two is fresh in its list; what betters a list is sent to its owner. A query walks the graph: it expands the best vectors
that it has not expanded, keeps the best it meets, and ends when none is left to expand.

Equal vectors are one node, which keeps the smallest ids that any answer can need.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from lectern.llm.common import parts_for
from lectern.session import cut_lineage

BLOCK_NODES = 4096
#: Nodes whose neighbours are gathered and compared together.
ASK_NODES = 256
#: Single precision scores this close to the last wanted one are all worked out in double precision.
MARGIN = 1e-4
JOIN_ROWS = 256
LISTS = [("id", pa.int64()), ("nbrs", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32()))]
LIST_SCHEMA = "id long, nbrs array<long>, scores array<float>"


def block_of(column: str, blocks: int):
    return F.pmod(F.xxhash64(F.lit(7), column), F.lit(blocks)).cast("int")


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, raw, unit``: original and unit vectors as bytes, of rows that take part."""
    wide = "double" in vectors.schema[vector_col].dataType.simpleString()
    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")).dropna()
    sizes = named.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    named = named.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))

    def run(batches):
        for batch in batches:
            ids, raws, units = [], [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()):
                if any(x is None for x in v):
                    continue
                x = np.array(v, dtype=np.float64)
                size = np.sqrt((x * x).sum()) if np.isfinite(x).all() else 0.0
                if size > 0 and np.isfinite(size):
                    ids.append(i)
                    raws.append(((x if wide else x.astype(np.float32)) + 0).tobytes())
                    units.append((x / size).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary()), pa.array(units, pa.binary())], ["vec_id", "raw", "unit"])

    return named.mapInArrow(run, "vec_id long, raw binary, unit binary")


def nodes_of(rows: DataFrame, keep: int) -> DataFrame:
    """One node per distinct vector: its least id, and its ``keep`` least ids."""
    place = F.row_number().over(W.partitionBy("raw").orderBy("vec_id"))
    least = rows.withColumn("place", place).filter(F.col("place") <= keep)
    grouped = least.groupBy("raw").agg(F.first("unit").alias("unit"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    return grouped.select(F.col("members")[0].alias("id"), "unit", "raw", "members")


def matrix(column, kind=np.float32) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float32, copy=False)


def best_lists(owner: np.ndarray, other: np.ndarray, score: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """The ``keep`` best distinct others of each owner, by owner and then falling score."""
    order = np.lexsort((other, -score, owner))
    owner, other, score = owner[order], other[order], score[order]
    # Equal pairs have equal scores but for rounding: drop repeats by pair first.
    pair = np.lexsort((np.arange(len(owner)), other, owner))
    fresh = np.ones(len(owner), dtype=bool)
    again = (owner[pair][1:] == owner[pair][:-1]) & (other[pair][1:] == other[pair][:-1])
    fresh[pair[1:][again]] = False
    owner, other, score = owner[fresh], other[fresh], score[fresh]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, dtype=int)
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.concatenate([first, [len(owner)]])))
    held = place < keep
    return owner[held], other[held], score[held]


def as_lists(owner: np.ndarray, other: np.ndarray, score: np.ndarray) -> pa.Table:
    """One row per owner; owners stand together."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, dtype=int)
    offsets = pa.array(np.concatenate([first, [len(owner)]]).astype(np.int32))
    return pa.table(
        {
            "id": pa.array(owner[first], pa.int64()),
            "nbrs": pa.ListArray.from_arrays(offsets, pa.array(other, pa.int64())),
            "scores": pa.ListArray.from_arrays(offsets, pa.array(score.astype(np.float32))),
        }
    )


def flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of lists as (owner, other, score)."""
    nbrs, scores = table.column("nbrs").combine_chunks(), table.column("scores").combine_chunks()
    sizes = np.diff(nbrs.offsets.to_numpy()) if len(nbrs) else np.zeros(0, dtype=int)
    return np.repeat(table.column("id").to_numpy(), sizes), nbrs.flatten().to_numpy(), scores.flatten().to_numpy()


def random_lists(nodes: DataFrame, n: int, keep: int, seed: int, deals: int = 4) -> DataFrame:
    """First lists: all nodes in the same small random group, over several ways to deal groups."""
    groups = parts_for(n, keep // deals + 1)
    tasks = parts_for(n * deals, BLOCK_NODES)
    group = [F.pmod(F.xxhash64(F.lit(seed + d), "id"), F.lit(groups)) * deals + d for d in range(deals)]
    dealt = nodes.select("id", "unit", F.explode(F.array(*group)).alias("g"))

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("g").to_numpy(), kind="stable")
        g, ids, x = rows.column("g").to_numpy()[order], rows.column("id").to_numpy()[order], matrix(rows.column("unit"))[order]
        cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        parts = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            s = x[a:b] @ x[a:b].T
            i, j = np.nonzero(~np.eye(b - a, dtype=bool))
            parts.append((ids[a + i], ids[a + j], s[i, j]))
        owner, other, score = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(owner, kind="stable")
        return as_lists(owner[order], other[order], score[order])

    lists = dealt.withColumn("task", F.pmod(F.xxhash64("g"), F.lit(tasks))).groupBy("task").applyInArrow(run, LIST_SCHEMA)
    return lists.groupBy("id").agg(F.flatten(F.collect_list("nbrs")).alias("nbrs"), F.flatten(F.collect_list("scores")).alias("scores"))


def both_ways(graph: DataFrame, reverse: int, seed: int) -> DataFrame:
    """``id, near``: the neighbours of each node and up to ``reverse`` nodes that it is a neighbour of."""
    links = graph.select("id", F.explode("nbrs").alias("nbr"))
    back = links.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"))
    drawn = F.row_number().over(W.partitionBy("id").orderBy(F.xxhash64(F.lit(seed), "nbr"), "nbr"))
    back = back.withColumn("r", drawn).filter(F.col("r") <= reverse).drop("r")
    return links.union(back).groupBy("id").agg(F.sort_array(F.collect_set("nbr")).alias("near"))


def sampled_near(graph: DataFrame, most_back: int, seed: int) -> DataFrame:
    """``id, near, fresh``: half the neighbours of each node, and nodes that it is a chosen neighbour of.

    A coin per (round, pair) chooses the links; reverse links are at most ``most_back`` fresh
    and as many old ones. Nodes without a fresh neighbour have nothing new to compare and are left out.
    """
    links = graph.select("id", F.explode(F.arrays_zip("nbrs", "fresh")).alias("n")).select("id", F.col("n.nbrs").alias("nbr"), F.col("n.fresh").alias("fresh"))
    links = links.filter(coin("id", "nbr", seed))
    drawn = F.row_number().over(W.partitionBy("nbr", "fresh").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
    back = links.withColumn("r", drawn).filter(F.col("r") <= most_back).select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "fresh")
    both = links.union(back).groupBy("id", "nbr").agg(F.max("fresh").alias("fresh"))
    near = both.groupBy("id").agg(F.collect_list(F.struct("nbr", "fresh")).alias("n"))
    return near.filter(F.exists("n", lambda x: x["fresh"])).select("id", F.col("n.nbr").alias("near"), F.col("n.fresh").alias("fresh"))


def coin(owner, other, seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), owner, other), F.lit(2)) == 0


def local_join(near: pa.Table, held: pa.Table, keep: int) -> pa.Table:
    """Pairs among each row's neighbours, at least one of them fresh, that better one of their lists."""
    ids, x = held.column("id").to_numpy(), matrix(held.column("small"), np.float16)
    order = np.argsort(ids)
    ids, x, worst = ids[order], x[order], held.column("worst").to_numpy()[order].copy()
    lists, flags = near.column("near").combine_chunks(), near.column("fresh").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    code = np.searchsorted(ids, lists.flatten().to_numpy())
    at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    table = np.full((len(sizes), int(sizes.max(initial=1))), -1)
    fresh = np.zeros(table.shape, dtype=bool)
    table[at], fresh[at] = code, flags.flatten().to_numpy(zero_copy_only=False)
    best = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)]
    for a in range(0, len(table), JOIN_ROWS):
        part, new = table[a : a + JOIN_ROWS], fresh[a : a + JOIN_ROWS]
        v = x[part]
        s = v @ v.transpose(0, 2, 1)
        bound = np.where(part < 0, np.float32(9), worst[part])
        hit = (s > bound[:, :, None]) & (part >= 0)[:, None, :] & (new[:, :, None] | new[:, None, :])
        hit[:, np.arange(part.shape[1]), np.arange(part.shape[1])] = False
        r, i, j = np.nonzero(hit)
        best = list(best_lists(*(np.concatenate(p) for p in zip(best, (part[r, i], part[r, j], s[r, i, j]))), keep))
        full = np.flatnonzero(np.bincount(best[0], minlength=len(ids)) == keep)
        last = np.searchsorted(best[0], full, side="right") - 1
        worst[full] = np.maximum(worst[full], best[2][last])
    return as_lists(ids[best[0]], ids[best[1]], best[2])


def merged(old: pa.Table, new: pa.Table, keep: int) -> pa.Table:
    """Old lists bettered by new entries, which are fresh, and how many entries are new."""
    a, b = flat(old), flat(new)
    b = [c[np.isin(b[0], a[0])] for c in b]
    out = best_lists(*[np.concatenate(p) for p in zip(a, b)], keep)
    made = as_lists(*out)
    names = np.unique(np.concatenate([a[0], a[1], out[1]]))
    pair = lambda rows: np.searchsorted(names, rows[0]) * len(names) + np.searchsorted(names, rows[1])
    was, now = pair(a), pair(out)
    order = np.argsort(was)
    place = np.minimum(np.searchsorted(was[order], now), len(was) - 1)
    known = was[order][place] == now
    waiting = old.column("fresh").combine_chunks().flatten().to_numpy(zero_copy_only=False)[order][place]
    offsets = made.column("nbrs").combine_chunks().offsets
    changed = np.add.reduceat((~known).astype(np.int64), offsets.to_numpy()[:-1]) if len(made) else np.zeros(0, dtype=np.int64)
    flags = pa.ListArray.from_arrays(offsets, pa.array(~known | waiting, pa.bool_()))
    return made.append_column("fresh", flags).append_column("changed", pa.array(changed, pa.int64()))


def placed_by_projection(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """``id, small, block``: half-precision vectors, in blocks of nodes that stand together along random projections.

    Nodes are sorted by the signs of their projections, so near nodes are likely in one block
    and ask for the same neighbours once. Where vectors have no such order, a block's nodes ask
    for at most their own neighbours, so copies grow with the nodes at any number of blocks.
    """

    def code(batches):
        planes = None
        for batch in batches:
            x = matrix(batch.column("unit"))
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], 40)).astype(np.float32)
            bits = ((x @ planes > 0) @ (1 << np.arange(39, -1, -1, dtype=np.int64))) if len(x) else np.zeros(0, dtype=np.int64)
            small = [row.tobytes() for row in x.astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(small, pa.binary()), pa.array(bits, pa.int64())], ["id", "small", "code"])

    def number(batches):
        from pyspark import TaskContext

        seen, first = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            block = first + (seen + np.arange(batch.num_rows)) // ASK_NODES
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("small"), pa.array(block, pa.int64())], ["id", "small", "block"])

    coded = nodes.select("id", "unit").mapInArrow(code, "id long, small binary, code long")
    ranges = coded.repartitionByRange(parts_for(n, 50 * BLOCK_NODES), "code", "id").sortWithinPartitions("code", "id")
    return ranges.mapInArrow(number, "id long, small binary, block long")


def descend(nodes: DataFrame, n: int, keep: int, least_change: float, most_rounds: int, seed: int) -> DataFrame:
    """The neighbour graph ``id, nbrs, scores``, best first.

    Only pairs with a fresh entry are compared: one that came in since it was last chosen.
    """
    blocks = parts_for(n, BLOCK_NODES)
    placed = cut_lineage(placed_by_projection(nodes, n, seed))
    graph = cut_lineage(random_lists(nodes, n, keep, seed).withColumn("fresh", F.transform("nbrs", lambda _: F.lit(True))))
    for step in range(most_rounds):
        turn = seed + step
        near = cut_lineage(sampled_near(graph, keep // 2, turn).join(placed.select("id", "block"), "id"))
        worst = F.when(F.size("scores") < keep, F.lit(-9.0)).otherwise(F.array_min("scores")).cast("float")
        known = placed.select("id", "small").join(graph.select("id", worst.alias("worst")), "id")
        asked = near.select("block", F.explode("near").alias("id")).distinct()
        held = asked.join(known, "id").select(F.col("block").alias("asking"), "id", "small", "worst").toDF("asking", "id", "small", "worst")
        better = near.groupBy("block").cogroup(held.groupBy("asking")).applyInArrow(lambda a, b: local_join(a, b, keep) if a.num_rows else as_lists(*[np.zeros(0)] * 3), LIST_SCHEMA)
        better = better.withColumn("owner", block_of("id", blocks))
        pairs = F.arrays_zip("nbrs", "fresh")
        waiting = F.transform(pairs, lambda x: x["fresh"] & ~coin(F.col("id"), x["nbrs"], turn)).alias("fresh")
        own = graph.select("id", "nbrs", "scores", waiting).withColumn("owner", block_of("id", blocks))
        new = own.groupBy("owner").cogroup(better.groupBy("owner")).applyInArrow(lambda a, b: merged(a, b, keep), LIST_SCHEMA + ", fresh array<boolean>, changed long")
        graph = cut_lineage(new)
        if (graph.agg(F.sum("changed")).first()[0] or 0) <= least_change * n * keep:
            break
    else:
        warnings.warn(f"NN-descent still changed over {least_change} of its entries after {most_rounds} rounds", stacklevel=2)
    return graph.select("id", "nbrs", "scores")


def walk(nodes: DataFrame, graph: DataFrame, queries: DataFrame, n: int, reverse: int, pool: int, step: int, most_hops: int, seed: int) -> DataFrame:
    """``id, nbrs, scores``: for each query node the best nodes that greedy search finds."""
    blocks = parts_for(n, BLOCK_NODES)
    near = cut_lineage(both_ways(graph, reverse, seed).withColumn("block", block_of("id", blocks)))
    placed = cut_lineage(nodes.select("id", "unit").withColumn("block", block_of("id", blocks)))
    asking = cut_lineage(queries.join(nodes.select("id", "unit"), "id").select(F.col("id").alias("q"), F.col("unit").alias("asks")))
    state = cut_lineage(graph.join(queries, "id").select("id", "nbrs", "scores", F.array().cast("array<long>").alias("done"), F.slice("nbrs", 1, step).alias("front")))

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return as_lists(*[np.zeros(0)] * 3)
        ids, x = held.column("id").to_numpy(), matrix(held.column("unit"))
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        parts = []
        for q, vector, wanted in zip(asked.column("q").to_pylist(), matrix(asked.column("asks")), asked.column("wanted")):
            at = np.searchsorted(ids, wanted.values.to_numpy())
            s = x[at] @ vector
            top = np.argsort(-s, kind="stable")[:pool]
            parts.append((np.full(len(top), q), ids[at[top]], s[top]))
        return as_lists(*(np.concatenate(p) for p in zip(*parts)))

    def gather(old: pa.Table, new: pa.Table) -> pa.Table:
        a, b = flat(old), flat(new)
        keep = b[0] != b[1]  # a query is no neighbour of its own
        out = as_lists(*best_lists(*(np.concatenate(p) for p in zip(a, [c[keep] for c in b])), pool))
        done = {q: set(d) | set(f) for q, d, f in zip(*(old.column(c).to_pylist() for c in ("id", "done", "front")))}
        fronts, dones = [], []
        for q, nbrs in zip(out.column("id").to_pylist(), out.column("nbrs").to_pylist()):
            fronts.append([v for v in nbrs if v not in done[q]][:step])
            dones.append([v for v in nbrs if v in done[q]])  # what left the pool cannot come back
        return out.append_column("done", pa.array(dones, pa.list_(pa.int64()))).append_column("front", pa.array(fronts, pa.list_(pa.int64())))

    for _ in range(most_hops):
        front = state.select(F.col("id").alias("q"), F.explode("front").alias("id"))
        if not front.limit(1).count():
            break
        met = front.join(near.select("id", "near"), "id").select("q", F.explode("near").alias("node")).distinct()
        wanted = met.groupBy("q", block_of("node", blocks).alias("block")).agg(F.collect_list("node").alias("wanted")).join(asking, "q")
        scored = wanted.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(score, LIST_SCHEMA)
        groups = parts_for(n, 50 * BLOCK_NODES)
        both = state.withColumn("g", block_of("id", groups)).groupBy("g").cogroup(scored.withColumn("g", block_of("id", groups)).groupBy("g"))
        state = cut_lineage(both.applyInArrow(gather, LIST_SCHEMA + ", done array<long>, front array<long>"))
    return state.select("id", "nbrs", "scores")


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    keep: int = 32,
    reverse: int = 32,
    least_change: float = 0.02,
    most_rounds: int = 20,
    pool: int = 256,
    step: int = 64,
    most_hops: int = 12,
    seed: int = 0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest that are found for each query row.

    ``is_query`` is a condition on ``vec_id``; every other row is a candidate. ``score`` is the
    cosine of the original vectors in double precision; ties go to the smaller id. Rounds of
    NN-descent end when fewer than ``least_change`` of all list entries change; a warning says
    so if ``most_rounds`` come first. Every vector of the walk's pool whose single precision
    score could tie with the last wanted one is scored exactly.

    Null vectors, zero ones, those with null or non-finite components, those not as long as
    most of the table and rows with a null id take no part. Rows that repeat an id are rows
    of their own. Equal vectors are each other's nearest. Fewer candidates than ``k`` give
    all of them, an empty table no rows. Other columns are left out.
    """
    rows = cut_lineage(usable(vectors, id_col, vector_col))
    nodes = cut_lineage(nodes_of(rows, k + 1))
    n = nodes.count()
    asked = rows.filter(is_query).join(nodes.select("id", "raw"), "raw").select("vec_id", "id", "raw")
    queries = cut_lineage(asked.select("id").distinct())
    graph = descend(nodes, n, keep, least_change, most_rounds, seed)
    found = walk(nodes, graph, queries, n, reverse, pool, step, most_hops, seed)
    # Single precision led the search; a margin of nodes is scored exactly.
    least = F.coalesce(F.get("scores", F.lit(k)), F.lit(-9.0)) - MARGIN
    close = F.filter(F.arrays_zip("nbrs", "scores"), lambda x, i: (i < 2 * k + 6) | (x["scores"] >= least))
    near = found.select("id", F.explode(F.transform(close, lambda x: x["nbrs"])).alias("node")).union(queries.select("id", F.col("id").alias("node")))
    pairs = near.join(nodes.select(F.col("id").alias("node"), F.col("raw").alias("other"), "members"), "node")
    pairs = pairs.join(nodes.select("id", "raw"), "id").select("id", "members", "raw", "other")
    kind = np.float64 if "double" in vectors.schema[vector_col].dataType.simpleString() else np.float32

    def exact(batches):
        for batch in batches:
            scores = []
            for a, b in zip(batch.column("raw").to_pylist(), batch.column("other").to_pylist()):
                x, y = (np.frombuffer(r, dtype=kind).astype(np.float64) for r in (a, b))
                scores.append(float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("members"), pa.array(scores, pa.float64())], ["id", "members", "score"])

    scored = pairs.mapInArrow(exact, "id long, members array<long>, score double")
    # A query node needs its k + 1 best rows, whichever of its own rows asks.
    each = scored.select("id", F.explode("members").alias("vec_id"), "score")
    order = W.partitionBy("id").orderBy(F.desc("score"), "vec_id")
    best = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    lists = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    answers = asked.select(F.col("vec_id").alias("query_id"), "id").join(lists, "id")
    own = F.filter("best", lambda b: b["vec_id"] == F.col("query_id"))
    kept = F.slice(F.when(F.size(own) > 0, F.filter("best", lambda b: b["r"] != own[0]["r"])).otherwise(F.col("best")), 1, k)
    ranked = answers.select("query_id", F.posexplode(kept).alias("p", "b"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
