"""Grouped evaluation refitted without each unit: n x n held-out scores that are never rows.

A unit is one row. Its row makes the fits that leave it out (``one_out``, once per fold) and keeps their
coefficients. Scores are ranked in chunks: units are cut by their score under the fits on everyone, and leaving
out one unit moves no margin further than a bound, so a chunk with that much of its neighbours holds every score
that any refit puts between its cuts. What lies further is above or below for certain and is only counted.
A task holds a block of refits and a chunk of units.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.operators import fold_fits, one_out
from lectern.operators.fold_fits import NOBODY, Fits
from lectern.session import cut_lineage

#: Units ranked and refits made in one task, about.
CHUNK, BLOCK = 8_192, 1_024
#: No cut lies beyond this margin, where scores of different margins become equal; margins this near to a cut count as on both sides.
STEEP, ROOM = 20.0, 1e-6


def _sigmoid(margin):
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))


def _margins(x: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Summed column by column, so equal rows have equal margins wherever they stand."""
    total = x[:, 0] * raw[..., 0]
    for j in range(1, x.shape[1]):
        total = total + x[:, j] * raw[..., j]
    return total


def _shared(rows: DataFrame, everyone: fold_fits.Fitted, penalty: float) -> list[one_out._Shared | None]:
    """Per fold what the fits without a unit start from; none where the fold has no fit."""
    design = everyone.design
    folds = everyone.fits.fold.tolist()
    central = fold_fits.central_values(rows, design.gaps, folds) if design.gaps else {k: np.zeros((0, 4)) for k in folds}
    used = np.ones((1, 1 + len(design.features)), dtype=bool)
    out = []
    for k, ended, raw in zip(folds, everyone.status, everyone.raw):
        if ended == "skipped":
            out.append(None)
            continue
        training = rows.where(F.col("fold") != k)
        moments, second, sizes = one_out._moments(training, design)
        second, reach = one_out._largest_reach(rows, design, second)  # of tested rows too
        sums = one_out._logistic_sums(training, design, raw[None])
        out.append(one_out._Shared(design, "logistic", penalty, used, raw[None], moments, second, sizes, central[k], reach, sums, []))
    return out


def _moved(shared: one_out._Shared, raw: np.ndarray) -> np.ndarray:
    """How far at most any margin is from that of the fit on everyone."""
    move = raw - shared.raw[0]
    return shared.reach * np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", move, shared.second, move), 0.0))


def _refits(rows: DataFrame, shared: list, rounds: int, tolerance: float) -> DataFrame:
    """Per unit its place, class, columns, margin ``m`` under the fits on everyone, coefficients of all folds without it, how far these
    move a margin, and the folds still ``open``."""
    design = next(s for s in shared if s).design
    size = max(design.width**2 * 4, len(one_out._monomials(design.width, 3)))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in one_out._slices(batch, size):
                x, y = design.read(part), one_out._label(part)
                values = np.column_stack([part.column(f"x{j}").to_numpy(zero_copy_only=False).astype(float) for j in range(len(design.features))])
                fold, unit = fold_fits._places(part)
                raw, moved, opened = np.full((len(x), len(shared), design.width), np.nan), np.zeros(len(x)), [[] for _ in x]
                margin = np.full(len(x), np.nan)
                for k, given in enumerate(shared):
                    if given is None:
                        continue
                    raw[:, k] = given.raw[0]
                    own, at = fold == k, np.flatnonzero(fold != k)
                    margin[own] = _margins(x[own], given.raw[0])
                    if len(at):
                        found, ended = one_out._fit_units(given, 0, x[at], values[at], y[at], unit[at], rounds, tolerance)
                        raw[at, k] = np.where((ended == "skipped")[:, None], np.nan, found)
                        for i in at[ended == "open"].tolist():
                            opened[i].append(k)
                        moved[at] = np.maximum(moved[at], np.select([ended == "skipped", ended == "open"], [np.inf, 0.0], _moved(given, found)))
                columns = [pa.array(v.astype(np.int32)) for v in (unit, fold, y)]
                columns += [pa.array(np.where(np.isnan(margin), 0.0, margin), mask=np.isnan(margin)), pa.array(moved), pa.array(opened, pa.list_(pa.int32()))]
                columns += [pa.array([v.tobytes() for v in np.ascontiguousarray(a)], pa.binary()) for a in (x, raw)]
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "fold", "y", "m", "moved", "open", "x", "raw"])

    return cut_lineage(rows.mapInArrow(solve, "unit int, fold int, y int, m double, moved double, open array<int>, x binary, raw binary"))


def _ranked(cuts: np.ndarray, above: np.ndarray, totals: np.ndarray, folds: int):
    """Sums of the metrics over a chunk's scores, for each refit of a block."""
    edges = np.concatenate([[-np.inf], _sigmoid(cuts), [np.inf]])

    def rank(key, held: pa.Table, refits: pa.Table) -> pa.Table:
        chunk = key[1].as_py()
        read = lambda t, c, kind=float: np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=kind)
        fold = held.column("fold").to_numpy()
        order = np.argsort(fold, kind="stable")
        ends = np.searchsorted(fold[order], np.arange(folds + 1))
        units, positive = held.column("unit").to_numpy()[order], held.column("y").to_numpy()[order] == 1
        x = read(held, "x").reshape(held.num_rows, -1)[order] if held.num_rows else np.zeros((0, 1))
        x = [np.asfortranarray(x[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        out = []
        for r in refits.to_pylist():
            raw = np.frombuffer(r["fits"]).reshape(folds, -1)
            if r["again"]:
                raw = raw.copy()
                raw[r["again"]] = np.frombuffer(r["again_raw"]).reshape(len(r["again"]), -1)
            own = np.array([r["its_y"] == 0, r["its_y"] == 1]) if r["its_lo"] is not None else np.zeros(2, dtype=bool)
            size = totals - own
            score = _sigmoid(np.concatenate([_margins(p, raw[k]) for k, p in enumerate(x) if len(p)])) if len(units) else np.zeros(0)
            here = (units != r["removed"]) & ~np.isnan(score)
            if np.isnan(raw).any():  # a fold without a fit scores nobody; there is one chunk then
                size = np.array([(here & ~positive).sum(), (here & positive).sum()])
            over = here & (score >= edges[chunk + 1])
            ahead = above[chunk] - (own if r["its_lo"] is not None and r["its_lo"] > chunk else 0)
            fp, tp = ahead[0] + (over & ~positive).sum(), ahead[1] + (over & positive).sum()
            here &= (score >= edges[chunk]) & ~over
            s, y = score[here], positive[here]
            down = np.argsort(-s)
            s, y = s[down], y[down]
            last = np.flatnonzero(np.append(s[1:] != s[:-1], True)) if len(s) else np.zeros(0, dtype=int)
            hits = np.cumsum(y)[last]
            misses = last + 1 - hits
            pos, neg = np.diff(hits, prepend=0), np.diff(misses, prepend=0)
            tps, fps = tp + hits, fp + misses
            out.append((r["removed"], int(size[1]), int(size[0]), float((pos * (size[0] - fps + neg / 2)).sum()), float((pos * tps / np.maximum(tps + fps, 1)).sum())))
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate({"removed": pa.int32(), "p": pa.int64(), "n": pa.int64(), "u": pa.float64(), "ap": pa.float64()}.items())})

    return rank


def without_each(rows: DataFrame, features: Sequence[str], folds: Sequence[int], iterations: int = 100, penalty: float = 1.0, tolerance: float = 1e-8) -> tuple[DataFrame, list[int]] | None:
    """``removed, roc_auc, pr_auc`` of the grouped evaluation without each unit (-1: nobody), and the units with a fit that did not end.

    ``rows`` are those of ``fold_fits.fold_rows`` with a row a unit. None where no fold, or not every fold, has a fit on everyone to start from.
    """
    spark = rows.sparkSession
    everyone = fold_fits.fit(rows, features, Fits.grid(folds), [list(features)], penalty=penalty, iterations=iterations)
    if penalty <= 0 or not len(everyone.fits) or not set(everyone.status) <= {"converged", "skipped"} or set(everyone.status) == {"skipped"}:
        return None
    shared = _shared(rows, everyone, penalty)
    made = _refits(rows, shared, iterations, tolerance)
    furthest = made.agg(F.max("moved")).first()[0] or 0.0
    pairs = [(k, r["unit"]) for r in made.where(F.size("open") > 0).select("unit", "open").collect() for k in r["open"]]
    again: dict[int, list] = {}
    unfinished = set()
    if pairs:  # few units, or units that move a fit far
        k, u = np.array(pairs).T
        exact = fold_fits.fit(rows, features, Fits(k, u, np.full(len(u), NOBODY), np.zeros(len(u), dtype=np.int64)), [list(features)], penalty=penalty, iterations=iterations)
        for k, u, ended, raw in zip(k.tolist(), u.tolist(), exact.status, exact.raw):
            skipped = ended == "skipped"
            furthest = max(furthest, math.inf if skipped else float(_moved(shared[k], raw[None])[0]))
            again.setdefault(u, []).append((k, np.full_like(raw, np.nan) if skipped else raw))
            if not skipped and ended != "converged":
                unfinished.add(u)
    second = spark.createDataFrame([(u, [k for k, _ in v], np.concatenate([r for _, r in v]).tobytes()) for u, v in again.items()], "removed int, again array<int>, again_raw binary")
    nobody = np.array([np.full(everyone.design.width, np.nan) if s is None else s.raw[0] for s in shared])
    full = spark.createDataFrame([(NOBODY, None, None, bytearray(nobody.tobytes()))], "removed int, its_y int, its_lo int, fits binary")

    scored = made.where("m is not null")
    n = scored.count()
    chunks = 1 if math.isinf(furthest) or any(s is None for s in shared) else math.ceil(max(n, 1) / CHUNK)
    cuts = sorted({c for c in scored.approxQuantile("m", [i / chunks for i in range(1, chunks)], 0.0005) if abs(c) <= STEEP}) if chunks > 1 else []
    room = (0.0 if math.isinf(furthest) else furthest) + ROOM
    place = lambda m: F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= m))
    placed = made.withColumns({"lo": F.when(F.col("m").isNotNull(), place(F.col("m") - room)), "hi": F.when(F.col("m").isNotNull(), place(F.col("m") + room))})
    counts = np.zeros((len(cuts) + 1, 2))
    for r in placed.where("lo is not null").groupBy("lo", "y").count().collect():  # two rows a chunk
        counts[r["lo"], r["y"]] += r["count"]
    above = counts[::-1].cumsum(axis=0)[::-1] - counts
    blocks = math.ceil((n + 1) / BLOCK)
    chunk, block = F.sequence(F.lit(0), F.lit(len(cuts))), F.sequence(F.lit(0), F.lit(blocks - 1))
    held = placed.where("lo is not null").select("unit", "fold", "y", "x", F.explode(F.sequence("lo", "hi")).alias("chunk")).withColumn("block", F.explode(block))
    refits = placed.select(F.col("unit").alias("removed"), F.col("y").alias("its_y"), F.col("lo").alias("its_lo"), F.col("raw").alias("fits")).union(full).join(second, "removed", "left")
    refits = refits.withColumn("block", F.pmod(F.xxhash64("removed"), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(chunk))
    rank = _ranked(np.array(cuts), above, counts.sum(axis=0), len(shared))
    sums = held.groupBy("block", "chunk").cogroup(refits.groupBy("block", "chunk")).applyInArrow(rank, "removed int, p long, n long, u double, ap double")
    found = sums.groupBy("removed").agg(F.max("p").alias("p"), F.max("n").alias("n"), F.sum("u").alias("u"), F.sum("ap").alias("ap"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    found = found.where(F.col("p") + F.col("n") > 0).select("removed", F.when(both, F.col("u") / (F.col("p") * F.col("n"))).alias("roc_auc"), F.when(both, F.col("ap") / F.col("p")).alias("pr_auc"))
    return cut_lineage(found), sorted(unfinished)
