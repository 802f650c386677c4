"""Byte strings of a fixed length that occur more than once, by suffix order and longest factors.

Two windows of ``length`` bytes that are equal have the same least hash of their ``GRAM``-byte
grams at the same place, their anchor. So every text gives its anchors with the range of
windows that each one stands for (its context), and only windows that share an anchor need
comparing:

- an anchor that occurs once has no repeated window;
- if all occurrences of an anchor have one context, all its windows are repeated;
- contexts that occur more than once are repeated throughout, and one stands for all;
- the distinct contexts of all other anchors are gathered by anchor. Their suffixes are ordered by
  prefix doubling, cut at the window length. In that order, ties by place, the previous and
  the next smaller place of a suffix give its longest previous and next factor; a window is
  repeated if either reaches the window length.

Anchors that very many contexts share are gathered by a longer part of the window. Where even
that part is in very many places, its windows are told apart by digest and counted, in an
aggregate that combines before it shuffles: no task gets an unbounded group. Copies of a whole
text stand for each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lectern.llm.common import id_and_text, schema_of
from lectern.session import cut_lineage

GRAM = 32
SEGMENT = 1 << 19
#: An anchor with more contexts is gathered by the bytes that ``STEP`` neighbouring windows share.
CROWDED = 2_000
STEP = 8
CONTEXTS_A_TASK = 8_000
#: Windows that very many places share are dealt over so many salts.
SALTS = 16
#: Contexts are compared in blocks of about so many bytes, whole anchors at a time.
BLOCK_BYTES = 1 << 20

_table = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_steps = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place, by doubling."""
    h = _table[data]
    for k, factor in enumerate(_steps):
        h = h[: -(1 << k)] * factor + h[1 << k :]
    h ^= h >> np.uint64(31)
    h *= _steps[0]
    h ^= h >> np.uint64(29)
    return h


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor of a text, in order."""
    out = []
    data = np.frombuffer(raw, dtype=np.uint8)
    low = np.uint64((1 << 20) - 1)
    width = length - GRAM + 1
    for a in range(0, len(data) - length + 1, SEGMENT):
        h = gram_hashes(data[a : min(len(data), a + SEGMENT + length - 1)])
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)  # ties go to the first place
        span = 1
        while 2 * span <= width:
            packed = np.minimum(packed[:-span], packed[span:])
            span *= 2
        if width > span:
            packed = np.minimum(packed[: span - width], packed[width - span :])
        first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(packed) - 1]])
        place = (packed[first] & low).astype(np.int64)
        out.append((h[place].view(np.int64), place + a, first + a, last + a))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def suffix_ranks(block: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank in suffix order, cut at ``length`` bytes, of the suffixes at ``starts``.

    Equal ranks have equal first ``length`` bytes. Ranks of 8, 16, 32, ... bytes are doubled,
    and the last is composed of the powers of two in ``length`` (a multiple of 8).
    """
    padded = np.concatenate([block, np.zeros(2 * length, dtype=np.uint8)])
    n = len(block) + length
    eight = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        eight = eight << np.uint64(8) | padded[k : k + n].astype(np.uint64)
    rank, size, done = ranks(eight), 8, 0
    found: np.ndarray | None = None
    levels = {8: rank}
    while 2 * size <= length:
        later = np.zeros(n, dtype=np.int64)
        later[: n - size] = rank[size:]
        rank, size = ranks(rank * (n + 1) + later), 2 * size
        levels[size] = rank
    for size in sorted(levels, reverse=True):
        while length - done >= size:
            part = levels[size][starts + done]
            found = part if found is None else ranks(found * (n + 1) + part)
            done += size
    return found


def factor_flags(rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the longest previous, and next, factor of each suffix reaches the full length.

    In suffix order, ties by place, all smaller places of a tie stand before a suffix and its
    previous smaller place is its predecessor; likewise for larger places after it.
    """
    order = np.lexsort((place, rank))
    tied = rank[order][1:] == rank[order][:-1]
    previous, following = np.zeros(len(rank), dtype=bool), np.zeros(len(rank), dtype=bool)
    previous[order[1:]] = tied
    following[order[:-1]] = tied
    return previous, following


def runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(at) != 1)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]


def block_repeats(raw: list[bytes], n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last) of the runs of repeated windows in a block of contexts with ``n`` windows each."""
    block = np.frombuffer(b"".join(raw), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])[:-1]
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    starts = offsets[owner] + within
    previous, following = factor_flags(suffix_ranks(block, starts, length), starts)
    hit = np.flatnonzero(previous | following)
    if not len(hit):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    first, last = runs(owner[hit].astype(np.int64) * (1 << 32) + within[hit])
    return first >> 32, first & 0xFFFFFFFF, last & 0xFFFFFFFF


def text_keys(text: Column) -> list[Column]:
    """Two digests that tell texts apart: 96 bits."""
    return [F.xxhash64(text).alias("k1"), (F.crc32(text) - (1 << 31)).cast("int").alias("k2")]


def counted_windows(pieces: DataFrame, length: int) -> DataFrame:
    """``k1, k2, first, last`` (one window a row) of the windows of ``pieces`` that occur more than once.

    Equal windows have equal digests of 96 bits. Rows of equal texts may count twice, which
    changes nothing: such texts are repeats throughout.
    """
    window = F.col("bytes").substr(F.col("i") + 1, F.lit(length))
    each = pieces.select("g", "k1", "k2", "first", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    each = each.select("g", F.xxhash64(window).alias("w1"), F.crc32(window).alias("w2"), "k1", "k2", (F.col("first") + F.col("i")).alias("at"))
    each = each.withColumn("salt", F.pmod(F.xxhash64("k1", "at"), F.lit(SALTS)).cast("int"))
    again = each.groupBy("g", "w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    again = again.select("g", "w1", "w2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return each.join(again, ["g", "w1", "w2", "salt"], "left_semi").select("k1", "k2", F.col("at").alias("first"), F.col("at").alias("last"))


def repeated_ranges(docs: DataFrame, length: int) -> DataFrame:
    """``k1, k2, ranges``: for each distinct text the byte ranges that repeated windows cover."""
    texts = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).filter(F.length("text") >= length)
    texts = texts.select(*text_keys(F.col("text")), "text")

    def list_anchors(batches):
        for batch in batches:
            out = []
            for k1, k2, raw in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text").to_pylist()):
                h, place, first, last = anchors(raw, length)
                digest = xxhash.xxh64_intdigest
                context = [digest(raw[a : b + length], p - a) - (1 << 63) for p, a, b in zip(place.tolist(), first.tolist(), last.tolist())]
                out.append((np.full(len(h), k1), np.full(len(h), k2), h, np.array(context, dtype=np.int64), place, first, last))
            arrays = [np.concatenate(x) if x else np.zeros(0) for x in zip(*out)] or [np.zeros(0)] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(k.to_pandas_dtype()), k) for a, k in zip(arrays, kinds)], ["k1", "k2", "h", "context", "place", "first", "last"])

    listed = cut_lineage(texts.mapInArrow(list_anchors, "k1 long, k2 int, h long, context long, place int, first int, last int"))
    shared = listed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"))
    shared = shared.filter("n > 1").select("h", (F.col("lo") == F.col("hi")).alias("alike"))
    found = cut_lineage(listed.join(shared, "h").distinct())
    ranges = found.filter("alike").select("k1", "k2", "first", "last")

    # Of equal contexts, which are repeats throughout, one stands for all in the comparison.
    mixed = found.filter("not alike").withColumn("tag", F.xxhash64("k1", "k2", "place"))
    per = cut_lineage(mixed.groupBy("h", "context").agg(F.count(F.lit(1)).alias("c"), F.min("tag").alias("tag_kept")))
    crowded = per.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > CROWDED).select("h", F.lit(True).alias("crowded"))
    judged = cut_lineage(mixed.join(per, ["h", "context"]).select("k1", "k2", "h", "place", "first", "last", "c", (F.col("tag") == F.col("tag_kept")).alias("kept")))
    ranges = ranges.union(judged.filter("c > 1").select("k1", "k2", "first", "last"))
    wanted = judged.filter("kept").join(crowded, "h", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "crowded", "place", "first", "last")).alias("anchors"))
    # Of equal texts one is enough: they stand next to each other, or are told apart later by their key.
    gathered = texts.join(wanted, ["k1", "k2"])

    def contexts(batches):
        before = None
        for batch in batches:
            out = []
            for k1, k2, raw, marked in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "anchors"))):
                if (k1, k2) == before:
                    continue
                before = (k1, k2)
                for a in marked:
                    if not a["crowded"]:
                        out.append((a["h"], k1, k2, a["first"], a["last"] - a["first"] + 1, raw[a["first"] : a["last"] + length]))
                        continue
                    # Windows in steps by their distance to the anchor, keyed by the bytes that all of a step share.
                    first = a["first"]
                    while first <= a["last"]:
                        step = (a["place"] - first) // STEP
                        core_from = a["place"] - step * STEP  # where the last window of the step starts
                        last = min(a["last"], core_from)
                        key = xxhash.xxh64_intdigest(raw[max(0, core_from) : core_from - STEP + 1 + length], (a["h"] ^ step) & 0xFFFFFFFF) - (1 << 63)
                        out.append((key, k1, k2, first, last - first + 1, raw[first : last + length]))
                        first = last + 1
            columns = [list(c) for c in zip(*out)] or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["g", "k1", "k2", "first", "n", "bytes"])

    made = cut_lineage(gathered.mapInArrow(contexts, "g long, k1 long, k2 int, first int, n int, bytes binary"))
    hot = cut_lineage(made.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > CROWDED).select("g"))
    pieces = made.join(hot, "g", "left_anti")
    counted = counted_windows(made.join(hot, "g", "left_semi"), length)
    tasks = max(1, -(-made.count() // CONTEXTS_A_TASK))

    def compare(rows: pa.Table) -> pa.Table:
        columns = {c: rows.column(c).to_numpy() for c in ("g", "k1", "k2", "first", "n")}
        order = np.lexsort((columns["first"], columns["k2"], columns["k1"], columns["g"]))
        k1, k2, first, n, g = (columns[c][order] for c in ("k1", "k2", "first", "n", "g"))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (first[1:] != first[:-1])
        order, g, k1, k2, first, n = order[new], g[new], k1[new], k2[new], first[new], n[new].astype(np.int64)
        raw = rows.column("bytes").take(pa.array(order)).to_pylist()
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
        who, low, high, batch, size = [], [], [], [], 0
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            # Equal contexts are repeats of each other throughout; one of them stands for all in the block.
            same: dict[bytes, list[int]] = {}
            for i in range(a, b):
                same.setdefault(raw[i], []).append(i)
            for members in same.values():
                if len(members) > 1:
                    who += members
                    low += [0] * len(members)
                    high += [int(n[i]) - 1 for i in members]
                batch.append(members[0])
                size += len(raw[members[0]])
            if batch and (size >= BLOCK_BYTES or b == len(g)):
                for column, found in zip((who, low, high), block_repeats([raw[i] for i in batch], n[batch], length)):
                    column += np.array(batch)[found].tolist() if column is who else found.tolist()
                batch, size = [], 0
        who = np.array(who, dtype=np.int64)
        return pa.table(
            {
                "k1": pa.array(k1[who], pa.int64()),
                "k2": pa.array(k2[who], pa.int32()),
                "first": pa.array(first[who] + np.array(low, dtype=np.int64), pa.int32()),
                "last": pa.array(first[who] + np.array(high, dtype=np.int64), pa.int32()),
            }
        )

    compared = pieces.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(tasks))).groupBy("part").applyInArrow(compare, "k1 long, k2 int, first int, last int")
    every = ranges.union(compared).union(counted).select("k1", "k2", F.struct("first", (F.col("last") + length).alias("end")).alias("range"))
    return every.groupBy("k1", "k2").agg(F.collect_list("range").alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = 200, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document what remains without the bytes that repeated strings of ``length`` bytes cover.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in this or
    another document; strings are judged on the input. ``n_spans`` counts maximal removed
    runs, ``kept_sha256`` is of the bytes kept; ``keep_text`` adds them as ``kept``.

    Null texts count as empty, and texts shorter than ``length`` stay whole. Rows that repeat
    an id and text are repeats of each other. An empty table gives no rows; other columns are
    left out.
    """
    if length % 8 or length < 2 * GRAM:
        raise ValueError("length must be a multiple of 8 and at least 64")
    named = id_and_text(docs, id_col, text_col)
    text = F.coalesce("text", F.lit("")).cast("binary")
    copies = named.select(*text_keys(text)).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    ranges = repeated_ranges(named, length)
    known = cut_lineage(ranges.join(copies, ["k1", "k2"], "full"))
    joined = named.select("doc_id", text.alias("text"), *text_keys(text)).join(known, ["k1", "k2"], "left").select("doc_id", "text", "copies", "ranges")
    extra: dict[str, T.DataType] = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType()}
    schema = schema_of(named, "doc_id", **extra, **({"kept": T.BinaryType()} if keep_text else {}))

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for raw, copied, marked in zip(*(batch.column(c).to_pylist() for c in ("text", "copies", "ranges"))):
                spans = [(0, len(raw))] if copied and len(raw) >= length else sorted((r["first"], r["end"]) for r in marked or ())
                kept, at, removed, n = [], 0, 0, 0
                end = -1
                for a, b in spans:
                    if a > end:
                        n += 1
                        kept.append(raw[at:a])
                    removed += max(0, b - max(a, end))
                    end = at = max(end, b)
                rest = b"".join([*kept, raw[max(at, 0) :]])
                for column, value in zip(out, (len(raw), removed, n, hashlib.sha256(rest).hexdigest(), rest)):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays[: len(schema) - 1]], schema.names)

    return joined.mapInArrow(run, schema)
