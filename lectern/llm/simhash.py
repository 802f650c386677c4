"""SimHash fingerprints of word shingles and near duplicates within a Hamming radius.

Pairs within the radius are found in buckets of fingerprints that agree on chosen bits, and
near copies in buckets of sets of shingles that share a band of minima.
In a bucket fingerprints are compared bit-sliced: each bit's plane is stored vertically, a
plane and its shift by one, two, ... rows differ in one exclusive or for 64 pairs at once,
carry-save counters add these differences up, and a block of pairs is given up as soon as
all its counters are beyond the radius. Only links that span a bucket's groups leave it.
Near copies are such links whose shingle sets were compared exactly.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window as W

from lectern.llm.common import parts_for, schema_of
from lectern.llm.components import connected_components
from lectern.session import cut_lineage

BLOCK_WORDS = 256
ROWS_A_TASK = 60_000
#: A bucket of more rows is dealt over blocks of about so many, and each two blocks are compared in a task.
BLOCK_ROWS = 8_192
#: The same where every near pair leaves a task, for pairs grow with the square.
ROWS_A_TASK_OF_PAIRS, BLOCK_ROWS_OF_PAIRS = 2_000, 512
#: Rows are dealt over so many salts where they learn that their bucket is split.
SALTS = 64
#: A node with more links has its shingles dealt over salts, one for so many links.
LINKS_A_SALT = 100
#: Bands of minima that near copies are searched by, and the minima of a band.
BANDS, BAND_ROWS = 30, 8


def shingle_hashes(raw: bytes | None, width: int, bits: int, seed: int) -> np.ndarray:
    """Hashes (rows of ``bits`` / 8 bytes) of the word shingles, repeats included."""
    words = (raw or b"").lower().split()  # lower-cases A-Z only, and splits at ASCII white space
    if not words:
        return np.zeros((0, bits // 8), dtype=np.uint8)
    joined = b" ".join(words)
    if len(words) <= width:
        pieces = [joined]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - width + 1].tolist()
        pieces = [joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist())]
    if bits == 64:
        h = xxhash.xxh64_intdigest
        found = np.array([h(p, seed) for p in pieces], dtype=">u8").view(np.uint8)
    else:
        h = xxhash.xxh3_128_digest
        found = np.frombuffer(b"".join([h(p, seed + k) for p in pieces for k in range(bits // 128)]), dtype=np.uint8)
    return found.reshape(len(pieces), bits // 8)


def fingerprint(raw: bytes | None, width: int = 3, bits: int = 64, seed: int = 42) -> bytes:
    """A bit is set if it is in over half the hashes; a text without words has none set."""
    hashes = shingle_hashes(raw, width, bits, seed)
    ones = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def band_keys(hashes: np.ndarray, seed: int) -> bytes:
    """``BANDS`` keys of 64 bits, each of the minima of ``BAND_ROWS`` random orders of a set's hashes.

    Two sets share some key with a chance of 1 - (1 - J^8)^30 at Jaccard similarity J: 0.996 at
    0.8, however many sets there are.
    """
    draw = np.random.default_rng(seed)
    factor, shift = (draw.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    step = max(1, (1 << 18) // max(1, len(hashes)))
    least = [(hashes * factor[i : i + step, None] + shift[i : i + step, None]).min(axis=1, initial=np.iinfo(np.uint64).max) for i in range(0, len(factor), step)]
    minima = np.concatenate(least).reshape(BANDS, BAND_ROWS)
    return b"".join(xxhash.xxh3_64_digest(row.tobytes(), band) for band, row in enumerate(minima))


def set_fingerprint(raw: bytes | None, width: int, bits: int, seed: int) -> tuple[bytes, bytes]:
    """The fingerprint of the distinct shingles with a digest that only equal sets share, and the set's band keys."""
    hashes = np.unique(np.ascontiguousarray(shingle_hashes(raw, width, bits, seed)).view(f"V{bits // 8}").ravel())
    rows = hashes.view(np.uint8).reshape(len(hashes), bits // 8)
    ones = np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    made = np.packbits(2 * ones > len(rows)).tobytes() + xxhash.xxh3_128_digest(rows.tobytes(), seed)
    return made, band_keys(np.ascontiguousarray(rows[:, :8]).view("<u8").ravel(), seed)


def fingerprints(docs: DataFrame, width: int, bits: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            made = [fingerprint(raw, width, bits, seed) for raw in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "fingerprint"])

    return named.mapInArrow(run, schema_of(named, "doc_id", fingerprint=T.BinaryType()))


def agreeing_bits(bits: int, radius: int, blocks: int) -> list[np.ndarray]:
    """Bits to agree on: at most ``radius`` of ``blocks`` blocks differ, so some choice of the others agrees."""
    parts = np.array_split(np.arange(bits), blocks)
    return [np.concatenate(c) for c in itertools.combinations(parts, blocks - radius)]


def sampled_bits(bits: int, radius: int, n: int, miss: float, seed: int = 0) -> list[np.ndarray]:
    """Random choices of about log2(n) bits, as many as leave a pair at ``radius`` out with chance ``miss``."""
    each = max(10, math.ceil(math.log2(max(n, 2))) - 1)
    agree = (1 - radius / bits) ** each
    tables = math.ceil(math.log(miss) / math.log(1 - agree))
    draw = np.random.default_rng(seed)
    return [draw.choice(bits, size=each, replace=False) for _ in range(tables)]


def planes(rows: np.ndarray) -> np.ndarray:
    """Bit planes, one row of 64-bit words a bit; lane i is bit i % 64 of word i // 64."""
    packed = np.packbits(np.unpackbits(rows, axis=1).T, axis=1, bitorder="little")
    room = -packed.shape[1] % 8 + 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, room)))).view("<u8")


def lanes_within(own: np.ndarray, other: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """Of the valid lanes, those where the planes differ in at most ``radius`` bits."""
    out = np.zeros_like(valid)
    size = (radius + 1).bit_length()
    start = (1 << size) - (radius + 1)  # counters overflow with difference radius + 1
    for a in range(0, len(valid), BLOCK_WORDS):
        alive = valid[a : a + BLOCK_WORDS].copy()
        if not alive.any():
            continue
        counter = [np.full_like(alive, ~np.uint64(0) if start >> k & 1 else np.uint64(0)) for k in range(size)]
        for p in range(0, len(own), 3):
            x = own[p : p + 3, a : a + BLOCK_WORDS] ^ other[p : p + 3, a : a + BLOCK_WORDS]
            if len(x) == 3:  # carry-save adder: three planes into ones and twos
                half = x[0] ^ x[1]
                added = [(0, half ^ x[2]), (1, (x[0] & x[1]) | (half & x[2]))]
            else:
                added = [(0, row) for row in x]
            for level, carry in added:
                for k in range(level, size):
                    counter[k], carry = counter[k] ^ carry, counter[k] & carry
                alive &= ~carry
            if not alive.any():
                break
        out[a : a + BLOCK_WORDS] = alive
    return out


def shifted(words: np.ndarray, lag: int) -> np.ndarray:
    """Lane i of the result is lane i + lag of ``words``."""
    skip, rest = divmod(lag, 64)
    out = np.zeros_like(words)
    kept = words[:, skip:]
    out[:, : kept.shape[1]] = kept >> np.uint64(rest)
    if rest:
        out[:, : kept.shape[1] - 1] |= kept[:, 1:] << np.uint64(64 - rest)
    return out


def spanning_links(rows: np.ndarray, run: np.ndarray, radius: int, label: np.ndarray | None = None, every: bool = False) -> np.ndarray:
    """Links (row, least row of its group) of all groups that pairs within ``radius`` connect.

    ``run`` numbers the buckets; equal numbers stand together, the largest buckets first.
    With ``label``, the least row of the group each row is in already, the links are near pairs
    themselves: those that connect groups, or with ``every`` all between different groups.
    """
    n = len(rows)
    stars = label is None
    label = np.arange(n) if label is None else label.copy()
    pairs: list[np.ndarray] = [np.zeros((0, 2), dtype=np.int64)]
    sizes = np.bincount(run)
    wide = sizes[run]
    bits = planes(rows)
    for lag in range(1, int(sizes.max(initial=1))):
        held = int(np.searchsorted(-wide, -lag, side="left"))  # rows of buckets larger than the lag
        same = np.zeros(bits.shape[1] * 64, dtype=bool)
        top = min(held, n - lag)
        same[:top] = run[:top] == run[lag : top + lag]
        words = -(-top // 64)
        valid = np.packbits(same, bitorder="little").view("<u8")[:words]
        near = lanes_within(bits[:, :words], shifted(bits[:, : words + lag // 64 + 2], lag)[:, :words], valid, radius)
        at = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        at = at[label[at] != label[at + lag]]
        if every:
            pairs.append(np.stack([at, at + lag], 1))
        elif len(at):
            joins = []
            for i in at.tolist():
                a, b = i, i + lag
                while label[a] != a:
                    a = int(label[a])
                while label[b] != b:
                    b = int(label[b])
                if a != b:
                    joins.append((i, i + lag))
                label[max(a, b)] = min(a, b)
            if joins:
                pairs.append(np.array(joins))
            while (label[label] != label).any():
                label = label[label]
    if not stars:
        return np.concatenate(pairs)
    moved = np.flatnonzero(label != np.arange(n))
    return np.stack([moved, label[moved]], 1)


def matrix(made: list[bytes], bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(made), dtype=np.uint8).reshape(len(made), -1)[:, : bits // 8]


def bits_chosen(choices: list[np.ndarray], bits: int):
    """A row's keys: the fingerprint's bits at each choice."""

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        held = np.unpackbits(matrix(batch.column("fingerprint").to_pylist(), bits), axis=1).astype(np.int64)
        return np.stack([(held[:, chosen] @ (1 << np.arange(len(chosen), dtype=np.int64))) * len(choices) + k for k, chosen in enumerate(choices)], axis=1)

    return keys, len(choices)


def bands_held(batch: pa.RecordBatch) -> np.ndarray:
    """A row's keys: those of its bands."""
    return np.frombuffer(b"".join(batch.column("bands").to_pylist()), dtype="<i8").reshape(-1, BANDS)


def bucket_rows(distinct: DataFrame, keys, n_keys: int, n: int, block_rows: int) -> tuple[DataFrame, int]:
    """``key, pair`` and the columns of ``distinct`` but ``bands`` for each row and key, and how many rows these are.

    Rows to compare share ``key`` and ``pair``. A bucket of over ``block_rows`` rows is dealt
    over blocks, and a row goes to each pair of blocks with its own, so any two rows of a
    bucket meet in some pair, and no pair has much over twice ``block_rows``.
    """
    columns = [c for c in distinct.columns if c != "bands"]

    def keyed(batches):
        for batch in batches:
            kept = [batch.column(c) for c in columns]
            for own in np.ascontiguousarray(keys(batch).T):
                yield pa.RecordBatch.from_arrays([pa.array(own), *kept], ["key", *columns])

    rows = distinct.mapInArrow(keyed, "key long, " + ", ".join(f"{c} binary" for c in columns))
    large, more = None, 0
    if n > block_rows:
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > block_rows)
        large = cut_lineage(counts.select("key", "held", F.ceil(F.col("held") / F.lit(block_rows)).cast("int").alias("blocks")))
        more = large.agg(F.sum(F.col("held") * (F.col("blocks") - 1))).first()[0] or 0
    if not more:
        return rows.withColumn("pair", F.lit(0).cast("long")), n * n_keys
    salted = large.select("key", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "fingerprint"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")
    return rows.select("key", *columns, pair.alias("pair")), n * n_keys + more


def near_links(distinct: DataFrame, keys, n_keys: int, radius: int, n: int, bits: int, pairs: str = "", turn: int = 0) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that connect all pairs found within the radius.

    What follows the first ``bits`` bits of a fingerprint only tells it from others. With
    ``pairs`` "spanning" or "every", ``distinct`` also has ``group``, and the links are near
    pairs of different groups, as many as connect them (which ones, changes with ``turn``) or all.
    """
    columns = ["fingerprint", "group"] if pairs else ["fingerprint"]

    def compare(rows: pa.Table) -> pa.Table:
        key, pair = (rows.column(c).to_numpy() for c in ("key", "pair"))
        order = np.lexsort((pair, key))
        run = np.empty(len(order), dtype=np.int64)
        run[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0) | (np.diff(pair[order]) != 0)]))
        sizes = np.bincount(run)
        order = np.lexsort((np.random.default_rng(turn).permutation(len(run)), run, -sizes[run]))
        order = order[sizes[run[order]] > 1]
        if not len(order):
            return pa.table({k: pa.array([], pa.binary()) for k in "ab"})
        made = rows.column("fingerprint").take(pa.array(order)).to_pylist()
        run = np.cumsum(np.concatenate([[0], np.diff(run[order]) != 0]))
        label = None
        if pairs:
            first: dict[tuple, int] = {}
            label = np.array([first.setdefault((r, g), i) for i, (r, g) in enumerate(zip(run.tolist(), rows.column("group").take(pa.array(order)).to_pylist()))])
        found = spanning_links(matrix(made, bits), run, radius, label, pairs == "every")
        return pa.table({k: pa.array([made[i] for i in found[:, c]], pa.binary()) for c, k in enumerate("ab")})

    every = pairs == "every"
    rows, total = bucket_rows(distinct.select(*columns, *[c for c in distinct.columns if c == "bands"]), keys, n_keys, n, BLOCK_ROWS_OF_PAIRS if every else BLOCK_ROWS)
    tasks = parts_for(total, ROWS_A_TASK_OF_PAIRS if every else ROWS_A_TASK)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "pair"), F.lit(tasks)))
    links = rows.groupBy("part").applyInArrow(compare, "a binary, b binary")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = 3, bits: int = 64, radius: int = 2, miss: float | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint (binary), component_id``: documents linked through near fingerprints.

    Fingerprints at most ``radius`` bits apart are linked; ``component_id`` is the least id
    that can be reached. With ``miss`` None the search finds every pair (for small radii);
    else it samples bits and leaves out a pair at the radius with that chance at most, nearer
    pairs with less. Equal fingerprints are compared once.

    Null and empty texts have fingerprint zero and are linked like any other. A component
    whose ids are all null has a null component. Repeated rows give a row each, an empty
    table none; other columns are left out.
    """
    made = cut_lineage(fingerprints(docs, width, bits, seed, id_col, text_col))
    labelled = grouped(made, lambda n: agreeing_bits(bits, radius, radius + 4) if miss is None else sampled_bits(bits, radius, n, miss), radius, bits)
    groups = labelled.groupBy("__group").agg(F.min("__least").alias("component_id"))
    return made.join(labelled.join(groups, "__group").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "fingerprint", "component_id")


def grouped(made: DataFrame, choose, radius: int, bits: int) -> DataFrame:
    """``fingerprint, __least, __group``: each distinct fingerprint, its least id and its component."""
    distinct = cut_lineage(made.groupBy("fingerprint").agg(F.min("doc_id").alias("__least")))
    n = distinct.count()
    found = connected_components(near_links(distinct, *bits_chosen(choose(n), bits), radius, n, bits))
    labelled = distinct.join(found, F.col("fingerprint") == F.col("node"), "left")
    return cut_lineage(labelled.select("fingerprint", "__least", F.coalesce("component", "fingerprint").alias("__group")))


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of texts whose shingle sets have this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def similar_links(links: DataFrame, texts: DataFrame, width: int, similarity: float, seed: int) -> DataFrame:
    """The links ``a, b`` whose texts' sets of shingles have at least this Jaccard similarity.

    ``texts`` has a ``text`` or several for each ``fingerprint``, any of which will do; only
    those of linked nodes are read on. A node's set is sent once for every
    ``LINKS_A_SALT`` of its links, so a node with very many is not one task.
    """
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    shares = F.ceil(F.count(F.lit(1)) / F.lit(LINKS_A_SALT)).cast("int").alias("n_salts")
    nodes = cut_lineage(ends.groupBy("node").agg(shares))
    crowded = cut_lineage(nodes.filter("n_salts > 1"))

    def hashed(batches):
        for batch in batches:
            made = [np.unique(shingle_hashes(t.encode() if t is not None else None, width, 64, seed).view(np.uint64)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n_salts"), pa.array(made, pa.binary())], ["node", "n_salts", "held"])

    linked = texts.join(nodes, F.col("fingerprint") == F.col("node")).groupBy("node")
    texts = linked.agg(F.any_value("n_salts").alias("n_salts"), F.min_by("text", F.struct(F.length("text"), F.xxhash64("text"))).alias("text"))
    sets = texts.mapInArrow(hashed, "node binary, n_salts int, held binary")
    sets = cut_lineage(sets.select("node", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"), "held"))
    rows = links
    for end, other in ("ab", "ba"):
        few = crowded.select(F.col("node").alias(end), F.col("n_salts").alias(f"{end}_salts"))
        salt = F.pmod(F.xxhash64(other), F.coalesce(F.col(f"{end}_salts"), F.lit(1))).cast("int")
        rows = rows.join(few, end, "left").withColumn(f"{end}_salt", salt).drop(f"{end}_salts")
    for end in "ab":
        rows = rows.join(sets.select(F.col("node").alias(end), F.col("salt").alias(f"{end}_salt"), F.col("held").alias(f"{end}_held")), [end, f"{end}_salt"])

    def verify(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("a_held"), batch.column("b_held")):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(kept, pa.bool_())) for k in "ab"], ["a", "b"])

    return rows.select("a", "b", "a_held", "b_held").mapInArrow(verify, "a binary, b binary")


def similar_groups(nodes: DataFrame, texts: DataFrame, radius: int, bits: int, width: int, similarity: float, seed: int) -> DataFrame:
    """``fingerprint, group`` of all nodes that have a link verified; the group is its least node.

    First the links that connect what is within the radius are verified. Where one fails,
    others may still connect its ends: its component is searched again with what is verified
    as groups, through other links as long as most of them hold, and at last through every
    near pair of different groups. So each pair found is verified, or its ends are connected.
    ``nodes`` has the ``bands`` of each ``fingerprint``.
    """
    nodes = nodes.select("fingerprint", "bands", F.col("fingerprint").alias("group"))
    n = nodes.count()
    pairs, turn, good = "spanning", 0, None
    live = nodes
    while True:
        found = cut_lineage(near_links(live, bands_held, BANDS, radius, n, bits, pairs, turn))
        new = cut_lineage(similar_links(found, texts, width, similarity, seed))
        good = new if good is None else cut_lineage(good.union(new))
        n_found, n_new = found.count(), new.count()
        groups = cut_lineage(connected_components(good).select(F.col("node").alias("fingerprint"), F.col("component").alias("group")))
        if n_new == n_found and not turn or pairs == "every" or not n_found:
            return groups
        if not turn:
            loose = cut_lineage(connected_components(found))
            failed = found.join(new, ["a", "b"], "left_anti").select(F.col("a").alias("node"))
            open_ones = loose.join(failed, "node").select("component").distinct()
            live_nodes = loose.join(open_ones, "component").select(F.col("node").alias("fingerprint"))
            live_nodes = cut_lineage(live_nodes.join(nodes.drop("group"), "fingerprint"))
            n = live_nodes.count()
        live = cut_lineage(live_nodes.join(groups, "fingerprint", "left").select("fingerprint", "bands", F.coalesce("group", "fingerprint").alias("group")))
        pairs, turn = "spanning" if 2 * n_new > n_found else "every", turn + 1


def one_of_each(
    docs: DataFrame, width: int = 5, similarity: float = 0.8, bits: int = 256, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each group of near copies, with all its columns: the one of the least id.

    Texts are linked if the Jaccard similarity of their sets of ``width``-word shingles is at
    least ``similarity``, compared exactly. What is compared are pairs that share the key of a
    band of minima (see ``band_keys``) and whose sets' fingerprints differ in no more bits than
    those at ``similarity`` are expected to, with 2.33 standard deviations of room; the keys
    miss a pair at 0.8 with a chance of 0.4 %, nearer pairs with less. Null ids come last; of rows that repeat an id and text
    one stays. Texts without words are one group.
    """
    share = differing_share(similarity)
    radius = int(bits * share + 2.33 * math.sqrt(bits * share * (1 - share)))
    schema = T.StructType([*docs.schema, T.StructField("__print", T.BinaryType()), T.StructField("__bands", T.BinaryType())])

    def run(batches):
        for batch in batches:
            made = [set_fingerprint(t.encode() if t is not None else None, width, bits, seed) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            more = [pa.array([m[i] for m in made], pa.binary()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "__print", "__bands"])

    printed = cut_lineage(docs.mapInArrow(run, schema))
    distinct = cut_lineage(printed.groupBy(F.col("__print").alias("fingerprint")).agg(F.min(f"`{id_col}`").alias("__least"), F.any_value("__bands").alias("bands")))
    texts = printed.select(F.col("__print").alias("fingerprint"), F.col(f"`{text_col}`").alias("text"))
    groups = similar_groups(distinct, texts, radius, bits, width, similarity, seed)
    labelled = distinct.join(groups, "fingerprint", "left").withColumn("__group", F.coalesce("group", "fingerprint"))
    order = F.struct(F.col("__least").isNull().alias("none"), "__least", F.col("fingerprint").alias("__print"))
    chosen = labelled.groupBy("__group").agg(F.min(order).alias("c")).select("c.__print", "c.__least")
    kept = printed.join(chosen, "__print").filter(F.col(f"`{id_col}`").eqNullSafe(F.col("__least")))
    first = F.row_number().over(W.partitionBy("__print").orderBy(F.length(f"`{text_col}`"), f"`{text_col}`"))
    return kept.withColumn("__place", first).filter("__place = 1").select([F.col(f"`{c}`") for c in docs.columns])
