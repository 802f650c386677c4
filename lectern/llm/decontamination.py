"""Benchmark items inside documents: MinHash containment search, then exact shingles.

A short item in a long document has a small Jaccard similarity with it, which MinHash cannot
find. So items are partitioned by size, and a document is seen through windows of twice a
partition's size at half overlap: one of them holds the item whole, and against it the
similarity is large. The windows run over those shingles only that some item has (a filter
tells), so the text around an item and between its parts does not dilute them. A window's
minimum under one hash function equals the item's if the least shingle is shared; with 64
functions an item of which 0.8 is there is missed about once in 10^12, unless most of its
window belongs to other items.

An item that repeats itself belongs to every class from its distinct shingles to its length.
One of fewer than four distinct shingles is searched by the shingles themselves. Candidates
are then verified by the exact containment of the item's shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lectern.session import cut_lineage

FUNCTIONS = 64
SMALLEST = 4
#: Items of fewer distinct shingles are their own keys.
FEW = 4
#: Filters of items' keys and shingles have this many bits (2 MB), whatever the benchmark's size.
FILTER_BITS = 1 << 24
SALTS = 16

_draw = np.random.default_rng(5)
FACTORS = _draw.integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _draw.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * STEP
    return x ^ (x >> np.uint64(29))


def words_of(raw: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (raw or b"").lower().split()


def shingle_keys(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of each shingle; fewer words than ``width`` are one shingle."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = out * MIX + h[k : k + len(out)]
    return mixed(out)


def shingle_at(words: list[bytes], i: int, width: int) -> bytes:
    return b" ".join(words[i : i + width])


def classes_up_to(size: int) -> list[int]:
    out = [SMALLEST]
    while out[-1] < size:
        out.append(2 * out[-1])
    return out


def keyed(minima: np.ndarray, size: int) -> np.ndarray:
    """Keys of minima (windows x functions) that also hold the function and the size class."""
    tags = (np.arange(FUNCTIONS, dtype=np.uint64) + np.uint64(FUNCTIONS * size.bit_length())) * MIX
    return mixed(minima ^ tags)


def own_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of single shingles, apart from those of minima."""
    return mixed(np.unique(hashes) ^ MIX)


def window_keys(hashes: np.ndarray, classes: list[int]) -> list[np.ndarray]:
    """For each size class the keys of all windows of twice its size, a row a window."""
    out = []
    if not classes:
        return out
    starts = np.arange(0, len(hashes), SMALLEST)
    blocks = np.empty((len(starts), FUNCTIONS), dtype=np.uint64)
    for f in range(FUNCTIONS):
        blocks[:, f] = np.minimum.reduceat(hashes * FACTORS[f] + OFFSETS[f], starts)
    size = SMALLEST
    while size <= classes[-1]:
        if size in classes:
            out.append(keyed(np.minimum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks, size))
        if len(blocks) > 1:
            if len(blocks) % 2:
                blocks = np.concatenate([blocks, blocks[-1:]])
            blocks = np.minimum(blocks[0::2], blocks[1::2])
        size *= 2
    return out


def add_to(bits: np.ndarray, keys: np.ndarray) -> None:
    at = keys & np.uint64(FILTER_BITS - 1)
    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


def held(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(FILTER_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def item_tables(items: DataFrame, width: int, item_id: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Search keys and distinct shingles of the items, stored; ``item_key`` names an item, a null id too."""
    named = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text_col}`").cast("binary").alias("text")).dropDuplicates()
    named = named.withColumn("item_key", F.to_json(F.struct("item_id")))
    kind = named.schema["item_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, names, keys, shingles, sizes = [], [], [], [], []
            for item, name, raw in zip(*[batch.column(c).to_pylist() for c in ("item_id", "item_key", "text")]):
                words = words_of(raw)
                hashes = shingle_keys(words, width)
                if not len(hashes):
                    continue
                distinct = np.unique(hashes)
                ids.append(item)
                names.append(name)
                if len(distinct) < FEW:
                    sizes.append([])
                    keys.append(own_keys(distinct).view(np.int64))
                else:
                    minima = np.array([[(distinct * FACTORS[f] + OFFSETS[f]).min() for f in range(FUNCTIONS)]], dtype=np.uint64)
                    own = [c for c in classes_up_to(len(hashes)) if c >= len(distinct)]
                    sizes.append(own)
                    keys.append(np.concatenate([keyed(minima, c)[0] for c in own]).view(np.int64))
                shingles.append(sorted({shingle_at(words, i, width) for i in range(len(hashes))}))
            arrays = [pa.array(ids, batch.column("item_id").type), pa.array(names, pa.string()), pa.array(sizes, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64())), pa.array(shingles, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(arrays, ["item_id", "item_key", "sizes", "keys", "shingles"])

    made = cut_lineage(named.mapInArrow(run, f"item_id {kind}, item_key string, sizes array<int>, keys array<long>, shingles array<binary>"))
    return made, made.select("item_id", "item_key", F.size("shingles").cast("long").alias("n_shingles"), F.explode("shingles").alias("shingle"))


def item_filters(made: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Filters of fixed size over the items' keys and shingles, and the size classes in use."""

    def run(batches):
        keys, shingles, sizes = np.zeros(FILTER_BITS // 8, np.uint8), np.zeros(FILTER_BITS // 8, np.uint8), set()
        for batch in batches:
            sizes |= set(batch.column("sizes").flatten().to_pylist())
            add_to(keys, batch.column("keys").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            for each in batch.column("shingles").to_pylist():
                for s in each:
                    add_to(shingles, shingle_keys(s.split(), width))
        yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()]), pa.array([shingles.tobytes()]), pa.array([sorted(sizes)], pa.list_(pa.int32()))], ["keys", "shingles", "sizes"])

    parts = made.coalesce(8).mapInArrow(run, "keys binary, shingles binary, sizes array<int>").collect()
    both = [np.zeros(FILTER_BITS // 8, np.uint8) for _ in range(2)]
    for p in parts:
        for bits, raw in zip(both, (p["keys"], p["shingles"])):
            bits |= np.frombuffer(raw, np.uint8)
    return both[0], both[1], sorted({s for p in parts for s in p["sizes"]})


def text_key(text_col: str) -> Column:
    """A digest that equal texts share."""
    return F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"))


def leaked_texts(docs: DataFrame, items: DataFrame, width: int = 5, least: float = 0.8, item_id: str = "item_id", text_col: str = "text", item_text: str = "text") -> DataFrame:
    """``text_key, item_id, n_common, n_shingles, containment`` for distinct texts of ``docs``."""
    made, shingles = item_tables(items, width, item_id, item_text)
    key_bits, shingle_bits, classes = item_filters(made, width)
    named = docs.select(text_key(text_col).alias("text_key"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    context = docs.sparkSession.sparkContext
    filters = context.broadcast((key_bits, shingle_bits))

    def run(batches):
        keys_of, shingles_of = filters.value
        for batch in batches:
            names, found_keys, found_shingles = [], [], []
            for name, raw in zip(batch.column("text_key").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(raw)
                hashes = shingle_keys(words, width)
                at = np.flatnonzero(held(shingles_of, hashes))
                if not len(at):
                    continue
                hits = [k[held(keys_of, k)] for k in [own_keys(hashes[at]), *window_keys(hashes[at], classes)]]
                hits = np.unique(np.concatenate(hits))
                if len(hits):
                    names.append(name)
                    found_keys.append(hits.view(np.int64))
                    found_shingles.append(list({shingle_at(words, int(i), width) for i in at}))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found_keys, pa.list_(pa.int64())), pa.array(found_shingles, pa.list_(pa.binary()))], ["text_key", "keys", "shingles"])

    hits = cut_lineage(named.mapInArrow(run, "text_key string, keys array<long>, shingles array<binary>").dropDuplicates(["text_key"]))
    # A key or shingle can be in a third of all texts: its rows are dealt over salts.
    salt = F.pmod(F.xxhash64("text_key"), F.lit(SALTS)).cast("int").alias("salt")
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    item_keys = made.select("item_key", F.explode("keys").alias("key")).distinct().select("item_key", "key", salted)
    pairs = hits.select("text_key", salt, F.explode("keys").alias("key")).join(item_keys, ["key", "salt"]).select("text_key", "item_key").distinct()
    items_of = shingles.select("item_id", "item_key", "n_shingles", "shingle", salted)
    own = pairs.join(hits.select("text_key", "shingles"), "text_key").select("text_key", "item_key", salt, F.explode("shingles").alias("shingle"))
    common = own.join(items_of, ["item_key", "shingle", "salt"]).groupBy("text_key", "item_key", "item_id", "n_shingles").agg(F.count(F.lit(1)).alias("n_common"))
    held_share = common.withColumn("containment", F.col("n_common") / F.col("n_shingles")).filter(F.col("containment") >= least)
    return held_share.select("text_key", "item_id", "n_common", "n_shingles", "containment")


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, least: float = 0.8, id_col: str = "doc_id", item_id: str = "item_id", text_col: str = "text", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_common, n_shingles, containment`` of every item found in a document.

    Words stand between ASCII white space, A-Z lower-cased; an item is in a document that has
    at least ``least`` of its distinct shingles of ``width`` words (fewer words: one shingle
    of all). Null and empty texts have no shingles and match nothing. Rows that repeat an id
    and text give one row; null ids of documents and of items are kept. Empty tables give no rows. Other columns are
    left out.
    """
    leaks = cut_lineage(leaked_texts(docs, items, width, least, item_id, text_col, item_text))
    ids = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_key(text_col).alias("text_key"))
    return ids.join(leaks, "text_key").drop("text_key").distinct()


def without_leaks(docs: DataFrame, items: DataFrame, width: int = 5, least: float = 0.8, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    leaks = cut_lineage(leaked_texts(docs, items, width, least, "item_id", text_col, item_text).select("text_key").distinct())
    keyed_docs = docs.withColumn("__text_key", text_key(text_col))
    return keyed_docs.join(leaks.withColumnRenamed("text_key", "__text_key"), "__text_key", "left_anti").select(docs.columns)
