"""Packing of documents into training sequences of a fixed length, balanced by cost.

The cost of a sequence is estimated as its tokens plus a quadratic share for attention
within each of its pieces. Pieces are placed longest first, each in the sequence of the
lowest cost that still has room; what fits nowhere whole is cut over the room left, so a
block of sequences wastes less than one sequence. Blocks are filled as documents stream
through a task, so there is no shuffle and a task holds one block.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T
from tokenizers import Tokenizer

from lectern.llm.common import id_and_text, schema_of
from lectern.llm.tokens import RUNS, UNIT, VOCABULARY, byte_characters

#: Entries a task keeps of encoded words; beyond it, it starts anew. Results don't depend on it.
KEPT = 700_000
END = b"\0\0\0\0"


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes; what a task has encoded it looks up."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # For single words a second encoder over the same vocabulary, whose ids are its ranks; it has less overhead a call.
        to_byte = byte_characters()
        ranks = {bytes(map(to_byte.__getitem__, k)): v for k, v in self.tokenizer.get_vocab(False).items()}
        self.words = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.spaced: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if RUNS.search(text):
            return b"".join(self.known(self.units, UNIT.findall(text), ""))
        first, *rest = text.split(" ")
        return b"".join([*self.known(self.units, [first] if first else [], ""), *self.known(self.spaced, rest, " ")])

    def known(self, kept: dict[str, bytes], words: list[str], before: str):
        missing = [w for w in set(words) if w not in kept]
        if missing:
            if len(kept) + len(missing) > KEPT:
                kept.clear()
                missing = list(set(words))
            for w in missing:
                kept[w] = array("I", self.words(before + w)).tobytes()
        return map(kept.__getitem__, words)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def place(lengths: np.ndarray, capacity: int, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length) for documents of at most ``capacity``."""
    n = -(-int(lengths.sum()) // capacity)
    room, cost = np.full(n, capacity), np.zeros(n)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]

    def put(k: int, doc: int, start: int, size: int) -> None:
        out[k].append((doc, start, size))
        room[k] -= size
        cost[k] += size + quadratic * size * size

    left = []
    for doc in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[doc])
        open_cost = np.where(room >= size, cost, np.inf)
        k = int(open_cost.argmin())
        put(k, doc, 0, size) if room[k] >= size else left.append(doc)
    for doc in left:
        start, size = 0, int(lengths[doc])
        while start < size:
            k = int(np.where(room > 0, cost, np.inf).argmin())
            step = min(int(room[k]), size - start)
            put(k, doc, start, step)
            start += step
    return [s for s in out if s]


def pack(
    docs: DataFrame,
    capacity: int = 1024,
    block_sequences: int = 256,
    attention: float = 1.0,
    vocabulary: str = VOCABULARY,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: where it comes from, its sequence and its place there.

    A document is its ids and then id 0. Longer ones are cut in sequences of their own, and
    the rest is packed. ``attention`` weighs the quadratic cost: a piece of n tokens costs
    n + attention * n² / capacity. ``keep_ids`` adds the ids of the piece.

    Null and empty texts are the id 0 alone. Rows with null or repeated ids are packed as
    rows of their own. An empty table gives no rows; other columns are left out.
    """
    named = id_and_text(docs, id_col, text_col)
    whole = {n: T.LongType() for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    schema = schema_of(named, "doc_id", **whole, **({"ids": T.ArrayType(T.IntegerType())} if keep_ids else {}))

    def run(batches):
        encode = encoder(public_tokenizers.path(vocabulary))
        sequence = (TaskContext.get().partitionId() << 36) - 1
        kind, rows, pool, pooled = None, [], [], 0

        def emit(doc_id, start: int, raw: bytes, total: int, offset: int) -> None:
            rows.append((doc_id, start, len(raw) // 4, zlib.crc32(raw), total, sequence, offset, raw))

        def close() -> None:
            nonlocal sequence, pooled
            for pieces in place(np.array([len(p[2]) // 4 for p in pool]), capacity, attention / capacity) if pool else ():
                sequence, offset = sequence + 1, 0
                for doc, start, size in pieces:
                    doc_id, first, raw, total = pool[doc]
                    emit(doc_id, first + start, raw[4 * start : 4 * (start + size)], total, offset)
                    offset += size
            pool.clear()
            pooled = 0

        def flush():
            columns = [list(c) for c in zip(*rows)] or [[] for _ in range(8)]
            arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(r, dtype="<u4").astype(np.int32) for r in columns[7]], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = encode.ids(text or "") + END
                total = len(raw) // 4
                full = total - total % capacity
                for start in range(0, full, capacity):
                    sequence += 1
                    emit(doc_id, start, raw[4 * start : 4 * (start + capacity)], total, 0)
                if total > full:
                    pool.append((doc_id, full, raw[4 * full :], total))
                    pooled += total - full
                if pooled >= block_sequences * capacity:
                    close()
            yield flush()
        if kind is not None:
            close()
            yield flush()

    return named.mapInArrow(run, schema)
