"""Periodic runs of words: stretches that repeat one period at least ``times`` times.

The dictionary of basic factors names, for every power of two m, the factors of m words at
each position so that equal factors have equal names (names of m come from pairs of names of
m/2). For each name, the next occurrence of a factor at a distance of up to twice m proposes
that distance as a period.

Of those proposals only distances d with m/2 < d <= m are followed, because they suffice: let
a run have smallest period q and length 3q or more, and let m be the least power of two with
m >= q. A factor of m words holds a whole period, so inside the run it comes again after q
words and not before (or the period were no smallest one). The positions whose next occurrence
is q away are therefore consecutive, from the run's start to the last position where m + q
words fit: an arithmetic progression, which gives both ends of the run. Conversely, a stretch
of such positions of length 4d or more has no smaller period. Each run is found once.

Names of repeated factors only go up to the next power, so plain text ends after a few.
No shuffle; a document is worked on whole in one task, as its text is one cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lectern.llm.common import id_and_text, schema_of

#: Short documents are worked on together, up to so many words.
WORDS_AT_ONCE = 200_000
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def runs_of(words: np.ndarray, ends: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs in ``words``, by start and then period.

    ``words`` are numbers that are equal for equal words of one document and differ between
    documents; ``ends`` is, for each position, the position after its document's last word.
    """
    found = []
    at, names, m = np.arange(len(words)), words, 1
    longest = int(np.diff(np.unique(ends), prepend=0).max()) if len(words) else 0
    while len(at) > 1 and (m == 1 or 2 * m <= longest):
        order = np.argsort(names, kind="stable")
        ranked = names[order]
        again = ranked[1:] == ranked[:-1]
        here, distance = at[order[:-1][again]], at[order[1:][again]] - at[order[:-1][again]]
        proposed = (2 * distance > m) & (distance <= m)
        found.append(stretches(here[proposed], distance[proposed], m))
        # names of the next power: pairs of repeated names
        group = np.concatenate([[0], np.cumsum(~again)])
        repeated = np.zeros(len(at), dtype=bool)
        repeated[1:] |= again
        repeated[:-1] |= again
        name_at = np.full(len(words) + 1, -1, dtype=np.int64)
        name_at[at[order[repeated]]] = group[repeated]
        at = np.sort(at[order[repeated]])
        at = at[at + 2 * m <= ends[at]]
        second = name_at[at + m]
        at, second = at[second >= 0], second[second >= 0]
        names, m = name_at[at] * (int(group[-1]) + 1) + second, 2 * m
    start, length, period = (np.concatenate([f[i] for f in found]) if found else np.empty(0, dtype=np.int64) for i in range(3))
    enough = length >= np.maximum(least, times * period)
    start, length, period = start[enough], length[enough], period[enough]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def stretches(here: np.ndarray, distance: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the stretches that consecutive positions of one distance span."""
    order = np.argsort(here, kind="stable")
    here, distance = here[order], distance[order]
    first = np.ones(len(here), dtype=bool)
    first[1:] = (np.diff(here) != 1) | (np.diff(distance) != 0)
    begins = np.flatnonzero(first)
    lasts = np.append(begins[1:], len(here)) - 1 if len(here) else begins
    return here[begins], here[lasts] - here[begins] + m + distance[begins], distance[begins]


def collapse(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not len(start):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    keep = np.cumsum(change[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def _grouped(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of documents, several short ones at a time, with the number of the first one."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        words = (text or "").encode().split()  # white space of bytes is that of ASCII
        if held and size + len(words) > WORDS_AT_ONCE:
            yield first, held
            held, size, first = [], 0, i
        held.append(words)
        size += len(words)
    if held:
        yield first, held


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row.

    Words are what ASCII white space parts. A run is a longest stretch of words with smallest
    period q and at least ``max(least, times * q)`` words (``times`` of 3 or more); ``runs`` has
    ``(start, length, period)`` by start and period, words numbered from 0. ``collapsed`` is the
    text without what a run holds after its first period, its words joined by single spaces.
    A null text is an empty one, and has no words and no runs. Null and repeated ids are rows like
    others, an empty table gives no rows, and other columns are not looked at.
    """
    if times < 3:
        raise ValueError("runs of under three periods are not found by these proposals")
    texts = id_and_text(docs, id_col, text_col)
    schema = schema_of(texts, "doc_id", n_words=T.LongType(), runs=T.ArrayType(RUN), collapsed=T.StringType())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, docs_words in _grouped(batch.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(docs_words)), *_found(docs_words, least, times)], names=schema.names)

    return texts.mapInArrow(find, schema)


def _found(docs_words: list[list[bytes]], least: int, times: int) -> list[pa.Array]:
    sizes = np.array([len(w) for w in docs_words], dtype=np.int64)
    ends = np.cumsum(sizes)
    flat = pa.array([w for words in docs_words for w in words], type=pa.large_binary()).dictionary_encode()
    numbers = flat.indices.to_numpy().astype(np.int64) + np.repeat(np.arange(len(sizes)) * max(1, len(flat.dictionary)), sizes)
    start, length, period = runs_of(numbers, np.repeat(ends, sizes), least, times)
    of = np.searchsorted(ends, start, side="right")
    cuts = np.searchsorted(of, np.arange(len(sizes) + 1))
    start = start - (ends - sizes)[of]
    left = [collapse(w, start[a:b], length[a:b], period[a:b]) for w, a, b in zip(docs_words, cuts[:-1], cuts[1:])]
    structs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    return [pa.array(sizes), pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), structs), pa.array([t.decode() for t in left], type=pa.string())]


def longest_in_periods(runs: str) -> Column:
    """The run of the greatest length over period, the first of equals; null where there is none."""
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(kind), lambda best, r: F.when(better(best, r), r).otherwise(best))
