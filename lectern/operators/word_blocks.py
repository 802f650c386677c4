"""Bigram scores and lexical columns of words that stay beside their text.

The texts are dealt into parts of bounded size. A part counts its forms and pairs in sorted
order and sends each of them once, in blocks: one block holds those of a part that meet in one
target. The numbers come back in the order of the block, so neither words nor keys travel back,
and a part finds each word's numbers by its place among its own sorted forms and pairs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lectern.operators import lexicon, surprisal
from lectern.session import cut_lineage

#: Characters of text in a part, about; a task holds one part's words, or the pairs that meet in one target, at once.
PART = 8_000_000
#: A corpus of fewer characters is small enough to join its words with its pairs.
SMALL = 8_000_000

PAIR, FORM = 0, 1
_MET = "kind int, part int, target int, data binary, form string, tokens long, n long, k long, s double"
_BLOCK = "kind int, part int, target int, data binary"
_SCORED = "text_id string, p int, pieces array<array<string>>, scores array<array<struct<frequency:long,rank:long,surprisal:double,entropy:double>>>"


def parts_of(texts: DataFrame, text: str = "text") -> int:
    """How many parts the texts are dealt into: none for a small corpus, a few a core at least for others."""
    size = texts.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return 0 if size < SMALL else max(math.ceil(size / PART), 3 * texts.sparkSession.sparkContext.defaultParallelism)


class _Part:
    """The words of one part: forms in sorted order, words and pairs as numbers of forms."""

    def __init__(self, pieces: pa.ChunkedArray, parts: int):
        lines = pa.concat_arrays(pieces.chunks) if pieces.num_chunks else pa.array([], pieces.type)
        sentences = lines.flatten()
        self.per_line = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
        self.per_sentence = pc.list_value_length(sentences).to_numpy(zero_copy_only=False)
        coded = sentences.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        self.forms = coded.dictionary.take(pa.array(order))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.words = number[coded.indices.to_numpy()]
        self.follows = np.ones(len(self.words), bool)
        starts = np.cumsum(self.per_sentence) - self.per_sentence
        self.follows[starts[self.per_sentence > 0]] = False
        at = np.flatnonzero(self.follows)
        codes = self.words[at - 1] * len(order) + self.words[at]
        codes, self.pair_of, self.pair_counts = np.unique(codes, return_inverse=True, return_counts=True)
        self.before, self.after = np.divmod(codes, max(len(order), 1))
        digest = pd.util.hash_array(self.forms.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(order) else np.empty(0, np.uint64)
        mixed = (digest[self.before] ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) + digest[self.after]
        self.targets = {FORM: (digest % np.uint64(parts)).astype(np.int64), PAIR: ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(parts)).astype(np.int64)}

    def blocks(self, kind: int) -> Iterator[tuple[int, np.ndarray]]:
        """The forms or pairs that meet in each target, in their order."""
        targets = self.targets[kind]
        order = np.argsort(targets, kind="stable")
        held, starts = np.unique(targets[order], return_index=True)
        return zip(held.tolist(), np.split(order, starts[1:]))


def _packed(*columns: np.ndarray | pa.Array) -> bytes:
    """Columns of equal length, numbers of 8 bytes or tokens, which hold no blank."""
    raw = [c.astype("<f8" if c.dtype.kind == "f" else "<i8").tobytes() if isinstance(c, np.ndarray) else " ".join(c.to_pylist()).encode() for c in columns]
    sizes = np.array([len(r) for r in raw], "<i8").tobytes()
    return zlib.compress(b"".join([sizes, *raw]), 1)


def _unpacked(data: bytes, kinds: str) -> list:
    """Columns of ``_packed`` by kind: ``i`` and ``f`` numbers, ``s`` tokens."""
    raw = zlib.decompress(data)
    at, out = 8 * len(kinds), []
    for kind, size in zip(kinds, np.frombuffer(raw, "<i8", len(kinds)).tolist()):
        cell = raw[at : at + size]
        out.append(pa.array(cell.decode().split(" "), pa.string()) if kind == "s" else np.frombuffer(cell, f"<{kind}8"))
        at += size
    return out


def _table(schema: pa.Schema, **columns) -> pa.Table:
    """A table whose missing columns are null."""
    size = len(next(iter(columns.values())))
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


_MET_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("target", pa.int32()), ("data", pa.binary()), ("form", pa.string()), ("tokens", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("s", pa.float64())])
_BLOCK_ARROW = pa.schema(list(_MET_ARROW)[:4])


def _send(parts: int):
    def run(key: tuple, lines: pa.Table) -> pa.Table:
        held = _Part(lines["pieces"], parts)
        counts = np.bincount(held.words, minlength=len(held.forms))
        rows = [(FORM, t, _packed(held.forms.take(pa.array(at)), counts[at])) for t, at in held.blocks(FORM)]
        for t, at in held.blocks(PAIR):
            rows.append((PAIR, t, _packed(held.forms.take(pa.array(held.before[at])), held.forms.take(pa.array(held.after[at])), held.pair_counts[at])))
        kinds, targets, data = zip(*rows) if rows else ((), (), ())
        return _table(_BLOCK_ARROW, kind=kinds, part=[key[0].as_py()] * len(rows), target=targets, data=data)

    return run


def _numbered(columns: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    coded = pa.concat_arrays(columns).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _meet(alpha: float):
    """In a target: the corpus counts of each block's pairs, the sums by word before, and the tokens of each form."""

    def run(key: tuple, blocks: pa.Table) -> pa.Table:
        target, out = key[0].as_py(), [_MET_ARROW.empty_table()]
        kinds = blocks["kind"].to_numpy()
        parts, data = blocks["part"].to_pylist(), blocks["data"]
        at = np.flatnonzero(kinds == FORM).tolist()
        if at:
            found = [_unpacked(data[i].as_py(), "si") for i in at]
            forms, number = _numbered([f[0] for f in found])
            tokens = np.zeros(len(forms), np.int64)
            np.add.at(tokens, number, np.concatenate([f[1] for f in found]))
            out.append(_table(_MET_ARROW, kind=[FORM] * len(at), part=[parts[i] for i in at], target=[target] * len(at), data=[_packed(f[0]) for f in found]))
            out.append(_table(_MET_ARROW, target=[target] * len(forms), form=forms, tokens=tokens))
        at = np.flatnonzero(kinds == PAIR).tolist()
        if at:
            found = [_unpacked(data[i].as_py(), "ssi") for i in at]
            heads, before = _numbered([f[0] for f in found])
            tails, after = _numbered([f[1] for f in found])
            pairs, which = np.unique(before * len(tails) + after, return_inverse=True)
            counts = np.zeros(len(pairs), np.int64)
            np.add.at(counts, which, np.concatenate([f[2] for f in found]))
            ends = np.cumsum([len(f[2]) for f in found])
            back = [_packed(c) for c in np.split(counts[which], ends[:-1])]
            out.append(_table(_MET_ARROW, kind=[PAIR] * len(at), part=[parts[i] for i in at], target=[target] * len(at), data=back))
            head = pairs // len(tails)
            n, smoothed = np.zeros(len(heads), np.int64), counts + alpha
            np.add.at(n, head, counts)
            sums = np.bincount(head, smoothed * np.log(smoothed), len(heads))
            out.append(_table(_MET_ARROW, form=heads, tokens=np.zeros(len(heads), np.int64), n=n, k=np.bincount(head, minlength=len(heads)), s=sums))
        return pa.concat_tables(out)

    return run


def _answer(key: tuple, blocks: pa.Table, forms: pa.Table) -> pa.Table:
    """The numbers of the forms of each block, in its order."""
    names = pa.concat_arrays(forms["form"].chunks) if forms.num_rows else pa.array([], pa.string())
    numbers = [pc.fill_null(forms[c], -1).to_numpy() for c in ("frequency", "rank")] + [pc.fill_null(forms[c], math.nan).to_numpy() for c in ("mass", "entropy")]
    asked = [_unpacked(cell.as_py(), "s")[0] for cell in blocks["data"]]
    at = pc.index_in(pa.concat_arrays(asked), names).to_numpy() if asked else np.empty(0, np.int64)
    data = [_packed(*[x[i] for x in numbers]) for i in np.split(at, np.cumsum([len(a) for a in asked])[:-1])] if asked else []
    return pa.table([blocks["kind"], blocks["part"], blocks["target"], pa.array(data, pa.binary())], schema=_BLOCK_ARROW)


def _attach(parts: int, alpha: float):
    def run(key: tuple, lines: pa.Table, blocks: pa.Table) -> pa.Table:
        held = _Part(lines["pieces"], parts)
        data = {(k, t): d for k, t, d in zip(blocks["kind"].to_pylist(), blocks["target"].to_pylist(), blocks["data"].to_pylist())}
        frequency, rank = np.empty(len(held.forms), np.int64), np.empty(len(held.forms), np.int64)
        mass, entropy = np.empty(len(held.forms)), np.empty(len(held.forms))
        for t, at in held.blocks(FORM):
            frequency[at], rank[at], mass[at], entropy[at] = _unpacked(data[FORM, t], "iiff")
        counts = np.empty(len(held.before), np.int64)
        for t, at in held.blocks(PAIR):
            (counts[at],) = _unpacked(data[PAIR, t], "i")
        scores = np.log(mass[held.before]) - np.log(counts + alpha)
        scored, spread = np.zeros(len(held.words)), np.zeros(len(held.words))
        scored[held.follows] = scores[held.pair_of]
        spread[held.follows] = entropy[held.before][held.pair_of]
        bare, first = frequency[held.words] < 0, ~held.follows
        numbers = [pa.array(frequency[held.words], mask=bare), pa.array(rank[held.words], mask=bare), pa.array(scored, mask=first), pa.array(spread, mask=first)]
        of_words = pa.StructArray.from_arrays(numbers, ["frequency", "rank", "surprisal", "entropy"])
        nested = of_words
        for sizes in (held.per_sentence, held.per_line):
            nested = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), nested)
        return pa.table({"text_id": lines["text_id"], "p": lines["p"], "pieces": lines["pieces"], "scores": nested})

    return run


def scored_lines(texts: DataFrame, parts: int, text_id: str = "doc_id", text: str = "text", alpha: float = surprisal.ALPHA) -> DataFrame:
    """The lines of the texts as ``text_id, p, pieces`` with ``scores`` of every word of their pieces.

    A word that starts a sentence has no surprisal or entropy; a form without a letter or digit no frequency or rank.
    """
    from lectern.plans.corpus import split_lines

    part = F.pmod(F.xxhash64(text_id), F.lit(parts)).cast("int")
    dealt = texts.select(part.alias("part"), text_id, text).repartitionById(parts, F.col("part"))
    lines = split_lines(dealt, text_id, text, "part")
    sent = lines.groupBy("part").applyInArrow(_send(parts), _BLOCK)
    met = cut_lineage(sent.repartitionById(parts, F.col("target")).groupBy("target").applyInArrow(_meet(alpha), _MET))
    sums = [F.sum(c).alias(c) for c in ("tokens", "n", "k", "s")]
    forms = cut_lineage(met.where(F.col("kind").isNull()).groupBy("form").agg(F.max("target").alias("target"), *sums))
    named = forms.withColumn("lowercase_form", lexicon.lowercase_form("form"))
    lexical = lexicon.frequencies(named.where(F.col("lowercase_form").isNotNull()))
    known = named.join(lexical, "lowercase_form", "left")
    counted = known.select("target", "form", F.col("corpus_frequency").alias("frequency"), F.col("frequency_rank").alias("rank"), *surprisal.context_scores(forms, alpha))
    blocks = met.where(F.col("kind").isNotNull()).select("kind", "part", "target", "data")
    asked = blocks.where(F.col("kind") == FORM).repartitionById(parts, F.col("target")).groupBy("target")
    answered = asked.cogroup(counted.repartitionById(parts, F.col("target")).groupBy("target")).applyInArrow(_answer, _BLOCK)
    pairs = blocks.where(F.col("kind") == PAIR)
    numbers = cut_lineage(answered).unionByName(pairs).repartitionById(parts, F.col("part"))
    return lines.groupBy("part").cogroup(numbers.groupBy("part")).applyInArrow(_attach(parts, alpha), _SCORED)
