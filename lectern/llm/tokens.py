"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

Byte-pair encoding has a local structure: a sequence of tokens is the encoding of its
bytes exactly if every two neighbours are the encoding of theirs. So each prefix of a
piece has one last token, found from the last tokens of shorter prefixes, and one pass
over a piece gives the token count of all its prefixes. Pieces are the matches of the
tokenizer's own splitting pattern; how a cut text splits differs from the whole only in
its last piece, and there only within white space and contractions.

A text is handled in units (white space and what follows up to the next white space).
No piece crosses the start of a run of white space, so counts of units add up.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, types as T

from lectern.llm.common import id_and_text, schema_of

VOCABULARY = "byte_bpe_50k.json"
#: Entries a task keeps of what it has worked out; beyond it, it starts anew. Results don't depend on it.
KEPT = 700_000
#: Stands for the token before the first.
START = (1 << 20) - 1
LONG_CONTRACTIONS = {"'re", "'ve", "'ll"}

#: White space before a space: such a text is cut at the starts of its runs, others at every space.
RUNS = re.compile(r"\s ")
UNIT = regex.compile(r"\s*\S+|\s+")
SPACE = regex.compile(r"\s")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies, by their public rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Token counts of every prefix, for one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        raw, to_byte = model["model"], byte_characters()
        self.special = [t["content"] for t in model.get("added_tokens", [])]
        vocab = {bytes(map(to_byte.__getitem__, k)): v for k, v in raw["vocab"].items() if k not in self.special}
        self.token_bytes = {v: k for k, v in vocab.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(raw["merges"]):
            a, b = (bytes(map(to_byte.__getitem__, x)) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            if a in vocab and b in vocab and a + b in vocab:
                self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.single = [vocab.get(bytes([b])) for b in range(256)]
        self.vocab = vocab
        self.longest = max(map(len, vocab))
        self.fit: dict[int, bool] = {}  # by pairs of tokens
        self.spaced: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def merged(self, raw: bytes) -> list[int]:
        """Encoding by merges in the order of their rank; only for pairs of tokens, so short."""
        ids = [self.single[b] for b in raw]
        while len(ids) > 1:
            ranked = [(self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
            if not ranked:
                break
            i = min(ranked)[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def fits(self, a: int, b: int) -> bool:
        """Whether token ``b`` follows ``a``, or starts a piece, in the encoding of their bytes."""
        start = a == START
        ids = [b] if start else [a, b]
        known = self.fit[a << 20 | b] = self.merged(b"".join(self.token_bytes[x] for x in ids)) == ids
        return known

    def piece(self, text: str) -> list[int]:
        """Token counts after each character of one piece."""
        raw, get, fit = text.encode("utf-8", "surrogatepass"), self.vocab.get, self.fit.get
        last, counts, began = [START], [0], 0
        for i in range(1, len(raw) + 1):
            # One last token fits. Tried first: the last token grown by a byte, then the shortest.
            j = began
            size = 0
            while True:
                token = get(raw[j:i])
                if token is not None:
                    ok = fit(last[j] << 20 | token)
                    if self.fits(last[j], token) if ok is None else ok:
                        break
                size += 1
                j = i - size
            last.append(token)
            counts.append(counts[j] + 1)
            began = j
        if len(raw) == len(text):
            return counts[1:]
        return [counts[i] for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]

    def prefixes(self, text: str) -> list[int]:
        """Token counts after each character of a text without special tokens."""
        if text[1:].isalpha() and text[0] == " ":  # one piece
            return self.piece(text)
        out: list[int] = []
        base, instead = 0, None
        for match in self.pattern.finditer(text):
            piece, end = match[0], match.end()
            counts = self.piece(piece)
            if piece in LONG_CONTRACTIONS:  # cut after two characters, these are two pieces
                counts = [counts[0], counts[0] + self.piece(piece[1])[0], counts[2]]
            at = len(out)
            out.extend([base + c for c in counts] if base else counts)
            if instead is not None:
                out[at], instead = instead, None
            if end < len(text) and SPACE.match(piece) and SPACE.match(text, end) and SPACE.match(piece[-1]):
                # A text cut in a run of white space has the whole run as its last piece.
                instead = base + self.piece(piece + text[end])[-1]
            base += counts[-1]
        return out

    def steps_of(self, text: str) -> bytes:
        """The change of the count with each character, a signed byte each."""
        return signed_steps(self.prefixes(text))

    def steps(self, text: str) -> bytes:
        """The same for any text: special tokens within it count as one token, as is the default."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self.plain(text)
        out, at = [], 0
        for match in self.special_pattern.finditer(text):
            before, name = text[at : match.start()], match[0]
            counts = self.prefixes(before + name)
            total = counts[len(before) - 1] if before else 0
            counts[-1] = total + 1
            out.append(signed_steps(counts))
            at = match.end()
        return b"".join([*out, self.plain(text[at:])])

    def plain(self, text: str) -> bytes:
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
                kept[w] = self.steps_of(before + w)
        return map(kept.__getitem__, words)


def signed_steps(counts: list[int]) -> bytes:
    return array("b", [b - a for a, b in zip([0, *counts], counts)]).tobytes()


def counts_from_steps(steps: bytes) -> np.ndarray:
    """Token counts after 0, 1, 2, ... characters."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, dtype=np.int8), dtype=np.int64)])


def longest_within(steps: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    return int(np.flatnonzero(counts_from_steps(steps) <= budget)[-1])


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_index(
    docs: DataFrame, limit: int = 1024, vocabulary: str = VOCABULARY, keep_index: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: bytes, tokens, whether over ``limit``, and the characters that fit in it.

    ``keep_index`` adds ``steps``: one signed byte a character, the change of the token
    count. It answers every question on prefixes without encoding again (see
    ``counts_from_steps`` and ``longest_within``). No shuffle; a task holds one batch.

    Null texts count as empty: 0 bytes, 0 tokens. Rows with null or repeated ids each give
    a row. Other columns of ``docs`` are left out. An empty table gives an empty result.
    """
    named = id_and_text(docs, id_col, text_col)
    extra = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType(), "fit_chars": T.LongType()}
    if keep_index:
        extra["steps"] = T.BinaryType()
    schema = schema_of(named, "doc_id", **extra)

    def run(batches):
        count = counter(public_tokenizers.path(vocabulary))
        for batch in batches:
            out: dict[str, list] = {k: [] for k in extra}
            for text in batch.column("text").to_pylist():
                text = text or ""
                steps = count.steps(text)
                total = int(np.frombuffer(steps, dtype=np.int8).sum(dtype=np.int64))
                out["n_bytes"].append(len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass")))
                out["n_tokens"].append(total)
                out["over_limit"].append(total > limit)
                out["fit_chars"].append(longest_within(steps, limit) if total > limit else len(text))
                if keep_index:
                    out["steps"].append(steps)
            kinds = {"over_limit": pa.bool_(), "steps": pa.binary()}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]], ["doc_id", *out]
            )

    return named.mapInArrow(run, schema)
