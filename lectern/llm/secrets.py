"""Secrets in texts: fixed patterns, and strings that look random to character models.

Two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, are fitted on labelled samples. A long string is a secret if the ratio of its
likelihoods is large enough. One pass over the texts, no shuffle.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lectern.llm.common import id_and_text, schema_of

# The patterns that every scan reports, and the least length of each.
ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs of hex digits, the short ones dropped at once
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "random")

#: Strings the models judge; a shorter one holds too little to tell.
LEAST_STRING = 20
STRING = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_STRING)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODE = np.full(128, len(ALPHABET), dtype=np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
SIDE = len(ALPHABET) + 1
#: Runs of one character (rules, padding) in the ordinary model: their length, and one pair in so many.
RULE, RULES_SHARE = 40, 50


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, ordered by start and then by kind."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def pairs(strings: list[str]) -> np.ndarray:
    """Counts of neighbouring characters over all strings."""
    counts = np.zeros((SIDE, SIDE))
    for s in strings:
        codes = CODE[np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8) & 127]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return counts


def random_strings(n: int, seed: int) -> list[str]:
    """Labelled samples of random strings, in the alphabets that keys are written in."""
    draw = np.random.default_rng(seed)
    kinds = [ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef"]
    return ["".join(draw.choice(list(kinds[i % len(kinds)]), size=40)) for i in range(n)]


def log_transitions(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Log probabilities of the next character, smoothed towards how often each follows at all."""
    overall = counts.sum(0) + 1e-3 * counts.sum() / SIDE + 1e-3
    overall = overall / overall.sum()
    return np.log((counts + smoothing * overall) / (counts.sum(1, keepdims=True) + smoothing))


def identifiers(words: list[str]) -> list[str]:
    """The words as names are written: in capitals, capitalised, and joined in pairs by each separator and by case."""
    out = [w.upper() for w in words] + [w.capitalize() for w in words]
    for a, b in zip(words[::2], words[1::2]):
        out += [f"{a}_{b}", f"{a}-{b}", f"{a}/{b}", f"{a}={b}", f"{a.upper()}_{b.upper()}", a.capitalize() + b.capitalize()]
    return out


class MarkovRatio:
    """Log-likelihood ratio of a string under the two models."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, smoothing: float = 5.0):
        self.weights = log_transitions(random, smoothing) - log_transitions(ordinary, smoothing)

    def score(self, text: str) -> float:
        codes = CODE[np.frombuffer(text.encode("ascii"), dtype=np.uint8)]
        return float(self.weights[codes[:-1], codes[1:]].sum())


def fit(docs: DataFrame, sample_docs: int = 5_000, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> MarkovRatio:
    """Both models from labelled samples.

    Random: what the fixed patterns find in the sample, and as many drawn strings. Ordinary:
    the other strings of eight to 19 characters in the sample (a longer one is to be judged, so
    it teaches nothing), the identifiers that can be written with them, and runs of one
    character. The sample is about ``sample_docs``
    documents, chosen by a hash of the id; only 67 x 67 counts leave a task.
    """
    named = id_and_text(docs, id_col, text_col)
    n = named.count()
    share = min(1.0, sample_docs / n) if n else 1.0
    chosen = named.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    word = re.compile(r"[A-Za-z0-9+/_=-]{8,}")

    def count(batches):
        for batch in batches:
            random, ordinary = [], []  # both are labelled by where they stand
            for text in batch.column("text").to_pylist():
                at = 0
                spans = base_spans(text or "")
                for start, end, _ in spans:
                    random += STRING.findall(text[start:end])
                    ordinary += word.findall(text[at:start])
                    at = max(at, end)
                ordinary += word.findall((text or "")[at:])
            ordinary = [w for w in ordinary if len(w) < LEAST_STRING]
            ordinary += identifiers([w for w in ordinary if w.isalpha()])
            both = np.concatenate([pairs(random).ravel(), pairs(ordinary).ravel()])
            used = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(both[used])], ["cell", "n"])

    counted = chosen.mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(2 * SIDE * SIDE)
    for row in counted:
        cells[row["cell"]] = row["n"]
    random, ordinary = cells.reshape(2, SIDE, SIDE)
    drawn = pairs(random_strings(1_000, seed))
    runs = pairs([c * RULE for c in ALPHABET])
    ordinary = ordinary + runs * max(1.0, ordinary.sum() / (RULES_SHARE * runs.sum()))
    return MarkovRatio(random + drawn * max(1.0, random.sum() / drawn.sum()), ordinary)


def all_spans(text: str, model: MarkovRatio | None, least_ratio: float) -> tuple[list, list]:
    """The fixed patterns' spans, and these with the strings that the models find."""
    base = base_spans(text)
    added = []
    if model is not None:
        for m in STRING.finditer(text):
            start, end = m.span()
            within = any(s <= start and end <= e for s, e, _ in base)
            if not within and model.score(m[0]) >= least_ratio:
                added.append((start, end, "random"))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(
    docs: DataFrame, model: MarkovRatio | None, least_ratio: float = 20.0, redact: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: counts by kind, a digest of the fixed patterns' spans, and all spans.

    Offsets are code points, ends exclusive. A string is added if it has 20 or more
    characters and a log ratio of at least ``least_ratio``, whatever its characters, unless it
    lies within one span of a fixed pattern; where such a span covers a part of it, both are
    spans. ``redact`` adds ``redacted``, the text with each span replaced.

    Null texts count as empty: no spans, and ``redacted`` stays null. Rows with null or
    repeated ids give a row each. An empty table gives none; other columns are left out.
    """
    named = id_and_text(docs, id_col, text_col)
    extra: dict[str, T.DataType] = {k: T.LongType() for k in ("n_assign", "n_access", "n_hex")}
    extra |= {"base_sha256": T.StringType(), "spans": T.StringType()}
    if redact is not None:
        extra["redacted"] = T.StringType()
    schema = schema_of(named, "doc_id", **extra)

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in extra}
            for text in batch.column("text").to_pylist():
                base, spans = all_spans(text or "", model, least_ratio)
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
                if redact is not None:
                    out["redacted"].append(replaced(text, spans, redact))
            kinds = [pa.int64()] * 3 + [pa.string()] * (len(extra) - 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]], schema.names)

    return named.mapInArrow(run, schema)


def replaced(text: str | None, spans: list[tuple[int, int, str]], by: str) -> str | None:
    """The text with each maximal covered range replaced once."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: MarkovRatio | None, by: str, least_ratio: float = 20.0, text_col: str = "text") -> DataFrame:
    """All documents, every secret in their texts replaced; other columns as they are."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [replaced(t, all_spans(t or "", model, least_ratio)[1], by) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
