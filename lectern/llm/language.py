"""Language of texts, word by word, by a linear-chain conditional random field.

A word's features are its prefixes, suffixes, character n-grams and itself (the lexicon);
transitions between languages are learned with them, so a text may switch. Forward-backward
gives each word's distribution, and a text's is their mean. The chain is worked out for many
texts at once: runs of words are multiplied into transfer matrices side by side, a short scan
over the runs of a text links them, and a pass within runs gives every word's distribution.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from lectern.llm.common import id_and_text, id_crc, schema_of

#: A word of the chain: at most so many letters. A longer run of letters (a script without
#: spaces, say) is several words in a row, so that each part counts and the language may switch.
WORD = re.compile(r"[^\W\d_]{1,24}")
BUCKETS = 1 << 15
RUN = 32
TRAIN_LENGTH = 64
KEPT = 500_000
BATCH_WORDS = 150_000


@lru_cache(maxsize=200_000)
def features(w: str) -> tuple[int, ...]:
    """Hashed features of a lower-cased word."""
    raw = [f"w{w}", *[f"p{w[:k]}" for k in (1, 2, 3)], *[f"s{w[-k:]}" for k in (1, 2, 3)]]
    raw += [f"n{w[i:i + k]}" for k in (2, 3) for i in range(len(w) - k + 1)]
    return tuple({xxhash.xxh32_intdigest(f) % BUCKETS for f in raw})


@dataclass
class Field:
    languages: list[str]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # languages x languages, logarithms


def chain(unary: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward vectors of equally long sequences, and the logarithms of their scales."""
    n, length, k = unary.shape
    forward, backward, scale = np.empty_like(unary), np.empty_like(unary), np.empty((n, length))
    state = np.full((n, k), 1.0 / k)
    for t in range(length):
        state = (state @ transition) * unary[:, t]
        scale[:, t] = state.sum(1)
        state = state / scale[:, t, None]
        forward[:, t] = state
    state = np.ones((n, k))
    for t in range(length - 1, -1, -1):
        backward[:, t] = state
        state = (state * unary[:, t]) @ transition.T / scale[:, t, None]
    return forward, backward, scale


def train(sequences: list[list[str]], labels: np.ndarray, languages: list[str], steps: int = 60, ridge: float = 0.5) -> Field:
    """Penalised likelihood by Adam over all sequences; ``labels`` has the language of every word."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s}))}
    parts = [features(w) for w in vocabulary]
    flat = np.concatenate([np.array(p) for p in parts])
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    words = np.array([[vocabulary[w] for w in s] for s in sequences])
    k, n = len(languages), words.size
    truth = np.eye(k)[labels]
    follows = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
    theta, trans = np.zeros((BUCKETS, k)), np.zeros((k, k))
    state = [np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(trans), np.zeros_like(trans)]
    observed = np.stack([np.bincount(words.ravel(), truth[..., j].ravel(), len(vocabulary)) for j in range(k)], 1)
    for step in range(1, steps + 1):
        scores = np.stack([np.bincount(owner, theta[flat, j], len(vocabulary)) for j in range(k)], 1)
        unary = np.exp(scores - scores.max(1, keepdims=True))[words]
        move = np.exp(trans)
        forward, backward, scale = chain(unary, move)
        posterior = forward * backward
        expected = np.stack([np.bincount(words.ravel(), posterior[..., j].ravel(), len(vocabulary)) for j in range(k)], 1)
        both = np.einsum("nti,ntj->ij", forward[:, :-1], unary[:, 1:] * backward[:, 1:] / scale[:, 1:, None]) * move
        gap = observed - expected
        grad = np.stack([np.bincount(flat, gap[owner, j], BUCKETS) for j in range(k)], 1) / n - ridge / n * theta
        grads = [grad, (follows - both) / n - ridge / n * trans]
        for which, g in enumerate(grads):
            m, v = state[2 * which], state[2 * which + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            change = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
            (theta if which == 0 else trans).__iadd__(np.where(g == 0, 0, change))
    return Field(languages, theta.astype(np.float32), trans)


def fit(docs: DataFrame, each: int = 300, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """The field from a bounded sample: about ``each`` documents a language outside the held-out fold.

    From each sampled document four stretches of 16 words spread over the whole text are
    taken. Stretches of different documents are joined in training sequences, most of one
    language and some switching, which is what the transitions learn from.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.pmod(id_crc(), F.lit(4)) != 2))
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    limit = F.lit(0)
    for lang, n in totals.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(1 << 30, int((1 << 30) * each / n)))).otherwise(limit)
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) < limit)

    def cut(batches):
        for batch in batches:
            langs, stretches = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = WORD.findall(text.lower())
                for k in range(4):
                    at = len(words) * k // 4
                    piece = [w[:200] for w in words[at : at + 16]]
                    if piece:
                        langs.append(lang)
                        stretches.append(" ".join(piece))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(stretches, pa.string())], ["lang", "words"])

    drawn = sorted((r["lang"], r["words"]) for r in chosen.select("lang", "text").mapInArrow(cut, "lang string, words string").collect())
    languages = sorted({lang for lang, _ in drawn})
    if not languages:
        return Field([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    code = {lang: i for i, lang in enumerate(languages)}
    draw = np.random.default_rng(seed)
    # In order of language with one stretch in eight moved elsewhere, then cut into equal sequences.
    order = np.arange(len(drawn))
    order = order[np.argsort(np.where(draw.random(len(order)) < 0.125, draw.permutation(len(order)), order), kind="stable")]
    words = [w for i in order for w in drawn[i][1].split(" ")]
    labels = np.array([code[drawn[i][0]] for i in order for _ in drawn[i][1].split(" ")])
    while len(words) < TRAIN_LENGTH:
        words, labels = words * 2, np.concatenate([labels, labels])
    n = len(words) // TRAIN_LENGTH
    sequences = [words[i * TRAIN_LENGTH : (i + 1) * TRAIN_LENGTH] for i in range(n)]
    return train(sequences, labels[: n * TRAIN_LENGTH].reshape(n, TRAIN_LENGTH), languages)


def posteriors(unary: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Distribution of every word of texts of the given lengths (none zero), one after another."""
    k = unary.shape[1]
    runs = -(-lengths // RUN)
    first_run = np.cumsum(runs) - runs
    total = int(runs.sum())
    text_of = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(unary)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = first_run[text_of] + within // RUN, within % RUN
    u = np.ones((total, RUN, k), dtype=unary.dtype)
    u[row, col] = unary
    used = np.zeros((total, RUN), dtype=bool)
    used[row, col] = True
    transfer = np.broadcast_to(np.eye(k, dtype=unary.dtype), (total, k, k)).copy()
    full = used.all()
    for t in range(RUN):
        new = (transfer.reshape(-1, k) @ transition).reshape(total, k, k) * u[:, t, None, :]
        new /= new.sum((1, 2), keepdims=True)
        transfer = new if full else np.where(used[:, t, None, None], new, transfer)
    start, end = np.empty((total, k), unary.dtype), np.empty((total, k), unary.dtype)
    longest = np.argsort(-runs, kind="stable")
    counts = runs[longest]
    state = np.full((len(lengths), k), 1.0 / k, dtype=unary.dtype)
    for r in range(int(counts[0])):
        live = longest[: int(np.searchsorted(-counts, -r, side="left"))]
        at = first_run[live] + r
        start[at] = state[live]
        moved = np.einsum("ni,nij->nj", state[live], transfer[at])
        state[live] = moved / moved.sum(1, keepdims=True)
    state = np.ones((len(lengths), k), dtype=unary.dtype)
    for r in range(int(counts[0]) - 1, -1, -1):
        live = longest[: int(np.searchsorted(-counts, -r, side="left"))]
        at = first_run[live] + r
        end[at] = state[live]
        moved = np.einsum("nij,nj->ni", transfer[at], state[live])
        state[live] = moved / moved.sum(1, keepdims=True)
    forward = np.empty_like(u)
    for t in range(RUN):
        new = (start @ transition) * u[:, t]
        new /= new.sum(1, keepdims=True)
        start = np.where(used[:, t, None], new, start)
        forward[:, t] = start
    for t in range(RUN - 1, -1, -1):
        forward[:, t] *= end
        new = (end * u[:, t]) @ transition.T
        new /= new.sum(1, keepdims=True)
        end = np.where(used[:, t, None], new, end)
    out = forward[row, col]
    return out / out.sum(1, keepdims=True)


class Labeller:
    def __init__(self, model: Field):
        self.model = model
        self.transition = np.exp(model.transitions - model.transitions.max(initial=0.0)).astype(np.float32)
        self.known: dict[str, int] = {}
        self.unary = np.zeros((KEPT + 1, len(model.languages)), dtype=np.float32)

    def codes(self, words: list[str]) -> list[int]:
        known = self.known
        missing = [w for w in set(words) if w not in known]
        if len(known) + len(missing) > KEPT:
            known.clear()
            missing = list(set(words))
        if len(missing) > KEPT:
            self.unary = np.zeros((len(missing) + 1, self.unary.shape[1]), dtype=np.float32)
        for w in missing:
            scores = self.model.weights[list(features.__wrapped__(w))].sum(0)
            known[w] = i = len(known)
            self.unary[i] = np.exp(scores - scores.max())
        return list(map(known.__getitem__, words))

    def means(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The mean distribution over the words of each text; None without words."""
        out: list[np.ndarray | None] = [None] * len(texts)
        held: list[int] = []
        codes: list[np.ndarray] = []
        size = 0
        for i, text in enumerate([*texts, None]):
            last = i == len(texts)
            words = WORD.findall(text.lower()) if text else []
            if held and (last or size + len(words) > BATCH_WORDS):
                lengths = np.array([len(c) for c in codes])
                every = posteriors(np.maximum(np.concatenate(codes), 1e-12), lengths, self.transition)
                sums = np.add.reduceat(every.astype(np.float64), np.cumsum(lengths) - lengths, axis=0)
                for j, mean in zip(held, sums / lengths[:, None]):
                    out[j] = mean
                held, codes, size = [], [], 0
            if words:
                held.append(i)
                codes.append(self.unary[self.codes(words)])
                size += len(words)
        return out


def predict(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` and ``shares``, the share of words by language.

    ``score`` is the mean probability of the predicted language over the words. Null texts
    and texts without letters are ``und`` with score 0, as is everything if nothing could be
    learned. Rows with null or repeated ids give a row each; an empty table gives none; other
    columns are left out.
    """
    named = id_and_text(docs, id_col, text_col)
    schema = schema_of(named, "doc_id", lang_pred=T.StringType(), score=T.DoubleType(), shares=T.MapType(T.StringType(), T.DoubleType()))

    def run(batches):
        labeller = Labeller(model)
        for batch in batches:
            langs, scores, shares = [], [], []
            texts = batch.column("text").to_pylist()
            for mean in labeller.means(texts) if model.languages else [None] * len(texts):
                best = None if mean is None else int(mean.argmax())
                langs.append("und" if best is None else model.languages[best])
                scores.append(0.0 if best is None else min(1.0, float(mean[best])))
                shares.append([] if best is None else [(l, float(p)) for l, p in zip(model.languages, mean)])
            kind = pa.map_(pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, kind)], schema.names)

    found = named.mapInArrow(run, schema)
    return found.select("doc_id", (F.pmod(id_crc(), F.lit(4)) == 2).alias("held_out"), "lang_pred", "score", "shares")
