"""Quality classifier: Naive Bayes support vectors (Wang and Manning, 2012).

Indicators of n-grams - of words, and of word shapes with the share of the text that they make up - are scaled by
the log-count ratios of the two classes, counted over all labelled documents; a linear hinge-loss model on the scaled
indicators is fitted by dual coordinate descent on at most SAMPLE of them, its margins turned into probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import discard
from .labelled import document_counts, kept, platt, sample, scored, sigmoid, training_rows
from .textvec import LOWER, U64, byte_view, hash_spans, mix, per_text, word_spans

BITS = 18
#: Rows on which the linear model is fitted; log-count ratios come from all labelled rows.
SAMPLE = 8000
THRESHOLD = 0.3


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the n-gram indicators of each text."""
    buf, offsets = byte_view(column)
    raw = buf[:-8].copy()
    buf[:-8] = LOWER[raw]
    starts, sizes, first = word_spans(buf, offsets)
    texts, n = len(column), np.diff(first)
    words = hash_spans(buf, starts, sizes)
    owner = np.repeat(np.arange(texts), n)

    def inside(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return total[starts + sizes] - total[starts]

    upper = inside((raw >= 65) & (raw <= 90))
    letters = inside((raw >= 97) & (raw <= 122)) + upper + inside(raw >= 128)
    digits = inside((raw >= 48) & (raw <= 57))
    marks = sizes - letters - digits
    case = np.where(upper == 0, 0, np.where(upper >= np.maximum(2, 0.6 * letters), 2, 1))
    again = np.zeros(len(words), np.int64)
    if len(words) > 1:
        again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    shape = ((np.minimum(marks, 3) * 3 + case) * 3 + np.minimum(digits, 2)) * 2 + again
    shape = shape * 4 + np.minimum(sizes // 4, 3)
    found = [(owner, words >> U64(64 - BITS + 1))]

    def binned(who: np.ndarray, gram: np.ndarray, seed: int) -> None:
        """Indicators of (n-gram, share of the text's n-grams that it makes up, in eighths and halves below)."""
        both, times = np.unique(who.astype(U64) << U64(32) | gram.astype(U64), return_counts=True)
        who = (both >> U64(32)).astype(np.int64)
        share = times / np.maximum(n[who], 1)
        step = np.where(
            share >= 0.125, 8 + np.floor(share * 8), np.maximum(0, 8 + np.floor(np.log2(share))),
        ).astype(U64)
        found.append(
            (who, half + (mix((both & U64(0xFFFFFFFF)) * U64(64) + step + U64(seed << 48)) >> U64(64 - BITS + 1)))
        )

    half = U64(1 << (BITS - 1))
    binned(owner, shape, 1)
    if len(words) > 1:
        same = owner[1:] == owner[:-1]
        binned(owner[1:][same], (shape[:-1] * 1024 + shape[1:])[same], 2)
    # how much of the text are n-grams that it has had before, in sixteenths: an indicator for each width
    for width in (1, 2, 5):
        h, who = words, owner
        for j in range(1, width):
            h, who = mix(h[:-1] ^ words[j:] * U64(2 * j + 1)), who[:-1]
        whole = np.arange(len(h)) + width <= first[who + 1]
        who = who[whole]
        seen = np.bincount(who, minlength=texts)
        kept = np.sort(who.astype(U64) << U64(40) | h[whole] >> U64(24))
        fresh = np.bincount(
            (kept[np.append(True, kept[1:] != kept[:-1])] >> U64(40)).astype(np.int64) if len(kept) else who,
            minlength=texts,
        )
        some = np.flatnonzero(seen)
        step = (16 * (seen[some] - fresh[some])) // seen[some]
        found.append((some, half + (mix((step + 32 * width).astype(U64) + U64(3 << 48)) >> U64(64 - BITS + 1))))
    return per_text(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), texts)


def descend(
    rows: list[np.ndarray], label: np.ndarray, scale: np.ndarray, c: float = 0.1, rounds: int = 12, seed: int = 7,
) -> np.ndarray:
    """Weights of the hinge-loss model, by dual coordinate descent (Hsieh et al., 2008); the last one is the offset."""
    sign, w, alpha = np.where(label == 1, 1.0, -1.0), np.zeros(len(scale) + 1), np.zeros(len(rows))
    values = [scale[r] for r in rows]
    norm = np.array([v @ v + 1 for v in values])
    cost = np.where(label == 1, c, c * max(1.0, min(4.0, label.mean() / max(1e-9, 1 - label.mean()))))
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            gradient = sign[i] * (w[rows[i]] @ values[i] + w[-1]) - 1
            step = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * sign[i] * values[i]
                w[-1] += step * sign[i]
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict:
    """weights, offset, slope of a model of labels.quality.  Without rows of both classes: the constant share of 1s."""
    rows = training_rows(docs, labels, "quality", features)
    good, bad, n_good, n_bad = document_counts(rows, 1 << BITS, 3)
    if not n_good or not n_bad:
        discard(rows)
        return {
            "weights": np.zeros(1 << BITS, np.float32), "slope": 0.0,
            "offset": 40.0 if n_good else -40.0 if n_bad else 0.0,
        }
    ratio = np.log((good + 1) / (n_good + 2)) - np.log((bad + 1) / (n_bad + 2))
    ratio[good + bad == 0] = 0  # too rare
    some, label = sample(rows, most)
    discard(rows)
    scale = ratio / np.sqrt(np.mean([len(r) for r in some]) + 1)
    w = descend(some, label, scale)
    weights = w[:-1] * scale
    slope, offset = platt(np.array([weights[r].sum() for r in some]) + w[-1], label)
    return {"weights": weights.astype(np.float32), "slope": slope, "offset": slope * w[-1] + offset}


def judge(model: dict, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    margin = np.bincount(np.repeat(np.arange(len(counts)), counts), model["weights"][flat], len(counts))
    return sigmoid(model["slope"] * margin + model["offset"])


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted.  One row for each input row.  Null and empty texts
    have no n-grams and get the model's score of nothing; null ids get held_out null; no other column is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, features, lambda flat, counts: judge(shared.value, flat, counts), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents that the classifier, trained on these documents' labels, doesn't reject.  Each row
    goes or stays by its own text; its id may be null or repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return kept(
        docs, features, lambda flat, counts: judge(shared.value, flat, counts), lambda score: score >= threshold,
    )
