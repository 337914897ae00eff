"""Toxicity: a factorization machine (Rendle, 2010) over hashed terms.

Besides a weight for each term it learns a vector for each, whose products weigh pairs: an insult together with the
mention of a group says more than the two do one by one.  Terms are the ones whose presence depends on the label over
all labelled documents; the machine is fitted on at most SAMPLE of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import discard
from .labelled import document_counts, kept, sample, scored, sigmoid, training_rows
from .textvec import LOWER, MARKS, U64, byte_view, hash_spans, per_text, word_spans

BITS = 20
RANK = 4
#: Bytes of the beginnings of words that are terms, too.
STEMS = (4, 5, 6)
#: Rows on which the machine is fitted; the choice of terms comes from all labelled rows.
SAMPLE = 8000
#: Least chi-square value (one degree of freedom) of a term that the machine sees.
DEPENDS = 10.83
THRESHOLD = 0.5


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each text's distinct terms, hashed: runs of letters and digits, A-Z lower-cased, and the beginnings of
    longer ones, which stand for all their inflected forms."""
    buf, offsets = byte_view(column)
    buf[:-8] = LOWER[buf[:-8]]
    starts, sizes, first = word_spans(buf, offsets, MARKS)
    owner = np.repeat(np.arange(len(column)), np.diff(first))
    terms = [(owner, hash_spans(buf, starts, sizes))]
    for size in STEMS:
        longer = sizes > size
        terms.append((owner[longer], hash_spans(buf, starts[longer], np.full(longer.sum(), size), seed=1)))
    return per_text(
        np.concatenate([t[0] for t in terms]), np.concatenate([t[1] for t in terms]) >> U64(64 - BITS), len(column),
    )


class Machine:
    """score(x) = offset + sum of weights + sum over pairs of the dot products of the terms' vectors."""

    def __init__(self, terms: int, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.offset, self.w, self.v = 0.0, np.zeros(terms), rng.normal(0, 0.01, (terms, rank))

    def margin(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        owner, n = np.repeat(np.arange(len(counts)), counts), len(counts)
        out = self.offset + np.bincount(owner, self.w[flat], n)
        for f in range(self.v.shape[1]):
            x = self.v[flat, f]
            out += 0.5 * (np.bincount(owner, x, n) ** 2 - np.bincount(owner, x * x, n))
        return out

    def fit(
        self, rows: list[np.ndarray], label: np.ndarray, rounds: int = 20, rate: float = 0.1, decay: float = 2e-5,
        batch: int = 128, tilt: float = 8.0, seed: int = 7,
    ) -> None:
        """AdaGrad on the log-loss with a quadratic penalty; the rarer class weighs more, up to `tilt` times."""
        rng, terms = np.random.default_rng(seed), len(self.w)
        seen_w, seen_v, seen_o = np.full(terms, 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        odds = (label.sum() + 1) / ((1 - label).sum() + 1)
        weight = np.where(label == 1, np.clip(1 / odds, 1, tilt), np.clip(odds, 1, tilt))
        self.offset = -1.0
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                some = order[at : at + batch]
                counts = np.array([len(rows[i]) for i in some])
                flat = np.concatenate([rows[i] for i in some])
                slope = (sigmoid(self.margin(flat, counts)) - label[some]) * weight[some] / len(some)
                seen_o += slope.sum() ** 2
                self.offset -= rate * slope.sum() / np.sqrt(seen_o)
                if not len(flat):
                    continue
                owner = np.repeat(np.arange(len(some)), counts)
                used, place = np.unique(flat, return_inverse=True)
                g = np.bincount(place, slope[owner], len(used)) + decay * self.w[used]
                grads = []
                for f in range(self.v.shape[1]):
                    x = self.v[flat, f]
                    total = np.bincount(owner, x, len(some))
                    grads.append(np.bincount(place, slope[owner] * (total[owner] - x), len(used)))
                gv = np.stack(grads, 1) + decay * self.v[used]
                seen_w[used] += g * g
                seen_v[used] += gv * gv
                self.w[used] -= rate * g / np.sqrt(seen_w[used])
                self.v[used] -= rate * gv / np.sqrt(seen_v[used])


def dependent(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int, least: float = DEPENDS) -> np.ndarray:
    """Terms whose presence depends on the label (chi-square of the 2 x 2 table), in at least five documents."""
    a, b = good, bad
    c, d = n_good - a, n_bad - b
    chi = (a * d - b * c) ** 2 * float(n_good + n_bad) / np.maximum((a + b) * (c + d) * float(n_good) * float(n_bad), 1)
    return np.flatnonzero((chi >= least) & (a + b >= 5))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> dict:
    """A model of labels.toxic.  Without rows of both classes: the constant share of 1s."""
    rows = training_rows(docs, labels, "toxic", features)
    toxic, clean, n_toxic, n_clean = document_counts(rows, 1 << BITS, 5)
    place = np.full(1 << BITS, -1, np.int32)
    if not n_toxic or not n_clean:
        discard(rows)
        constant = Machine(1)
        constant.offset = 40.0 if n_toxic else -40.0
        return {"place": place, "machine": constant}
    terms = dependent(toxic, clean, n_toxic, n_clean)
    place[terms] = np.arange(len(terms))
    some, label = sample(rows, most, place)
    discard(rows)
    machine = Machine(max(1, len(terms)))
    machine.fit(some, label)
    return {"place": place, "machine": machine}


def judge(model: dict, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    place = model["place"][flat]
    known = place >= 0
    counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[known], minlength=len(counts))
    return sigmoid(model["machine"].margin(place[known], counts))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: more toxic), predicted.  One row for each input row.  Null and empty
    texts have no terms and get the model's score of nothing; null ids get held_out null; no other column is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, features, lambda flat, counts: judge(shared.value, flat, counts), threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents that the machine, trained on these documents' labels, doesn't reject.  Each row goes
    or stays by its own text; its id may be null or repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return kept(docs, features, lambda flat, counts: judge(shared.value, flat, counts), lambda score: score < threshold)
