"""What the trained classifiers share: labelled rows, counts of hashed features, bounded samples, scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, map_text, prepare, remainder, stored
from .textvec import pack

#: crc32(doc_id) modulo HOLD = 0 is held out.
HOLD = 5

#: A function from texts to each text's distinct feature numbers, flat, and their number by text.
Features = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def training_rows(docs: DataFrame, labels: DataFrame, column: str, features: Features, hold: int = HOLD) -> DataFrame:
    """doc_id, label (0 or 1), packed features of all labelled documents that aren't held out; a stored table.

    A document's label is the largest of its non-null ones.  Labels are broadcast up to a counted bound; beyond it,
    features (a fraction of the text) are shuffled instead of texts.
    """
    labels = labels.where(
        F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", hold) != 0)
    ).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column) > 0).cast("int").alias("label"))
    docs = docs.select(F.col("doc_id").cast("long"), "text").where(remainder("doc_id", hold) != 0)
    if is_small(labels):
        rows = packed(
            docs.join(F.broadcast(labels.select("doc_id")), "doc_id", "left_semi"), features,
        ).join(F.broadcast(labels), "doc_id")
    else:
        rows = packed(docs, features).join(labels, "doc_id")
    return stored(rows.select("doc_id", "label", "features"), "training")


def packed(docs: DataFrame, features: Features) -> DataFrame:
    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch(
                [part.column("doc_id"), pack(*features(part.column("text")))], ["doc_id", "features"],
            )

        return step

    prepare()
    return map_text(docs, "text", "doc_id long, features binary", make)


def document_counts(rows: DataFrame, size: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, int, int]:
    """For each feature in at least `least` rows, in how many rows of label 1 and 0 it occurs (0 for the others); and the
    numbers of these rows.  All rows count.  Each task adds up its own rows; at most `size` sums come to the driver.
    """

    def add(batches):
        total = np.zeros((2, size + 1), np.int64)
        for batch in batches:
            label = batch.column("label").to_numpy()
            for one in (0, 1):
                some = [
                    np.frombuffer(x.as_py(), np.uint32) for x in batch.column("features").filter(pa.array(label == one))
                ]
                total[one, size] += len(some)
                if some:
                    total[one, :size] += np.bincount(np.concatenate(some), minlength=size)
        at = np.flatnonzero(total.any(0))
        yield pa.record_batch(
            [pa.array(at), pa.array(total[1, at]), pa.array(total[0, at])], ["feature", "good", "bad"],
        )

    sums = rows.mapInArrow(add, "feature long, good long, bad long").groupBy("feature").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"),
    ).where((F.col("good") + F.col("bad") >= least) | (F.col("feature") == size)).toPandas()
    out = np.zeros((2, size + 1))
    out[:, sums["feature"]] = sums[["good", "bad"]].to_numpy(float).T
    return out[0, :size], out[1, :size], int(out[0, size]), int(out[1, size])


def sample(rows: DataFrame, most: int, place: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most `most` rows, those whose hashed ids are smallest; with `place`, features are looked
    up there, and those below 0 left out, before anything comes to the driver."""
    ids = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).distinct()
    some = rows.join(F.broadcast(ids), "doc_id", "left_semi")
    if place is not None:
        shared = rows.sparkSession.sparkContext.broadcast(place)

        def known(batches):
            for batch in batches:
                kept = (shared.value[np.frombuffer(x.as_py(), np.uint32)] for x in batch.column("features"))
                yield pa.record_batch(
                    [
                        batch.column("doc_id"), batch.column("label"),
                        pa.array([k[k >= 0].astype(np.uint32).tobytes() for k in kept], pa.binary()),
                    ],
                    ["doc_id", "label", "features"],
                )

        some = some.mapInArrow(known, "doc_id long, label int, features binary")
    got = some.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(most).select("features", "label").toPandas()
    return [np.frombuffer(x, np.uint32).astype(np.int64) for x in got["features"]], got["label"].to_numpy(int)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (Newton steps on the smoothed log-loss)."""
    good, bad = label.sum(), (1 - label).sum()
    aim = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([1.0, np.log((good + 1) / (bad + 1))])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - aim) + 1e-3 * w)
        w -= np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def scored(
    docs: DataFrame, features: Features, judge: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float,
    hold: int = HOLD,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; judge maps features, flat and by text, to scores."""

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            score = judge(*features(part.column("text")))
            return pa.record_batch(
                [part.column("doc_id"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

        return step

    prepare()
    out = map_text(
        docs.select(F.col("doc_id").cast("long"), "text"), "text", "doc_id long, score double, predicted int", make,
    )
    return out.select("doc_id", (remainder("doc_id", hold) == 0).alias("held_out"), "score", "predicted")


def kept(
    docs: DataFrame, features: Features, judge: Callable[[np.ndarray, np.ndarray], np.ndarray],
    keep: Callable[[np.ndarray], np.ndarray],
) -> DataFrame:
    """The rows of docs, with all their columns, whose own scores `keep` takes; ids are not looked at."""

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            return part.filter(pa.array(keep(judge(*features(part.column("text"))))))

        return step

    prepare()
    return map_text(docs, "text", docs.schema, make)
