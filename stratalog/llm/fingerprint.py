"""Fingerprints by canonical exact digest: Unicode normalisation, case and white-space folding, wide xxhash, bytes compared.

Equal canonical texts have equal fingerprints, and exact_groups() compares the bytes inside each bucket of equal ones.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_small, map_text, prepare, stored


def canonical(text: str | None) -> str:
    """NFKC, case-folded (and normalised again, as folding can undo it), each run of white space one space, none at the ends."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def digest(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points), fingerprint.  A null text is an empty one; every row has one of its own."""
    prepare()

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = part.column("text").to_pylist()
            return pa.record_batch(
                [
                    part.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()),
                    pa.array([digest(t) for t in texts]),
                ],
                ["doc_id", "n_chars", "fingerprint"],
            )

        return step

    return map_text(
        docs.select(F.col("doc_id").cast("long"), "text"), "text", "doc_id long, n_chars long, fingerprint string",
        make,
    )


def likeness(left: str, right: str) -> F.Column:
    """Of two fingerprint columns: 1 if they are equal, else 0, as exact digests know no degrees."""
    return (F.col(left) == F.col(right)).cast("double")


def exact_groups(docs: DataFrame, part: int = 10_000, prints: DataFrame | None = None) -> DataFrame:
    """doc_id, fingerprint, group_id: the smallest doc_id whose canonical text has the same bytes.

    Each bucket of equal digests is compared with its first document, whose text goes to each of the bucket's salted
    parts (one for `part` documents), so that no large bucket comes to one task.  Texts that differ in spite of equal digests (never seen) keep their
    own id as group_id.  Null ids form no group (group_id null); repeated ids are rows of their own.  `prints` (doc_id,
    fingerprint) spares a pass over the texts where fingerprints are known.
    """
    prints = stored(fingerprints(docs).select("doc_id", "fingerprint"), "prints") if prints is None else prints
    heads = prints.groupBy("fingerprint").agg(
        F.min("doc_id").alias("head"), F.count("*").alias("n"),
    ).where("n > 1 and head is not null").select(
        "fingerprint", "head", F.ceil(F.col("n") / part).cast("int").alias("parts"),
    )
    # a table of its own, so that the join can split a fingerprint that a third of all rows has
    heads = stored(heads, "heads")
    shared = stored(
        join_small(
            prints.where("doc_id is not null"), heads, ["fingerprint"], "inner",
        ).select("doc_id", "head", "parts").distinct(),
        "shared",
    )
    discard(heads)

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            data = [
                zstandard.compress(canonical(t).encode("utf-8", "surrogatepass"), 1)
                for t in part.column("text").to_pylist()
            ]
            return pa.record_batch([part.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

        return step

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    data = map_text(
        join_small(texts, shared.select("doc_id").distinct(), ["doc_id"], "left_semi"), "text",
        "doc_id long, data binary", make,
    )
    data = join_small(data, shared, ["doc_id"], "inner")
    first = data.where("doc_id = head").groupBy("head").agg(
        F.min("data").alias("first"), F.min("parts").alias("parts"),
    ).select("head", "first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    rest = data.select("doc_id", "head", "data", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("salt"))
    same = rest.join(first, ["head", "salt"]).where("data = first").groupBy("doc_id").agg(F.min("head").alias("same"))
    return prints.join(same, "doc_id", "left").select(
        "doc_id", "fingerprint", F.coalesce("same", "doc_id").alias("group_id"),
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, and that of its text with the last third replaced by the next document's beginning.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint.  The next document is the one
    with the next smaller id; the last one's is the first.  Rows of equal ids follow each other by the hashes of their
    bytes; null ids count as smaller than all.  Where ids are unique, a document and its neighbour (an id less by one)
    that come in the same batch meet there; all others' texts move once, compressed, into ranges of ids that are cut by
    a look at the ids alone, and the first document of each range goes to the range before it as well.
    """
    spark = docs.sparkSession
    prepare()
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(
        set(ids.select(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or [])
    )[: n - 1]
    unique = not ids.groupBy("id").count().where("count > 1").limit(1).count()
    bounds = np.array(cuts, np.int64)

    def largest(batches):
        for batch in batches:
            at = batch.column("id").to_numpy()
            place = np.searchsorted(bounds, at)
            top = np.full(len(bounds) + 1, LEAST)
            np.maximum.at(top, place, at)
            some = np.unique(place)
            yield pa.record_batch([pa.array(some), pa.array(top[some])], ["place", "top"])

    # the largest id of each range: at most n rows
    tops = ids.mapInArrow(largest, "place long, top long").groupBy("place").agg(F.max("top").alias("top")).collect()
    rising = np.array(sorted(r["top"] for r in tops), np.int64)
    last = len(rising) - 1

    def send(batch):
        pack = zstandard.ZstdCompressor(level=1)
        rows = [
            (LEAST if i is None else i, i is None, t or "")
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
        ]
        rows.sort(key=lambda r: -r[0])
        digests = [digest(r[2]) for r in rows]
        linked = [unique and a[0] - 1 == b[0] for a, b in zip(rows, rows[1:])] + [False]
        places = last - np.searchsorted(rising, np.array([r[0] for r in rows], np.int64))
        for k, ((at, absent, text), own) in enumerate(zip(rows, places.tolist(), strict=True)):
            serves = not (k and linked[k - 1])
            result = _edit((at, absent, text, digests[k]), (*rows[k + 1], digests[k + 1])) if linked[k] else (None,) * 6
            data = text.encode("utf-8", "surrogatepass") if serves or not linked[k] else None
            row = (
                at, absent, None if data is None else pack.compress(data),
                0 if data is None else xxhash.xxh3_64_intdigest(data) >> 1,
            )
            yield (own, False, not linked[k], *row, *result)
            if at == rising[last - own] and serves:
                yield ((own - 1) % (last + 1), True, False, *row, *(None,) * 6)

    def batched(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*send(batch), strict=True), MOVED, strict=True)], NAMES,
                )

    def pair(batches):
        unpack = zstandard.ZstdDecompressor()
        before, ended = None, False
        for batch in batches:
            out = []
            for extra, own, at, absent, data, *result in zip(
                *(batch.column(c).to_pylist() for c in NAMES[1:6] + NAMES[7:]), strict=True,
            ):
                if not own and not extra:
                    out.append(tuple(result))
                if data is None or ended:
                    continue
                text = unpack.decompress(data).decode("utf-8", "surrogatepass") if data else ""
                now = (at, absent, text, digest(text), own)
                if before is not None and before[4]:
                    out.append(_edit(before[:4], now[:4]))
                before, ended = now, extra  # of the copies from the next range only the first one is a neighbour
            if out:
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), RESULT, strict=True)], NAMES[7:],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        batched, ", ".join(f"{n} {t}" for n, t in zip(NAMES, KINDS, strict=True)),
    )
    rows = rows.repartitionById(max(1, last + 1), F.col("place")).sortWithinPartitions("extra", F.desc("at"), "ord")
    return rows.mapInArrow(pair, ", ".join(f"{n} {t}" for n, t in zip(NAMES[7:], KINDS[7:], strict=True)))


#: Stands for a null id: smaller than all.
LEAST = -(1 << 63)
NAMES = [
    "place", "extra", "own", "at", "absent", "data", "ord", "doc_id", "n_chars", "edited_sha256", "fingerprint",
    "edited_fingerprint", "next_fingerprint",
]
KINDS = ["int", "boolean", "boolean", "long", "boolean", "binary", "long", "long", "long", *["string"] * 4]
RESULT = [pa.int64(), pa.int64(), *[pa.string()] * 4]
MOVED = [pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), *RESULT]


def _edit(this: tuple, following: tuple) -> tuple:
    at, absent, text, own = this
    cut = len(text) // 3
    edited = text[: len(text) - cut] + following[2][:cut]
    return None if absent else at, len(text), hashlib.sha256(
        edited.encode("utf-8", "surrogatepass")
    ).hexdigest(), own, digest(edited), following[3]
