"""Token ids in ORC: documents in ascending id, integer run-length encoding, row indexes, Bloom filters on the ids.

Each file holds one range of ids and says in its rows where a document's ids begin, so that a reader can take stripes in
any order; a look-up by id prunes by the files' and stripes' statistics and Bloom filters.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import map_text, parts, prepare, small_batches
from .textvec import MARKS, WHITE, byte_view, gather, hash_spans, lead_spans, lists, ragged, wide_white, worker_memo

#: ASCII letters and digits.
PLAIN = ~MARKS & (np.arange(256) < 0x80)
#: New words that one call of the library encodes.
JOINED = 4096
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("offset", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


class Encoder:
    """A tokenizer that asks the library only for words it hasn't met: a word with the white space before it is encoded
    alike wherever it stands, as the pre-tokenizer never joins across the start of a run of white space.

    Strings of the vocabulary's added tokens (such as <|endoftext|>) become these tokens, as in the library; with
    `plain_specials` they are ordinary text.
    """

    def __init__(self, tokenizer_json: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = plain_specials
        added = [t for t in self.tokenizer.get_added_tokens_decoder().values() if not (plain_specials and t.special)]
        self.added = [t.content.encode() for t in added]
        self.memo = worker_memo(f"bpe_{xxhash.xxh3_64_hexdigest(tokenizer_json)}", np.int32)
        # in a byte-level vocabulary each character stands for one byte
        self.sizes = np.array(
            [len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())]
        )

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of ids of each text.  Texts that hold an added token's string are encoded whole."""
        buf, offsets = byte_view(column)
        whole = buf[:-8].tobytes()
        if not any(a in whole for a in self.added):
            return self._cut(buf, offsets, whole)
        odd = np.array(
            [any(a in whole[i:j] for a in self.added) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        )
        some = [
            np.array(
                self.tokenizer.encode(whole[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids,
                np.int32,
            )
            for i in np.flatnonzero(odd)
        ]
        flat, n = self.encode(column.filter(pa.array(~odd))) if not odd.all() else (
            np.zeros(0, np.int32), np.zeros(0, np.int64),
        )
        counts = np.zeros(len(odd), np.int64)
        counts[odd], counts[~odd] = [len(x) for x in some], n
        owner = np.repeat(
            np.concatenate([np.flatnonzero(odd), np.flatnonzero(~odd)]), np.concatenate([counts[odd], counts[~odd]]),
        )
        return np.concatenate([*some, flat])[np.argsort(owner, kind="stable")], counts

    def _cut(self, buf: np.ndarray, offsets: np.ndarray, whole: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Texts are cut where the pre-tokenizer always cuts: before white space, and between a letter and a mark."""
        space = wide_white(buf[:-8])
        starts = lead_spans(buf, offsets, white=space)[0]
        # a mark behind an ASCII letter or digit begins a piece of its own, too
        mark = MARKS[buf[1:-8]] & ~WHITE[buf[1:-8]] & PLAIN[buf[:-9]] if len(buf) > 9 else np.zeros(0, bool)
        starts = np.sort(np.concatenate([starts, np.flatnonzero(mark) + 1]))
        starts = starts[np.append(True, starts[1:] != starts[:-1])[: len(starts)]]
        lengths, first = np.diff(np.append(starts, len(buf) - 8)), np.searchsorted(starts, offsets)
        # New words that begin with white space and don't end with it are joined to long texts: one call for many.
        white, tail = space[starts], space[starts + lengths - 1]

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            fit = white[new] & ~tail[new]
            alone, joined = new[~fit], new[fit]
            texts = [whole[s : s + n].decode() for s, n in zip(starts[alone], lengths[alone], strict=True)]
            runs = [joined[at : at + JOINED] for at in range(0, len(joined), JOINED)]
            data = [buf[gather(starts[r], lengths[r])].tobytes().decode() for r in runs]
            counts, flat = np.zeros(len(new), np.int64), []
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                flat.append(np.array(e.ids, np.int32))
            counts[~fit] = [len(x) for x in flat]
            ends = []
            for r, text in zip(runs, data, strict=True):
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
                ends.append(np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(lengths[r])) + 1, prepend=0))
                flat.append(ids)
            if runs:
                counts[fit] = np.concatenate(ends)
            flat = np.concatenate(flat)
            owner, _ = ragged(np.concatenate([counts[~fit], counts[fit]]))
            return flat[
                np.argsort(np.concatenate([np.flatnonzero(~fit), np.flatnonzero(fit)])[owner], kind="stable")
            ], counts

        flat, counts = self.memo.look(hash_spans(buf, starts, lengths), make)
        ends = np.concatenate([[0], np.cumsum(counts)])[first]
        return flat, np.diff(ends)


def encode(docs: DataFrame, tokenizer_json: str, end_id: int | None = None, plain_specials: bool = False) -> DataFrame:
    """doc_id, ids as bytes (little-endian, 16 bits if the vocabulary allows it, else 32), the end id added.  Strings of
    special tokens in a text become these tokens, as in the library, or stay ordinary text with `plain_specials`."""
    return _encoded(docs, tokenizer_json, end_id, plain_specials, []).drop("place")


def _encoded(
    docs: DataFrame, tokenizer_json: str, end_id: int | None, plain_specials: bool, cuts: list[int],
) -> DataFrame:
    """encode(), and the place of each document's id among the cuts."""
    prepare()
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    width = _width(tokenizer_json, end_id)

    def make():
        encoder = Encoder(shared.value, plain_specials)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            flat, counts = encoder.encode(part.column("text"))
            tail = b"" if end_id is None else np.array([end_id], width).tobytes()
            ids = [x.tobytes() + tail for x in np.split(flat.astype(width), np.cumsum(counts)[:-1])]
            place = [0 if x is None else bisect_left(cuts, x) for x in part.column("doc_id").to_pylist()]
            columns = [part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(place, pa.int32())]
            return pa.record_batch(columns, ["doc_id", "ids", "place"])

        return step

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return map_text(docs, "text", "doc_id long, ids binary, place int", make)


def _width(tokenizer_json: str, end_id: int | None) -> str:
    return "<u2" if max(Tokenizer.from_str(tokenizer_json).get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else "<u4"


def write_tokens(
    docs: DataFrame, path: str, tokenizer_json: str, end_id: int | None = None, plain_specials: bool = False,
) -> None:
    """Writes all documents' ids as ORC files, in ascending doc_id over the files in the order of their names.

    Rows: doc_id, offset (ids of earlier documents in the same file), ids.  A null text is an empty one and has the end
    id alone; null doc_ids come first; repeated ids stand side by side, ordered by their token ids; further columns of
    docs are left out; an empty table writes files without rows.  The ranges come from the ids alone, before any text
    is read; texts are encoded once and shuffled as 16-bit ids.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(
        F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)] or [0.5], 100 * n)
    ).first()[0] or []
    cuts = sorted(set(cuts))[: n - 1]
    width = _width(tokenizer_json, end_id)

    def unpack(batches):
        offset = 0
        for part in parts(batches):
            ids = part.column("ids").to_pylist()
            counts = np.array([len(x) // np.dtype(width).itemsize for x in ids], np.int64)
            flat = np.frombuffer(b"".join(ids), width).astype(np.int32)
            columns = [
                part.column("doc_id"), pa.array(offset + np.cumsum(counts) - counts), lists(flat, counts, pa.int32()),
            ]
            yield pa.record_batch(columns, ["doc_id", "offset", "ids"])
            offset += int(counts.sum())

    rows = _encoded(docs, tokenizer_json, end_id, plain_specials, cuts).repartitionById(n, F.col("place"))
    rows = rows.select("doc_id", "ids").sortWithinPartitions("doc_id", "ids").mapInArrow(unpack, SCHEMA)
    options = {"compression": "zstd", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id"}
    with small_batches(spark):
        rows.write.mode("overwrite").options(**options, **{"orc.bloom.filter.fpp": "0.01"}).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it, over all files), ids; of the given documents only, if any are given
    (found through statistics and Bloom filters)."""
    rows = spark.read.schema(SCHEMA).orc(path).select("*", F.col("_metadata.file_name").alias("file"))
    # one row a file: the running sum over files is small
    files = rows.groupBy("file").agg(
        F.max(F.struct("offset", F.size("ids").alias("n"))).alias("last")
    ).select("file", (F.col("last.offset") + F.col("last.n")).alias("held"))
    listed = files.agg(F.array_sort(F.collect_list(F.struct("file", "held"))).alias("all"))
    bases = listed.select(
        F.explode(
            F.expr(
                "transform(all, (x, i) -> struct(x.file as file, aggregate(slice(all, 1, i), 0L, (a, y) -> a + y.held) as base))"
            )
        ).alias("f")
    ).select("f.*")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(bases), "file").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "ids",
    )


def summary(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens returns."""

    def run(batches):
        for batch in parts(batches):
            ids = batch.column("ids")
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            counts = np.array([len(x) for x in ids], np.int64)
            ends = np.cumsum(counts)
            sums = [zlib.crc32(flat[e - c : e].tobytes()) for e, c in zip(ends, counts, strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("start"), pa.array(counts), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
