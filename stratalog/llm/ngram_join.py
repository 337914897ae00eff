"""N-gram Jaccard join: exact similarity classes of documents by their word shingles.

The distance 1 - Jaccard is a metric, and the join works in that metric space:

1. Census.  A document can only have a partner if at least the required share of its shingles occurs elsewhere.
   Shingles are counted over all documents (31 bits of hash inside hash buckets; a collision only keeps a document
   for the exact steps), each map task adding up its own first, so that a shingle that every document has is one entry
   a task.  What remains is counted again, and each document's shingles are put in order, the rarest first: a linked
   pair shares one among the first n - ceil(t n) + 1 of both.
2. Pivots.  The document at such a shingle with the smallest share of shingles of its own is the pivot of all others
   there, so that both ends of every link are members of a common pivot's region.  Regions inside another are dropped.
3. Regions.  A region of few members is joined in one task.  In a larger one, pivots are chosen, and their distances to
   all members are found part by part; members that are linked to a pivot follow it.  The others go to the Voronoi region
   of their nearest pivot, and boundary documents also to each other region whose triangle-inequality window they are in;
   those regions are joined in turn, by the same step.
4. Components of the links, by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_small, map_text, prepare, slices, stored, trim
from .components import components
from .textvec import LOWER, U64, byte_view, distinct_by_text, gather, hash_spans, lists, shingle_hashes, word_spans

WIDTH, PERCENT = 5, 75
#: Members of a region that one task joins; beyond SPLIT, a region's pivots are compared with its parts first.
LEAF, SPLIT = 4096, 256
#: Pivots of one step inside a task, and of one step over the parts of a region.
PIVOTS, SPREAD = 8, 16
#: Steps over a region; what is larger than LEAF after them is joined block by block.
DEPTH = 4
#: Shingles of a census bucket: the first size up to BUCKETS buckets, then the second, which a task's memory bounds.
BUCKET, BUCKETS, FULL_BUCKET = 1 << 20, 4096, 1 << 24
#: Shingles that a census task adds up before it passes them on (more, if there are many buckets to fill), and documents.
CHUNK, FULL_CHUNK, CHUNK_DOCS = 1 << 21, 1 << 24, 60_000
NEW, LOW = np.uint32(1 << 31), np.uint32((1 << 31) - 1)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = byte_view(column)
    buf[:-8] = LOWER[buf[:-8]]
    starts, lengths, first = word_spans(buf, offsets)
    return distinct_by_text(*shingle_hashes(hash_spans(buf, starts, lengths), first, width))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least size of an intersection with any partner: ceil(percent/100 n)."""
    return -(-n * percent // 100)


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, and a 128-bit digest of the set (null for an empty set)."""

    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            flat, counts = shingle_sets(part.column("text"), width)
            ends = np.cumsum(counts)
            sums = [
                xxhash.xxh3_128_digest(flat[e - c : e].tobytes()) if c else None
                for e, c in zip(ends, counts, strict=True)
            ]
            return pa.record_batch(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.binary())],
                ["doc_id", "n_shingles", "digest"],
            )

        return step

    return map_text(
        docs.select(F.col("doc_id").cast("long"), "text"), "text", "doc_id long, n_shingles long, digest binary", make,
    )


# --- census


def census_buckets(total: int) -> int:
    """Buckets for so many shingles: it depends on them alone, not on the number of partitions."""
    return max(1, min(-(-total // BUCKET), BUCKETS), -(-total // FULL_BUCKET))


_ROW = [
    ("bucket", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("once", pa.binary()),
    ("whose", pa.binary()), ("more", pa.binary()),
]


def census_rows(docs: DataFrame, total: int, width: int = WIDTH, whole: bool = False) -> DataFrame:
    """What each chunk of documents has in each bucket: bucket, chunk, ids and sizes (in one row a chunk), once (shingles
    in the order of their documents, the top bit marking a document's first one), whose (the places of those documents
    in the chunk), more (shingles that several of the chunk's documents have, once each; if `whole`, they are in `once`)."""
    buckets = census_buckets(total)
    held = min(FULL_CHUNK, max(CHUNK, 256 * buckets))
    bounds = np.array([b * (1 << 64) // buckets for b in range(1, buckets)], U64)

    def emit(ids: list, flats: list, counts: list, place: int) -> Iterator[pa.RecordBatch]:
        ids, flat, counts = np.concatenate(ids), np.concatenate(flats), np.concatenate(counts)
        who = np.repeat(np.arange(len(ids), dtype=np.uint16), counts)
        order = np.argsort(flat)
        flat, who = flat[order], who[order]
        head = np.append(True, flat[1:] != flat[:-1])[: len(flat)]
        alone = np.ones(len(flat), bool) if whole else head & np.append(head[1:], True)[: len(flat)]
        cuts = np.concatenate([[0], np.searchsorted(flat, bounds), [len(flat)]])
        chunk = xxhash.xxh3_64_intdigest(ids.tobytes(), place) >> 1
        short = flat.astype(np.uint32) & LOW
        rows = []
        for b in range(buckets):
            s = slice(cuts[b], cuts[b + 1])
            if b and cuts[b] == cuts[b + 1]:
                continue
            mine, owner = short[s][alone[s]], who[s][alone[s]]
            order = np.argsort(owner, kind="stable")
            mine, owner = mine[order], owner[order]
            first = np.append(True, owner[1:] != owner[:-1])[: len(owner)]
            mine[first] |= NEW
            rows.append(
                (
                    b, chunk, b"" if b else ids.tobytes(), b"" if b else counts.astype(np.uint32).tobytes(),
                    mine.tobytes(), owner[first].tobytes(), short[s][head[s] & ~alone[s]].tobytes(),
                )
            )
        for at in range(0, len(rows), 64):
            yield pa.record_batch(
                [pa.array(c, t) for c, (_, t) in zip(zip(*rows[at : at + 64], strict=True), _ROW, strict=True)],
                [n for n, _ in _ROW],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flats, counts, load, place = [], [], [], 0, 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, "text"):
                flat, n = shingle_sets(part.column("text"), width)
                ids.append(part.column("doc_id").to_numpy(zero_copy_only=False))
                flats.append(flat)
                counts.append(n)
                load += len(flat)
                if load >= held or sum(map(len, ids)) >= CHUNK_DOCS - 10_000:
                    yield from emit(ids, flats, counts, task << 20 | place)
                    ids, flats, counts, load, place = [], [], [], 0, place + 1
        if ids:
            yield from emit(ids, flats, counts, task << 20 | place)
        del ids, flats, counts
        trim()

    table = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return table.mapInArrow(
        count, "bucket int, chunk long, ids binary, sizes binary, once binary, whose binary, more binary",
    )


def _times(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The chunks' lists of a bucket, and all its shingles with their numbers."""
    once = [np.frombuffer(x, np.uint32) for x in rows["once"]]
    keys, times = np.unique(
        np.concatenate([*once, *(np.frombuffer(x, np.uint32) for x in rows["more"])]) & LOW, return_counts=True,
    )
    return once, keys, times


def _sparse(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Where counts aren't 0, and the counts there (8 bits each, or 32 if one needs them)."""
    at = np.flatnonzero(counts)
    some = counts[at]
    return at.astype(np.uint16).tobytes(), some.astype(np.uint8 if some.max(initial=0) < 256 else np.uint32).tobytes()


def _dense(at: bytes, some: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    where = np.frombuffer(at, np.uint16)
    out[where] = np.frombuffer(some, np.uint8 if len(some) == len(where) else np.uint32)
    return out


def _owners(once: np.ndarray, whose: bytes) -> np.ndarray:
    return np.frombuffer(whose, np.uint16)[
        np.cumsum(once >> 31) - 1
    ].astype(np.int64) if len(once) else np.zeros(0, np.int64)


def census(docs: DataFrame, total: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Ids of the documents of which enough shingles occur in other documents, too (all that can have a partner)."""

    def rare(rows: pd.DataFrame) -> pd.DataFrame:
        """For each chunk, how many shingles of each of its documents occur nowhere else."""
        once, keys, times = _times(rows)
        keys = keys[times == 1]
        out = []
        for mine, whose in zip(once, rows["whose"], strict=True):
            at = np.minimum(np.searchsorted(keys, mine & LOW), max(0, len(keys) - 1))
            hit = keys[at] == mine & LOW if len(keys) else np.zeros(len(mine), bool)
            out.append(_sparse(np.bincount(_owners(mine, whose)[hit])))
        return pd.DataFrame(
            {
                "chunk": rows["chunk"], "ids": rows["ids"], "sizes": rows["sizes"], "place": [a for a, _ in out],
                "lone": [c for _, c in out],
            }
        )

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.loc[rows["sizes"].str.len().idxmax()]
        ids, n = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        lone = sum(_dense(a, c, len(ids)) for a, c in zip(rows["place"], rows["lone"], strict=True))
        return pd.DataFrame({"doc_id": ids[(n > 0) & (n - lone >= needed(n, percent))]})

    found = census_rows(docs, total, width).groupBy("bucket").applyInPandas(
        rare, "chunk long, ids binary, sizes binary, place binary, lone binary",
    )
    return found.groupBy("chunk").applyInPandas(keep, "doc_id long").distinct()


def prefixes(docs: DataFrame, total: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, lone (how many in a thousand of its shingles occur nowhere else), tokens: of each document's first
    n - ceil(percent/100 n) + 1 shingles, rarest first, those that occur in other documents (as bucket and 31 bits of
    hash).  Both ends of a link have one in common."""

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        once, keys, times = _times(rows)
        out = []
        for mine, whose in zip(once, rows["whose"], strict=True):
            owner, n = _owners(mine, whose), times[np.searchsorted(keys, mine & LOW)]
            often = n > 1
            out.append(
                (
                    *_sparse(np.bincount(owner[~often])), owner[often].astype(np.uint16).tobytes(),
                    (mine & LOW)[often].tobytes(), np.minimum(n[often], 65_535).astype(np.uint16).tobytes(),
                )
            )
        columns = dict(zip(("place", "lone", "whose", "token", "times"), zip(*out, strict=True), strict=True))
        return pd.DataFrame(
            {
                "bucket": rows["bucket"], "chunk": rows["chunk"], "ids": rows["ids"], "sizes": rows["sizes"],
                **{k: list(v) for k, v in columns.items()}
            }
        )

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.loc[rows["sizes"].str.len().idxmax()]
        ids, n = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        lone = sum(_dense(a, c, len(ids)) for a, c in zip(rows["place"], rows["lone"], strict=True))
        owner = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["whose"]]).astype(np.int64)
        token = np.concatenate(
            [
                np.frombuffer(x, np.uint32).astype(np.int64) | int(b) << 31
                for b, x in zip(rows["bucket"], rows["token"], strict=True)
            ]
        )
        times = np.concatenate([np.frombuffer(x, np.uint16) for x in rows["times"]])
        token = token[np.lexsort((token, times, owner))]
        counts = np.bincount(owner, minlength=len(ids))
        take = np.clip(n - needed(n, percent) + 1 - lone, 0, counts)
        flat = token[gather(np.cumsum(counts) - counts, take)]
        some = np.flatnonzero(take)
        return pd.DataFrame(
            {
                "doc_id": ids[some], "lone": lone[some] * 1000 // n[some],
                "tokens": pd.Series(np.split(flat, np.cumsum(take[some])[:-1]) if len(some) else [], dtype=object),
            }
        )

    found = census_rows(docs, total, width, whole=True).groupBy("bucket").applyInPandas(
        spread,
        "bucket int, chunk long, ids binary, sizes binary, place binary, lone binary, whose binary, token binary, times binary",
    )
    return found.groupBy("chunk").applyInPandas(first, "doc_id long, lone long, tokens array<long>")


def sets_of(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    def make():
        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            flat, counts = shingle_sets(part.column("text"), width)
            return pa.record_batch(
                [part.column("doc_id"), lists(flat.view(np.int64), counts, pa.int64())], ["doc_id", "tokens"],
            )

        return step

    return map_text(docs.select(F.col("doc_id").cast("long"), "text"), "text", "doc_id long, tokens array<long>", make)


# --- regions


class Region:
    """Sets of one region: distances from one member to others through an inverted index."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sets)), self.n)
        _, token = np.unique(flat, return_inverse=True)
        order = np.argsort(token, kind="stable")
        self.posted = owner[order]
        self.bounds = np.searchsorted(token[order], np.arange(token.max() + 2 if len(token) else 1))
        self.own = np.split(token, np.cumsum(self.n)[:-1]) if sets else []
        self.up = np.arange(len(sets))

    def root(self, x: np.ndarray) -> np.ndarray:
        while not np.array_equal(y := self.up[x], x):
            x = y
        return x

    def link(self, members: np.ndarray) -> None:
        roots = np.unique(self.root(members))
        self.up[roots] = roots[0]

    def near(self, pivot: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances from a pivot to members, and which of them it links with."""
        posted = np.concatenate(
            [self.posted[self.bounds[t] : self.bounds[t + 1]] for t in self.own[pivot]]
        ) if self.n[pivot] else self.posted[:0]
        both = np.bincount(posted, minlength=len(self.n))[members]
        union = self.n[pivot] + self.n[members] - both
        return 1 - both / np.maximum(union, 1), (100 * both >= self.percent * union) & (both > 0)

    def resolve(self) -> np.ndarray:
        """Joins members that are linked, directly or through others; returns each member's smallest fellow."""
        gap = 1 - self.percent / 100 + 1e-9
        stack = [np.arange(len(self.n))]
        while stack:
            region = stack.pop()
            roots = self.root(region)
            names, sizes = np.unique(roots, return_counts=True)
            if len(names) < 2:
                continue
            # Two members of the largest component need no comparison: every pair of interest has an end outside it.
            pivots = region[roots != names[sizes.argmax()]][:PIVOTS]
            far = np.empty((len(pivots), len(region)))
            for i, p in enumerate(pivots):
                far[i], linked = self.near(p, region)
                self.link(np.append(region[linked], p))
            rest = ~np.isin(region, pivots)  # all pairs of the pivots are settled
            region, far = region[rest], far[:, rest]
            if not len(region):
                continue
            closest, least = far.argmin(0), far.min(0)
            core, parts = least < 3 * gap, []
            for i in range(len(pivots)):
                mine = core & (closest == i)
                if mine.any():
                    window = (far[i] <= least + 2 * gap) & (far[i] <= far[i][mine].max() + gap)
                    parts.append(region[mine | window])
            if (~core).any():  # far from every pivot, with those near enough to be linked with one that is
                parts.append(region[least >= 2 * gap])
            # Regions that overlap too much to gain anything stay one, less the pivots.
            stack += parts if sum(map(len, parts)) <= 1.2 * len(region) else [region]
        return self.root(np.arange(len(self.n)))


def solver(percent: int):
    """For the rows (doc_id, tokens, main) of a region: edges that connect what its links connect.  The rows of `main`
    are known to be connected."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["doc_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, frame = ids[order], frame.iloc[order]
        region = Region([np.asarray(t, np.int64) for t in frame["tokens"]], percent)
        for i in np.flatnonzero(ids[1:] == ids[:-1]):
            region.link(np.array([i, i + 1]))
        if (main := frame["main"].to_numpy(bool)).any():
            region.link(np.flatnonzero(main))
        root = region.resolve()
        least = pd.Series(ids).groupby(root).transform("min").to_numpy()
        return pd.DataFrame({"u": ids, "v": least})[ids != least]

    return solve


def distances(percent: int):
    """For a part of a region, and its pivots: the distance of each member to each pivot, and the bits of the pivots that
    it is linked with (and the bit SPREAD, if it is a main member)."""

    def measure(frame: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        pivots = pivots.sort_values("slot")
        held = [np.asarray(t, np.int64) for t in pivots["tokens"]]
        words = np.unique(np.concatenate(held))
        has = np.zeros((len(words) + 1, len(held)), np.int32)  # the last row is for shingles that no pivot has
        for i, t in enumerate(held):
            has[np.searchsorted(words, t), i] = 1
        sets = [np.asarray(t, np.int64) for t in frame["tokens"]]
        n = np.array([len(t) for t in sets], np.int64)
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        at[words[at] != flat] = len(words)
        both = np.add.reduceat(has[at], np.cumsum(n) - n, axis=0).astype(np.int64)
        union = n[:, None] + np.array([len(t) for t in held]) - both
        linked = (100 * both >= percent * union) & (both > 0)
        mask = (linked << np.arange(len(held))).sum(1) | frame["main"].to_numpy(np.int64) << SPREAD
        far, ids = 1 - both / union, pivots["doc_id"].to_numpy()
        own = ((frame["doc_id"].to_numpy()[:, None] == ids) & (far == 0)).any(1)
        lead = np.where(linked.any(1), ids[linked.argmax(1)], frame["doc_id"].to_numpy())
        return pd.DataFrame(
            {
                "region": frame["region"], "doc_id": frame["doc_id"], "rank": frame["rank"], "main": frame["main"],
                "pivot": own, "lead": lead, "mask": mask, "far": list(far),
            }
        )

    return measure


def scored(rows: DataFrame, large: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the members of the regions in `large` (region, parts) what distances() says; and the pivots (region, names).

    The pivots are the members outside the main component that come first by rank (those with the smallest share of
    shingles of their own, which most others are near), one of each of SPREAD hash classes.  Their sets go to each of the
    region's parts, so that no task sees a whole region."""
    slot = F.pmod(F.xxhash64("doc_id", "region"), F.lit(SPREAD)).cast("int").alias("slot")
    chosen = rows.where("not main").groupBy("region", slot).agg(F.min_by("doc_id", "rank").alias("doc_id"))
    # (of repeated ids with unlike sets one set)
    held = join_small(
        sets, chosen, ["doc_id"], "inner",
    ).groupBy("region", "slot", "doc_id").agg(F.max("tokens").alias("tokens"))
    held = stored(held.join(large, "region"), "pivots")
    names = held.groupBy("region").agg(
        F.sort_array(F.collect_list(F.struct("slot", "doc_id"))).alias("p")
    ).select("region", F.col("p.doc_id").alias("names"))
    each = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    met = join_small(
        sets, rows.join(large, "region"), ["doc_id"], "inner",
    ).withColumn("part", part).groupBy("region", "part").cogroup(each.groupBy("region", "part"))
    made = stored(
        met.applyInPandas(
            distances(percent),
            "region string, doc_id long, rank long, main boolean, pivot boolean, lead long, mask long, far array<double>",
        ),
        "scored",
    )
    names = stored(names, "names")
    discard(held)
    return made, names


def leading(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each region the mask of its main component (that of the main members, or the one with the most linked members),
    and edges between pivots that are connected.

    `near` holds for each pivot, and last for the main members, the union of the masks that have its bit."""
    for frame in rows:
        out = []
        for region, names, near, counts in zip(
            frame["region"], frame["names"], frame["near"], frame["counts"], strict=True,
        ):
            masks = [int(x) for x in near]
            for i in range(len(masks)):  # what meets in one mask is connected
                for j in range(len(masks)):
                    if masks[j] >> i & 1:
                        masks[j] |= masks[i]
            best = SPREAD if masks[SPREAD] else max(
                range(SPREAD), key=lambda i: sum(c for k, c in enumerate(counts) if masks[i] >> k & 1),
            )
            heads = [(names[i], names[(masks[i] & -masks[i]).bit_length() - 1]) for i in range(len(names)) if masks[i]]
            out.append((region, masks[best], [u for u, v in heads if u != v], [v for u, v in heads if u != v]))
        yield pd.DataFrame(out, columns=["region", "mains", "us", "vs"])


def dealt(score: DataFrame, names: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The edges that a step over large regions has found, and the members of the regions that it leaves to join."""
    gap = 1 - percent / 100 + 1e-9
    has = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    unions = [F.coalesce(F.bit_or(F.when(has(i), F.col("mask"))), F.lit(0).cast("long")) for i in range(SPREAD + 1)]
    sums = score.groupBy("region").agg(
        F.array(*unions).alias("near"), F.array(*(F.count_if(has(i)) for i in range(SPREAD + 1))).alias("counts"),
    )
    mains = stored(
        sums.join(names, "region").mapInPandas(leading, "region string, mains long, us array<long>, vs array<long>"),
        "mains",
    )
    among = mains.select(F.explode(F.arrays_zip("us", "vs")).alias("e")).select(
        F.col("e.us").alias("u"), F.col("e.vs").alias("v"),
    )
    edges = stored(
        score.where("lead <> doc_id").select(F.col("doc_id").alias("u"), F.col("lead").alias("v")).union(among),
        "links",
    )
    rest = score.join(mains.select("region", "mains"), "region").where("not pivot")  # all pairs of the pivots are settled
    rest = rest.withColumn("main", F.expr("mask & mains <> 0")).withColumn("least", F.array_min("far"))
    # the region of a member outside the main component: its nearest pivot's, or the one of all that are far from each
    home = F.when(
        F.col("least") < 3 * gap, F.array_position("far", F.col("least")) - 1,
    ).otherwise(F.lit(SPREAD)).cast("int")
    rest = rest.withColumn("home", F.when(~F.col("main"), home))
    reach = rest.where("home is not null").groupBy("region", "home").agg(
        F.min(F.expr("get(far, home)")).alias("low"), F.max(F.expr("get(far, home)")).alias("high"),
    )
    reach = reach.groupBy("region").agg(
        F.collect_list(
            F.struct("home", F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(1.0)).alias("high"))
        ).alias("reach")
    )
    inside = F.expr(f"""filter(reach, r -> r.home <=> home or if(r.home = {SPREAD}, least >= {2 * gap},
        far[least(r.home, size(far) - 1)] <= least + {2 * gap} and far[least(r.home, size(far) - 1)] between r.low - {gap} and r.high + {gap}))""")
    left = rest.join(reach, "region").withColumn("to", inside).where("size(to) > 0").select(
        "region", "doc_id", "rank", "main", F.col("to.home").alias("to"),
    )
    # regions that overlap too much to gain anything stay one, less the pivots
    thick = left.groupBy("region").agg(F.sum(F.size("to")).alias("all"), F.count("*").alias("n")).select(
        "region", (F.col("all") > 1.5 * F.col("n")).alias("thick"),
    )
    left = left.join(thick, "region").withColumn(
        "to", F.explode(F.when(F.col("thick"), F.array(F.lit(SPREAD + 1))).otherwise(F.col("to"))),
    )
    left = stored(left.select(F.concat_ws("/", "region", "to").alias("region"), "doc_id", "rank", "main"), "members")
    discard(mains)
    return edges, left


def blocks(rows: DataFrame, large: DataFrame, sets: DataFrame, percent: int, leaf: int) -> DataFrame:
    """Edges of regions that no further pivots make smaller: the members outside the main component, in blocks, with the
    blocks of all members."""
    rows = rows.join(large, "region")
    outside = rows.where("not main").groupBy("region").agg(F.ceil(F.count("*") / leaf).cast("int").alias("blocks"))
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    cut = join_small(sets, rows.join(outside, "region"), ["doc_id"], "inner")
    left = cut.where("not main").withColumn("block", place("blocks")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)),
    )
    right = cut.withColumn("part", place("parts")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)),
    ).where("main or part <> block or blocks <> parts")
    keep = ["region", "block", "part", "doc_id", "tokens", "main"]
    return left.select(keep).union(right.select(keep)).groupBy("region", "block", "part").applyInPandas(
        solver(percent), "u long, v long",
    )


def regions(
    members: DataFrame, sets: DataFrame, percent: int = PERCENT, leaf: int = LEAF, split: int = SPLIT,
) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (u, v) that connect exactly what the links inside the regions connect, and the tables that hold them;
    members: region, doc_id, rank (an order in which they may become pivots), main (known to be connected)."""
    out, made, depth = [], [], 0
    while True:
        most = leaf if depth else min(split, leaf)
        sizes = members.groupBy("region").agg(
            F.count("*").alias("size"), F.count_if(~F.col("main")).alias("open"),
        ).where("size > 1 and open > 0")
        large = stored(
            sizes.where(F.col("size") > most).select("region", F.ceil(F.col("size") / most).cast("int").alias("parts")),
            "large",
        )
        some = sizes.where(F.col("size") <= most).select("region")
        small = join_small(
            sets, members.join(some, "region"), ["doc_id"], "inner",
        ).groupBy("region").applyInPandas(solver(percent), "u long, v long")
        out.append(stored(small, "links"))
        if not large.limit(1).count():
            break
        mine = join_small(members, large.select("region"), ["region"], "left_semi")
        if depth == DEPTH:
            out.append(stored(blocks(mine, large, sets, percent, leaf), "links"))
            break
        score, names = scored(mine, large, sets, percent)
        found, members = dealt(score, names, percent)
        out.append(found)
        discard(score, names, large, *made)
        made, depth = [members], depth + 1
    discard(large, *made)
    return reduce(DataFrame.union, out), out


def cells_of(short: DataFrame) -> DataFrame:
    """region, doc_id, rank, main (false) of the documents in `short` (prefixes()): both ends of every link are in a
    common region; a stored table."""
    # pivots come first by the share of shingles of their own: copies are nearer to their original than to each other;
    # two documents of one rank, which hashes make unlikely, would share a region
    rank = F.expr("lone << 50 | (xxhash64(doc_id) & ((1L << 50) - 1))").alias("rank")
    claims = short.select("doc_id", rank, F.explode("tokens").alias("token"))
    owners = claims.groupBy("token").agg(
        F.min("rank").alias("cell"), F.count("*").alias("times"),
    ).where("times > 1").select("token", "cell")
    owners = stored(owners, "owners")  # a table of its own, so that the join can split a token that a third of all documents has
    members = stored(claims.join(owners, "token").select("cell", "doc_id", "rank").distinct(), "members")
    discard(owners)
    # A document's home is the first of its cells.  If all members of a cell have one home, other than the cell, they meet
    # there, and the cell adds nothing.
    home = members.groupBy("doc_id").agg(F.min("cell").alias("home"))
    cells = members.join(home, "doc_id").groupBy("cell").agg(
        F.count("*").alias("size"), F.min("home").alias("low"), F.max("home").alias("high"),
    )
    cells = cells.where("size > 1 and (low <> high or low = cell)").select("cell")
    kept = stored(
        members.join(cells, "cell").select(
            F.col("cell").cast("string").alias("region"), "doc_id", "rank", F.lit(False).alias("main"),
        ),
        "members",
    )
    discard(members)
    return kept


def link_counts(
    members: DataFrame, sets: DataFrame, weights: DataFrame, percent: int = PERCENT, leaf: int = LEAF,
) -> DataFrame:
    """doc_id, n: how many rows are linked with each document, each set counting as often as `weights` (doc_id, weight) says.

    All members of a region are compared, block by block, and a pair counts in the first region that has both.  The work
    grows with the square of the number of unlike sets in a region, which no index can spare where each pair is to be
    told from the ones that just fail; so classes() does it only if asked to.
    """
    sizes = members.groupBy("region").agg(F.count("*").alias("size")).where("size > 1").select(
        "region", F.ceil(F.col("size") / leaf).cast("int").alias("parts"),
    )
    lists = members.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.col("region").cast("long"))).alias("cells"))
    rows = join_small(
        sets, members.join(sizes, "region").join(lists, "doc_id").join(weights, "doc_id"), ["doc_id"], "inner",
    )
    rows = rows.withColumn(
        "part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"),
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(
        "region", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "doc_id",
        "tokens", "cells", "weight",
    )

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        here, cross = int(frame["region"].iloc[0]), frame["a"].iloc[0] != frame["b"].iloc[0]
        region = Region([np.asarray(t, np.int64) for t in frame["tokens"]], percent)
        everyone, part, weight = np.arange(len(frame)), frame["part"].to_numpy(), frame["weight"].to_numpy()
        earlier = [np.asarray(c, np.int64) for c in frame["cells"]]
        earlier = [c[c < here] for c in earlier]
        names, at = np.unique(np.concatenate(earlier), return_inverse=True)
        also = np.zeros((len(frame), len(names)), np.float32)
        also[np.repeat(everyone, [len(c) for c in earlier]), at] = 1
        total = np.zeros(len(frame), np.int64)
        for i in everyone:
            mine = region.near(i, everyone)[1]
            mine[i] = False
            if cross:
                mine &= part != part[i]
            if len(names):
                mine[mine] = also[mine] @ also[i] == 0  # counted in an earlier region
            total[i] = weight[mine].sum()
        return pd.DataFrame({"doc_id": frame["doc_id"], "n": total})

    return rows.groupBy("region", "a", "b").applyInPandas(
        count, "doc_id long, n long",
    ).groupBy("doc_id").agg(F.sum("n").alias("n"))


def classes(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, leaf: int = LEAF, split: int = SPLIT,
    counts: bool = False,
) -> DataFrame:
    """Similarity classes: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    Two documents link when the Jaccard similarity of their sets is percent/100 or more; words are what stands between
    ASCII white space, A-Z lower-cased.  One row for each input row, repeated ids too (they are one vertex).  A null or
    empty text, or one of white space, has an empty set and links with nothing; so do rows with a null id, whose
    component is null.  A text of fewer than `width` words has its whole sequence as one shingle.  Links inside a
    region's main component aren't listed pair by pair; all links between classes' members are found, none is sampled.

    With `counts`, also n_links: the number of other rows that the document is linked with, copies included (of a repeated
    id with unlike sets, those of all its sets); see link_counts() for what that costs.
    """
    prepare()
    docs = docs.select("doc_id", "text")
    named = stored(digests(docs, width), "digests")
    # copies of a set: their first document stands for them; a table of its own, so that a join with it can be split
    first = named.where("digest is not null and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("n"),
    )
    first = stored(first.where("n > 1").select("digest", "first"), "first")
    copies = named.join(first, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("first"),
    )
    one = copies.where("n_shingles > 0 and doc_id = first").select("doc_id", "n_shingles")
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    once = stored(census(docs, total, width, percent).join(one, "doc_id", "left_semi"), "maybe")
    total = one.join(once, "doc_id", "left_semi").agg(F.sum("n_shingles")).first()[0] or 0
    some = join_small(docs, once, ["doc_id"], "left_semi")
    short = stored(prefixes(some, total, width, percent), "prefixes")
    # an id whose rows have unlike sets is one vertex: it joins the classes of all of them
    ids = copies.where("first is not null").groupBy("doc_id").agg(
        F.min("first").alias("low"), F.max("first").alias("high"),
    ).where("low <> high").select("doc_id")
    ids = stored(ids, "unlike")
    same = join_small(
        copies.where("doc_id <> first"), ids, ["doc_id"], "left_semi",
    ).select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    members = cells_of(short)
    sets = stored(
        sets_of(
            join_small(docs, members.select("doc_id").distinct(), ["doc_id"], "left_semi"), width,
        ).where("size(tokens) > 0"),
        "sets",
    )
    edges, held = regions(members, sets, percent, leaf, split)
    found = stored(components(edges.union(same)), "components")
    out = copies.join(found, copies["first"] == found["id"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "first").alias("component_id"), "first",
    )
    if counts:
        weights = stored(
            copies.where(
                "n_shingles > 0 and first is not null"
            ).groupBy(F.col("first").alias("doc_id")).agg(F.count("*").alias("weight")),
            "weights",
        )
        linked = stored(
            weights.join(link_counts(members, sets, weights, percent, leaf), "doc_id", "left").select(
                F.col("doc_id").alias("first"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            ),
            "counts",
        )
        out = out.join(linked, "first", "left").withColumn(
            "n_links", F.when(F.col("first").isNotNull(), F.coalesce("n_links", F.lit(0))),
        )
        held += [weights, linked]
    out = stored(out.drop("first"), "classes")
    discard(named, first, once, short, ids, members, sets, found, *held)
    return out


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """All columns of one document of each class: the one with the smallest id (of repeated ids, every row)."""
    found = classes(docs, **options).where("doc_id <> component_id").select("doc_id").distinct()
    return join_small(docs, found, ["doc_id"], "left_anti")


__all__ = ["census", "classes", "digests", "keep_one", "link_counts", "prefixes", "regions", "sets_of"]
