"""Benchmark decontamination: pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces; a passage within the budget leaves at least one of
them as it is.  One automaton finds the exact hits of all pieces, and Myers' bit-parallel distance (1999) verifies each
place that a hit points to.  Texts are compared as lower-cased letters and digits with single spaces between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_text, prepare, stored

#: Edits allowed for each character of an item.
RATE = 0.07
#: Characters of items that one pass over the documents searches for; more items take more passes.
BLOCK = 4_000_000
_GAP = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their places; one piece for each character at most."""
    n = min(budget + 1, len(item))
    return [(j * len(item) // n, item[j * len(item) // n : (j + 1) * len(item) // n]) for j in range(n)]


def distances(pattern: str, text: str, anchored: bool = False) -> Iterator[int]:
    """After each character of text: the least edit distance of pattern to a part of text that ends there (and begins
    anywhere, or, if anchored, at the beginning)."""
    size = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    every, last, score = (1 << size) - 1, 1 << size - 1, size
    up, down, carry = every, 0, int(anchored)
    for c in text:
        same = masks.get(c, 0)
        x = same | down
        diagonal = ((same & up) + up ^ up) | same
        right = down | ~(diagonal | up) & every
        left = up & diagonal
        if right & last:
            score += 1
        elif left & last:
            score -= 1
        right = (right << 1 | carry) & every
        left = left << 1 & every
        up = left | ~(x | right) & every
        down = right & x
        yield score


def locate(item: str, text: str, budget: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the part of text nearest to item, the first of equal ones; None beyond the budget."""
    best, end = min(((d, e) for e, d in enumerate(distances(item, text), 1)), default=(budget + 1, 0))
    if best > budget:
        return None
    back = text[:end][::-1][: len(item) + budget]
    start = min(((d, -e) for e, d in enumerate(distances(item[::-1], back, anchored=True), 1)), default=(0, 0))[1]
    return best, end + start, end


class Searcher:
    def __init__(self, items: list[tuple[str, list[int]]], rate: float):
        self.items = [(text, ids, int(rate * len(text))) for text, ids in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (text, _, budget) in enumerate(self.items):
            for at, piece in pieces(text, budget):
                found.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the nearest passage for each item that the text holds."""
        if not self.items or not text:
            return []
        lines: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                lines.setdefault(n, set()).add(end + 1 - size - at)
        out = []
        for n, begins in lines.items():
            item, ids, budget = self.items[n]
            best = None
            windows: list[list[int]] = []
            for b in sorted(begins):  # a passage begins within the budget of where a hit says
                if windows and b - budget <= windows[-1][1]:
                    windows[-1][1] = b + len(item) + budget
                else:
                    windows.append([max(0, b - budget), b + len(item) + budget])
            for a, e in windows:
                got = locate(item, text[a:e], budget)
                if got and (best is None or got[0] < best[0]):
                    best = got[0], a + got[1], a + got[2]
            if best:
                out += [(i, *best) for i in ids]
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, start, end: each document and item of which the document holds a passage with at most
    rate * length edits; start and end count characters of the document's plain() text, for the nearest passage.

    Items are sent to the executors in blocks of BLOCK characters, one pass over the documents each; of more than one
    block the rows found are stored, and the block is dropped before the next one is sent.  Null or empty texts
    hold nothing, empty items are held by nothing; repeated items and documents give a row each; an item that is shorter
    than 1 / rate must be met exactly; empty tables give no rows; further columns are left out.
    """
    prepare()
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, item_id long, distance int, start long, end long"
    found: list[DataFrame] = []

    def search(items: dict[str, list[int]]) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(sorted(items.items()))

        def make():
            searcher = Searcher(shared.value, rate)

            def step(part: pa.RecordBatch) -> pa.RecordBatch:
                rows = [
                    (doc, *hit)
                    for doc, text in zip(
                        part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True,
                    )
                    for hit in searcher.search(plain(text))
                ]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                return pa.record_batch(
                    [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                    ["doc_id", "item_id", "distance", "start", "end"],
                )

            return step

        return map_text(docs, "text", schema, make), shared

    for block, last in _with_last(blocks(benchmark)):
        rows, sent = search(block)
        if last and not found:
            return rows
        found.append(stored(rows, "leaks"))
        sent.destroy()
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def _with_last(items: Iterator) -> Iterator[tuple]:
    """Each item, and whether it is the last one."""
    now = next(items, None)
    while now is not None:
        after = next(items, None)
        yield now, after is None
        now = after


def blocks(benchmark: DataFrame) -> Iterator[dict[str, list[int]]]:
    """The plain() texts of the items and their ids, BLOCK characters at a time."""
    block: dict[str, list[int]] = {}
    held = 0
    for row in benchmark.select(
        F.col("item_id").cast("long"), "text",
    ).where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if not (text := plain(row["text"])):
            continue
        if held and held + len(text) > BLOCK:
            yield block
            block, held = {}, 0
        held += len(text) if text not in block else 0
        block.setdefault(text, []).append(row["item_id"])
    if block:
        yield block


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """All columns of the documents that hold no passage of the benchmark.  Each row goes or stays by its own text; its
    id may be null or repeated.  Each block of items is one pass over the rows that the ones before left."""
    prepare()

    def without(docs: DataFrame, items: dict[str, list[int]]) -> tuple[DataFrame, Broadcast]:
        shared = docs.sparkSession.sparkContext.broadcast(sorted(items.items()))

        def make():
            searcher = Searcher(shared.value, rate)
            return lambda part: part.filter(
                pa.array([not searcher.search(plain(text)) for text in part.column("text").to_pylist()], pa.bool_())
            )

        return map_text(docs, "text", docs.schema, make), shared

    held: list[DataFrame] = []
    for block, last in _with_last(blocks(benchmark)):
        docs, sent = without(docs, block)
        if not last:
            docs = stored(docs, "clean")
            sent.destroy()
            discard(*held)
            held = [docs]
    return docs
