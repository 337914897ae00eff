"""Words of many texts at once, as numpy arrays over one byte buffer: no Python object per word."""

from __future__ import annotations

import sys
import types

import numpy as np
import pandas as pd
import pyarrow as pa

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: All but letters, digits and bytes of characters beyond ASCII.
MARKS = np.ones(256, bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Bytes that a memo holds, about.
MEMO_BYTES = 48 << 20
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_K1, _K2, _K3 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def byte_view(column: pa.Array, copy: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes (with eight zero bytes behind them) and the n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    if where is None or not len(column):
        return np.zeros(8, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    if not copy:
        return np.zeros(0, np.uint8), offsets - first
    out = np.zeros(last - first + 8, np.uint8)
    if last > first:
        out[:-8] = np.frombuffer(data, np.uint8)[first:last]
    return out, offsets - first


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _K1
    x ^= x >> U64(29)
    x *= _K2
    x ^= x >> U64(32)
    return x


def hash_spans(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step; buf ends in eight spare bytes."""
    view = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    h = (lengths.astype(U64) + U64(seed)) * _K3
    if not len(starts):
        return h
    h = mix(h ^ (view[starts] & _MASK[np.minimum(lengths, 8)]))
    live, done = np.flatnonzero(lengths > 8), 0
    while len(live):
        done += 8
        left = lengths[live] - done
        h[live] = mix(h[live] ^ (view[starts[live] + done] & _MASK[np.minimum(left, 8)]))
        live = live[left > 8]
    return h


def word_spans(
    buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = WHITE,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words (runs without white space, or without bytes of `gap`), and each text's first word
    (n + 1 entries)."""
    n = len(buf) - 8
    white = gap[buf[:n]]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = ~white
    begin[1:] &= white[:-1] | edge[1:n]
    end = ~white
    end[:-1] &= white[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1 - starts, np.searchsorted(starts, offsets)


def worker_value(name: str, make):
    """What make() returns, made once in a Python worker for all its tasks; functions travel by value, so it hangs on a
    module of its own."""
    home = sys.modules.setdefault("stratalog_worker", types.ModuleType("stratalog_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def worker_memo(name: str, kind: type) -> Memo:
    """A memo that all tasks of a Python worker share, one task at a time."""
    return worker_value(name, lambda: Memo(kind))


def wide_white(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space, that beyond ASCII included (Unicode's White_Space)."""
    white = WHITE[buf]
    at = np.flatnonzero((buf >= 0xC2) & (buf <= 0xE3))  # first bytes of what is looked for are C2 and E1 to E3
    if not len(at):
        return white
    spare = np.append(buf[at[0] :], np.zeros(2, np.uint8))
    a, b, c = (spare[at - at[0] + k] for k in range(3))
    two = at[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
    # U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
    spaces = (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)
    three = at[
        ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x80) & (c >= 0x80) & spaces)
        | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    ]
    for k in range(2):
        white[two + k] = True
    for k in range(3):
        white[three + k] = True
    return white


def lead_spans(
    buf: np.ndarray, offsets: np.ndarray, space_only: bool = False, white: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like word_spans, but each span takes the white space before it along (that beyond ASCII, too), so that the spans of a
    text join to the text."""
    n = len(buf) - 8
    if white is None:
        white = buf[:n] == 0x20 if space_only else wide_white(buf[:n])
    begin = white.copy()
    begin[1:] &= ~white[:-1]
    inner = offsets[offsets < n]
    begin[inner] = True
    starts = np.flatnonzero(begin)
    return starts, np.diff(np.append(starts, n)), np.searchsorted(starts, offsets)


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists of these lengths: of each element its list, and its place in the list."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the elements of spans of a flat array, span after span."""
    some = counts > 0
    starts, counts = starts[some], counts[some]
    if not len(starts):
        return np.zeros(0, np.int64)
    step = np.ones(int(counts.sum()), np.int64)
    step[0] = starts[0]
    step[np.cumsum(counts)[:-1]] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(step, out=step)


def lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, kind),
    )


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `width` words (of the whole sequence, if it is shorter), and their number by text."""
    n = np.diff(first)
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    at = gather(first[:-1], counts)
    span = np.repeat(np.minimum(n, width), counts)
    h = mix(span.astype(U64) * _K3)
    for j in range(width):
        live = span > j
        if live.all():
            h = mix(h ^ words[at + j])
        else:
            h[live] = mix(h[live] ^ words[at[live] + j])
    return h, counts


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting: faster on 64-bit hashes than numpy's own way)."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def distinct_by_text(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, flat, and their number by text."""
    bounds = np.concatenate([[0], np.cumsum(counts)])
    parts = [distinct(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return (np.concatenate(parts) if parts else hashes[:0]), np.array([len(p) for p in parts], np.int64)


class Memo:
    """Results for words seen before, by hash: look(hashes) asks `make` only for the new ones.

    make(indices into the hashes) returns (flat values, number of values of each).  What it holds stays within `limit`
    bytes; beyond that it starts anew, and a word of more than LONG values isn't kept at all, neither of which changes a
    result.
    """

    #: Values of the longest word that is kept.
    LONG = 256

    def __init__(self, kind: type, limit: int = MEMO_BYTES):
        self.kind, self.limit = kind, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts, self.counts = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 10, self.kind), 0

    def held(self) -> int:
        return self.flat.nbytes + 24 * len(self.keys)

    def _put(self, flat: np.ndarray) -> None:
        """Appends values; the room doubles, so that what is there is copied seldom."""
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(self.used, 2 * len(flat)), self.kind)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def look(self, hashes: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """Flat values of all the words, in order, and the number of values of each word."""
        back, keys = pd.factorize(hashes)
        if self.held() > self.limit:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        starts, counts = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        starts[known], counts[known] = self.starts[at[known]], self.counts[at[known]]
        base, fresh = self.used, np.zeros(0, self.kind)
        if len(new):
            new = new[np.argsort(keys[new])]
            first = np.empty(len(keys), np.int64)
            first[back[::-1]] = np.arange(len(back) - 1, -1, -1)
            fresh, counts[new] = make(first[new])
            starts[new] = base + np.cumsum(counts[new]) - counts[new]
            self._put(fresh)
        sizes = counts[back]
        out = self.flat[gather(starts[back], sizes)]
        if len(new):
            short = counts[new] <= self.LONG
            if not short.all():  # the long ones give way
                self.used = base
                kept = fresh[gather(starts[new[short]] - base, counts[new[short]])]
                new = new[short]
                starts[new] = base + np.cumsum(counts[new]) - counts[new]
                self._put(kept)
            at = at[new]
            self.keys, self.starts, self.counts = np.insert(self.keys, at, keys[new]), np.insert(
                self.starts, at, starts[new],
            ), np.insert(self.counts, at, counts[new])
        return out, sizes


def pack(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each text's values as the bytes of a uint32 array."""
    return pa.array([x.tobytes() for x in np.split(flat.astype(np.uint32), np.cumsum(counts)[:-1])], pa.binary())


def per_text(owner: np.ndarray, values: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values (below 2**32) of each text, flat by text, and their number by text."""
    both = np.sort(owner.astype(U64) << U64(32) | values.astype(U64))
    if len(both):
        both = both[np.append(True, both[1:] != both[:-1])]
    return (both & U64(0xFFFFFFFF)).astype(np.int64), np.bincount((both >> U64(32)).astype(np.int64), minlength=texts)
