"""SentencePiece encoding and decoding in batches: Viterbi over numpy arrays, for unigram and BPE models.

Words (a run of spaces with what follows) that haven't been met before are grouped by length; the words of a group
advance together, position by position.  Hashes of their substrings probe the sorted hashes of the pieces; at each
position the vectorised maximum over the pieces that end there stores a back-pointer.

Unigram models: the score of a path is the sum of its pieces' scores, by word, in 32-bit floats.  (The library sums from
the text's beginning; of paths whose sums differ by no more than rounding it can choose another one.)
BPE models, whose encoding is no path of a greatest sum: a piece scores at a position only if the model itself would leave
it beside the best piece before it; each prefix then has exactly one path, the model's own encoding.

Long words are cut wherever no piece holds the two characters beside each other.  What is still long is cut into chunks
that overlap and advance together, too: a chunk is right from where it agrees with the one before over the length of the
longest piece; where it never does, the positions go one by one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, prepare
from .textvec import U64, byte_view, gather, hash_spans, lead_spans, lists, mix, worker_memo

BASE = U64(0x9E3779B97F4A7C15)
#: Bits of a key that the first look leaves out.
HEAD = U64(44)
NONE, FREE = np.int64(-1), np.int64(1 << 40)
#: Characters of one group of words, about.
GROUP = 1 << 16
#: Words beyond so many characters are cut; pieces of them beyond CHUNK + OVERLAP advance as chunks.
CUT, CHUNK, OVERLAP = 128, 512, 128
#: Fixed values of the model file: kinds of models and of pieces, and the penalty of an unknown character.
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = np.float32(10)


def _fields(data: bytes) -> dict[int, list]:
    """The fields of a protocol-buffers message: numbers, or bytes."""
    out: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        size = {0: 0, 1: 8, 5: 4}.get(kind, -1)
        if kind == 0:
            value: object = number()
        else:
            size = number() if size < 0 else size
            value = data[at : at + size]
            at += size
        out.setdefault(tag >> 3, []).append(value)
    return out


def _kind(model: bytes) -> int:
    """UNIGRAM or BPE; other models, and texts that a model would change before it cuts them, are refused."""
    top = _fields(model)
    trainer, normalizer = (_fields(top[k][-1]) if k in top else {} for k in (2, 3))
    kind = trainer.get(3, [UNIGRAM])[-1]
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"a model of kind {kind}: only unigram and BPE models are known")
    plain = not normalizer.get(
        2, [b""],
    )[-1] and normalizer.get(3, [1])[-1] and not normalizer.get(4, [1])[-1] and normalizer.get(5, [1])[-1]
    if not plain or trainer.get(24, [0])[-1]:
        raise ValueError("a model that normalises texts, or doesn't put a space before them and keep all others")
    if not trainer.get(35, [0])[-1]:
        raise ValueError("a model without byte fallback can't give every text back")
    return kind


def tables(model: bytes) -> dict:
    """What encoding and decoding need of a model: sorted piece keys, merge order, splits, bytes.  Bounded by the vocabulary."""
    kind = _kind(model)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if any("▁" in pieces[i].lstrip("▁") for i in plain):
        raise ValueError("pieces that join words can't be told apart at spaces")
    data = [
        b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
        for i, p in enumerate(pieces)
    ]
    beside = np.unique(
        np.array([ord(a) << 32 | ord(b) for i in plain for a, b in zip(pieces[i], pieces[i][1:])], np.int64)
    )
    both = {
        "kind": kind, "byte0": next(i for i in range(size) if sp.is_byte(i)),
        "data": np.frombuffer(b"".join(data), np.uint8), "sizes": np.array([len(d) for d in data]), "beside": beside,
    }
    if kind == UNIGRAM:
        if any(_fields(x).get(3, [1])[-1] == 4 for x in _fields(model)[1]):
            raise ValueError("user-defined pieces aren't supported")
        scores = np.array([sp.get_score(i) for i in plain], np.float32)
        key, by = _sorted_keys([pieces[i] for i in plain])
        return both | {
            "keys": key, "orders": by, "ids": np.array(plain), "scores": scores,
            "unknown": scores.min() - UNKNOWN_PENALTY, "longest": max(len(pieces[i]) for i in plain),
        }
    # Runs of spaces have one score, below all others, in models of this kind: they are merged last, from the left.
    runs = {len(pieces[i]): i for i in plain if not pieces[i].strip("▁")}
    inner = [i for i in plain if pieces[i].strip("▁") or len(pieces[i]) == 1]
    score = {pieces[i]: sp.get_score(i) for i in inner}
    joined = [sp.get_score(i) for i in inner if len(pieces[i]) > 1]
    if len(set(joined)) < len(joined) or (
        len(runs) > 1 and max(sp.get_score(i) for k, i in runs.items() if k > 1) > min(joined)
    ):
        raise ValueError("merges of equal rank can't be told apart")
    plain = inner
    chars = [i for i in plain if len(pieces[i]) == 1]
    merges = sorted((i for i in plain if len(pieces[i]) > 1), key=lambda i: -score[pieces[i]])
    order = {pieces[i]: k for k, i in enumerate(chars + merges)}
    left, right = np.arange(len(order)), np.arange(len(order))
    pairs, reached = {}, [True] * len(chars)
    for i in merges:
        now, whole = list(pieces[i]), pieces[i]
        while len(now) > 2:
            best = max(range(len(now) - 1), key=lambda k: (score.get(now[k] + now[k + 1], -np.inf), -k))
            if now[best] + now[best + 1] not in score:
                break
            now[best : best + 2] = [now[best] + now[best + 1]]
        fine = len(now) == 2 and now[0] in order and now[1] in order
        reached.append(fine)
        if fine:
            k = order[whole]
            left[k], right[k] = order[now[0]], order[now[1]]
            pairs[order[now[0]] * len(order) + order[now[1]]] = k
    names = [p for p, k in order.items() if reached[k]]
    key, by = _sorted_keys(names)
    keys = np.array(sorted(pairs))
    return both | {
        "keys": key, "orders": np.array([order[p] for p in names])[by], "ids": np.array(chars + merges), "left": left,
        "right": right, "pairs": keys, "merged": np.array([pairs[k] for k in keys]), "runs": runs,
        "longest": max(map(len, names)),
    }


def _sorted_keys(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    key = np.array([_key(np.array([[ord(c) for c in p]], np.uint32))[0] for p in names], U64)
    by = np.argsort(key)
    return key[by], by


def _prefixes(codes: np.ndarray) -> np.ndarray:
    h = np.zeros((len(codes), codes.shape[1] + 1), U64)
    for i in range(codes.shape[1]):
        h[:, i + 1] = h[:, i] * BASE + codes[:, i] + U64(1)
    return h


def _key(codes: np.ndarray) -> np.ndarray:
    """Hash of whole rows of code points."""
    return mix(_prefixes(codes)[:, -1] ^ U64(codes.shape[1]))


class Codec:
    def __init__(self, table: dict):
        self.t, self.memo = table, worker_memo(f"pieces_{xxhash.xxh3_64_hexdigest(table['keys'].tobytes())}", np.int32)
        self.n = len(table["ids"])
        self.heads = np.zeros(1 << 64 - int(HEAD), bool)
        self.heads[table["keys"] >> HEAD] = True
        self.data_at = np.cumsum(table["sizes"]) - table["sizes"]

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the model leaves pieces a and b (merge orders) side by side: takes back merges on either side of the
        border, the latest first, and looks for one across it that would have come before."""
        t = self.t
        fine = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (a < self.n) & (b < self.n))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), FREE)
        while len(live):
            key = a[live] * self.n + b[live]
            at = np.minimum(np.searchsorted(t["pairs"], key), len(t["pairs"]) - 1)
            bad = (t["pairs"][at] == key) & (t["merged"][at] < limit[live])
            fine[live[bad]] = False
            live = live[~bad]
            x, y = a[live], b[live]
            down_x, down_y = t["right"][x], t["left"][y]
            atom_x, atom_y = down_x == x, down_y == y
            use_x = np.where(x > y, ~atom_x, atom_y & ~atom_x)
            go = use_x | ~atom_y
            live, use_x, x, y, down_x, down_y = live[go], use_x[go], x[go], y[go], down_x[go], down_y[go]
            limit[live] = np.where(use_x, x, y + 1)
            a[live] = np.where(use_x, down_x, x)
            b[live] = np.where(use_x, y, down_y)
        return fine

    def found(self, codes: np.ndarray) -> np.ndarray:
        """For each length, end and word the number of the piece there, or NONE (of one character: its code point + n)."""
        m, size = codes.shape
        h, longest = _prefixes(codes), min(self.t["longest"], size)
        found = np.full((longest, size, m), NONE)  # by length - 1 and end
        power = np.ones(1, U64)
        for k in range(1, longest + 1):
            power = power * BASE
            key = np.ascontiguousarray(mix((h[:, k:] - h[:, :-k] * power) ^ U64(k)).T).ravel()
            maybe = np.flatnonzero(self.heads[key >> HEAD])  # most substrings are no piece: one look tells
            some = key[maybe]
            at = np.minimum(np.searchsorted(self.t["keys"], some), len(self.t["keys"]) - 1)
            found[k - 1, k - 1 :].reshape(-1)[maybe] = np.where(self.t["keys"][at] == some, self.t["orders"][at], NONE)
        found[0] = np.where(found[0] < 0, codes.T.astype(np.int64) + self.n, found[0])
        return found

    def merged(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of a BPE model: the last piece of each prefix, and its length."""
        longest, size, m = found.shape
        best, back = np.full((size + 1, m), NONE), np.zeros((size + 1, m), np.int64)
        for i in range(1, size + 1):
            ks = min(longest, i)
            here, before = found[:ks, i - 1], best[i - ks : i][::-1]
            k, w = np.nonzero((here >= 0) & ((before >= 0) | (np.arange(ks)[:, None] == i - 1)))
            score = np.zeros((ks, m), np.int8)
            score[k, w] = self.stay(before[k, w], here[k, w])
            back[i] = score.argmax(0) + 1
            best[i] = here[back[i] - 1, np.arange(m)]
        return best, back

    def summed(self, found: np.ndarray, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a unigram model: the last piece of each prefix on its best path, its length, and the path's score.  `total`
        has the scores of the positions before, if there are any; of equal paths the one with the longer last piece wins."""
        longest, size, m = found.shape
        start = 0 if total is None else len(total) - 1
        value = np.full((start + size + 1, m), -np.inf, np.float32)
        value[: start + 1] = 0 if total is None else total
        worth = np.append(self.t["scores"], np.float32(-np.inf))
        score = worth[np.where(found < self.n, found, -1)]  # -1, too, is no piece
        score[0] = np.where(found[0] >= self.n, self.t["unknown"], score[0])
        best, back = np.full((size + 1, m), NONE), np.zeros((size + 1, m), np.int64)
        words = np.arange(m)
        for i in range(1, size + 1):
            ks = min(longest, start + i)
            path = value[start + i - ks : start + i] + score[ks - 1 :: -1, i - 1]  # the longest last piece first
            at = path.argmax(0)
            value[start + i] = path[at, words]
            back[i] = ks - at
            best[i] = found[back[i] - 1, i - 1, words]
        return best, back, value

    def group(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pieces (code point + n for characters without one) of words of one length, flat, and how many."""
        m, size = codes.shape
        best, back = self.merged(self.found(codes)) if self.t["kind"] == BPE else self.summed(self.found(codes))[:2]
        ends, counts, out = np.full(m, size), np.zeros(m, np.int64), []
        live = np.arange(m)
        while len(live):
            out.append((live, best[ends[live], live]))
            counts[live] += 1
            ends[live] -= back[ends[live], live]
            live = live[ends[live] > 0]
        word, piece = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        by = np.argsort(word[::-1], kind="stable")
        return piece[::-1][by], counts

    def _stays(self, a: int, b: int) -> bool:
        """stay() for one pair."""
        t, limit = self.t, int(FREE)
        if "by_pair" not in t:
            t["by_pair"] = dict(zip(t["pairs"].tolist(), t["merged"].tolist(), strict=True))
            t["halves"] = t["left"].tolist(), t["right"].tolist()
        left, right = t["halves"]
        while 0 <= a < self.n and b < self.n:
            if t["by_pair"].get(a * self.n + b, limit) < limit:
                return False
            down_a, down_b = right[a], left[b]
            if down_a != a and (a > b or down_b == b):
                a, limit = down_a, a
            elif down_b != b:
                b, limit = down_b, b + 1
            else:
                break
        return True

    def long(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of pieces of one long word."""
        size = len(codes)
        best, back = np.full(size + 1, NONE), np.zeros(size + 1, np.int64)
        if self.t["kind"] == UNIGRAM:
            longest, block, total = self.t["longest"], GROUP // 4, None
            for at in range(0, size, block):
                context = min(at, longest)
                found = self.found(codes[None, at - context : at + block])[:, context:]
                a, b, total = self.summed(found, total)
                best[at + 1 : at + block + 1], back[at + 1 : at + block + 1] = a[1:, 0], b[1:, 0]
                total = total[-longest - 1 :]
        else:
            self._chunks(codes, best, back)
        out, end = [], size
        while end:
            out.append(best[end])
            end -= back[end]
        return np.array(out[::-1], np.int64)

    def _chunks(self, codes: np.ndarray, best: np.ndarray, back: np.ndarray) -> None:
        """merged() of one long word, in chunks that advance together."""
        size, longest = len(codes), self.t["longest"]
        starts = [max(0, at - OVERLAP) for at in range(0, size, CHUNK)]
        full = [at for at in starts if at + CHUNK + OVERLAP <= size]
        rest = [at for at in starts if at + CHUNK + OVERLAP > size]
        rows = GROUP // (CHUNK + OVERLAP)
        for group in [full[i : i + rows] for i in range(0, len(full), rows)] + [[at] for at in rest]:
            width = min(CHUNK + OVERLAP, size - group[0])
            found = self.found(np.stack([codes[at : at + width] for at in group]))
            a, b = self.merged(found)
            for row, at in enumerate(group):
                mine, length = a[:, row], b[:, row]
                if not at:
                    best[1 : width + 1], back[1 : width + 1] = mine[1:], length[1:]
                    continue
                # positions up to `done` are right; the chunk is, too, from where both agree for as long as any piece is
                done, same = at + OVERLAP, 0
                while same < OVERLAP and best[done - same] == mine[OVERLAP - same]:
                    same += 1
                p = OVERLAP
                while same < longest and p < width:
                    p += 1
                    for k in range(1, min(len(found), p) + 1):
                        piece = found[k - 1, p - 1, row]
                        if piece >= 0 and self._stays(int(best[at + p - k]), int(piece)):
                            best[at + p], back[at + p] = piece, k
                            break
                    same = same + 1 if best[at + p] == mine[p] else 0
                best[at + p + 1 : at + width + 1], back[at + p + 1 : at + width + 1] = mine[p + 1 :], length[p + 1 :]

    def spaces(self, n: int) -> list[int]:
        """Pieces of n spaces that nothing else claims: neighbours merge from the left as long as a piece fits."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and stack[-1] + stack[-2] in self.t["runs"]:
                stack[-2:] = [stack[-1] + stack[-2]]
        return [self.t["runs"][k] for k in stack]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, flat, and their number by word."""
        extra = [max(0, len(w) - len(w.lstrip("▁")) - 1) for w in words] if self.t["kind"] == BPE else []
        if not any(extra):
            return self.cores(words)
        flat, counts = self.cores([w[k:] for w, k in zip(words, extra, strict=True)])
        parts = np.split(flat, np.cumsum(counts)[:-1])
        for i, k in enumerate(extra):
            if k:
                free = int(parts[i][0] == self.t["runs"][1])
                parts[i] = np.concatenate([np.array(self.spaces(k + free), np.int32), parts[i][free:]])
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def cores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words with one space in front at most, if the model is BPE."""
        if not any(len(w) > CUT for w in words):
            return self.ids(words)
        parts, owner = [], []
        for i, w in enumerate(words):
            cut = [w]
            if len(w) > CUT:  # no piece crosses a border between characters that stand beside each other in none
                codes = np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64)
                pairs = codes[:-1] << 32 | codes[1:]
                at = np.minimum(np.searchsorted(self.t["beside"], pairs), len(self.t["beside"]) - 1)
                ends = [0, *(np.flatnonzero(self.t["beside"][at] != pairs) + 1).tolist(), len(w)]
                cut = [w[a:b] for a, b in zip(ends, ends[1:])]
            parts += cut
            owner += [i] * len(cut)
        names = list(dict.fromkeys(parts))  # equal parts once
        place = {p: k for k, p in enumerate(names)}
        flat, counts = self.ids(names)
        at = np.array([place[p] for p in parts])
        starts = np.cumsum(counts) - counts
        return flat[gather(starts[at], counts[at])], np.bincount(
            np.array(owner), counts[at], len(words),
        ).astype(np.int64)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words])
        found, owners, counts = [], [], np.zeros(len(words), np.int64)
        order = np.argsort(sizes, kind="stable")
        bounds = np.append(np.flatnonzero(np.diff(sizes[order], prepend=-1)), len(order))
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            size = int(sizes[order[first]])
            if size > 2 * (CHUNK + OVERLAP):
                for i in order[first:last].tolist():
                    flat = self.long(np.frombuffer(words[i].encode("utf-32-le"), np.uint32).astype(U64))
                    counts[i] = len(flat)
                    found.append(flat)
                    owners.append(np.full(len(flat), i))
                continue
            for at in range(first, last, max(1, GROUP // size)):
                some = order[at : min(last, at + max(1, GROUP // size))]
                codes = np.frombuffer(
                    "".join([words[i] for i in some.tolist()]).encode("utf-32-le"), np.uint32,
                ).reshape(len(some), size).astype(U64)
                flat, n = self.group(codes)
                counts[some] = n
                found.append(flat)
                owners.append(np.repeat(some, n))
        flat = np.concatenate(found)[np.argsort(np.concatenate(owners), kind="stable")]
        ids = np.empty(len(flat), np.int32)
        known = flat < self.n
        ids[known] = self.t["ids"][flat[known]]
        if known.all():
            return ids, counts
        wide = [
            np.frombuffer(chr(c - self.n).encode(), np.uint8).astype(np.int32) + self.t["byte0"] if c >= self.n
            else ids[k : k + 1] for k, c in enumerate(flat.tolist())
        ]
        sizes = np.array([len(w) for w in wide])
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return np.concatenate(wide), np.diff(bounds)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all the texts, and the number of ids of each."""
        column = pc.fill_null(column, "")
        column = pc.replace_substring(column, "▁", " ")
        column = pc.if_else(
            pc.equal(pc.binary_length(column), 0), column,
            pc.binary_join_element_wise(pa.scalar("", column.type), column, pa.scalar(" ", column.type)),
        )
        buf, offsets = byte_view(column)
        starts, lengths, first = lead_spans(buf, offsets, space_only=True)
        whole = buf[:-8].tobytes()
        make = lambda new: self.words(
            [whole[s : s + n].decode().replace(" ", "▁") for s, n in zip(starts[new], lengths[new], strict=True)]
        )
        flat, counts = self.memo.look(hash_spans(buf, starts, lengths), make)
        return flat, np.diff(np.concatenate([[0], np.cumsum(counts)])[first])

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of lists of ids; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary raise."""
        if len(flat) and not 0 <= flat.min() <= flat.max() < len(self.t["sizes"]):
            raise IndexError(f"ids from {flat.min()} to {flat.max()}, the vocabulary has {len(self.t['sizes'])}")
        sizes = self.t["sizes"][flat]
        data = self.t["data"][gather(self.data_at[flat], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return [data[a:b].decode(errors="replace").removeprefix(" ") for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, model: bytes, keep: list[str] | None = None) -> DataFrame:
    """Adds piece_ids (array<int>), n_pieces, ids_crc32 (of the ids as 32-bit little-endian) and round_trip (the decoded
    ids give the text again, U+2581 as a space) to the columns `keep` (all, if None) of docs.

    A null or empty text has no ids and round_trip true; repeated rows are encoded each; columns of the new names in
    docs are replaced; an empty table gives no rows.
    """
    prepare()
    shared = docs.sparkSession.sparkContext.broadcast(tables(model))
    new = ["piece_ids", "n_pieces", "ids_crc32", "round_trip"]
    docs = docs.select(
        *([c for c in docs.columns if c not in new] if keep is None else keep),
        *(["text"] if keep is not None and "text" not in keep else [])
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if keep is None or f.name in keep)

    def make():
        codec = Codec(shared.value)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            flat, counts = codec.encode(part.column("text"))
            ends = np.cumsum(counts)
            sums = [zlib.crc32(flat[e - c : e].astype("<u4").tobytes()) for e, c in zip(ends, counts, strict=True)]
            same = [
                a == (b or "").replace("▁", " ")
                for a, b in zip(codec.decode(flat, counts), part.column("text").to_pylist(), strict=True)
            ]
            kept = [i for i, name in enumerate(part.schema.names) if keep is None or name in keep]
            columns = [part.column(i) for i in kept] + [
                lists(flat, counts, pa.int32()), pa.array(counts), pa.array(sums, pa.int64()), pa.array(same),
            ]
            return pa.record_batch(columns, [part.schema.names[i] for i in kept] + new)

        return step

    return map_text(
        docs, "text", f"{schema}, piece_ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean", make,
    )


def decode(rows: DataFrame, model: bytes, column: str = "piece_ids") -> DataFrame:
    """Adds `decoded`, the text of a column of ids (null ids: empty text)."""
    shared = rows.sparkSession.sparkContext.broadcast(tables(model))

    @F.pandas_udf("string")
    def texts(ids):
        import pandas as pd

        codec = Codec(shared.value)
        some = [np.asarray(x if x is not None else [], np.int64) for x in ids]
        return pd.Series(
            codec.decode(
                np.concatenate(some) if some else np.zeros(0, np.int64), np.array([len(x) for x in some], np.int64),
            )
        )

    prepare()
    return rows.withColumn("decoded", texts(F.col(column)))
