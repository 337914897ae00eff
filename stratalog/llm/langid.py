"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word is a run of letters (with the marks on them) of one script, lower-cased; long runs are cut, above all those of
scripts without spaces.  Its score in a language is the log-likelihood of its letter trigrams, counted over all training
documents, against the mean of the candidates.  A candidate is a language in whose training words the word's script occurs.
Changing the language between two words costs a fixed penalty, so that spans of a mixed text come out, not single words.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, prepare, remainder
from .textvec import LOWER, MARKS, U64, Memo, byte_view, hash_spans, mix, ragged, word_spans, worker_value

HOLD, HELD = 4, 2
BITS = 16
#: Cost, in nats, of a change of language between two words.
SWITCH = 12.0
UNKNOWN = "und"
#: First code points of Unicode ranges, and the script of the letters from there on.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"),
)
NAMES = sorted({s for _, s in SCRIPTS})
_FROM = np.array([f for f, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(s) for _, s in SCRIPTS])


#: Characters of a word at most; of one of a script that is written without spaces.
CAP, CAP_UNSPACED = 24, 8
UNSPACED = [NAMES.index(n) for n in ("Han", "Kana", "Thai", "Other")]
LATIN = NAMES.index("Latin")
#: Beyond this code point there are no letters.
LETTERS_END = 0x33480
MARK, GAP = -1, -2


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case form, a space if it is no part of a word; and its script, MARK or GAP."""
    fold, script = np.full(LETTERS_END + 1, 0x20, np.uint32), np.full(LETTERS_END + 1, GAP, np.int8)
    for c in range(LETTERS_END):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            low = chr(c).lower()
            fold[c] = ord(low) if len(low) == 1 else c
            script[c] = _SCRIPT[np.searchsorted(_FROM, c, "right") - 1]
        elif kind == "M":
            fold[c], script[c] = c, MARK
    return fold, script


def _width(codes: np.ndarray) -> np.ndarray:
    """Bytes in UTF-8 (a byte that is no UTF-8 stands as a low surrogate)."""
    return 1 + (codes >= 0x80).astype(np.int64) * ((codes < 0xDC80) | (codes > 0xDCFF)) * (
        1 + (codes >= 0x800) + (codes >= 0x10000)
    )


class Words:
    """Words of a batch of texts: their folded bytes, number of characters and script, and their place in the texts."""

    def __init__(self, column: pa.Array):
        raw, self.offsets = byte_view(column)
        if raw.max(initial=0) < 0x80:
            self.buf = LOWER[raw]
            gap = MARKS.copy()
            gap[0x30:0x3A] = True
            starts, sizes, _ = word_spans(self.buf, self.offsets, gap)
            owner, place = ragged(-(-sizes // CAP))
            self.starts = self.begin = starts[owner] + CAP * place
            self.sizes = self.chars = np.minimum(sizes[owner] - CAP * place, CAP)
            self.end = self.begin + self.sizes
            self.script = np.full(len(owner), LATIN)
        else:
            self._wide(raw)
        self.first = np.searchsorted(self.begin, self.offsets)
        self.hashes = hash_spans(self.buf, self.starts, self.sizes)
        self.owner = np.repeat(np.arange(len(column)), np.diff(self.first))

    def _wide(self, raw: np.ndarray) -> None:
        fold, script = worker_value("language_characters", _characters)
        codes = np.frombuffer(
            raw[:-8].tobytes().decode(errors="surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32,
        )
        at = np.concatenate([[0], np.cumsum(_width(codes))])
        known = np.minimum(codes, LETTERS_END)
        kind, lower = script[known], fold[known]
        inside, letter = kind != GAP, kind >= 0
        edge = np.zeros(len(codes) + 1, bool)
        edge[np.searchsorted(at, self.offsets)] = True
        fresh = edge[:-1].copy()
        fresh[1:] |= ~inside[:-1]
        # a letter of another script than the last letter of its run begins a word
        here = np.arange(len(codes))
        run = np.maximum.accumulate(np.where(inside & fresh, here, 0))
        last = np.maximum.accumulate(np.where(letter, here, -1))
        before = np.append(-1, last[:-1])
        change = letter & (before >= run) & (kind[before] != kind)
        begin = np.flatnonzero(inside & (fresh | change))
        # a word ends before the next one of its run, at a gap, or with its text
        bounds = np.flatnonzero(np.append(~inside, True) | np.append(inside & (fresh | change), True))
        sizes = bounds[np.searchsorted(bounds, begin, "right")] - begin if len(begin) else begin
        heads = np.concatenate([[0], np.cumsum(letter)])
        has = heads[begin + sizes] > heads[begin]
        lead = np.minimum(np.searchsorted(heads, heads[begin], "right") - 1, len(codes) - 1)  # its first letter
        own = np.where(has, kind[lead], MARK).astype(np.int64)
        cap = np.where(np.isin(own, UNSPACED), CAP_UNSPACED, CAP)
        owner, place = ragged(-(-sizes // cap))
        start = begin[owner] + cap[owner] * place
        self.chars = np.minimum(sizes[owner] - cap[owner] * place, cap[owner])
        self.script = own[owner]
        self.begin, self.end = at[start], at[start + self.chars]
        folded = np.concatenate([[0], np.cumsum(_width(lower))])
        self.buf = np.frombuffer(lower.tobytes().decode("utf-32-le").encode() + bytes(8), np.uint8)
        self.starts, self.sizes = folded[start], folded[start + self.chars] - folded[start]

    def trigrams(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed byte trigrams of some words, with a border at either end: flat, and as many as the word has bytes."""
        sizes = self.sizes[which]
        owner, place = ragged(sizes)
        at = self.starts[which][owner] + place
        here = self.buf[at].astype(U64)
        before = np.where(place > 0, self.buf[np.maximum(at - 1, 0)], 0).astype(U64)
        after = np.where(place < sizes[owner] - 1, self.buf[at + 1], 0).astype(U64)
        return (mix(before << U64(16) | here << U64(8) | after) >> U64(64 - BITS)).astype(np.int64), sizes

    def scripts(self, which: np.ndarray) -> np.ndarray:
        """Script of each word; MARK for a word without letters."""
        return self.script[which]


def fit(docs: DataFrame) -> dict:
    """Trigram log-probabilities and scripts by language, from text and lang of the rows that aren't held out.

    Rows without lang or text count for nothing.  Each task adds up its own rows, Spark adds up the tasks' sums; a sum
    for each language and trigram bucket comes to the driver (languages x 65,536).  Without rows, no language is known.
    """
    prepare()
    rows = docs.where(
        (remainder("doc_id", HOLD) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).select("lang", "text")

    def make():
        memo = Memo(np.int64)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(part.column("text"))
            langs, which = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)

            def parts(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                grams, sizes = words.trigrams(new)
                ends = np.cumsum(sizes) + np.arange(len(new)) + 1
                flat = np.empty(len(grams) + len(new), np.int64)
                flat[ends - 1] = (1 << BITS) + 1 + words.scripts(new)
                rest = np.ones(len(flat), bool)
                rest[ends - 1] = False
                flat[rest] = grams
                return flat, sizes + 1

            flat, counts = memo.look(words.hashes, parts)
            kind = (1 << BITS) + 1 + len(NAMES)
            sums = np.bincount(np.repeat(which[words.owner], counts) * kind + flat, minlength=len(langs) * kind)
            at = np.flatnonzero(sums)
            return pa.record_batch(
                [
                    pa.array(langs[at // kind], pa.string()), pa.array(at % kind, pa.int32()),
                    pa.array(sums[at], pa.int64()),
                ],
                ["lang", "gram", "times"],
            )

        return step

    sums = map_text(
        rows, "text", "lang string, gram int, times long", make,
    ).groupBy("lang", "gram").agg(F.sum("times").alias("times")).toPandas()
    langs = sorted(sums["lang"].unique())
    table, scripts = np.full((len(langs), 1 << BITS), 0.05), np.zeros((len(langs), len(NAMES)))
    for i, lang in enumerate(langs):
        mine = sums[sums["lang"] == lang]
        grams = mine["gram"].to_numpy()
        letters = grams < 1 << BITS
        table[i, grams[letters]] += mine["times"].to_numpy()[letters]
        script = grams > 1 << BITS
        scripts[i, grams[script] - (1 << BITS) - 1] = mine["times"].to_numpy()[script]
    table = np.log(table / table.sum(1, keepdims=True)) if langs else table
    return {
        "langs": langs, "table": table.T.astype(np.float32).copy(),
        "scripts": (scripts > 0.005 * scripts.sum(1, keepdims=True)).T,
    }


class Labeller:
    def __init__(self, model: dict, switch: float = SWITCH):
        self.model, self.switch, self.memo, self.k = model, switch, Memo(np.float32), len(model["langs"])

    def word_scores(self, words: Words) -> np.ndarray:
        """For each word and language a log-likelihood; a row of zeros for a word without letters."""

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            grams, sizes = words.trigrams(new)
            ends = np.cumsum(sizes)
            total = np.concatenate(
                [np.zeros((1, self.k)), np.cumsum(self.model["table"][grams], axis=0, dtype=np.float64)]
            )
            score = total[ends] - total[ends - sizes]
            score -= score.max(1, keepdims=True)
            script = words.scripts(new)
            fit = self.model["scripts"][script]
            score = np.where(fit | ~fit.any(1, keepdims=True), np.maximum(score, -25), -50)
            score[script < 0] = 0
            return np.hstack(
                [score - score.mean(1, keepdims=True), (script >= 0)[:, None]]
            ).astype(np.float32).ravel(), np.full(len(new), self.k + 1)

        flat, _ = self.memo.look(words.hashes, make)
        return flat.reshape(-1, self.k + 1).astype(np.float64)

    def label(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Language number of each word on the best path of its text; whether the word has letters."""
        score = self.word_scores(words)
        letters, score = score[:, -1] > 0, score[:, :-1]
        texts = len(words.first) - 1
        total = np.stack([np.bincount(words.owner, score[:, i], texts) for i in range(self.k)], 1)
        best = total.argmax(1) if texts else np.zeros(0, int)
        out = best[words.owner]
        # A text stays in its best language if no run of its words gains half a switch in another one.
        mixed = np.zeros(texts, bool)
        if len(words.owner):
            for i in range(self.k):
                gain = np.cumsum(score[:, i] - score[np.arange(len(out)), out]) - words.owner * 1e7
                low = np.minimum.accumulate(np.append(0, gain)[:-1])
                fresh = np.append(True, words.owner[1:] != words.owner[:-1])
                base = np.where(
                    fresh, np.append(0, gain)[:-1] - 1e7 * np.append(words.owner[0], np.diff(words.owner)), low,
                )
                mixed |= np.bincount(words.owner, gain - np.minimum.accumulate(base) > self.switch / 2, texts) > 0
        some = np.flatnonzero(mixed)
        if len(some):
            self.viterbi(words, score, some[np.argsort(-np.diff(words.first)[some], kind="stable")], out)
        return out, letters

    def viterbi(self, words: Words, score: np.ndarray, texts: np.ndarray, out: np.ndarray) -> None:
        """Labels the words of some texts (longest first), all texts one word further at a time."""
        sizes, first = np.diff(words.first)[texts], words.first[texts]
        value, moves = np.zeros((len(texts), self.k)), []
        live = len(texts)
        for i in range(sizes[0]):
            while sizes[live - 1] <= i:
                live -= 1
            now = value[:live]
            top = now.argmax(1)
            stay = now >= now[np.arange(live), top][:, None] - self.switch
            moves.append(np.where(stay, np.arange(self.k), top[:, None]).astype(np.int16))
            value[:live] = np.where(
                stay, now, now[np.arange(live), top][:, None] - self.switch,
            ) + score[first[:live] + i]
        state = value.argmax(1)
        for i in range(sizes[0] - 1, -1, -1):
            live = len(moves[i])
            out[first[:live] + i] = state[:live]
            state[:live] = moves[i][np.arange(live), state[:live]]


def predict(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language of most letters over all spans, and their share (0 to 1).

    Null texts, texts without a letter, and all texts if no language was learned, get `und` and 0.  Of equal languages
    the first by name wins.  One row for each input row; null ids get held_out null; no other column is looked at.
    """
    prepare()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller = Labeller(shared.value, switch)
        langs = [*shared.value["langs"], UNKNOWN]

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            words, n = Words(part.column("text")), part.num_rows
            pred, share = np.full(n, len(langs) - 1), np.zeros(n)
            if labeller.k:
                labels, letters = labeller.label(words)
                weight = np.where(letters, words.chars, 0)
                held = np.stack([np.bincount(words.owner, weight * (labels == i), n) for i in range(labeller.k)], 1)
                some = held.sum(1) > 0
                pred[some] = held[some].argmax(1)
                share[some] = held[some].max(1) / held[some].sum(1)
            return pa.record_batch(
                [part.column("doc_id"), pa.array([langs[i] for i in pred]), pa.array(share)],
                ["doc_id", "lang_pred", "score"],
            )

        return step

    out = map_text(
        docs.select(F.col("doc_id").cast("long"), "text"), "text", "doc_id long, lang_pred string, score double", make,
    )
    return out.select("doc_id", (remainder("doc_id", HOLD) == HELD).alias("held_out"), "lang_pred", "score")


def spans(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """doc_id, start, end (bytes of UTF-8), lang: the spans of one language that Viterbi finds, in order.

    Spans go from the first byte of their first word to the last of their last; texts without words have none.
    """
    prepare()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller = Labeller(shared.value, switch)

        def step(part: pa.RecordBatch) -> pa.RecordBatch | None:
            words = Words(part.column("text"))
            if not labeller.k or not len(words.owner):
                return None
            labels, _ = labeller.label(words)
            head = np.append(True, (labels[1:] != labels[:-1]) | (words.owner[1:] != words.owner[:-1]))
            at = np.flatnonzero(head)
            last = np.append(at[1:], len(head)) - 1
            base = words.offsets[words.owner[at]]
            names = np.array(labeller.model["langs"], object)
            return pa.record_batch(
                [
                    part.column("doc_id").take(pa.array(words.owner[at])), pa.array(words.begin[at] - base),
                    pa.array(words.end[last] - base), pa.array(names[labels[at]], pa.string()),
                ],
                ["doc_id", "start", "end", "lang"],
            )

        return step

    return map_text(
        docs.select(F.col("doc_id").cast("long"), "text"), "text", "doc_id long, start long, end long, lang string",
        make,
    )
