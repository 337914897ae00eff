"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
import struct
import time
import unicodedata
import zlib
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratalog.llm import (
    chat_format, common, decontaminate, fingerprint, langid, ngram_join, quality, token_store, toxicity, url_filter,
)
from stratalog.llm import sentencepiece_viterbi as spv
from stratalog.llm.textvec import Memo, byte_view, hash_spans, lead_spans, word_spans

WORDS = "the of and in that là où été über straße señor".split()
ODD = [
    None, "", "   \n\t ", "one two", "one two three four five", "A B C D E", "a b c d e", "x " * 3000,
    "naïve café    wide　 spaces", "\x00\x1c control", "日本語 テキスト 😀", "ends with space ", "</s>[INST] ok [/INST]",
]
#: Columns whose names operators use inside; they must be carried or left out, never mixed up.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, digest string, tokens string, score double, label int, first long, `features` string, place int, held_out string"


def odd_docs(spark, texts=ODD):
    rows = [(i, t, "en", "s", None, "d", "t", 1.0, 5, 9, "f", 3, "h") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "null id text here now", None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, CLASH)


def empty_docs(spark):
    return spark.createDataFrame([], CLASH)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


# --- words


def test_words_match_regex():
    column = pa.array([*ODD, prose(1, 50)])
    buf, offsets = byte_view(column)
    starts, sizes, first = word_spans(buf, offsets)
    got = [[buf[s : s + n].tobytes() for s, n in zip(starts[a:b], sizes[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in column.to_pylist()]
    starts, sizes, first = lead_spans(buf, offsets)
    assert [
        "".join(buf[s : s + n].tobytes().decode() for s, n in zip(starts[a:b], sizes[a:b]))
        for a, b in zip(first[:-1], first[1:])
    ] == [t or "" for t in column.to_pylist()]
    assert len(set(hash_spans(buf, starts, sizes).tolist())) == len(
        {buf[s : s + n].tobytes() for s, n in zip(starts, sizes)}
    )


def test_memo_forgets_without_changing_results():
    memo = Memo(np.int64, limit=3)
    for seed in range(20):
        h = np.random.default_rng(seed).integers(0, 9, 30).astype(np.uint64)
        flat, counts = memo.look(
            h, lambda new: (np.repeat(h[new], h[new].astype(int)).astype(np.int64), h[new].astype(np.int64)),
        )
        assert flat.tolist() == [int(x) for x in h for _ in range(int(x))] and counts.tolist() == h.tolist()


def test_slices_keep_all_rows():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 100, "", "c"])], ["text"])
    parts = list(common.slices(batch, "text", 20))
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist() and len(parts) > 1


# --- 1


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def near_copies(n=60, seed=3):
    """Chains and stars of edited copies, some exactly at the threshold, among unrelated texts that share a passage."""
    r, out = random.Random(seed), []
    passage = prose(999, 40)
    base = prose(5, 120).split()
    for i in range(n):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = f"edit{r.randint(0, 5)}"
        out.append(" ".join(words))
        out.append(prose(1000 + i, 60) + " " + passage)
        base = words if i % 10 == 0 else base
    out += [
        " ".join(f"w{i}" for i in range(11)), " ".join(f"w{i}" for i in range(12)),
        " ".join(f"w{i}" for i in range(14)), "a b c", "A b C", "a b c",
    ]
    return list(enumerate(out))


@pytest.mark.parametrize("leaf", [4096, 7])
def test_jaccard_classes_against_all_pairs(spark, leaf):
    rows = near_copies()
    got = {
        r[0]: (r[1], r[2])
        for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), leaf=leaf).collect()
    }
    assert got == brute_components(rows)


def test_region_resolves_like_all_pairs():
    r = np.random.default_rng(4)
    for trial in range(30):
        sets = [np.unique(r.integers(0, 60, r.integers(1, 30))) for _ in range(40)] + [np.arange(20), np.arange(1, 21)]
        region = ngram_join.Region(sets, 75)
        root = region.resolve()
        want = np.arange(len(sets))
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    want[want == want[a]] = want[b]
        assert all((root[a] == root[b]) == (want[a] == want[b]) for a in range(len(sets)) for b in range(a)), trial


@pytest.mark.parametrize("leaf", [4096, 11])
def test_jaccard_link_counts(spark, leaf):
    """Each document's number of links, copies of a set counting each, against all pairs."""
    rows = near_copies(40)
    rows += [(500 + i, t) for i, (_, t) in enumerate(rows[:6])] + [(600, rows[0][1]), (700, ""), (701, None)]
    got = {
        r["doc_id"]: (r["n_links"], r["component_id"])
        for r in ngram_join.classes(
            spark.createDataFrame(rows, "doc_id long, text string"), leaf=leaf, split=leaf, counts=True,
        ).collect()
    }
    sets = [(i, shingles(t)) for i, t in rows]
    linked = {
        i: sum(j != i and bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b) for j, b in sets) for i, a in sets
    }
    assert {i: n for i, (n, _) in got.items()} == linked
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in brute_components(rows).items()}


@pytest.mark.parametrize(("leaf", "depth"), [(9, 4), (9, 1), (9, 0), (40, 4)])
def test_large_regions_join_like_all_pairs(spark, monkeypatch, leaf, depth):
    """Members at all distances from each other, in regions that are cut by Voronoi windows, or block by block."""
    monkeypatch.setattr(ngram_join, "DEPTH", depth)
    r = np.random.default_rng(leaf + depth)
    sets, members = [], []
    for cell in range(3):
        for k in range(90):
            low, size = r.integers(0, [30, 80, 200][cell]), r.integers(8, 30)
            sets.append(np.setdiff1d(np.arange(low, low + size), r.integers(0, 230, 3)))
            members.append((str(cell), len(sets) - 1, int(r.integers(0, 1 << 40)), cell == 2 and k % 3 == 0))
    frame = spark.createDataFrame(members, "region string, doc_id long, rank long, main boolean")
    tokens = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "doc_id long, tokens array<long>")
    edges, held = ngram_join.regions(frame, tokens, 75, leaf)
    edges = edges.collect()
    common.discard(*held)
    got, want = np.arange(len(sets)), np.arange(len(sets))
    for _, a, _, main in members:  # members of main are known to be connected
        if main:
            got[got == got[a]] = want[want == want[a]] = want[next(b for _, b, _, m in members if m)]
    for u, v in edges:
        got[got == got[u]] = got[v]
    for a in range(len(sets)):
        for b in range(a - a % 90, a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                want[want == want[a]] = want[b]
    assert {frozenset(np.flatnonzero(got == x)) for x in got} == {frozenset(np.flatnonzero(want == x)) for x in want}


def test_census_rows_do_not_grow_with_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = []
    for n in ("8", "512"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = ngram_join.census_rows(docs, 50 * ngram_join.BUCKET)
        sizes.append(
            rows.agg(F.sum(sum(F.length(c) for c in ("ids", "sizes", "once", "whose", "more")) + 12)).first()[0]
        )
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sizes[0] == sizes[1]
    # a document's id and size are there once; what is left is its shingles, and its place where it has some
    tokens = ngram_join.digests(docs).agg(F.sum("n_shingles")).first()[0]
    assert sizes[0] < 6.5 * tokens + 12 * docs.count() + 64 * 50 * 8
    assert [ngram_join.census_buckets(n) for n in (0, 1, 1 << 20, 1 << 32, 1 << 40)] == [1, 1, 1, 4096, 1 << 16]


def test_jaccard_odd_rows(spark):
    got = sorted(ngram_join.classes(odd_docs(spark)).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert len(got) == len(ODD) + 2
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["n_shingles"] for i in range(7)] == [0, 0, 0, 1, 1, 1, 1] and by[7]["n_shingles"] == 1
    assert by[6][
        "component_id"
    ] == 5 and by[5]["component_id"] == 5 and by[0]["component_id"] == 0 and by[1]["component_id"] == 1
    assert by[None]["component_id"] is None and by[None]["n_shingles"] == 1
    twin = spark.createDataFrame(
        [
            (4, "same words in both rows here"), (None, "same words in both rows here"),
            (9, "same words in both rows here"),
        ],
        "doc_id long, text string",
    )
    assert sorted(
        (r["doc_id"] or 0, r["component_id"] or 0) for r in ngram_join.classes(twin).collect()
    ) == [(0, 0), (4, 4), (9, 4)]
    assert ngram_join.classes(empty_docs(spark)).count() == 0
    kept = ngram_join.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(ODD) + 1


def test_jaccard_of_very_long_texts(spark):
    """Texts of 150,000 words, alike but for a few, beside one of a million characters without a space."""
    long = prose(7, 150_000).split()
    other = [*long[:-40], *prose(8, 40).split()]
    third = [w if i % 9 else f"n{i}" for i, w in enumerate(long)]
    rows = [
        (1, " ".join(long)), (2, "z" * 1_000_000), (3, " ".join(other)), (4, " ".join(third)),
        (5, " ".join(other) + " "),
    ]
    got = {
        r["doc_id"]: (r["n_shingles"], r["component_id"])
        for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    assert got == brute_components(rows) and got[3][1] == 1 and got[4][1] == 4 and got[2] == (1, 2)


def test_jaccard_repeated_ids_join_their_sets(spark):
    """Document 5 has the sets of both 2 and 3, neither of which it is the first of."""
    a, b = "one text of seven words in all", "quite another one that has eight words here"
    rows = spark.createDataFrame(
        [(2, b), (3, a), (5, a), (5, b), (7, "alone among all these rows")], "doc_id long, text string",
    )
    assert sorted(
        (r["doc_id"], r["component_id"]) for r in ngram_join.classes(rows).collect()
    ) == [(2, 2), (3, 2), (5, 2), (5, 2), (7, 7)]


# --- 2


@pytest.mark.parametrize("plain", [False, True])
def test_tokens_round_trip(spark, tmp_path, plain):
    """As the unmodified library encodes, special tokens' strings included; with plain_specials, as ordinary text."""
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        js = f.read()
    tokenizer = Tokenizer.from_str(js)
    if plain:
        tokenizer.encode_special_tokens = True
    texts = [
        *ODD, "don't we'll I'm,x 'sabc 12a3,b.  <|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x",
        "<|endof text|>", *(prose(i, 80) + ",end." for i in range(20))
    ]
    texts += [
        "un\u00a0mot  \u00a0 deux\u2003trois \u3000\u3000fin\u00a0", "\u00a0",
        "\u2028x\u2029 y\u202f;\u205fz\u1680\u0085!", "x\u200by \u180ez\ufeff", "。中文 ，文本　没有空格" * 5,
    ]
    rows = [(i * 7 % 50, t) for i, t in enumerate(texts)] + [(None, "x"), (0, "again")]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string",
    ).withColumn("ids", F.lit("clash")).withColumn("place", F.lit(1)).repartition(5)
    path = str(tmp_path / "t")
    token_store.write_tokens(docs, path, js, 2, **({'plain_specials': True} if plain else {}))
    got = token_store.read_tokens(spark, path).collect()
    enc = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    want = sorted([(-1 if i is None else i, enc(t)) for i, t in rows])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], list(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["ids"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids)
    assert [list(r["ids"]) for r in token_store.read_tokens(spark, path, [7]).collect()] == [enc(rows[1][1])]
    sums = {r["start"]: r["ids_crc32"] for r in token_store.summary(token_store.read_tokens(spark, path)).collect()}
    assert all(sums[r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)


def test_words_of_wide_spaces():
    """Spans begin where a run of Unicode's white space begins, whatever its bytes."""
    spaces = [chr(c) for c in (0x20, 0x0A, 0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    r = random.Random(4)
    texts = [
        "".join(r.choice([*spaces, *"aé語\u200b\u2010\u0084¡"]) for _ in range(r.randint(0, 30))) for _ in range(300)
    ]
    buf, offsets = byte_view(pa.array(texts))
    starts, sizes, first = lead_spans(buf, offsets)
    got = [
        [buf[s : s + n].tobytes().decode() for s, n in zip(starts[a:b], sizes[a:b])]
        for a, b in zip(first[:-1], first[1:])
    ]
    white = "[" + "".join(spaces) + "]"
    assert got == [re.findall(f"^[^{white[1:-1]}]+|{white}+[^{white[1:-1]}]*", t) for t in texts]


def test_memo_is_bounded_by_bytes():
    memo, r = Memo(np.int64, limit=1 << 20), np.random.default_rng(1)
    for _ in range(200):
        h = r.integers(0, 1 << 20, 500).astype(np.uint64)
        h[:3] = r.integers(1 << 21, 1 << 22, 3)  # a few very long words
        size = lambda x: np.where(x > 1 << 20, 60_000, x % 90).astype(np.int64)
        flat, counts = memo.look(h, lambda new: (np.repeat(h[new], size(h[new])).astype(np.int64), size(h[new])))
        assert np.array_equal(flat, np.repeat(h, size(h)).astype(np.int64)) and np.array_equal(counts, size(h))
        assert memo.held() < 6 << 20


def test_tokens_of_very_long_texts():
    """A megabyte without white space, one of spaces, and French in wide spaces: as the library, memo small."""
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        js = f.read()
    tokenizer, encoder = Tokenizer.from_str(js), token_store.Encoder(js)
    texts = ["日本語の文章" * 60_000, " " * 200_000 + "x", "mot\u00a0" * 100_000, prose(3, 100_000)]
    flat, counts = encoder.encode(pa.array(texts))
    for got, text in zip(np.split(flat, np.cumsum(counts)[:-1]), texts, strict=True):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.memo.held() < 64 << 20


def test_tokens_of_nothing(spark, tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        js = f.read()
    token_store.write_tokens(empty_docs(spark), str(tmp_path / "e"), js, 2)
    assert token_store.summary(token_store.read_tokens(spark, str(tmp_path / "e"))).count() == 0


# --- 3 and 9


def labelled(spark, column):
    texts, marks = [], []
    r = random.Random(2)
    for i in range(400):
        bad = i % 4 == 0
        text = prose(i, 30)
        if column == "quality":
            text = " ".join(w + "!!" for w in text.upper().split()) if bad else text
        elif bad:
            text += f" {r.choice(['idiot', 'scum'])} groupish"
        texts.append((i, text))
        marks.append((i, int(not bad) if column == "quality" else int(bad)))
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(
        [*marks, (None, 1), (1, None)], f"doc_id long, {column} int",
    )


@pytest.mark.parametrize(("module", "column", "least"), [(quality, "quality", 0.3), (toxicity, "toxic", 0.5)])
def test_classifiers(spark, module, column, least):
    docs, labels = labelled(spark, column)
    model = module.fit(docs, labels)
    got = module.score(docs, model).join(labels, "doc_id").where(f"{column} is not null").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r[column] for r in held]) > 0.95
    odd = module.score(odd_docs(spark), model).collect()
    assert len(odd) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in odd)
    assert module.score(empty_docs(spark), model).count() == 0
    nothing = module.fit(empty_docs(spark), labels.limit(0))
    assert module.score(odd_docs(spark), nothing).count() == len(ODD) + 2


def test_stage_filters_keep_columns(spark):
    docs, labels = labelled(spark, "quality")
    kept = quality.keep_good(docs.withColumn("score", F.lit("x")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and 280 < kept.count() < 320
    docs, labels = labelled(spark, "toxic")
    assert 280 < toxicity.keep_clean(docs, labels).count() < 320


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_stage_filters_judge_each_row(spark, module, column):
    """Null and repeated ids: every row goes by its own verdict."""
    docs, labels = labelled(spark, column)
    worst = 0 if column == "quality" else 1
    texts = {
        r["doc_id"]: (r["text"], r["predicted"] == worst)
        for r in module.score(docs, module.fit(docs, labels)).join(docs, "doc_id").collect()
    }
    bad, good = next(t for t, b in texts.values() if b), next(t for t, b in texts.values() if not b)
    more = spark.createDataFrame(
        [(None, bad, ["b"]), (None, good, ["g"]), (9000, bad, ["b"]), (9000, good, ["g"])],
        "doc_id long, text string, tags array<string>",
    )
    kept = (module.keep_good if column == "quality" else module.keep_clean)(
        docs.withColumn("tags", F.array(F.lit("x"))).union(more), labels,
    ).collect()
    assert sorted((r["doc_id"] or 0, r["tags"][0]) for r in kept if r["tags"] != ["x"]) == [(0, "g"), (9000, "g")]


def test_dual_descent_reaches_the_optimum():
    """Against projected gradients on the dual, written plainly; the rounds that are used come near the least cost."""
    r = np.random.default_rng(5)
    rows = [np.flatnonzero(r.random(25) < 0.3) for _ in range(80)] + [np.zeros(0, int)]
    label = np.array([int((3 in x) + (7 in x) + r.random() > 1) for x in rows])
    scale = r.normal(0, 1, 25)
    x = np.zeros((len(rows), 26))
    for i, row in enumerate(rows):
        x[i, row] = scale[row]
    x[:, 25] = 1
    sign = np.where(label == 1, 1.0, -1.0)
    cost = np.where(label == 1, 0.1, 0.1 * max(1.0, min(4.0, label.mean() / (1 - label.mean()))))
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha = np.zeros(len(rows))
    pace = 1 / np.linalg.norm(q, 2)
    for _ in range(60_000):
        alpha = np.clip(alpha - pace * (q @ alpha - 1), 0, cost)
    want = (alpha * sign) @ x

    def primal(w):
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()

    assert abs(primal(want) - (alpha.sum() - 0.5 * want @ want)) < 1e-6  # no duality gap
    assert np.allclose(quality.descend(rows, label, scale, rounds=3000), want, atol=1e-4)
    assert primal(quality.descend(rows, label, scale)) < 1.02 * primal(want)


def test_quality_scores_against_a_plain_version(spark):
    """Log-count ratios from plain counts; margins as plain sums; ties at the sample's edge and repeated rows are decided
    by the rows alone, not by their order."""
    docs, labels = labelled(spark, "quality")
    docs = docs.union(docs.where("doc_id < 20"))
    model = quality.fit(docs, labels)
    rows = docs.join(labels.where("quality is not null and doc_id is not null"), "doc_id").collect()
    rows = [x for x in rows if zlib.crc32(str(x["doc_id"]).encode()) % 5]
    times = {0: {}, 1: {}}
    for x in rows:
        for f in quality.features(pa.array([x["text"]]))[0].tolist():
            times[x["quality"]][f] = times[x["quality"]].get(f, 0) + 1
    n = {k: sum(x["quality"] == k for x in rows) for k in (0, 1)}
    ratio = {
        f: np.log((times[1].get(f, 0) + 1) / (n[1] + 2)) - np.log((times[0].get(f, 0) + 1) / (n[0] + 2))
        for f in {*times[0], *times[1]} if times[0].get(f, 0) + times[1].get(f, 0) >= 3
    }
    used = np.flatnonzero(model["weights"])
    assert set(used.tolist()) <= set(ratio) and len(used) > 20
    some = sorted(rows, key=lambda x: (x["doc_id"], x["text"]))
    sets = [quality.features(pa.array([x["text"]]))[0] for x in some]
    scale = np.zeros(1 << quality.BITS)
    for f, v in ratio.items():
        scale[f] = v / np.sqrt(np.mean([len(s) for s in sets]) + 1)
    margins = np.array([model["weights"][s].sum() for s in sets])
    best = quality.descend(sets, np.array([x["quality"] for x in some]), scale, rounds=200)
    plain = np.array([(best[:-1] * scale)[s].sum() for s in sets])
    assert np.corrcoef(margins, plain)[0, 1] > 0.99
    got = {(x["doc_id"], x["score"]) for x in quality.score(docs, model).collect()}
    for x, m in zip(some, margins):
        want = 1 / (1 + np.exp(-np.clip(model["slope"] * m + model["offset"], -40, 40)))
        assert any(i == x["doc_id"] and abs(v - want) < 1e-4 for i, v in got)
    again = quality.fit(docs.repartition(7, "text"), labels.repartition(3))
    assert np.array_equal(again["weights"], model["weights"])
    few = [quality.fit(docs.repartition(k), labels, most=50)["weights"] for k in (2, 5)]
    assert np.array_equal(*few)


def test_toxicity_scores_against_a_plain_version(spark):
    """Margins as plain sums over terms and pairs of terms; the terms chosen by plain chi-square values."""
    docs, labels = labelled(spark, "toxic")
    model = toxicity.fit(docs, labels)
    machine, place = model["machine"], model["place"]
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    for x in docs.collect():
        terms = [place[t] for t in toxicity.features(pa.array([x["text"]]))[0] if place[t] >= 0]
        margin = machine.offset + sum(machine.w[t] for t in terms) + sum(
            machine.v[a] @ machine.v[b] for i, a in enumerate(terms) for b in terms[:i]
        )
        assert abs(got[x["doc_id"]] - 1 / (1 + np.exp(-np.clip(margin, -40, 40)))) < 1e-9
    rows = [
        (toxicity.features(pa.array([x["text"]]))[0].tolist(), x["toxic"])
        for x in docs.join(labels.where("doc_id is not null and toxic is not null"), "doc_id").collect()
        if zlib.crc32(str(x["doc_id"]).encode()) % 5
    ]
    for t in {t for f, _ in rows for t in f}:
        a, b = (sum(t in f and y == k for f, y in rows) for k in (1, 0))
        c, d = (sum(t not in f and y == k for f, y in rows) for k in (1, 0))
        chi = (a * d - b * c) ** 2 * len(rows) / max(1, (a + b) * (c + d) * (a + c) * (b + d))
        assert (place[t] >= 0) == (chi >= toxicity.DEPENDS and a + b >= 5), (t, chi)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_read_very_long_texts(module):
    """A text's features are those of its whole length: its last word counts."""
    long = ("word " * 400_000).strip()
    a, b = (set(module.features(pa.array([t]))[0].tolist()) for t in (long, long + " FINALLY!!! finally"))
    assert len(b - a) > 1
    flat, counts = module.features(pa.array(["x" * 2_000_000, None, "", " \n" * 100_000]))
    assert counts[0] > 0 and counts[1:].tolist() == [0, 0, 0] and len(flat) == counts[0]


def test_factorization_machine_learns_a_pair():
    """Neither word alone is toxic, both together are: no linear model can tell."""
    rows = [np.array(x) for x in ([0, 2], [1, 2], [0, 1, 2], [2])] * 100
    label = np.array([0, 0, 1, 0] * 100)
    m = toxicity.Machine(3, rank=4)
    m.fit(rows, label, rounds=60)
    assert ((m.margin(np.concatenate(rows), np.array([len(r) for r in rows])) > 0) == label).mean() > 0.99


# --- 4


def edit_distance_anywhere(item, text):
    last = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(last[j - 1] + (a != b), last[j] + 1, now[-1] + 1))
        last = now
    return min(last)


def test_leaks_against_brute_force(spark):
    r = random.Random(8)
    items = [(i, prose(500 + i, 12)) for i in range(6)] + [
        (6, ""), (7, None), (8, "Ünïcode Straße!"), (3, items_text := prose(503, 12)),
    ]
    docs = []
    for i in range(40):
        text = prose(i, 60)
        if i % 2:
            part = list(prose(500 + i % 6, 12))
            for _ in range(r.randint(0, 9)):
                part[r.randrange(len(part))] = r.choice("xyz ")
            text = text[:100] + " " + "".join(part) + " " + text[100:]
        docs.append((i, text))
    docs += [(40, None), (41, ""), (42, "xx ÜNÏCODE, straße"), (42, "xx ÜNÏCODE, straße")]
    del items_text
    got = sorted(
        (r["doc_id"], r["item_id"], r["distance"])
        for r in decontaminate.leaks(
            spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(items, "item_id long, text string"),
        ).collect()
    )
    want = []
    for d, t in docs:
        for i, x in items:
            if item := decontaminate.plain(x):
                dist = edit_distance_anywhere(item, decontaminate.plain(t))
                if t and dist <= int(decontaminate.RATE * len(item)):
                    want.append((d, i, dist))
    assert got == sorted(want) and len(got) > 10
    assert decontaminate.leaks(
        empty_docs(spark), spark.createDataFrame(items, "item_id long, text string"),
    ).count() == 0
    assert decontaminate.leaks(odd_docs(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_ties_long_texts_and_clashing_columns(spark):
    """Of equally near passages the first one counts; whole texts are searched; other columns are left out."""
    item = "which river flows past the old mill at noon every day"
    near = item.replace("mill", "hill")
    long = "filler words of no interest " * 60_000
    texts = [f"a {near} b {near} c", long + item, item + " " + long + item, "x" * 1_000_000, None]
    docs = odd_docs(spark, texts).withColumn("item_id", F.lit(9)).withColumn("distance", F.lit("d"))
    docs = docs.withColumn("start", F.lit("s")).withColumn("end", F.lit("e"))
    items = spark.createDataFrame(
        [(1, item, "t", 5), (1, item, "t", 5), (2, item, None, None)],
        "item_id long, text string, doc_id string, start int",
    )
    got = sorted(map(tuple, decontaminate.leaks(docs, items).collect()))
    at = len(decontaminate.plain(long)) + 1
    want = [(0, 1, 2, 2 + len(item)), (1, 0, at, at + len(item)), (2, 0, 0, len(item))]
    assert got == sorted((d, i, n, a, b) for d, n, a, b in want for i in (1, 1, 2))
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, None}


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    """However the benchmark is cut into blocks, the same rows are found."""
    items = spark.createDataFrame([(i, prose(500 + i, 12)) for i in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(i, 30) + " " + prose(500 + i % 8, 12)) for i in range(24)], "doc_id long, text string")
    found = [sorted(map(tuple, decontaminate.leaks(docs, items).collect()))]
    monkeypatch.setattr(decontaminate, "BLOCK", 150)
    found.append(sorted(map(tuple, decontaminate.leaks(docs, items).collect())))
    assert found[0] == found[1] and {(r[0], r[1]) for r in found[0]} == {(i, i % 8) for i in range(24) if i % 8 < 6}


def test_leaks_go_row_by_row(spark, monkeypatch):
    items = [(1, "which river flows past the old mill at noon"), (2, "how many stones lie under the northern bridge")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(
        [(None, items[0][1], 1), (None, "clean", 2), (7, items[1][1] + " yes", 3), (7, "also clean", 4), (8, None, 5)],
        "doc_id long, text string, n int",
    )
    for size in (4_000_000, 10):
        monkeypatch.setattr(decontaminate, "BLOCK", size)
        assert sorted(r["n"] for r in decontaminate.keep_clean(docs, benchmark).collect()) == [2, 4, 5]


# --- 5


def test_urls(spark):
    rules = spark.createDataFrame(
        [
            ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
            ("block", "example.net", "/de/8"), ("block", "org", "/es/"), ("block", "", "/x"), (None, "com", "/"),
            ("block", "bad.com", None), ("allow", "tie.com", "/a"), ("block", "tie.com", "/a"),
        ],
        "verdict string, host string, path string",
    )
    cases = {
        "http://A.Example.COM/en/71?x": ("a.example.com", "/en/71", "example.com/en/7", "allow"),
        "http://xexample.com/en/71": ("xexample.com", "/en/71", "com/en/", "block"),
        "https://www.example.net/de/8": ("www.example.net", "/de/8", "example.net/de/8", "block"),
        "https://example.net/de/7#f": ("example.net", "/de/7", "net/de/", "allow"),
        "https://example.org/en/": ("example.org", "/en/", None, "allow"),
        "ftp://bad.com": ("bad.com", "", "bad.com", "block"),
        "http://tie.com/a": ("tie.com", "/a", "tie.com/a", "block"),
        "com/en/": ("", "", None, "allow"),
        "http:///en/": ("", "/en/", None, "allow"),
        "": ("", "", None, "allow"),
        "http://com?/en/": ("com", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(
        [(i, u, "old", "short") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "old", "short")],
        "page_id long, url string, rule string, short string",
    )
    got = url_filter.judge(pages, rules).collect()
    assert len(got) == len(cases) + 1
    assert {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == cases
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0), "block").collect()} == {"block"}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    names = [
        n for n in ("Python", "Pandas", "Arrow")
        if n in url_filter.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    ]
    assert not names


def test_very_long_urls(spark):
    rules = spark.createDataFrame(
        [("block", "com", "/en/"), ("allow", "b.com", "/en/" + "x" * 3000)], "verdict string, host string, path string",
    )
    cases = {
        "http://b.com/en/" + "x" * 500_000: "allow", "http://b.com/en/" + "x" * 2999: "block",
        "http://" + "a." * 200_000 + "com/en/?q": "block", "http://" + "com" * 100_000: "allow",
        "x" * 100_000 + "://com/en/": "block",
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")
    assert {r["url"]: r["verdict"] for r in url_filter.judge(pages, rules).collect()} == cases


# --- 6


def test_fingerprints(spark):
    texts = ["Straße  X", "STRASSE x", "ﬁne", "fine", "fine ", None, "", "é", "é"]
    rows = list(enumerate(texts))
    prints = {
        r["doc_id"]: r["fingerprint"]
        for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    assert prints[
        0
    ] == prints[1] and prints[2] == prints[3] == prints[4] and prints[5] == prints[6] and prints[7] == prints[8] and len(
        set(prints.values())
    ) == 4
    groups = {
        r["doc_id"]: r["group_id"]
        for r in fingerprint.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    assert groups == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5, 6: 5, 7: 7, 8: 7}
    assert groups == {
        r["doc_id"]: r["group_id"]
        for r in fingerprint.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), part=1).collect()
    }
    assert fingerprint.exact_groups(empty_docs(spark)).count() == 0
    assert fingerprint.exact_groups(odd_docs(spark)).count() == len(ODD) + 2
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi"


@pytest.mark.parametrize("n", [0, 1, 2, 57])
def test_edited_texts(spark, n):
    rows = [(i * 3, ODD[i] if i < len(ODD) else prose(i, i)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("at", F.lit(1)).repartition(6)
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(docs).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == n
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % n][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["next_fingerprint"]) == (
            len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.digest(t), fingerprint.digest(edited),
            fingerprint.digest(following),
        )


def test_edited_texts_that_are_very_long(spark):
    rows = [(1, "é" * 900_000), (2, "b " * 700_000), (3, ""), (4, "x")]
    got = {
        r["doc_id"]: r
        for r in fingerprint.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    for (i, t), (_, after) in zip(rows[::-1], [*rows[::-1][1:], rows[-1]]):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    groups = fingerprint.exact_groups(spark.createDataFrame([*rows, (9, "B \n" * 700_000)], "doc_id long, text string"))
    assert {r["doc_id"]: r["group_id"] for r in groups.collect()}[9] == 2


def test_edited_texts_of_repeated_and_null_ids(spark):
    rows = [(1, "aaa"), (1, "bbb"), (1, "bbb"), (None, "zzz"), (5, "ccc")]
    got = fingerprint.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [
        (False, 1), (False, 1), (False, 1), (False, 5), (True, 0),
    ]
    assert {r["next_fingerprint"] for r in got if r["doc_id"] is None} == {fingerprint.digest("ccc")}


# --- 7


def brute_path(scores, switch):
    k, value, back = scores.shape[1], np.zeros(scores.shape[1]), []
    for s in scores:
        move = [[value[j] - (switch if j != i else 0) for j in range(k)] for i in range(k)]
        back.append([int(np.argmax(m)) for m in move])
        value = np.array([max(m) for m in move]) + s
    state, out = int(value.argmax()), []
    best = value.max()
    for b in reversed(back):
        out.append(state)
        state = b[state]
    return out[::-1], best


def path_value(scores, path, switch):
    return sum(s[p] for s, p in zip(scores, path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


def test_languages(spark):
    vocab = {
        "aa": "alpha beta gamma delta".split(), "bb": "omega sigma kappa zeta".split(),
        "gr": "λόγος φως νους ψυχή".split(),
    }
    r = random.Random(1)
    docs = [
        (i, " ".join(r.choice(vocab[lang]) for _ in range(12)), lang) for i in range(90)
        for lang in [list(vocab)[i % 3]]
    ]
    frame = spark.createDataFrame(
        [*docs, (900, None, "aa"), (901, "x y", None)], "doc_id long, text string, lang string",
    )
    model = langid.fit(frame)
    assert model["langs"] == ["aa", "bb", "gr"]
    got = {r["doc_id"]: r for r in langid.predict(frame, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in docs) and got[900]["lang_pred"] == "und"
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    odd = langid.predict(
        spark.createDataFrame(
            [(1, "123 !!"), (2, ""), (3, None), (None, "alpha"), (5, "alpha"), (5, "alpha"), (6, "ЖЖ日"), (7, "“—”")],
            "doc_id long, text string",
        ).withColumn("lang", F.lit("zz")),
        model,
    ).collect()
    assert len(odd) == 8 and [r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3, 7)] == ["und"] * 4
    assert langid.predict(empty_docs(spark), model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(frame, langid.fit(frame.limit(0))).collect()} == {"und"}
    mixed = "alpha beta gamma " * 10 + "omega sigma kappa " * 10
    spans = langid.spans(
        spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model,
    ).orderBy("start").collect()
    assert [(s["lang"], mixed[s["start"] : s["end"]].split()[0]) for s in spans] == [("aa", "alpha"), ("bb", "omega")]


def plain_words(text):
    """Runs of letters of one script with their marks, lower-cased, cut at CAP; (word, script, first byte, behind it)."""
    out, now, script = [], [], None

    def end():
        nonlocal now, script
        cap = langid.CAP_UNSPACED if script in langid.UNSPACED else langid.CAP
        for i in range(0, len(now), cap):
            some = now[i : i + cap]
            low = "".join(
                c.lower() if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1 else c for _, c in some
            )
            out.append((low, -1 if script is None else script, some[0][0], some[-1][0] + len(some[-1][1].encode())))
        now, script = [], None

    at = 0
    for c in text:
        kind = unicodedata.category(c)[0]
        if kind == "L":
            mine = max(i for i, (f, _) in enumerate(langid.SCRIPTS) if f <= ord(c))
            mine = langid.NAMES.index(langid.SCRIPTS[mine][1])
            if script is not None and mine != script:
                end()
            script = mine
            now.append((at, c))
        elif kind == "M":
            now.append((at, c))
        else:
            end()
        at += len(c.encode())
    end()
    return out


def plain_grams(word):
    data = word.encode()
    cells = [(data[i - 1] if i else 0, data[i], data[i + 1] if i + 1 < len(data) else 0) for i in range(len(data))]
    return [
        int(langid.mix(np.array([a << 16 | b << 8 | c], np.uint64))[0] >> np.uint64(64 - langid.BITS))
        for a, b, c in cells
    ]


MIXED = [
    "日本語です。中文文本，没有空格。これはペンです", "École école ÉCOLE", "a1b2 c", "naïve café", "x" * 60 + " " + "日" * 30,
    "e\u0301cole \u0301 a\u0300\u0301b", "Straße λόγος ЖЖ", "ﬁn Ⅷ ª 𝒳 ʼn", "ภาษาไทย", "\u3000\u00a0", "한국어 텍스트",
]


def test_language_words_against_a_plain_version():
    texts = [*ODD, *MIXED, "plain ascii Words, it's 3x", prose(4, 50)]
    for batch in [texts, *[[t] for t in texts]]:
        words = langid.Words(pa.array(batch, pa.string()))
        got = [
            [
                (
                    words.buf[words.starts[i] : words.starts[i] + words.sizes[i]].tobytes().decode(),
                    int(words.script[i]), int(words.begin[i] - words.offsets[k]), int(words.end[i] - words.offsets[k]),
                )
                for i in range(words.first[k], words.first[k + 1])
            ]
            for k in range(len(batch))
        ]
        assert got == [plain_words(t or "") for t in batch]


def test_languages_against_a_plain_version(spark):
    """Counts, scores, best paths and shares by plain loops; spans of texts that mix scripts."""
    vocab = {
        "aa": "alpha beta École gamma delta".split(), "ja": "日本語です これは ペン 本です".split(), "zh": "中文文本 没有 空格 本文".split(),
        "gr": "λόγος φως νους".split(),
    }
    r = random.Random(12)
    docs = [
        (i, ("" if lang in ("ja", "zh") else " ").join(r.choice(vocab[lang]) for _ in range(8)), lang)
        for i in range(120) for lang in [list(vocab)[i % 4]]
    ]
    model = langid.fit(
        spark.createDataFrame([*docs, (500, "alpha", None), (501, None, "aa")], "doc_id long, text string, lang string")
    )
    langs = sorted(vocab)
    table, scripts = np.full((4, 1 << langid.BITS), 0.05), np.zeros((4, len(langid.NAMES)))
    for i, text, lang in docs:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for word, script, _, _ in plain_words(text):
                for g in plain_grams(word):
                    table[langs.index(lang), g] += 1
                scripts[langs.index(lang), script] += 1
    table = np.log(table / table.sum(1, keepdims=True))
    assert model["langs"] == langs and np.allclose(model["table"].T, table, atol=1e-5)
    fits = scripts > 0.005 * scripts.sum(1, keepdims=True)

    def scores(word, script):
        if script < 0:
            return np.zeros(4)
        s = sum((table[:, g] for g in plain_grams(word)), np.zeros(4))
        s = s - s.max()
        f = fits[:, script]
        s = np.where(f | ~f.any(), np.maximum(s, -25), -50)
        return s - s.mean()

    texts = [t for _, t, _ in docs[:30]] + MIXED + [
        "".join(r.choice(vocab["ja"] + vocab["zh"]) for _ in range(30)) + " alpha beta" * 6,
        "alpha " * 9 + "中文文本" * 9 + " λόγος" * 9,
    ]
    rows = {
        x["doc_id"]: x
        for x in langid.predict(
            spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model,
        ).collect()
    }
    for i, text in enumerate(texts):
        words = plain_words(text)
        path, _ = brute_path(
            np.array([scores(w, s) for w, s, _, _ in words]).reshape(-1, 4), langid.SWITCH,
        ) if words else ([], 0)
        held = np.zeros(4)
        for (w, s, _, _), p in zip(words, path):
            held[p] += len(w) if s >= 0 else 0
        if not held.sum():
            assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
        else:
            assert abs(
                rows[i]["score"] - held.max() / held.sum()
            ) < 1e-9 and held[langs.index(rows[i]["lang_pred"])] == held.max(), text
    spans = langid.spans(
        spark.createDataFrame([(1, texts[-1])], "doc_id long, text string"), model,
    ).orderBy("start").collect()
    data = texts[-1].encode()
    assert [
        (x["lang"], data[x["start"] : x["end"]].decode().strip()[:2]) for x in spans
    ] == [("aa", "al"), ("zh", "中文"), ("gr", "λό")]


def test_languages_of_very_long_texts():
    """A megabyte without spaces is words of bounded length; the whole of it counts."""
    words = langid.Words(pa.array(["日本語" * 100_000 + "λ", "x" * 1_000_000 + " y"]))
    assert words.chars.max() <= langid.CAP and words.chars.sum() == 300_001 + 1_000_001
    assert words.script[words.first[1] - 1] == langid.NAMES.index("Greek")


def test_viterbi_is_the_best_path(spark):
    vocab = {
        "aa": "alpha beta gamma delta".split(), "bb": "omega sigma kappa zeta".split(),
        "cc": "uno dos tres siete".split(),
    }
    r = random.Random(5)
    docs = [
        (i, " ".join(r.choice(vocab[lang]) for _ in range(9)), lang) for i in range(60) for lang in [list(vocab)[i % 3]]
    ]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    every = sum(vocab.values(), [])
    texts = [
        " ".join(r.choice(every if r.random() < 0.5 else vocab["aa"]) for _ in range(r.randint(0, 40)))
        for _ in range(60)
    ]
    for switch in (1.0, 4.0, 12.0):
        labeller = langid.Labeller(model, switch)
        words = langid.Words(pa.array(texts))
        labels, _ = labeller.label(words)
        scores = labeller.word_scores(words)[:, :-1]
        for a, b in zip(words.first[:-1], words.first[1:]):
            if b > a:
                path, best = brute_path(scores[a:b], switch)
                assert abs(path_value(scores[a:b], labels[a:b], switch) - best) < 1e-6, path


# --- 8


def test_pieces_match_the_library(spark):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [
        *ODD, "▁x▁ y", "aaaa aaaaa " + "a" * 200, "-------- ===== 1234567 <s> </s> <unk> <0x41>",
        "supercalifragilistic" * 40, *(prose(i, 60) for i in range(20))
    ]
    docs = odd_docs(spark, texts).withColumn("piece_ids", F.lit(1)).withColumn("n_pieces", F.lit(1))
    got = spv.encode(docs, model)
    assert got.columns == [
        *(c for c in docs.columns if c not in ("piece_ids", "n_pieces")), "piece_ids", "n_pieces", "ids_crc32",
        "round_trip",
    ]
    rows = got.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = sp.encode(r["text"] or "")
        assert list(
            r["piece_ids"]
        ) == want and r["n_pieces"] == len(want) and r["round_trip"] and r["ids_crc32"] == zlib.crc32(
            np.array(want, "<u4").tobytes()
        )
    back = spv.decode(got, model).collect()
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in back)
    assert spv.encode(empty_docs(spark), model, ["doc_id"]).count() == 0


def test_pieces_of_random_strings():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec, r = spv.Codec(spv.tables(model)), random.Random(11)
    texts = ["".join(r.choice("aeinrst  hlo.,-_é語1") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += [" " * n + tail for n in range(40) for tail in ("", "x", "the", "\n", "_ _", ".")]
    flat, counts = codec.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [sp.encode(t) for t in texts]


def codec_of(model):
    return spv.Codec(spv.tables(model)), sentencepiece.SentencePieceProcessor(model_proto=model)


def same_as_library(codec, sp, texts):
    flat, counts = codec.encode(pa.array(texts))
    for got, text in zip(np.split(flat, np.cumsum(counts)[:-1]), texts, strict=True):
        assert got.tolist() == sp.encode(text), text[:80]
    assert codec.decode(flat, counts) == [t.replace("▁", " ") for t in texts]


def test_pieces_of_very_long_words(monkeypatch):
    """Words without a space, of all kinds: as the library, however they are cut; a megabyte takes seconds."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        codec, sp = codec_of(f.read())
    r = random.Random(3)
    kinds = [
        "ab", "aeinrstlo", "abcdefghijklmnopqrstuvwxyz", "ABCdef0123+/=", "日本語の中文", "éàüß", "a", "=-", "inging", "aab",
    ]
    texts = ["".join(r.choice(k) for _ in range(n)) for k in kinds for n in (127, 129, 700, 1281, 1400, 3000)]
    texts += [
        "thequickbrownfoxjumpsoverthelazydog" * 200, "x" + "a" * 5001, "supercalifragilisticexpialidocious" * 90,
        prose(4, 800).replace(" ", ""),
    ]
    same_as_library(codec, sp, texts)
    for chunk, overlap in ((40, 32), (64, 17)):  # chunks that hardly overlap, or not enough
        monkeypatch.setattr(spv, "CHUNK", chunk)
        monkeypatch.setattr(spv, "OVERLAP", overlap)
        same_as_library(spv.Codec(codec.t), sp, texts)
    monkeypatch.undo()
    began = time.perf_counter()
    same_as_library(codec, sp, ["".join(r.choice("aeinrstlo") for _ in range(1_000_000))])
    assert time.perf_counter() - began < 60


def unigram_model(pieces, **normalizer):
    """A unigram model in the library's file format, from pieces and their scores (nothing is trained)."""

    def number(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    def whole(field, data):
        return number(field << 3 | 2) + number(len(data)) + data

    def entry(piece, score, kind):
        return whole(
            1, whole(1, piece.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + number(3 << 3) + number(kind),
        )

    out = entry("<unk>", 0, 2) + entry("<s>", 0, 3) + entry("</s>", 0, 3) + b"".join(
        entry(f"<0x{b:02X}>", 0, 6) for b in range(256)
    )
    out += b"".join(entry(p, s, 1) for p, s in pieces)
    flags = {3: 1, 4: 0, 5: 1} | normalizer.get("flags", {})
    spec = whole(1, b"identity") + b"".join(number(k << 3) + number(v) for k, v in flags.items())
    return out + whole(
        2, number(3 << 3) + number(normalizer.get("kind", 1)) + number(35 << 3) + number(normalizer.get("fallback", 1)),
    ) + whole(3, spec)


def test_pieces_of_a_unigram_model(spark):
    """The path of the greatest score sum, against the library and against all paths."""
    r = random.Random(9)
    pieces = {"▁", "▁▁", *"abcdeé語"} | {"".join(r.choice("abcde") for _ in range(r.randint(2, 5))) for _ in range(150)}
    pieces |= {"▁" + p for p in list(pieces)[:60] if "▁" not in p}
    model = unigram_model([(p, round(-r.uniform(2, 12), 3)) for p in sorted(pieces)])
    codec, sp = codec_of(model)
    texts = ["".join(r.choice("aabbccdde  é語xyz") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    score = {p: sp.get_score(sp.piece_to_id(p)) for p in pieces}
    worth = lambda ids: (
        sum(score[sp.id_to_piece(i)] for i in ids if not sp.is_byte(i)), [i for i in ids if sp.is_byte(i)],
    )

    def alike(got, want):
        """The same ids, or, where sums are equal but for rounding (the library's begin with the text), as good a path."""
        (a, x), (b, y) = worth(got), worth(want)
        return got == want or (abs(a - b) < 1e-3 * max(1, len(want) / 100) and x == y)

    every = [*texts, "a" * 3000, "".join(r.choice("abcdex") for _ in range(40_000)), " " * 50 + "a", "", "▁a"]
    flat, counts = codec.encode(pa.array(every))
    found = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert all(alike(x, sp.encode(t)) for x, t in zip(found, every, strict=True))
    assert np.mean([x == sp.encode(t) for x, t in zip(found, texts)]) > 0.98
    assert codec.decode(flat, counts) == [t.replace("▁", " ") for t in every]

    def best(word):
        value = [0.0]
        for i in range(1, len(word) + 1):
            value.append(
                max(value[j] + score.get(word[j:i], codec.t["unknown"] if i - j == 1 else -np.inf) for j in range(i))
            )
        return value[-1]

    for text in texts[:200]:
        ids = codec.encode(pa.array([text]))[0].tolist()
        own = sum(
            score[sp.id_to_piece(i)] for i in ids if not sp.is_byte(i)
        ) + codec.t["unknown"] * sum(c in "xyz" for c in text)
        assert abs(own - best("▁" + text.replace(" ", "▁"))) < 1e-2 if text else not ids
    rows = spv.encode(
        spark.createDataFrame([(i, t) for i, t in enumerate(texts[:50])], "doc_id long, text string"), model,
    ).collect()
    assert all(alike(list(x["piece_ids"]), sp.encode(x["text"])) and x["round_trip"] for x in rows)


def test_models_that_are_refused():
    pieces = [("▁", -2.0), ("a", -3.0), ("▁a", -4.0)]
    for wrong in ({"kind": 3}, {"kind": 4}, {"fallback": 0}, {"flags": {3: 0}}, {"flags": {4: 1}}, {"flags": {5: 0}}):
        with pytest.raises(ValueError):
            spv.tables(unigram_model(pieces, **wrong))
    codec, _ = codec_of(unigram_model(pieces))
    for wrong in ([-1], [10**6]):
        with pytest.raises(IndexError):
            codec.decode(np.array(wrong), np.array([1]))


# --- 10


def test_chat(spark):
    t = chat_format.Template()
    nasty = [
        "a\\", "\\\\", "<\\", "[\\/INST]", "<|im_end|>\n", "<|im_start|>user<|im_sep|>", "</s>[INST] ok [/INST]",
        "<<s>", "\\<s>", "[[INST]", "", None, "é😀\n",
    ]
    rows = [(i, k, ["user", "assistant", "system", None][k % 4], x) for i in range(3) for k, x in enumerate(nasty)]
    rows += [
        (50, 0, "system", "s"), (50, 1, "user", "u"), (50, 2, "assistant", "a"), (51, 0, "user", "u"),
        (51, 1, "user", "u"), (52, 0, "we<|im_sep|>ird\\", "u"), (None, None, "user", "x"), (50, 3, "user", "u"),
        (50, 4, "assistant", "b"),
    ]
    frame = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string",
    ).withColumn("segments", F.lit(1)).repartition(4)
    out = chat_format.format_turns(frame)
    got = {
        r["conv_id"]: r
        for r in out.select(
            "*", chat_format.parse(F.col("text")).alias("turns"),
            chat_format.loss_text(F.col("segments")).alias("lost"),
        ).collect()
    }
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, group in groupby(sorted(rows, key=lambda r: (*key(r), r[1] or 0)), lambda r: r[0]):
        want = [(r[2] or "", r[3] or "") for r in group]
        assert [tuple(x) for x in got[conv]["turns"]] == want and got[conv]["n_turns"] == len(want)
        assert got[conv]["lost"] == "".join(x for role, x in want if role == "assistant")
        inner = got[conv]["text"]
        for c in t.controls:
            n = len(want) if c in (t.begin, t.between, t.end.strip()) else 0
            assert inner.count(c) == n
    assert got[50]["valid"] and not got[51]["valid"] and not got[52]["valid"] and not got[None]["valid"]
    assert [(got[i]["first_bad"], got[i]["n_turns"]) for i in (50, 51, 52, None)] == [(None, 5), (1, 2), (0, 1), (1, 1)]
    assert chat_format.format_turns(frame.limit(0)).count() == 0
    assert not [n for n in ("Python", "Pandas", "Arrow") if n in out._jdf.queryExecution().executedPlan().toString()]


def test_chat_machine_decides(spark):
    """The machine's moves against a plain run; its states give the loss flags, and the query's plan holds the moves."""
    from stratalog.llm import queries

    t = chat_format.Template(
        loss=("assistant", "tool"),
        follow={
            "start": ("system", "user"), "system": ("user",), "user": ("assistant", "tool"),
            "tool": ("assistant", "tool"), "assistant": ("user",),
        },
        final=("assistant", "tool"),
    )
    r = random.Random(6)
    chats = [
        [
            r.choice(["system", "user", "assistant", "tool", "robot", "start", chat_format.OTHER])
            for _ in range(r.randint(1, 6))
        ]
        for _ in range(150)
    ]
    chats += [
        ["user", "tool", "tool", "assistant"], ["system", "user", "assistant"], ["user"], ["user", "assistant"] * 300,
    ]
    rows = [(i, k, role, f"<s>{i}") for i, chat in enumerate(chats) for k, role in enumerate(chat)]
    got = {
        x["conv_id"]: x
        for x in chat_format.format_turns(
            spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), t,
        ).collect()
    }
    for i, chat in enumerate(chats):
        state, bad = "start", None
        for k, role in enumerate(chat):
            if bad is None and (role == "start" or role not in t.follow.get(state, ())):
                bad = k
            state = role if role in t.states else None
        bad = len(chat) if bad is None and chat[-1] not in t.final else bad
        assert (got[i]["first_bad"], got[i]["valid"]) == (bad, bad is None), chat
        assert [s["loss"] for s in got[i]["segments"]][3::5] == [role in t.loss for role in chat]
    plan = queries.op10(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert chat_format.OTHER in plan and "system" in plan and "allowed" in plan


def test_chat_of_very_long_texts(spark):
    """A turn of megabytes and a conversation of thousands of turns come back as they were."""
    big = "<s>\\\\[INST] " * 100_000
    rows = [
        (1, 0, "user", big), (1, 1, "assistant", big),
        *((2, k, ["user", "assistant"][k % 2], f"</s>{k}") for k in range(4000))
    ]
    out = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {
        r["conv_id"]: r
        for r in out.select(
            "conv_id", "valid", chat_format.parse(F.col("text")).alias("turns"),
            chat_format.loss_text(F.col("segments")).alias("lost"),
        ).collect()
    }
    for conv in (1, 2):
        want = [(role, t) for c, _, role, t in rows if c == conv]
        assert [tuple(x) for x in got[conv]["turns"]] == want and got[conv]["valid"]
        assert got[conv]["lost"] == "".join(t for role, t in want if role == "assistant")
