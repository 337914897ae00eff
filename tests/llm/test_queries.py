"""The registered queries and the pipeline on the smallest tables, against SQL or plain versions."""

import hashlib
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from stratalog.llm import common, decontaminate, ngram_join, quality, toxicity
from stratalog.llm.queries import QUERIES, SQL, table

from .test_operators import brute_components, edit_distance_anywhere


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_whole_tables(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir)
    assert (rows.count() == table(spark, sf_dir, "documents").count()) or name == "op4_decontamination"


def texts_of(spark, sf_dir):
    return sorted(((r["doc_id"], r["text"] or "") for r in table(spark, sf_dir, "documents").collect()))


def test_token_ids_of_the_table(spark, sf_dir):
    """The unmodified library, text by text."""
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, text in texts_of(spark, sf_dir):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = QUERIES["op2_token_ids"](spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_fingerprints_of_the_table(spark, sf_dir):
    docs = texts_of(spark, sf_dir)[::-1]
    canonical = [
        " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split()) for _, t in docs
    ]
    marks = [xxhash.xxh3_128_hexdigest(c.encode()) for c in canonical]
    got = {r["doc_id"]: r for r in QUERIES["op6_fingerprint"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    first = {}
    for (i, _), c in zip(reversed(docs), reversed(canonical)):
        first.setdefault(c, i)
    for k, (i, text) in enumerate(docs):
        after = (k + 1) % len(docs)
        cut = len(text) // 3
        edited = text[: len(text) - cut] + docs[after][1][:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["group_id"]) == (
            len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[k], first[canonical[k]],
        )
        assert (r["near_next"], r["near_edited"]) == (
            float(marks[k] == marks[after]), float(r["edited_fingerprint"] == marks[k]),
        )


def test_pieces_of_the_table(spark, sf_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(texts_of(spark, sf_dir))
    for r in QUERIES["op8_sentencepiece"](spark, sf_dir).collect():
        want = sp.encode(texts[r["doc_id"]])
        assert (list(r["piece_ids"]), r["n_pieces"], r["round_trip"]) == (want, len(want), True)


@pytest.mark.parametrize("name", ["op3_quality", "op5_url_filter", "op6_fingerprint", "op9_toxicity"])
def test_both_sides_of_a_broadcast(spark, sf_dir, name, monkeypatch):
    """Sides that are too large to be sent to all tasks are shuffled; the rows stay the same."""
    want = sorted(map(repr, QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert not common.is_small(spark.range(1))
    assert sorted(map(repr, QUERIES[name](spark, sf_dir).collect())) == want


def test_similar_documents_without_broadcasts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r[0]: (r[1], r[2]) for r in ngram_join.classes(docs, split=20).collect()} == brute_components(rows)


def test_no_query_joins_by_nested_loops(spark, sf_dir):
    plan = QUERIES["op5_url_filter"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing_is_left_behind_or_set(spark, sf_dir):
    """No session setting changes; what stays in the shared folder is what results read."""
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    for name in ("op3_quality", "op5_url_filter", "op9_toxicity"):
        QUERIES[name](spark, sf_dir).count()
    assert {r["key"]: r["value"] for r in spark.sql("SET").collect()} == before


def test_leaks_of_the_table(spark, sf_dir):
    docs = [(r["doc_id"], decontaminate.plain(r["text"])) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r["item_id"], decontaminate.plain(r["text"])) for r in table(spark, sf_dir, "benchmark").collect()]
    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_decontamination"](spark, sf_dir).collect()}
    whole = {(d, i) for d, t in docs for i, x in items if x in t}
    assert whole and whole <= found
    for d, i in found - whole:
        assert edit_distance_anywhere(dict(items)[i], dict(docs)[d]) <= int(decontaminate.RATE * len(dict(items)[i]))


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns
        after = {r["doc_id"] for r in out.collect()}
        if name == "toxicity":
            gone = {
                r["doc_id"] for r in toxicity.score(kept, toxicity.fit(kept, labels)).where("predicted = 1").collect()
            }
        elif name == "quality":
            gone = {
                r["doc_id"] for r in quality.score(kept, quality.fit(kept, labels)).where("predicted = 0").collect()
            }
        elif name == "ngram_jaccard":
            gone = {i for i, (_, c) in brute_components(list(before.items())).items() if i != c}
        else:
            items = [decontaminate.plain(r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
            gone = {
                i for i, t in before.items()
                if any(
                    edit_distance_anywhere(x, decontaminate.plain(t)) <= int(decontaminate.RATE * len(x)) for x in items
                    if any(
                        p in decontaminate.plain(t)
                        for _, p in decontaminate.pieces(x, int(decontaminate.RATE * len(x)))
                    )
                )
            }
        assert after == set(before) - gone
        seen.append(len(before) - len(after))
        kept = spark.createDataFrame(out.collect(), docs.schema)
    assert seen[2] > 0
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(list(r["piece_ids"]) == sp.encode(texts[r["doc_id"]]) for r in last) and len(last) == len(texts)
    whole = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert whole == set(texts)


def test_similar_documents_of_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r[0]: (r[1], r[2]) for r in ngram_join.classes(docs).collect()} == brute_components(rows)
