"""The queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format, decontaminate, fingerprint, langid, ngram_join, quality, sentencepiece_viterbi, token_store, toxicity,
    url_filter,
)
from .common import own_path, stored

END_ID = 2
RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]
EXTRA_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_path(spark, "tokens")
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        token_store.write_tokens(table(spark, sf_dir, "documents"), path, f.read(), END_ID)
    return token_store.summary(token_store.read_tokens(spark, path))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_filter.judge(
        table(spark, sf_dir, "pages").select("page_id", "url"), rules,
    ).select("page_id", "host", "path", "rule", "verdict")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = stored(fingerprint.edited_pairs(docs), "pairs")
    groups = fingerprint.exact_groups(
        docs, prints=pairs.select("doc_id", "fingerprint"),
    ).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))
    pairs = pairs.join(groups, "doc_id", "left")
    near = [fingerprint.likeness("fingerprint", f"{x}_fingerprint").alias(f"near_{x}") for x in ("edited", "next")]
    return pairs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near, "group_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return sentencepiece_viterbi.encode(table(spark, sf_dir, "documents"), f.read(), ["doc_id"])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(EXTRA_TURNS, "conv_id long, turn long, role string, text string")
    rows = chat_format.format_turns(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    )
    read = rows.select(
        "conv_id", chat_format.parse(F.col("text")).alias("turns"),
        chat_format.loss_text(F.col("segments")).alias("loss"), F.length("text").cast("long").alias("formatted_chars"),
        "valid", "first_bad",
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
        "valid", "first_bad",
    )


QUERIES = {
    "op1_ngram_jaccard": op1,
    "op2_token_ids": op2,
    "op3_quality": op3,
    "op4_decontamination": op4,
    "op5_url_filter": op5,
    "op6_fingerprint": op6,
    "op7_language_id": op7,
    "op8_sentencepiece": op8,
    "op9_toxicity": op9,
    "op10_chat_format": op10,
}


def _escaped_chars(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in chat_format.Template().controls:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return f"length({out})"


_MARKS = chat_format.Template()
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
_TURN_ROWS = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in EXTRA_TURNS)

SQL = {
    "op1_ngram_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
        flat AS (SELECT doc_id, unnest(s) AS t FROM sets),
        pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS inter FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT u, v FROM pairs JOIN sets x ON x.doc_id = u JOIN sets y ON y.doc_id = v WHERE 100 * inter >= 75 * (len(x.s) + len(y.s) - inter)),
        ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
        reach AS (SELECT u, v FROM ways UNION SELECT r.u, w.v FROM reach r JOIN ways w ON r.v = w.u),
        least AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sets LEFT JOIN least ON u = doc_id""",
    "op5_url_filter": f"""
        WITH rules(verdict, r_host, r_path) AS (VALUES {_RULE_ROWS}),
        cut AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        keyed AS (SELECT *, row_number() OVER () AS k FROM parts),
        fits AS (SELECT k, r_host || r_path AS rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(r_host || r_path) DESC, length(r_host) DESC, verdict DESC) AS n
            FROM keyed JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM keyed LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (k)""",
    "op10_chat_format": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES {_TURN_ROWS}) AS e(conv_id, turn, role, text)),
        placed AS (SELECT *, row_number() OVER w AS n, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS last FROM turns
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        judged AS (SELECT *, CASE WHEN n = 1 THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant'
            WHEN before = 'assistant' THEN role = 'user' ELSE false END AS allowed FROM placed),
        runs AS (SELECT conv_id, coalesce(min(n) FILTER (NOT allowed) - 1, max(CASE WHEN last AND role <> 'assistant' THEN n END)) AS first_bad FROM judged GROUP BY conv_id),
        said AS (SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
            CAST(sum({len(_MARKS.begin) + len(_MARKS.between) + len(_MARKS.end)} + {_escaped_chars('role')} + {_escaped_chars('text')}) AS BIGINT) AS formatted_chars
            FROM turns GROUP BY conv_id)
        SELECT said.*, first_bad IS NULL AS valid, CAST(first_bad AS BIGINT) AS first_bad FROM said JOIN runs ON said.conv_id IS NOT DISTINCT FROM runs.conv_id""",
}
