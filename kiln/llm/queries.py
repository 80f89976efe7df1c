"""The queries of the training-data operators: each applies one, with production parameters, to its
whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kiln.llm import (ann, disclosure, impact_search, license_scan, mixing, ngram_join, packing, quality_rules, resampling, suffix_dedup, syncmers,
                      toxicity, url_rules)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_url_rules")
def op1(spark, sf_dir):
    """One row per page: host, path, fixed rule and verdict."""
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


@query("op2_toxicity")
def op2(spark, sf_dir):
    """One row per document: its toxicity score."""
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query("op3_mixing")
def op3(spark, sf_dir):
    """One row per document: what the mix takes of it."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


@query("op4_suffix_array")
def op4(spark, sf_dir):
    """One row per document with passages of 50 words or more that another document holds."""
    spans = suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return spans.select("doc_id", "spans", "removable", words("spans").alias("repeated_words"), words("removable").alias("removable_words"))


@query("op5_posting_lists")
def op5(spark, sf_dir):
    """The 20 nearest vectors of each vector whose id is divisible by 20."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


@query("op6_ngram_jaccard")
def op6(spark, sf_dir):
    """One row per document: the size of its shingle set and its near-duplicate component."""
    return ngram_join.near_duplicate_components(_table(spark, sf_dir, "documents"))


@query("op7_syncmers")
def op7(spark, sf_dir):
    """One row per document: its fingerprint, and its likeness to an edited and to the next text."""
    return syncmers.fingerprint_documents(_table(spark, sf_dir, "documents"))


@query("op8_packing")
def op8(spark, sf_dir):
    """One row per piece of a document: its sequence and place."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@query("op9_licences")
def op9(spark, sf_dir):
    """One row per paragraph that speaks of a licence: its family, or unknown."""
    return license_scan.scan_licences(_table(spark, sf_dir, "documents"))


@query("op10_quality_rules")
def op10(spark, sf_dir):
    """One row per document: its quality score."""
    return quality_rules.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_norm_buckets", f"""
WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, len(terms) AS n, term, count(*) AS tf
       FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
found AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
          FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM found WHERE score > 0)
WHERE rank <= 50""")
def op11(spark, sf_dir):
    """The 50 best documents of each benchmark item."""
    return impact_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op12_disclosure")
def op12(spark, sf_dir):
    """One row per document: its personal data, and the terms that reveal some."""
    return disclosure.find_personal_data(_table(spark, sf_dir, "documents"))


_BYTES = "list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)"


@query("op13_resampling", f"""
WITH tbl AS (SELECT list(list_reduce(list_prepend(i, range(8)),
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) t(i)),
d AS (SELECT doc_id, unnest({_TERMS}) AS word FROM documents),
q AS (SELECT unnest({_TERMS}) AS word FROM benchmark),
words AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
          FROM (SELECT word FROM d UNION SELECT word FROM q), tbl),
s AS (SELECT bucket, count(*) AS s FROM d JOIN words USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM q JOIN words USING (word) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
         FROM s LEFT JOIN t USING (bucket), sums),
w AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS g FROM d JOIN words USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
             floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
           FROM documents LEFT JOIN w USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, weight + noise AS score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM placed) THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)""")
def op13(spark, sf_dir):
    """One row per document: its weight towards the benchmark texts, its score, and its rank if drawn."""
    return resampling.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("key")
