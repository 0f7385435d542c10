"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from worklens.llm import divergence, extraction, line_rules, lm, packing, pieces, quality, runs, urls
from worklens.llm.common import table
from worklens.llm.exact_dedup import exact_dedup
from worklens.llm.pivots import near_dedup
from worklens.llm.simhash import simhash_groups
from worklens.llm.substring import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query(
    "op10_exact_dedup",
    """
    WITH n AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    )
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM n
    """,
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("bucket")


@query("op3_quality")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, weights).select("doc_id", "held_out", "score", "predicted")


@query("op9_simhash")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@query("op7_best_fit_packing")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_sentencepiece")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_substring_dedup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_pivot_near_dedup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"))


@query("op6_url_filter")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op1_html_text")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract_pages(pages, extraction.train(pages))


@query("op5_context_tree_lm")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


_TERMS_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    t AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
    k AS (SELECT lang, term, count(*) AS lang_count FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
    v AS (SELECT lang, count(*) AS terms, sum(lang_count) AS lang_total FROM k GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
    s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (
      SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (s.total + 5 * v.terms) AS p,
             1 + (1000000000 * (k.lang_count + 5)::HUGEINT) // (v.lang_total + 5 * v.terms) AS q
      FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
    ),
    pairs AS (
      SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
        ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    ),
    r AS (
      SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
      UNION ALL
      SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM p WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", _TERMS_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


_LINES_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
    a AS (SELECT rid, string_split_regex(text, '[\x20\x09-\x0D]+') AS words FROM d),
    w AS (SELECT * FROM (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM a) x WHERE word <> ''),
    n AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
    v AS (SELECT rid, i, word, lead(word) OVER o AS second, lead(word, 2) OVER o AS third FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
    f AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, second, third) AS times FROM v WHERE third IS NOT NULL),
    r AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM f, (VALUES (0), (1), (2)) x(o) WHERE times > 1 GROUP BY rid),
    l AS (SELECT rid, host, md5(text) AS digest, unnest(string_split(text, chr(10))) AS line FROM d),
    h AS (
      SELECT *, trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS normal
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    ),
    u AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM h GROUP BY rid),
    common AS (SELECT host, normal FROM h GROUP BY ALL HAVING count(DISTINCT digest) > 20),
    gone AS (SELECT rid, sum(1 + length(normal) - length(replace(normal, ' ', ''))) AS n_common_words FROM h JOIN common USING (host, normal) GROUP BY rid),
    m AS (
      SELECT d.rid, d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_common_words, 0)::BIGINT AS n_common_words
      FROM d LEFT JOIN n USING (rid) LEFT JOIN r USING (rid) LEFT JOIN u USING (rid) LEFT JOIN gone USING (rid)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_common_words) >= 33 * n_words AS kept, n_common_words
    FROM m
"""


@query("op12_line_rules", _LINES_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(table(spark, sf_dir, "documents"), plant=True)
