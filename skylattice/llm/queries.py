"""The operators as queries over the shared test tables, with SQL forms where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import anchors, decontaminate, mixing, quality, repeats, secrets, similarity_join, surrogates, token_files, turns, url_rules, whitening, wrappers
from skylattice.operators.materialise import shared_folder

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(_table(spark, sf_dir, "pages"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.with_surrogates(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    token_files.write_token_files(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return token_files.read_token_files(spark, folder)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages")).drop("pattern")


def op7_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.similarity_classes(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(_table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.digests(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.damage_and_repair(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_benchmark_decontamination, op3_html_extraction, op4_surrogates, op5_token_files, op6_url_filters, op7_similarity_join, op8_secret_scans, op9_repeated_passages, op10_source_mixing,
                          op11_embedding_whitening, op12_substring_dedup, op13_conversation_repair)
}


def _words(text: str, keep_marks: bool) -> str:
    """SQL list of the words of a text."""
    split = f"regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+')"
    word = "w" if keep_marks else "regexp_replace(w, '[!-/:-@\\[-`{-~]', '', 'g')"
    return f"[{word} for w in {split} if {word} <> '']"


def _shingle_sql(table: str, key: str, text: str, n: int, keep_marks: bool) -> str:
    """SQL of distinct (key, shingle) rows; fewer words than n make one shingle."""
    return f"""SELECT DISTINCT {key}, array_to_string(CASE WHEN len(ws) < {n} THEN ws ELSE list_slice(ws, i, i + {n - 1}) END, ' ') AS s
        FROM (SELECT {key}, ws, unnest(generate_series(1, greatest(1, len(ws) - {n - 1}))) AS i FROM (SELECT {key}, {_words(text, keep_marks)} AS ws FROM {table}) WHERE len(ws) > 0)"""


_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH d AS ({_shingle_sql('documents', 'doc_id', 'lower(text)', decontaminate.SHINGLE, False)}),
b AS ({_shingle_sql('benchmark', 'item_id', 'lower(text)', decontaminate.SHINGLE, False)}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found, count(*) / n_shingles::DOUBLE AS containment
FROM b JOIN d USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) >= {decontaminate.CONTAINMENT} * n_shingles
"""


def _pattern_sql(verdict: str) -> str:
    tests = [f"regexp_matches(u, '{p.regex.replace(chr(39), chr(39) * 2)}')" for p in url_rules.patterns() if p.verdict == verdict]
    return "(" + " OR ".join(tests) + ")"


_LISTED = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_rules.LIST_RULES)
OP6_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p),
r AS (SELECT * FROM (VALUES {_LISTED}) AS t(rh, rp, rv)),
best AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv FROM h JOIN r
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
v AS (SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u FROM h)
SELECT h.page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN rv WHEN {_pattern_sql('allow')} THEN 'allow'
  WHEN {_pattern_sql('block')} THEN 'block' ELSE 'allow' END AS verdict
FROM h JOIN v ON h.page_id = v.page_id LEFT JOIN best ON h.page_id = best.page_id
"""

OP7_SQL = f"""
WITH RECURSIVE s AS MATERIALIZED ({_shingle_sql('documents', 'doc_id', _ASCII_LOWER, 4, True)}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM s AS a JOIN s AS b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.y) AS component_id
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id, n.n
"""

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words("coalesce(text, '')", True)} AS ws FROM documents),
w AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + {anchors.LENGTH - 1}), ' ') AS s
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - {anchors.LENGTH - 1})) AS i FROM d WHERE len(ws) >= {anchors.LENGTH})),
again AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, i + k AS i FROM (SELECT rid, i FROM w JOIN again USING (s)), range({anchors.LENGTH}) AS r(k)),
words AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

SQL: dict[str, str] = {"op2_benchmark_decontamination": OP2_SQL, "op6_url_filters": OP6_SQL, "op7_similarity_join": OP7_SQL, "op12_substring_dedup": OP12_SQL}
