"""The registered query of each operator, with production parameters, over its whole table; and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import codes, decontaminate, line_dedup, mixing, ngram_join, packing, prefix_trie, repeats, secrets, tokencount, toxicity, vector_dedup, warc
from millrace.llm.common import table


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op1_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"), short_copies=True)


def op6_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_convert": op1_warc_convert,
    "op2_pivotal_mix": op2_pivotal_mix,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_pack_tokens": op6_pack_tokens,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_secret_scan": op8_secret_scan,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_substring_dedup": op13_substring_dedup,
}

#: Base 32 of a SHA-1: each five hexadecimal digits are four characters.
_BASE32 = (
    "array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, CAST(5 * i + 1 AS INT), 5) AS INT) >> k) & 31) + 1 AS INT), 1)), '')), '')"
)
_OP1 = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (h)"""


def _components(nodes: str, links: str) -> str:
    """(id, component) of ``nodes`` (id) by ``links`` (a, b), as the closure of the links; for groups of moderate size."""
    return f"both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}), reach AS (SELECT id AS a, id AS b FROM {nodes} UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b), component AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"


_OP3 = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.id < y.id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.98),
{_components("v", "links")}, degree AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT v.id AS vec_id, coalesce(n, 0) AS n_links, component AS component_id, v.id = component AS kept FROM v JOIN component USING (id) LEFT JOIN degree USING (id)"""

_OP7 = rf"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT id, len(s) AS n FROM s), e AS (SELECT id, unnest(s) AS x FROM s), k AS (SELECT p.id AS a, q.id AS b, count(*) AS k FROM e p JOIN e q ON p.x = q.x AND p.id < q.id GROUP BY ALL),
links AS (SELECT a, b FROM k JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * k >= 85 * (x.n + y.n - k)), {_components("n", "links")}
SELECT id AS doc_id, n AS n_shingles, component AS component_id FROM n JOIN component USING (id)"""

#: The others have no SQL: rounding by draws, training, packing, edit distances of passages and lines, a tokenizer's pieces.
ORACLE_SQL: dict[str, str] = {
    "op1_warc_convert": _OP1,
    "op3_vector_dedup": _OP3,
    "op7_ngram_jaccard": _OP7,
    "op8_secret_scan": secrets.oracle(),
    "op11_vector_codes": codes.oracle(),
    "op12_prefix_trie": prefix_trie.oracle(),
    "op13_substring_dedup": repeats.oracle(),
}
