"""The registered queries of this package, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import avi, divergence, embeddings, html_blocks, language, mixing, packing, periodic, pii, resharding, simhash, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": _over("documents", simhash.op1),
        "op2_embeddings": _over("embeddings", embeddings.op2),
        "op3_warc": _over("pages", warc.op3),
        "op5_resharding": _over("documents", resharding.op5),
        "op4_avi": _over("documents", avi.op4),
        "op6_language": _over("documents", language.op6),
        "op7_packing": _over("documents", packing.op7),
        "op8_surrogates": _over("documents", pii.op8),
        "op9_mixing": _mixing,
        "op10_html_blocks": _over("pages", html_blocks.op10),
        "op11_token_counts": _over("documents", token_counts.op11),
        "op12_periodic_runs": _over("documents", periodic.op12),
        "op13_divergence": _over("documents", divergence.op13),
    }


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))
_SQL = {
    "op2_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT r.s, l.b FROM reach r JOIN links l ON r.t = l.a),
least AS (SELECT s, min(t) AS component_id FROM reach GROUP BY s), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN least ON s = vec_id LEFT JOIN degree ON a = vec_id""",
    "op3_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), least AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p JOIN least USING (h)""",
    "op13_divergence": r"""WITH d AS (SELECT row_number() OVER () AS i, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 30), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d), n AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
c AS (SELECT lang, source, term, v, coalesce(c, 0) AS c FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)),
t AS (SELECT *, sum(c) OVER (PARTITION BY lang, source) AS sn, sum(c) OVER (PARTITION BY lang) AS ln, sum(c) OVER (PARTITION BY lang, term) AS lc FROM c),
s AS (SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 5)) // (sn + 5 * v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (lc + 5)) // (ln + 5 * v))::BIGINT AS q FROM t),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE c > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 50""",
}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are tested by brute force, round trips or held-out accuracy."""
    return dict(_SQL)
