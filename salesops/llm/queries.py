"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesops.llm import embedding_dedup, fill_middle, fingerprints, html_text, lexical_search, mixing, near_dup, packing, quality, sharding, substring_dedup, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.posteriors(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "evidence", "site_rate", "probability", "kept")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"))
    return packing.number(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.restored(fill_middle.transform(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_toxicity,
    op2_embedding_near_dedup,
    op3_sharding,
    op4_minhash_near_dedup,
    op5_exact_top_k,
    op6_quality_classifier,
    op7_html_extraction,
    op8_substring_dedup,
    op9_mixing,
    op10_packing,
    op11_fill_in_middle,
    op12_fingerprints,
    op13_ranked_search,
)}

ORACLES: dict[str, str] = {
    "op5_exact_top_k": """
        WITH ints AS (
            SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
            FROM ints q JOIN ints x ON q.n = x.n AND q.vec_id <> x.vec_id
            WHERE q.vec_id % 50 = 0),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op2_embedding_near_dedup": """
        WITH RECURSIVE fit AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach AS (
            SELECT vec_id AS node, vec_id AS root FROM embeddings
            UNION
            SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node),
        roots AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
        counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN roots ON roots.node = e.vec_id LEFT JOIN counted ON counted.a = e.vec_id
    """,
    "op8_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
            FROM words, unnest(range(1, len(w) - 48)) AS u(i)),
        firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
        gone AS (
            SELECT DISTINCT doc_id, i + k AS pos
            FROM windows JOIN firsts USING (s), unnest(range(0, 50)) AS v(k)
            WHERE doc_id > first),
        single AS (SELECT doc_id, pos, w[pos] AS word FROM words, unnest(range(1, len(w) + 1)) AS t(pos)),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
            FROM single ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(text, '')) AS kept_sha256
        FROM words LEFT JOIN kept USING (doc_id)
    """,
    "op11_fill_in_middle": r"""
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS unit,
                   list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), i, 8))::BIGINT) AS h
            FROM documents),
        placed AS (
            SELECT *, len(unit) AS n, least(h[1] % (len(unit) + 1), h[2] % (len(unit) + 1)) AS a, greatest(h[1] % (len(unit) + 1), h[2] % (len(unit) + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                        WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM cut),
        pieces AS (
            SELECT *, coalesce(array_to_string(unit[1:a], ''), '') AS prefix, coalesce(array_to_string(unit[a + 1:b], ''), '') AS middle, coalesce(array_to_string(unit[b + 1:n], ''), '') AS suffix
            FROM placed)
        SELECT doc_id, n::BIGINT AS n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM pieces
    """,
    "op13_ranked_search": r"""
        WITH low AS (
            SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
            UNION ALL
            SELECT 1, item_id, 0, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
        term AS (
            SELECT kind, id, row, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM low),
        held AS (SELECT id AS doc_id, row, t, count(*) AS tf FROM term WHERE kind = 0 GROUP BY ALL),
        doc AS (SELECT row, sum(tf)::BIGINT AS n FROM held GROUP BY row),
        whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM doc),
        weight AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, whole GROUP BY t, docs),
        scored AS (
            SELECT i.id AS item_id, h.doc_id, h.row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // terms)))))::BIGINT AS score
            FROM (SELECT DISTINCT id, t FROM term WHERE kind = 1) i JOIN held h USING (t) JOIN weight USING (t) JOIN doc USING (row), whole
            GROUP BY i.id, h.doc_id, h.row),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
