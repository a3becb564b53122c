"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dual_tree, exact_dedup, kneser_ney, language_id, mixing, near_dedup, packing, pii_scan, quality_rules, resharding, secret_scan, token_files, zone_mining
from .common import id_bucket, read_table, run_dir, text_or_empty


def word_bpe() -> str:
    """Path of the tokenizer file; looked up when a query asks for it, so that the other queries do without."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_dir(spark, "op1")
    files = token_files.write_token_files(read_table(spark, sf_dir, "documents"), out, word_bpe(), 2)
    return token_files.read_token_files(spark, out, files)


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), word_bpe(), 2048, 1)


def op3_structural_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"), run_dir(spark, "op4"))


def op5_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read_table(spark, sf_dir, "documents"))


def op6_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), run_dir(spark, "op6"))


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fitted = mixing.fit_mixture(docs, read_table(spark, sf_dir, "labels"), mixing.WEIGHTS, run_dir(spark, "op7"))
    return mixing.mixing_rates(docs, fitted)


def op8_decision_list_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), run_dir(spark, "op8"))


def op9_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    old_shard = lambda path, stretch: F.pmod(F.xxhash64(F.element_at(F.split(path, "/"), -1)) + stretch, F.lit(32))
    moved = resharding.reshard(docs, old_shard, 40, run_dir(spark, "op9"), stretches=32)
    crc = F.crc32(text_or_empty().cast("binary"))
    return moved.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 7) == 2
    model = kneser_ney.train(docs.where(~held_out), run_dir(spark, "op10"))
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.vector_codes(read_table(spark, sf_dir, "embeddings"), run_dir(spark, "op11"))


def op12_character_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii_scan.scan_personal_data(docs, pii_scan.train(docs, run_dir(spark, "op12")))


def op13_zone_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return zone_mining.mine(rows, 50, run_dir(spark, "op13"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_sum_of_squares_packing,
        op3_structural_secrets,
        op4_content_sort,
        op5_hyperdimensional_language,
        op6_coordinate_join,
        op7_soft_mixing,
        op8_decision_list_quality,
        op9_flow_resharding,
        op10_kneser_ney,
        op11_dual_tree_lloyd,
        op12_character_tagger,
        op13_zone_mining,
    )
}



def _lloyd_sql(r: int) -> str:
    """Assignment ``a<r>`` of all parts to codebook ``b<r>``, and the codebook after it."""
    near = f"""a{r} AS (
            SELECT c.vec_id, any_value(c.label) AS label, c.p, any_value(c.w) AS w, arg_min(c.e, (c.d, c.e)) AS e, min(c.d) AS d FROM (
                SELECT x.vec_id, x.label, x.p, x.w, b.e, list_sum(list_transform(list_zip(x.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
                FROM cut x JOIN b{r} b ON x.p = b.p) c GROUP BY c.vec_id, c.p)"""
    mean = f"""s{r} AS (SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(w) AS x, unnest(range(len(w))) AS i FROM a{r}) GROUP BY ALL),
        b{r + 1} AS (
            SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM b{r} b LEFT JOIN (
                SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM s{r} GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)"""
    return near if r == 2 else f"{near}, {mean}"


ORACLE_SQL = {
    "op4_content_sort": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        n AS (SELECT doc_id, length(text) AS points, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM d)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)""",
    "op6_coordinate_join": """
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
        one AS (SELECT min(doc_id) AS rep, g FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
        same AS (SELECT s.doc_id, one.rep FROM s JOIN one ON list_sort(s.g) = one.g WHERE len(s.g) > 0),
        e AS (SELECT rep, len(g) AS n, unnest(g) AS h FROM one),
        c AS (SELECT a.rep AS x, b.rep AS y, a.n AS n, b.n AS m, count(*) AS k FROM e a JOIN e b ON a.h = b.h AND a.rep < b.rep
              WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL),
        l AS (SELECT x, y FROM c WHERE 100 * k >= 75 * (n + m - k) UNION SELECT y, x FROM c WHERE 100 * k >= 75 * (n + m - k)),
        r AS (SELECT rep AS a, rep AS b FROM one UNION SELECT r.a, l.y FROM r JOIN l ON r.b = l.x),
        k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
        SELECT s.doc_id, len(g) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id,
               s.doc_id = coalesce(k.component_id, s.doc_id) AS kept
        FROM s LEFT JOIN same ON s.doc_id = same.doc_id LEFT JOIN k ON same.rep = k.a""",
    "op11_dual_tree_lloyd": f"""
        WITH i AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cut AS (SELECT vec_id, label, k.p, v[k.p * len(v) // 16 + 1:(k.p + 1) * len(v) // 16] AS w FROM i, (SELECT unnest(range(16)) AS p) k),
        b0 AS (SELECT p, w, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM cut QUALIFY e < 64),
        {", ".join(_lloyd_sql(r) for r in range(3))},
        t AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM t""",
    "op13_zone_mining": """
        WITH i AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM i a JOIN i b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY rank <= 3""",
}
