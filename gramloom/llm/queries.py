"""The registered queries of the operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm import bpe, centroids, exact_dedup, fixity, html_text, importance, jaccard_join, language_id, lm_scoring, media, near_dup, packing, toxicity
from gramloom.llm._shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@query(
    "op10_exact_dedup",
    """
    WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY x)
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_multi_50k.tiktoken"))


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("n_offending", F.size("offending")).drop("offending")


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op3_media_columns")
def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.store(table(spark, sf_dir, "documents")))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages as a bad disk might leave it, by rules on page_id: one page in 97 has its first character
    overwritten, one in 4099 has lost its second half, and one in 8209 is gone."""
    half = F.expr("left(html, cast(length(html) / 2 as int))")
    body = F.when(F.col("page_id") % 97 == 5, F.expr("overlay(html placing '?' from 1 for 1)")).when(F.col("page_id") % 4099 == 7, half).otherwise(F.col("html"))
    return pages.filter(F.coalesce(F.col("page_id") % 8209 != 11, F.lit(True))).withColumn("html", body)


_WARC_SQL = """
    WITH a AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
    b AS (
        SELECT page_id, url, CASE WHEN page_id % 97 = 5 AND html <> '' THEN '?' || substr(html, 2)
                                  WHEN page_id % 4099 = 7 THEN left(html, CAST(floor(length(html) / 2) AS INT)) ELSE html END AS html
        FROM a WHERE page_id % 8209 <> 11),
    pa AS (SELECT page_id, url, html, 128 + strlen(CAST(page_id AS VARCHAR)) + strlen(url) + strlen(html) + strlen(CAST(strlen(html) AS VARCHAR)) AS n FROM a),
    pb AS (SELECT page_id, url, html, 128 + strlen(CAST(page_id AS VARCHAR)) + strlen(url) + strlen(html) + strlen(CAST(strlen(html) AS VARCHAR)) AS n FROM b),
    oa AS (SELECT *, CAST(sum(n) OVER (PARTITION BY page_id // 1024 ORDER BY page_id) - n AS BIGINT) AS o FROM pa),
    ob AS (SELECT *, CAST(sum(n) OVER (PARTITION BY page_id // 1024 ORDER BY page_id) - n AS BIGINT) AS o FROM pb),
    j AS (SELECT oa.page_id // 1024 AS file_no, oa.page_id AS slot,
              CASE WHEN ob.page_id IS NULL THEN 'missing' WHEN oa.html <> ob.html THEN 'corrupt' WHEN oa.o <> ob.o THEN 'moved' END AS status,
              oa.o AS primary_offset, oa.n AS primary_length, coalesce(ob.o, -1) AS replica_offset, coalesce(ob.n, -1) AS replica_length
          FROM oa LEFT JOIN ob USING (page_id))
    SELECT * FROM j WHERE status IS NOT NULL
"""


@query("op9_warc_fixity", _WARC_SQL)
def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    both = (p.select(F.col("page_id").alias("slot"), fixity.record(p).alias("record")) for p in (pages, damaged(pages)))
    return fixity.audit(*map(fixity.leaves, both))


@query("op5_minhash_near_dedup")
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(table(spark, sf_dir, "documents")).drop("_row", "text_key")


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def _cluster_sql() -> str:
    """Three rounds and a last assignment; floor(sum / n) in whole numbers."""
    out = """WITH k AS MATERIALIZED (
        SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM k ORDER BY h, v LIMIT 16))"""
    for i in range(4):
        out += f""",
    a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS m
        FROM (SELECT k.r, vec_id, k.v, c, CAST(list_sum(list_transform(list_zip(k.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM k, c{i}) GROUP BY r)"""
        if i < 3:
            out += f""",
    e{i} AS (SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}),
    f{i} AS (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM e{i} GROUP BY c, j),
    g{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM f{i} GROUP BY c),
    c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(g{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN g{i} ON g{i}.c = c{i}.c)"""
    return out + """
    SELECT vec_id, CAST(m.c AS INT) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
           sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.c = m.c"""


@query("op13_centroid_clusters", _cluster_sql())
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


_RESAMPLE_SQL = r"""
    WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    dw AS MATERIALIZED (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
    bw AS MATERIALIZED (SELECT w, count(*) AS k FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY w),
    h AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
    y AS (SELECT w, list_transform(range(0, length(h) // 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT)) AS b FROM h),
    v AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295) % 10000 AS bucket FROM y, crc),
    s AS (SELECT bucket, sum(k) AS s FROM dw JOIN v USING (w) GROUP BY bucket), t AS (SELECT bucket, sum(k) AS t FROM bw JOIN v USING (w) GROUP BY bucket),
    n AS (SELECT (SELECT coalesce(sum(k), 0) FROM dw)::DOUBLE AS a, (SELECT coalesce(sum(k), 0) FROM bw)::DOUBLE AS b),
    g AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (n.a + 10000) / ((s::DOUBLE + 1) * (n.b + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
    x AS (SELECT doc_id, sum(k * gain) AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY doc_id),
    u AS (SELECT doc_id, (CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296 AS u FROM documents),
    z AS (SELECT d.doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln(u))))::BIGINT AS score FROM d JOIN u USING (doc_id) LEFT JOIN x USING (doc_id)),
    o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM o) * 10 // 100 THEN rank END AS rank FROM z LEFT JOIN o USING (doc_id)
"""


@query("op11_importance_resampling", _RESAMPLE_SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_JACCARD_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS MATERIALIZED (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
    e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c)
    SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query("op12_ngram_jaccard", _JACCARD_SQL)
def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))
