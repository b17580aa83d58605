"""The queries of this package, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoded
from .exact_dedup import exact_groups
from .language_id import languages
from .license_scan import scan
from .line_dedup import dedup_lines
from .maxscore import top_k
from .mixing import mixture
from .phrases import collocations
from .shared import table
from .simhash import hex_print, near_components
from .suffix_dedup import repeats
from .toxicity import toxicity
from .vector_codes import compressed
from .warc import archive_roundtrip


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("detections")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "line_id", "component_id", "kept")


def op4_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).drop("check")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_print().alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_roundtrip(table(spark, sf_dir, "pages")).drop("url", "block")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents")).drop("spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compressed(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return found.select("vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_exact_dedup,
        op3_line_dedup,
        op4_maxscore_topk,
        op5_source_mixing,
        op6_simhash_near_dedup,
        op7_warc,
        op8_bpe,
        op9_language_id,
        op10_toxicity,
        op11_suffix_dedup,
        op12_vector_codes,
        op13_phrases,
    )
}

def _codebook_sql() -> str:
    """Four rounds over all pairs of a part and an entry, in whole numbers."""
    steps = [
        """v AS MATERIALIZED (
            SELECT vec_id, label, w, row_number() OVER (ORDER BY vec_id, w) AS n
            FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
                  FROM embeddings
                  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)),
        p AS MATERIALIZED (SELECT n, p, w[p * len(w) // 4 + 1 : (p + 1) * len(w) // 4] AS x FROM v, range(4) AS r(p)),
        c0 AS MATERIALIZED (SELECT p, n - 1 AS e, x AS c FROM p WHERE n <= 256)"""
    ]
    for k in range(5):
        steps.append(f"""a{k} AS MATERIALIZED (
            SELECT n, p, min(256 * d + e) AS best
            FROM (SELECT n, p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{k} USING (p))
            GROUP BY n, p)""")
        steps.append(f"""s{k} AS MATERIALIZED (
            SELECT p, e, list(x ORDER BY i) AS c
            FROM (SELECT p, e, i, CAST((s - ((s % m) + m) % m) // m AS BIGINT) AS x
                  FROM (SELECT p, best % 256 AS e, i, sum(x[i]) AS s, count(*) AS m FROM a{k} JOIN p USING (n, p), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL))
            GROUP BY p, e),
        c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(s{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN s{k} USING (p, e))""")
    return f"""WITH {", ".join(steps)},
        f AS (SELECT n, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY n)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM c4, LATERAL (SELECT unnest(c) AS x, unnest(range(len(c))) AS i)) AS codebooks_sha256
        FROM f JOIN v USING (n)"""


ORACLES: dict[str, str] = {
    "op12_vector_codes": _codebook_sql(),
    "op13_phrases": """
        WITH t AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents),
        w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
        total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        g AS (
            SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
            FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) AS r(k))),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
        cuts AS (
            SELECT c.lang, c.k, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * c.f // (x.f + y.f) AS BIGINT) AS score
            FROM (SELECT *, string_split(phrase, ' ') AS p, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(p[1 : j], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(p[j + 1 :], ' ')),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        kept AS (
            SELECT * FROM best c
            WHERE NOT EXISTS (
                SELECT 1 FROM best o WHERE o.lang = c.lang AND o.k > c.k AND 100 * o.a >= 80 * c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op4_maxscore_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.w) = len(c.w))
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op5_source_mixing": """
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
                   ['web', 'books', 'code', 'forums'][1 + coalesce(TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '([0-9]{1,9})$', 1), '') AS INTEGER), 0) % 4] AS domain
            FROM documents),
        r AS (
            SELECT doc_id, domain, lang, source, text,
                   CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM d),
        leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(2 * sum(n_tokens) AS BIGINT) AS capacity FROM r GROUP BY ALL),
        d0 AS (
            SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity,
                   CASE domain WHEN 'web' THEN 6 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END AS w,
                   (SELECT CAST(sum(tokens) * 800 // 1000 AS BIGINT) FROM leaves) AS budget
            FROM leaves GROUP BY domain),
        d1 AS (
            SELECT *, budget - coalesce(sum(capacity) OVER (ORDER BY capacity / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lb,
                   sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY capacity / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw
            FROM d0),
        d2 AS (
            SELECT *, min(CASE WHEN capacity * lw > lb * w THEN lw * 1000000000000000000::HUGEINT + lb END) OVER () AS x,
                   max(CASE WHEN capacity * lw > lb * w THEN lw END) OVER () AS rw FROM d1),
        d3 AS (
            SELECT domain, CASE WHEN capacity * lw <= lb * w THEN capacity
                   ELSE (max(CASE WHEN capacity * lw > lb * w AND lw = rw THEN lb END) OVER ()) * w // rw END AS budget FROM d2),
        l1 AS (
            SELECT l.domain, l.lang, sum(l.capacity) AS capacity, any_value(d3.budget) AS budget,
                   CASE l.lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS w
            FROM leaves l JOIN d3 USING (domain) GROUP BY l.domain, l.lang),
        l2 AS (
            SELECT *, budget - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lb,
                   sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER (PARTITION BY domain ORDER BY capacity / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw
            FROM l1),
        l3 AS (SELECT *, max(CASE WHEN capacity * lw > lb * w THEN lw END) OVER (PARTITION BY domain) AS rw FROM l2),
        l4 AS (
            SELECT domain, lang, CASE WHEN capacity * lw <= lb * w THEN capacity
                   ELSE (max(CASE WHEN capacity * lw > lb * w AND lw = rw THEN lb END) OVER (PARTITION BY domain)) * w // rw END AS budget FROM l3),
        s1 AS (SELECT l.*, l4.budget, 1 AS w FROM leaves l JOIN l4 USING (domain, lang)),
        s2 AS (
            SELECT *, budget - coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lb,
                   sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER (PARTITION BY domain, lang ORDER BY capacity / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw
            FROM s1),
        s3 AS (SELECT *, max(CASE WHEN capacity * lw > lb * w THEN lw END) OVER (PARTITION BY domain, lang) AS rw FROM s2),
        s4 AS (
            SELECT domain, lang, source, tokens, CASE WHEN capacity * lw <= lb * w THEN capacity
                   ELSE (max(CASE WHEN capacity * lw > lb * w AND lw = rw THEN lb END) OVER (PARTITION BY domain, lang)) * w // rw END AS budget FROM s3),
        plan AS (
            SELECT domain, lang, source, CAST(CASE WHEN tokens > 0 THEN least(budget // tokens, 2) ELSE 0 END AS INTEGER) AS whole, tokens, budget FROM s4),
        o AS (
            SELECT r.*, whole, budget - whole * tokens AS rest,
                   CAST('0x' || substr(md5('42|' || whole || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS key
            FROM r JOIN plan USING (domain, lang, source)),
        c AS (
            SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM o)
        SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, n_tokens
        FROM c, LATERAL (SELECT unnest(range(0, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)) AS e)""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, strlen(html) AS payload_bytes,
                     CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS f FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to FROM f""",
}
