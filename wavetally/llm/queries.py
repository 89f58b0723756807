"""The subpackage's queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import table
from . import bpe, bytebpe, decontaminate, langid, linededup, lmscore, phrases, pii, secrets, simhash, topk, vectorcodes, warc


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages")).drop("uri")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_spread_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op11_byte_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.token_digests(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.backoff_scores(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).drop("languages")


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_round_trip,
        op2_simhash_near_dedup,
        op3_benchmark_decontamination,
        op4_exact_top_k,
        op5_pii,
        op6_secret_scan,
        op7_bpe_encode_decode,
        op8_line_dedup,
        op9_lm_scoring,
        op10_language_id,
        op11_byte_bpe_encode_decode,
        op12_vector_codes,
        op13_phrase_collocations,
    )
}

#: Parts of integer vectors in long form, and two rounds of codebooks from the parts of the 64 smallest ids.
CODES_SQL = """
        WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS w FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT vec_id, label, p, v[p * w + 1 : p * w + w] AS x FROM k, unnest(range(16)) AS r(p)),
        b0 AS (SELECT p, e, x AS y FROM (SELECT *, dense_rank() OVER (ORDER BY vec_id) - 1 AS e FROM q) WHERE e < 64)"""
for _k in (0, 1, 2):
    CODES_SQL += f""",
        d{_k} AS (SELECT vec_id, label, p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))::BIGINT AS d FROM q JOIN b{_k} USING (p)),
        a{_k} AS (SELECT vec_id, label, p, any_value(x) AS x, min(d) AS d, arg_min(e, d * 64 + e) AS e FROM d{_k} GROUP BY vec_id, label, p),
        m{_k} AS (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS c FROM a{_k}, unnest(range(1, len(x) + 1)) AS r(i) GROUP BY p, e, i),
        n{_k} AS (SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY i) AS y FROM m{_k} GROUP BY p, e),
        b{_k + 1} AS (SELECT p, e, coalesce(n{_k}.y, b{_k}.y) AS y FROM b{_k} LEFT JOIN n{_k} USING (p, e))"""

ORACLE_SQL = {
    "op12_vector_codes": f"""{CODES_SQL},
        h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(y, ',') AS t FROM b2)),
        c AS (SELECT vec_id, label, string_agg(lower(lpad(printf('%x', e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id, label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h""",
    "op1_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
        FROM f""",
    "op13_phrase_collocations": """
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
        t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
        f AS (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS a FROM w, unnest(range(1, 6)) AS r(m), unnest(range(1, len(ws) - m + 2)) AS s(i) GROUP BY ALL HAVING count(*) >= 100),
        c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2),
        g AS (SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, max(a) AS longer FROM c, unnest(range(2, m)) AS r(k), unnest(range(1, m - k + 2)) AS s(i) GROUP BY ALL),
        k AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1 :], ' ') AS tail FROM c LEFT JOIN g ON c.lang = g.lang AND c.phrase = g.phrase, unnest(range(1, m)) AS r(k) WHERE longer IS NULL OR 100 * longer < 100 * c.a),
        s AS (SELECT k.lang, k.phrase, k.a, k, l.a AS l, r.a AS r, n, (1000::HUGEINT * k.a * n // (l.a::HUGEINT * r.a))::BIGINT AS score FROM k JOIN f l ON k.lang = l.lang AND k.head = l.phrase JOIN f r ON k.lang = r.lang AND k.tail = r.phrase JOIN t ON k.lang = t.lang
              QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s QUALIFY rank <= 2000""",
    "op4_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op9_lm_scoring": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS ws FROM documents),
        t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM w),
        b AS (SELECT doc_id, w, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY pos), '') AS v FROM t),
        u AS (SELECT w, count(*) AS c FROM t GROUP BY w UNION ALL SELECT '', count(DISTINCT doc_id) FROM t),
        c AS (SELECT v, w, count(*) AS c FROM b GROUP BY v, w HAVING count(*) >= 2),
        s AS (SELECT b.doc_id, c.c IS NULL AS backed, CASE WHEN c.c IS NOT NULL THEN ln(c.c / uv.c::DOUBLE) ELSE ln(0.4 * uw.c / (SELECT count(*) FROM t)) END AS score
              FROM b LEFT JOIN c ON b.v = c.v AND b.w = c.w JOIN u uv ON b.v = uv.w JOIN u uw ON b.w = uw.w)
        SELECT d.doc_id, count(s.doc_id)::BIGINT AS n_tokens, (count(*) FILTER (s.backed))::BIGINT AS n_backoff, round(sum(s.score) / count(s.doc_id), 6) AS mean_logprob
        FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id""",
    "op8_line_dedup": """
        WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        t AS (SELECT doc_id, source, line, pos, trim(line, ' ') AS k FROM l),
        s AS (SELECT k, min(doc_id) AS first_id FROM t WHERE k <> '' AND source IS NOT NULL GROUP BY k HAVING count(DISTINCT source) >= 5),
        g AS (SELECT t.*, s.k IS NOT NULL AND s.first_id IS DISTINCT FROM t.doc_id AS gone FROM t LEFT JOIN s ON t.k = s.k)
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
               count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed
        FROM g GROUP BY doc_id""",
}
