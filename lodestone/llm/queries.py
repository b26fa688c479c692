"""The queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontamination import decontaminate
from lodestone.llm.divergence import divergences
from lodestone.llm.embedding_dedup import near_duplicates
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.mixing import mix_sources
from lodestone.llm.ngram_join import jaccard_join
from lodestone.llm.pii import find_pii, listed
from lodestone.llm import sentencepiece_fst as sp
from lodestone.llm import warc
from lodestone.llm.resampling import resample
from lodestone.llm.topk import top_k
from lodestone.llm.toxicity import score_toxicity, train
from lodestone.llm.url_filter import filter_urls
from lodestone.operators.shared import spread

#: Where the model's file is on this machine; a parameter of the query.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, threshold=(90, 100))


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sp.encode(docs, sp.model_bytes(model)).select("doc_id", "n_tokens", "ids", "round_trip")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica in which some records are damaged by rule: one changed in 97, one lost in 211."""
    pages = table(spark, sf_dir, "pages").select("page_id", warc.record_text(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))
    harmed = F.when(F.col("page_id") % 97 == 13, F.translate("record", "e", "3")).otherwise(F.col("record"))
    laid = warc.layout(warc.hashed(pages.withColumn("harmed", F.sha2(harmed, 256))))
    place = ["file", "ordinal", "offset", "length"]
    ours = laid.select("page_id", *place, "hash")
    theirs = laid.where(~(F.coalesce(F.col("page_id") % 211 == 7, F.lit(False)))).select(*place, F.col("harmed").alias("hash"))
    found = warc.audit(ours, theirs)
    return found.join(ours.select("page_id", "file", "ordinal"), ["file", "ordinal"]).select("page_id", *place, "problem")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.95)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_kept", "dropped")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op4_warc_fixity": op4_warc_fixity,
    "op5_url_filter": op5_url_filter,
    "op6_exact_topk": op6_exact_topk,
    "op7_pii": op7_pii,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_decontamination": op12_decontamination,
    "op13_importance_resampling": op13_importance_resampling,
}

HOST = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        sets AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY ALL),
        g AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM sets),
        shared AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.rep <> b.rep
                   AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
        links AS (SELECT a, b FROM shared WHERE 100 * k >= 90 * (na + nb - k)),
        reach(a, b) AS (SELECT rep, rep FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, coalesce(count(*) FILTER (len(s.s) > 0) OVER (PARTITION BY list_sort(s.s)), 1) AS n_copies
        FROM s LEFT JOIN sets ON sets.s = list_sort(s.s) LEFT JOIN comp c ON c.a = sets.rep""",
    "op4_warc_fixity": r"""
        WITH r AS (SELECT page_id, concat_ws(chr(13) || chr(10), 'WARC/1.0', 'WARC-Type: resource', 'WARC-Record-ID: <urn:page:' || page_id || '>', 'WARC-Target-URI: ' || coalesce(url, ''),
                   'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || octet_length(encode(coalesce(html, '')))) || chr(13) || chr(10) || chr(13) || chr(10)
                   || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
        l AS (SELECT page_id, record, page_id // 256 AS file, octet_length(encode(record)) AS length FROM r),
        o AS (SELECT *, row_number() OVER w - 1 AS ordinal, (sum(length) OVER w - length)::BIGINT AS "offset" FROM l WINDOW w AS (PARTITION BY file ORDER BY page_id))
        SELECT page_id, file, ordinal, "offset", length, CASE WHEN page_id % 211 = 7 THEN 'missing' ELSE 'changed' END AS problem
        FROM o WHERE page_id % 211 = 7 OR page_id % 97 = 13""",
    "op5_url_filter": f"""
        WITH rules(host, path, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
        parsed AS (SELECT page_id, {HOST} AS host, {PATH} AS path FROM pages),
        fits AS (
            SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
                   row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, r.host || r.path) AS n
            FROM parsed p JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parsed p LEFT JOIN fits f ON f.page_id = p.page_id AND f.n = 1""",
    "op6_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op8_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                  AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
        reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT m.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, m.vec_id = c.c AS kept
        FROM embeddings m JOIN comp c ON c.a = m.vec_id LEFT JOIN n ON n.a = m.vec_id""",
    "op11_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 3),
        v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        g AS (SELECT d.lang, d.source, coalesce(any_value(n.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) n USING (lang, source) GROUP BY ALL),
        p AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (g.n + v.v)::HUGEINT AS p, 1 + 1000000000::HUGEINT * (kept.c + 1) // (v.n + v.v)::HUGEINT AS q
              FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                      LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM all_pairs
        UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 200""",
    "op12_decontamination": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS} AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item_id, {WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS x
                FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        places AS (SELECT k, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS x FROM (SELECT k, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM win))),
        occ AS (SELECT k, l, i, item_id FROM places JOIN win USING (l, x)),
        hit AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest(range(i, i + l)) AS p FROM occ) GROUP BY k),
        its AS (SELECT k, list_sort(list(DISTINCT item_id)) AS items FROM occ WHERE item_id IS NOT NULL GROUP BY k)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (k) LEFT JOIN its USING (k)""",
    "op13_importance_resampling": rf"""
        WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS} AS w FROM documents),
        f AS (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM d),
        h AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM (SELECT {WORDS} AS w FROM benchmark)),
        bytes AS (SELECT x, list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda b: ('0x' || b)::UBIGINT)) AS b FROM (SELECT x FROM f UNION SELECT x FROM h)),
        bucket AS (SELECT x, xor(list_reduce(b, lambda c, y: xor(t[((xor(c, y) & 255) + 1)::BIGINT], c >> 8)), 4294967295::UBIGINT) % 10000 AS bucket FROM bytes, crc),
        s AS (SELECT bucket, count(*) AS s FROM f JOIN bucket USING (x) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM h JOIN bucket USING (x) GROUP BY bucket),
        g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM h) + 10000)))) AS g FROM s LEFT JOIN t USING (bucket)),
        m AS (SELECT k, count(*) AS n_features, floor(sum(g) / count(*))::BIGINT AS weight FROM f JOIN bucket USING (x) JOIN g USING (bucket) GROUP BY k),
        r AS (SELECT k, doc_id, len(w) >= 20 AS long, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (k)),
        o AS (SELECT *, row_number() OVER (PARTITION BY long ORDER BY score DESC, doc_id) AS n FROM r)
        SELECT doc_id, n_features, weight, score, CASE WHEN long AND n <= 25 * (SELECT count(*) FROM r WHERE long) // 100 THEN n END AS rank FROM o""",
}
