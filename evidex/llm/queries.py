"""The registered query of each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidex.llm import (
    bpe, caps, decontaminate, licenses, mixing, quality, shard, simhash, substring, toxicity, variants, warc, whiten,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return mixing.mix(docs, _table(spark, sf_dir, "labels")).drop("lang", "text")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return shard.place(docs.select("doc_id"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(_table(spark, sf_dir, "embeddings"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_toxicity": op3_toxicity,
    "op4_licenses": op4_licenses,
    "op5_warc": op5_warc,
    "op6_shards": op6_shards,
    "op7_substrings": op7_substrings,
    "op8_decontaminate": op8_decontaminate,
    "op9_caps": op9_caps,
    "op10_quality": op10_quality,
    "op11_bpe": op11_bpe,
    "op12_whitening": op12_whitening,
    "op13_variants": op13_variants,
}

ORACLES: dict[str, str] = {
    "op5_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
        ), d AS (SELECT page_id, n, sha1(html) AS digest FROM p),
        o AS (SELECT digest, max(page_id) AS owner FROM d WHERE n >= 1000 GROUP BY digest)
        SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
            CASE WHEN o.owner IS NULL OR o.owner = d.page_id THEN 'response' ELSE 'revisit' END
                AS record_type,
            CASE WHEN o.owner <> d.page_id THEN o.owner END AS refers_to
        FROM d LEFT JOIN o ON d.digest = o.digest AND d.n >= 1000
    """,
    "op7_substrings": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), s AS (
            SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) > 12
        ), g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS t FROM s),
        m AS (SELECT t, min(doc_id) AS least FROM g GROUP BY t),
        hit AS (SELECT g.doc_id, g.i FROM g JOIN m USING (t) WHERE m.least < g.doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM hit),
        k AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS j FROM w WHERE len(words) > 0),
        r AS (
            SELECT k.doc_id, count(*) AS n_words, count(gone.j) AS n_removed,
                coalesce(string_agg(k.words[k.j], ' ' ORDER BY k.j) FILTER (WHERE gone.j IS NULL), '') AS kept
            FROM k LEFT JOIN gone ON k.doc_id = gone.doc_id AND k.j = gone.j GROUP BY k.doc_id
        )
        SELECT w.doc_id, CAST(coalesce(r.n_words, 0) AS BIGINT) AS n_words,
            CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
            sha256(coalesce(r.kept, '')) AS kept_sha256
        FROM w LEFT JOIN r ON w.doc_id = r.doc_id
    """,
    "op9_caps": """
        WITH RECURSIVE good AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
                ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT c.a AS vec_id, coalesce(n.n, 0) AS n_links, c.component_id,
            c.a = c.component_id AS kept
        FROM c LEFT JOIN n ON n.a = c.a
    """,
    "op13_variants": r"""
        WITH RECURSIVE bits AS (
            SELECT i, i AS c, 0 AS k FROM range(256) t(i)
            UNION ALL
            SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
        ), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
        runs AS (
            SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
            FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents)
            WHERE length(r) >= 6 GROUP BY ALL
        ), bytes AS (SELECT *, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x FROM runs),
        hashed AS (
            SELECT run, k, xor(list_reduce(
                list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
                lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) AS h
            FROM bytes, crc
        ), spelled AS (
            SELECT k, CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT))
                ELSE run END AS word FROM hashed
        ), words AS (
            SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
        ), places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        holed AS (
            SELECT word, n, i, left(word, i - 1) || '_' || substr(word, i + 1) AS pattern,
                left(word, i - 1) || substr(word, i + 1) AS shorter FROM places
        ), near AS (
            SELECT a.word, a.n, b.word AS other, b.n AS m FROM holed a JOIN holed b ON a.pattern = b.pattern AND a.i = b.i AND a.word <> b.word
            UNION SELECT h.word, h.n, w.word, w.n FROM holed h JOIN words w ON h.shorter = w.word
            UNION SELECT w.word, w.n, h.word, h.n FROM holed h JOIN words w ON h.shorter = w.word
        ), best AS (
            SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word
        ), formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form,
                CASE WHEN m >= 5 * w.n THEN m END AS form_n
            FROM words w LEFT JOIN best USING (word)
        ), chain AS (
            SELECT word, word AS root FROM formed
            UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
        )
        SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM formed f
        JOIN chain c USING (word) JOIN formed e ON e.word = c.root AND e.form IS NULL
    """,
}
