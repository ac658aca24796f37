"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import asof, cost_packing, flac, html_text, lexical, packing, piece_fst, quality, simhash_dedup, substring_dedup, token_counts, topk, warc_audit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.digest(table(spark, sf_dir, "documents"))


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read(flac.store(table(spark, sf_dir, "documents")))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.by_section(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op9_sentencepiece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_fst.digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages' WARC files of 1,000 ids each against a replica in which the last byte of
    each record with ``page_id % 50 = 7`` is another."""
    pages = table(spark, sf_dir, "pages")
    text = warc_audit.record(F.col("url"), F.col("page_id"), F.col("html"))
    damaged = F.when(F.col("page_id") % 50 == 7, F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit("!"))).otherwise(text)
    file = F.floor(F.col("page_id") / 1000).cast("bigint")
    first, second = (warc_audit.inventory(pages, file, [F.col("page_id")], t) for t in (text, damaged))
    return warc_audit.audit(first, second)


def op11_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.clicks_with_orders(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def queries() -> dict:
    found = [op1_quality_classifier, op2_html_extraction, op3_best_fit_packing, op4_substring_dedup, op5_simhash_dedup, op6_flac_media, op7_exact_topk, op8_token_counts, op9_sentencepiece_fst, op10_warc_fixity, op11_asof_join, op12_lexical_search, op13_cost_packing]
    return {f.__name__: f for f in found}


TOPK_SQL = """
WITH clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM clean q JOIN clean c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""


WARC_SQL = r"""
WITH records AS (
  SELECT page_id, page_id // 1000 AS file,
         concat('WARC/1.0', nl, 'WARC-Type: resource', nl, 'WARC-Record-ID: <urn:record:', CAST(page_id AS VARCHAR), '>', nl,
                'WARC-Date: 2024-01-01T00:00:00Z', nl, 'WARC-Target-URI: ', coalesce(url, ''), nl, 'Content-Type: text/html', nl,
                'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), nl, nl, coalesce(html, ''), nl, nl) AS a
  FROM pages, (SELECT chr(13) || chr(10) AS nl)
), two AS (
  SELECT *, CASE WHEN page_id % 50 = 7 THEN left(a, length(a) - 1) || '!' ELSE a END AS b FROM records
), laid AS (
  SELECT page_id, file, row_number() OVER w - 1 AS place, sha256(a) AS sha_a, sha256(b) AS sha_b,
         CAST(strlen(a) AS BIGINT) AS length_a, CAST(strlen(b) AS BIGINT) AS length_b,
         CAST(sum(strlen(a)) OVER w - strlen(a) AS BIGINT) AS offset_a, CAST(sum(strlen(b)) OVER w - strlen(b) AS BIGINT) AS offset_b
  FROM two WINDOW w AS (PARTITION BY file ORDER BY page_id)
)
SELECT file, place, 'altered' AS kind, offset_a, length_a, sha_a, offset_b, length_b, sha_b FROM laid WHERE sha_a <> sha_b
"""


REPEATS_SQL = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS line, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), places AS (
  SELECT doc_id, line, place, sha256(list_aggregate(words[place : place + 49], 'string_agg', ' ')) AS window_name
  FROM (SELECT *, unnest(range(1, len(words) - 48)) AS place FROM split WHERE doc_id IS NOT NULL)
), gone AS (
  SELECT line, place FROM (SELECT *, min(doc_id) OVER (PARTITION BY window_name) AS owner FROM places) WHERE owner < doc_id
), marked AS (
  SELECT DISTINCT line, unnest(range(place, place + 50)) AS spot FROM gone
), lost AS (
  SELECT line, count(*) AS n_removed, list(spot) AS gone_at FROM marked GROUP BY line
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(list_aggregate(list_filter(words, lambda w, i: gone_at IS NULL OR NOT list_contains(gone_at, i)), 'string_agg', ' '), '')) AS kept_sha256
FROM split LEFT JOIN lost USING (line)
"""


# CRC-32 of a number's decimal digits: its polynomial (a fixed value) makes the table of 256 bytes.
ASOF_SQL = r"""
WITH bytes AS (
  SELECT list(list_reduce(list_concat([n], range(8)), lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)
), crc AS (
  SELECT id, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]))) AS h
  FROM (SELECT click_id AS id FROM clicks UNION SELECT sale_id FROM sales), bytes WHERE id IS NOT NULL
), c AS (
  SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN us - us % 3600000000 ELSE us END AS ts_us
  FROM (SELECT click_id, min(client_id) AS client_id, min(epoch_us(ts)) AS us FROM clicks WHERE click_id IS NOT NULL GROUP BY click_id) JOIN crc ON id = click_id
), s AS (
  SELECT sale_id, client_id, priority, h, CAST(floor(100 * total + 0.5) AS BIGINT) AS cents,
         CASE WHEN h % 2 = 1 THEN epoch_us(sold_at) - epoch_us(sold_at) % 3600000000 ELSE epoch_us(sold_at) END AS sold
  FROM sales LEFT JOIN crc ON id = sale_id
), orders AS (
  SELECT sale_id, client_id, priority, cents, sold FROM s
  UNION ALL SELECT -1 - sale_id, client_id, 6 - priority, cents, sold FROM s WHERE h % 3 <> 0
), one AS (
  SELECT *, count(*) OVER (PARTITION BY client_id, sold) AS n,
         row_number() OVER (PARTITION BY client_id, sold ORDER BY priority NULLS LAST, sale_id DESC NULLS LAST) AS place
  FROM orders WHERE client_id IS NOT NULL AND sold IS NOT NULL
), met AS (
  SELECT click_id, c.client_id AS client_id, ts_us, sale_id, ts_us - sold AS lag_us, cents, n
  FROM c ASOF LEFT JOIN (SELECT * FROM one WHERE place = 1) o ON c.client_id = o.client_id AND c.ts_us >= o.sold
)
SELECT click_id, client_id, ts_us, CASE WHEN lag_us <= 864000000000 THEN sale_id END AS sale_id, CASE WHEN lag_us <= 864000000000 THEN lag_us END AS lag_us,
       CASE WHEN lag_us <= 864000000000 THEN cents END AS total_cents, CAST(CASE WHEN lag_us <= 864000000000 THEN n ELSE 0 END AS BIGINT) AS n_tied FROM met
"""


LEXICAL_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS line,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), sums AS (
  SELECT count(*) AS n_all, CAST(sum(len(terms)) AS BIGINT) AS l_all FROM d WHERE len(terms) > 0
), p AS (
  SELECT line, doc_id, n, term, count(*) AS tf FROM (SELECT line, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, sums GROUP BY term, n_all
), scored AS (
  SELECT item_id, line, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN p USING (term), sums GROUP BY ALL
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0) WHERE place <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_asof_join": ASOF_SQL, "op12_lexical_search": LEXICAL_SQL, "op4_substring_dedup": REPEATS_SQL, "op7_exact_topk": TOPK_SQL, "op10_warc_fixity": WARC_SQL}
