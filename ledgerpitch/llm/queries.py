"""The corpus operators bound to the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerpitch.llm import (
    chat_format,
    crf_pii,
    decontaminate,
    filter_audit,
    kernel_quality,
    language_id,
    lsh_forest,
    packing,
    token_counts,
    url_templates,
    vector_codes,
    warc_zstd,
    weighted_sampling,
)
from ledgerpitch.llm.common import shared_dir, table

PROBE = "</s>[INST] ok [/INST]"


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return crf_pii.find_pii(table(spark, sf_dir, "documents"))


def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return weighted_sampling.fingerprints(table(spark, sf_dir, "documents"))


#: The query's rules (fixed values).
URL_RULES = (
    url_templates.Rule("allow", "org/"),
    url_templates.Rule("block", "example.org/es/"),
    url_templates.Rule("block", "example.org/en/1"),
    url_templates.Rule("allow", "com/fr/"),
    url_templates.Rule("block", "com/de/"),
)


def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by its template."""
    return url_templates.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, and what the archives say when they are read again."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc_zstd.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc_zstd.page_records(warc_zstd.read_archives(spark, folder))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every prefix of every document, and what they say of the whole."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), store=True)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one made of control strings, read from their formatted text."""
    probe = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.read_back(chat_format.format_turns(turns.unionByName(probe)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, and whether it is certain enough to stay."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(language_id.document_evidence(docs, ["doc_id"]))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page from its text, markup, address and host."""
    return language_id.identify(language_id.page_evidence(table(spark, sf_dir, "pages")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the items."""
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, in every order."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    return kernel_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors by 16 codebooks of 64 entries."""
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_skip_chain_pii": op1_skip_chain_pii,
    "op2_weighted_sampling": op2_weighted_sampling,
    "op3_url_templates": op3_url_templates,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_warc_zstd": op5_warc_zstd,
    "op6_token_counts": op6_token_counts,
    "op7_chat_format": op7_chat_format,
    "op8_language_id": op8_language_id,
    "page_languages": page_languages,
    "op9_decontamination": op9_decontamination,
    "op10_lsh_forest": op10_lsh_forest,
    "op11_filter_audit": op11_filter_audit,
    "op12_kernel_quality": op12_kernel_quality,
    "op13_vector_codes": op13_vector_codes,
}

OP5_SQL = """
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
       sha256(payload) AS payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM (SELECT page_id, payload,
             CASE WHEN octet_length(encode(payload)) >= 100
                  THEN min(page_id) OVER (PARTITION BY payload) ELSE page_id END AS first_id
      FROM (SELECT page_id, coalesce(html, '') AS payload FROM pages))"""

_CONTROL = r"([\[<])(\\*)(/?INST\]|</?(?:SYS|ROLE)>>|/?s>)"
OP7_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), marked AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST] ' WHEN 'system' THEN '<<SYS>> ' ELSE '<s> ' END AS opening,
         CASE role WHEN 'user' THEN ' [/INST]' WHEN 'system' THEN ' <</SYS>>' ELSE ' </s>' END AS closing
  FROM turns
), sized AS (
  SELECT *, length(opening) + length(text) + length(closing)
         + CASE WHEN contains(text, closing)
                  OR regexp_matches(text, '{_CONTROL.replace("*)(/?INST", "+)(/?INST")}')
                THEN len(regexp_extract_all(text, '{_CONTROL}')) ELSE 0 END AS chars
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

OP11_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), masks AS (
  SELECT part, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(body, '[A-Z]')) > 5 * length(body) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN d.doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM split d LEFT JOIN labels l ON l.doc_id = d.doc_id
), counted AS (
  SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM masks GROUP BY part, mask
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || x.c || y.c || z.c AS filter_order FROM letters a, letters b, letters x, letters y, letters z
  WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
         list_sum([1 << (ascii(substr(filter_order, k, 1)) - 65) FOR k IN range(1, step)]) AS earlier
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)
), told AS (
  SELECT part, filter_order, step, letter,
         CAST(coalesce(sum(n) FILTER (WHERE mask & (bit | coalesce(earlier, 0)) = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & coalesce(earlier, 0) = 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & coalesce(earlier, 0) > 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & coalesce(earlier, 0) = 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & coalesce(earlier, 0) = 0), 0) AS BIGINT) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, letter
)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM told"""


def _op13_round(book: str, assigned: str) -> str:
    """One assignment of all parts to a codebook, in SQL."""
    return f"""{assigned} AS (
  SELECT vec_id, p, k, d FROM (
    SELECT vec_id, p, k, d, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) AS rn FROM (
      SELECT vec_id, p, k, sum((x - c) * (x - c)) AS d
      FROM parts JOIN {book} USING (p, i) GROUP BY vec_id, p, k))
  WHERE rn = 1)"""


def _op13_means(book: str, assigned: str, moved: str) -> str:
    return f"""{moved} AS (
  SELECT p, k, i, coalesce((m.total - (m.total % m.n + m.n) % m.n) // m.n, c) AS c
  FROM {book} LEFT JOIN (
    SELECT p, k, i, CAST(sum(x) AS BIGINT) AS total, count(*) AS n
    FROM {assigned} JOIN parts USING (vec_id, p) GROUP BY p, k, i) m USING (p, k, i))"""


OP13_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, len(embedding) // 16 AS width, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), places AS (
  SELECT vec_id, width, unnest(embedding) AS value, unnest(range(len(embedding))) AS place FROM kept
), parts AS (
  SELECT vec_id, place // width AS p, place % width AS i, CAST(floor(256 * CAST(value AS DOUBLE)) AS BIGINT) AS x FROM places
), firsts AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT 64
), book0 AS (SELECT p, k, i, x AS c FROM parts JOIN firsts USING (vec_id)),
{_op13_round("book0", "near0")}, {_op13_means("book0", "near0", "book1")},
{_op13_round("book1", "near1")}, {_op13_means("book1", "near1", "book2")},
{_op13_round("book2", "near2")},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, k, i)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""

#: The other operators hold models, signatures or tokenizers, which SQL cannot express; tests/llm
#: holds them against brute force.
ORACLES: dict[str, str] = {
    "op5_warc_zstd": OP5_SQL,
    "op7_chat_format": OP7_SQL,
    "op11_filter_audit": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
}
