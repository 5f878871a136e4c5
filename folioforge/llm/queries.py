"""The registered queries of the ten operators, and SQL for those that SQL can express.

Each query applies one operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bbpe, decontam, lang_id, minhash, quality, secrets, style_tree, token_cache, toxicity, warc
from folioforge.llm.common import materialize, table


def held_out() -> Column:
    """Rows that models may not learn from: a fifth, by a checksum of the id."""
    return F.expr("coalesce(crc32(cast(doc_id as string)), 0) % 5 = 0")


OP2 = minhash.MinMaxParams(k=3, percent=85)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(~held_out()))
    return lang_id.identify(docs, model).withColumn("held_out", held_out())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.train(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, index).withColumn("held_out", held_out())


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), OP2).drop("text_key")


#: Words by ASCII white space, A-Z folded; sets of 3-word shingles; all pairs that share one.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w)
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 85 * (na.c + nb.c - i)
), r AS (SELECT doc_id AS id, doc_id AS o FROM documents UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.id
), c AS (SELECT id, min(o) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""



def _stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger, stored: what follows reads measurements and bits, no text."""
    return materialize(quality.ledger(table(spark, sf_dir, "documents")), "quality-ledger")[0]


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both policies applied to the stored ledger; ``only_rule`` is the rule without which a document would be kept."""
    rows = quality.apply_policy(_stored_ledger(spark, sf_dir), quality.CURRENT)
    base = ~quality.verdict(quality.POLICIES["base-1"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits", quality.only_rule().alias("only_rule"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, by bit arithmetic over the stored ledger."""
    rows, out = _stored_ledger(spark, sf_dir), None
    for policy in quality.POLICIES.values():
        one = quality.ablation(rows, policy).select(F.lit(policy.version).alias("policy"), "rule", "failed", "only_failure", "kept_now")
        out = one if out is None else out.unionByName(one)
    return out


OP4_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t
), g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3
), d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
), p AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY r
), m AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM w LEFT JOIN p USING (r)
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END) AS fail_bits
  FROM m
)
"""
_OP4_BITS = OP4_SQL
OP4_SQL += """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits,
  CASE fail_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'short_words' WHEN 16 THEN 'long_words' WHEN 32 THEN 'repeated_lines' END AS only_rule FROM b
"""
ABLATION_SQL = _OP4_BITS + """, r AS (SELECT * FROM (VALUES ('base-1', 3), ('full-1', 63)) p(policy, mask), (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('short_words', 8), ('long_words', 16), ('repeated_lines', 32)) q(rule, bit) WHERE mask & bit <> 0)
SELECT policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS failed, count(*) FILTER (fail_bits & mask = bit) AS only_failure, count(*) FILTER (fail_bits & mask = 0) AS kept_now FROM r, b GROUP BY ALL
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbpe.round_trip(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


#: Base 32 of SHA-1: five hexadecimal digits are four base-32 digits.
OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(h)) AS payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
      (((('0x' || sha1(h)[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1]), 'string_agg', '') AS payload_digest
  FROM p
), m AS (SELECT payload_digest, max(page_id) AS first FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN m USING (payload_digest)
"""


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.count_tokens(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan_secrets(docs, secrets.train(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "quality_ablation": quality_ablation,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_html_text": op8_html_text,
    "op9_token_counts": op9_token_counts,
    "op10_secret_scan": op10_secret_scan,
}
SQL: dict[str, str] = {"op2_minhash_dedup": OP2_SQL, "op4_quality_rules": OP4_SQL, "quality_ablation": ABLATION_SQL, "op7_warc": OP7_SQL}
