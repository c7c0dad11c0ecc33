"""The registered queries of this subpackage: thin digests of the operators' outputs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .decontaminate import contaminated
from .jaccard_join import Join, jaccard_components
from .line_dedup import dedup_lines
from .mixing import mix
from .quality_model import quality_scores
from .quality_rules import STOP_WORDS, quality_rules
from .secrets import scan_secrets
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), Join(k=3, percent=90))


def _removed(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir), length=100)
    return out.select(
        "doc_id", F.col("size").alias("n_bytes"), _removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(documents(spark, sf_dir), length=35)
    return out.select("doc_id", F.col("size").alias("n_words"), _removed().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=3, min_chars=20)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """``tokenizer``: path of the vocabulary file; by default that of the installed public one."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts(documents(spark, sf_dir), tokenizer, limit=512)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir).select("doc_id", "text"), documents(spark, sf_dir, "benchmark"))


def secret_digest(spans: DataFrame) -> DataFrame:
    kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return spans.select(
        "doc_id",
        *[F.size(kind(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.size(kind("entropy")).cast("long").alias("n_entropy"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(documents(spark, sf_dir)))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_mix_sources": op7_mix_sources,
    "op8_decontaminate": op8_decontaminate,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_model": op10_quality_model,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS m FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (
  SELECT k.doc_id, k.pos, k.line, c.m IS NOT NULL AND c.m <> k.doc_id AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op6_quality_rules": rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_zip(w[1:len(w)-2], w[2:len(w)-1], w[3:len(w)])) AS gram FROM w WHERE len(w) >= 3
), r AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g
), p AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE c >= 2 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words,
    length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS said,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals,
    length(t) - length(replace(t, '|', '')) AS pipes,
    len(list_filter(w, lambda x: list_contains([{", ".join("'" + x + "'" for x in sorted({x for ws in STOP_WORDS.values() for x in ws}))}], translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS stops
  FROM w LEFT JOIN p ON w.doc_id = p.doc_id
), b AS (
  SELECT *, (len(said) - len(list_distinct(said)))::BIGINT AS n_dup_lines, greatest(len(said), 1) AS nl, greatest(n_words, 1) AS n,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n BETWEEN 1.5 AND 25 AND n_symbols / n <= 0.25 AND pipes / n <= 0.25
  AND capitals / greatest(word_chars, 1) <= 0.5 AND stops / n >= 0.02 AND n_dup_lines / nl <= 0.5
  AND len(list_filter(said, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) / nl <= 0.5
  AND len(list_filter(said, lambda x: regexp_matches(x, '^\s*[-*•]'))) / nl <= 0.95 AS kept
FROM b""",
    "op7_mix_sources": rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source
), w AS (
  SELECT *, (sid % 3 + 1)::BIGINT AS w FROM s
), f AS (
  SELECT *, (sum(n) OVER () - 3 * coalesce(sum(n) OVER (ORDER BY n / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
    (sum(w) OVER (ORDER BY n / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws FROM w
), c AS (
  SELECT *, 3::HUGEINT * n * ws <= rest::HUGEINT * w AS capped FROM f
), v AS (
  SELECT rest, ws FROM c WHERE NOT capped ORDER BY n / w, sid LIMIT 1
), t AS (
  SELECT sid, source, n, CASE WHEN capped THEN (3 * n)::DOUBLE ELSE ((SELECT rest FROM v) * w)::DOUBLE / (SELECT ws FROM v)::DOUBLE END AS target FROM c
), p AS (
  SELECT d.*, t.sid, t.n, t.target, floor(t.target + 0.5)::BIGINT AS goal,
    (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS a
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), o AS (
  SELECT doc_id, size, n AS source_size, target, sid, a // 1024 AS rank,
    (CASE WHEN n = 0 THEN 0 ELSE (goal // n) * size + greatest(least(a + size, goal % n) - a, 0) END)::BIGINT AS taken
  FROM p
), g AS (
  SELECT sid, n, floor(target + 0.5)::BIGINT AS goal FROM t WHERE n > 0 AND floor(target + 0.5) > 0
), e AS (
  SELECT sid, ((goal // n) * ((n + 1023) // 1024) + (goal % n + 1023) // 1024)::BIGINT AS need FROM g
), u AS (
  SELECT *, coalesce(sum(need) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(need) OVER () AS total FROM e
), q AS (
  SELECT unnest(range((SELECT ((27 * max(total) + 9) // 10 + 8)::BIGINT FROM u))) AS slot
), x AS (
  SELECT slot, (slot::HUGEINT * 2850178704830799621 % 4611686018427387904)::BIGINT::DOUBLE / 4611686018427387904::DOUBLE AS x FROM q
), h AS (
  SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
  FROM x JOIN u ON x >= before::DOUBLE / total::DOUBLE AND x < (before + need)::DOUBLE / total::DOUBLE
)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN slot END AS first_slot
FROM o LEFT JOIN h ON o.sid = h.sid AND o.rank = h.rank""",
}
