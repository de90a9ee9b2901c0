"""The registered queries of this package: each applies one operator to its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from retentia.llm import (
    ball_search, bpe, chat, decontaminate, filter_audit, html_extract, lm_score, mixing, near_join,
    pii, quality_rules, toxicity, warc,
)
from retentia.llm.common import load

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


W = r"[^\x20\x09-\x0D]+"

MIX_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(len(regexp_extract_all(coalesce(text, ''), '{W}')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, sum(size) AS s, 2.0::DOUBLE * sum(size) AS cap,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS w
  FROM sizes GROUP BY source
), ordered AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS held, sum(w) OVER rest AS free,
         (SELECT 1.5 * sum(s) FROM sources) AS budget
  FROM sources
  WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT arg_min((budget - held) / free, cap / w) FILTER (WHERE (budget - held) / free <= cap / w) AS l FROM ordered
)
SELECT source, CAST(s AS BIGINT) AS source_size,
       round(least(cap, coalesce(l, 1e300) * w), 6) AS target
FROM sources, level
"""


@query("op6_mix_sources")
def op6(spark, sf_dir):
    return mixing.mixed(load(spark, sf_dir, "documents"))


@query("op6s_source_targets", MIX_SQL)
def op6_targets(spark, sf_dir):
    """The targets alone, which SQL can express without the seeded draw."""
    docs = mixing.mixed(load(spark, sf_dir, "documents"))
    return docs.groupBy("source").agg(
        F.max("source_size").alias("source_size"), F.round(F.max("target"), 6).alias("target"))


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n
  FROM pages
), d AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS held FROM p
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND held <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND held <> page_id THEN held END AS refers_to
FROM d
"""


@query("op7_warc_round_trip", WARC_SQL)
def op7(spark, sf_dir):
    return warc.round_trip(load(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), merged AS (
  SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS first FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), sized AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
      text, '\', '\0'), '<s>', '\1s>'), '</s>', '\1/s>'), '[INST]', '\2INST]'),
      '[/INST]', '\2/INST]'), '<<SYS>>', '\1<SYS>>'), '<</SYS>>', '\1</SYS>>'), '<|', '\1|'),
      '<unk>', '\1unk>'), '', '') AS escaped
  FROM merged
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
              FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped)
                + CASE WHEN first = 1 THEN 8 + length(role) + 8 + 7 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op9_chat_format", CHAT_SQL)
def op9(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    kinds = dict(rows.dtypes)
    more = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)],
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string")
    return chat.digests(chat.format_chats(rows.unionByName(more)))


@query("op10_toxicity")
def op10(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    out = toxicity.scored(docs, toxicity.training_part(labels))
    return out.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op3_quality_rules")
def op3(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    rows = quality_rules.judged(docs, labels)
    return rows.select(
        "doc_id", *quality_rules.COUNTS[:5], "base_failed", "kept", "stratum", "step")


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), lines AS (
  SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), win AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS five
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, five) AS c FROM win)
  WHERE c > 1
), rep AS (
  SELECT doc_id, CAST(count(DISTINCT i + j) AS BIGINT) AS n
  FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
       coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
       len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)
"""


@query("op3b_quality_counts", QUALITY_SQL)
def op3_counts(spark, sf_dir):
    """The counts alone, which SQL can express."""
    rows = quality_rules.measured(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", *quality_rules.COUNTS[:5], "base_failed")


@query("op4_near_copies")
def op4(spark, sf_dir):
    return near_join.classes(load(spark, sf_dir, "documents"))


@query("op8_pii_surrogates")
def op8(spark, sf_dir):
    return pii.with_surrogates(load(spark, sf_dir, "documents"))


@query("op2_benchmark_leaks")
def op2(spark, sf_dir):
    return decontaminate.hits(
        load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op5_lm_score")
def op5(spark, sf_dir):
    """Target: documents labelled as good; background: all documents."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return lm_score.scored(docs, labels.where("quality = 1"))


@query("op1_main_text")
def op1(spark, sf_dir):
    return html_extract.main_texts(load(spark, sf_dir, "pages"))


@query("op11_ball_search")
def op11(spark, sf_dir):
    return ball_search.searched(
        load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op12_bpe_round_trip")
def op12(spark, sf_dir):
    vocabulary = bpe.Vocabulary.read(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(bpe.encoded(load(spark, sf_dir, "documents"), vocabulary), vocabulary)


AUDIT_SQL = r"""
WITH RECURSIVE letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT c AS o FROM letters
  UNION ALL SELECT o || c FROM orders, letters WHERE NOT contains(o, c)
), steps AS (
  SELECT o AS filter_order, step, substr(o, step, 1) AS f, substr(o, 1, step - 1) AS earlier
  FROM orders, (SELECT unnest(range(1, 6))::INTEGER AS step) WHERE length(o) = 5
), docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, concat(
    CASE WHEN len(w) < 200 THEN 'A' END,
    CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' END,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' END) AS m
  FROM docs LEFT JOIN known USING (doc_id)
), counts AS (
  SELECT part, m, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM judged GROUP BY ALL
), hits AS (
  SELECT *, contains(m, f) AS fails,
         len(translate(m, earlier, '')) < len(m) AS gone FROM counts, steps
)
SELECT part, filter_order, step,
       CAST(coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (WHERE m = f), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(bad) FILTER (WHERE fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // greatest(length(m), 1)) FILTER (WHERE fails), 0) AS BIGINT) AS shapley
FROM hits GROUP BY part, filter_order, step
"""


@query("op13_filter_audit", AUDIT_SQL)
def op13(spark, sf_dir):
    return filter_audit.audit(
        spark, f"{sf_dir}/documents.parquet", load(spark, sf_dir, "labels"))
