"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import corpus_pipeline
from taxalog.llm import audits, chat, decontaminate, embedding_dedup, language, line_dedup, mixing, pii, simhash_dedup, url_filter, warc
from taxalog.storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.train()).select("page_id", "host", "path", "rule", "verdict", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    counts = [F.size(F.filter("pii", lambda s, k=kind: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    secrets = F.size(F.filter("pii", lambda s: s["kind"] == "secret")).cast("long")
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
                       secrets.alias("n_secret"), F.size("pii").cast("long").alias("n_spans"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, similarity of every benchmark item that a document holds."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages"))), "archives")

    def page(record_id):
        return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    return warc.read_archives(archives).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"), "error")


OP4 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first != page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first != page_id THEN first END AS refers_to,
       CAST(NULL AS VARCHAR) AS error
FROM g
"""


def chat_events(rows: DataFrame) -> DataFrame:
    """The log that would have led to the rows: texts streamed in two deltas, answers after a draft and a regeneration."""
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    text = F.coalesce("text", F.lit(""))
    half = (F.char_length(text) / 2).cast("int")

    def event(seq, kind, text):
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    whole = [event(3, "delta", F.substring(text, F.lit(1), half)), event(4, "delta", F.substring(text, half + 1, F.char_length(text)))]
    draft = [event(1, "delta", F.concat(F.lit("draft "), text)), event(2, "regenerate", F.lit(None))]
    start = event(0, "start", F.lit(None))
    events = F.when(F.col("role") == chat.TRAINED, F.array(start, *draft, *whole)).otherwise(F.array(start, *whole))
    return (rows.withColumn("message", F.struct("turn", copy.alias("copy")))
            .select("conv_id", "message", "role", F.explode(events).alias("e")).select("conv_id", "message", "role", "e.*"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    awkward = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(awkward).alias("text"))
    out = chat.render(chat.fold_events(chat_events(rows.unionByName(more))))
    out = out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
                     chat.trained_text(F.col("formatted"), F.col("loss")).alias("trained"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                      F.char_length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
                      F.char_length("formatted").cast("long").alias("formatted_chars"))


OP5 = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role IS NOT DISTINCT FROM 'assistant' AS trained FROM c
), e AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '\\', '\\\\', 'g'), '<(/?s>)', '<\\\1', 'g'),
                           '\[(/?INST\])', '[\\\1', 'g') AS escaped FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (trained), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (trained), '')) AS loss_sha256,
       CAST(sum(length(escaped) + length(role) + 20) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return (rows.select("doc_id", "size", "source_size", "target", "taken", F.get("times", F.lit(0)).alias("position"))
            .orderBy(F.col("position").asc_nulls_last(), "doc_id"))


OP6 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS o FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2 AS most FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE)
             - coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY CAST(most AS DOUBLE) / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, place,
         least(CAST(most AS DOUBLE), (SELECT max(level) FROM l WHERE level * w <= most) * w) AS target FROM w
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.place, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         - CAST(d.size AS DOUBLE) / 2 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CASE WHEN middle < target THEN middle / target END AS share,
         CASE place % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a,
         CASE place % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS b,
         CAST((middle < target)::INT + (middle + source_size < target)::INT AS BIGINT) AS copies FROM r
)
SELECT doc_id, size, source_size, target, size * copies AS taken,
       CASE WHEN a = b THEN share ELSE (sqrt(a * a + (b - a) * 2 * ((a + b) / 2) * share) - a) / (b - a) END AS position
FROM c
"""


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7 = r"""
WITH d AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d
), s AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.line, k.pos, s.keeper IS NOT NULL AND s.keeper != k.doc_id AS dropped FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP8 = """
WITH RECURSIVE u AS (
  SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id != b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = language.identify(docs, language.train(docs))
    return rows.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_dedup.assign_components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict:
    return {
        "op1_url_filter": op1, "op2_pii": op2, "op3_decontamination": op3, "op4_warc": op4, "op5_chat_format": op5,
        "op6_source_mix": op6, "op7_line_dedup": op7, "op8_embedding_dedup": op8, "op9_language_id": op9,
        "op10_simhash_dedup": op10, "pipeline": corpus_pipeline.run,
    } | audits.queries()


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4, "op5_chat_format": OP5, "op6_source_mix": OP6, "op7_line_dedup": OP7, "op8_embedding_dedup": OP8} | audits.oracle_sql()
