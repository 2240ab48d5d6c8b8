"""The registered queries of operators 11 to 13, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxalog.llm import divergence, filter_audit, repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_first=False)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12 = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), k AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30
), v AS (
  SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang
), c AS (
  SELECT t.lang, source, t.term, count(*)::HUGEINT AS n
  FROM (SELECT lang, source, unnest(terms) AS term FROM d) t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, source, t.term
), g AS (
  SELECT DISTINCT d.lang, d.source FROM d
), s AS (
  SELECT g.lang, g.source, v.v, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS total
  FROM g JOIN v ON g.lang = v.lang
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.total + 5 * s.v) AS p
  FROM s JOIN k ON s.lang = k.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), q AS (
  SELECT t.lang, t.term, 1 + (1000000000::HUGEINT * (t.n + 5)) // (t.total + 5 * v.v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n, (sum(sum(n)) OVER (PARTITION BY lang))::HUGEINT AS total FROM c GROUP BY lang, term) t
  JOIN v ON t.lang = v.lang
), w AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(w.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN w ON w.lang = a.lang AND w.source = a.source AND w.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, CAST(p.p - q.q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term
  WHERE p.n > 0 AND p.p > q.q
), o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r
)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50
"""


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copied FROM d
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         {'A': len(words) < 100,
          'B': 100 * len(list_distinct(words)) < 80 * len(words),
          'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': copied} AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), g AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), c AS (
  SELECT g.part, filter_order, step, own, n, good, toxic,
         CASE own WHEN 'A' THEN fails.A WHEN 'B' THEN fails.B WHEN 'C' THEN fails.C WHEN 'D' THEN fails.D ELSE fails.E END AS hit,
         (fails.A AND list_contains(before, 'A')) OR (fails.B AND list_contains(before, 'B')) OR (fails.C AND list_contains(before, 'C'))
         OR (fails.D AND list_contains(before, 'D')) OR (fails.E AND list_contains(before, 'E')) AS gone,
         fails.A::INT + fails.B::INT + fails.C::INT + fails.D::INT + fails.E::INT AS failed FROM g, s
), t AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, own,
         CAST(coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (hit AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (hit AND failed = 1), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM c GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM t
"""


def queries() -> dict:
    return {"op11_repeats": op11, "op12_source_divergence": op12, "op13_filter_audit": op13}


def oracle_sql() -> dict[str, str]:
    return {"op12_source_divergence": OP12, "op13_filter_audit": OP13}
