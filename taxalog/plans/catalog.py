"""The registered queries: every operator over the given tables.

Each entry is ``name -> (query(spark, tables), oracle SQL or None)``; ``tables``
maps a table name to its DataFrame.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from taxalog import schemas
from taxalog.functions import text as X
from taxalog.functions.jsonfields import DEFAULT_STRIP_FIELDS, strip_fields
from taxalog.functions.vectors import masked_mean, project
from taxalog.operators import batching, classify, dedup, embed, evaluate, learned, taxonomy
from taxalog.operators.compact import compact, compaction_report
from taxalog.operators.normalize import (Normalizer, by_severity, classify as label_logs, default_time, event_fields, event_json,
                                         normalize, split_rejects)
from taxalog.options import Options
from taxalog.plans.jobs import query, spread
from taxalog.sources import logs as sources
from taxalog.storage import work_path
from taxalog.streaming import sinks, streams

THRESHOLD = 0.05   # word sets of long prose against short labels
QUERIES: dict[str, tuple[Callable, str | None]] = {}


class Tables(Mapping):
    """The parquet tables of one directory, opened on first use."""

    NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
             "benchmark labels conversations").split()

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def __iter__(self):
        return iter(self.NAMES)

    def __len__(self):
        return len(self.NAMES)


def registered(oracle: str | None = None):
    def add(query):
        QUERIES[query.__name__] = (query, oracle)
        return query
    return add


def utc(day: int, hour: int = 0) -> datetime:
    return datetime(2024, 1, day, hour, tzinfo=timezone.utc)


def no_zone(column: str | Column) -> Column:
    """Plain UTC timestamps compare equal in both engines."""
    return F.to_timestamp_ntz(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")) if isinstance(column, Column) else \
        no_zone(F.col(column))


def r6(column) -> Column:
    return F.round(column, 6)


# --- shared SQL ------------------------------------------------------------------

SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PUNCT = r"\p{P}$+<=>^`|~"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_clean(text: str) -> str:
    gone = rf"regexp_replace({text}, '[\x{{FFFD}}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]', '', 'g')"
    return rf"regexp_replace({gone}, '[\t\n\r\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g')"


def sql_fold(text: str) -> str:
    return f"strip_accents(lower({sql_clean(text)}))"


def sql_words(text: str) -> str:
    return f"regexp_extract_all({sql_fold(text)}, '[^{SPACE}{PUNCT}]+')"


def sql_tokens(text: str) -> str:
    return f"regexp_extract_all({sql_fold(text)}, '[{PUNCT}]|[^{SPACE}{PUNCT}]+')"


def sql_trim(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def sql_summary(text: str) -> str:
    line = sql_trim(f"split_part({text}, chr(10), 1)")
    return (f"CASE WHEN length({line}) <= 120 THEN {line} "
            f"ELSE regexp_replace(substr({line}, 1, 120), ' [^ ]*$', '') || '...' END")


def sql_truncate(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) <= {n} THEN {text} ELSE substr({text}, 1, {n}) || '...' END"


def sql_estimate(text: str) -> str:
    return f"CAST(ceil(len(regexp_extract_all({text}, '[^{SPACE}]+')) * 1.3) AS BIGINT)"


def sql_frame(line: str) -> str:
    return rf"regexp_matches({line}, '^[\t\n\f\r ]+at |^[\t\n\f\r ]+[^\n]+\.go:[0-9]|^goroutine [0-9]')"


def sql_trace(text: str, keep: int) -> str:
    lines = f"string_split({text}, chr(10))"
    frames = f"list_filter(range(1, len({lines}) + 1), lambda i: {sql_frame(f'{lines}[i]')})"
    return (f"CASE WHEN len({frames}) <= {keep + 2} THEN {text} ELSE "
            f"array_to_string(list_concat({lines}[1:({frames})[{keep}]], "
            f"[chr(9) || '... (' || (len({frames}) - {keep + 2}) || ' frames omitted) ...'], "
            f"{lines}[({frames})[-2]:]), chr(10)) END")


def sql_duration(us: str) -> str:
    secs = f"({us} // 1000000)"
    return (f"CASE WHEN {us} < 1000000 THEN ({us} // 1000) || 'ms' "
            f"WHEN {us} < 60000000 THEN CAST(round_even({us} / 1e6, 0) AS BIGINT) || 's' "
            f"WHEN {secs} % 60 = 0 THEN ({secs} // 60) || 'm' "
            f"ELSE ({secs} // 60) || 'm' || ({secs} % 60) || 's' END")


TAX_SQL = "tax(ord, root, leaf, path, severity, embed_text) AS (VALUES " + ", ".join(
    f"({o}, {quoted(root)}, {quoted(leaf)}, {quoted(path)}, {quoted(sev)}, {quoted(text)})"
    for o, root, leaf, path, sev, _, text in taxonomy.rows()) + ")"


def lexical_sql(docs: str = "SELECT doc_id, text FROM documents", threshold: float = THRESHOLD) -> str:
    """CTEs up to ``found(doc_id, path, severity, sim)``."""
    return f"""{TAX_SQL}, docs AS ({docs}),
      lw AS (SELECT ord, unnest(list_distinct({sql_words('embed_text')})) AS token FROM tax),
      tw AS (SELECT token, greatest(1, CAST(round(10 * ln((1 + (SELECT count(*) FROM tax)) / count(*))) AS BIGINT)) AS w FROM lw GROUP BY token),
      ln AS (SELECT ord, sum(w * w) AS n FROM lw JOIN tw USING (token) GROUP BY ord),
      dw AS (SELECT doc_id, token, w FROM (SELECT doc_id, unnest(list_distinct({sql_words('text')})) AS token FROM docs) JOIN tw USING (token)),
      dn AS (SELECT doc_id, sum(w * w) AS n FROM dw GROUP BY doc_id),
      sims AS (SELECT doc_id, ord, CAST(sum(w * w) AS BIGINT) / sqrt(CAST(dn.n * ln.n AS DOUBLE)) AS sim
               FROM dw JOIN lw USING (token) JOIN dn USING (doc_id) JOIN ln USING (ord) GROUP BY doc_id, ord, dn.n, ln.n),
      best AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, ord) = 1),
      found AS (SELECT d.doc_id, coalesce(b.sim, 0.0) AS sim,
                  CASE WHEN coalesce(b.sim, 0.0) >= {threshold} THEN t.path ELSE 'UNCLASSIFIED' END AS path,
                  CASE WHEN coalesce(b.sim, 0.0) >= {threshold} THEN t.severity ELSE 'warning' END AS severity
                FROM docs d LEFT JOIN best b USING (doc_id) LEFT JOIN tax t ON t.ord = coalesce(b.ord, 0))"""


# --- classification ----------------------------------------------------------------

def document_logs(t: Tables) -> DataFrame:
    """Documents as raw logs; the time only has to be some column of the table."""
    return spread(t["documents"]).select(F.col("doc_id").alias("seq"), F.timestamp_seconds("doc_id").alias("ts"),
                                 F.col("source"), F.col("text").alias("raw"))


def document_labels(t: Tables, threshold: float = THRESHOLD) -> DataFrame:
    return label_logs(document_logs(t), taxonomy.taxonomy(t.spark), threshold=threshold)


EVENTS_SQL = f"""
  SELECT doc_id AS seq, split_part(path, '.', 1) AS type, split_part(path, '.', 2) AS category, severity,
         {sql_summary('text')} AS summary, round(sim, 6) AS confidence, {sql_truncate('text', 2000)} AS raw, 0 AS count
  FROM found JOIN docs USING (doc_id)"""


@registered(f"WITH {lexical_sql()} {EVENTS_SQL}")
def normalize_documents(spark, t):
    events = normalize(document_logs(t), options=Options(threshold=THRESHOLD))
    return events.select("seq", "type", "category", "severity", "summary", r6("confidence").alias("confidence"),
                         "raw", "count")


@registered(f"""WITH {lexical_sql()}
  SELECT split_part(path, '.', 1) AS type, split_part(path, '.', 2) AS category, severity, count(*) AS n_docs,
         round(max(sim), 6) AS top_confidence FROM found GROUP BY ALL""")
def label_counts(spark, t):
    return (document_labels(t).groupBy("type", "category", "severity")
            .agg(F.count("*").alias("n_docs"), r6(F.max("confidence")).alias("top_confidence")))


@registered(f"WITH {lexical_sql()} SELECT doc_id, path, severity, round(sim, 6) AS confidence FROM found")
def classify_lexical(spark, t):
    labels = taxonomy.taxonomy(spark)
    found = classify.resolve(classify.lexical_match(F.col("text"), labels), labels, THRESHOLD)
    return (spread(t["documents"]).select("doc_id", found.alias("f"))
            .select("doc_id", "f.path", "f.severity", r6("f.confidence").alias("confidence")))


@registered(f"""WITH {TAX_SQL},
  lw AS (SELECT ord, token, count(*) AS w FROM (SELECT ord, unnest({sql_words('embed_text')}) AS token FROM tax) GROUP BY ALL),
  ln AS (SELECT ord, sum(w * w) AS n FROM lw GROUP BY ord),
  dw AS (SELECT doc_id, token, count(*) AS w FROM (SELECT doc_id, unnest({sql_words('text')}) AS token FROM documents) GROUP BY ALL),
  dn AS (SELECT doc_id, sum(w * w) AS n FROM dw GROUP BY doc_id),
  sims AS (SELECT doc_id, ord, sum(dw.w * lw.w) / sqrt(CAST(any_value(dn.n) * any_value(ln.n) AS DOUBLE)) AS sim
           FROM dw JOIN lw USING (token) JOIN dn USING (doc_id) JOIN ln USING (ord) GROUP BY doc_id, ord),
  best AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, ord) = 1)
  SELECT doc_id, path, round(coalesce(sim, 0.0), 6) AS confidence
  FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN tax ON tax.ord = coalesce(best.ord, 0)""")
def classify_by_term_join(spark, t):
    labels = taxonomy.taxonomy(spark)
    docs = spread(t["documents"]).select("doc_id", "text")
    matched = classify.nearest_label_sparse(docs, "doc_id", "text", classify.term_weights(labels, "ord", "embed_text"))
    found = classify.resolve(F.col("match"), labels, 0.0)
    return matched.select("doc_id", found["path"].alias("path"), r6(found["confidence"]).alias("confidence"))


def prototypes(t: Tables) -> DataFrame:
    """One label vector per class: that of its first row."""
    severity = F.element_at(F.lit(["error", "warning", "info"]), F.col("label") % 3 + 1)
    return (t["embeddings"].groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
            .select(F.col("label").alias("ord"), F.concat(F.lit("CLASS.c"), "label").alias("path"),
                    severity.alias("severity"), "vector"))


DENSE_SQL = """
  vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  proto AS (SELECT label AS ord, arg_min(v, vec_id) AS pv FROM vecs GROUP BY label),
  pairs AS (SELECT vec_id, label, ord, list_cosine_similarity(v, pv) AS sim FROM vecs, proto),
  best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, ord) = 1),
  judged AS (SELECT vec_id, label, sim AS confidence, 'CLASS.c' || label AS expected_path,
               CASE WHEN sim >= 0.3 THEN 'CLASS.c' || ord ELSE 'UNCLASSIFIED' END AS path,
               CASE WHEN sim >= 0.3 THEN ['error', 'warning', 'info'][ord % 3 + 1] ELSE 'warning' END AS severity,
               ['error', 'warning', 'info'][vec_id % 3 + 1] AS expected_severity FROM best)"""


def dense_found(t: Tables, match=classify.dense_match) -> DataFrame:
    labels = prototypes(t)
    matched = t["embeddings"].withColumn("m", match(F.col("embedding"), labels))
    return (matched.withColumn("f", classify.resolve(F.col("m"), labels, 0.3))
            .select("vec_id", "f.path", "f.severity", "f.confidence"))


def dense_judged(t: Tables) -> DataFrame:
    expected = t["embeddings"].select(
        "vec_id", F.concat(F.lit("CLASS.c"), "label").alias("expected_path"),
        F.element_at(F.lit(["error", "warning", "info"]), (F.col("vec_id") % 3 + 1).cast("int")).alias("expected_severity"))
    return evaluate.judge(dense_found(t), expected, "vec_id")


@registered(f"WITH {DENSE_SQL} SELECT vec_id, path, severity, round(confidence, 6) AS confidence FROM judged")
def classify_dense(spark, t):
    return dense_found(t).withColumn("confidence", r6("confidence"))


@registered(f"WITH {DENSE_SQL} SELECT vec_id, path, severity, round(confidence, 6) AS confidence FROM judged")
def classify_dense_native(spark, t):
    return dense_found(t, classify.dense_match_native).withColumn("confidence", r6("confidence"))


class LetterModel:
    """A stand-in for a user model: counts of the letters a to z."""

    def embed(self, texts):
        return np.array([[text.count(c) for c in string.ascii_lowercase] for text in texts], dtype=np.float32)


class PickyModel(LetterModel):
    """Fails on texts that hold an at sign."""

    def embed(self, texts):
        if any("@" in text for text in texts):
            raise ValueError("at sign")
        return super().embed(texts)


def sql_letters(text: str) -> str:
    return "[" + ", ".join(f"CAST(length({text}) - length(replace({text}, '{c}', '')) AS DOUBLE)"
                           for c in string.ascii_lowercase) + "]"


def model_sql(docs: str, text: str) -> str:
    return f"""{TAX_SQL}, docs AS ({docs}),
      lv AS (SELECT ord, path, {sql_letters('embed_text')} AS pv FROM tax),
      dv AS (SELECT *, {sql_letters(text)} AS v FROM docs),
      dd AS (SELECT DISTINCT v FROM dv),
      pairs AS (SELECT v, ord, path, list_cosine_similarity(v, pv) AS s FROM dd, lv),
      best AS (SELECT v, path, CASE WHEN isnan(s) OR s IS NULL THEN 0 ELSE s END AS sim FROM pairs
               QUALIFY row_number() OVER (PARTITION BY v ORDER BY coalesce(CASE WHEN isnan(s) THEN 0 ELSE s END, 0) DESC, ord) = 1)"""


@registered(f"""WITH {model_sql('SELECT conv_id, turn, text FROM conversations', 'text')}
  SELECT conv_id, turn, path, round(sim, 5) AS confidence FROM dv JOIN best USING (v)""")
def classify_with_model(spark, t):
    labels = taxonomy.taxonomy(spark)
    match, _ = classify.ModelEmbedder(LetterModel).match(F.col("text"), labels)
    found = classify.resolve(F.col("m"), labels, 0.0)
    return (t["conversations"].withColumn("m", match).withColumn("f", found)
            .select("conv_id", "turn", "f.path", F.round("f.confidence", 5).alias("confidence")))


@registered()
def classify_learned(spark, t):
    """The learned lexical vector at its own threshold; a fitted model has no SQL form, tests fit it in plain form."""
    rows = t["documents"].select("doc_id", "text")
    found = label_logs(rows, taxonomy.taxonomy(spark), learned.LearnedEmbedder(), raw="text")
    return found.select("doc_id", "type", "category", "severity", F.round("confidence", 4).alias("confidence"))


@registered(f"""WITH {model_sql('SELECT user_id, event_id, event_type AS text FROM events', 'text')}
  SELECT event_id, path, round(sim, 5) AS confidence FROM dv JOIN best USING (v)""")
def classify_once_per_text(spark, t):
    labels = taxonomy.taxonomy(spark)

    def compute(texts):
        match, _ = classify.ModelEmbedder(LetterModel).match(F.col("text"), labels)
        return texts.withColumn("m", match)
    rows = t["events"].select(F.col("event_id").alias("seq"), F.col("event_type").alias("text"))
    found = classify.resolve(F.col("m"), labels, 0.0)
    return (embed.embed_once(rows, "text", compute).withColumn("f", found)
            .select(F.col("seq").alias("event_id"), "f.path", F.round("f.confidence", 5).alias("confidence")))


@registered("""SELECT CASE WHEN contains(text, '@') THEN 'ValueError: at sign' ELSE '' END AS error,
  count(*) AS n FROM documents GROUP BY 1""")
def bad_row_isolation(spark, t):
    events = normalize(document_logs(t), embedder=classify.ModelEmbedder(PickyModel))
    good, rejected = split_rejects(events)
    return (good.select(F.lit("").alias("error")).unionByName(rejected.select("error"))
            .groupBy("error").agg(F.count("*").alias("n")))


# --- reports --------------------------------------------------------------------------

@registered(f"""WITH {DENSE_SQL} SELECT count(*) AS total, count(*) FILTER (path = expected_path) AS correct,
  count(*) FILTER (path <> expected_path AND path <> 'UNCLASSIFIED') AS incorrect, count(*) FILTER (path = 'UNCLASSIFIED') AS unclassified,
  round(count(*) FILTER (path = expected_path) / count(*) * 100, 6) AS accuracy_pct FROM judged""")
def accuracy(spark, t):
    return evaluate.accuracy(dense_judged(t)).withColumn("accuracy_pct", r6("accuracy_pct"))


@registered(f"""WITH {DENSE_SQL} SELECT expected_path, count(*) AS total, count(*) FILTER (path = expected_path) AS correct,
  count(*) FILTER (path <> expected_path AND path <> 'UNCLASSIFIED') AS incorrect, count(*) FILTER (path = 'UNCLASSIFIED') AS unclassified,
  round(count(*) FILTER (path = expected_path) / count(*) * 100, 6) AS accuracy_pct FROM judged GROUP BY 1""")
def accuracy_by_label(spark, t):
    return evaluate.accuracy_by_path(dense_judged(t)).withColumn("accuracy_pct", r6("accuracy_pct"))


@registered(f"""WITH {DENSE_SQL} SELECT vec_id, path, expected_path, round(confidence, 6) AS confidence
  FROM judged WHERE path <> expected_path""")
def misclassified(spark, t):
    return evaluate.misclassified(dense_judged(t)).select(
        "vec_id", "path", "expected_path", r6("confidence").alias("confidence"))


@registered(f"""WITH {DENSE_SQL} SELECT path = expected_path AS is_correct, count(*) AS n, round(avg(confidence), 6) AS mean,
  round(min(confidence), 6) AS min, round(max(confidence), 6) AS max FROM judged GROUP BY 1""")
def confidence_distribution(spark, t):
    return evaluate.confidence_distribution(dense_judged(t)).select(
        "is_correct", "n", *[r6(c).alias(c) for c in ("mean", "min", "max")])


@registered(f"""WITH {DENSE_SQL}, th(threshold) AS (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in evaluate.THRESHOLDS)}),
  c AS (SELECT threshold, count(*) FILTER (confidence >= threshold AND path = expected_path) AS correct,
          count(*) FILTER (confidence >= threshold AND path <> expected_path) AS incorrect FROM judged, th GROUP BY 1)
  SELECT *, CASE WHEN correct + incorrect > 0 THEN round(correct / (correct + incorrect) * 100, 6) ELSE 0.0 END AS net_accuracy_pct FROM c""")
def threshold_sweep(spark, t):
    return evaluate.threshold_sweep(dense_judged(t)).withColumn("net_accuracy_pct", r6("net_accuracy_pct"))


@registered(f"""WITH {DENSE_SQL}, s AS (SELECT min(confidence) FILTER (path = expected_path) AS a,
    avg(confidence) FILTER (path <> expected_path) AS b FROM judged)
  SELECT round(a, 6) AS correct_min, round(b, 6) AS incorrect_mean, round(a - b, 6) AS gap, a - b < 0.05 AS overlap,
         CASE WHEN a - b >= 0.05 THEN round((a + b) / 2, 6) END AS suggested FROM s""")
def threshold_suggestion(spark, t):
    return evaluate.threshold_suggestion(dense_judged(t)).select(
        r6("correct_min").alias("correct_min"), r6("incorrect_mean").alias("incorrect_mean"),
        r6("gap").alias("gap"), "overlap", r6("suggested").alias("suggested"))


@registered(f"""WITH {DENSE_SQL} SELECT count(*) AS checked, count(*) FILTER (severity <> expected_severity) AS mismatches
  FROM judged WHERE path = expected_path""")
def severity_consistency(spark, t):
    return evaluate.severity_consistency(dense_judged(t))


@registered(f"""WITH {lexical_sql('SELECT doc_id, text FROM documents JOIN labels USING (doc_id)', 0.0)},
  c AS (SELECT path, count(*) AS n FROM found GROUP BY path)
  SELECT tax.ord, tax.path, coalesce(n, 0) AS n_rows, coalesce(n, 0) = 0 AS missing, coalesce(n, 0) < 2 AS too_few
  FROM tax LEFT JOIN c USING (path)""")
def corpus_coverage(spark, t):
    covered = document_logs(t).join(t["labels"].select(F.col("doc_id").alias("seq")), "seq")
    labels = taxonomy.taxonomy(spark)
    found = label_logs(covered, labels, threshold=0.0)
    return evaluate.leaf_coverage(labels, found.select(F.concat_ws(".", "type", "category").alias("expected_path")))


@registered(f"""SELECT count(*) AS n_rows,
  count(*) FILTER (regexp_matches(CASE WHEN turn % 7 = 0 THEN ' ' ELSE text END, '^[{SPACE}]*$')) AS blank_raw,
  count(*) FILTER (role = 'user') AS blank_type, CAST(0 AS BIGINT) AS blank_category, count(*) FILTER (turn = 1) AS blank_severity,
  count(*) FILTER (turn = 1 OR role = 'assistant') AS invalid_severity FROM conversations""")
def corpus_problems(spark, t):
    corpus = t["conversations"].select(
        F.when(F.col("turn") % 7 == 0, " ").otherwise(F.col("text")).alias("raw"),
        F.when(F.col("role") == "user", "").otherwise("T").alias("expected_type"),
        F.lit("c").alias("expected_category"),
        F.when(F.col("turn") == 1, None).otherwise(
            F.when(F.col("role") == "assistant", "fatal").otherwise("info")).alias("expected_severity"))
    return evaluate.corpus_problems(corpus)


@registered(f"""WITH {lexical_sql()}, c AS (SELECT split_part(path, '.', 1) AS root, count(*) AS n FROM found GROUP BY 1)
  SELECT root, count(*) AS n_leaves, string_agg(leaf || '=' || severity, ',' ORDER BY ord) AS leaves,
         coalesce(any_value(n), 0) AS n_docs FROM tax LEFT JOIN c USING (root) GROUP BY root""")
def taxonomy_rollup(spark, t):
    counts = document_labels(t).groupBy(F.col("type").alias("root")).agg(F.count("*").alias("n"))
    leaves = F.array_join(F.transform("labels", lambda x: F.concat(x["name"], F.lit("="), x["severity"])), ",")
    return (taxonomy.by_root(taxonomy.taxonomy(spark)).join(counts, "root", "left")
            .select("root", "n_leaves", leaves.alias("leaves"), F.coalesce("n", F.lit(0)).alias("n_docs")))


# --- text ------------------------------------------------------------------------------

@registered(f"SELECT doc_id, {sql_summary('text')} AS summary FROM documents")
def summarize(spark, t):
    return spread(t["documents"]).select("doc_id", X.summarize(F.col("text")).alias("summary"))


@registered(f"SELECT conv_id, turn, {sql_truncate('text', 200)} AS minimal, {sql_truncate('text', 2000)} AS standard FROM conversations")
def truncate(spark, t):
    text = F.col("text")
    return t["conversations"].select("conv_id", "turn", X.truncate(text, 200).alias("minimal"),
                                     X.truncate(text, 2000).alias("standard"))


@registered(f"SELECT doc_id, {sql_estimate('text')} AS tokens FROM documents")
def token_estimate(spark, t):
    return spread(t["documents"]).select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@registered(f"SELECT doc_id, {sql_clean('text')} AS cleaned, strip_accents(text) AS bare FROM documents")
def clean_and_strip_accents(spark, t):
    return spread(t["documents"]).select("doc_id", X.clean_text(F.col("text")).alias("cleaned"),
                                 X.strip_accents(F.col("text")).alias("bare"))


IDEOGRAPHS_SQL = X.IDEOGRAPHS


@registered(rf"""WITH d AS (SELECT doc_id, replace(replace(text, 'th', chr(26085)), 'en', chr(26412)) AS text FROM documents)
  SELECT doc_id, regexp_replace(text, '([{IDEOGRAPHS_SQL}])', ' \1 ', 'g') AS padded FROM d""")
def pad_ideographs(spark, t):
    text = F.replace(F.replace("text", F.lit("th"), F.lit("日")), F.lit("en"), F.lit("本"))
    return spread(t["documents"]).select("doc_id", X.pad_ideographs(text).alias("padded"))


@registered(f"SELECT doc_id, len({sql_tokens('text')}) AS n_tokens, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents")
def basic_tokens(spark, t):
    return (spread(t["documents"]).select("doc_id", X.basic_tokens(F.col("text")).alias("t"))
            .select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens")))


TRACE = "'Exception in thread main' || chr(10) || replace(text, '. ', '.' || chr(10) || chr(9) || 'at ')"


def trace_text() -> Column:
    return F.concat(F.lit("Exception in thread main\n"), F.replace("text", F.lit(". "), F.lit(".\n\tat ")))


@registered(f"""WITH d AS (SELECT doc_id, {TRACE} AS raw FROM documents)
  SELECT doc_id, {sql_trace('raw', 5)} AS shortened,
         len(list_filter(string_split(raw, chr(10)), lambda x: {sql_frame('x')})) AS n_frames FROM d""")
def shorten_trace(spark, t):
    rows = spread(t["documents"]).select("doc_id", trace_text().alias("raw"))
    return rows.select("doc_id", X.shorten_trace(F.col("raw"), 5).alias("shortened"),
                       F.size(F.filter(F.split("raw", "\n"), X.is_frame)).cast("long").alias("n_frames"))


def compact_sql(verbosity: str) -> str:
    frames, n = {"minimal": (5, 200), "standard": (10, 2000), "full": (0, 0)}[verbosity]
    if verbosity == "full":
        return "raw"
    return f"CASE WHEN type = 'ERROR' AND s <> raw THEN s ELSE {sql_truncate('raw', n)} END".replace(
        " s ", f" {sql_trace('raw', frames)} ")


TYPED = f"d AS (SELECT doc_id, {TRACE} AS raw, CASE WHEN doc_id % 2 = 0 THEN 'ERROR' ELSE 'REQUEST' END AS type FROM documents)"


def typed_logs(t: Tables) -> DataFrame:
    return spread(t["documents"]).select("doc_id", trace_text().alias("raw"),
                                 F.when(F.col("doc_id") % 2 == 0, "ERROR").otherwise("REQUEST").alias("type"))


def _compact_query(verbosity: str):
    def query(spark, t):
        rows = typed_logs(t)
        return rows.select("doc_id", compact(F.col("raw"), F.col("type"), verbosity).alias("compacted"))
    query.__name__ = f"compact_{verbosity}"
    registered(f"WITH {TYPED} SELECT doc_id, {compact_sql(verbosity)} AS compacted FROM d")(query)


for _verbosity in ("minimal", "standard", "full"):
    _compact_query(_verbosity)


@registered(f"""WITH {TYPED}, c AS (SELECT type, {sql_estimate('raw')} AS b, {compact_sql('minimal')} AS m FROM d)
  SELECT type, count(*) AS n_rows, CAST(sum(b) AS BIGINT) AS tokens_before, CAST(sum({sql_estimate('m')}) AS BIGINT) AS tokens_after,
         round((sum(b) - sum({sql_estimate('m')})) / sum(b) * 100, 6) AS saved_pct FROM c GROUP BY type""")
def compaction_ratio(spark, t):
    rows = typed_logs(t).withColumn("compacted", compact(F.col("raw"), F.col("type"), "minimal"))
    return compaction_report(rows, ["type"]).withColumn("saved_pct", r6("saved_pct"))


@registered(r"""SELECT event_id,
  CASE WHEN event_id % 3 = 0 THEN props || ' trailing "k"'
       WHEN event_id % 3 = 1 THEN '{"msg":"' || event_type || '","value":' || regexp_replace(CAST(value AS VARCHAR), '\.0$', '') || '}'
       ELSE '{}' END AS stripped FROM events""")
def strip_json_fields(spark, t):
    record = F.concat(F.lit(' {"trace_id": "t'), F.col("event_id").cast("string"), F.lit('", "value": '),
                      F.col("value").cast("string"), F.lit(', "msg": "'), F.col("event_type"), F.lit('"}\n'))
    raw = (F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit(' trailing "k"')))
           .when(F.col("event_id") % 3 == 1, record).otherwise(F.col("props")))
    return t["events"].select("event_id", strip_fields(raw, ("k", *DEFAULT_STRIP_FIELDS)).alias("stripped"))


@registered(f"""WITH d AS (SELECT event_id, CAST(floor(value * user_id * 10007) AS BIGINT) AS us FROM events)
  SELECT event_id, {sql_duration('us')} AS shown FROM d""")
def format_duration(spark, t):
    micros = F.floor(F.col("value") * F.col("user_id") * 10007)
    return t["events"].select("event_id", X.format_duration(micros).alias("shown"))


@registered(r"""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '(invalid URL)' ELSE
    regexp_replace(regexp_replace(CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '://', '://u:p@') ELSE url END,
      '//[^/?#]*@', '//REDACTED@'), '\?[^#]+', '?REDACTED') END AS shown,
  regexp_extract(url, '[^/]*$') AS base FROM pages""")
def redact_urls(spark, t):
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "://", "://u:p@")).otherwise(F.col("url"))
    url = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit(":"), url)).otherwise(url)
    return t["pages"].select("page_id", X.redact_url(url).alias("shown"), X.basename(F.col("url")).alias("base"))


@registered(f"""SELECT conv_id, turn, 'UNCLASSIFIED' AS type, 'empty_input' AS category, 'warning' AS severity,
  CAST(0 AS DOUBLE) AS confidence, '' AS summary, CASE WHEN turn % 4 = 0 THEN chr(9) || ' ' || chr(10) || chr(160) ELSE '' END AS raw
  FROM conversations WHERE turn % 4 <= 1""")
def empty_input(spark, t):
    raw = (F.when(F.col("turn") % 4 == 0, F.lit("\t \n ")).when(F.col("turn") % 4 == 1, F.lit(""))
           .otherwise(F.col("text")))
    rows = t["conversations"].select(F.struct("conv_id", "turn").alias("seq"), F.timestamp_seconds("turn").alias("ts"),
                                     raw.alias("raw"))
    return (normalize(rows).filter(F.col("category") == "empty_input")
            .select("seq.conv_id", "seq.turn", "type", "category", "severity", "confidence", "summary", "raw"))


# --- vectors ---------------------------------------------------------------------------

@registered("""WITH v AS (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
  SELECT label, i AS dim, round(avg(CAST(x AS DOUBLE)) FILTER (vec_id % 3 <> 0), 6) AS mean FROM v GROUP BY label, i""")
def mean_pool(spark, t):
    rows = t["embeddings"].withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    means = masked_mean(rows, ["label"], "embedding", 64, "mask")
    return (means.select("label", F.posexplode("mean").alias("p", "m"))
            .select("label", (F.col("p") + 1).cast("long").alias("dim"), r6("m").alias("mean")))


@registered("""WITH w AS (SELECT label AS i, arg_min(embedding, vec_id) AS row FROM embeddings GROUP BY label)
  SELECT vec_id, i, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(row AS DOUBLE[])), 4) AS y FROM embeddings, w""")
def dense_projection(spark, t):
    rows = taxonomy.collect_labels(prototypes(t))
    weights = np.array([r["vector"] for r in rows], dtype=np.float32)
    projected = t["embeddings"].select("vec_id", F.posexplode(project(F.col("embedding"), weights)).alias("i", "y"))
    return projected.select("vec_id", "i", F.round(F.col("y").cast("double"), 4).alias("y"))


def word_vocab(t: Tables, n: int = 400) -> DataFrame:
    """A vocabulary from the data: frequent words and letters, whole and as continuations."""
    tokens = spread(t["documents"]).select(F.explode(X.basic_tokens(F.col("text"))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    top = counts.filter(F.length("token") > 1).orderBy(F.desc("n"), "token").limit(n).select("token")
    letters = t.spark.range(25).select(F.char(F.col("id") + 97).alias("token"))
    pieces = top.unionByName(letters).select(F.explode(F.array("token", F.concat(F.lit("##"), "token"))).alias("token"))
    special = t.spark.createDataFrame([(x,) for x in ("[PAD]", "[UNK]", "[CLS]", "[SEP]")], "token string")
    return special.unionByName(pieces).select("token", F.xxhash64("token").alias("id"))


WORD_PIECE_SQL = f"""
  tok AS (SELECT doc_id, source, unnest({sql_tokens('text')}) AS token FROM documents),
  cnt AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
  top AS (SELECT token FROM cnt WHERE length(token) > 1 ORDER BY n DESC, token LIMIT 400),
  piece AS (SELECT token AS p FROM top UNION SELECT DISTINCT c FROM (SELECT unnest(string_split(token, '')) AS c FROM cnt)
            WHERE regexp_full_match(c, '[a-y]')),
  g(token, rest, n) AS (SELECT token, token, 0 FROM cnt WHERE length(token) <= 200 UNION ALL
    SELECT token, substr(rest, 1 + max(length(p))), n + 1 FROM g JOIN piece ON starts_with(rest, p) WHERE rest <> '' GROUP BY token, rest, n),
  split AS (SELECT cnt.token, coalesce(max(g.n) FILTER (rest = ''), 1) AS k, count(*) FILTER (rest = '') = 0 AS unk
            FROM cnt LEFT JOIN g USING (token) GROUP BY cnt.token),
  per_doc AS (SELECT doc_id, source, CAST(sum(k) AS BIGINT) AS k, count(*) FILTER (unk) AS n_unk FROM tok JOIN split USING (token) GROUP BY doc_id, source)"""


@registered(f"""WITH RECURSIVE {WORD_PIECE_SQL}
  SELECT source, count(*) AS n_rows, CAST(sum(k + 2) AS BIGINT) AS n_tokens, CAST(sum(n_unk) AS BIGINT) AS n_unk,
         CAST(0 AS BIGINT) AS n_truncated FROM per_doc GROUP BY source""")
def word_piece_report(spark, t):
    vocab = spark.sparkContext.broadcast(embed.collect_vocab(word_vocab(t)))
    ids = embed.word_piece_ids(F.col("text"), vocab, max_tokens=1_000_000_000)
    return embed.token_report(spread(t["documents"]).select("source", ids.alias("r")).select("source", "r.*"))


@registered(f"""WITH RECURSIVE {WORD_PIECE_SQL}
  SELECT doc_id, CAST(least(k, 126) + 2 AS INTEGER) AS n_tokens, k > 126 AS truncated FROM per_doc""")
def word_piece_ids(spark, t):
    vocab = spark.sparkContext.broadcast(embed.collect_vocab(word_vocab(t)))
    return (spread(t["documents"]).select("doc_id", embed.word_piece_ids(F.col("text"), vocab).alias("r"))
            .select("doc_id", "r.n_tokens", "r.truncated"))


# --- repeats ----------------------------------------------------------------------------

def event_stream_rows(events: DataFrame, seq: Column | None = None) -> DataFrame:
    return events.select(
        (F.col("event_id") if seq is None else seq).alias("seq"), F.lit("EVENT").alias("type"),
        F.col("event_type").alias("category"), F.lit("info").alias("severity"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.concat("event_type", F.lit(" "), "props").alias("summary"),
        (F.lit(0.5) + (F.col("event_id") % 4) * 0.125).alias("confidence"), F.col("props").alias("raw"),
        F.lit(0).alias("count"))


def dedup_sql(clock: str, seconds: int, seq: str = "event_id") -> str:
    """CTEs up to ``grp(seq, event_type, anchor, n, latest)``; ``clock`` is the time a row counts with."""
    return f"""
      src AS (SELECT {seq} AS seq, event_type, ts, props, {clock} AS c FROM events),
      a(event_type, anchor) AS (SELECT event_type, min(c) FROM src GROUP BY event_type UNION ALL
        SELECT a.event_type, min(s.c) FROM a JOIN src s ON s.event_type = a.event_type AND s.c > a.anchor + INTERVAL {seconds} SECOND
        GROUP BY a.event_type, a.anchor),
      mine AS (SELECT src.*, anchor FROM src ASOF JOIN a ON src.event_type = a.event_type AND src.c >= a.anchor),
      grp AS (SELECT event_type, anchor, count(*) AS n, max(c) AS latest, arg_min(seq, (c, seq)) AS seq FROM mine GROUP BY ALL),
      out AS (SELECT g.seq, 'EVENT' AS type, g.event_type AS category, s.ts AS timestamp,
                CAST(CASE WHEN n > 1 THEN n ELSE 0 END AS INTEGER) AS count, anchor, latest,
                s.event_type || ' ' || props || CASE WHEN n > 1 THEN ' (x' || n || ' in ' ||
                  {sql_duration("(epoch_us(latest) - epoch_us(anchor))")} || ')' ELSE '' END AS summary
              FROM grp g JOIN src s ON s.seq = g.seq)"""


DEDUP_OUT = "SELECT seq, type, category, timestamp, count, summary FROM out"


def dedup_out(events: DataFrame) -> DataFrame:
    return events.select("seq", "type", "category", no_zone("timestamp").alias("timestamp"), "count", "summary")


@registered(f"WITH RECURSIVE {dedup_sql('ts', 3600)} {DEDUP_OUT}")
def dedup_event_time(spark, t):
    return dedup_out(dedup.deduplicate(event_stream_rows(t["events"]), 3600, "time"))


SHUFFLED = "CAST(xor(event_id, 31) AS BIGINT)"


@registered(f"""WITH RECURSIVE {dedup_sql(f'max(ts) OVER (PARTITION BY event_type ORDER BY {SHUFFLED})', 1800, SHUFFLED)} {DEDUP_OUT}""")
def dedup_arrival_order(spark, t):
    return dedup_out(dedup.deduplicate(event_stream_rows(t["events"], F.col("event_id").bitwiseXOR(31)), 1800))


@registered(f"""WITH RECURSIVE {dedup_sql('ts', 600)}
  SELECT CAST(sum(greatest(count, 1)) AS BIGINT) AS total, count(*) AS events FROM out""")
def dedup_conservation(spark, t):
    return dedup.total_count(dedup.deduplicate(event_stream_rows(t["events"]), 600))


# --- sources ----------------------------------------------------------------------------

@registered("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09' ORDER BY ts, event_id LIMIT 700")
def time_range_limit(spark, t):
    rows = t["events"].select("event_id", "ts", "event_type").filter(
        (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-09").cast("timestamp_ntz")))
    return sources.merged([rows], 700, ("ts", "event_id"))


@registered("""SELECT event_type, chunk, rank, event_id FROM (
    SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-02 06:00:00')) // 86400000000 AS chunk,
           row_number() OVER (PARTITION BY event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-02 06:00:00')) // 86400000000 ORDER BY ts, event_id) AS rank
    FROM events WHERE ts >= TIMESTAMP '2024-01-02 06:00:00' AND ts < TIMESTAMP '2024-01-20') WHERE rank <= 25""")
def top_per_chunk(spark, t):
    events = t["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    top = sources.chunked_top(events, utc(2, 6), utc(20), "event_type", "ts", "event_id", per_chunk=25)
    return top.select("event_type", "chunk", F.col("rank").cast("long").alias("rank"), "event_id")


@registered("""SELECT event_id AS seq, event_type || 's' AS source, ts, props AS raw FROM events ORDER BY ts, source, seq LIMIT 900""")
def merge_sources(spark, t):
    """Every event type as a source of its own."""
    kinds = [r[0] for r in t["events"].select("event_type").distinct().orderBy("event_type").collect()]

    def part(kind):
        return t["events"].filter(F.col("event_type").eqNullSafe(F.lit(kind))).select(
            F.col("event_id").alias("seq"), F.concat("event_type", F.lit("s")).alias("source"), "ts", F.col("props").alias("raw"))
    return sources.merged([part(kind) for kind in kinds], 900, ("ts", "source", "seq"))


def landed_pages(t: Tables, record: Column, array: str, schema, size: int = 100, **extra: Column) -> DataFrame:
    """Provider responses made from the events: JSON text per page, read with the page schema."""
    rows = t["events"].select((F.floor(F.col("event_id") / size)).alias("page_no"), F.col("event_id").alias("o"),
                              record.alias("r"), *[c.alias(n) for n, c in extra.items()])
    pages = rows.groupBy("page_no", *extra).agg(F.sort_array(F.collect_list(F.struct("o", F.to_json("r").alias("r")))).alias("rows"))
    body = F.concat(F.lit('{"%s":[' % array), F.array_join(F.transform("rows", lambda x: x["r"]), ","), F.lit("]}"))
    return pages.select("page_no", *extra, F.from_json(body, schema).alias("p")).select("page_no", *extra, "p.*")


@registered("""SELECT event_id, CAST(date_trunc('milliseconds', ts) AS TIMESTAMP) AS ts, 'vercel' AS source, 'GET ' || event_type AS raw,
  'info' AS level, 'lambda' AS origin, 'log_' || event_id AS id,
  CASE WHEN event_id % 2 = 0 THEN '200' END AS status_code, CASE WHEN event_id % 2 = 0 THEN '/u/' || user_id END AS path,
  CASE WHEN event_id % 2 = 0 THEN 7 ELSE 3 END AS n_metadata FROM events""")
def vercel_pages(spark, t):
    proxy = F.when(F.col("event_id") % 2 == 0, F.struct(
        F.lit(200).alias("statusCode"), F.concat(F.lit("/u/"), "user_id").alias("path"), F.lit("GET").alias("method"),
        F.lit("app.example.com").alias("host")))
    record = F.struct(F.concat(F.lit("log_"), "event_id").alias("id"), F.concat(F.lit("GET "), "event_type").alias("message"),
                      F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.lit("lambda").alias("source"),
                      F.lit("info").alias("level"), proxy.alias("proxy"))
    rows = sources.vercel_logs(landed_pages(t, record, "data", schemas.VERCEL_PAGE), "page_no")
    m = F.col("metadata")
    return rows.select((F.col("page_no") * 100 + F.col("pos")).alias("event_id"), no_zone("ts").alias("ts"), "source", "raw",
                       m["level"].alias("level"), m["source"].alias("origin"), m["id"].alias("id"),
                       m["status_code"].alias("status_code"), m["path"].alias("path"), F.size(m).alias("n_metadata"))


@registered("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN TIMESTAMP '2024-02-01' ELSE ts END AS ts, event_type AS raw,
  CASE WHEN event_id % 3 = 0 THEN 'overlay' ELSE 'ord' END AS region, CAST(user_id AS VARCHAR) AS custom, 5 AS n_metadata FROM events""")
def flyio_pages(spark, t):
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    stamp = F.when(F.col("event_id") % 10 == 0, F.lit("yesterday")).otherwise(stamp)
    meta = F.create_map(F.lit("custom"), F.col("user_id").cast("string"))
    meta = F.when(F.col("event_id") % 3 == 0, F.map_concat(meta, F.create_map(F.lit("region"), F.lit("overlay")))).otherwise(meta)
    record = F.struct(F.col("event_id").cast("string").alias("id"), F.lit("log").alias("type"), F.struct(
        stamp.alias("timestamp"), F.col("event_type").alias("message"), F.lit("info").alias("level"),
        F.lit("i1").alias("instance"), F.lit("ord").alias("region"), meta.alias("meta")).alias("attributes"))
    pages = landed_pages(t, record, "data", schemas.FLYIO_PAGE)
    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    rows = sources.flyio_logs(pages, "page_no", now=now)
    m = F.col("metadata")
    return rows.select((F.col("page_no") * 100 + F.col("pos")).alias("event_id"), no_zone("ts").alias("ts"), "raw",
                       m["region"].alias("region"), m["custom"].alias("custom"), F.size(m).alias("n_metadata"))


@registered("""SELECT event_id, ts, event_type AS raw, CASE event_type WHEN 'click' THEN 'edge_logs' WHEN 'view' THEN 'auth_logs' ELSE 'postgres_logs' END AS tbl,
  'e' || event_id AS id, CAST(user_id AS VARCHAR) AS extra, 4 AS n_metadata FROM events""")
def supabase_pages(spark, t):
    name = (F.when(F.col("event_type") == "click", "edge_logs").when(F.col("event_type") == "view", "auth_logs")
            .otherwise("postgres_logs"))
    record = F.struct(F.concat(F.lit("e"), "event_id").alias("id"),
                      F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"),
                      F.col("event_type").alias("event_message"), F.col("user_id").alias("extra"))
    rows = sources.supabase_logs(landed_pages(t, record, "result", schemas.SUPABASE_PAGE, table=name))
    m = F.col("metadata")
    return rows.select(F.substring(m["id"], 2, 20).cast("long").alias("event_id"), no_zone("ts").alias("ts"), "raw",
                       m["table"].alias("tbl"), m["id"].alias("id"), m["extra"].alias("extra"), F.size(m).alias("n_metadata"))


@registered("""SELECT event_id, ts FROM events ORDER BY event_id LIMIT 1234""")
def page_cursor_limit(spark, t):
    record = F.struct(F.col("event_id").cast("string").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"))
    pages = landed_pages(t, record, "data", schemas.VERCEL_PAGE)
    rows = sources.page_order(sources.vercel_logs(pages, "page_no"), 1234)
    ids = rows.select(F.col("metadata")["id"].cast("long").alias("event_id"))
    return t["events"].select("event_id", "ts").join(ids, "event_id")


def landed_files(spark, t: Tables, record: Column, array: str, size: int = 100, **extra: Column) -> str:
    """A folder of provider responses made from the events, a page per line, for the registered readers."""
    rows = t["events"].select(F.floor(F.col("event_id") / size).alias("page_no"), F.col("event_id").alias("o"),
                              record.alias("r"), *[c.alias(n) for n, c in extra.items()])
    pages = rows.groupBy("page_no", *extra).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]).alias(array))
    folder = work_path(spark, "landed")
    # Files and the lines in them follow the pages, so the reader's own order is that of the events.
    ranged = pages.repartitionByRange(4, "page_no").sortWithinPartitions("page_no")
    ranged.select(F.to_json(F.struct(array)).alias("value"), *extra).write.partitionBy(*extra).text(folder)
    return folder


def vercel_record() -> Column:
    return F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("message"),
                    F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.lit("edge").alias("source"), F.lit("info").alias("level"))


@registered("SELECT event_id, event_type AS raw, CAST(date_trunc('milliseconds', ts) AS TIMESTAMP) AS ts FROM events ORDER BY event_id LIMIT 1250")
def vercel_reader_limit(spark, t):
    """Pages in landed files through the registered reader, cut inside a page."""
    rows = sources.read(spark, "vercel", path=landed_files(spark, t, vercel_record(), "data"), n=1250)
    return rows.select(F.col("metadata")["id"].cast("long").alias("event_id"), "raw", no_zone("ts").alias("ts"))


@registered("""SELECT event_id, event_type AS raw, ts, 'i' || user_id AS instance FROM events
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09 12:00:00' ORDER BY event_id LIMIT 900""")
def flyio_reader_range(spark, t):
    """A half-open range and a limit through the registered reader."""
    record = F.struct(F.col("event_id").cast("string").alias("id"), F.struct(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.col("event_type").alias("message"), F.concat(F.lit("i"), "user_id").alias("instance")).alias("attributes"))
    rows = sources.read(spark, "flyio", path=landed_files(spark, t, record, "data"), start=utc(5), end=utc(9, 12), n=900)
    m = F.col("metadata")
    return rows.select(m["id"].cast("long").alias("event_id"), "raw", no_zone("ts").alias("ts"), m["instance"].alias("instance"))


@registered("""SELECT event_id, ts, event_type AS raw, CASE event_type WHEN 'click' THEN 'edge_logs' ELSE 'auth_logs' END AS tbl FROM (
    SELECT *, row_number() OVER (PARTITION BY event_type = 'click', (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-03')) // 86400000000
                                 ORDER BY ts, CAST(event_id AS VARCHAR)) AS r
    FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20') WHERE r <= 40""")
def supabase_reader(spark, t):
    """Selected tables, a range, and the first rows of each table and day, through the registered reader."""
    name = (F.when(F.col("event_type") == "click", "edge_logs").when(F.col("event_type") == "view", "auth_logs").otherwise("storage_logs"))
    record = F.struct(F.col("event_id").cast("string").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp"),
                      F.col("event_type").alias("event_message"))
    folder = landed_files(spark, t, record, "result", table=name)
    rows = sources.read(spark, "supabase", path=folder, start=utc(3), end=utc(20), tables="edge_logs,auth_logs", per_chunk=40)
    m = F.col("metadata")
    return rows.select(m["id"].cast("long").alias("event_id"), no_zone("ts").alias("ts"), "raw", m["table"].alias("tbl"))


@registered("""SELECT row_number() OVER (ORDER BY CASE WHEN event_id < 3 THEN 0 WHEN event_id % 4 > 0 THEN 1 ELSE 2 END, event_id) - 1 AS seq,
  event_id FROM events""")
def text_reader_order(spark, t):
    """Folders of three, most and the other lines: numbers follow file and line, not size."""
    part = F.when(F.col("event_id") < 3, 0).when(F.col("event_id") % 4 > 0, 1).otherwise(2)
    folder = work_path(spark, "text")
    (t["events"].select(part.alias("part"), "event_id").repartitionByRange(4, "part", "event_id").sortWithinPartitions("part", "event_id")
     .select("part", F.col("event_id").cast("string").alias("value")).write.partitionBy("part").text(folder))
    return sources.read(spark, "file", path=folder).select("seq", F.col("raw").cast("long").alias("event_id"))


@registered("""WITH m AS (SELECT event_type, max(ts) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1)
  SELECT event_type, count(*) AS n_new, min(ts) AS first_new, max(ts) AS mark FROM events JOIN m USING (event_type)
  WHERE ts > m.mark AND ts < TIMESTAMP '2024-01-15' GROUP BY event_type""")
def incremental_marks(spark, t):
    events = t["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    old = events.filter(F.col("ts") < F.lit(utc(10)))
    marks = old.groupBy("event_type").agg(F.max("ts").alias("mark"))
    fresh = sources.newer_than(events, marks, utc(15), utc(1), "event_type")
    counts = fresh.groupBy("event_type").agg(F.count("*").alias("n_new"), F.min("ts").alias("first_new"))
    return (counts.join(sources.next_marks(marks, fresh, "event_type"), "event_type")
            .select("event_type", "n_new", no_zone("first_new").alias("first_new"), no_zone("mark").alias("mark")))


@registered("""WITH x AS (SELECT event_id, ts, event_id % 5 AS k FROM events)
  SELECT event_id, CASE k WHEN 0 THEN TIMESTAMP '2024-02-01' WHEN 1 THEN date_trunc('second', ts)
    WHEN 2 THEN ts - INTERVAL 90 MINUTE ELSE ts END AS ts FROM x""")
def parse_rfc3339(spark, t):
    ts = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 5
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(k == 0, F.lit("2024-13-01T00:00:00Z")).when(k == 1, F.concat(base, F.lit("Z")))
            .when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+01:30'"))
            .otherwise(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("999Z"))))
    rows = t["events"].select("event_id", X.parse_rfc3339(text).alias("ts"))
    return default_time(rows, datetime(2024, 2, 1, tzinfo=timezone.utc)).withColumn("ts", no_zone("ts"))


@registered("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS raw FROM documents)
  SELECT raw, count(*) AS n FROM (SELECT regexp_replace(raw, '\\r$', '') AS raw FROM l) WHERE raw <> '' GROUP BY raw""")
def text_line_scan(spark, t):
    path = work_path(spark, "lines")
    t["documents"].select("text").write.text(path)
    lines, too_long = sources.text_lines(spark, path)
    return lines.select("raw").unionByName(too_long.select("raw")).groupBy("raw").agg(F.count("*").alias("n"))


# --- events out ---------------------------------------------------------------------------

@registered("""SELECT event_id AS seq, 'EVENT' AS type, event_type AS category, CAST(0 AS DOUBLE) AS confidence, '' AS raw FROM events""")
def minimal_fields(spark, t):
    return event_fields(event_stream_rows(t["events"]), "minimal").select("seq", "type", "category", "confidence", "raw")


STAMP = r"regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', '') || 'Z'"
EVENT_JSON = f"""'{{"type":"EVENT","category":"' || event_type || '","severity":"info","timestamp":"' || {STAMP} ||
  '","summary":"' || event_type || ' ' || replace(props, '"', '\\"') || '","confidence":' || CAST(0.5 + (event_id % 4) * 0.125 AS DOUBLE) ||
  ',"raw":"' || replace(props, '"', '\\"') || '"}}'"""


@registered(f"SELECT event_id AS seq, {EVENT_JSON} AS json FROM events")
def ndjson(spark, t):
    return event_stream_rows(t["events"]).select("seq", event_json().alias("json"))


@registered(f"""SELECT event_id AS seq, {EVENT_JSON} AS json FROM (
  SELECT * REPLACE (ts + to_months(CAST(event_id % 37 * 10 - 290 AS INTEGER)) AS ts) FROM events)""")
def ndjson_other_months(spark, t):
    """Times in all months between 1999 and 2029."""
    moved = t["events"].withColumn("ts", F.expr("ts + make_ym_interval(0, CAST(event_id % 37 * 10 - 290 AS INT))"))
    return event_stream_rows(moved).select("seq", event_json().alias("json"))


@registered("SELECT props AS raw, count(*) * 2 AS n FROM events WHERE props <> '' GROUP BY props")
def two_runs_append(spark, t):
    """The whole job twice into one folder, from text files over the file reader."""
    path, out = work_path(spark, "lines"), work_path(spark, "runs")
    t["events"].select("props").write.text(path)
    for _ in range(2):
        query(spark, "file", [sinks.parquet(out)], datetime(2000, 1, 1), datetime(2100, 1, 1), dedup=False, path=path)
    return spark.read.parquet(out).groupBy("raw").agg(F.count("*").alias("n"))


@registered(f"SELECT {EVENT_JSON} AS json, count(*) AS n FROM events GROUP BY 1")
def ndjson_sink(spark, t):
    path = work_path(spark, "ndjson")
    sinks.ndjson(path, max_records_per_file=50_000)(event_stream_rows(t["events"]), 0)
    return spark.read.text(path).select(F.col("value").alias("json")).groupBy("json").agg(F.count("*").alias("n"))


@registered(f"""SELECT batch_id, count(*) AS n, '[' || string_agg(j, ',' ORDER BY event_id) || ']' AS body FROM (
  SELECT event_id, {EVENT_JSON} AS j, (row_number() OVER (ORDER BY event_id) - 1) // 50 AS batch_id FROM events) GROUP BY batch_id""")
def payload_batches(spark, t):
    return batching.payloads(batching.ordered_batches(event_stream_rows(t["events"])), event_json("full"))


@registered(f"""WITH {lexical_sql()} SELECT CASE WHEN severity = 'error' THEN 'alerts' ELSE 'log' END AS route, count(*) AS n
  FROM found WHERE severity IN ('error', 'warning') GROUP BY 1""")
def severity_routing(spark, t):
    events = document_labels(t)
    alerts = by_severity(events, "error").select(F.lit("alerts").alias("route"))
    return alerts.unionByName(by_severity(events, "warning").select(F.lit("log").alias("route"))).groupBy("route").agg(F.count("*").alias("n"))


# --- streams ------------------------------------------------------------------------------

def file_stream(spark: SparkSession, t: Tables, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files; a pattern is the form of path that a stream takes for both."""
    return spark.readStream.schema(t[name].schema).parquet(f"{t.path}/{name}.parque[t]")


def drained(events: DataFrame, name: str, through=lambda sink: sink, rest=None) -> DataFrame:
    """Run a stream to the end of its input; its output as a table, with ``rest(checkpoint)`` of what it held back."""
    spark = events.sparkSession
    path = work_path(spark, name)
    sink = through(sinks.parquet(path))
    checkpoint = work_path(spark, f"{name}-checkpoint")
    streams.start(events, sink, checkpoint).awaitTermination()
    if rest is not None:
        sink(rest(checkpoint), -1)
    return spark.read.parquet(path)


@registered(f"WITH {lexical_sql()} {EVENTS_SQL}")
def stream_direct(spark, t):
    docs = file_stream(spark, t, "documents")
    logs = docs.select(F.col("doc_id").alias("seq"), F.timestamp_seconds("doc_id").alias("ts"), F.col("text").alias("raw"))
    events = drained(streams.direct(logs, options=Options(threshold=THRESHOLD)), "direct")
    return events.select("seq", "type", "category", "severity", "summary", r6("confidence").alias("confidence"), "raw", "count")


@registered(f"WITH RECURSIVE {dedup_sql('ts', 3600)} {DEDUP_OUT}")
def stream_micro_batches(spark, t):
    rows = event_stream_rows(file_stream(spark, t, "events"))
    return dedup_out(drained(rows, "batches", lambda sink: streams.dedup_batches(sink, 3600)))


@registered(f"WITH RECURSIVE {dedup_sql('ts', 3600)} {DEDUP_OUT}")
def stream_event_time(spark, t):
    streams.use_rocksdb(spark)
    rows = event_stream_rows(file_stream(spark, t, "events"))
    return dedup_out(drained(streams.event_time_dedup(rows, 3600, "0 seconds"), "event-time",
                             rest=lambda checkpoint: streams.left_open(spark, checkpoint, 3600)))


def in_slices(events: DataFrame, slices: int = 4) -> DataFrame:
    """``events`` landed as a folder per stretch of time, one after the other, read as a stream of one file a batch."""
    spark, path = events.sparkSession, work_path(events.sparkSession, "slices")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    edges = [low + (high - low) * k / slices for k in range(1, slices)] if low is not None else []
    for start, end in zip([None, *edges], [*edges, None]):
        sources.in_range(events, start, end).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@registered(f"WITH RECURSIVE {dedup_sql('ts', 3600)} {DEDUP_OUT}")
def stream_event_time_chunked(spark, t):
    """The same over several batches, groups and waiting rows going from one to the next."""
    streams.use_rocksdb(spark)
    rows = event_stream_rows(in_slices(t["events"]))
    return dedup_out(drained(streams.event_time_dedup(rows, 3600, "1 hour"), "event-time-chunked",
                             rest=lambda checkpoint: streams.left_open(spark, checkpoint, 3600)))


@registered("SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1")
def stream_null_times(spark, t):
    """Every seventh event without a time: it counts with the time of its batch, and no row is lost."""
    streams.use_rocksdb(spark)
    rows = event_stream_rows(file_stream(spark, t, "events"))
    rows = rows.withColumn("timestamp", F.when(F.col("seq") % 7 != 0, F.col("timestamp")))
    out = drained(streams.event_time_dedup(rows, 60, "0 seconds"), "null-times",
                  rest=lambda checkpoint: streams.left_open(spark, checkpoint, 60))
    return out.groupBy("category").agg(F.sum(F.greatest("count", F.lit(1))).cast("long").alias("n"))


@registered("""SELECT count(*) AS seen, count(*) FILTER (NOT contains(text, '@')) AS written, count(*) FILTER (contains(text, '@')) AS skipped,
  count(*) FILTER (NOT contains(text, '@')) AS events, count(*) FILTER (contains(text, '@')) AS rejects FROM documents""")
def stream_counts(spark, t):
    """Counters of a stream whose model fails on some rows, beside what came out."""
    docs = file_stream(spark, t, "documents")
    logs = docs.select(F.col("doc_id").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), F.col("text").alias("raw"))
    path = work_path(spark, "rejects")
    listener = streams.CountListener("counted")
    spark.streams.addListener(listener)
    try:
        rows = streams.counted_events(logs, embedder=classify.ModelEmbedder(PickyModel), name="counted")
        events = drained(rows, "counted", lambda sink: streams.with_rejects(sink, sinks.parquet(path)))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    written, skipped = (sum(b[k] for b in listener.batches) for k in (1, 2))
    out = events.select(F.lit(1).alias("event")).unionByName(spark.read.parquet(path).select(F.lit(0).alias("event")))
    return out.agg(F.lit(written + skipped).cast("long").alias("seen"), F.lit(written).cast("long").alias("written"),
                   F.lit(skipped).cast("long").alias("skipped"), F.count_if(F.col("event") == 1).alias("events"),
                   F.count_if(F.col("event") == 0).alias("rejects"))


@registered("""SELECT count(*) AS seen, count(*) FILTER (NOT contains(text, '@')) AS written, count(*) FILTER (contains(text, '@')) AS skipped,
  count(*) FILTER (contains(text, '@')) AS rejects FROM documents""")
def job_counts(spark, t):
    """The same counters of a one-shot job, kept by an observation."""
    folder = work_path(spark, "lines")
    t["documents"].select(F.to_json(F.struct(F.lit(0).alias("page"), F.array(F.struct(
        F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") * 1000).alias("timestamp"), F.lit("lambda").alias("source"),
        F.col("text").alias("message"), F.lit("info").alias("level"))).alias("data"))).alias("value")).write.text(folder)
    counts = Observation()
    rejected = query(spark, "vercel", [sinks.parquet(work_path(spark, "job"))], datetime(1970, 1, 1, tzinfo=timezone.utc),
                     datetime(2100, 1, 1, tzinfo=timezone.utc), Normalizer(spark, embedder=classify.ModelEmbedder(PickyModel)),
                     dedup=False, counts=counts, path=folder)
    written, skipped = counts.get["written"], counts.get["skipped"]
    return rejected.agg(F.count("*").alias("rejects")).select(
        F.lit(written + skipped).cast("long").alias("seen"), F.lit(written).cast("long").alias("written"),
        F.lit(skipped).cast("long").alias("skipped"), "rejects")


@registered("SELECT event_id, ts FROM events")
def stream_without_copies(spark, t):
    """A page landed twice: every row of the stream exists two times."""
    events = file_stream(spark, t, "events")
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = twice.select(F.col("ts").cast("timestamp").alias("ts"), F.lit("events").alias("source"), F.col("props").alias("raw"),
                        F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("metadata"))
    out = drained(sources.once(rows, "1 hour"), "once")
    return out.select(F.col("metadata")["id"].cast("long").alias("event_id"), no_zone("ts").alias("ts"))


# --- the driver's view -------------------------------------------------------------------

def _prepared(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query):
        def run(spark: SparkSession, path: str) -> DataFrame:
            _prepared(spark)
            return query(spark, Tables(spark, path))
        return run
    return {name: bind(query) for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
