"""Language identification (operator 9).

Character n-grams, hashed and weighed by TF-IDF, go into a sparse multinomial
logistic regression that is trained with follow-the-regularised-leader (L1 and L2
penalties) and calibrated by one temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 14
ORDERS = (1, 2, 3)
#: Labelled rows that the model is fitted on, shared evenly by the languages. Document frequencies count all rows.
SAMPLE = 3000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
UNKNOWN = "und"
BLOCK = 1 << 20


def gram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text, lower-cased; long texts are counted in blocks."""
    counts = np.zeros(1 << bits, np.int64)
    for at in range(0, len(text), BLOCK):
        block = text[at:at + BLOCK + max(ORDERS) - 1].lower()
        code = np.frombuffer(block.encode("utf-32-le", "replace"), "<u4")
        for n in ORDERS:
            size = min(len(code) - n + 1, BLOCK)
            if size <= 0:
                continue
            h = np.full(size, n, np.uint32)
            for k in range(n):
                h = (h ^ code[k:k + size]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            counts += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    return counts


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, the last row is the bias
    temperature: float = 1.0

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        return at, self.scaled(at, counts[at])

    def scaled(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        norm = np.sqrt((x * x).sum())
        return x / norm if norm else x

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.weights[-1]

    def predict(self, text: str) -> tuple[str, float]:
        p = softmax(self.scores(*self.features(gram_counts(text))) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, classes: int) -> np.ndarray:
    """Weights (buckets + 1 bias, classes) by FTRL-proximal with elastic net; the bias has no L1."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))
    l1 = np.full((buckets + 1, 1), L1)
    l1[-1] = 0

    def solved(at):
        za, na, la = z[at], n[at], l1[at]
        return np.where(np.abs(za) <= la, 0.0, (np.sign(za) * la - za) / ((BETA + np.sqrt(na)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, label in rows:
            at, x = np.append(at, buckets), np.append(x, 1.0)
            w = solved(at)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return solved(np.arange(buckets + 1))


def best_temperature(scores: list[tuple[np.ndarray, int]]) -> float:
    """The temperature of least log loss, between 1/16 and 16."""
    def loss(t):
        return -sum(np.log(max(softmax(s / t)[label], 1e-12)) for s, label in scores)
    return min((2.0 ** (k / 4) for k in range(-16, 17)), key=lambda t: (round(loss(t), 9), t)) if scores else 1.0


def held_out():
    """crc32 of the doc_id as text, modulo 3, is 1. Rows without doc_id are held out as well."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> LanguageModel | None:
    """Model of the labelled, not held-out rows; None where there are none.

    Document frequencies are counted over all of these rows, in the tasks, and
    reach the driver as one count per bucket. The regression is fitted on at most
    ``sample`` rows, chosen by hash of the doc_id; their n-gram counts, not their
    texts, come to the driver.
    """
    rows = docs.where(~held_out()).where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    quota = max(sample // len(languages), 1)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text in batch.column(0):
                df += gram_counts(text.as_py(), bits) > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["bucket", "n"])

    found = (rows.select("text").mapInArrow(frequencies, "bucket int, n long")
             .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    df = np.zeros(1 << bits)
    df[found["bucket"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1

    # Half as many again as wanted, so that hardly ever fewer come; the rest is cut off below.
    rate = F.element_at(F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.5 * quota / n)))), F.col("lang"))
    order = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [gram_counts(t.as_py(), bits) for t in batch.column(2)]
            ats = [np.flatnonzero(g).astype("<i4") for g in grams]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.tobytes() for a in ats], pa.binary()),
                 pa.array([g[a].astype("<i4").tobytes() for g, a in zip(grams, ats)], pa.binary())],
                names=["order", "lang", "at", "n"])

    picked = (rows.select(order.alias("order"), "lang", "text").where(F.col("order") < rate * float(1 << 53))
              .mapInArrow(vectors, "order long, lang string, at binary, n binary").collect())
    picked.sort(key=lambda r: (r["order"], r["lang"], r["at"], r["n"]))
    model = LanguageModel(languages, idf, np.zeros(((1 << bits) + 1, len(languages))))
    seen, examples = dict.fromkeys(languages, 0), []
    for r in picked:
        seen[r["lang"]] += 1
        if seen[r["lang"]] <= quota:
            at = np.frombuffer(r["at"], "<i4")
            examples.append((at, model.scaled(at, np.frombuffer(r["n"], "<i4")), languages.index(r["lang"])))
    fit, calibrate = [e for k, e in enumerate(examples) if k % 5], examples[::5]
    model.weights = ftrl(fit or examples, 1 << bits, len(languages))
    model.temperature = best_temperature([(model.scores(at, x), label) for at, x, label in calibrate])
    return model


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (double, calibrated probability of that language).

    Whole texts are read. Null texts, texts without a letter, and all texts where
    there is no model are ``und`` with score 0. Columns of these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        out = [model.predict(t.as_py()) if t.is_valid else (None, None) for t in texts]
        return pa.StructArray.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                                          names=["lang_pred", "score"])

    wordless = F.coalesce(~F.col("text").rlike(r"\p{L}"), F.lit(True))
    if model is None:
        return docs.select(*names, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return (docs.select(*names).withColumn("_p", predict(F.when(~wordless, F.col("text"))))
            .select(*names, F.coalesce("_p.lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
                    F.coalesce("_p.score", F.lit(0.0)).alias("score")))


def known(docs: DataFrame, model: LanguageModel | None, least: float = 0.5) -> DataFrame:
    """The rows whose language is recognised with a score of at least ``least``, with the columns of ``docs``."""
    rows = identify(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return rows.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
