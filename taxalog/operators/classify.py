"""Nearest label by cosine similarity.

The label set is small, so it travels inside the plan and every row finds its
label where it is: no join, no shuffle, no Python for the lexical form.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxalog.functions.text import let, words
from taxalog.functions.vectors import cosine, to_matrix
from taxalog.operators.embed import MAX_TOKENS, Model, embed_labels, embed_text, encode_ids, with_vectors, word_piece_ids
from taxalog.operators.taxonomy import collect_labels

UNCLASSIFIED = "UNCLASSIFIED"
#: Least similarity of neural models, where an embedder names none of its own.
MODEL_THRESHOLD = 0.5
MATCH = "struct<ord:int,similarity:double>"


def _unranked(best: Column) -> Column:
    return F.struct((-best["rank"]).cast("int").alias("ord"), best["similarity"].alias("similarity"))


def _best(scores: list[tuple[int, Column]]) -> Column:
    ranked = F.array(*[F.struct(sim.alias("similarity"), F.lit(-ord_).alias("rank")) for ord_, sim in scores])
    return let(F.array_max(ranked), _unranked)


def no_match() -> Column:
    return F.lit(None).cast(MATCH)


# --- lexical ------------------------------------------------------------------

def label_words(labels: DataFrame) -> list[tuple[int, list[str]]]:
    """The distinct words of each label, in tie-break order."""
    rows = collect_labels(labels.select("ord", F.array_distinct(words(F.col("embed_text"))).alias("tokens")))
    return [(row["ord"], row["tokens"]) for row in rows]


def importance(sets: list[tuple[int, list[str]]]) -> dict[str, int]:
    """Whole-number weight of each label word: the fewer labels have it, the more it tells."""
    holders = Counter(token for _, tokens in sets for token in tokens)
    return {token: max(1, round(10 * math.log((1 + len(sets)) / n))) for token, n in holders.items()}


def constant(value, schema: str) -> Column:
    """A nested literal; the optimizer folds it before execution."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def lexical_match(text: Column, labels: DataFrame) -> Column:
    """Cosine of word sets weighed by ``importance``; words that no label has do not count."""
    sets = label_words(labels)
    if not sets:
        return no_match()
    weight, holders = importance(sets), defaultdict(list)
    for ord_, tokens in sets:
        norm = sum(weight[t] ** 2 for t in tokens)
        for token in tokens:
            holders[token].append({"ord": ord_, "w": weight[token] ** 2, "norm": norm})
    known = constant(holders, "map<string, array<struct<ord int, w bigint, norm bigint>>>")
    zero = F.lit(0).cast("long")

    def scored(n, acc):
        similarity = acc["dot"] / F.sqrt((n * acc["norm"]).cast("double"))
        return F.when(acc["ord"].isNotNull(), F.struct(similarity.alias("similarity"), (-acc["ord"]).alias("rank")))

    def compare(hits):
        """The hits in order of labels, summed label by label; any number of labels costs one pass."""
        n = F.aggregate(hits, zero, lambda total, h: total + h[0]["w"])

        def best_of(parts):
            def add(acc, h):
                same = acc["ord"] == h["ord"]
                best = F.when(same, acc["best"]).otherwise(F.greatest(acc["best"], scored(parts["n"], acc)))
                return F.struct(h["ord"].alias("ord"), (F.when(same, acc["dot"]).otherwise(zero) + h["w"]).alias("dot"),
                                h["norm"].alias("norm"), best.alias("best"))
            start = F.struct(F.lit(None).cast("int").alias("ord"), zero.alias("dot"), zero.alias("norm"),
                             F.lit(None).cast("struct<similarity:double,rank:int>").alias("best"))
            return F.aggregate(parts["flat"], start, add,
                               lambda acc: F.greatest(acc["best"], scored(parts["n"], acc)))
        best = let(F.struct(n.alias("n"), F.sort_array(F.flatten(hits)).alias("flat")), lambda parts: let(best_of(parts), _unranked))
        nothing = F.struct(F.lit(sets[0][0]).alias("ord"), F.lit(0.0).alias("similarity"))
        return F.when(F.size(hits) == 0, nothing).otherwise(best)

    def looked_up(tokens):
        return F.transform(F.array_intersect(tokens, F.map_keys(known)), lambda t: F.element_at(known, t))
    return let(looked_up(F.array_distinct(words(text))), compare)


def term_weights(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Long form ``(key, token, weight)`` with the word counts as weights."""
    return (rows.select(key, F.explode(words(F.col(text))).alias("token"))
            .groupBy(key, "token").agg(F.count("*").alias("weight")))


def _square_norm(tokens: Column) -> Column:
    """Sum of the squared counts of the words of one row, along the sorted words."""
    def add(acc, token):
        run = F.when(token == acc["last"], acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(token.alias("last"), run.alias("run"), (acc["total"] + 2 * run - 1).alias("total"))
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("last"), zero.alias("run"), zero.alias("total"))
    return F.aggregate(F.sort_array(tokens), start, add, lambda acc: acc["total"])


def nearest_label_sparse(docs: DataFrame, key: str, text: str, label_terms: DataFrame) -> DataFrame:
    """``key`` and ``match``, the nearest label by word counts, for label sets of any size.

    ``docs`` has one row per ``key``; ``label_terms`` is ``(ord, token, weight)``.
    A document's norm is computed in its row; only words that a label has get
    any further, to one sum per document and label, combined before the shuffle.
    Documents that share no word with a label get the first label with
    similarity 0. Spark broadcasts the label side when it is small.
    """
    w = F.col("weight")
    norm = F.sum(w * w).over(Window.partitionBy("ord")).cast("long")
    by_token = (label_terms.select("token", F.struct("ord", w.alias("weight"), norm.alias("label_norm")).alias("label"))
                .groupBy("token").agg(F.collect_list("label").alias("labels")))
    own = F.coalesce(words(F.col(text)), F.array().cast("array<string>"))

    def with_norm(tokens):
        # The null stands for the document itself, which so stays without any join back.
        marked = F.concat(tokens, F.array(F.lit(None).cast("string")))
        return let(_square_norm(tokens), lambda norm: F.transform(marked, lambda t: F.struct(t.alias("token"), norm.alias("norm"))))
    # All inside the generator: what stands beside it would be computed for every word.
    terms = (docs.select(key, F.inline(let(own, with_norm)))
             .join(by_token, "token", "left").where("labels IS NOT NULL OR token IS NULL"))
    none = F.array(F.struct(*(F.lit(None).cast(t).alias(c) for c, t in (
        ("ord", label_terms.schema["ord"].dataType), ("weight", label_terms.schema["weight"].dataType), ("label_norm", "long")))))
    dots = (terms.select(key, "norm", F.inline(F.coalesce("labels", none)))
            .groupBy(key, "ord").agg(F.sum("weight").alias("dot"), F.max("norm").alias("norm"), F.max("label_norm").alias("label_norm")))
    similarity = F.col("dot") / F.sqrt((F.col("norm") * F.col("label_norm")).cast("double"))
    best = F.max(F.when(F.col("ord").isNotNull(), F.struct(similarity.alias("similarity"), (-F.col("ord")).alias("rank"))))
    first = label_terms.agg(F.min("ord")).first()[0]
    nothing = F.lit(None) if first is None else F.struct(F.lit(first).cast("int").alias("ord"), F.lit(0.0).alias("similarity"))
    return (dots.groupBy(key).agg(best.alias("best"))
            .select(key, F.when(F.col("best").isNotNull(), _unranked(F.col("best"))).otherwise(nothing).alias("match")))


# --- dense --------------------------------------------------------------------

def dense_match(vector: Column, labels: DataFrame) -> Column:
    """One matrix product per Arrow batch against all label vectors."""
    rows = collect_labels(labels.select("ord", "vector"))
    if not rows:
        return no_match()
    # An identical later label can never win.
    firsts = {}
    for row in rows:
        firsts.setdefault(tuple(row["vector"] or ()), row["ord"])
    label_ords = np.array(list(firsts.values()), dtype=np.int32)
    by_width = defaultdict(list)
    for column, values in enumerate(firsts):
        by_width[len(values)].append((column, values))
    packed = {width: ([c for c, _ in members], np.array([v for _, v in members], dtype=np.float64))
              for width, members in by_width.items() if width}

    @F.arrow_udf(MATCH)
    def nearest(vectors: pa.Array) -> pa.Array:
        # A label of another width, or a zero vector, has similarity 0.
        sims = np.zeros((len(vectors), len(label_ords)))
        for width, (columns, matrix) in packed.items():
            values, at = to_matrix(vectors, width)
            norms = np.sqrt((values * values).sum(axis=1))[:, None] * np.sqrt((matrix * matrix).sum(axis=1))[None, :]
            sims[np.ix_(at, columns)] = np.divide(values @ matrix.T, norms, out=np.zeros_like(norms), where=norms > 0)
        pick = sims.argmax(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(label_ords[pick]), pa.array(sims[np.arange(len(pick)), pick])], ["ord", "similarity"])

    return nearest(vector)


def dense_match_native(vector: Column, labels: DataFrame) -> Column:
    """The same as one JVM expression per label; slower, used to check the batch form."""
    rows = collect_labels(labels.select("ord", "vector"))
    if not rows:
        return no_match()
    scores = [(r["ord"], cosine(vector, F.array(*[F.lit(float(x)).cast("float") for x in r["vector"] or ()])))
              for r in rows]
    return _best(scores)


# --- embedders ----------------------------------------------------------------

class LexicalEmbedder:
    """Bag of words; deterministic and entirely inside the JVM."""

    #: Least similarity that labels a row; nearly all of the labelled lines in the tests reach it.
    threshold = 0.2

    def match(self, text: Column, labels: DataFrame) -> tuple[Column, Column]:
        return lexical_match(text, labels), F.lit(None).cast("string")


class ModelEmbedder:
    """A user model, loaded in the Python workers by ``load``."""

    threshold = MODEL_THRESHOLD

    def __init__(self, load: Callable[[], Model]):
        self.load = load

    def match(self, text: Column, labels: DataFrame) -> tuple[Column, Column]:
        embedded = embed_text(text, self.load)
        return dense_match(embedded["vector"], embed_labels(labels, self.load)), embedded["error"]


class TransformerEmbedder:
    """WordPiece ids in the JVM and Arrow, a user's network in the workers, pooling and projection around it."""

    threshold = MODEL_THRESHOLD

    def __init__(self, vocab, load: Callable[[], Callable], weights: np.ndarray | None = None, max_tokens: int = MAX_TOKENS):
        self.vocab, self.load, self.weights, self.max_tokens = vocab, load, weights, max_tokens

    def encode(self, text: Column) -> Column:
        ids = word_piece_ids(text, self.vocab, self.max_tokens)["ids"]
        return encode_ids(F.when(text.isNotNull(), ids), self.load, self.weights)

    def match(self, text: Column, labels: DataFrame) -> tuple[Column, Column]:
        embedded = self.encode(text)
        return (dense_match(embedded["vector"], with_vectors(labels, self.encode(F.col("embed_text")))),
                embedded["error"])


# --- result columns -----------------------------------------------------------

def path_type(path: Column) -> Column:
    return F.substring_index(path, ".", 1)


def path_category(path: Column) -> Column:
    return F.regexp_replace(path, r"^[^.]*\.?", "")


def resolve(match: Column, labels: DataFrame, threshold: float) -> Column:
    """``struct<path, severity, confidence>`` of a match; below the threshold only the score stays."""
    rows = collect_labels(labels.select("ord", "path", "severity"))
    if not rows:
        return F.struct(F.lit(UNCLASSIFIED).alias("path"), F.lit("warning").alias("severity"),
                        F.lit(0.0).alias("confidence"))
    known = constant({row["ord"]: {"path": row["path"], "severity": row["severity"]} for row in rows},
                     "map<string, struct<path string, severity string>>")
    label = F.element_at(known, match["ord"].cast("string"))
    path, severity = label["path"], label["severity"]
    hit = match["similarity"] >= threshold
    return F.struct(F.when(hit, path).otherwise(F.lit(UNCLASSIFIED)).alias("path"),
                    F.when(hit, severity).otherwise(F.lit("warning")).alias("severity"),
                    match["similarity"].alias("confidence"))
