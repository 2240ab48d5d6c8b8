"""Turning text into vectors with a user model, and the WordPiece job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxalog.functions.text import basic_tokens, is_blank
from taxalog.storage import stored

BATCH = 128          # texts per model call
MAX_TOKENS = 128     # with the two markers
MAX_TOKEN_LENGTH = 200
MAX_VOCAB = 1_000_000
SALT_ROWS = 100_000  # rows of one text that meet in one task


class Model(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray:
        """One row of float32 per text."""


def _embed_batch(model: Model, texts: list) -> list[tuple]:
    """Vectors, or for a failing batch one call per text so one bad row stays alone."""
    try:
        return [(v, None) for v in np.asarray(model.embed(texts), dtype=np.float32)]
    except Exception as failure:
        if len(texts) == 1:
            return [(None, f"{type(failure).__name__}: {failure}")]
        return [_embed_batch(model, [t])[0] for t in texts]


def embed_text(text: Column, load: Callable[[], Model]) -> Column:
    """``struct<vector array<float>, error string>`` per row.

    ``load`` runs once per task. Blank rows never reach the model, and copies
    within an Arrow batch are embedded once.
    """
    @F.pandas_udf("vector array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = None
        for texts in batches:
            # Similar lengths together keep the padding short.
            wanted = sorted(texts.dropna().unique(), key=len)
            if wanted and model is None:
                model = load()
            done = {}
            for start in range(0, len(wanted), BATCH):
                chunk = wanted[start:start + BATCH]
                done.update(zip(chunk, _embed_batch(model, chunk)))
            pairs = [(None, None) if t is None else done[t] for t in texts]
            yield pd.DataFrame({"vector": [p[0] for p in pairs], "error": [p[1] for p in pairs]})

    return run(F.when(~is_blank(text), text))


def embed_labels(labels: DataFrame, load: Callable[[], Model]) -> DataFrame:
    return with_vectors(labels, embed_text(F.col("embed_text"), load))


def with_vectors(labels: DataFrame, embedded: Column) -> DataFrame:
    """Label vectors, computed by one task; a failure here fails the run instead of a row."""
    checked = F.when(F.col("r.error").isNull(), F.col("r.vector")).otherwise(
        F.raise_error(F.concat(F.lit("embedding of label "), F.col("path"), F.lit(" failed: "), F.col("r.error"))))
    return labels.coalesce(1).withColumn("r", embedded).withColumn("vector", checked).drop("r")


def embed_once(rows: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], seq: str = "seq",
               salt_rows: int = SALT_ROWS) -> DataFrame:
    """Run ``compute`` on each distinct ``key`` and join the result back.

    Worth its shuffles only for a model that costs more than moving a row. Rows
    and results meet by a 128-bit hash of the text, so a text travels to its
    result once. A text with more than ``salt_rows`` rows is cut into parts of
    about that size, and its single result row is repeated for each part. How
    many texts are cut is no parameter; their table is stored, so that Spark knows
    its size when it picks the join.
    """
    digest = F.unhex(F.md5(F.col(key)))
    copies = stored(rows.groupBy(key).agg(F.count("*").alias("_n")), "copies")
    hot = stored(copies.filter(F.col("_n") > salt_rows)
                 .select(digest.alias("_text"), F.ceil(F.col("_n") / salt_rows).cast("int").alias("_salts")), "hot-texts")
    part = F.pmod(F.xxhash64(seq), F.col("_salts")).cast("int")
    salted = (rows.withColumn("_text", digest).join(hot, "_text", "left")
              .withColumn("_salt", F.coalesce(part, F.lit(0))).drop("_salts"))
    parts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    results = (compute(copies.select(key)).withColumn("_text", digest).drop(key).join(hot, "_text", "left")
               .withColumn("_salt", F.explode(parts)).drop("_salts"))
    return salted.join(results, ["_text", "_salt"], "left").drop("_text", "_salt")


# --- WordPiece ----------------------------------------------------------------

def load_vocab(path: str) -> dict[str, int]:
    """Token to line number of a vocabulary file, one token per line."""
    with open(path, encoding="utf-8") as lines:
        return check_vocab({line.rstrip("\r\n"): i for i, line in enumerate(lines)})


def collect_vocab(vocab: DataFrame) -> dict[str, int]:
    """A ``(token, id)`` table on the driver, with the size checked."""
    found = vocab.select("token", "id").limit(MAX_VOCAB + 1).collect()
    if len(found) > MAX_VOCAB:
        raise ValueError(f"vocabulary has more than {MAX_VOCAB} tokens")
    return check_vocab({row["token"]: row["id"] for row in found})


def check_vocab(vocab: dict[str, int]) -> dict[str, int]:
    missing = [t for t in ("[PAD]", "[UNK]", "[CLS]", "[SEP]") if t not in vocab]
    if missing:
        raise ValueError(f"vocabulary lacks {', '.join(missing)}")
    return vocab


def word_pieces(token: str, vocab: dict[str, int]) -> list[int]:
    """Longest-match pieces of one token, or a single unknown."""
    ids, start = [], 0
    while start < len(token) <= MAX_TOKEN_LENGTH:
        mark = "##" if start else ""
        end = next((e for e in range(len(token), start, -1) if mark + token[start:e] in vocab), None)
        if end is None:
            break
        ids.append(vocab[mark + token[start:end]])
        start = end
    return ids if start >= len(token) else [vocab["[UNK]"]]


def word_piece_ids(text: Column, vocab, max_tokens: int = MAX_TOKENS) -> Column:
    """``struct<ids, n_tokens, n_unk, truncated>``; ``vocab`` is a dict or a broadcast of one."""
    @F.arrow_udf("struct<ids:array<bigint>,n_tokens:int,n_unk:int,truncated:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = vocab if isinstance(vocab, dict) else vocab.value
        for tokens in batches:
            yield _piece_batch(tokens, known, max_tokens)

    return run(basic_tokens(text))


def _running(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _piece_batch(tokens: pa.Array, vocab: dict[str, int], max_tokens: int) -> pa.Array:
    """Pieces of each distinct token once; everything per row is array arithmetic."""
    coded = tokens.flatten().dictionary_encode()
    pieces = [word_pieces(t, vocab) for t in coded.dictionary.to_pylist()]
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    table = np.array([i for p in pieces for i in p], dtype=np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False)

    # All ids of the batch in order: piece start of each token plus position in it.
    at = _running(sizes[codes]) if len(codes) else np.zeros(1, dtype=np.int64)
    steps = np.repeat(_running(sizes)[:-1][codes] - at[:-1], sizes[codes]) if len(codes) else np.zeros(0, dtype=np.int64)
    ids = table[steps + np.arange(at[-1])]

    row_start = at[_running(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    totals = np.diff(row_start)
    kept = np.minimum(totals, max_tokens - 2)
    inside = np.arange(len(ids)) - np.repeat(row_start[:-1], totals)
    ids = ids[inside < max_tokens - 2]

    offsets = _running(kept + 2)
    out = np.empty(offsets[-1], dtype=np.int64)
    body = np.ones(len(out), dtype=bool)
    body[offsets[:-1]] = body[offsets[1:] - 1] = False
    out[offsets[:-1]], out[offsets[1:] - 1], out[body] = vocab["[CLS]"], vocab["[SEP]"], ids
    unknown = _running(out == vocab["[UNK]"])
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out)), pa.array(kept + 2, pa.int32()),
         pa.array(unknown[offsets[1:]] - unknown[offsets[:-1]], pa.int32()), pa.array(totals > kept)],
        ["ids", "n_tokens", "n_unk", "truncated"])


def pad_ids(ids: list[list[int]], pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask padded to the longest row of the batch."""
    lengths = np.array([len(row) for row in ids])
    mask = np.arange(lengths.max(initial=0)) < lengths[:, None]
    padded = np.full(mask.shape, pad, dtype=np.int64)
    padded[mask] = np.concatenate([np.asarray(row, dtype=np.int64) for row in ids]) if len(ids) else []
    return padded, mask.astype(np.int64)


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the unmasked positions of ``[rows, positions, dim]``."""
    used = (mask == 1)[:, :, None]
    return (hidden * used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)


def token_report(ids: DataFrame, key: str = "source") -> DataFrame:
    """Tokens, unknowns and truncations per source."""
    return ids.groupBy(key).agg(
        F.count("*").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_unk").alias("n_unk"),
        F.count_if("truncated").alias("n_truncated"))


def encode_ids(ids: Column, load: Callable[[], Callable], weights: np.ndarray | None = None) -> Column:
    """Token ids through a model to one vector: infer, mean-pool, project.

    ``load`` runs once per task and gives ``infer(ids, mask) -> [rows, positions,
    dim]``; both arguments are padded to the longest row of the call.
    """
    def vectors(infer, rows: list[np.ndarray]) -> np.ndarray:
        padded, mask = pad_ids(rows)
        pooled = mean_pool(np.asarray(infer(padded, mask), dtype=np.float32), mask)
        return pooled if weights is None else pooled @ np.asarray(weights, dtype=np.float32).T

    class Encoder:
        def __init__(self):
            self.infer = load()

        def embed(self, rows):
            return vectors(self.infer, rows)

    @F.pandas_udf("vector array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = None
        for rows in batches:
            lengths = rows.map(lambda r: 0 if r is None else len(r))
            order = [i for i in np.argsort(lengths, kind="stable") if lengths.iloc[i]]
            if order and encoder is None:
                encoder = Encoder()
            pairs = [(None, None)] * len(rows)
            for start in range(0, len(order), BATCH):
                chunk = order[start:start + BATCH]
                for i, pair in zip(chunk, _embed_batch(encoder, [rows.iloc[i] for i in chunk])):
                    pairs[i] = pair
            yield pd.DataFrame({"vector": [p[0] for p in pairs], "error": [p[1] for p in pairs]})

    return run(ids)
