"""Removal of lines that many documents share (operator 7).

Lines are normalised, hashed to 128 bits and counted by distinct document; lines
over the threshold go, everywhere but in the largest doc_id that holds them, and
the other lines are put together again in their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalog.storage import stored

MIN_CHARS = 40
MIN_DOCS = 5
SLICE = 256


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped, A-Z lower-cased line; None if it is under ``min_chars`` code points."""
    key = line.strip().lower()  # on bytes both know ASCII only
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id``, ``own``, ``key`` (binary): each long line of a text once.

    ``own`` tells rows without doc_id apart, by a hash of the text; else it is null.
    """
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, owns, keys = [], [], []
                for doc_id, own_id, text in zip(*(c.to_pylist() for c in part.columns)):
                    own = {line_key(line, min_chars) for line in (text or b"").split(b"\n")} - {None}
                    ids += [doc_id] * len(own)
                    owns += [own_id] * len(own)
                    keys += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(owns, pa.int64()), pa.array(keys, pa.binary())],
                                                 names=["doc_id", "own", "key"])

    return (docs.select(F.col("doc_id").cast("long"), own_of().alias("own"), F.col("text").cast("binary"))
            .mapInArrow(split, "doc_id long, own long, key binary"))


def own_of():
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def shared_lines(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``key``, ``keeper``: lines in at least ``min_docs`` distinct doc_ids, and the largest of those.

    Keys are combined within tasks before each of the two shuffles, so a line
    that a third of the documents holds is no hot key.
    """
    return (keys.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
            .where(F.col("n") >= min_docs).select("key", "keeper"))


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` without shared lines: ``text`` replaced, ``n_lines`` and ``n_dropped`` added.

    Null or empty texts are one empty line and come out as "". A document whose
    lines all go keeps an empty text. Repeated rows of a doc_id are one document
    when counting, and lose the same lines. A null doc_id counts for no line, and
    each row with it loses its shared lines for itself. Existing columns
    ``n_lines`` and ``n_dropped`` are replaced, others pass through.

    The keys (24 bytes a long line) are written once and read for the count and
    for the list of each document's lost lines; the texts are shuffled once.
    """
    keys = stored(line_keys(docs, min_chars), "line-keys")
    # A table of its own: broadcast while small, else joined over exchanges that adaptive execution can split.
    shared = stored(shared_lines(keys, min_docs), "shared-lines")
    lost = (keys.join(shared, "key").where("NOT doc_id <=> keeper")
            .groupBy(F.col("doc_id").alias("_lost_id"), F.col("own").alias("_lost_own")).agg(F.collect_set("key").alias("_lost")))

    @F.arrow_udf("text string, n_lines long, n_dropped long")
    def reassemble(texts: pa.Array, lost: pa.Array) -> pa.Array:
        kept, total, dropped = [], [], []
        for text, gone in zip(texts, lost):
            lines, gone = (text.as_py() or b"").split(b"\n"), set(gone.as_py() or ())
            rest = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
            kept.append(b"\n".join(rest).decode("utf-8", "replace"))
            total.append(len(lines))
            dropped.append(len(lines) - len(rest))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())],
                                          names=["text", "n_lines", "n_dropped"])

    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*names).join(
        lost, F.col("doc_id").eqNullSafe(F.col("_lost_id")) & own_of().eqNullSafe(F.col("_lost_own")), "left")
    rows = rows.withColumn("_new", reassemble(F.col("text").cast("binary"), "_lost"))
    return rows.select(*(F.col("_new.text").alias("text") if c == "text" else c for c in names),
                       "_new.n_lines", "_new.n_dropped")
