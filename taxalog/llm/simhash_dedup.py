"""Near-duplicate documents by SimHash fingerprints (operator 10).

Fingerprints are split into blocks. Two of them that differ in at most
``radius`` bits agree in all but ``radius`` blocks, so with ``radius + agree``
blocks they agree in ``agree`` of them: every choice of ``agree`` blocks is one
join key, pairs that meet under a key are verified, and no close pair is missed.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxalog.llm.columns import free
from taxalog.llm.graph import components, forest
from taxalog.llm.words import fingerprint
from taxalog.storage import stored

WIDTH = 4
RADIUS = 4
PIECE = 4096
FLUSH = 1 << 20


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with ``fp`` (long, the 64 bits as they are). Null and blank texts: zero."""
    @F.pandas_udf("long")
    def simhash(texts):
        return texts.map(lambda x: fingerprint(x, width)).astype("uint64").astype("int64")

    return docs.withColumn("fp", simhash(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def block_count(radius: int, rows: int) -> int:
    """Blocks so that a key has about as many bits as the rows need for short runs.

    More blocks make longer keys and more of them; any number gives the same links.
    Keys of 20 bits, two blocks, are the least, and do up to some 17 million rows.
    """
    wanted = max(20.0, math.log2(max(rows, 1)) - 4)
    agree = 1
    while agree < 6 and 64 * agree / (radius + agree) < wanted:
        agree += 1
    return radius + agree


def block_masks(radius: int, blocks: int) -> list[int]:
    """One mask of fingerprint bits for each choice of ``blocks - radius`` blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in itertools.combinations(bits, blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(key: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the pairs with equal ``key`` (sorted) whose fingerprints differ in ``radius`` bits at most."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held, at, step = 0, np.arange(len(key)), 0
    while True:
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= radius]
        if len(near):
            found.append((node[near], node[near + step]))
            held += len(near)
        if held > FLUSH:
            found = [forest(*map(np.concatenate, zip(*found)))]
            held = len(found[0][0])
    return forest(*map(np.concatenate, zip(*found))) if found else (node[:0], node[:0])


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Links (a, b) that connect what fingerprints within ``radius`` bits connect.

    ``prints``: ``fp``, ``node`` (long), each fp once. Rows that meet under a key
    are compared within tasks and leave as a spanning forest, never as all pairs.
    A key with more than ``PIECE`` rows is cut into pieces by hash, and each pair
    of pieces is a run of its own, so that it spreads over many tasks.
    """
    spark = prints.sparkSession
    masks = block_masks(radius, blocks or block_count(radius, prints.count()))
    table = F.array(*(F.struct(F.lit(k).alias("t"), F.lit(signed(m)).alias("mask")) for k, m in enumerate(masks)))
    rows = (prints.select("fp", "node", F.explode(table).alias("m"))
            .select("fp", "node", F.xxhash64("m.t", F.col("fp").bitwiseAND(F.col("m.mask"))).alias("key")))
    large = stored(rows.groupBy("key").count().where(F.col("count") > PIECE)
                   .select("key", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces")), "large-keys")
    # Mostly empty, so its files let Spark broadcast it; else a skewed key stays on the side of the rows.
    rows = rows.join(large, "key", "left")
    piece = F.pmod(F.xxhash64(F.lit("piece"), "fp"), F.col("pieces")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1),
                         lambda j: F.least(j, piece) * F.col("pieces") + F.greatest(j, piece))
    rows = rows.select(
        "fp", "node", F.explode(F.when(F.col("pieces").isNull(), F.array("key"))
                                .otherwise(F.transform(others, lambda x: F.xxhash64(F.lit("run"), "key", x)))).alias("run"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3
        for batch in batches:
            cols = [np.concatenate([r, batch.column(k).to_numpy()]) for k, r in enumerate(rest)]
            cut = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0  # the last run may go on
            yield links_of(*(c[:cut] for c in cols))
            rest = [c[cut:] for c in cols]
        yield links_of(*rest)

    def links_of(run, fp, node):
        a, b = close_pairs(run, fp.view(np.uint64), node, radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return (rows.select("run", "fp", "node").repartition(n, "run").sortWithinPartitions("run")
            .mapInArrow(compare, "a long, b long"))


def assign_components(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp``, ``component_id``.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``radius`` differing bits, itself included. Equal fingerprints are one node,
    so groups of exact copies never meet as pairs. Null or blank texts have the
    fingerprint zero, which links like any other; a null doc_id gets the
    component of its fingerprint and names none (null if nothing else is there).
    Repeated rows stay. Other columns are ignored.
    """
    prints = stored(fingerprints(docs.select("doc_id", "text"), width).select("doc_id", "fp"), "fingerprints")
    named = print_components(prints, radius)
    # A node without any doc_id is no name for others: the smallest real one is.
    real = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(real, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def print_components(prints: DataFrame, radius: int) -> DataFrame:
    """``fp``, ``first`` (smallest doc_id with it), ``component`` of each fingerprint of ``prints`` (doc_id, fp)."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
                   .withColumn("node", F.coalesce("first", F.xxhash64("fp"))), "nodes")
    found = components(near_links(nodes.select("fp", "node"), radius))
    return nodes.join(found, "node", "left").select("fp", "first", F.coalesce("component", "node").alias("component"))


def keep_first(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that of the smallest doc_id, then of the smallest hash of its text.

    Rows without doc_id belong to components like others and stay only where
    theirs has no doc_id. Rows with one doc_id are one document, of which one row
    stays. Whole rows are shuffled once, to meet the chosen keys.
    """
    d, o, row, own = free(docs, "_d", "_o", "_row", "_own")
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    prints = stored(fingerprints(docs.select("doc_id", "text", text_hash.alias("own")), width).select("doc_id", "own", "fp"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "own")).alias("best")
    chosen = (prints.join(print_components(prints, radius).select("fp", "component"), "fp")
              .groupBy("component").agg(first).select(F.col("best.doc_id").alias(d), F.col("best.own").alias(o)))
    rows = docs.withColumn(own, text_hash)
    kept = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(own) == F.col(o)), "left_semi")
    order = Window.partitionBy("doc_id", own).orderBy("text")
    return kept.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).select(*docs.columns)
