"""Benchmark items inside documents (operator 3), with DataFrame functions only.

A document's item-sized windows get a SimHash; the items' SimHashes lie in a
multi-index over blocks of bits that finds every item within ``RADIUS`` bits of a
window; the exact weighted-shingle similarity then decides.

A window without any shingle in common with an item has similarity 0 with it, so
windows are laid only where a document's shingle is some item's: with the item's
length and start, counted from that shingle. The work per word is one hash.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxalog.storage import stored

WIDTH = 5
SIMILARITY = 0.8
#: Similarity 0.8 of windows of one size means 10 of 64 bits on average, 3 as deviation.
RADIUS = 23
BLOCKS = 8
#: Rows of item shingles that are broadcast at once; more are joined in that many blocks.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Runs of letters, marks and digits, lower-cased; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def shingle_at(words: Column, at: Column) -> Column:
    """Hash of the ``WIDTH`` words from ``at`` on; past the end there are nulls, which a hash leaves out."""
    return F.xxhash64(*(F.get(words, at + k) for k in range(WIDTH)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often and deep in lambdas ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def weighted(hashes: Column) -> Column:
    """A multiset of hashes as a set: each occurrence becomes an element of its own."""
    def numbered(ordered):
        return F.transform(ordered, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(ordered, h).cast("int")))
    return bound(F.sort_array(hashes), numbered)


def simhash(features: Column) -> Column:
    """64-bit SimHash of an array of longs: a bit is set where over half of them have it."""
    def with_bit(acc, k):
        ones = F.aggregate(features, F.lit(0), lambda n, h: n + F.getbit(h, k).cast("int"))
        return acc.bitwiseOR(F.call_function("shiftleft", (ones * 2 > F.size(features)).cast("long"), k))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), with_bit)


def block_of(fp: Column, block: int) -> Column:
    low, high = 64 * block // BLOCKS, 64 * (block + 1) // BLOCKS
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))


def block_keys(fp: Column, flips: int) -> Column:
    """(block, value) of each block of ``fp``, and of all values that differ from it in at most ``flips`` bits."""
    keys = []
    for block in range(BLOCKS):
        bits = range(64 * (block + 1) // BLOCKS - 64 * block // BLOCKS)
        masks = [sum(1 << b for b in chosen) for k in range(flips + 1) for chosen in itertools.combinations(bits, k)]
        keys += [F.struct(F.lit(block).alias("block"), block_of(fp, block).bitwiseXOR(F.lit(m).cast("long")).alias("value")) for m in masks]
    return F.array(*keys)


def named(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``own``, ``text``. Rows without doc_id are told apart by ``own``, a hash of their text; else it is null."""
    return docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("own"), "text")


def same_document() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("own").eqNullSafe(F.col("_own"))


def doc_shingles(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``own``, ``at``, ``h``: every shingle of every whole text, hashed in the scan's stage."""
    n = F.size("words")
    last = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - WIDTH, F.lit(0))))
    # The outer form keeps the optimizer from adding a filter that would split the text twice.
    return (docs.select("doc_id", "own", words_of(F.col("text")).alias("words"))
            .select("doc_id", "own", "words", F.explode_outer(last).alias("at"))
            .where("at IS NOT NULL").select("doc_id", "own", "at", shingle_at(F.col("words"), F.col("at")).alias("h")))


def items_of(benchmark: DataFrame) -> DataFrame:
    """``item_id``, ``n`` words, ``hashes`` of the shingles in order; items without a word are left out."""
    def hashed(words):
        positions = F.sequence(F.lit(0), F.greatest(F.size(words) - WIDTH, F.lit(0)))
        return F.struct(F.size(words).alias("n"), F.transform(positions, lambda i: shingle_at(words, i)).alias("hashes"))
    return (benchmark.select("item_id", bound(words_of(F.col("text")), hashed).alias("item"))
            .select("item_id", "item.n", "item.hashes").where("n > 0"))


def item_windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id``, ``own``, ``features``: the item-sized windows of ``named`` documents, each document's ones once.

    ``features``: the window's shingles as a set of longs, see ``weighted``.
    """
    seeds = stored(items.select(F.posexplode("hashes").alias("j", "h"), "n").distinct(), "seeds")
    parts = max(1, math.ceil(seeds.count() / BROADCAST_ROWS))
    shingles, found = doc_shingles(docs), None
    for part in range(parts):
        own = seeds.where(F.pmod(F.col("h"), F.lit(parts)) == part)
        hit = shingles.join(F.broadcast(own), "h").select("doc_id", "own", (F.col("at") - F.col("j")).alias("start"), "n")
        found = hit if found is None else found.unionByName(hit)
    spans = (found.groupBy(F.col("doc_id").alias("_id"), F.col("own").alias("_own")).agg(F.collect_set(F.struct("start", "n")).alias("spans")))

    def features(words, span):
        first = F.greatest(span["start"], F.lit(0))
        end = F.least(span["start"] + span["n"], F.size(words))
        return weighted(F.transform(F.sequence(first, F.greatest(end - WIDTH, first)), lambda i: shingle_at(words, i)))

    def windows(words):
        return F.array_distinct(F.transform("spans", lambda span: features(words, span)))

    return (docs.join(spans, same_document())
            .select("doc_id", "own", F.explode(bound(words_of(F.col("text")), windows)).alias("features")))


def found_items(docs: DataFrame, benchmark: DataFrame, similarity: float) -> DataFrame:
    """``doc_id``, ``own``, ``item_id``, ``similarity`` of every window of ``named`` documents that is an item.

    Equal windows are one row until the last join, so a passage that a third of
    the documents holds is looked up and compared once.
    """
    items = items_of(benchmark)
    windows = stored(item_windows(docs, items), "windows")
    prints = stored(windows.select("features").distinct().withColumn("fp", simhash(F.col("features"))), "window-prints")
    index = stored(items.select("item_id", bound(weighted(F.col("hashes")), lambda x: F.struct(
        x.alias("item"), simhash(x).alias("item_fp"))).alias("x")).select("item_id", "x.*"), "item-prints")
    index = index.withColumn("key", F.explode(block_keys(F.col("item_fp"), RADIUS // BLOCKS)))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    pairs = (prints.withColumn("key", F.explode(block_keys(F.col("fp"), 0))).join(index, "key").where(near)
             .select("features", "item_id", "item").distinct())

    def jaccard(common):
        return common / (F.size("features") + F.size("item") - common)
    pairs = (pairs.withColumn("similarity", bound(F.size(F.array_intersect("features", "item")), jaccard))
             .where(F.col("similarity") >= similarity).select("features", "item_id", "similarity"))
    return windows.join(pairs, "features").drop("features")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity`` (double): every item that a document holds.

    The similarity is the best weighted Jaccard of word shingles between the item
    and an item-sized window, at least ``similarity``. Case and punctuation do not
    count. Items of fewer than five words match texts of just these words. Null,
    blank or wordless texts and items match nothing; repeated rows of a doc_id
    count as one; a null doc_id is reported as null, its row for itself by ``clean``.
    Other columns are ignored.
    """
    return (found_items(named(docs), benchmark, similarity).groupBy("doc_id", "item_id")
            .agg(F.max("similarity").alias("similarity")))


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no item, with the columns of ``docs``. Rows without doc_id are judged one by one."""
    found = found_items(named(docs), benchmark, similarity).select(F.col("doc_id").alias("_id"), F.col("own").alias("_own")).distinct()
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & own.eqNullSafe(F.col("_own")), "left_anti")
