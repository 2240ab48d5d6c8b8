"""How document filters interact, over a sparse document-term matrix (operator 13).

Texts are read once into CSR shards with a dictionary of their own each. The words
of all shards get global numbers, every shard's columns are renumbered,
and row sums and nonzero counts of the matrix decide the two filters on words. The
flags of the others travel with the rows. What remains of a document is one of 32
sets of failed filters, so the audit of all orders works on their counts.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxalog.storage import stored

FILTERS = "ABCDE"
MIN_WORDS = 100
#: Percent: of distinct words at least, of capitals at most.
MIN_DISTINCT, MAX_CAPITALS = 80, 10
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHARD_ROWS, SHARD_BYTES = 8192, 16 << 20
#: A shard is stored in pieces of about 1 MiB, few of them to a row group: Spark reads all rows of a group at once.
BLOCK_CELLS, BLOCK_WORDS, GROUP_ROWS = 1 << 17, 1 << 16, 16
FLUSH = 1 << 20

_BLOCK = ("shard long, block int, doc_id array<long>, part array<string>, flags array<int>, digest array<binary>, "
          "starts array<long>, columns array<int>, counts array<int>")
_SHARD = f"{_BLOCK}, first int, words array<binary>"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def text_flags(text: bytes) -> int:
    """Bits 2 (too many capitals) and 3 (a symbol) of a text."""
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text) if text.isascii() else int((np.frombuffer(text, np.int8) >= -64).sum())  # without continuation bytes
    return (100 * capitals > MAX_CAPITALS * points) << 2 | any(s in text for s in SYMBOLS) << 3


def one_row(**values) -> pa.RecordBatch:
    """A row of ``_SHARD``; columns without a value are null."""
    fields = dict(f.split() for f in _SHARD.split(", "))
    kinds = {n: pa.list_(_TYPES[k[6:-1]]) if k.startswith("array") else _TYPES[k] for n, k in fields.items()}
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], kind) for n, kind in kinds.items()], names=list(kinds))


class Shard:
    """Rows of the matrix, their words numbered as they come; ``take`` hands out the rows since the last one."""

    def __init__(self, number: int):
        self.number, self.block, self.rows, self.bytes = number, 0, 0, 0
        # A new word gets the next number. The dictionary's own length would make a cycle, which holds its memory in a reused worker.
        self.words: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)
        self.clear()

    def clear(self):
        self.ids, self.parts, self.flags, self.digests = [], [], [], []
        self.starts, self.columns, self.counts = [0], [], []
        self.last = 0

    def add(self, doc_id, part, text: bytes):
        words = text.split()  # on bytes, split knows the six white-space characters of ASCII only
        columns, counts = np.unique(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)), return_counts=True)
        if len(columns):
            self.columns.append(np.diff(columns, prepend=np.int32(self.last)))
            self.counts.append(counts.astype(np.int32))
            self.last = columns[-1]
        self.starts.append(self.starts[-1] + len(columns))
        self.ids.append(doc_id)
        self.parts.append(part)
        self.flags.append(text_flags(text))
        self.digests.append(xxhash.xxh3_128_digest(text))
        self.bytes += len(text)
        self.rows += 1

    def full(self) -> bool:
        return self.rows >= SHARD_ROWS or self.bytes >= SHARD_BYTES

    def take(self) -> pa.RecordBatch:
        def joined(arrays):
            return np.concatenate([np.empty(0, np.int32), *arrays])
        out = one_row(shard=self.number, block=self.block, doc_id=self.ids, part=self.parts, flags=self.flags, digest=self.digests,
                      starts=self.starts, columns=joined(self.columns), counts=joined(self.counts))
        self.block += 1
        self.clear()
        return out

    def rest(self) -> Iterator[pa.RecordBatch]:
        """The rows that are left, and the words."""
        if self.ids:
            yield self.take()
        words = iter(self.words)
        for first in range(0, len(self.words), BLOCK_WORDS):
            yield one_row(shard=self.number, first=first, words=list(itertools.islice(words, BLOCK_WORDS)))


def shards(docs: DataFrame) -> DataFrame:
    """CSR shards of ``docs`` (doc_id, lang, text): at most 8192 rows or, but for one text, 16 MiB of text each.

    A shard has several rows. Those with a ``block`` hold rows of the matrix: ``starts`` delimits them in
    ``columns`` and ``counts``; ``columns`` has each number as its difference to the one before in the block.
    Those with ``first`` hold ``words``, which name the columns from there on. A task numbers its shards on from its partition's number.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, part, text in zip(*(batch.column(k) for k in range(3))):
                shard.add(doc_id.as_py(), part.as_py(), text.as_py())
                if shard.starts[-1] >= BLOCK_CELLS:
                    yield shard.take()
                if shard.full():
                    yield from shard.rest()
                    shard = Shard(shard.number + 1)
        yield from shard.rest()

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")), text).mapInArrow(build, _SHARD)


def numbered(parts: DataFrame) -> DataFrame:
    """``shard``, ``places``, ``ids``: the global numbers of words of a shard; several rows a shard.

    Equal words meet sorted in one partition, whose number is the upper part of
    theirs; the lower part counts its distinct words. Only the shards' vocabularies
    are shuffled, not the words of the documents, and a task holds a million numbers at most.
    """
    def packed(held):
        shard, place, ids = map(np.concatenate, zip(*held))
        order = np.argsort(shard, kind="stable")
        names, first = np.unique(shard[order], return_index=True)
        offsets = pa.array(np.r_[first, len(shard)].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays(offsets, pa.array(place[order])),
                                           pa.ListArray.from_arrays(offsets, pa.array(ids[order]))], names=["shard", "places", "ids"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, held, size = None, TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            words = batch.column(0)
            if not len(words):
                continue
            new = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False) if len(words) > 1 else np.empty(0, bool)
            ids = at + np.cumsum(np.r_[words[0] != last, new])
            last, at = words[len(words) - 1], int(ids[-1])
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), ids))
            size += len(ids)
            if size >= FLUSH:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (parts.where("first IS NOT NULL").select("shard", "first", F.posexplode("words").alias("place", "word"))
            .select("word", "shard", (F.col("first") + F.col("place")).alias("place"))
            .repartition(n, "word").sortWithinPartitions("word").mapInArrow(number, "shard long, places array<int>, ids array<long>"))


def encoded(parts: DataFrame) -> DataFrame:
    """The blocks of each shard in a row, after the (``places``, ``ids``) of its words; no row holds a whole shard."""
    blocks = parts.where("block IS NOT NULL").drop("first", "words")
    return blocks.unionByName(numbered(parts), allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "block")


def matrix_rows(parts: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``digest``, ``n_words``, ``n_distinct``, ``failed`` (bits of A to D) of each row of the matrix."""
    def dense(held):
        """A column per global number that the shard has, by place."""
        place, number = map(np.concatenate, zip((np.empty(0, np.int32), np.empty(0, np.int64)), *held))
        names = np.empty(len(place), np.int64)
        names[place] = np.unique(number, return_inverse=True)[1]
        return names

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, names = None, [], None
        for batch in batches:
            for k, shard in enumerate(batch.column(0).to_pylist()):
                if shard != last:
                    last, held, names = shard, [], None
                ids, part, flags, digest, starts, columns, counts, place, number = (c[k].values for c in batch.columns[2:])
                if place is not None:  # copies: a view would keep its batch
                    held.append((place.to_numpy().copy(), number.to_numpy().copy()))
                    continue
                if names is None:
                    names, held = dense(held), []
                starts, counts = starts.to_numpy(), counts.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(ids)), np.diff(starts))
                words = np.add.reduceat(np.append(counts, 0), starts[:-1]) * (np.diff(starts) > 0)
                # Nonzeros by global column: two columns of a shard are never one word, and this would show it.
                width = names.max(initial=0) + 1
                cells = np.sort(row * width + names[np.cumsum(columns.to_numpy())])
                distinct = np.bincount(cells[np.diff(cells, prepend=-1) > 0] // width, minlength=len(ids))
                failed = ((words < MIN_WORDS) | (100 * distinct < MIN_DISTINCT * words) << 1).astype(np.int32) | flags.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [ids, part, digest, pa.array(words), pa.array(distinct.astype(np.int64)), pa.array(failed)],
                    names=["doc_id", "part", "digest", "n_words", "n_distinct", "failed"])

    return encoded(parts).mapInArrow(sums, "doc_id long, part string, digest binary, n_words long, n_distinct long, failed int")


def judged(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``part``, ``n_words``, ``n_distinct``, ``failed`` (bit k: the k-th filter).

    A null text is empty, and all empty texts are identical. A null lang is the
    part "". Without doc_id a row is no copy of others (E), nor are others copies of
    it; rows of the smallest doc_id that holds a text all pass E. Other columns are ignored.
    """
    rows = stored(matrix_rows(stored(shards(docs), "shards", **{"parquet.block.row.count.limit": GROUP_ROWS})), "matrix-rows")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = F.coalesce((F.col("doc_id") > F.col("first")).cast("int"), F.lit(0))
    return (rows.join(firsts, "digest", "left")
            .select("doc_id", "part", "n_words", "n_distinct", F.col("failed").bitwiseOR(F.shiftleft(copies, 4)).alias("failed")))


def steps() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bits of the filters before, bit of the step's filter) of all orders."""
    out = []
    for order in map("".join, itertools.permutations(FILTERS)):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append((order, step, before, bit))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of each order of the five filters, by part.

    ``labels``: doc_id, quality, toxic. A document is good (toxic) if any of its
    labels says so. Documents are counted as combinations of part, failed filters
    and labels, at most 128 a part, before orders come in; an empty table gives no row.
    """
    by_doc = (labels.where("doc_id IS NOT NULL").groupBy("doc_id")
              .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    rows = judged(docs).join(by_doc, "doc_id", "left")
    counts = stored(rows.groupBy("part", "failed").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")),
        "failed-sets")
    table = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(k).alias("bit"))
                      for o, s, b, k in steps()))
    cells = counts.select("*", F.explode(table).alias("at")).select("part", "failed", "n", "good", "toxic", "at.*")
    fails, earlier = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0

    def total(condition, what="n"):
        return F.sum(F.when(condition, F.col(what)).otherwise(F.lit(0))).cast("long")
    out = cells.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"), total(fails & ~earlier, "toxic").alias("toxic_lost"))
    whole = F.sum("removed").over(Window.partitionBy("part", "bit"))  # 600 rows a part
    return out.withColumn("shapley", whole.cast("long")).drop("bit")
