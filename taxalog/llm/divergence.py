"""How the words of sources differ from their language (operator 12).

The terms that a language keeps are sorted and built into minimal acyclic
transducers that give each term its lexicographic ordinal. Texts are streamed
through them and counted again by ordinal; smoothed shares of the counts are compared
source by source and term by term, and ordinals break ties.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxalog.storage import stored

MIN_DOCS = 30
TOP = 50
SCALE, PRIOR = 1_000_000_000, 5
#: Terms a transducer, and bytes of transducers that go to the tasks at once; more are streamed in further passes.
SHARD_TERMS = 1 << 16
PASS_BYTES = 64 << 20
#: Ordinals and sources of a block of the comparison.
ORDINALS, SOURCES = 4096, 128

#: Letters and all code points beyond ASCII are of terms; on UTF-8 these are the bytes that stay. A-Z are lower-cased.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Transducer:
    """Minimal acyclic transducer over sorted distinct byte strings.

    Arcs are sorted by (state, byte); an arc carries how many terms of its state
    come before those that lie behind it, so the sum along a path is the ordinal.
    """

    def __init__(self, terms: list[bytes]):
        self.size = len(terms)
        frozen: dict[tuple, int] = {}  # (final, arcs) of a state that has all its arcs -> its number
        states: list[tuple] = []
        path: list[list] = [[False, []]]  # final, arcs of the states along the last term

        def freeze(state) -> int:
            key = (state[0], tuple(state[1]))
            number = frozen.get(key)
            if number is None:
                number = frozen[key] = len(states)
                states.append(key)
            return number

        last = b""
        for term in terms:
            same = 0
            while same < len(last) and same < len(term) and last[same] == term[same]:
                same += 1
            while len(path) > same + 1:
                number = freeze(path.pop())
                path[-1][1].append((last[len(path) - 1], number))
            path += [[False, []] for _ in term[same:]]
            path[-1][0] = True
            last = term
        while len(path) > 1:
            number = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], number))
        self.root = freeze(path.pop())
        # Targets are numbered before their sources, so one sweep counts the terms behind each state.
        behind, keys, targets, outputs = [], [], [], []
        for number, (final, arcs) in enumerate(states):
            before = int(final)
            for byte, target in arcs:
                keys.append(number << 8 | byte)
                targets.append(target)
                outputs.append(before)
                before += behind[target]
            behind.append(before)
        self.final = np.array([s[0] for s in states], bool)
        self.keys, self.targets, self.outputs = (np.array(x, np.int64) for x in (keys, targets, outputs))

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """Ordinal of each term, -1 for those not in the transducer; all go forward together, byte by byte."""
        out = np.full(len(terms), -1, np.int64)
        if not len(self.keys):
            return out
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        text = np.frombuffer(b"".join(terms), np.uint8)
        at = np.cumsum(sizes) - sizes
        term, state, total = np.arange(len(terms)), np.full(len(terms), self.root), np.zeros(len(terms), np.int64)
        step = 0
        while len(term):
            done = sizes[term] == step
            ended = term[done]
            out[ended] = np.where(self.final[state[done]], total[done], -1)
            term, state, total = term[~done], state[~done], total[~done]
            key = state << 8 | text[at[term] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes = self.keys[arc] == key
            term, arc = term[goes], arc[goes]
            state, total, step = self.targets[arc], total[goes] + self.outputs[arc], step + 1
        return out

    def dump(self) -> bytes:
        head = np.array([self.size, self.root, len(self.final), len(self.keys)], np.int64)
        return b"".join(x.tobytes() for x in (head, self.keys, self.targets, self.outputs, self.final))

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        self = cls.__new__(cls)
        self.size, self.root, states, arcs = np.frombuffer(data, np.int64, 4).tolist()
        self.keys, self.targets, self.outputs = np.frombuffer(data, np.int64, 3 * arcs, 32).reshape(3, arcs)
        self.final = np.frombuffer(data, bool, states, 32 + 24 * arcs)
        return self


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                       F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang``, ``term`` (binary) of the terms in at least ``min_docs`` documents of the language.

    Each Arrow batch leaves every term once with its number of documents.
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0), batch.column(1)):
                seen.setdefault(lang.as_py(), Counter()).update(set(terms_of(text.as_py())))
            for lang, own in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()),
                                                  pa.array(list(own.values()), pa.int64())], names=["lang", "term", "docs"])

    return (texts_of(docs).select("lang", "text").mapInArrow(found, "lang string, term binary, docs long")
            .groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term"))


def transducers(kept: DataFrame) -> DataFrame:
    """``lang``, ``first`` (smallest term), ``n``, ``start`` (ordinal of the first), ``data`` of each transducer.

    Terms are range-sorted by language and bytes; each task builds its stretch,
    at most 65,536 terms a transducer.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, held = None, []

        def closed():
            return pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([held[0]], pa.binary()), pa.array([len(held)], pa.int64()),
                 pa.array([Transducer(held).dump()], pa.binary())], names=["lang", "first", "n", "data"])
        for batch in batches:
            for own, term in zip(batch.column(0), batch.column(1)):
                if held and (own.as_py() != lang or len(held) == SHARD_TERMS):
                    yield closed()
                    held = []
                lang = own.as_py()
                held.append(term.as_py())
        if held:
            yield closed()

    kept = stored(kept, "kept-terms")
    n = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    built = stored(kept.repartitionByRange(n, "lang", "term").sortWithinPartitions("lang", "term")
                   .mapInArrow(build, "lang string, first binary, n long, data binary"), "transducers")
    before = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row per transducer
    starts = (built.select("lang", "first", "n").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    return built.join(starts, ["lang", "first"])


def passes(sizes: list[tuple[str, bytes, int]]) -> list[list[tuple[str, bytes]]]:
    """The transducers (lang, first, bytes) in lots of at most 64 MiB, one transducer at least."""
    lots, room = [], 0
    for lang, first, size in sizes:
        if size > room:
            lots.append([])
            room = PASS_BYTES
        lots[-1].append((lang, first))
        room -= size
    return lots


def recounted(docs: DataFrame, built: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``ordinal``, ``term``, ``count`` of the kept terms that occur in a group.

    Texts are streamed through the transducers, of which a lot of at most 64 MiB
    travels to the tasks at a time; a larger vocabulary takes more passes. The driver
    holds one row of sizes per transducer and one lot.
    """
    spark = docs.sparkSession
    sizes = built.select("lang", "first", F.octet_length("data")).orderBy("lang", "first").collect()
    texts, cells = texts_of(docs), None

    def edge(lang, first):
        return F.struct(F.lit(lang).alias("lang"), F.lit(first).alias("first"))
    for lot in passes([(lang, bytes(first), size) for lang, first, size in sizes]):
        (low, first), (high, last) = lot[0], lot[-1]
        place = F.struct("lang", "first")
        data = built.where((place >= edge(low, first)) & (place <= edge(high, last)))
        sent = spark.sparkContext.broadcast([(r.lang, r.start, bytes(r.data)) for r in data.select("lang", "start", "data").collect()])

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known: dict[str, list] = {}
            for lang, start, dumped in sent.value:
                known.setdefault(lang, []).append((start, Transducer.load(dumped)))
            for batch in batches:
                seen: dict[str, dict[str, Counter]] = {}
                for lang, source, text in zip(*(batch.column(k) for k in range(3))):
                    if lang.as_py() in known:
                        seen.setdefault(lang.as_py(), {}).setdefault(source.as_py(), Counter()).update(terms_of(text.as_py()))
                for lang, by_source in seen.items():
                    terms = list(set().union(*by_source.values()))
                    place = np.full(len(terms), -1, np.int64)
                    for start, automaton in known[lang]:
                        ordinal = automaton.ordinals(terms)
                        place = np.where(ordinal >= 0, ordinal + start, place)
                    place = {t: k for t, k in zip(terms, place.tolist()) if k >= 0}
                    rows = [(source, place[t], t, n) for source, own in by_source.items() for t, n in own.items() if t in place]
                    sources, ordinals, words, counts = zip(*rows) if rows else ((), (), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(rows), pa.string()), pa.array(sources, pa.string()), pa.array(ordinals, pa.int64()),
                         pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "source", "ordinal", "term", "count"])

        part = texts.mapInArrow(count, "lang string, source string, ordinal long, term binary, count long")
        cells = part if cells is None else cells.unionByName(part)
    if cells is None:
        return spark.createDataFrame([], "lang string, source string, ordinal long, term binary, count long")
    return cells.groupBy("lang", "source", "ordinal", "term").agg(F.sum("count").alias("count"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), in decimals: exact beyond the range of long."""
    wide = (F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.call_function("div", wide, (total + terms * PRIOR).cast("decimal(20,0)")).cast("long") + 1


def pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``other``, ``total``: the sum of |p - q| over all kept terms of the language.

    Cells are dealt into blocks of 4096 ordinals and, where a language has many
    sources, pairs of blocks of 128 sources; a task compares one block as a dense
    matrix of at most 256 x 4096 shares. A row without a term stands for each source in
    each block, so that sources without a count there are compared as well.
    """
    shares = groups.select("lang", "source", "place", "sources", "base", "total", "terms")
    rows = (cells.join(shares, ["lang", "source"])
            .withColumn("p", share(F.col("count"), F.col("total"), F.col("terms"))).withColumn("block", F.floor(F.col("ordinal") / ORDINALS)))
    each = F.sequence(F.lit(0).cast("long"), F.floor((F.col("terms") - 1) / ORDINALS))
    stand = (shares.where("terms > 0").withColumn("block", F.explode(each))
             .withColumn("ordinal", F.lit(None).cast("long")).withColumn("p", F.lit(None).cast("long")))
    names = ["lang", "block", "source", "place", "sources", "ordinal", "p", "base", "terms"]
    blocks, mine = F.ceil(F.col("sources") / SOURCES).cast("int"), F.floor(F.col("place") / SOURCES).cast("int")
    runs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, mine).alias("low"), F.greatest(k, mine).alias("high")))
    rows = rows.select(*names).unionByName(stand.select(*names)).select(*names, F.explode(runs).alias("run")).drop("sources")

    def compare(table: pa.Table) -> pa.Table:
        place, base = table.column("place").to_numpy(), table.column("base").to_numpy()
        places, first, row = np.unique(place, return_index=True, return_inverse=True)
        start = table.column("block")[0].as_py() * ORDINALS
        width = min(ORDINALS, table.column("terms")[0].as_py() - start)
        dense = np.repeat(base[first][:, None], width, axis=1)
        cell = table.column("ordinal").is_valid().to_numpy()
        dense[row[cell], table.column("ordinal").drop_null().to_numpy() - start] = table.column("p").drop_null().to_numpy()
        names, of = table.column("source").take(pa.array(first)).to_pylist(), places // SOURCES
        low, high = table.column("run")[0].as_py().values()
        a, b, total = [], [], []
        for k in range(len(places)):  # each pair of places meets in one run only
            sums = np.abs(dense - dense[k]).sum(1)
            others = np.flatnonzero(((of != of[k]) | (low == high)) & (places != places[k]))
            a += [names[k]] * len(others)
            b += [names[j] for j in others]
            total += sums[others].tolist()
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(a), pa.string()), "source": pa.array(a, pa.string()),
                         "other": pa.array(b, pa.string()), "total": pa.array(total, pa.int64())})

    parts = rows.groupBy("lang", "block", "run").applyInArrow(compare, "lang string, source string, other string, total long")
    return parts.groupBy("lang", "source", "other").agg(F.sum("total").alias("total"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how far sources differ, and by which terms.

    Part ``pair`` ranks the other sources of the language by the summed
    difference of their shares of kept terms, part ``term`` the terms that the source
    has more often than the language, up to ``top``. Null text, lang and source are
    ''. Rows of a doc_id are documents of their own; doc_id and other columns are
    ignored. A group without terms has pairs, all shares being equal there; a
    language that keeps no term has pairs of value 0; an empty table gives no row.
    Equal values rank by UTF-8, terms through their ordinals.
    """
    built = stored(transducers(kept_terms(docs, min_docs)), "numbered-transducers")
    cells = stored(recounted(docs, built), "cells")
    sizes = built.groupBy("lang").agg(F.sum("n").alias("terms"))
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    named = texts_of(docs).select("lang", "source").distinct()
    per = Window.partitionBy("lang")
    groups = stored(
        named.join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
        .fillna(0, ["terms", "total"])
        .withColumn("place", F.row_number().over(per.orderBy("source")) - 1).withColumn("sources", F.count("*").over(per))
        .withColumn("base", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(0))), "groups")

    # Every other source of the language is a row of the result, so this join makes nothing that is not asked for.
    others = groups.select("lang", F.col("source").alias("other"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source != other")
    pairs = (pairs.join(pair_sums(cells, groups), ["lang", "source", "other"], "left")
             .select("lang", "source", F.col("other").alias("item"), F.coalesce("total", F.lit(0)).alias("value")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    whole = cells.groupBy("lang", "ordinal").agg(F.sum("count").alias("lang_count"))
    sums = cells.groupBy("lang").agg(F.sum("count").alias("lang_total"))
    rows = (cells.join(groups.select("lang", "source", "total", "terms"), ["lang", "source"]).join(whole, ["lang", "ordinal"]).join(sums, "lang")
            .withColumn("value", share(F.col("count"), F.col("total"), F.col("terms")) - share(F.col("lang_count"), F.col("lang_total"), F.col("terms")))
            .where("value > 0"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    rows = (rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank"))
    return pairs.unionByName(rows)
