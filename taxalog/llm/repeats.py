"""Removal of long byte strings that occur twice, by suffix order (operator 11).

Every ``min_bytes``-long string has an anchor: the leftmost of its ``width``-byte
grams with the smallest hash. Neighbouring strings with one anchor are a piece, so
texts fall into pieces, equal strings have equal anchors, and a string can only
occur again among the pieces of its anchor's hash. Pieces whose hash no other
piece has are done. Equal pieces are one. The different pieces of a hash, a few
hundred bytes each, are put in suffix order, and the longest previous factors of
their positions, from the previous and next smaller positions in that order, tell
which strings have been there before.

A hash that very many different pieces share (a passage that a third of all texts
quote) is cut again with longer grams, which part the pieces by what surrounds the
passage; the last grams are as long as the strings, and those are simply equal or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalog.llm.columns import free
from taxalog.storage import stored

MIN_BYTES = 400
#: Gram lengths of the first and the later cuts, as shares of ``min_bytes``; the last is all of it.
WIDTHS = (0.25, 0.95, 1.0)
#: Different pieces that one suffix order takes; beyond, their strings are cut with longer grams.
PIECES = 512
#: Bytes that are hashed, and that are put in suffix order, at a time.
SLICE, SORTED = 1 << 18, 1 << 18
#: Bits of a sieve: 16 a key, at most 16 MiB however many keys there are.
SIEVE_BITS, KEY_BITS = 1 << 27, 16
SEED = 0x9E3779B97F4A7C15

_RANDOM = np.random.default_rng(11)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RANDOM.integers(1 << 62, 1 << 63)) * 2 + 1
_POWERS = np.cumprod(np.full(SLICE + 1, _BASE, np.uint64)) * np.uint64(pow(_BASE, -1, 1 << 64))
_BACK = np.cumprod(np.full(SLICE + 1, pow(_BASE, -1, 1 << 64), np.uint64)) * np.uint64(_BASE)


def gram_hashes(text: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` bytes of ``text`` (at most a slice of it)."""
    n = len(text) - width + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[text] * _POWERS[:len(text)])])
    h = (sums[width:] - sums[:n]) * _BACK[:n]
    h = (h ^ h >> np.uint64(32)) * np.uint64(SEED)
    return h ^ h >> np.uint64(29)


def smallest(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` values in a row."""
    n, short = len(values), -len(values) % size
    blocks = np.concatenate([values, np.full(short, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - size + 1], ahead[size - 1:n])


def cut(text: np.ndarray, ends: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the texts that lie one after the other in ``text`` and end at ``ends``: start, number of strings, hash.

    Works slice by slice; a slice's edge cuts a piece in two, which keeps their hash.
    """
    found = []
    last = np.uint64(SLICE - 1)
    for at in range(0, len(text) - length + 1, SLICE - length + 1):
        part = text[at:at + SLICE]
        if len(part) < length:
            break
        h = gram_hashes(part, width)
        anchor = (smallest(h & ~last | np.arange(len(h), dtype=np.uint64), length - width + 1) & last).astype(np.int64)
        start = at + np.arange(len(anchor))
        end = ends[np.searchsorted(ends, start, "right")]
        whole = start + length <= end  # strings do not run on into the next text
        first = np.flatnonzero(whole & np.r_[True, (anchor[1:] != anchor[:-1]) | ~whole[:-1]])
        if len(first):
            runs = np.add.reduceat(whole.astype(np.int64), first)
            found.append((first + at, runs, h[anchor[first]].view(np.int64)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(map(np.concatenate, zip(*found)))


def buffers(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, bytes and ends of the rows' texts, some 1 MiB of text at a time or one text."""
    values = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    sizes = np.fromiter((len(v.as_buffer() or b"") for v in values), np.int64, len(values))
    low = 0
    while low < len(sizes):
        high = max(low + 1, low + int(np.searchsorted(np.cumsum(sizes[low:]), 4 * SLICE, "right")))
        text = np.frombuffer(b"".join(values[k].as_py() for k in range(low, high)), np.uint8)
        yield low, high, text, np.cumsum(sizes[low:high])
        low = high


_PIECES = "doc_id long, own long, base long, start long, strings long, hash long, digest binary"


def pieces(texts: DataFrame, width: int, length: int) -> DataFrame:
    """The pieces of ``texts`` (doc_id, own, base, text): where each starts and how many strings it has.

    ``base`` is the place of the text in its document, ``start`` that of the piece, ``digest`` 128 bits of its bytes.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, text, ends in buffers(batch, 3):
                at, strings, hashes = cut(text, ends, width, length)
                row = low + np.searchsorted(ends, at, "right")
                before = np.r_[0, ends[:-1]][row - low]
                rows = pa.array(row)
                data = text.tobytes()
                digests = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(at.tolist(), (at + strings + length - 1).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(rows) for k in range(3)), pa.array(at - before + batch.column(2).to_numpy()[row]),
                     pa.array(strings), pa.array(hashes), pa.array(digests, pa.binary())],
                    names=[f.split()[0] for f in _PIECES.split(", ")])

    return texts.select("doc_id", "own", "base", "text").mapInArrow(find, _PIECES)


def suffix_ranks(text: np.ndarray, room: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(h, rank of the h bytes from each position) for h = 8 doubling up to ``length``; 0 where fewer than h bytes are left."""
    n, h = len(text), min(8, length)
    wide = np.concatenate([text, np.zeros(h, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(h):
        key = key << np.uint64(8) | wide[k:n + k]
    out = []
    while True:
        at = np.flatnonzero(room >= h)
        rank = np.zeros(n, np.int32)
        rank[at] = np.unique(key[at], return_inverse=True)[1] + 1
        out.append((h, rank))
        if h == length:
            return out
        step = min(h, length - h)
        key = np.zeros(n, np.int64)
        key[:n - step] = rank[:n - step] * np.int64(int(rank.max(initial=0)) + 1) + rank[step:]
        h += step


def smaller_before(position: np.ndarray) -> np.ndarray:
    """Index of the nearest element before each one that is smaller, -1 without one: chains are halved until all have arrived."""
    near = np.arange(len(position)) - 1
    while True:
        far = np.flatnonzero((near >= 0) & (position[near] >= position))
        if not len(far):
            return near
        near[far] = near[near[far]]


def common(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes ``a`` and ``b`` have in common, up to the length of the last ranks; below it in steps of 8."""
    length, top = ranks[-1]
    out = np.where(top[a] == top[b], length, 0)
    rest = np.flatnonzero(out == 0)
    x, y, got = a[rest], b[rest], np.zeros(len(rest), np.int64)
    for h, rank in reversed(ranks[:-1]):
        same = (rank[x] == rank[y]) & (rank[x] > 0)
        x, y, got = np.minimum(x + h * same, len(rank) - 1), np.minimum(y + h * same, len(rank) - 1), got + h * same
    out[rest] = np.minimum(got, length - 1)
    return out


def previous_factors(ranks: list[tuple[int, np.ndarray]], order: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix of ``order`` (suffixes in their order, ``position`` in the corpus of each).

    The longest string that also starts at a smaller position starts there at the
    nearest smaller position before or behind in suffix order.
    """
    n = len(order)
    before = smaller_before(position)
    behind = n - 1 - smaller_before(position[::-1])[::-1]
    out = np.zeros(n, np.int64)
    for near, there in ((before, before >= 0), (behind, behind < n)):
        at = np.flatnonzero(there)
        out[at] = np.maximum(out[at], common(ranks, order[at], order[near[at]]))
    return out


def repeated(texts: list[bytes], places: np.ndarray, length: int, keep_first: bool) -> list[np.ndarray]:
    """Of each piece, whether each of its strings starts at another place too (``keep_first``: at an earlier one).

    ``places``: rank of each piece in the corpus; equal ranks are the same piece.
    """
    text, sizes = np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(text)) - (ends - sizes)[piece]
    ranks = suffix_ranks(text, sizes[piece] - offset, length)
    position = places[piece] * (int(sizes.max(initial=0)) + 1) + offset
    starts = np.flatnonzero(offset + length <= sizes[piece])
    order = starts[np.lexsort((position[starts], ranks[-1][1][starts]))]
    hit = np.zeros(len(text), bool)
    for sign in (1,) if keep_first else (1, -1):  # later places: the earlier ones of the mirrored positions
        hit[order] |= previous_factors(ranks, order, sign * position[order]) >= length
    return [hit[end - size:end - length + 1] for end, size in zip(ends.tolist(), sizes.tolist())]


_SPANS = "doc_id long, own long, low long, high long"


def spans_of(rows: list[tuple], keep_first: bool, length: int) -> pa.RecordBatch:
    """Runs of repeated strings of the pieces (hash, doc_id, own, base, text) of some hashes."""
    ids, owns, lows, highs = [], [], [], []
    if rows:
        # Hashes are sorted, and each piece's rank is its place in its hash; different hashes have no string in common.
        order = sorted(range(len(rows)), key=lambda k: (rows[k][1] is None, rows[k][1] or 0, rows[k][2], rows[k][3]))
        places, last = np.empty(len(rows), np.int64), None
        for place, k in enumerate(order):
            places[k] = places[last] if last is not None and rows[last][1:4] == rows[k][1:4] else place
            last = k
        for (_, doc_id, own, start, _), hit in zip(rows, repeated([r[4] for r in rows], places, length, keep_first)):
            edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
            ids += [doc_id] * (len(edge) // 2)
            owns += [own] * (len(edge) // 2)
            lows += (start + edge[::2]).tolist()
            highs += (start + edge[1::2] + length - 1).tolist()
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(owns, pa.int64()), pa.array(lows, pa.int64()),
                                       pa.array(highs, pa.int64())], names=["doc_id", "own", "low", "high"])


def suffix_spans(fragments: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """``doc_id``, ``own``, ``low``, ``high`` (bytes) of what is repeated in ``fragments`` (hash, doc_id, own, base, text).

    Whole hashes, some 256 KiB of text at a time, are put in suffix order in a task.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[-1][0] and size > SORTED:
                    yield spans_of(held, keep_first, length)
                    held, size = [], 0
                if held and row[:4] == held[-1][:4]:  # a repeated row of documents
                    continue
                held.append(row)
                size += len(row[4])
        yield spans_of(held, keep_first, length)

    n = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (fragments.select("hash", "doc_id", "own", "base", "text").repartition(n, "hash")
            .sortWithinPartitions("hash", "doc_id", "own", "base").mapInArrow(work, _SPANS))


def sieve(keys: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with ``maybe``: false only where no row of ``keys`` (a stored table, it is read twice) has these columns.

    A bit array that is sized by the number of keys, but is 16 MiB at most, goes to
    the tasks: beyond some 8 million keys it lets more and more through, which costs
    time in the exact join that follows and nothing else.
    """
    keys = keys.select(F.xxhash64(*columns).alias("h"))
    n = keys.agg(F.approx_count_distinct("h")).first()[0]
    bits = min(SIEVE_BITS, max(1 << 15, 1 << (KEY_BITS * n).bit_length()))
    place = F.pmod(F.col("h"), F.lit(bits))
    maps = (keys.select(F.shiftright(place, 15).alias("block"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
            .groupBy("block").agg(F.bitmap_construct_agg("bit").alias("map")).collect())  # at most 4096 rows of 4 KiB
    table = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for row in maps:
        table[row.block] = np.frombuffer(bytes(row["map"]), np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(table.ravel())

    @F.arrow_udf("boolean")
    def maybe(place: pa.Array) -> pa.Array:
        at = place.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return rows.withColumn("maybe", maybe(F.pmod(F.xxhash64(*columns), F.lit(bits))))


def taken_out(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The ``wanted`` pieces (doc_id, own, base, start, strings, hash, kinds) with their bytes, from ``texts`` (doc_id, own, base, text)."""
    texts = sieve(wanted, texts, "doc_id", "own", "base").where("maybe").drop("maybe")
    lists = (wanted.groupBy("doc_id", "own", "base").agg(F.collect_list(F.struct("start", "strings", "hash", "kinds")).alias("list"))
             .withColumnsRenamed({"doc_id": "d", "own": "o", "base": "b"}))
    rows = texts.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("own") == F.col("o")) & (F.col("base") == F.col("b")))

    def part(p):
        at = (p["start"] - F.col("base") + 1).cast("int")
        return F.struct(p["hash"].alias("hash"), p["kinds"].alias("kinds"), p["start"].alias("base"),
                        F.substring("text", at, (p["strings"] + length - 1).cast("int")).alias("text"))
    return rows.select("doc_id", "own", F.explode(F.transform("list", part)).alias("p")).select("doc_id", "own", "p.*")


def repeated_spans(texts: DataFrame, length: int, keep_first: bool, widths: list[int]) -> DataFrame:
    """``doc_id``, ``own``, ``low``, ``high`` of what is repeated in ``texts`` (doc_id, own, base, text; text as bytes)."""
    width, later = widths[0], widths[1:]
    found = stored(pieces(texts, width, length), "pieces")
    # Most pieces are alone with their hash and leave here. A hash that very many have is combined within tasks.
    shared = stored(found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "shared-hashes")
    near = stored(sieve(shared, found, "hash").where("maybe").drop("maybe"), "shared-pieces")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "own", "start", "base")).alias("first")
    kinds = stored(near.groupBy("hash", "digest").agg(F.count("*").alias("n"), F.max("strings").alias("strings"), first), "kinds")

    copied = near.join(kinds.where("n > 1").select("hash", "digest", "first"), ["hash", "digest"])
    if keep_first:  # the first of equal pieces has to be looked at like one that is alone
        copied = copied.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("own") == F.col("first.own"))
                                & (F.col("start") == F.col("first.start"))))
    spans = copied.select("doc_id", "own", F.col("start").alias("low"), (F.col("start") + F.col("strings") + length - 1).alias("high"))
    if not later:  # grams as long as the strings: different pieces have no string in common
        return spans

    per_hash = kinds.groupBy("hash").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = stored(kinds.join(per_hash, "hash").select("hash", "kinds", "strings", "first.doc_id", "first.own", "first.start", "first.base"),
                    "mixed-kinds")
    fragments = stored(taken_out(texts, wanted, length), "fragments")
    spans = spans.unionByName(suffix_spans(fragments.where(F.col("kinds") <= PIECES), length, keep_first))
    many = fragments.where(F.col("kinds") > PIECES)
    if not many.isEmpty():
        many = stored(many.select("doc_id", "own", "base", "text").dropDuplicates(["doc_id", "own", "base"]), "many-kinds")
        spans = spans.unionByName(repeated_spans(many, length, keep_first, later))
    return spans


def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Each text without its spans, its bytes, the bytes taken out and the runs that they make."""
    kept, sizes, removed, runs = [], [], [], []
    for text, own in zip(texts, spans):
        text, own = text.as_py(), own.as_py() or ()
        parts, at, gone, n = [], 0, 0, 0
        end = -1
        for low, high in sorted((s["low"], s["high"]) for s in own):
            n += low > end
            if low > at:
                parts.append(text[at:low])
            gone += max(0, high - max(at, low))
            at, end = max(at, high), max(end, high)
        parts.append(text[at:])
        kept.append(b"".join(parts))
        sizes.append(len(text))
        removed.append(gone)
        runs.append(n)
    return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs))],
                                      names=["kept", "n_bytes", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, keep_first: bool = True) -> DataFrame:
    """``docs`` with ``kept`` (binary: the text's UTF-8 bytes without repeats), ``n_bytes``, ``n_removed``, ``n_spans`` (runs removed).

    A byte goes if a string of ``min_bytes`` that covers it also starts elsewhere, in
    this document or another: at an earlier place with ``keep_first`` (documents in the
    order of doc_id, those without one last, in the order of a hash of their text), at any
    place without. Strings are judged on the texts as they are, overlaps count, and none crosses documents.
    Null texts are empty. Rows with one doc_id and text are documents of their own:
    without ``keep_first`` they repeat each other, with it they keep and lose the same
    bytes. Existing columns with the four names are replaced, others pass through.
    """
    keep = [c for c in docs.columns if c.lower() not in ("kept", "n_bytes", "n_removed", "n_spans")]
    lists, d, o, new = free(docs, "_spans", "_d", "_o", "_new")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("own"), F.lit(0).cast("long").alias("base"), text.alias("text"))
    widths = [max(1, int(min_bytes * w)) for w in WIDTHS]
    spans = stored(repeated_spans(texts.where(F.octet_length("text") >= min_bytes), min_bytes, keep_first, widths), "spans")
    per_doc = spans.groupBy(F.col("doc_id").alias(d), F.col("own").alias(o)).agg(F.collect_set(F.struct("low", "high")).alias(lists))
    # Only texts that lose something are shuffled and cut; the others have one Python worker a task, that of the sieve.
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), F.struct(*keep).alias("row"))
    ids = sieve(spans, ids, "doc_id", "own")
    hit = ids.where("maybe").join(per_doc, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("own") == F.col(o)), "left").select("row.*", lists)
    hit = hit.withColumn(new, F.arrow_udf(without, "kept binary, n_bytes long, n_removed long, n_spans long")(text, lists))
    none = F.lit(0).cast("long")
    rest = ids.where("NOT maybe").select("row.*").withColumn(
        new, F.struct(text.alias("kept"), F.octet_length(text).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans")))
    return hit.select(*keep, f"{new}.*").unionByName(rest.select(*keep, f"{new}.*"))
