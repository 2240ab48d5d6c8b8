"""Near-duplicate embeddings by product quantisation (operator 8).

Vectors are put into coarse inverted lists and stored as codes of their residual's
subspaces. Near lists form regions. A query reads the regions that can hold a
neighbour, estimates distances to decoded codes, and decides what is left by exact
cosine.

Both cuts are bounds and lose nothing. With unit vectors, cosine >= c means a distance
of at most d = sqrt(2 - 2c). A neighbour in list j is no further than d from the query,
so the query is no further than d beyond the plane between its own centroid and that of
j: regions without such a list are not read. And the distance to a vector is at least
the distance to its code less the code's error, which is stored.

Random vectors of 64 dimensions, and a group of near copies that holds a fixed share of
the rows, leave the first bound little to cut, so there the comparisons grow with the
square of the rows. They are matrix products of blocks; links leave as counts and forests.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxalog.llm.graph import components, forest
from taxalog.llm.simhash_dedup import FLUSH
from taxalog.storage import stored

COSINE = 0.9
#: Vectors per list that are aimed at, and the most lists; beyond, regions grow and are cut into blocks.
LIST, MAX_LISTS = 200, 4096
SUBSPACES, CODES = 16, 64
#: Rows that centroids and codebooks are fitted on, chosen by hash. Every row is indexed.
SAMPLE = 16_384
#: Entries of a block, and how many times as many queries meet them in one task.
BLOCK, WIDE = 4096, 4
QUERIES = 256
SLACK = 1e-4


@dataclass
class Index:
    centroids: np.ndarray  # lists x dimensions, by region
    books: np.ndarray  # subspaces x codes x width
    regions: np.ndarray  # region of each list, ascending

    def gaps(self) -> np.ndarray:
        """Distances between centroids."""
        return np.sqrt(squares(self.centroids, self.centroids))

    def regions_of(self, x: np.ndarray, reach: float, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home list of each row, and (row, region) of the other regions with a list that a neighbour within ``reach`` can be in."""
        d = squares(x, self.centroids)
        home = d.argmin(1)
        own = d[np.arange(len(x)), home][:, None]
        starts = np.flatnonzero(np.diff(self.regions, prepend=-1))
        row, other = np.nonzero(np.logical_or.reduceat(d - own <= 2 * reach * gaps[home] + SLACK, starts, 1))
        away = other != self.regions[home[row]]
        return home, row[away], other[away]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x subspaces, bytes) of the residuals, and their errors."""
        rest = split(x - self.centroids[home], self.books)
        codes = np.stack([squares(rest[:, m], book).argmin(1) for m, book in enumerate(self.books)], 1).astype(np.uint8)
        near = np.stack([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - near) ** 2).sum((1, 2)))

    def decode(self, codes: np.ndarray, home: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for."""
        rest = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return self.centroids[home] + rest[:, :self.centroids.shape[1]]


def split(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Rows x subspaces x width, filled up with zeros."""
    m, _, width = books.shape
    out = np.zeros((len(x), m * width), x.dtype)
    out[:, :x.shape[1]] = x
    return out.reshape(len(x), m, width)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(0)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([squares(x[a:a + 4096], centers).argmin(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centers)
        np.add.at(sums, home, x)
        n = np.bincount(home, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


def fit(sample: np.ndarray, rows: int) -> Index:
    lists = int(min(max(rows // LIST, 1), MAX_LISTS, max(len(sample) // 4, 1)))
    x = sample.astype(np.float32)
    centroids = kmeans(x, lists)
    # Lists that lie together form regions of about a block, so that a near group is one or a few of them.
    region = squares(centroids, kmeans(centroids, min(lists, max(rows // BLOCK, 1)))).argmin(1)
    centroids, regions = centroids[np.argsort(region, kind="stable")], np.unique(np.sort(region), return_inverse=True)[1]
    home = np.concatenate([squares(x[a:a + 4096], centroids).argmin(1) for a in range(0, len(x), 4096)])
    width = math.ceil(x.shape[1] / SUBSPACES)
    rest = split(x - centroids[home], np.zeros((SUBSPACES, 1, width), np.float32))
    k = min(CODES, len(x))
    books = np.stack([kmeans(np.ascontiguousarray(rest[:, m]), k) for m in range(SUBSPACES)])
    return Index(centroids, books, regions)


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``first`` (smallest vec_id), ``n`` and ``unit`` (array of double) of each distinct usable embedding.

    Null and zero embeddings and those with null or non-finite components are left
    out. Equal vectors are grouped within tasks before the shuffle.
    """
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    groups = (rows.where(F.coalesce(usable, F.lit(False))).groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
              .withColumn("norm", norm).where("norm > 0 AND norm < double('infinity')"))
    return groups.select("embedding", "first", "n", F.transform("embedding", lambda v: v.cast("double") / F.col("norm")).alias("unit"))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def near_vectors(units: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``kind``, ``a``, ``b``: (0, id, number of rows linked with it) and (1, id, id) links that connect what is near.

    ``units``: ``id``, ``n``, ``unit``, each vector once, all of one length. A pair
    is looked at once: from the vector in the lower region, or within a region. Regions
    are cut into blocks of some ``BLOCK`` entries and ``WIDE`` times as many queries,
    so that no group grows with the input; links leave a block as counts and a spanning forest.
    """
    spark = units.sparkSession
    rows = units.count()
    if not rows:
        return spark.createDataFrame([], "kind int, a long, b long")
    rate = min(1.0, 1.2 * SAMPLE / rows)
    sample = (units.where(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "id"), 11) < rate * float(1 << 53))
              .select("id", "unit").toArrow().sort_by("id").slice(0, SAMPLE))
    if not len(sample):
        sample = units.orderBy("id").limit(64).select("id", "unit").toArrow()
    index = fit(matrix(sample.column("unit")), rows)
    shared = spark.sparkContext.broadcast(index)
    reach = math.sqrt(2 - 2 * cosine)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        gaps = own.gaps()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = matrix(part.column(2)).astype(np.float32)
                home, row, other = own.regions_of(x, reach, gaps)
                codes, error = own.encode(x, home)
                at_home = own.regions[home]
                up = other > at_home[row]
                take = np.concatenate([np.arange(len(x)), np.arange(len(x)), row[up]])
                regions = np.concatenate([at_home, at_home, other[up]])
                asks = np.arange(len(take)) >= len(x)
                take_pa = pa.array(take)
                none = pa.array([None] * int(asks.sum()), pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(regions.astype(np.int32)), pa.array(asks), pa.array(home[take].astype(np.int32)),
                    part.column(0).take(take_pa), part.column(1).take(take_pa), part.column(2).take(take_pa),
                    pa.concat_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), none]),
                    pa.array(np.where(asks, 0, error[take]).astype(float))],
                    names=["region", "asks", "home", "id", "n", "unit", "code", "error"])

    placed = stored(units.select("id", "n", "unit").mapInArrow(
        place, "region int, asks boolean, home int, id long, n long, unit array<double>, code binary, error double"), "regions")
    blocks = (placed.groupBy("region").agg(F.ceil(F.sum(F.when(F.col("asks"), 0).otherwise(1)) / BLOCK).cast("int").alias("entries"),
                                         F.ceil(F.sum(F.when(F.col("asks"), 1).otherwise(0)) / (BLOCK * WIDE)).cast("int").alias("queries")))
    # Each entry goes to every block of queries and each query to every block of entries.
    side = F.pmod(F.xxhash64("id"), F.when(F.col("asks"), F.col("queries")).otherwise(F.col("entries"))).cast("int")
    others = F.when(F.col("asks"), F.col("entries")).otherwise(F.col("queries"))
    dealt = (placed.join(blocks, "region").where(others > 0)
             .withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
             .withColumn("e", F.when(F.col("asks"), F.col("other")).otherwise(F.col("side")))
             .withColumn("q", F.when(F.col("asks"), F.col("side")).otherwise(F.col("other"))))

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").combine_chunks()
        entries, queries = table.filter(pa.compute.invert(asks)), table.filter(asks)
        counts, links = linked(shared.value, entries, queries, cosine, reach)
        kind = np.repeat(np.array([0, 1], np.int32), [len(counts[0]), len(links[0])])
        return pa.table({"kind": kind, "a": np.concatenate([counts[0], links[0]]), "b": np.concatenate([counts[1], links[1]])})

    return (dealt.select("region", "e", "q", "asks", "home", "id", "n", "unit", "code", "error")
            .groupBy("region", "e", "q").applyInArrow(compare, "kind int, a long, b long"))


def linked(index: Index, entries: pa.Table, queries: pa.Table, cosine: float, reach: float):
    """(ids, counts) and (member, smallest member) of the pairs of one block."""
    none = np.empty(0, np.int64)
    if not entries.num_rows or not queries.num_rows:
        return (none, none), (none, none)
    at = entries.column("region")[0].as_py()
    ids, n = (entries.column(c).to_numpy() for c in ("id", "n"))
    units, error = matrix(entries.column("unit")), entries.column("error").to_numpy()
    codes = np.frombuffer(b"".join(entries.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
    decoded = index.decode(codes, entries.column("home").to_numpy())
    q_ids, q_n, q_home = (queries.column(c).to_numpy() for c in ("id", "n", "home"))
    q_units, inside = matrix(queries.column("unit")), index.regions[q_home] == at
    limit = (reach + error + SLACK).astype(np.float32) ** 2
    counts, q_counts = np.zeros(len(ids), np.int64), np.zeros(len(q_ids), np.int64)
    found, held = [(none, none)], 0
    order, starts = np.arange(len(ids)), np.arange(len(ids))  # entries by the groups that are known, and where groups start
    for k in range(0, len(q_ids), QUERIES):
        asked, own = q_units[k:k + QUERIES], slice(k, k + QUERIES)
        near = squares(asked.astype(np.float32), decoded) <= limit
        if inside[own].any():  # Within a region both vectors ask; the pair counts for the smaller id's query.
            near &= ~inside[own, None] | (q_ids[own, None] < ids)
        if np.count_nonzero(near) * 64 < near.size:
            q, e = np.nonzero(near)
            same = np.einsum("ij,ij->i", asked[q], units[e]) >= cosine
            q, e = k + q[same], e[same]
            np.add.at(q_counts, q, n[e])
            np.add.at(counts, e, q_n[q])
            found.append((q_ids[q], ids[e]))
            held += len(q)
            if held > FLUSH:
                found = [forest(*map(np.concatenate, zip(*found)))]
                held = len(found[0][0])
            continue
        near &= asked @ units.T >= cosine
        ones = near.astype(float)
        q_counts[own] += (ones @ n.astype(float)).astype(np.int64)
        counts += (q_n[own].astype(float) @ ones).astype(np.int64)
        # One link with each group of entries connects what all of its links do.
        q, group = np.nonzero(np.logical_or.reduceat(near[:, order], starts, 1))
        found.append((q_ids[k + q], ids[order[starts[group]]]))
        found = [forest(*map(np.concatenate, zip(*found)))]
        held = len(found[0][0])
        member, low = found[0]
        root = ids.copy()
        if held:
            place = np.minimum(np.searchsorted(member, ids), held - 1)
            root = np.where(member[place] == ids, low[place], ids)
        order = np.argsort(root, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(root[order]) != 0])
    who, many = np.concatenate([ids, q_ids]), np.concatenate([counts, q_counts])
    return (who[many > 0], many[many > 0]), forest(*map(np.concatenate, zip(*found)))


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of (vec_id, embedding).

    Unusable vectors (see ``unit_vectors``) link with nothing: 0 links, their own
    component, kept. Repeated rows are linked with each other. A null vec_id is
    counted as a vector but names no component. Vectors of different lengths are
    compared within their length. Other columns are ignored.
    """
    rows = rows.select("vec_id", "embedding")
    units = stored(unit_vectors(rows).withColumn("id", F.coalesce("first", F.xxhash64("embedding"))), "units")
    lengths = [r[0] for r in units.select(F.size("unit")).distinct().collect()]
    found = None
    for length in lengths:
        part = near_vectors(units.where(F.size("unit") == length).select("id", "n", "unit"), cosine)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stored(found, "near")
    links = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    groups = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "id")
    named = (units.join(links, "id", "left").join(groups, "id", "left")
             .withColumn("component", F.coalesce("component", "id"))
             .select(F.col("embedding").alias("_same"), "first", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")))
    real = named.groupBy("component").agg(F.min("first").alias("real"))
    named = named.join(real, "component").select("_same", "real", "links")
    out = rows.join(named, F.col("embedding") == F.col("_same"), "left")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("real"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
