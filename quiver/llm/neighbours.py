"""The most similar vectors for every vector, by robust-pruned graphs over shards.

Cells: of each collection, centroids are fitted on a bounded sample.  A vector
is stored in the cell of its nearest centroid, and searches that cell, the
next nearest ones and all others whose centroids are about as similar to it:
how near a pair lies to the border of its cells doesn't depend on how many
cells there are, so neither does the share of pairs that are met.  A cell that
the sample shows to be large gets cells of its own, fitted by the executors on
a sample of its vectors, so the cells' number grows with the vectors while
their size doesn't.  What is still large is split into shards by a hash, and a
search goes to each of its shards.  In a shard, a robust-pruned directed graph
is built over the stored vectors and beam searches give every stored or
visiting vector its candidates; their exact similarities decide.

Vectors of equal direction, whatever their norms, beyond the first few of them
never enter a graph: their nearest ones are those few, so they are paired with
these directly.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quiver.llm.pruned_graph import PrunedGraph
from quiver.workdir import materialise


_COPIES = 1 << 32  # shard number and copy number in one


@dataclass(frozen=True)
class Settings:
    """k: neighbours of each vector; least: least cosine similarity of a result;
    sample: most vectors to fit the cells of all collections on; cell: vectors
    a cell is planned for; shard: vectors at which a cell is split; visits:
    cells that a vector searches at least; margin: it also searches every cell
    whose centroid is less similar by at most this than the nearest; degree, beam, alpha, reach: the graph's
    edges, its beam when built, its relaxation, and the beam of the searches.
    """

    k: int = 5
    least: float = 0.9
    sample: int = 40_000
    cell: int = 400
    shard: int = 4096
    visits: int = 2
    margin: float = 0.04
    degree: int = 16
    beam: int = 32
    alpha: float = 1.2
    reach: int = 16
    bytes: int = 256 << 20
    known: int = 2500


@dataclass
class Cells:
    """Centroids of one collection, grouped under coarser ones if there are many.

    shards: into how many parts a cell's stored vectors are split; copies: on
    how many groups each shard is built, so that no group has too many visitors;
    deep: cells that get cells of their own; salts: over how many tasks their
    vectors are spread for that.
    """

    centroids: np.ndarray
    shards: np.ndarray
    copies: np.ndarray
    deep: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    salts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    groups: list[np.ndarray] = field(default_factory=list)
    coarse: np.ndarray | None = None
    spread: np.ndarray | None = None  # the widest angle between a coarse centroid and one of its group

    def _similarities(self, x: np.ndarray, r: int, margin: float) -> np.ndarray:
        """Of each row to each centroid; -inf for those that can neither be among the ``r`` nearest nor within ``margin`` of the nearest."""
        if self.coarse is None:
            return x @ self.centroids.T
        to = np.arccos(np.clip(x @ self.coarse.T, -1, 1))
        out, first, least = np.full((len(x), len(self.centroids)), -np.inf, np.float32), np.argmin(to, axis=1), np.full(len(x), -np.inf)
        bound = np.cos(np.maximum(0, to - self.spread))  # no centroid of the group is more similar
        for g in np.unique(first):
            rows = np.flatnonzero(first == g)
            if len(self.groups[g]):
                s = x[rows] @ self.centroids[self.groups[g]].T
                out[rows[:, None], self.groups[g]] = s
                if s.shape[1] >= r:
                    least[rows] = np.minimum(np.partition(s, -r, axis=1)[:, -r], s.max(axis=1) - margin)
        for g, group in enumerate(self.groups):
            rows = np.flatnonzero((first != g) & (bound[:, g] >= least))
            if len(rows) and len(group):
                out[rows[:, None], group] = x[rows] @ self.centroids[group].T
        return out

    def nearest(self, x: np.ndarray, r: int) -> np.ndarray:
        """The numbers of the ``r`` nearest cells of each row, nearest first."""
        r = min(r, len(self.centroids))
        return np.argsort(-self._similarities(x, r, 0.0), axis=1, kind="stable")[:, :r]

    def visited(self, x: np.ndarray, least: int, margin: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the nearest cell of each row; row and cell of every visit: the ``least`` nearest cells and all within ``margin`` of the nearest)."""
        r = min(least, len(self.centroids))
        if len(self.centroids) == 1 or not len(x):
            return np.zeros(len(x), np.int64), np.arange(len(x)), np.zeros(len(x), np.int64)
        home, who, cell = [], [], []
        for lo in range(0, len(x), block):
            s = self._similarities(x[lo : lo + block], r, margin)
            row, col = np.nonzero(s >= np.minimum(np.partition(s, -r, axis=1)[:, -r], s.max(axis=1) - np.float32(margin))[:, None])
            home.append(np.argmax(s, axis=1))
            who.append(lo + row)
            cell.append(col)
        return np.concatenate(home), np.concatenate(who), np.concatenate(cell)


def _means(x: np.ndarray, count: int, rounds: int, seed: int = 11) -> np.ndarray:
    """Spherical k-means."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:count]].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-30), c)
    return c


def fit_cells(x: np.ndarray, size: int, s: Settings, last: bool = False) -> Cells:
    """Cells for a collection of about ``size`` vectors of which ``x`` (unit rows) is a sample; ``last``: none of them gets cells of its own."""
    count = int(max(1, min(-(-size // s.cell), len(x) // 8)))
    c = _means(x, count, 4) if count > 1 else x[:1] if len(x) else np.zeros((1, 1), np.float32)
    held = np.bincount(np.argmax(x @ c.T, axis=1), minlength=count) if len(x) else np.ones(1)
    planned = lambda n, most: np.maximum(1, np.ceil(n / max(1, len(x)) * size / most)).astype(np.int64)
    cells = Cells(c, planned(held, s.shard), np.ones(count, dtype=np.int64))
    if count > 256:
        cells.coarse = _means(c, int(count**0.5), 4)
        own = np.argmax(c @ cells.coarse.T, axis=1)
        cells.groups = [np.flatnonzero(own == g) for g in range(len(cells.coarse))]
        angle = np.arccos(np.clip((c * cells.coarse[own]).sum(axis=1), -1, 1))
        cells.spread = np.array([angle[g].max() if len(g) else 0.0 for g in cells.groups]) + 2e-3  # more than single precision can lose
    visitors = np.bincount(cells.visited(x, s.visits, s.margin)[2], minlength=count) if len(x) else np.ones(count)
    cells.copies = planned(visitors, 2 * s.shard)
    cells.deep = np.zeros(count, bool) if last else cells.shards > 1
    cells.salts = planned(visitors, 8 * s.shard)
    return cells


def places(c: Cells, x: np.ndarray, ids: np.ndarray, stored: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, cell, shard and copy, role) of where vectors are stored and search; role 2: stored, searches here; 1: stored; 0: searches.

    Rows that aren't ``stored`` only search, the nearest cell at least.  In a
    cell that is deep the third number is the salt.
    """
    spread = lambda k, by: (ids.astype(np.uint64) * np.uint64(k) >> np.uint64(33)).astype(np.int64) % by
    home, who, cell = c.visited(x, s.visits, s.margin) if stored.all() else c.visited(x, 1, s.margin)
    deep = c.deep[cell]
    if deep.any():
        w, k = who[deep], cell[deep]
        mixed = (ids[w].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64)
        yield w, k, mixed % c.salts[k], np.where((home[w] == k) & stored[w], 2, 0)
        who, cell = who[~deep], cell[~deep]
    at_home = spread(0x9E3779B97F4A7C15, c.shards[home])
    own = np.flatnonzero(stored & ~c.deep[home])
    # a stored vector joins the graph of its shard in every copy, and searches in its own
    copies = c.copies[home[own]]
    mine = spread(0xD6E8FEB86659FD93, c.copies[home])
    row = np.repeat(own, copies)
    copy = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
    yield row, home[row], at_home[row] * _COPIES + copy, np.where(copy == mine[row], 2, 1)
    count = c.shards[cell]
    shard = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    who, cell = np.repeat(who, count), np.repeat(cell, count)
    other = ~stored[who] | (cell != home[who]) | (shard != at_home[who])
    who, cell, shard = who[other], cell[other], shard[other]
    mixed = (ids[who].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64)
    yield who, cell, shard * _COPIES + mixed % c.copies[cell], np.zeros(len(who), np.int64)


def _unit(batch: pa.RecordBatch | pa.Table, rows: np.ndarray, dimension: int, column: str = "embedding") -> np.ndarray:
    a = batch.column(column).take(pa.array(rows))
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    x = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dimension)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(entries: DataFrame) -> DataFrame:
    e = F.col("embedding")
    fine = (F.size(e) == F.col("dimension")) & F.exists(e, lambda v: v != 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return entries.select("index_name", "vec_id", "dimension", e.cast("array<float>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("index_name").isNotNull() & e.isNotNull() & fine)


def _directions(usable: DataFrame, grid: float = 1e4) -> DataFrame:
    """Of each vector the hash of its content and two of its direction, rounded on grids that lie half a step apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, hashed = batch.column("dimension").to_numpy(), np.zeros((2, batch.num_rows), np.int64)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                x, factor = _unit(batch, rows, int(d)) * grid, np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, int(d))
                for shift in (0, 1):
                    hashed[shift, rows] = (np.floor(x + shift / 2).astype(np.int64) * factor).sum(axis=1)
            kept = [batch.column(c) for c in ("index_name", "dimension", "vec_id", "content")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hashed[0]), pa.array(hashed[1])], names=["index_name", "dimension", "vec_id", "content", "a", "b"])

    return usable.mapInArrow(run, "index_name string, dimension int, vec_id long, content long, a long, b long")


def _crowds(usable: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(first members, other members) of the groups of more than k + 1 vectors of equal direction.

    Equal is a similarity that rounds to 1.  Vectors so alike differ by single
    precision only, so a border of one grid may part them, but hardly one of
    both: what shares a cell of grid b goes by its least cell of grid a.  Within
    that, the vector of the least id decides by its similarity; those that
    aren't equal to it are still grouped by content.

    Counts merge map-side; the first k + 1 by id are found in salted parts first, so no window sees a whole hot group.
    """
    at = ["index_name", "dimension"]
    marked = materialise(_directions(usable), "directions")
    close = marked.join(marked.groupBy(*at, "b").agg(F.min("a").alias("near")), [*at, "b"])
    large = close.groupBy(*at, "near").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1).select(*at, "near")
    # written down, as its size then decides whether the vectors have to be shuffled to meet it
    found = materialise(close.join(large, [*at, "near"], "left_semi").select(*at, "vec_id", "content", "near").distinct(), "crowd-rows")
    held = materialise(usable.join(found, [*at, "vec_id", "content"]).distinct(), "crowds")
    leader = held.groupBy(*at, "near").agg(F.min_by("embedding", F.struct("vec_id", "content")).alias("leader"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, equal = batch.column("dimension").to_numpy(), np.zeros(batch.num_rows, bool)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                equal[rows] = np.round(np.einsum("nd,nd->n", _unit(batch, rows, int(d)), _unit(batch, rows, int(d), "leader")), 12) >= 1
            copy = np.where(equal, batch.column("near").to_numpy(), batch.column("content").to_numpy())
            kept = [batch.column(c) for c in (*at, "vec_id", "content")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(equal), pa.array(copy)], names=[*at, "vec_id", "content", "equal", "copy"])

    key = [*at, "equal", "copy"]
    named = materialise(held.join(leader, [*at, "near"]).mapInArrow(name, "index_name string, dimension int, vec_id long, content long, equal boolean, copy long"), "crowd-members")
    crowded = named.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k + 1).select(*key)
    members = named.join(crowded, key, "left_semi")
    salted = members.select(*key, "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    some = salted.withColumn("no", F.row_number().over(Window.partitionBy(*key, "salt").orderBy("vec_id"))).filter(F.col("no") <= k + 1)
    first = some.withColumn("no", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).filter(F.col("no") <= k + 1).select(*key, "vec_id")
    return first, materialise(members.join(first, [*key, "vec_id"], "left_anti"), "crowd-rest")


def nearest_pairs(entries: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(index_name, vec_id, other, similarity): for every vector its up to k most similar others of ``least`` or more.

    ``entries`` has index_name, vec_id, dimension, embedding; other columns
    are ignored.  Vectors that are null, all zero, not of their dimension or
    not finite take no part, nor do rows without an id or index.  Repeated
    rows count once; ties go to the smaller id.  An id given with several
    contents takes part with each of them, and isn't its own neighbour.
    Neighbours are within one (index_name, dimension).
    """
    s = settings or Settings()
    spark = entries.sparkSession
    usable = _usable(entries)
    out = "index_name string, vec_id long, other long, similarity double"
    sizes = usable.groupBy("index_name", "dimension").count()
    top = sizes.orderBy(F.desc("count"), "index_name", "dimension").limit(s.known + 1).collect()
    if not top:
        return spark.createDataFrame([], out)
    total, numbers = (sum(r["count"] for r in top), sum(r["count"] * r.dimension for r in top)) if len(top) <= s.known else sizes.agg(F.sum("count"), F.sum(F.col("count") * F.col("dimension"))).first()
    size = {(r.index_name, r.dimension): r["count"] for r in top[: s.known]}
    share = min(1 << 40, (s.sample << 40) // total, (s.bytes << 40) // (8 * numbers))
    picked = usable.filter(F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 40)) < share)
    if len(top) > s.known:
        picked = picked.join(F.broadcast(spark.createDataFrame(list(size), "index_name string, dimension int")), ["index_name", "dimension"], "left_semi")
    picked = picked.limit(4 * s.sample).toArrow()  # one id may have many rows
    cells: dict[tuple[str, int], Cells] = {}
    names, dims = np.array(picked.column("index_name").to_pylist(), dtype=object), picked.column("dimension").to_numpy()
    for key, n in size.items():
        rows = np.flatnonzero((names == key[0]) & (dims == key[1]))
        cells[key] = fit_cells(_unit(picked, rows, key[1]).astype(np.float32), n, s)
    del picked
    # collections beyond the known ones, none larger than the least of these, are one cell that gets cells of its own
    lone = Cells(np.zeros((1, 1), np.float32), np.ones(1, np.int64), np.ones(1, np.int64), np.ones(1, bool), np.full(1, -(-top[-1]["count"] // (8 * s.shard)), np.int64))
    any_deep = len(top) > s.known or any(c.deep.any() for c in cells.values())
    shared = spark.sparkContext.broadcast(cells)  # at most a number for every eight of the sample's, by the bound on cells
    rate = 8 / s.cell  # of a deep cell's vectors that its own cells are fitted on

    def collections(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], np.ndarray]]:
        names = batch.column("index_name").dictionary_encode()
        code, of, dims = names.indices.to_numpy(), names.dictionary.to_pylist(), batch.column("dimension").to_numpy()
        for c, d in sorted({(int(c), int(d)) for c, d in zip(code, dims)}):
            yield (of[c], d), np.flatnonzero((code == c) & (dims == d))

    columns = ("index_name", "dimension", "cell", "shard", "role", "vec_id", "content", "embedding")
    schema = "index_name string, dimension int, cell long, shard long, role byte, vec_id long, content long, embedding array<float>"

    def moved(batch: pa.RecordBatch | pa.Table, rows: np.ndarray, cell: np.ndarray, shard: np.ndarray, role: np.ndarray) -> list:
        b = batch.take(pa.array(rows))
        own = {"cell": pa.array(cell, pa.int64()), "shard": pa.array(shard, pa.int64()), "role": pa.array(role.astype(np.int8))}
        return [own[c] if c in own else b.column(c) for c in columns]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for key, rows in collections(batch):
                c = shared.value.get(key, lone)
                x = _unit(batch, rows, key[1]).astype(np.float32)
                for who, cell, shard, role in places(c, x, ids[rows], np.ones(len(rows), bool), s):
                    if len(who):
                        # cells of the first level have even numbers if they are final, odd ones if they are deep
                        yield pa.RecordBatch.from_arrays(moved(batch, rows[who], 2 * cell + c.deep[cell], shard, role), names=list(columns))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sample of the vectors that are stored in deep cells."""
        for batch in batches:
            for key, rows in collections(batch):
                c = shared.value.get(key, lone)
                home = c.visited(_unit(batch, rows, key[1]).astype(np.float32), 1, 0.0)[0]
                deep = c.deep[home]
                if deep.any():
                    b = batch.take(pa.array(rows[deep]))
                    yield pa.RecordBatch.from_arrays([b.column("index_name"), b.column("dimension"), pa.array(2 * home[deep] + 1, pa.int64()), b.column("embedding")], names=["index_name", "dimension", "cell", "embedding"])

    def own_cells(table: pa.Table) -> pa.Table:
        """The cells of a deep cell, once for each salt."""
        table = table.combine_chunks()
        name, dimension, cell = (table.column(c)[0].as_py() for c in ("index_name", "dimension", "cell"))
        use = np.arange(min(len(table), s.sample, max(1, s.bytes // (8 * dimension))))
        c = fit_cells(_unit(table, use, dimension).astype(np.float32), int(len(table) / rate), s, last=True)
        salts = int(shared.value.get((name, dimension), lone).salts[cell // 2])
        return pa.table({"index_name": pa.array([name] * salts, pa.string()), "dimension": pa.array([dimension] * salts, pa.int32()), "cell": pa.array([cell] * salts, pa.int64()), "shard": pa.array(range(salts), pa.int64()), "cells": pa.array([pickle.dumps(c)] * salts, pa.binary())})

    def route_deep(table: pa.Table, own: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({c: pa.array([], t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int8(), pa.int64(), pa.int64(), pa.list_(pa.float32())))})
        table = table.combine_chunks()
        dimension, cell_of = table.column("dimension")[0].as_py(), table.column("cell")[0].as_py()
        c = pickle.loads(own.column("cells")[0].as_py()) if len(own) else Cells(lone.centroids, lone.shards, lone.copies, np.zeros(1, bool), lone.salts)
        ids, role, parts = table.column("vec_id").to_numpy(), table.column("role").to_numpy(), []
        for stored in (True, False):
            rows = np.flatnonzero((role == 2) == stored)
            x = _unit(table, rows, dimension).astype(np.float32)
            for who, cell, shard, r in places(c, x, ids[rows], np.full(len(rows), stored), s):
                if len(who):
                    parts.append(pa.table(dict(zip(columns, moved(table, rows[who], (cell + 1) * _COPIES + cell_of, shard, r)))))
        return pa.concat_tables(parts)

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        name, dimension = table.column("index_name")[0].as_py(), table.column("dimension")[0].as_py()
        ids, role = table.column("vec_id").to_numpy(), table.column("role").to_numpy()
        # repeated rows: one of equal id, content and role
        content = table.column("content").to_numpy()
        by = np.lexsort((role, content, ids))
        same = (ids[by][1:] == ids[by][:-1]) & (content[by][1:] == content[by][:-1]) & (role[by][1:] == role[by][:-1])
        once = by[np.append(True, ~same)]
        ids, role, exact = ids[once], role[once], _unit(table, once, dimension)
        own, guests = np.flatnonzero(role > 0), np.flatnonzero(role == 0)
        none = np.zeros(0, np.int64)
        a, b, sim = none, none, np.zeros(0)
        if len(own):
            x = exact[own].astype(np.float32)
            g = PrunedGraph(x, s.degree, s.beam, s.alpha)
            reach = max(s.reach, 2 * s.k + 2)
            asking = np.flatnonzero(role[own] == 2).astype(np.int32)
            found, _ = g.search(x[asking], asking[:, None], beam=reach)
            seek = [(own[asking], found)]
            if len(guests):
                q = exact[guests].astype(np.float32)
                seek.append((guests, g.search(q, np.broadcast_to(g.entry, (len(q), len(g.entry))), beam=s.beam)[0]))
            for who, found in seek:
                r, c = np.nonzero(found >= 0)
                p, o = who[r], own[found[r, c]]
                apart = ids[p] != ids[o]
                p, o = p[apart], o[apart]
                value = np.round(np.einsum("nd,nd->n", exact[p], exact[o]), 12)
                good = value >= s.least
                a, b, sim = np.append(a, ids[p[good]]), np.append(b, ids[o[good]]), np.append(sim, value[good])
            by = np.lexsort((b, -sim, a))
            a, b, sim = a[by], b[by], sim[by]
            begin = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
            rank = np.arange(len(a)) - np.maximum.accumulate(np.where(begin, np.arange(len(a)), 0)) if len(a) else none
            a, b, sim = a[rank < s.k], b[rank < s.k], sim[rank < s.k]
        return pa.table({"index_name": pa.array([name] * len(a), pa.string()), "vec_id": pa.array(a, pa.int64()), "other": pa.array(b, pa.int64()), "similarity": pa.array(sim, pa.float64())})

    with_content = usable.withColumn("content", F.xxhash64("embedding"))
    first, rest = _crowds(with_content, s.k)
    active = with_content.join(rest, ["index_name", "dimension", "vec_id", "content"], "left_anti")
    active = active.select("index_name", "dimension", "vec_id", "content", "embedding")
    routed = active.mapInArrow(route, schema)
    if any_deep:
        at = ("index_name", "dimension", "cell")
        own = active.filter(F.pmod(F.xxhash64("vec_id", "content", F.lit(29)), F.lit(1 << 40)) < int(rate * (1 << 40)))
        own = own.mapInArrow(homes, "index_name string, dimension int, cell long, embedding array<float>")
        own = own.groupBy(*at).applyInArrow(own_cells, "index_name string, dimension int, cell long, shard long, cells binary")
        deep = routed.filter(F.col("cell") % 2 == 1).groupBy(*at, "shard").cogroup(own.groupBy(*at, "shard")).applyInArrow(route_deep, schema)
        routed = routed.filter(F.col("cell") % 2 == 0).unionByName(deep)
    found = routed.groupBy("index_name", "dimension", "cell", "shard").applyInArrow(search, out)
    key = ["index_name", "dimension", "equal", "copy"]
    heads = first.groupBy(*key).agg(F.sort_array(F.collect_list("vec_id")).alias("heads"))  # k + 1 for each crowd
    others = F.slice(F.array_remove(F.col("heads"), F.col("vec_id")), 1, s.k)
    paired = lambda members: members.join(heads, key).select("index_name", "vec_id", F.explode(others).alias("other"), F.lit(1.0).alias("similarity"))
    w = Window.partitionBy("index_name", "vec_id").orderBy(F.desc("similarity"), "other")
    best = found.unionByName(paired(first)).groupBy("index_name", "vec_id", "other").agg(F.max("similarity").alias("similarity"))
    return best.withColumn("_no", F.row_number().over(w)).filter(F.col("_no") <= s.k).drop("_no").unionByName(paired(rest))
