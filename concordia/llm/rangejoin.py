"""Embedding near-duplicates: an exact metric range join.

Unit vectors with cosine >= c are within r = sqrt(2 - 2c) of each other.  Pivots partition the vectors: each
has its home in the cell of the nearest pivot, and visits, of every two cells, the one whose turn it is
if the triangle inequality cannot rule it out: a cell is ruled out if the vector is farther than r from the bisector between the two
pivots, or farther than r from the ball of the cell's home vectors.  So every pair meets
in one cell, the home of one of the two, and cells join independently, in blocks of bounded
size however many vectors a cell has.  Copies are one class with a count.  A block bounds
cosines by distances to some reference vectors and computes what is left in double precision; it
returns a link count per vector and a spanning forest of its links, never the pairs.

Defined results: null, zero and non-finite vectors (or ones with such components) link with nothing; so do
vectors of unequal dimensions with each other; repeated rows are copies and link with each other; a null id
counts as a vector but is never a component id while its group has another; an empty table gives
an empty table; ties (a cosine of exactly the limit) link.

Cost: vectors without clusters in many dimensions are all about equally far apart, so no partition keeps most cells out
of a vector's reach (the README has figures); there the join is a product of blocks and grows with the square of the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.llm._common import components, ship, stage

CELL_ROWS, LEAST_PIVOTS, MOST_PIVOTS = 4096, 8, 1024
#: Vectors whose span gives the bound inside a block.
REFERENCES = 24
HOME_BLOCK, OTHER_BLOCK = 4096, 16384
MARGIN = 1e-3
_EPS = 1e-9


def unit_rows(blobs) -> np.ndarray:
    """Double-precision unit vectors of equal-length binary float64 rows."""
    v = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    big = np.abs(v).max(axis=1, keepdims=True)
    v = v / big  # no overflow or underflow in the norm
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def vector_classes(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Per row: vec_id, cid (null if it links with nothing), dim, vec (float64 bytes)."""
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            cids, dims, blobs = [], [], []
            for x in batch.column(1):
                ok = x.is_valid and len(x.values) and not x.values.null_count
                v = x.values.to_numpy(zero_copy_only=False) if ok else None
                if v is None or not np.isfinite(v).all() or not v.any():
                    cids.append(None)
                    dims.append(None)
                    blobs.append(None)
                    continue
                blob = (np.ascontiguousarray(v, np.float64) + 0.0).tobytes()  # -0.0 is 0.0
                cids.append(xxhash.xxh3_64_intdigest(blob) - (1 << 63))
                dims.append(len(v))
                blobs.append(blob)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cids, pa.int64()), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], ["vec_id", "cid", "dim", "vec"]
            )

    return src.mapInArrow(run, "vec_id long, cid long, dim int, vec binary")


def spread_pivots(v: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first choice of at most *most* rows: the first, then each time the one farthest from all chosen."""
    chosen = [0]
    far = 2 - 2 * (v @ v[0])
    while len(chosen) < min(most, len(v)):
        k = int(far.argmax())
        if far[k] < 1e-6:
            break
        chosen.append(k)
        far = np.minimum(far, 2 - 2 * (v @ v[k]))
    return v[chosen]


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (v @ pivots.T)))


def spanning_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of a bipartite relation given as a boolean matrix."""
    edges: list[tuple[int, int]] = []
    new_col = np.ones(linked.shape[1], bool)
    new_row = linked.any(axis=1)
    while new_row.any():
        todo = [int(new_row.argmax())]
        new_row[todo[0]] = False
        while todo:
            i = todo.pop()
            cols = np.flatnonzero(linked[i] & new_col)
            if not len(cols):
                continue
            new_col[cols] = False
            edges += [(i, c) for c in cols.tolist()]
            rest = np.flatnonzero(new_row)
            part = linked[np.ix_(rest, cols)]
            hit = part.any(axis=1)
            rows = rest[hit]
            new_row[rows] = False
            edges += list(zip(rows.tolist(), cols[part[hit].argmax(axis=1)].tolist(), strict=True))
            todo += rows.tolist()
    return edges


def lifted(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates of unit vectors in the span of *basis* and the length of the rest: their product bounds the cosine."""
    part = v @ basis
    rest = np.sqrt(np.maximum(0.0, 1.0 - (part * part).sum(1, keepdims=True)))
    return np.hstack([part, rest]).astype(np.float32)


def block_links(home: np.ndarray, other: np.ndarray, least: float, basis: np.ndarray) -> np.ndarray:
    """Boolean matrix: cosine of each pair >= *least* in double precision.

    Distances to the references bound each cosine from above, in fewer dimensions; the pairs that the bound leaves are
    computed, or, where it leaves many, the whole single-precision product and the pairs near the limit.
    """
    rough = lifted(home, basis) @ lifted(other, basis).T
    open_ = rough >= least - MARGIN
    linked = np.zeros(rough.shape, bool)
    if np.count_nonzero(open_) > open_.size // 50:
        rough = home.astype(np.float32) @ other.astype(np.float32).T
        linked = rough >= least + MARGIN
        open_ = (rough >= least - MARGIN) & ~linked
    i, j = np.nonzero(open_)
    for a in range(0, len(i), 1 << 18):
        x, y = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
        linked[x, y] = np.einsum("ij,ij->i", home[x], other[y]) >= least
    return linked


def range_join(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """For classes (cid, copies, vec) of one dimension: links (cid, n) and forest edges (a, b)."""
    spark = classes.sparkSession
    r = math.sqrt(2 - 2 * least) + _EPS
    n = classes.count()
    wanted = max(LEAST_PIVOTS, min(MOST_PIVOTS, n // CELL_ROWS))
    # a bounded sample, by hash: pivots decide cost, not results
    sample = classes.orderBy(F.xxhash64("cid"), "cid").limit(min(8 * wanted, 4096)).select("vec").toArrow()
    sample = unit_rows(sample.column("vec").to_pylist()) if n else np.ones((1, 1))
    pivots = spread_pivots(sample, wanted)
    basis = np.linalg.qr(sample[:REFERENCES].T)[0]

    def homes(batches):
        for batch in batches:
            d = _distances(unit_rows(batch.column(0).to_pylist()), pivots)
            home = d.argmin(axis=1)
            radius = np.zeros(len(pivots))
            np.maximum.at(radius, home, d.min(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots))), pa.array(radius)], ["cell", "radius"])

    reach = np.zeros(len(pivots))
    for row in classes.select("vec").mapInArrow(homes, "cell long, radius double").groupBy("cell").agg(F.max("radius").alias("r")).collect():  # a row per pivot
        reach[row["cell"]] = row["r"]
    apart = _distances(pivots, pivots)

    def deal(batches):
        for batch in batches:
            d = _distances(unit_rows(batch.column(2).to_pylist()), pivots)
            home = d.argmin(axis=1)
            at = np.arange(len(home))
            near = d[at, home]
            bisector = (d * d - (near * near)[:, None]) <= 2 * r * apart[home] + _EPS
            ball = d <= reach[None, :] + r + _EPS
            cells = np.arange(len(pivots))[None, :]
            # of two cells, one has the visitors from the other: every pair meets once
            turn = ((cells + home[:, None]) % 2 == 0) == (cells < home[:, None])
            visits = bisector & ball & turn
            visits[at, home] = True
            i, cell = np.nonzero(visits)
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int64()), pa.array(home[i] == cell), *(batch.column(k).take(take) for k in range(3))],
                ["cell", "home", "cid", "copies", "vec"],
            )

    dealt = classes.select("cid", "copies", "vec").mapInArrow(deal, "cell long, home boolean, cid long, copies long, vec binary")
    dealt = stage(dealt, "cells")
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("home").cast("long")).alias("homes"))
    blocks = sizes.select("cell", F.ceil(F.col("homes") / HOME_BLOCK).alias("hbs"), F.ceil(F.col("rows") / OTHER_BLOCK).alias("obs"))
    rows = dealt.join(F.broadcast(blocks), "cell").where("hbs > 0")  # at most MOST_PIVOTS rows
    pick = F.shiftrightunsigned(F.xxhash64("cid"), 1)
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    left = rows.where("home").select("cell", (pick % F.col("hbs")).alias("hb"), each("obs").alias("ob"), F.lit(True).alias("left"), "home", "cid", "copies", "vec")
    right = rows.select("cell", each("hbs").alias("hb"), (pick % F.col("obs")).alias("ob"), F.lit(False).alias("left"), "home", "cid", "copies", "vec")

    def join(table: pa.Table) -> pa.Table:
        is_left = table.column("left").to_numpy()
        cid, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        vec = table.column("vec").to_pylist()
        rows_, others = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        a, b, n_ = [], [], []
        if len(rows_) and len(others):
            other = unit_rows([vec[i] for i in others])
            oc, on = cid[others], copies[others]
            visitor = ~table.column("home").to_numpy()[others]
            back = np.zeros(len(others), np.int64)
            for at in range(0, len(rows_), 1024):
                part = rows_[at : at + 1024]
                linked = block_links(unit_rows([vec[i] for i in part]), other, least, basis)
                linked &= cid[part][:, None] != oc[None, :]
                count = linked @ on
                back += copies[part] @ linked
                hit = np.flatnonzero(count)
                a.append(cid[part][hit])
                b.append(np.full(len(hit), -1))
                n_.append(count[hit])
                if forest := spanning_forest(linked):
                    x, y = np.array(forest).T
                    a.append(cid[part][x])
                    b.append(oc[y])
                    n_.append(np.zeros(len(x), np.int64))
            hit = np.flatnonzero(visitor & (back > 0))  # pairs of two cells meet once and count for both
            a.append(oc[hit])
            b.append(np.full(len(hit), -1))
            n_.append(back[hit])
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.table({"a": pa.array(cat(a), pa.int64()), "b": pa.array(cat(b), pa.int64()), "n": pa.array(cat(n_), pa.int64())})

    found = left.unionByName(right).groupBy("cell", "hb", "ob").applyInArrow(join, "a long, b long, n long")
    found = stage(found, "block-links")
    links = found.where("n > 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    return links, found.where("n = 0").select("a", "b")


def near_vectors(df: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reachable by links), kept."""
    rows = stage(vector_classes(df, id_col, vec_col), "vectors")
    classes = rows.where("cid is not null").groupBy("cid", "dim").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("rep"), F.first("vec").alias("vec")
    )
    classes = stage(classes, "vector-classes")
    links = edges = None
    for row in classes.select("dim").distinct().orderBy("dim").collect():  # dimensions, nearly always one
        one, forest = range_join(classes.where(F.col("dim") == row["dim"]), least)
        links = one if links is None else links.unionByName(one)
        edges = forest if edges is None else edges.unionByName(forest)
    if links is None:
        own = F.col("vec_id")
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept"))
    label = stage(components(edges, "vec-cc"), "vec-roots")
    named = classes.join(label, classes["cid"] == label["node"], "left").select("cid", "copies", "rep", F.coalesce("root", "cid").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("rep").alias("component_id")), "root").join(links, "cid", "left")
    named = named.select("cid", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    named = stage(named, "vec-named")
    out = rows.select("vec_id", "cid").join(named, "cid", "left")
    comp = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(F.col("vec_id") == comp, F.lit(True))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), comp.alias("component_id"), kept.alias("kept"))


ship(__name__)
