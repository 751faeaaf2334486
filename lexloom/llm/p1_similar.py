"""The k most similar vectors of every vector, by query-aware collision counting.

Copies of a vector are collapsed. Each distinct vector is dealt to the cells of its nearest pivots
(a bounded sample; every vector is dealt), more of them the more pivots there are. Within a cell each of ``projections`` random directions
has one sorted array of projections; around a query's own place a window is opened in every array,
widened by virtual rehashing from one radius to the next until the query has its neighbours, and
only the vectors that fall into at least the threshold number of windows are verified. A cell that
is too large is cut into blocks, every pair of which is a task, so no vector is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_sample, materialize

#: Largest number of pivots (sampled vectors that every executor holds, two bytes a number).
MAX_PIVOTS = 131_072
#: Groups of pivots that are looked into for the nearest pivots of a vector.
GROUPS = 24
#: Vectors of a cell, from which on it is cut into blocks of this many.
BLOCK = 4_096
#: Half width of a window, in radii.
WIDTH = 1.8
#: Radii of the windows, as shares of the distance at the least cosine.
RADII = (0.7, 1.0)
#: Pairs that are verified at a time.
PAIRS = 1_024


def units(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, raw vectors, unit vectors) of the usable rows: right length, finite, not zero."""
    lists = column.to_pylist() if column.null_count or column.flatten().null_count else None
    if lists is None:
        lengths = np.diff(column.offsets.to_numpy())
        usual = dim or (int(np.bincount(lengths).argmax()) if len(lengths) else 0)
        if len(lengths) and (lengths == usual).all() and usual:
            raw, at = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, usual).astype(np.float32), np.arange(len(lengths))
        else:
            lists = column.to_pylist()
    if lists is not None:
        sizes = [len(v) for v in lists if v]
        usual = dim or (max(set(sizes), key=sizes.count) if sizes else 0)
        at = np.array([i for i, v in enumerate(lists) if v is not None and usual and len(v) == usual and None not in v], np.int64)
        raw = np.array([lists[i] for i in at], np.float32).reshape(len(at), usual)
    norm = np.sqrt((raw.astype(np.float64) ** 2).sum(1)) if len(raw) else np.zeros(0)
    good = np.isfinite(norm) & (norm > 0)
    return at[good], raw[good], raw[good].astype(np.float64) / norm[good][:, None]


def pack(raw: np.ndarray) -> list[bytes]:
    """Vectors as 16-bit integers, each with its own scale, low bytes before high bytes.

    Nothing is lost where a power of two makes integers of all numbers, and these are made as small
    as they can be, for compression; else cosines keep about five places.
    """
    if not len(raw):
        return []
    raw = raw.astype(np.float64)
    top = np.abs(raw).max(1, keepdims=True)
    even = raw * np.exp2(np.floor(np.log2(32767 / top)))
    whole = (even == np.round(even)).all(1)
    x = np.where(whole[:, None], even, np.round(raw * (32767 / top))).astype(np.int32)
    bits = np.bitwise_or.reduce(np.abs(x), axis=1)
    x = np.where(whole[:, None], x // (bits & -bits)[:, None], x).astype("<i2")
    return [v.tobytes() for v in np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1, 2).transpose(0, 2, 1))]


def unpack(blobs: list[bytes]) -> np.ndarray:
    """The unit vectors of what :func:`pack` made."""
    planes = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), 2, -1)
    x = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i2")[:, :, 0].astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Pivots:
    """Finds the nearest pivots of unit vectors: pivots are grouped around some of them, and only the nearest groups are looked into."""

    def __init__(self, pivots: np.ndarray, probes: int):
        self.pivots, self.probes = pivots.astype(np.float32), probes
        heads = self.pivots[np.linspace(0, len(pivots) - 1, max(1, round(sqrt(len(pivots))))).astype(int)]
        self.heads, of = heads, np.concatenate([np.argmax(self.pivots[lo : lo + 8192] @ heads.T, axis=1) for lo in range(0, len(pivots), 8192)])
        self.members = [np.flatnonzero(of == h) for h in range(len(heads))]

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        """The numbers of the ``probes`` nearest pivots of each vector, in no order; -1 where there are fewer."""
        x, n = unit.astype(np.float32), min(GROUPS, len(self.heads))
        groups = np.argpartition(-(x @ self.heads.T), n - 1, axis=1)[:, :n]
        best, found = np.full((len(x), self.probes), -2, np.float32), np.full((len(x), self.probes), -1, np.int64)
        for g in np.unique(groups):
            rows, own = np.flatnonzero((groups == g).any(1)), self.members[g]
            cos = np.concatenate([best[rows], x[rows] @ self.pivots[own].T], axis=1)
            which = np.concatenate([found[rows], np.broadcast_to(own, (len(rows), len(own)))], axis=1)
            keep = np.argpartition(-cos, self.probes - 1, axis=1)[:, : self.probes]
            best[rows], found[rows] = np.take_along_axis(cos, keep, 1), np.take_along_axis(which, keep, 1)
        return found


def threshold(projections: int, sigmas: float = 1.75) -> int:
    """The collisions that a pair at the radius reaches but for ``sigmas`` standard deviations."""
    p = erf(WIDTH / sqrt(2))
    return max(1, int(projections * p - sigmas * sqrt(projections * p * (1 - p))))


class Arrays:
    """The sorted arrays of a cell's vectors, one for each direction; places are kept in 256ths of an array."""

    def __init__(self, index: np.ndarray, directions: np.ndarray):
        places = (index @ directions).astype(np.float32)
        order = np.argsort(places, axis=0)
        self.sorted = np.ascontiguousarray(np.take_along_axis(places, order, 0).T)
        rank = np.empty(order.shape, np.int64)
        np.put_along_axis(rank, order, np.arange(len(index))[:, None], 0)
        self.n, self.rank = len(index), np.ascontiguousarray((rank * 256 // len(index)).astype(np.uint8).T)

    def collisions(self, own: np.ndarray, half: float) -> np.ndarray:
        """In how many arrays each vector lies in the window of each query, whose projections are ``own``."""
        counts, shifted = np.zeros((len(own), self.n), np.uint8), np.empty((len(own), self.n), np.uint8)
        inside = np.empty((len(own), self.n), bool)
        for array, rank, place in zip(self.sorted, self.rank, own.T):
            lo = np.minimum(np.searchsorted(array, place - half) * 256 // self.n, 255)
            hi = np.maximum(lo, (np.searchsorted(array, place + half) - 1) * 256 // self.n)
            np.subtract(rank, lo.astype(np.uint8)[:, None], out=shifted)  # unsigned: what is below lo wraps around
            np.less_equal(shifted, (hi - lo).astype(np.uint8)[:, None], out=inside)
            np.add(counts, inside.view(np.uint8), out=counts)
        return counts


def search(index: np.ndarray, index_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, min_cos: float, directions: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(queries, neighbours, cosines, pairs verified) for blocks of queries: the k best of the index for each, self left out."""
    need, far, arrays = threshold(directions.shape[1]), sqrt(2 - 2 * min_cos), Arrays(index, directions)
    own, small, asked = (queries @ directions).astype(np.float32), index.astype(np.float32), queries.astype(np.float32)
    for at in range(0, len(queries), 256):
        waiting = np.arange(at, min(at + 256, len(queries)))
        seen = index_ids == query_ids[waiting][:, None]  # verified, or the query itself
        rows, cols, good = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.float32)]
        verified = 0
        for radius in RADII:  # virtual rehashing: the windows widen until the neighbours are certain
            counts = arrays.collisions(own[waiting], WIDTH * radius * far)
            r, c = np.nonzero((counts >= need) & ~seen[waiting - at])
            r = waiting[r]
            seen[r - at, c] = True
            verified += len(r)
            cos = np.concatenate([np.empty(0, np.float32), *(np.einsum("ij,ij->i", asked[r[lo : lo + PAIRS]], small[c[lo : lo + PAIRS]]) for lo in range(0, len(r), PAIRS))])
            near = cos >= min_cos - 1e-4
            rows, cols, good = [*rows, r[near]], [*cols, c[near]], [*good, cos[near]]
            certain = np.concatenate(good) >= 1 - (radius * far) ** 2 / 2 - 1e-4
            waiting = waiting[np.bincount(np.concatenate(rows)[certain] - at, minlength=256)[waiting - at] < k]
            if not len(waiting):
                break
        r, c = np.concatenate(rows), np.concatenate(cols)
        exact = np.round(np.einsum("ij,ij->i", queries[r], index[c]), 6)
        order = np.lexsort((index_ids[c], -exact, r))
        order = order[exact[order] >= min_cos]
        r, c = r[order], c[order]
        first = np.searchsorted(r, r)  # the place of each query's best
        keep = np.arange(len(r)) - first < k
        yield query_ids[r[keep]], index_ids[c[keep]], exact[order][keep], verified


def nearest(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, min_cos: float = 0.6, probes: int = 6, per_pivot: int = 128, projections: int = 64, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(query, neighbour, cosine, rank): for every usable vector its k most similar other vectors.

    Cosines are rounded to 6 places, ties go to the smaller id, and only cosines from ``min_cos``
    on count. Null, all-zero, non-finite vectors, vectors with null elements and vectors of another
    length than most are left out. Copies of a vector are each other's neighbours with cosine 1.
    Ids must be unique; other columns are not read. Approximate: see the README for the recall.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    usual = rows.groupBy(F.size("vec").alias("size")).count().where("size > 0").orderBy(F.desc("count"), "size").first()
    if usual is None:
        return spark.createDataFrame([], "query long, neighbour long, cosine double, rank int")
    dim = usual["size"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw, _ = units(batch.column(1), dim)
            digests = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(digests, pa.binary())], names=["id", "key"])

    ids = materialize(rows.mapInArrow(keys, "id long, key binary"), "keys")
    groups = ids.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = materialize(ids.join(groups, "key").select("id", "rep"), "members")
    copies = members.where("id <> rep")
    reps = rows.where(F.size("vec") == dim).join(copies.select("id"), "id", "left_anti")
    count = ids.count() - copies.count()
    n_pivots = int(min(max_pivots, max(probes, count // per_pivot)))
    probes = max(probes, ceil(probes * (n_pivots / 256) ** 0.25))  # among more pivots, two neighbours have fewer in common
    chosen = bounded_sample(ids.select("id").join(copies.select("id"), "id", "left_anti"), "id", count, n_pivots)
    sample = rows.join(F.broadcast(chosen), "id", "left_semi").select("vec").collect()  # at most n_pivots ids
    good = units(pa.array([r.vec for r in sample], pa.list_(pa.float32())), dim)[2][:n_pivots]
    probes = min(probes, len(good))
    shared = spark.sparkContext.broadcast((good.astype(np.float16), np.random.RandomState(7).standard_normal((dim, projections))))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        pivots = Pivots(shared.value[0], probes)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                at, raw, unit = units(part.column(1), dim)
                if len(at):
                    yield part.column(0).take(pa.array(at)), raw, pivots.nearest(unit)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value[0]), np.int64)
        for _, _, near in cells(batches):
            total += np.bincount(near[near >= 0], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["cell", "n"])

    sizes = reps.mapInArrow(measure, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    large = {r.cell: ceil(r.n / BLOCK) for r in sizes.where(F.col("n") > BLOCK).collect()}  # at most one row per pivot

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = np.ones(len(shared.value[0]), np.int64)
        for cell, n in large.items():
            blocks[cell] = n
        for ids, raw, near in cells(batches):
            row, probe = np.nonzero(near >= 0)
            n = blocks[near[row, probe]]
            row, cell, n = np.repeat(row, n), np.repeat(near[row, probe], n), np.repeat(n, n)
            other = np.arange(len(row)) - np.flatnonzero(np.diff(np.stack([row, cell]), axis=1, prepend=-1).any(0))[np.cumsum(np.diff(np.stack([row, cell]), axis=1, prepend=-1).any(0)) - 1]
            mine = (ids.to_numpy()[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
            vec = pa.array(pack(raw), pa.binary()).take(pa.array(row))
            cols = (cell, np.minimum(mine, other), np.maximum(mine, other), mine)
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cols), ids.take(pa.array(row)), vec], names=["cell", "i", "j", "mine", "id", "vec"])

    def within(data: pa.Table) -> pa.Table:
        ids, x = data.column("id").to_numpy(), unpack(data.column("vec").to_pylist())
        i, j, mine = data.column("i")[0].as_py(), data.column("j")[0].as_py(), data.column("mine").to_numpy()
        sides = [(mine >= 0, mine >= 0)] if i == j else [(mine == i, mine == j), (mine == j, mine == i)]
        found = [f[:3] for q, v in sides if q.any() and v.any() for f in search(x[v], ids[v], x[q], ids[q], k, min_cos, shared.value[1])]
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0)] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query", "neighbour", "cosine"])

    dealt = reps.mapInArrow(deal, "cell int, i int, j int, mine int, id long, vec binary")
    found = dealt.groupBy("cell", "i", "j").applyInArrow(within, "query long, neighbour long, cosine double")
    best = lambda by, n: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("cosine"), "neighbour")) <= n
    found = found.groupBy("query", "neighbour").agg(F.max("cosine").alias("cosine"))
    found = materialize(found.withColumn("keep", best("query", k)).where("keep").drop("keep"), "found")

    # copies: at most k + 1 members of a group can be among the neighbours of any vector
    few = members.withColumn("keep", F.row_number().over(Window.partitionBy("rep").orderBy("id")) <= k + 1).where("keep").select(F.col("rep"), F.col("id").alias("member"))
    others = found.join(few.withColumnRenamed("rep", "neighbour"), "neighbour", "left").select("query", F.coalesce("member", "neighbour").alias("neighbour"), "cosine")
    own = few.select(F.col("rep").alias("query"), F.col("member").alias("neighbour"), F.lit(1.0).alias("cosine"))
    lists = others.unionByName(own).withColumn("keep", best("query", k + 1)).where("keep").select(F.col("query").alias("rep"), "neighbour", "cosine")
    wanted = lists.select(F.col("rep").alias("query"), "neighbour", "cosine").unionByName(copies.withColumnRenamed("id", "query").join(lists, "rep").select("query", "neighbour", "cosine"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))
    return wanted.where("query <> neighbour").withColumn("rank", place).where(F.col("rank") <= k)
