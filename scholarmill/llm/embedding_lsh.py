"""Embedding near-dedup: Euclidean p-stable hashing, then exact cosines.

Normalised vectors are projected on Gaussian directions, shifted and quantised; the quantised projections of a table
make a bucket. Vectors that share a bucket in some table are compared exactly. A pair is counted in the first table
it shares only. Buckets are cut into blocks, and pairs of blocks are the tasks' work, so that no bucket, however
large, is one task's; a block pair gives each vector's count and links that keep the block connected, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buckets, blob_schema, connected_components, materialise, mix64, partitions, runs_of, unblob

_MEMBER = np.dtype([("g", "<u8"), ("v", "<i8")])
#: Vectors to a block of a large bucket.
BLOCK = 512


class Stable:
    """The hash functions: ``tables`` times ``projections`` Gaussian directions with random shifts."""

    def __init__(self, tables: int, projections: int, width: float, seed: int) -> None:
        self.tables, self.projections, self.width, self.seed = tables, projections, width, seed
        self.by_size: dict[int, tuple] = {}

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """Bucket keys (vectors x tables); a key also tells its table."""
        d = unit.shape[1]
        if d not in self.by_size:
            rng = np.random.default_rng([self.seed, d])
            n = self.tables * self.projections
            self.by_size[d] = rng.standard_normal((d, n)), rng.uniform(0, self.width, n), rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        directions, shift, mult = self.by_size[d]
        q = np.floor((unit @ directions + shift) / self.width).astype(np.int64).view(np.uint64)
        keys = (q * mult).reshape(len(unit), self.tables, self.projections).sum(2, dtype=np.uint64)
        return mix64(keys + np.arange(self.tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))


def units(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors in double precision, grouped by dimension as (rows, matrix); rows without a direction are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.cumsum(size) - size
    out = []
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        m = values[at[rows][:, None] + np.arange(d)]
        scale = np.abs(m).max(1)
        ok = np.isfinite(m).all(1) & (scale > 0)
        if ok.any():
            m = m[ok] / scale[ok, None]
            out.append((rows[ok], m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]))
    return out


def _hash(stable: Stable, buckets: int):
    def run(batches):
        out = Buckets(_MEMBER, buckets, 1 << 20)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, unit in units(batch.column(1)):
                for lo in range(0, len(rows), 2048):
                    keys = stable(unit[lo : lo + 2048])
                    rec = np.empty(keys.size, _MEMBER)
                    rec["g"], rec["v"] = keys.ravel(), np.repeat(ids[rows[lo : lo + 2048]], keys.shape[1])
                    yield from out.add((rec["g"] >> np.uint64(40)).astype(np.int64) % buckets, rec)
        yield from out.flush()

    return run


def _share(block: int):
    """(v, g, i, j, mine): members of shared buckets, once for each pair of blocks that theirs takes part in."""

    def run(batches):
        rec = unblob(batches, _MEMBER)
        rec = rec[np.lexsort((rec["v"], rec["g"]))]
        start, count = runs_of(rec["g"])
        keep = np.repeat(count > 1, count)
        rec, count = rec[keep], count[count > 1]
        if not len(rec):
            return
        first = np.cumsum(count) - count
        own = (np.arange(len(rec)) - np.repeat(first, count)) // block
        blocks = np.repeat(-(-count // block), count)
        for lo in range(0, len(rec), 1 << 15):
            sl = slice(lo, lo + (1 << 15))
            n = blocks[sl]
            at = np.repeat(np.arange(len(n)), n)
            other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            mine = own[sl][at]
            r = rec[sl][at]
            cols = [r["v"], np.ascontiguousarray(r["g"]).view(np.int64), np.minimum(mine, other), np.maximum(mine, other), mine]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in cols], names=["v", "g", "i", "j", "mine"])

    return run


def _compare(stable: Stable, least: float):
    def pairs(unit: np.ndarray, at: np.ndarray, size: np.ndarray, left: np.ndarray, same: np.ndarray):
        """Index pairs with a cosine of ``least`` or more, within each group's pair of blocks."""
        small = size <= 24
        most = int(size[small].max()) if small.any() else 0
        group = np.repeat(np.arange(len(size)), size)
        for shift in range(1, most):
            a = np.flatnonzero((group[:-shift] == group[shift:]) & small[group[:-shift]])
            b = a + shift
            ok = same[group[a]] | (left[a] != left[b])
            a, b = a[ok], b[ok]
            for lo in range(0, len(a), 1 << 15):
                x, y = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
                hit = np.einsum("ij,ij->i", unit[x], unit[y]) >= least
                yield x[hit], y[hit]
        for k in np.flatnonzero(~small):
            rows = np.arange(at[k], at[k] + size[k])
            if same[k]:
                x, y = np.nonzero(np.triu(unit[rows] @ unit[rows].T >= least, 1))
                yield rows[x], rows[y]
            else:
                mine, other = rows[left[rows]], rows[~left[rows]]
                x, y = np.nonzero(unit[mine] @ unit[other].T >= least)
                yield mine[x], other[y]

    def chunk(part: pa.Table):
        v, g, i, j, mine, weight = (part.column(k).to_numpy() for k in range(6))
        start = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        size = np.diff(np.append(start, len(v)))
        same, left = (i == j)[start], mine == i
        found = units(part.column(6))
        unit, dims = np.zeros((len(v), max(m.shape[1] for _, m in found))), np.zeros(len(v), np.int64)
        for at, m in found:
            unit[at, : m.shape[1]], dims[at] = m, m.shape[1]
        group = np.repeat(np.arange(len(size)), size)
        counts = np.zeros(len(v), np.int64)
        edges = []
        for x, y in pairs(unit, start, size, left, same):
            ok = dims[x] == dims[y]
            x, y = x[ok], y[ok]
            for lo in range(0, len(x), 1 << 16):
                a, b = x[lo : lo + (1 << 16)], y[lo : lo + (1 << 16)]
                used, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
                keys = np.empty((len(used), stable.tables), np.uint64)
                for d in np.unique(dims[used]):
                    on = dims[used] == d
                    keys[on] = stable(unit[used[on], :d])
                ka, kb = keys[inv[: len(a)]], keys[inv[len(a) :]]
                first = (ka == kb).argmax(1)
                here = ka[np.arange(len(a)), first] == g[a].view(np.uint64)
                x1, y1 = a[here], b[here]
                np.add.at(counts, x1, weight[y1])
                np.add.at(counts, y1, weight[x1])
            if len(x):
                edges.append(np.stack([x, y]))
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(v[on]), pa.nulls(len(on), pa.int64()), pa.array(counts[on])], names=["a", "b", "n"])
        if edges:
            # links that keep what the pairs connect: to the smallest linked row, until no row changes
            e = np.concatenate(edges, 1)
            label = np.arange(len(v))
            while True:
                new = label.copy()
                np.minimum.at(new, e[0], label[e[1]])
                np.minimum.at(new, e[1], label[e[0]])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            on = np.flatnonzero(label != np.arange(len(v)))
            pair = np.unique(np.stack([v[on], v[label[on]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.nulls(len(pair), pa.int64())], names=["a", "b", "n"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # whole groups only: what follows the last border waits for the next batch
            held.append(batch)
            if sum(b.num_rows for b in held) < 8192:
                continue
            part = pa.Table.from_batches(held)
            g, i, j = (part.column(k).to_numpy() for k in (1, 2, 3))
            border = np.flatnonzero((g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
            if len(border):
                cut = int(border[-1]) + 1
                yield from chunk(part.slice(0, cut))
                part = part.slice(cut)
            held = part.to_batches()
        if sum(b.num_rows for b in held):
            yield from chunk(pa.Table.from_batches(held))

    return run


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, tables: int = 64, projections: int = 16, width: float = 2.0, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """Links vectors with a cosine of ``least`` or more (in double precision) that share a bucket of some table.

    Returns (vec_id, n_links, component_id, kept): the number of other vectors linked directly, the smallest id
    reachable by links, and whether that is the vector itself. Vectors that are null, empty, zero, or hold null or
    non-finite values link with nothing, and vectors of different sizes never link. With the defaults a pair at 0.9
    shares a bucket with probability 0.94, one at 0.95 with 0.999. Rows with a null id are left out. A row that comes
    again counts once and comes out once; an id with several vectors has a row for each. Other columns are ignored; an
    empty table gives no rows.
    """
    spark, n = vectors.sparkSession, partitions(vectors.sparkSession)
    base = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("v"), F.col(vector_col).cast("array<double>").alias("x"))
    # equal vectors are one class before anything is dealt out: only its smallest id is hashed, with the number of ids
    usable = (F.size("x") > 0) & ~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("x", lambda e: e != 0)
    ids = base.select("v", F.coalesce(usable, F.lit(False)).alias("usable"), F.xxhash64("x").alias("k1"), F.xxhash64(F.lit(7), "x").alias("k2"), "x")
    classes = ids.where("usable").groupBy("k1", "k2").agg(F.min("v").alias("rep"), F.first("x").alias("x"))
    classes = materialise(classes, "lsh-classes")
    ids = materialise(ids.select("v", "usable", "k1", "k2").distinct().join(classes.select("k1", "k2", "rep"), ["k1", "k2"], "left").select("v", F.when(F.col("usable"), F.col("rep")).alias("rep")), "lsh-ids")
    weights = materialise(ids.where("rep IS NOT NULL").groupBy("rep").agg(F.count("*").alias("w")), "lsh-weights")
    once = classes.groupBy("rep").agg(F.first("x").alias("x")).join(weights, "rep").select(F.col("rep").alias("v"), "x", "w")
    stable = Stable(tables, projections, width, seed)
    dealt = once.select("v", "x").mapInArrow(_hash(stable, 16 * n), blob_schema("bucket"))
    members = materialise(dealt.repartition(n, "bucket").mapInArrow(_share(block), "v long, g long, i long, j long, mine long"), "lsh-members")
    met = members.join(once, "v").select("v", "g", "i", "j", "mine", "w", "x").repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j")
    found = materialise(met.mapInArrow(_compare(stable, least), "a long, b long, n long"), "lsh-found")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("b IS NOT NULL").select("a", "b"), "lsh-groups").select(F.col("id").alias("rep"), "component")
    of_rep = materialise(weights.join(counts, "rep", "left").join(groups, "rep", "left").select("rep", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component"), "lsh-reps")
    component = F.coalesce("component", "rep", "v")
    out = ids.join(of_rep, "rep", "left")
    return out.select(F.col("v").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (component == F.col("v")).alias("kept"))
