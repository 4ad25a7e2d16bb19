"""Shared helpers: shared-folder tables, Arrow access to text, byte blobs and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled by one vectorised step inside a task.
SLICE_BYTES = 1 << 18
#: Bytes of a batch between Spark and Python; two tasks of an executor hold a few of them at a time.
BATCH_BYTES = 8 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder that the whole cluster shares (``spark.checkpoint.dir``); a temporary one where a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = os.path.join(tempfile.gettempdir(), "scholarmill-work")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ``BATCH_BYTES``, so that texts don't pile up beside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = spark.conf.get(name)
        if int(now.rstrip("b")) > BATCH_BYTES:
            spark.conf.set(name, str(BATCH_BYTES))
    except ValueError:  # a size in other units was set on purpose
        return


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A text or binary column as (bytes, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Position-independent hashes of any slice of a sequence, from prefix sums modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n + 1:
            size = max(n + 1, 2 * len(self.up))
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of values[i] * BASE**i."""
        self.powers(len(values))
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the slices [start, end); equal slices have equal hashes wherever they stand."""
        return (sums[end] - sums[start]) * self.down[start]


_seed = np.random.default_rng(20240501)
#: A random 64-bit value for each byte.
BYTE_VALUE = _seed.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BYTE_VALUE_LOWER = BYTE_VALUE[_LOWER]
#: The separators of ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over lower-cased text, and of that over any text.
IS_MARK = np.zeros(256, bool)
IS_MARK[:128] = [not chr(b).isalnum() for b in range(128)]


def words_of(buf: np.ndarray, offsets: np.ndarray, rolling: Rolling, lower: bool, apart: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts: their (start, end) bytes, 64-bit hashes, and each text's first word (length: texts + 1)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~apart[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = rolling.sums((BYTE_VALUE_LOWER if lower else BYTE_VALUE)[buf])
    hashes = mix64(rolling.of(sums, start, end) + (end - start).astype(np.uint64))
    return start, end, hashes, np.searchsorted(start, offsets)


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every id of ``edges(a, b)``: the smallest id that links reach.

    Every round each node takes the neighbour of least priority (a fixed hash), pointers are doubled, and
    the edges are contracted to the nodes pointed at; the mappings are composed at the end. Everything is
    joins and minima: no group is ever gathered, and a hub is a splittable join key. Null ends and self-links
    are ignored; repeated links do no harm; no links give no rows.
    """
    current = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()
    current = materialise(current, f"{name}-edges")
    steps: list[DataFrame] = []

    def prior(c: str):
        return F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("n"))

    while not current.isEmpty():
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        best = both.groupBy("u").agg(F.min(prior("v")).alias("m"))
        to = materialise(best.select("u", F.least(F.col("m"), prior("u"))["n"].alias("r")), f"{name}-to")
        doubled = to
        for _ in range(2):
            nxt = doubled.select(F.col("u").alias("r"), F.col("r").alias("r2"))
            doubled = doubled.join(nxt, "r").select("u", F.col("r2").alias("r"))
        to = materialise(doubled, f"{name}-to")
        steps.append(to)
        left, right = to.select(F.col("u").alias("a"), F.col("r").alias("ra")), to.select(F.col("u").alias("b"), F.col("r").alias("rb"))
        moved = current.join(left, "a").join(right, "b").where("ra <> rb")
        current = materialise(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-edges")
    if not steps:
        return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    label = steps[0].select(F.col("u").alias("id"), "r")
    for to in steps[1:]:
        nxt = to.select(F.col("u").alias("r"), F.col("r").alias("r2"))
        label = materialise(label.join(nxt, "r", "left").select("id", F.coalesce("r2", "r").alias("r")), f"{name}-label")
    least = materialise(label.groupBy("r").agg(F.min("id").alias("component")), f"{name}-least")
    return materialise(label.join(least, "r").select("id", "component"), name)


def blob_schema(*names: str) -> str:
    return ", ".join([f"{n} long" for n in names] + ["blob binary"])


class Buckets:
    """Collects fixed-size records in a task and gives them out as one byte blob for each bucket.

    Rows of a shuffle then are blobs, so that millions of records cost a few thousand rows.
    """

    def __init__(self, dtype: np.dtype, n: int, hold: int = 1 << 20) -> None:
        self.dtype, self.n, self.hold = np.dtype(dtype), n, hold
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, bucket: np.ndarray, records: np.ndarray) -> list[pa.RecordBatch]:
        self.parts.append((bucket, records))
        self.size += len(records)
        return self.flush() if self.size >= self.hold else []

    def flush(self) -> list[pa.RecordBatch]:
        if not self.size:
            return []
        bucket, records = np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])
        order = np.argsort(bucket, kind="stable")
        bucket, records = bucket[order], records[order]
        ids, at = np.unique(bucket, return_index=True)
        data = records.tobytes()
        offsets = pa.py_buffer((np.append(at, len(records)) * self.dtype.itemsize).astype(np.int32))
        blob = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, offsets, pa.py_buffer(data)])
        self.parts, self.size = [], 0
        return [pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), blob], names=["bucket", "blob"])]


def unblob(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> np.ndarray:
    """All records of a task's blobs."""
    parts = [np.frombuffer(utf8(b.column(b.schema.get_field_index("blob")))[0].tobytes(), dtype=dtype) for b in batches if b.num_rows]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return start, np.diff(np.append(start, len(values)))
