"""Tables, shared intermediate storage and the vectorised text kernel.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  All functions take
``bytes`` per document; a null text is the empty one.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Bytes of text handled at once by the numpy kernels (a longer text is one chunk of its own).
CHUNK_BYTES = 1 << 20
#: Bits of a bitmap; what is collected and broadcast is bounded by it (16 MB).
BITMAP_BITS = 27


#: Bounds of an Arrow batch, where the session leaves Spark's own: texts may be long, and a task holds some batches at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2048", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
_defaults: dict[str, str] = {}


def bound_batches(spark: SparkSession) -> None:
    for key, value in BATCH.items():
        now = spark.conf.get(key)
        if now == _defaults.setdefault(key, now) and key not in dict(spark.sparkContext.getConf().getAll()):
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt out over them."""
    bound_batches(spark)
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def alike(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: never broadcast, so that small inputs run and cost as large ones do."""
    return df.hint("merge")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's, or a temporary one in local tests."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    there = f"file://{tempfile.gettempdir()}/glyphlake-shared"
    spark.conf.set("spark.checkpoint.dir", there)
    return there


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write and reread, so that lineage ends at files all executors share."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def settle_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """settle() in buckets of ``column``, so that a join on it moves the other side only."""
    spark = df.sparkSession
    name = f"{name}-{uuid.uuid4().hex}"
    path, called = f"{shared_dir(spark)}/{name}", name.replace("-", "_")
    # Rows that come from an exchange by the column lie in its buckets as they are.
    df.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(called)
    out = spark.table(called)
    out._settled_at, out._settled_as = path, called
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_settled_at", None):
            if called := getattr(df, "_settled_as", None):
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {called}")
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """A bitmap with the bit of every value of a bigint column set."""
    slot = F.col(column).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    words = values.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values.view(np.uint64) & np.uint64((1 << BITMAP_BITS) - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def without(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """df without the rows whose ``column`` has a value of ``gone``; a bitmap of fixed size spares the others the exact join."""
    bits = df.sparkSession.sparkContext.broadcast(bitmap(gone.select(F.xxhash64(column).alias("k")), "k"))

    @F.arrow_udf(T.BooleanType())
    def may(k: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bits.value, k.to_numpy()))

    maybe = may(F.xxhash64(column))
    some = df.where(maybe).join(alike(gone.select(column)), column, "left_anti")
    return df.where(~maybe).unionByName(some.select(*df.columns))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their first ``keys`` bigint columns, as batches of whole groups and the groups' bounds."""

    def starts(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(max(b.num_rows - 1, 0), bool)
        for k in range(keys):
            c = b.column(k).to_numpy()
            new |= c[1:] != c[:-1]
        return np.r_[0, np.flatnonzero(new) + 1]

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and any(held[0].column(k)[0].as_py() != b.column(k)[0].as_py() for k in range(keys)):
            whole = pa.concat_batches(held)
            yield whole, np.array([0, whole.num_rows])
            held = []
        at = starts(b)
        if len(at) == 1:  # the last group may go on in the next batch
            held.append(b)
            continue
        whole = pa.concat_batches([*held, b.slice(0, at[-1])])
        shift = whole.num_rows - int(at[-1])
        yield whole, np.r_[0, at[1:] + shift]
        held = [b.slice(at[-1])]
    if held:
        whole = pa.concat_batches(held)
        yield whole, np.array([0, whole.num_rows])


def release() -> None:
    """Give back to the system what a task's arrays took of a worker that other tasks will use again."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """``run``, a function of Arrow batches, with release() at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string or binary column as bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Spans of rows with about ``most`` bytes each."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


_M = 0xD6E8FEB86659FD95  # 5 mod 8: of the largest order modulo 2**64
_M_INV = pow(_M, -1, 1 << 64)
_VALUES = np.random.default_rng(20250101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, 1 << 16), np.uint64(base), np.uint64)
        p[0] = 1
        np.cumprod(p, out=p)
        if n > 2 * CHUNK_BYTES:
            return p
        _powers[base] = p
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Words:
    """The words of some texts: byte spans in ``buf``, 64-bit hashes, and for each text its span of words."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = b"\n" + b"\n".join(texts) + b"\n"
        if lower:
            raw = raw.translate(LOWER)
        self.raw = raw
        self.buf = np.frombuffer(raw, np.uint8)
        n = len(self.buf)
        self.text_start = np.zeros(len(texts) + 1, np.int64)
        self.text_start[0] = 1
        np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=self.text_start[1:])
        self.text_start[1:] += 1
        ws = _WS[self.buf]
        self.start = np.flatnonzero(ws[:-1] & ~ws[1:]) + 1
        self.end = np.flatnonzero(~ws[:-1] & ws[1:]) + 1
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[self.buf] * powers(_M, n)[:n], out=c[1:])
        h = (c[self.end] - c[self.start]) * powers(_M_INV, n)[self.start]
        self.hash = mix(h + (self.end - self.start).astype(np.uint64))
        self.offset = np.searchsorted(self.start, self.text_start)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k-word windows that stay inside a text, and each text's span of them."""
        n = len(self.hash)
        counts = np.diff(self.offset)
        inside = np.maximum(counts - k + 1, 0)
        offset = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(inside, out=offset[1:])
        if not offset[-1]:
            return np.zeros(0, np.uint64), offset
        h = combine([self.hash[j : n - k + 1 + j] for j in range(k)])
        first = np.repeat(self.offset[:-1] - offset[:-1], inside) + np.arange(offset[-1])
        return h[first], offset


def combine(parts: Iterable[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of hashes, by position."""
    h = None
    for p in parts:
        h = p.copy() if h is None else h * np.uint64(0x9E3779B97F4A7C15) + p
    return mix(h)


def word_sequence_hash(h: np.ndarray) -> np.uint64:
    """One hash of a short sequence of word hashes, apart from those of full windows."""
    return combine([h[i : i + 1] for i in range(len(h))])[0] ^ np.uint64(0xA5A5A5A5A5A5A5A5 + len(h))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def shield(docs: DataFrame, used: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")):
    """docs with every column that isn't used under a name that clashes with nothing, and a function that gives the names back."""
    safe = {c: c if c in used else f"__kept_{i}" for i, c in enumerate(docs.columns)}
    bound_batches(docs.sparkSession)
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in safe.items()])
    return renamed, lambda out: out.select(*[F.col(n).alias(c) for c, n in safe.items()])
