"""Shared helpers: stage tables in the cluster's shared folder, bounded Arrow slices, 64-bit mixing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracepairs.functions.frames import carried, carried_columns, quoted, relaxed, with_row  # noqa: F401

#: ASCII white space that separates words, as a Java/RE2 character class body.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD_RE = rf"[^{SPACE_CLASS}]+"

#: Explicit broadcasts are used only below this measured number of (narrow) rows.
BROADCAST_ROWS = 500_000


#: A key with more than this share of the rows is hot: there are fewer than 1 / share of them, however large the input.
HOT_SHARE = 1e-4

_tables: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary one (tests); on
    a cluster this raises, as executors would write where the driver does not read."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tracepairs-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage.

    The table survives lost executors; each call uses a new folder, so retries never meet old rows. It stays until
    the innermost :func:`stage_tables` ends, or :func:`remove_tables`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables[-1].append(path)
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete the tables of :func:`materialize` (all that are not deleted yet, or ``paths``). DataFrames that read them
    must have been used before."""
    for path in list(_tables[-1] if paths is None else paths):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        for own in _tables:
            if path in own:
                own.remove(path)


@contextlib.contextmanager
def stage_tables(spark: SparkSession, keep: int = 0):
    """Tables written inside are deleted at its end, but for the last ``keep`` ones, which pass to the scope around."""
    _tables.append([])
    try:
        yield
    finally:
        own = _tables.pop()
        gone = own[: len(own) - keep] if keep else own
        _tables[-1] += own[len(own) - keep :] if keep else []
        remove_tables(spark, gone)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], count_col: str) -> DataFrame:
    """Inner join with a table of one row per key that says how many rows of ``left`` have it (``count_col``).

    Keys with over ``HOT_SHARE`` of the rows are joined by broadcast: there are at most 1 / HOT_SHARE of them at any
    size. In the join of the others no key has more than that share, so no task is hot. Keys are not null.
    """
    total, most = right.agg(F.sum(count_col), F.max(count_col)).first()
    limit = max((total or 0) * HOT_SHARE, 1)
    if (most or 0) <= limit:
        return left.join(right, on)
    hot, rest = right.where(F.col(count_col) > limit), right.where(F.col(count_col) <= limit)
    with_hot = left.join(F.broadcast(hot), on)
    return with_hot.unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on))


_BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB (or one row) between the JVM and Python: records may be long, and Spark's default
    of 64 MB is held several times over by each worker. A smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > _BATCH_BYTES:
        spark.conf.set(key, f"{_BATCH_BYTES}b")


def give_back_memory() -> None:
    """Unused memory of Arrow's pool and of the C heap goes back to the system; reused workers else keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """The Arrow function ``run``, which gives unused memory back at the end of each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back_memory()

    return wrapped


def map_arrow(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(lean(run), schema)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the measured ``rows`` are within ``limit``; otherwise leave a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_row(df: DataFrame, but: tuple[str, ...] = ()) -> Column:
    """The columns of ``df`` as one struct, whatever their names; ``select("row.*")`` of it, as ``row``, gives them back."""
    names = [c for c in df.columns if c not in but]
    return F.struct(*[quoted(c) for c in names]).cast(relaxed(df.select(*map(quoted, names)).schema))


def rename_clashes(df: DataFrame, added: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop input columns that would clash with the operator's own result columns (``keep`` stay)."""
    own = {c.lower() for c in added} - {c.lower() for c in keep}
    return df.drop(*[c for c in df.columns if c.lower() in own])


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int, max_rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds at most ``max_bytes`` (or one row) in each."""
    for batch in batches:
        arr = batch.column(batch.schema.get_field_index(column))
        _, offs = raw(arr)
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
            hi = min(max(hi, lo + 1), lo + max_rows, batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string/binary array without copying rows; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n, at = len(arr), arr.offset
    _, offsets, data = arr.buffers()
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


# --- 64-bit arithmetic on numpy columns ------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_G = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + _G
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(7))
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``base**i`` (or its inverse) modulo 2**64 for i below ``n``; kept per worker."""
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), _BASE_INV if inverse else _BASE, np.uint64)
        out[0] = 1
        have = _powers[key] = np.multiply.accumulate(out)
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums H with H[i] = sum of byte codes times powers; see :func:`span_hash`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte spans [start, end), equal for equal bytes wherever they stand."""
    inv = powers(len(prefix), inverse=True)
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * _G)
