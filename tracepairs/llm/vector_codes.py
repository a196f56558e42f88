"""Vector code compression: product codebooks trained by delta-maintained Lloyd rounds.

Vectors become integers, ``floor(scale * x)``, so that sums and distances are exact in any order of tasks. They are cut into
equal parts, each with a codebook. A round assigns every part to the nearest entry of its codebook and is written with
the assignment of the round before beside it. Only parts whose assignment changed then contribute: each task sums its
plus (new entry) and minus (old entry) contributions up, at most one record for each entry, and only these records
shuffle. The running sums (one for each entry and component, bounded by the parameters) give the next codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tracepairs.llm.common import join_hot, map_arrow, materialize, quoted, raw, stage_tables, whole_row

_CHUNK = 4096  # vectors whose distances to a codebook are held at once
_STATE = [StructField("v", BinaryType()), StructField("codes", BinaryType()), StructField("before", BinaryType()), StructField("error", LongType())]


@dataclass
class Codebooks:
    """``entries`` are integers by part, entry and position within the part; ``dim`` is the length of a vector (0: none)."""

    entries: np.ndarray
    scale: int

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def largest(dim: int) -> int:
    """The largest component for which distances and errors of ``dim`` components stay below 2**63."""
    return math.isqrt(2**61 // dim)


def integers(values: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """``floor(scale * x)`` by row; components beyond :func:`largest` are held at it."""
    bound = min(largest(dim), 2**31 - 1)
    return np.clip(np.floor(values.astype(np.float64) * scale), -bound, bound).astype(np.int32).reshape(-1, dim)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by row and part, and squared distances summed over the parts. Of equally near entries the first is taken."""
    parts, _, width = entries.shape
    codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * width * most * most < 2**53 else np.int64  # integers in floats are exact up to 2**53
    book = entries.astype(kind)
    for lo in range(0, len(x), _CHUNK):
        rows = x[lo : lo + _CHUNK].astype(kind)
        for p in range(parts):
            own, c = rows[:, p * width : (p + 1) * width], book[p]
            d = (c * c).sum(1) - 2 * (own @ c.T)
            best = d.argmin(1)
            codes[lo : lo + _CHUNK, p] = best
            error[lo : lo + _CHUNK] += (np.take_along_axis(d, best[:, None], 1)[:, 0] + (own * own).sum(1)).astype(np.int64)
    return codes, error


def _rows(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return raw(column)[0].view(kind).reshape(-1, width)


def _binary(a: np.ndarray) -> pa.Array:
    """One binary value for each row of a C-ordered array."""
    width = a.shape[1] * a.itemsize
    offsets = np.arange(len(a) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(a))])


def _assign(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``row, v, codes, before, error`` of ``rows`` (``row``, and ``vector`` or the state of the round before)."""
    dim, scale, entries = books.dim, books.scale, books.entries
    first = "vector" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = integers(b.column("vector").flatten().to_numpy(zero_copy_only=False), dim, scale) if first else _rows(b.column("v"), np.int32, dim)
            codes, error = nearest(x, entries)
            before = pa.nulls(b.num_rows, pa.binary()) if first else b.column("codes")
            yield pa.RecordBatch.from_arrays([b.column("row"), _binary(x), _binary(codes), before, pa.array(error)], names=["row", "v", "codes", "before", "error"])

    schema = StructType([StructField("row", rows.schema["row"].dataType), *_STATE])
    return map_arrow(rows.select("row", *(["vector"] if first else ["v", "codes"])), run, schema)


def _contributions(state: DataFrame, books: Codebooks) -> DataFrame:
    """``part, entry, n, sums``: what the parts whose assignment changed add to and take from the running sums."""
    parts, entries, width = books.entries.shape
    dim = books.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            x, now = _rows(b.column("v"), np.int32, dim), _rows(b.column("codes"), np.uint8, parts)
            first = b.column("before").null_count == b.num_rows
            old = now if first else _rows(b.column("before"), np.uint8, parts)
            for p in range(parts):
                moved = np.arange(len(x)) if first else np.flatnonzero(now[:, p] != old[:, p])
                own = x[moved, p * width : (p + 1) * width].astype(np.int64)
                for codes, sign in ((now, 1),) if first else ((now, 1), (old, -1)):
                    at = codes[moved, p].astype(np.int64) + p * entries
                    n += sign * np.bincount(at, minlength=len(n))
                    np.add.at(sums, at, sign * own)
        at = np.flatnonzero((n != 0) | (sums != 0).any(1))
        if len(at):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(sums[at].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array((at // entries).astype(np.int32)), pa.array((at % entries).astype(np.int32)), pa.array(n[at]), lists], names=["part", "entry", "n", "sums"])

    local = map_arrow(state.select("v", "codes", "before"), run, "part int, entry int, n long, sums array<long>")
    whole = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return local.groupBy("part", "entry").agg(F.sum("n").alias("n"), *whole)


def kept_vectors(vector_col: str) -> Column:
    """Whether a row has a vector of finite components, at least one."""
    v = quoted(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, finite), F.lit(False))


def compress_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256
) -> tuple[DataFrame, Codebooks]:
    """``row, codes, error`` (``row``: a struct of the other columns of ``df``; ``codes``: one byte for each part) of the kept
    rows, and the codebooks.

    Rows are left out whose vector is null, empty or holds null or non-finite components. All vectors have the length of the
    one with the smallest id among those whose length is a multiple of ``parts``; rows with another length are left
    out too. Codebooks start from the ``entries`` smallest ids, ascending, null last, equal ids by their vectors; with
    fewer rows they are smaller. Rows that repeat an id or a vector count each. Components beyond :func:`largest`
    are held at it. An empty table gives an empty result and empty codebooks. ``entries`` is 256 at most.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 0:
        raise ValueError("entries from 1 to 256, parts from 1, rounds from 0")
    spark, v = df.sparkSession, quoted(vector_col)
    rows = df.where(kept_vectors(vector_col) & (F.size(v) % parts == 0)).select(whole_row(df, (vector_col,)).alias("row"), quoted(id_col).alias("id"), v.cast("array<double>").alias("vector"))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    head = rows.orderBy(*order).limit(1).select(F.size("vector")).first()
    if head is None:
        return rows.select("row", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    dim = head[0]
    rows = rows.where(F.size("vector") == dim)
    start = np.array([r[0] for r in rows.orderBy(*order).limit(entries).select("vector").collect()], np.float64)
    start = integers(start.ravel(), dim, scale).astype(np.int64).reshape(len(start), parts, dim // parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)), scale)
    n, sums = np.zeros(books.entries.shape[:2], object), np.zeros(books.entries.shape, object)
    with stage_tables(spark, keep=1):
        state = rows.select("row", "vector")
        for _ in range(rounds):
            state = materialize(_assign(state, books), "assigned")
            for r in _contributions(state, books).collect():  # at most parts * entries rows
                n[r["part"], r["entry"]] += r["n"]
                sums[r["part"], r["entry"]] += np.array([int(r[f"s{i}"]) for i in range(dim // parts)], object)
            used = n > 0
            moved = books.entries.copy()
            moved[used] = (sums[used] // n[used][:, None]).astype(np.int64)
            books = Codebooks(moved, scale)
        codes = materialize(_assign(state, books).select("row", "codes", "error"), "codes")
    return codes, books


def decompress(codes: Column, books: Codebooks) -> Column:
    """The vector (array of doubles) that ``codes`` stands for: the entries of its parts, in the middle of their cells."""
    parts, _, width = books.entries.shape
    values = F.array(*[F.array(*[F.array(*[F.lit((c + 0.5) / books.scale) for c in e]) for e in p]) for p in books.entries.tolist()])
    byte = lambda p: F.conv(F.hex(F.substring(codes, p + 1, 1)), 16, 10).cast("int")
    return F.flatten(F.array(*[F.get(F.get(values, F.lit(p)), byte(p)) for p in range(parts)]))


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` of the kept rows; see :func:`compress_vectors`.

    Errors are summed over equal labels, null ones together. A label with any share of the rows is summed up map-side and
    joined by broadcast.
    """
    rows = df.select(quoted(id_col).alias("id"), quoted(label_col).alias("label"), quoted(vector_col).alias("vector"))
    if rows.schema["label"].dataType.simpleString() in ("float", "double"):
        raise ValueError("labels of floating point are not compared")
    coded, books = compress_vectors(rows, "id", "vector", **options)
    label = F.col("row.label")
    coded = coded.select("row.id", F.coalesce(label.cast("string"), F.lit("")).alias("name"), label.isNull().alias("none"), "codes", "error")
    by_label = materialize(coded.groupBy("name", "none").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    return join_hot(coded, by_label, ["name", "none"], "n").select(
        F.col("id").alias(id_col), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
