"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Encoding is reduced over a binary tree of text pieces. Two encoded neighbours join by re-encoding a window
around their boundary, which grows until the tokens outside it are provably those of the whole text:

* at a *seam* on either side, a place that no match of the splitting pattern crosses and that no look-ahead sees past:
  white space after a character that is none, or a change between ASCII letters, digits and other signs (but not
  after an apostrophe, which may begin a contraction);
* or, within one long match without seams, where the window's first and last tokens go with the neighbours that
  stay: tokens in a row are the encoding of their bytes exactly if each two neighbours are the encoding of
  theirs (when each token encodes to itself, which is checked for the ranks). So the two new pairs decide.

So joining is associative. Decoding concatenates up the same tree.

Both arguments are about one splitting pattern, :data:`SEAM_PATTERN`. With another pattern, texts are encoded whole.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracepairs.llm.common import carried, carried_columns, map_arrow, quoted, raw, rename_clashes, slices, with_row

#: Fixed value: the splitting pattern for which seams are defined.
SEAM_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters that some regex engine counts as white space (fixed values).
_ANY_SPACE = frozenset(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))
_SEAM_SPACE = frozenset(" \n\t\r")
_LETTER, _DIGIT, _SIGN, _SPACE = 1, 2, 3, 4
_ASCII = [0] * 128
for _c in range(128):
    _ASCII[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _SPACE if chr(_c) in _SEAM_SPACE else _SIGN if 32 < _c < 127 else 0
#: Characters that are looked at for a seam before the tokens themselves decide.
_LOOK = 64


class Encoder:
    """Encoding of texts, of the bytes of one match, and what is known of single tokens."""

    def __init__(self, encoding: tiktoken.Encoding, pattern: str):
        self.encoding, self.tree = encoding, pattern == SEAM_PATTERN
        self.token = {i: b for b, i in encoding._mergeable_ranks.items()}
        self.length = np.zeros(max(self.token, default=0) + 1, np.int64)
        for i, b in self.token.items():
            self.length[i] = len(b)
        self.sound = all(self.piece(b) == [i] for i, b in self.token.items())

    def __call__(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def piece(self, data: bytes) -> list[int]:
        """Ids of the bytes of one match."""
        return self.encoding._encode_single_piece(data)

    def fits(self, x: int, y: int) -> bool:
        """Whether the two tokens stand side by side in the encoding of their bytes."""
        return self.piece(self.token[x] + self.token[y]) == [x, y]


def load(rank_file: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _kind(c: str) -> int:
    """The class of a character in the pattern; 0 where engines may differ."""
    if c < "\x80":
        return _ASCII[ord(c)]
    # letters since Unicode 3.2, which every engine knows
    return _LETTER if unicodedata.ucd_3_2_0.category(c)[0] == "L" and unicodedata.category(c)[0] == "L" else 0


def _is_seam(text: str, p: int) -> bool:
    left, right = text[p - 1], text[p]
    if right in _SEAM_SPACE:
        return left not in _ANY_SPACE
    if left >= "\x80" or right >= "\x80" or left == "'":
        return False
    a, b = _ASCII[ord(left)], _ASCII[ord(right)]
    return a != b and 0 < a < _SPACE and 0 < b


def _seam_before(text: str, lo: int, mid: int, look: int) -> int | None:
    """Last seam in (lo, mid], or ``lo``; None if there is none within ``look`` characters."""
    for p in range(min(mid, len(text) - 1), max(lo, mid - look), -1):
        if _is_seam(text, p):
            return p
    return lo if mid - look <= lo else None


def _seam_after(text: str, mid: int, hi: int, look: int) -> int | None:
    """First seam in [mid, hi), or ``hi``; None if there is none within ``look`` characters."""
    for p in range(max(mid, 1), min(hi, mid + look)):
        if _is_seam(text, p):
            return p
    return hi if mid + look >= hi else None


def _join_run(text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray, encode: Encoder) -> np.ndarray | None:
    """As :func:`join_pieces` within one long match; None if the boundary is not inside one."""
    kind = _kind(text[mid])
    if not kind or not encode.sound:
        return None
    look = _LOOK
    while True:
        start, end = mid, mid
        while start > max(lo, mid - look) and _kind(text[start - 1]) == kind and text[start - 1] != "'":
            start -= 1
        while end < min(hi, mid + look) and _kind(text[end]) == kind and text[end] != "'":
            end += 1
        before, after = text[start:mid].encode(), text[mid : max(mid, end - 1)].encode()  # of white space, the last one may be cut off
        tail, head = left[-len(before) :] if before else left[:0], right[: len(after)]
        k = int(np.searchsorted(np.cumsum(encode.length[tail[::-1]]), len(before), "right")) - 1
        j = int(np.searchsorted(np.cumsum(encode.length[head]), len(after), "right")) - 1
        if k < 1 or j < 1:  # one more token on either side must be inside
            return None
        n, m = int(encode.length[tail[len(tail) - k :]].sum()), int(encode.length[head[:j]].sum())
        window = encode.piece(before[len(before) - n :] + after[:m])
        if encode.fits(int(left[-k - 1]), window[0]) and encode.fits(window[-1], int(right[j])):
            return np.concatenate([left[:-k], np.array(window, left.dtype), right[j:]])
        if start > mid - look and end < mid + look:
            return None
        look *= 2


def join_pieces(text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray, encode: Encoder) -> np.ndarray:
    """Ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
    a, b = _seam_before(text, lo, mid, _LOOK), _seam_after(text, mid, hi, _LOOK)
    if a is None or b is None:
        joined = _join_run(text, lo, mid, hi, left, right, encode)
        if joined is not None:
            return joined
        a, b = (_seam_before(text, lo, mid, mid - lo) if a is None else a), (_seam_after(text, mid, hi, hi - mid) if b is None else b)
    if a == mid or b == mid:
        return np.concatenate([left, right])
    n_left = len(left) - len(encode(text[a:mid])) if a > lo else 0
    n_right = len(encode(text[mid:b])) if b < hi else len(right)
    return np.concatenate([left[:n_left], encode(text[a:b]), right[n_right:]])


def encode_tree(text: str, encode: Encoder, leaf: int = 512, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Token ids of text[lo:hi], halves first; a leaf has at most ``leaf`` characters."""
    hi = len(text) if hi is None else hi
    if hi - lo <= leaf or not encode.tree:
        return encode(text[lo:hi])
    mid = (lo + hi) // 2
    left, right = encode_tree(text, encode, leaf, lo, mid), encode_tree(text, encode, leaf, mid, hi)
    return join_pieces(text, lo, mid, hi, left, right, encode)


def decode_tree(ids: np.ndarray, decode, leaf: int = 256) -> bytes:
    """Bytes of the ids (``decode``: of a list of ids), halves first."""
    if len(ids) <= leaf:
        return decode(ids.tolist())
    mid = len(ids) // 2
    return decode_tree(ids[:mid], decode, leaf) + decode_tree(ids[mid:], decode, leaf)


def _share_ranks(df: DataFrame, rank_path: str) -> Broadcast:
    with open(rank_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _encoder(files: Broadcast, pattern: str) -> Encoder:
    """The encoder of a broadcast rank file, made for each task: workers are reused by other stages."""
    return Encoder(load(files.value, pattern), pattern)


def _array_of(ids: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.astype(np.int32)))


def bpe_encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids", *, leaf: int = 512) -> DataFrame:
    """``df`` with ``out_col`` (array<int>): ids by the ranks of ``rank_path``, each match of ``pattern`` on its
    own, special strings as ordinary text. Null and empty texts give an empty array. An input column with
    the name of ``out_col`` is replaced. One pass without a shuffle; the rank file is broadcast (its size is
    that of the vocabulary)."""
    files = _share_ranks(df, rank_path)
    df = rename_clashes(df, [out_col], keep=(text_col,)) if out_col != text_col else df
    others = [c for c in df.columns if c != out_col]
    rows = df.select(F.coalesce(quoted(text_col), F.lit("")).alias("__t"), carried(df, others).alias("__row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(files, pattern)
        for b in slices(batches, "__t", 2 << 20):
            ids = [encode_tree(t, encode, leaf) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), _array_of(ids)], names=["__row", "__ids"])

    return map_arrow(rows, run, with_row(rows, "__row", "__ids array<int>")).select(*carried_columns(others, "__row"), F.col("__ids").alias(out_col))


def bpe_decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded", *, leaf: int = 256) -> DataFrame:
    """``df`` with ``out_col`` (binary): the bytes of the ids. Null counts as no ids; an id outside the ranks raises."""
    files = _share_ranks(df, rank_path)
    others = [c for c in df.columns if c != out_col]
    rows = df.select(F.coalesce(quoted(ids_col), F.array().cast("array<int>")).alias("__ids"), carried(df, others).alias("__row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _encoder(files, pattern).encoding.decode_bytes
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                lists = b.column(0)
                offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                out = [decode_tree(flat[lo:hi], decode, leaf) for lo, hi in zip(offs[:-1], offs[1:])]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], names=["__row", "__out"])

    return map_arrow(rows, run, with_row(rows, "__row", "__out binary")).select(*carried_columns(others, "__row"), F.col("__out").alias(out_col))


def bpe_round_trip(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", out_col: str = "decoded", *, leaf: int = 512) -> DataFrame:
    """``df`` with ``ids_col`` as of :func:`bpe_encode` and ``out_col`` as of :func:`bpe_decode` on these ids, in one
    pass of one Python worker. Input columns of these names are replaced."""
    files = _share_ranks(df, rank_path)
    others = [c for c in df.columns if c not in (ids_col, out_col)]
    rows = df.select(F.coalesce(quoted(text_col), F.lit("")).alias("__t"), carried(df, others).alias("__row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(files, pattern)
        for b in slices(batches, "__t", 1 << 20):
            ids = [encode_tree(t, encode, leaf) for t in b.column(0).to_pylist()]
            decoded = pa.array([decode_tree(x, encode.encoding.decode_bytes) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(1), _array_of(ids), decoded], names=["__row", "__ids", "__out"])

    out = map_arrow(rows, run, with_row(rows, "__row", "__ids array<int>, __out binary"))
    return out.select(*carried_columns(others, "__row"), F.col("__ids").alias(ids_col), F.col("__out").alias(out_col))


def token_digests(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` of each row: encoded, then decoded from the ids."""
    found = bpe_round_trip(df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")), rank_path, pattern, **options)
    return found.select(
        F.col("id").alias(id_col),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
