"""Media columns of AVI motion-JPEG: RIFF indexes, intra frames, shots by adaptive histogram differences."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracepairs.llm.common import carried, carried_columns, map_arrow, quoted, raw, slices, with_row
from tracepairs.llm.mjpeg import encode_frames, luma_pixels, luma_samples

SIDE = 24
FRAME_BYTES = SIDE * SIDE
CLIP = "struct<clip int, first_frame int, end_frame int, start_s double, end_s double>"


# --- RIFF ----------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = 25) -> bytes:
    """An AVI file of one MJPG stream with an ``idx1`` index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    parts, index, at = [b"movi"], [], 4
    for f in frames:
        parts.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    body = b"AVI " + hdrl + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


@dataclass
class Avi:
    fps: float = 0.0
    width: int = 0
    height: int = 0
    frames: list[tuple[int, int]] = field(default_factory=list)  # offset and length
    error: str | None = None


def parse_avi(data: bytes | memoryview) -> Avi:
    """Where the video frames of the first stream are: by OpenDML standard indexes, else by ``idx1``, else by
    a walk over ``movi``. Damage gives an ``error`` and what could be found."""
    out, tops, index, standard, super_index = Avi(), [], None, [], []
    data = bytes(data)
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        out.error = "not an AVI file"
        return out

    def walk(lo: int, hi: int, depth: int = 0) -> None:
        nonlocal index
        while lo + 8 <= hi:
            name, n = data[lo : lo + 4], int.from_bytes(data[lo + 4 : lo + 8], "little")
            body, end = lo + 8, lo + 8 + n
            if end > hi:
                out.error, end = f"chunk cut short at byte {lo}", hi
            if name in (b"RIFF", b"LIST"):
                kind = data[body : body + 4]
                if kind == b"movi":
                    tops.append((body, end))
                elif depth < 4:
                    walk(body + 4, end, depth + 1)
            elif name == b"avih" and n >= 40:
                micro, _, _, _, _, _, _, _, out.width, out.height = struct.unpack_from("<10I", data, body)
                out.fps = out.fps or (1e6 / micro if micro else 0.0)
            elif name == b"strh" and n >= 28 and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                out.fps = rate / scale if scale and rate else out.fps
            elif name == b"indx" and n >= 24 and data[body + 3] == 0:
                super_index.extend(struct.unpack_from("<QII", data, body + 24 + 16 * i)[:2] for i in range(min(struct.unpack_from("<I", data, body + 4)[0], (n - 24) // 16)))
            elif name == b"idx1":
                index = (body, min(n, end - body) // 16)
            lo = end + (n & 1)

    walk(0, len(data))
    for at, _ in super_index:  # 'ix00': base offset, then (offset, size) of the bodies
        if at + 32 <= len(data) and data[at : at + 2] == b"ix":
            n, _, base = struct.unpack_from("<I4sQ", data, at + 12)
            if at + 32 + 8 * n <= len(data):
                standard += [(base + o, s & 0x7FFFFFFF) for o, s in struct.iter_unpack("<II", data[at + 32 : at + 32 + 8 * n])]
    if standard:
        found = standard
    elif index and tops:
        found, (body, n), movi = [], index, tops[0][0]
        for name, _, at, size in struct.iter_unpack("<4sIII", data[body : body + 16 * n]):
            if name[2:] in (b"dc", b"db"):
                base = 0 if not found and data[at : at + 4] == name and data[movi + at : movi + at + 4] != name else movi
                found.append((base + at + 8, size))
        if found and data[found[0][0] - 8 : found[0][0] - 4][2:] not in (b"dc", b"db"):
            found = _walk_movi(data, tops)
    else:
        found = _walk_movi(data, tops)
    out.frames = [(o, s) for o, s in found if s and o + s <= len(data)]
    if len(out.frames) < sum(1 for _, s in found if s):
        out.error = out.error or "frames beyond the end of the file"
    return out


def _walk_movi(data: bytes, tops: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found = []
    for lo, hi in tops:
        lo += 4
        while lo + 8 <= hi:
            name, n = data[lo : lo + 4], int.from_bytes(data[lo + 4 : lo + 8], "little")
            if name == b"LIST":
                lo += 12  # into 'rec '
                continue
            if name[2:] in (b"dc", b"db") and lo + 8 + n <= hi:
                found.append((lo + 8, n))
            lo += 8 + n + (n & 1)
    return found


# --- shots -----------------------------------------------------------------------------------------------


def shot_starts(histograms: np.ndarray, first: np.ndarray, *, window: int = 8, ratio: int = 2, floor: float = 0.25) -> np.ndarray:
    """True where a shot starts. ``histograms`` (frames, bins) holds counts, ``first`` marks the first frames of files.

    A cut needs a difference to the frame before of at least ``floor`` of what is possible, and of ``ratio`` times
    the mean of the up to ``window`` differences before it in the same file.
    """
    n = len(histograms)
    start = first.copy()
    if n < 2:
        return start
    h = histograms.astype(np.int64)
    diff = np.zeros(n, np.int64)
    diff[1:] = np.abs(h[1:] - h[:-1]).sum(axis=1)
    diff[first] = 0
    most = h.sum(axis=1) + np.concatenate([[0], h[:-1].sum(axis=1)])
    total = np.concatenate([[0], np.cumsum(diff)])
    i = np.arange(n)
    file_at = np.maximum.accumulate(np.where(first, i, 0))
    lo = np.maximum(file_at + 1, i - window)
    seen = np.maximum(i - lo, 0)
    before = total[i] - total[np.minimum(lo, i)]
    return start | (~first & (diff >= floor * most) & (diff * seen >= ratio * before))


_BINS = 16


def _histograms(samples: list[np.ndarray]) -> np.ndarray:
    """Counts of the samples of each frame in equal bins."""
    size = np.array([len(s) for s in samples])
    flat = np.concatenate(samples) >> 4
    key = np.repeat(np.arange(len(samples)) * _BINS, size) + flat
    return np.bincount(key, minlength=len(samples) * _BINS).reshape(-1, _BINS)


# --- columns -----------------------------------------------------------------------------------------------


def _carried(df: DataFrame, column: str, default, made: list[str]) -> DataFrame:
    """``column`` (null: ``default``) and all other columns that do not clash with ``made`` as one struct."""
    kept = [c for c in df.columns if c not in made]
    return df.select(F.coalesce(quoted(column), default).alias("__in"), carried(df, kept).alias("__row"))


def _flat(out: DataFrame, df: DataFrame, made: list[str]) -> DataFrame:
    return out.select(*carried_columns([c for c in df.columns if c not in made], "__row"), *map(quoted, made))


def payload_bytes(n: int) -> int:
    """Length of a payload of ``n`` bytes once filled up to whole frames, one at least."""
    return max(1, -(-n // FRAME_BYTES)) * FRAME_BYTES


def text_to_avi(df: DataFrame, text_col: str = "text", out_col: str = "media", fps: int = 25) -> DataFrame:
    """``df`` with ``out_col``: an AVI file whose frames hold the UTF-8 bytes of the text as 8-bit samples.

    Filled up with bytes 255 to whole frames of 24 x 24 samples, one at least. Null texts count as empty.
    A column of the name ``out_col`` is replaced. No shuffle; a task holds one slice of texts at a time.
    """
    made = [out_col]
    rows = _carried(df, text_col, F.lit(""), made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__in", 1 << 20, 4000):
            data, offs = raw(b.column(0))
            size = np.array([payload_bytes(n) for n in np.diff(offs).tolist()])
            at = np.concatenate([[0], np.cumsum(size)])
            flat = np.full(at[-1], 255, np.uint8)
            flat[np.repeat(at[:-1] - offs[:-1], np.diff(offs)) + np.arange(len(data))] = data
            frames = encode_frames(flat.reshape(-1, FRAME_BYTES), SIDE)
            cut = at // FRAME_BYTES
            files = [write_avi(frames[lo:hi], SIDE * 8, SIDE * 8, fps) for lo, hi in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(files, pa.binary())], names=["__row", "__out"])

    return _flat(map_arrow(rows, run, with_row(rows, "__row", "__out binary")).withColumnRenamed("__out", out_col), df, made)


DECODED = ["n_frames", "bad_frames", "fps", "samples", "clips", "error"]


def decode_avi(df: DataFrame, media_col: str = "media", *, keep_media: bool = True) -> DataFrame:
    """``df`` with ``n_frames, bad_frames, fps, samples, clips, error`` (columns of these names are replaced).

    ``samples``: luma at an eighth of the size, frame after frame. ``clips``: the shots, numbered from 0 with
    frame ranges and times. A frame that cannot be decoded counts in ``bad_frames`` and stands for its
    predecessor (at the start: for a black one) without samples. Null, empty and foreign bytes give no frames, no
    clips and an ``error``. Files of one slice are decoded together; a task holds one slice at a time.
    """
    kept = df if keep_media else df.drop(media_col)
    rows = _carried(df, media_col, F.lit(b""), DECODED if keep_media else [*DECODED, media_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__in", 4 << 20, 4000):
            blobs = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(0)]
            files = [parse_avi(x) for x in blobs]
            count = [len(f.frames) for f in files]
            found = luma_samples([x[o : o + s] for x, f in zip(blobs, files) for o, s in f.frames])
            cut = np.concatenate([[0], np.cumsum(count)]).tolist()
            starts = _shots(found, cut)
            out = []
            for f, lo, hi in zip(files, cut[:-1], cut[1:]):
                own = [s for s in found[lo:hi] if s is not None]
                at = [int(x) for x in np.flatnonzero(starts[lo:hi])]
                fps = f.fps or 1.0
                clips = [{"clip": i, "first_frame": a, "end_frame": e, "start_s": a / fps, "end_s": e / fps} for i, (a, e) in enumerate(zip(at, [*at[1:], hi - lo]))]
                samples = np.concatenate(own).tobytes() if own else b""
                out.append((hi - lo, hi - lo - len(own), f.fps, samples, clips, f.error or (None if hi > lo else "no frames")))
            clip_type = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
            types = [pa.int32(), pa.int32(), pa.float64(), pa.binary(), clip_type, pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array(c, t) for c, t in zip(zip(*out), types)]], names=["__row", *DECODED])

    schema = with_row(rows, "__row", f"n_frames int, bad_frames int, fps double, samples binary, clips array<{CLIP}>, error string")
    return _flat(map_arrow(rows, run, schema), kept, DECODED)


FRAME = ["frame", "width", "height", "luma"]


def decode_frames(df: DataFrame, media_col: str = "media", *, batch_pixels: int = 8 << 20) -> DataFrame:
    """One row per frame of the AVI files: the other columns of ``df``, then ``frame`` (from 0), ``width, height`` and
    ``luma``, the whole picture row by row as 8-bit samples (all null for a frame that cannot be decoded).

    Input columns of these names are replaced. Null, empty and foreign bytes give no rows. Frames leave a task in batches of
    about ``batch_pixels``, one frame at least.
    """
    kept = df.drop(media_col)
    rows = _carried(df, media_col, F.lit(b""), [*FRAME, media_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(0)[i].as_buffer().to_pybytes()
                avi = parse_avi(data)
                step = max(1, batch_pixels // max(1, avi.width * avi.height))
                for lo in range(0, len(avi.frames), step):
                    found = luma_pixels([data[o : o + s] for o, s in avi.frames[lo : lo + step]])
                    shape = [(None, None, None) if x is None else (x.shape[1], x.shape[0], x.tobytes()) for x in found]
                    wide, high, luma = zip(*shape)
                    own = b.column(1).take(pa.array([i] * len(found)))
                    at = pa.array(range(lo, lo + len(found)), pa.int32())
                    yield pa.RecordBatch.from_arrays([own, at, pa.array(wide, pa.int32()), pa.array(high, pa.int32()), pa.array(luma, pa.binary())], names=["__row", *FRAME])

    schema = with_row(rows, "__row", "frame int, width int, height int, luma binary")
    return _flat(map_arrow(rows, run, schema), kept, FRAME)


def _shots(found: list[np.ndarray | None], cut: list[int]) -> np.ndarray:
    if not found:
        return np.zeros(0, bool)
    first = np.zeros(len(found), bool)
    first[[c for c, d in zip(cut[:-1], cut[1:]) if d > c]] = True
    filled, last = [], np.zeros(1, np.uint8)
    for s, new in zip(found, first):
        last = s if s is not None else (np.zeros(1, np.uint8) if new else last)
        filled.append(last)
    return shot_starts(_histograms(filled), first)


def clip_rows(decoded: DataFrame) -> DataFrame:
    """One row per clip of :func:`decode_avi`'s result: its other columns, then the clip's."""
    others = [c for c in decoded.columns if c not in DECODED]
    return decoded.select(*others, F.explode("clips").alias("__clip")).select(*others, "__clip.*")


def feature(n_frames, clips):
    """``frames:first-end,first-end,...`` as one string."""
    return F.concat_ws(":", n_frames.cast("string"), F.array_join(F.transform(clips, lambda c: F.concat_ws("-", c["first_frame"], c["end_frame"])), ","))
