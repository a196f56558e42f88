"""Baseline motion-JPEG frames in numpy: many frames are entropy-(de)coded in lockstep, one symbol a step.

The writer stores one 8-bit sample per 8x8 block: the block is flat, its DC coefficient (quantiser 8) is the
sample less 128, so any baseline decoder shows the sample and nothing is lost. The reader takes baseline
frames in general: one or three components with subsampling, AC coefficients, restart intervals, frames
without Huffman tables (the usual ones of the standard then hold).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Fixed values of the JPEG standard (Annex K): code counts by length, then symbols.
_DC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
_DC_CHROMA_BITS = [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]
_DC_SYMBOLS = list(range(12))
_AC_BITS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
_AC_FIRST = "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a"
_AC_CHROMA_BITS = [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]
_AC_CHROMA_FIRST = "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"


def _with_rest(first: str, sizes: int = 10) -> list[int]:
    """The listed symbols, then all others (run, size 1 to 10) in order, which share the longest codes."""
    symbols = [int(x, 16) for x in first.split()]
    return symbols + sorted({run << 4 | size for run in range(16) for size in range(1, sizes + 1)} - set(symbols))


ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_CHUNK = 8  # pixels a side of a block


def _codes(bits: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for length, count in enumerate(bits, 1):
        for symbol in symbols[at : at + count]:
            out[symbol] = (code, length)
            code += 1
        at, code = at + count, code << 1
    return out


def _lookup(bits: list[int], symbols: list[int]) -> np.ndarray:
    """For each 16-bit window: symbol << 5 | code length; 0 where no code matches."""
    lut = np.zeros(1 << 16, np.int32)
    for symbol, (code, length) in _codes(bits, symbols).items():
        lut[code << (16 - length) : (code + 1) << (16 - length)] = symbol << 5 | length
    return lut


# --- writing -----------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(width: int, height: int) -> bytes:
    """Up to the entropy-coded data: grey, quantiser 8 throughout, one AC code (end of block, one bit)."""
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\0" + bytes([8]) * 64),
        _segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x01\x11\x00"),
        _segment(0xC4, b"\x00" + bytes(_DC_BITS) + bytes(_DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00"),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


def _sample_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 to 255, end of block included."""
    codes, word, length = _codes(_DC_BITS, _DC_SYMBOLS), [], []
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, n = codes[size]
        extra = diff if diff > 0 else diff + (1 << size) - 1
        word.append((code << size | extra) << 1)
        length.append(n + size + 1)
    return np.array(word, np.int64), np.array(length, np.int64)


_WORD, _LENGTH = _sample_codes()


def encode_frames(samples: np.ndarray, side: int = 24) -> list[bytes]:
    """One JPEG for each row of ``samples`` (n, side * side), uint8."""
    n, per = samples.shape
    if not n:
        return []
    diff = np.diff(samples.astype(np.int64), axis=1, prepend=128) + 255
    length = _LENGTH[diff]
    end = np.cumsum(length, axis=1)
    size = (end[:, -1] + 7) // 8
    base = np.concatenate([[0], np.cumsum(size)])
    bit = (base[:-1, None] * 8 + end - length).ravel()
    length, word = length.ravel(), _WORD[diff].ravel()
    word = word << (24 - (bit & 7) - length)
    total, at = int(base[-1]), bit >> 3
    data = np.zeros(total + 3)
    for k in range(3):  # bits of different codes never overlap, so sums are unions
        data[k : k + total] += np.bincount(at, weights=(word >> (16 - 8 * k)) & 255, minlength=total)[:total]
    data = data[:total].astype(np.uint8)
    pad = (-end[:, -1]) % 8
    data[base[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    stuffed = np.flatnonzero(data == 0xFF)
    base = base + np.searchsorted(stuffed, base)
    out = np.insert(data, stuffed + 1, 0).tobytes()
    head = _header(side * _CHUNK, side * _CHUNK)
    return [head + out[lo:hi] + b"\xff\xd9" for lo, hi in zip(base[:-1].tolist(), base[1:].tolist())]


# --- reading -----------------------------------------------------------------------------------------


@dataclass
class Frame:
    """What a header says. ``pattern``: for each block of an MCU its component; ``tables``: (dc, ac) lookups."""

    width: int
    height: int
    pattern: list[int]
    mcus: int
    restart: int
    luma: tuple[int, int]
    luma_quantiser: np.ndarray
    lut: np.ndarray


def parse_header(head: bytes) -> Frame:
    """ValueError for what is not baseline."""
    quant, huff, restart, p = {}, {}, 0, 2
    size = comps = None
    while p + 4 <= len(head):
        marker, n = head[p + 1], int.from_bytes(head[p + 2 : p + 4], "big")
        body = head[p + 4 : p + 2 + n]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                raw = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                quant[body[0] & 15], body = raw.astype(np.int64), body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                k = sum(body[1:17])
                huff[body[0]], body = _lookup(list(body[1:17]), list(body[17 : 17 + k])), body[17 + k :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("not 8 bits a sample")
            size = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
            comps = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not a baseline frame")
        elif marker == 0xDA:
            if comps is None or body[0] != len(comps) or 0 in size:
                raise ValueError("no frame header, or several scans")
            standard = {0x00: (_DC_BITS, _DC_SYMBOLS), 0x01: (_DC_CHROMA_BITS, _DC_SYMBOLS), 0x10: (_AC_BITS, _with_rest(_AC_FIRST)), 0x11: (_AC_CHROMA_BITS, _with_rest(_AC_CHROMA_FIRST))}
            pattern, lut, chosen = [], [], [body[1 + 2 * i : 3 + 2 * i] for i in range(body[0])]
            single = len(chosen) == 1
            for i, (c, t) in enumerate(chosen):
                h, v, _ = comps[c]
                pattern += [i] * (1 if single else h * v)
                for key in (t >> 4, 0x10 | t & 15):
                    lut.append(huff[key] if key in huff else _lookup(*standard[key]))
            h, v = (1, 1) if single else (max(x[0] for x in comps.values()), max(x[1] for x in comps.values()))
            mcus = -(-size[0] // (8 * h)) * -(-size[1] // (8 * v))
            first = comps[chosen[0][0]]
            return Frame(*size, pattern, mcus, restart, (1, 1) if single else first[:2], quant[first[2]], np.concatenate(lut))
        p += 2 + n
    raise ValueError("no scan")


def _scan_start(jpeg: bytes) -> int:
    p = 2
    while jpeg[p] == 0xFF and jpeg[p + 1] != 0xDA:
        p += 2 + int.from_bytes(jpeg[p + 2 : p + 4], "big")
    if jpeg[p] != 0xFF:
        raise ValueError("broken marker")
    return p + 2 + int.from_bytes(jpeg[p + 2 : p + 4], "big")


def _lockstep(scans: list[bytes], blocks: np.ndarray, frame: Frame, coefficients: bool):
    """DC values (lane, block) before dequantising, coefficients if wanted, and which lanes were read well."""
    lanes, most, per = len(scans), int(blocks.max()), len(frame.pattern)
    flat = np.frombuffer(b"".join(scans), np.uint8)
    size = np.array([len(s) for s in scans])
    start = np.concatenate([[0], np.cumsum(size)])
    stuffed = np.flatnonzero((flat[1:] == 0) & (flat[:-1] == 0xFF)) + 1
    flat = np.delete(flat, stuffed)
    start = start - np.searchsorted(stuffed, start)
    padded = np.concatenate([flat, np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(flat) + 1, np.uint64)
    for k in range(8):
        window |= padded[k : k + len(window)] << np.uint64(56 - 8 * k)
    dc = np.zeros((lanes, most), np.int32)
    full = np.zeros((lanes, most, 64), np.int16) if coefficients else None
    pattern, n_comps = np.array(frame.pattern), max(frame.pattern) + 1
    predicted = np.zeros((lanes, n_comps), np.int64)
    ok = np.ones(lanes, bool)
    lane = np.arange(lanes)
    bit, end = start[:-1] * 8, start[1:] * 8
    block, k = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    while len(lane):
        comp = pattern[block % per] if per > 1 else 0
        w = window[np.minimum(bit >> 3, len(flat))] << (bit & 7).astype(np.uint64)
        entry = frame.lut[((comp * 2 + (k > 0)) << 16) + (w >> np.uint64(48)).astype(np.int64)]
        length, symbol = entry & 31, entry >> 5
        bits = np.where(k > 0, symbol & 15, symbol)
        extra = ((w << length.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) >> (32 - bits)
        value = np.where(bits == 0, 0, np.where(extra >> np.maximum(bits - 1, 0) == 0, extra - (1 << bits) + 1, extra))
        bit = bit + length + bits
        bad = (length == 0) | (bit > end) | (bits > 15)
        first = k == 0
        if first.any():
            f_lane, f_comp = lane[first], comp[first] if per > 1 else 0
            predicted[f_lane, f_comp] += value[first]
            dc[f_lane, block[first]] = predicted[f_lane, f_comp]
        run = symbol >> 4
        to = np.where(first, 0, k + run)
        ended = ~first & (bits == 0) & (run != 15)
        bad |= to > 63
        if coefficients:
            put = ~first & (bits > 0) & ~bad
            full[lane[put], block[put], ZIGZAG[to[put]]] = value[put]
        k = to + 1
        done = ended | (k > 63)
        block, k = block + done, np.where(done, 0, k)
        ok[lane[bad]] = False
        go = ~bad & (block < blocks[lane])
        if not go.all():
            lane, bit, end, block, k = lane[go], bit[go], end[go], block[go], k[go]
    if coefficients:
        full[:, :, 0] = dc
    return dc, full, ok


def _groups(jpegs: list[bytes]) -> Iterator[tuple[Frame | None, list[int], list[bytes]]]:
    """Frames of equal headers together; None for those that cannot be read."""
    by_head: dict[bytes, tuple[list[int], list[bytes]]] = {}
    broken = []
    for i, jpeg in enumerate(jpegs):
        try:
            at = _scan_start(jpeg)
            stop = jpeg.rfind(b"\xff\xd9")
            who, scans = by_head.setdefault(jpeg[:at], ([], []))
            who.append(i)
            scans.append(jpeg[at : stop if stop >= at else len(jpeg)])
        except (ValueError, IndexError):
            broken.append(i)
    for head, (who, scans) in by_head.items():
        try:
            if head[:2] != b"\xff\xd8":
                raise ValueError("no start of image")
            yield parse_header(head), who, scans
        except (ValueError, IndexError, KeyError):
            broken += who
    if broken:
        yield None, broken, []


def _read(frame: Frame, scans: list[bytes], coefficients: bool):
    """(frames, blocks) in coding order over restart segments, and which frames were read well."""
    per, n = len(frame.pattern), frame.mcus * len(frame.pattern)
    if not frame.restart:
        return _lockstep(scans, np.full(len(scans), n), frame, coefficients)
    each = frame.restart * per
    segments = -(-n // each)
    lanes, ok = [], np.ones(len(scans), bool)
    for i, scan in enumerate(scans):
        cuts = [p for p in range(len(scan) - 1) if scan[p] == 0xFF and 0xD0 <= scan[p + 1] <= 0xD7]
        parts = [scan[a:b] for a, b in zip([0, *[c + 2 for c in cuts]], [*cuts, len(scan)])]
        ok[i] = len(parts) == segments
        lanes += (parts + [b""] * segments)[:segments]
    blocks = np.tile(np.minimum(each, n - each * np.arange(segments)), len(scans))
    dc, full, good = _lockstep(lanes, blocks, frame, coefficients)
    ok &= good.reshape(len(scans), segments).all(axis=1)
    shape = (len(scans), segments * each)
    return dc.reshape(shape)[:, :n], None if full is None else full.reshape(*shape, 64)[:, :n], ok


def luma_samples(jpegs: list[bytes]) -> list[np.ndarray | None]:
    """Means of the luma blocks of each frame as uint8, in coding order (the picture at an eighth of its size);
    None for a frame that cannot be read."""
    out: list[np.ndarray | None] = [None] * len(jpegs)
    for frame, who, scans in _groups(jpegs):
        if frame is None:
            continue
        dc, _, ok = _read(frame, scans, False)
        luma = np.tile(np.array(frame.pattern) == 0, frame.mcus)
        q = int(frame.luma_quantiser[0])
        mean = np.clip((dc[:, luma].astype(np.int64) * q + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        for i, row, good in zip(who, mean, ok):
            out[i] = row if good else None
    return out


_X = np.arange(8)
_DCT = np.sqrt(np.where(_X == 0, 1, 2) / 8)[:, None] * np.cos((2 * _X + 1) * _X[:, None] * np.pi / 16)


def luma_pixels(jpegs: list[bytes]) -> list[np.ndarray | None]:
    """Whole luma pictures (height, width), uint8; None for a frame that cannot be read."""
    out: list[np.ndarray | None] = [None] * len(jpegs)
    for frame, who, scans in _groups(jpegs):
        if frame is None:
            continue
        _, full, ok = _read(frame, scans, True)
        luma = np.tile(np.array(frame.pattern) == 0, frame.mcus)
        quant = np.zeros(64, np.int64)
        quant[ZIGZAG] = frame.luma_quantiser
        blocks = (full[:, luma] * quant).reshape(len(who), -1, 8, 8)
        pixels = np.clip(np.rint(_DCT.T @ blocks @ _DCT) + 128, 0, 255).astype(np.uint8)
        h, v = frame.luma
        wide = -(-frame.width // (8 * h)) if len(frame.pattern) > 1 else -(-frame.width // 8)
        # (frame, mcu row, mcu column, v, h, y, x) -> (frame, y, x)
        grid = pixels.reshape(len(who), -1, wide, v, h, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6)
        grid = grid.reshape(len(who), grid.shape[1] * v * 8, wide * h * 8)
        for i, picture, good in zip(who, grid, ok):
            out[i] = picture[: frame.height, : frame.width] if good else None
    return out
