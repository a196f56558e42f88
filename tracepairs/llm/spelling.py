"""Spelling variants: words one edit apart, found by bands of letter-parity bitmasks.

A bit of a word's mask says whether it has a letter an odd number of times. One inserted, deleted or replaced letter flips
at most two bits, so with the bits in three bands two such words agree in one band at least. Words meet where a band and
the length (or the next one) agree; inside such a group masks are compared first (two flipped bits, or one where the lengths
differ), and what is left is verified by the common beginning and end of both words. A group beyond ``group_words`` is split
by halves of its words: one edit leaves the first half or the rest of the shorter word whole. A pair counts where it meets first,
in its first equal band (and first equal half), so no pairs leave a task: only each word's number of near words in the
group and the best of them do.
"""

from __future__ import annotations

import collections
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracepairs.llm.common import join_hot, map_arrow, materialize, quoted, slices

_PIECE = 1 << 22  # characters of a text worked on at once, up to the end of a run
_ENTRIES, _CHARS = 200_000, 1 << 24  # words, and characters of words, that a task counts before it passes them on
_BLOCK = 1 << 22  # pairs of masks compared at once
_CELLS = 1 << 23  # letters compared at once
_BITS = 21  # of each of the three bands
#: Letters from frequent to rare in European languages, dealt to the bands in turn so that these are equally telling.
_FREQUENT_FIRST = "etaoinsrhldcumfpgwybvkxjqz"

_FIRST, _LAST = "À", "ÿ"


def _letter_bits() -> np.ndarray:
    """The bit of each Latin-1 letter: a to z have their own, letters with marks share what is left of each band."""
    bits = np.zeros(256, np.uint64)
    others = [chr(c) for c in range(ord(_FIRST), ord(_LAST) + 1)]
    for i, c in enumerate([*_FREQUENT_FIRST, *others]):
        own = i // 3 if i < 26 else 9 + (i // 3 - 9) % (_BITS - 9)
        bits[ord(c)] = np.uint64(1) << np.uint64(i % 3 * _BITS + own)
    return bits


_LETTER_BITS = _letter_bits()


# --- words and their counts -------------------------------------------------------------------------------


def _pieces(text: str) -> Iterator[str]:
    """Parts of the text that cut no run of letters."""
    gap, lo = re.compile(rf"[^A-Za-z{_FIRST}-{_LAST}]"), 0
    while lo < len(text):
        end = gap.search(text, lo + _PIECE) if lo + _PIECE < len(text) else None
        hi = end.start() if end else len(text)
        yield text[lo:hi]
        lo = hi


def with_slip(run: str, n: int, crc: int, one_in: int, out: collections.Counter) -> None:
    """Adds ``n`` occurrences of a run, without one of its letters if ``one_in`` divides its checksum."""
    h = zlib.crc32(run.encode(), crc)
    if h % one_in == 0:
        at = h % len(run)
        run = run[:at] + run[at + 1 :]
    out[run] += n


def count_words(df: DataFrame, id_col: str, text_col: str, min_length: int, one_in: int) -> DataFrame:
    """``word, n``: how often each word of ``min_length`` letters or more occurs, summed up in each task first."""
    runs = re.compile(rf"[a-z{_FIRST}-{_LAST}]{{{min_length},}}")

    def packed(counts: collections.Counter) -> pa.RecordBatch:
        own = [(w, n) for w, n in counts.items() if len(w) >= min_length]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([n for _, n in own], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, chars = collections.Counter(), 0
        for b in slices(batches, "text", 1 << 20):
            for name, text in zip(b.column(0).to_pylist(), b.column(1)):
                crc = zlib.crc32(f"{'' if name is None else name}:".encode())
                for piece in _pieces(text.as_py() or ""):
                    # bytes are lower-cased from A to Z only
                    for w, n in collections.Counter(runs.findall(piece.encode().lower().decode())).items():
                        before = len(counts)
                        with_slip(w, n, crc, one_in, counts)
                        chars += len(w) if len(counts) > before else 0
                    if len(counts) > _ENTRIES or chars > _CHARS:
                        yield packed(counts)
                        counts, chars = collections.Counter(), 0
        yield packed(counts)

    rows = df.select(quoted(id_col).cast("string").alias("id"), quoted(text_col).alias("text"))
    return map_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- near words -------------------------------------------------------------------------------------------


def masks(words: list[bytes]) -> np.ndarray:
    """Parity masks of Latin-1 words, none empty."""
    flat = _LETTER_BITS[np.frombuffer(b"".join(words), np.uint8)]
    starts = np.cumsum([0, *map(len, words[:-1])])
    return np.bitwise_xor.reduceat(flat, starts) if words else np.empty(0, np.uint64)


def band(mask: np.ndarray, i: int) -> np.ndarray:
    return (mask >> np.uint64(i * _BITS)) & np.uint64((1 << _BITS) - 1)


def _keys(words: DataFrame) -> DataFrame:
    """``word, n, band, value, short``: each word under each of its bands, as the shorter word of a pair (``short`` is its
    length) and as the longer one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "word", 1 << 20, 20_000):
            encoded = [w.encode("latin-1") for w in b.column(0).to_pylist()]
            if not encoded:
                continue
            mask, length = masks(encoded), np.array(list(map(len, encoded)))
            for i in range(3):
                for less in (0, 1):
                    fields = [b.column(0), b.column(1), pa.array(np.full(len(mask), i, np.int8)), pa.array(band(mask, i).astype(np.int32)), pa.array((length - less).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(fields, names=["word", "n", "band", "value", "short"])

    return map_arrow(words, run, "word string, n long, band byte, value int, short int")


def _ends(a: np.ndarray) -> np.ndarray:
    """For each row of flags the number of true ones before the first false one."""
    return np.where(a.all(1), a.shape[1], (~a).argmax(1))


def _verified(left: np.ndarray, right: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j are one edit apart. ``left`` and ``right``: letters of each word at the left and right side of
    a row, 0 elsewhere; words i are not longer than words j."""
    out = np.empty(len(i), bool)
    step = max(1, _CELLS // left.shape[1])
    for lo in range(0, len(i), step):
        a, b = i[lo : lo + step], j[lo : lo + step]
        same = _ends(left[a] == left[b]) + _ends((right[a] == right[b])[:, ::-1])
        m = length[a]
        out[lo : lo + step] = np.where(length[b] > m, same >= m, same == m - 1)
    return out


def near_in_group(words: list[bytes], mask: np.ndarray, which: int, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of near words, and the first of them, of each word of a group (best words first; their number where there is
    none). Pairs that agree in an earlier band, or for ``side`` 1 in the first half too, count elsewhere."""
    size = len(words)
    length = np.array(list(map(len, words)))
    m, width = int(length.min()), int(length.max())
    left, right = np.zeros((size, width), np.uint8), np.zeros((size, width), np.uint8)
    for r, w in enumerate(words):
        left[r, : len(w)] = right[r, width - len(w) :] = np.frombuffer(w, np.uint8)
    count, best = np.zeros(size, np.int64), np.full(size, size)
    shorter = np.flatnonzero(length == m)
    step = max(1, _BLOCK // size)
    for lo in range(0, len(shorter), step):
        rows = shorter[lo : lo + step]
        flipped = mask[rows, None] ^ mask[None, :]
        ok = np.bitwise_count(flipped) <= np.where(length == m, 2, 1)
        ok &= (length > m) | (np.arange(size) > rows[:, None])  # words of one length meet once
        for i in range(which):
            ok &= band(flipped, i) != 0
        a, b = np.nonzero(ok)
        a = rows[a]
        if side == 1:
            other = (left[a, : m // 2] != left[b, : m // 2]).any(1)
            a, b = a[other], b[other]
        near = _verified(left, right, length, a, b)
        a, b = a[near], b[near]
        count += np.bincount(a, minlength=size) + np.bincount(b, minlength=size)
        np.minimum.at(best, a, b)
        np.minimum.at(best, b, a)
    return count, best


_GROUP = ["band", "value", "short", "side", "half"]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n_near, best_n, best`` from rows sorted by group and from best to worst."""
    key, words, counts = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        if len(words) < 2 or min(map(len, words)) > key[2]:
            return  # nothing to meet: two longer words meet as the shorter ones of another group
        n_near, best = near_in_group(words, masks(words), key[0], key[3])
        at = np.flatnonzero(n_near)
        if len(at):
            texts = [w.decode("latin-1") for w in words]
            fields = [[texts[i] for i in at], n_near[at], [counts[best[i]] for i in at], [texts[best[i]] for i in at]]
            yield pa.RecordBatch.from_arrays([pa.array(f) for f in fields], names=["word", "n_near", "best_n", "best"])

    for b in batches:
        own = zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in [*_GROUP, "word", "n"]])
        for *group, w, n in own:
            if group != key:
                yield from done()
                key, words, counts = group, [], []
            words.append(w.encode("latin-1"))
            counts.append(n)
    yield from done()


def near_words(words: DataFrame, group_words: int = 2048, group_chars: int = 1 << 22) -> DataFrame:
    """``word, n_near, best_n, best`` of the words (``word, n``; each once, in letters of Latin-1) that have near ones."""
    keys = materialize(_keys(words), "keys")
    sizes = materialize(keys.groupBy("band", "value", "short").agg(F.count(F.lit(1)).alias("size")), "sizes")
    keys = join_hot(keys, sizes, ["band", "value", "short"], "size").where("size > 1")
    large = (F.col("size") > F.least(F.lit(group_words), F.lit(group_chars) / F.greatest("short", F.lit(1)))) & (F.col("short") > 1)
    half = F.floor(F.col("short") / 2).cast("int")
    first, rest = F.substring("word", F.lit(1), half), F.substring("word", F.length("word") - (F.col("short") - half) + 1, F.col("short") - half)
    one = lambda side, text: F.struct(F.lit(side).alias("side"), text.alias("half"))
    sides = F.when(large, F.array(one(0, F.xxhash64(first)), one(1, F.xxhash64(rest)))).otherwise(F.array(one(0, F.lit(0).cast("long"))))
    keys = keys.select("word", "n", "band", "value", "short", F.explode(sides).alias("s")).select("*", "s.*").drop("s")
    grouped = keys.repartition(*_GROUP).sortWithinPartitions(*_GROUP, F.desc("n"), "word")
    found = map_arrow(grouped, _near, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


# --- forms and roots --------------------------------------------------------------------------------------


def roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """``word, root`` from ``word, form``, none null. A form occurs at least ``ratio`` times as often as its word, so a chain
    has no more than log(most) steps, and each round doubles how many are followed."""
    steps = max(1, math.ceil(math.log(max(most, 2), ratio)))
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(steps)))):
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = materialize(at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return at


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_length: int = 6, min_count: int = 5, ratio: int = 5, one_in: int = 199, group_words: int = 2048
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each word of the texts.

    Words are runs of Latin letters (A to Z, and U+00C0 to U+00FF, which keep their case) of ``min_length`` code points or
    more that occur ``min_count`` times or more. A run loses one letter in one of ``one_in`` documents, by the checksum of its
    document's id (null: empty) and the run; a text's copies under other ids lose others. Two words are near if one inserted,
    deleted or replaced letter leads from one to the other. ``form``: the near word with the largest n (of equal ones the
    first by code points) if that is ``ratio`` times the word's n or more, else null with ``form_n``. ``root``: the end of the
    chain of forms, the word itself without one. Rows that repeat an id, or id and text, count each. Null and empty texts have no
    words; without words the result is empty.
    """
    if min_length < 1 or ratio < 2:
        raise ValueError("words of one letter at least, forms twice as frequent at least")
    words = materialize(count_words(df, id_col, text_col, min_length, one_in).where(F.col("n") >= min_count), "words")
    near = near_words(words, group_words)
    joined = words.join(near, "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    judged = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    judged = materialize(judged, "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(judged.where("form IS NOT NULL").select("word", "form"), most, ratio)
    return judged.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
