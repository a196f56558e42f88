"""Benchmark decontamination by winnowing.

A text is the sequence of its words. Of the hashes of all k-grams (k words) the least one in each sliding window of
``window - k + 1`` k-grams is its fingerprint there (of equal ones the last), so every span of ``window`` words that two
texts share holds a fingerprint that both keep at the same place. Fingerprints of the benchmark go into a bitmap of bounded
size, which each task has: fingerprints of documents are met in it where they are made, and nothing else of a clean
document moves. A hit is extended to the windows of ``window`` words around it; those that the bitmap also knows are
joined with the benchmark's windows by 128 bits, which settles what the bitmap let through by chance. Items of fewer
words are one window of their own length, for which every n-gram of that length is a fingerprint.

Windows that stand in the same items are one class, and documents that hit the same classes share one list of items, so
that a passage in many documents and many items is not paired document by item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tracepairs.llm.common import BROADCAST_ROWS, join_hot, map_arrow, materialize, mix, prefix_hash, quoted, raw, slices, span_hash, whole_row

_STEP = 1 << 18  # words, or bytes of text, worked on at once
_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IS_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_HITS = ArrayType(StructType().add("h1", "long").add("h2", "long").add("len", "integer").add("starts", ArrayType(IntegerType())))


# --- words and fingerprints of a batch ----------------------------------------------------------------------


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (one more entry than texts).

    Words are runs of digits, letters a to z (A to Z lower-cased) and characters beyond ASCII, whose bytes are all 128 or more.
    """
    data = np.insert(_LOWER[data], offs[1:], 0)  # no word goes on in the next text
    offs = offs + np.arange(len(offs))
    inside = _IS_WORD[data]
    change = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    hashes, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):  # in steps: hashing takes 24 bytes for each byte
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (_STEP << 2), "right")))
        at = starts[lo]
        hashes[lo:hi] = span_hash(prefix_hash(data[at : ends[hi - 1]]), starts[lo:hi] - at, ends[lo:hi] - at)
        lo = hi
    return hashes, np.searchsorted(starts, offs)


def grams(h: np.ndarray, at: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hashes of the ``length`` words from each place ``at``."""
    factors = mix(np.arange(length, dtype=np.uint64) + np.uint64((length << 8) + (salt << 20))) | np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for j, f in enumerate(factors):
        out += h[at + j] * f
    return mix(out)


def full(last: np.ndarray, length: int) -> np.ndarray:
    """Places from which ``length`` words of the same text follow; ``last``: where the text of a place ends."""
    at = np.arange(len(last))
    return at[at + length <= last]


def winnow(h: np.ndarray, starts: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the fingerprints of the windows of ``window`` words that begin at ``starts`` (rising)."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    made = np.zeros(len(h), np.uint64)
    at = np.flatnonzero(np.convolve(np.bincount(starts, minlength=len(h)), np.ones(window - k + 1, np.int64))[: len(h)])
    made[at] = grams(h, at, k)
    best, least = starts.copy(), made[starts]
    for j in range(1, window - k + 1):
        new = made[starts + j]
        take = new <= least
        best[take], least[take] = starts[take] + j, new[take]
    places = np.unique(best)
    return places, made[places]


def _last(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(bounds[1:], np.diff(bounds))


# --- the benchmark's side -----------------------------------------------------------------------------------


def benchmark_marks(items: DataFrame, id_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """``h1, h2, len, item``: the windows of all items (128 bits), and their fingerprints (``len`` 0, no item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            h, bounds = word_hashes(*raw(b.column(b.schema.get_field_index("text"))))
            n, last = np.diff(bounds), _last(bounds)
            short = (n > 0) & (n < window)
            starts = full(last, window)
            owner = np.repeat(np.arange(len(n)), n)
            parts = [(starts, window)] + [(bounds[:-1][short & (n == m)], m) for m in range(1, window)]
            _, prints = winnow(h, starts, window, k)
            at = np.concatenate([owner[p] for p, _ in parts])
            h1 = np.concatenate([*[grams(h, p, m, 1) for p, m in parts], prints])
            h2 = np.concatenate([*[grams(h, p, m, 2) for p, m in parts], np.zeros(len(prints), np.uint64)])
            length = np.concatenate([np.full(len(p), m, np.int32) for p, m in parts] + [np.zeros(len(prints), np.int32)])
            item = b.column(b.schema.get_field_index("item")).take(pa.array(np.concatenate([at, np.zeros(len(prints), np.int64)])))
            item = pa.array(np.where(length > 0, item.to_numpy(zero_copy_only=False), None), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(length), item], names=["h1", "h2", "len", "item"])

    rows = items.select(F.coalesce(quoted(id_col).cast("string"), F.lit("")).alias("item"), quoted(text_col).alias("text"))
    return map_arrow(rows, run, "h1 long, h2 long, len int, item string").distinct()


def bitmap(marks: DataFrame, max_bits: int) -> np.ndarray:
    """Two cells of each mark set, in 16 to 32 cells for each mark, ``max_bits`` (a power of two) at most."""
    bits = min(max_bits, max(1 << 16, 1 << (16 * marks.count()).bit_length()))
    cell = F.explode(F.array(F.col("h1").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h1", 32).bitwiseAND(F.lit(bits - 1)))).alias("cell")
    blocks = marks.select(cell).groupBy(F.shiftright("cell", 15).alias("block"))
    blocks = blocks.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell % 32768 + 1))").alias("bits"))
    out = np.zeros(bits >> 3, np.uint8)
    for r in blocks.toLocalIterator():  # max_bits / 8 bytes at most
        out[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(bits) * 8 - 1)
    out = np.ones(len(h), bool)
    for cell in (h & mask, (h >> np.uint64(32)) & mask):
        out &= (bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


# --- the documents' side ------------------------------------------------------------------------------------


def possible_hits(h: np.ndarray, bounds: np.ndarray, bits: np.ndarray, window: int, k: int, short: list[int]) -> tuple[np.ndarray, ...]:
    """``start, length, h1, h2`` of windows of the texts that the bitmap knows."""
    found, last = [], _last(bounds)
    for lo in range(0, len(h), _STEP):
        own, ends = h[lo : lo + _STEP + window - 1], last[lo : lo + _STEP + window - 1] - lo
        starts = full(ends, window)
        starts = starts[starts < _STEP]
        places, prints = winnow(own, starts, window, k)
        places = places[_known(bits, prints)]
        around = np.zeros(len(own) + 1, np.int64)  # a window around a place begins at most window - k before it
        np.add.at(around, np.maximum(places - (window - k), 0), 1)
        np.add.at(around, places + 1, -1)
        jobs = [(starts[np.cumsum(around)[starts] > 0], window)]
        for m in short:
            at = full(ends, m)
            jobs.append((at[at < _STEP], m))
        for at, m in jobs:
            h1 = grams(own, at, m, 1)
            keep = _known(bits, h1)
            at, h1 = at[keep], h1[keep]
            found.append((at + lo, np.full(len(at), m, np.int32), h1, grams(own, at, m, 2)))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.empty(0, t) for t in (np.int64, np.int32, np.uint64, np.uint64))


def _hit_lists(start: np.ndarray, length: np.ndarray, h1: np.ndarray, h2: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One list of (h1, h2, len, starts) for each text; starts count from the text's first word."""
    doc = np.searchsorted(bounds, start, "right") - 1
    order = np.lexsort((start, h2, h1, length, doc))
    start, length, h1, h2, doc = (x[order] for x in (start, length, h1, h2, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (length[1:] != length[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)
    starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array((start - bounds[doc]).astype(np.int32)))
    fields = [pa.array(h1[first].view(np.int64)), pa.array(h2[first].view(np.int64)), pa.array(length[first]), starts]
    one = pa.StructArray.from_arrays(fields, names=["h1", "h2", "len", "starts"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[first], np.arange(len(bounds))).astype(np.int32)), one)


def document_hits(rows: DataFrame, bits: np.ndarray, window: int, k: int, short: list[int]) -> DataFrame:
    """``rid, id, n_words, hits`` for each row (``id, text``): windows that the bitmap knows. ``rid`` numbers the rows; write the result
    before it is used twice."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for b in slices(batches, "text", 1 << 20):
            h, bounds = word_hashes(*raw(b.column(b.schema.get_field_index("text"))))
            hits = _hit_lists(*possible_hits(h, bounds, shared.value, window, k, short), bounds)
            ids = pa.array(np.arange(rid, rid + b.num_rows))
            rid += b.num_rows
            yield pa.RecordBatch.from_arrays([ids, b.column(b.schema.get_field_index("id")), pa.array(np.diff(bounds)), hits], names=["rid", "id", "n_words", "hits"])

    return map_arrow(rows, run, StructType().add("rid", "long").add("id", rows.schema["id"].dataType).add("n_words", "long").add("hits", _HITS))


def _covered() -> Column:
    """Words in any of the spans (start, end), sorted by start."""
    zero = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n"))

    def add(acc, s):
        new = F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["reach"]))
        return F.struct(F.greatest(acc["reach"], s["end"]).alias("reach"), (acc["n"] + new).alias("n"))

    return F.aggregate(F.array_sort(F.flatten(F.collect_list("spans"))), zero, add, lambda a: a["n"])


def _judged(rows: DataFrame, items: DataFrame, item_col: str, item_text_col: str, *, window: int = 10, k: int = 5, max_bits: int = 1 << 27, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``id, n_words, n_hit, items`` for each of ``rows`` (``id, text``; the id may be of any type)."""
    marks = materialize(benchmark_marks(items, item_col, item_text_col, window, k), "marks")
    windows = marks.where("len > 0")
    bits = bitmap(marks, max_bits)
    short = sorted(r[0] for r in windows.where(F.col("len") < window).select("len").distinct().collect())
    found = materialize(document_hits(rows, bits, window, k, short), "hits")
    flagged = found.where(F.size("hits") > 0)

    # windows in the same items are one class: the sums of two hashes of their items, and their number, are equal
    sums = [F.sum(F.xxhash64(F.lit(s), F.col("item")).cast("decimal(38,0)")) for s in (1, 2)]
    by_window = windows.groupBy("h1", "h2").agg(F.md5(F.concat_ws(":", F.count(F.lit(1)), *sums)).alias("class"))
    by_window = materialize(by_window, "windows")
    one = by_window.groupBy("class").agg(F.min(F.struct("h1", "h2")).alias("w")).select("class", "w.*")
    class_items = windows.join(one, ["h1", "h2"]).select("class", "item")

    hits = flagged.select("rid", F.explode("hits").alias("hit")).select("rid", "hit.*")
    if by_window.count() <= broadcast_rows:
        true = hits.join(F.broadcast(by_window), ["h1", "h2"])
    else:
        met = materialize(hits.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).join(by_window, ["h1", "h2"]), "met")
        true = join_hot(hits, met, ["h1", "h2"], "n")
    spans = F.transform("starts", lambda s: F.struct(s.alias("start"), (s + F.col("len")).alias("end"))).alias("spans")
    by_doc = true.select("rid", "class", spans).groupBy("rid").agg(_covered().alias("n_hit"), F.array_sort(F.collect_set("class")).alias("classes"))
    by_doc = materialize(by_doc.withColumn("set", F.sha2(F.array_join("classes", ","), 256)), "documents")

    sets = by_doc.groupBy("set").agg(F.first("classes").alias("classes"), F.count(F.lit(1)).alias("n"))
    lists = sets.select("set", F.explode("classes").alias("class")).join(class_items, "class").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lists = materialize(sets.select("set", "n").join(lists, "set"), "items")
    judged = join_hot(by_doc.select("rid", "n_hit", "set"), lists, ["set"], "n").select("rid", "n_hit", "items")
    none = F.array().cast("array<string>")
    clean = found.where(F.size("hits") == 0).select("id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"))
    marked = flagged.select("rid", "id", "n_words").join(judged, "rid", "left")
    marked = marked.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))
    return clean.unionByName(marked)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: ``id_col, n_words, n_hit, n_items, items, contaminated``.

    ``n_hit``: words inside an occurrence of a window of an item (``window``, 10 words, or all of a shorter item that has
    words). ``items``: ids, as strings, of the items with such windows, sorted, each once; a null id is the empty string,
    and rows that repeat an item's id are one item. Null and blank texts have no words. Rows that repeat a document's id
    are judged each by its own text. Empty tables give an empty result, or documents without hits. ``max_bits`` bounds the
    bitmap: a larger benchmark lets more through to the join, and changes no result.
    """
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    out = _judged(rows, items, item_col, item_text_col, **options)
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, max_share: float = 0.0, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, of which at most ``max_share`` of the words are hit."""
    rows = docs.select(whole_row(docs).alias("id"), quoted(text_col).alias("text"))
    clean = _judged(rows, items, item_col, item_text_col, **options).where(F.col("n_hit") <= max_share * F.col("n_words"))
    return clean.select("id.*")


def item_digest(items: Column) -> Column:
    """Lower-case hex SHA-256 of the ids joined by commas."""
    return F.sha2(F.array_join(items, ","), 256)
