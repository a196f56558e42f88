"""Token counts by a two-tier lookup on the map side; the pre-tokens of documents are never shuffled.

Where the tokenizer's normaliser and splitting pattern never join characters across ASCII white space, a text has
as many tokens as its white-space-separated pre-tokens together. Tier one is a broadcast table of the
token counts of the pre-tokens most frequent in the whole table: each task sums its own words up in a summary of bounded
size, and summaries are merged by tree until one is left. The table only saves time and never changes a count. Tier two
is a cache in each worker, bounded by ``cache_size``, that the library fills for pre-tokens not met before. What tasks exchange are their summaries,
of at most ``table_size`` words each, and nothing else.

The tokenizer's file is checked for this when it is loaded; with any other, whole texts are encoded.
"""

from __future__ import annotations

import collections
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracepairs.llm.common import give_back_memory, map_arrow, materialize, quoted, raw, slices, with_row

_LONG = 256  # longer pre-tokens are encoded each time and kept nowhere
_FAN_IN = 64  # summaries merged by a task
#: Fixed value: a splitting pattern whose matches hold no white space and look at nothing outside.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The same on lower-case printable ASCII characters without spaces.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def splits_at_spaces(spec: str) -> bool:
    """Whether the tokenizer of this file never joins characters across ASCII white space."""
    t = json.loads(spec)
    parts = lambda x, name: [] if x is None else x[name] if x["type"] == "Sequence" else [x]
    for x in parts(t.get("normalizer"), "normalizers"):
        if x["type"] not in ("NFC", "Lowercase") and (x["type"], x.get("pattern"), x.get("content")) != ("Replace", {"Regex": r"\s+"}, " "):
            return False
    first, *others = parts(t.get("pre_tokenizer"), "pretokenizers") or [{"type": None}]
    removed = (first["type"], first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": _WORD_PATTERN}, "Removed", True)
    plain = all(x["type"] == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in others)
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    added = all(x["content"].split() == [x["content"]] and not any(x.get(f) for f in flags) for x in t.get("added_tokens", []))
    return removed and plain and added and not t["model"].get("dropout")


def counts_by_piece(spec: str) -> bool:
    """Whether a word of printable ASCII characters has the tokens of its pieces: the tokenizer lower-cases it, changes it in
    no other way, and splits it by the known pattern."""
    t = json.loads(spec)
    normalizer = t.get("normalizer") or {"type": "Sequence", "normalizers": []}
    kinds = [x["type"] for x in (normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer])]
    return splits_at_spaces(spec) and "Lowercase" in kinds


# --- frequent pre-tokens ---------------------------------------------------------------------------------


def reduced(counts: collections.Counter, size: int) -> collections.Counter:
    """The ``size`` most frequent words (of equal ones the first by bytes): at most that many have a share above 1 / ``size``."""
    if len(counts) <= size:
        return counts
    last = -int(np.partition(-np.fromiter(counts.values(), np.int64, len(counts)), size - 1)[size - 1])
    out = collections.Counter({w: n for w, n in counts.items() if n > last})
    ties = sorted(w for w, n in counts.items() if n == last)
    out.update(dict.fromkeys(ties[: size - len(out)], last))
    return out


def _packed(task: int, counts: collections.Counter) -> list[pa.Array]:
    words = sorted(counts, key=lambda w: (-counts[w], w))
    n = np.array([counts[w] for w in words], "<i8")
    return [pa.array([task], pa.int64()), pa.array([b" ".join(words)], pa.binary()), pa.array([n.tobytes()], pa.binary())]


_SUMMARY = "task long, words binary, counts binary"
_SUMMARY_NAMES = ["task", "words", "counts"]


def _summary(share: float, size: int):
    """The words that make up ``share`` or more of a task's words, with their counts: one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        counts, total = collections.Counter(), 0
        for b in slices(batches, "text", 1 << 20):
            data, offs = raw(b.column(0))
            data = data.tobytes()
            for lo, hi in zip(offs[:-1], offs[1:]):
                words = data[lo:hi].split()
                total += len(words)
                counts.update(words)
            if len(counts) > 4 * size:
                counts = reduced(counts, size)
        often = collections.Counter({w: n for w, n in counts.items() if n >= share * total and len(w) < _LONG})
        if often:
            yield pa.RecordBatch.from_arrays(_packed(TaskContext.get().partitionId(), reduced(often, size)), names=_SUMMARY_NAMES)

    return run


def _merge(size: int):
    def run(table: pa.Table) -> pa.Table:
        counts = collections.Counter()
        for words, n in zip(table.column("words").to_pylist(), table.column("counts").to_pylist()):
            counts.update(dict(zip(words.split(b" "), np.frombuffer(n, "<i8").tolist())))
            if len(counts) > 4 * size:
                counts = reduced(counts, size)
        return pa.table(_packed(table.column("task")[0].as_py() // _FAN_IN, reduced(counts, size)), names=_SUMMARY_NAMES)

    return run


def frequent_lengths(df: DataFrame, text_col: str, tokenizer: Tokenizer, *, table_share: float = 5e-6, table_size: int = 65_536) -> dict[bytes, int]:
    """Token counts of the most frequent pre-tokens of all rows, ``table_size`` at most.

    A task's summary holds its words with a share of ``table_share`` or more. Every ``_FAN_IN`` summaries are merged into
    one of ``table_size`` words, until one is left, which the driver reads.
    """
    texts = df.select(F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    parts = materialize(map_arrow(texts, _summary(table_share, table_size), _SUMMARY), "summaries")
    while parts.count() > 1:
        merged = parts.groupBy(F.floor(F.col("task") / _FAN_IN)).applyInArrow(_merge(table_size), _SUMMARY)
        parts = materialize(merged, "summaries")
    row = parts.first()
    found = bytes(row.words).split(b" ") if row else []
    return dict(zip(found, _lengths(found, tokenizer)))


# --- counts --------------------------------------------------------------------------------------------------


class Cache:
    """Token counts of pre-tokens: the broadcast table, and what was met since, in two generations of words and one of their
    pieces, which hold ``size`` entries together, but for those of the last texts.

    When the younger one is full it becomes the older one; words found in that return to the younger. So frequent words stay.
    With ``by_piece`` (:func:`counts_by_piece`) new words of printable ASCII characters are split as the tokenizer's pattern does
    and counted by its model, piece by piece; all others go through the whole tokenizer.
    """

    def __init__(self, table: dict[bytes, int], size: int, tokenizer: Tokenizer, by_piece: bool):
        self.table, self.size, self.tokenizer, self.model, self.by_piece = table, size // 3, tokenizer, tokenizer.model, by_piece
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.young, self.old = dict(table or {}), {}
        self.pieces: dict[str, int] = {}

    def _encode(self, words: list[bytes]) -> dict[bytes, int]:
        out, others, pieces = {}, [], self.pieces
        if len(pieces) > self.size:
            pieces.clear()
        for w in words:
            t = w.decode()
            if not (self.by_piece and t.isascii() and t.isprintable()) or any(a in t for a in self.added):
                others.append(w)
                continue
            total = 0
            for p in _ASCII_PIECES.findall(t.lower()):
                n = pieces.get(p)
                if n is None:
                    n = pieces[p] = len(self.model.tokenize(p))
                total += n
            out[w] = total
        out.update(zip(others, _lengths(others, self.tokenizer)))
        return out

    def count(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text."""
        split = [t.split() for t in texts]
        lens = [list(map(self.young.get, words)) for words in split]
        missing = {w for words, ns in zip(split, lens) if None in ns for w, n in zip(words, ns) if n is None}
        found = {w: n for w in missing if (n := self.old.get(w)) is not None}
        found.update(self._encode([w for w in missing if w not in found]))
        out = [sum(found[w] if n is None else n for w, n in zip(words, ns)) if None in ns else sum(ns) for words, ns in zip(split, lens)]
        self.young.update((w, n) for w, n in found.items() if len(w) < _LONG)
        if len(self.young) > len(self.table) + self.size:
            self.young, self.old = dict(self.table), self.young
        return out


def _lengths(texts: list[bytes], tokenizer: Tokenizer) -> list[int]:
    """Tokens of each text; encodings, which are far larger than texts, are held for few of them at a time."""
    out: list[int] = []
    while len(out) < len(texts):
        lo = hi = len(out)
        size = 0
        while hi < len(texts) and hi < lo + 1000 and (size := size + len(texts[hi])) <= 1 << 16 or hi == lo:
            hi += 1
        out += [len(e) for e in tokenizer.encode_batch_fast([t.decode() for t in texts[lo:hi]], add_special_tokens=False)]
    return out


def _tokenizer(spec: str) -> Tokenizer:
    out = Tokenizer.from_str(spec)
    out.no_truncation()
    out.no_padding()
    return out


_state: dict[str, Cache] = {}


def drop_caches() -> None:
    """Caches of earlier calls, which a reused worker still has, go."""
    if _state:
        _state.clear()
        give_back_memory()


class _Counted:
    """Counts the rows (id, text) of a task. A class of the module: a function within another one would be sent with a ``_state``
    of its own, and each task would load the tokenizer and fill its cache anew."""

    def __init__(self, shared: Broadcast, cache_size: int):
        self.shared, self.cache_size, self.key = shared, cache_size, uuid.uuid4().hex

    def _cache(self) -> Cache:
        if self.key not in _state:
            drop_caches()
            spec, table, by_piece = self.shared.value
            _state[self.key] = Cache(table, self.cache_size, _tokenizer(spec), by_piece)
        return _state[self.key]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = self._cache()
        for b in slices(batches, "text", 1 << 20):
            data, offs = raw(b.column(1))
            data = data.tobytes()
            texts = [data[lo:hi] for lo, hi in zip(offs[:-1], offs[1:])]
            n = _lengths(texts, cache.tokenizer) if cache.table is None else cache.count(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offs)), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, limit: int = 2048, cache_size: int = 200_000, table_share: float = 5e-6, table_size: int = 65_536) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row.

    Counts are those of the library without begin, end or added special tokens; special strings within a
    text count as the library's default has it. No truncation or padding. Null and empty texts have none.
    ``over_limit`` is ``n_tokens > limit``. A tokenizer that may join characters across white space
    (:func:`splits_at_spaces`) encodes whole texts, with neither table nor cache.
    """
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    table = frequent_lengths(df, text_col, _tokenizer(spec), table_share=table_share, table_size=table_size) if splits_at_spaces(spec) else None
    shared = spark.sparkContext.broadcast((spec, table, counts_by_piece(spec)))
    rows = df.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    out = map_arrow(rows, _Counted(shared, cache_size), with_row(rows, "id", "n_bytes long, n_tokens long"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
