"""Removal of long repeated passages by longest-previous-factor arrays over suffix arrays.

A passage is a string of ``length`` bytes that starts at two places or more. A suffix array over a whole corpus
does not fit a task, but equal strings can be brought together first:

1. *Anchors.* Each window of ``length`` bytes has an anchor: its least k-gram by hash, leftmost of equals. Equal
   windows have equal anchors at the same place. The windows of one anchor are consecutive; the bytes that
   they cover are the anchor's context. Every window of a text is in exactly one context.
2. *Equal contexts* of a k-gram are merged into one by 128-bit fingerprints, before anything is gathered. All
   windows of a context that occurs again are repeated.
3. *Suffix arrays.* The different contexts of a k-gram meet in one piece of a block. A piece is sorted into a
   suffix array (prefix doubling) of the suffixes that have ``length`` bytes; the previous and next smaller
   positions in suffix order, with the prefixes shared on the way, give the longest previous factor of each position
   and its earlier match.
4. *Split groups.* A group of more contexts than one task should compare is split: all its windows agree in a core around the
   anchor, and each window agrees with its equals in half of the remaining bytes before the core or in half of
   those after it. So each context goes on as at most two shorter ones, its windows with the larger half before the
   core and the others, under the core grown by that half; then steps 2 and 3 again. Equal windows stay
   together; contexts that share less fall apart. Cores reach ``length`` after log2(length) splits at most, where
   all contexts of a group are equal, so any number of contexts of one k-gram ends in pieces.
5. Spans return to their texts, are merged, and the bytes removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracepairs.llm.common import carried, carried_columns, join_hot, map_arrow, materialize, maybe_broadcast, mix, partitions, prefix_hash, quoted, raw, slices, span_hash, with_row

GRAM = 40
_POS_BITS = 28
_SHARED_KEYS = 10_000  # numbers that several texts share: of 64 bits, some hundred among 10**11 rows


# --- suffix arrays ------------------------------------------------------------------------------------


def _smaller(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order the nearest place before it with a smaller position (-1: none), and the
    length that the two suffixes share. ``lcp[i]`` is shared by the suffixes at places i - 1 and i."""
    n = len(sa)
    to, shared = np.arange(-1, n - 1), lcp.copy()
    shared[:1] = 0
    open_ = np.arange(1, n)
    while len(open_):
        # beyond a place with a larger position only that place's own jump needs a look
        open_ = open_[to[open_] >= 0]
        open_ = open_[(sa[to[open_]] > sa[open_]) & (shared[open_] > 0)]
        at = to[open_]
        to[open_], shared[open_] = to[at], np.minimum(shared[open_], shared[at])
    return np.where(shared > 0, to, -1), np.where(to >= 0, shared, 0)


def longest_previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions with ``length`` bytes before the end of their string, the longest match of each with such a position
    before it (up to ``length``; 0: none), and where that match starts (-1: none).

    ``starts``: where the strings in ``data`` start; no match goes beyond the end of a string. ``length``: 8 or more.
    """
    n = len(data)
    size = np.diff(np.append(starts, n))
    left = np.repeat(starts + size, size) - np.arange(n)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key |= wide[k : k + n] << np.uint64(56 - 8 * k)
    at, h = np.flatnonzero(left >= 8), 8
    key, ranks = key[at], []  # ranks: by the first h bytes, of positions that have them
    while True:
        order = np.argsort(key)
        key = key[order]
        place = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        rank = np.zeros(n, np.int32)
        rank[at[order]] = place
        ranks.append((h, rank))
        if h >= length:
            break
        step = min(h, length - h)
        at, h = np.flatnonzero(left >= h + step), h + step
        key = rank[at].astype(np.int64) * (n + 1) + rank[at + step]
    sa = at[order]
    if not len(sa):
        return sa, sa.copy(), sa.copy()
    a, b, same = sa[:-1], sa[1:], np.zeros(max(len(sa) - 1, 0), np.int64)
    for h, rank in reversed(ranks):
        fits = np.flatnonzero(same + h <= length)
        equal = fits[rank[a[fits] + same[fits]] == rank[b[fits] + same[fits]]]
        same[equal] += h
    for _ in range(7):
        more = np.flatnonzero(same < length)
        more = more[data[a[more] + same[more]] == data[b[more] + same[more]]]
        same[more] += 1
    lcp = np.concatenate([[0], same])
    before, with_before = _smaller(sa, lcp)
    back, with_back = _smaller(sa[::-1], np.concatenate([[0], same[::-1]]))
    after, with_after = np.where(back >= 0, len(sa) - 1 - back, -1)[::-1], with_back[::-1]
    nearer = with_before >= with_after
    place = np.where(nearer, before, after)
    factor = np.where(nearer, with_before, with_after)
    source = np.where(place >= 0, sa[place], -1)
    by_position = np.argsort(sa)
    return sa[by_position], factor[by_position], source[by_position]


# --- anchors --------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Contexts of a slice of texts: text index, k-gram fingerprint, context fingerprint, first and last window
    start and the anchor's position (in the slice)."""
    n, none = len(data), np.empty(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    prefix = prefix_hash(data)
    at = np.arange(n - gram + 1)
    h = span_hash(prefix, at, at + gram)
    key = (h >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS)) | at.astype(np.uint64)
    width = length - gram + 1  # k-grams in a window: minima over powers of two, then over two that overlap
    least, have = key, 1
    while have * 2 <= width:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(anchor)]
    inside = np.flatnonzero(np.arange(len(anchor)) + length <= offs[1:][text])
    if not len(inside):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    a = anchor[inside]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (np.diff(inside) != 1)]))
    first, last = inside[new], inside[np.append(new[1:], len(inside)) - 1]
    a = a[new]
    context = mix(span_hash(prefix, first, last + length) + (a - first).astype(np.uint64))
    return text[first], h[a], context, first, last, a


#: Windows of a longer text are cut in steps of so many bytes, which bounds a task's memory. A context at a step's end is
#: cut in two; its windows keep their anchors.
STEP = 4 << 20


def anchors_in_steps(data: np.ndarray, offs: np.ndarray, length: int, step: int = STEP) -> Iterator[tuple[np.ndarray, ...]]:
    """:func:`anchors` of a slice, or of a slice that is one long text step by step, with starts in the slice."""
    if len(data) <= step + length or len(offs) != 2:
        yield anchors(data, offs, length)
        return
    for lo in range(0, len(data) - length + 1, step):
        part = data[lo : lo + step + length - 1]
        text, fp, context, first, last, anchor = anchors(part, np.array([0, len(part)]), length)
        yield text, fp, context, first + lo, last + lo, anchor + lo


_ANCHORS = "k long, o long, gram long, context long, at int, windows int, pos int"


def _cut_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            data, offs = raw(b.column(2))
            k, o = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for text, fp, context, first, last, anchor in anchors_in_steps(data, offs, length):
                own = offs[text]
                small = [(first - own).astype(np.int32), (last - first + 1).astype(np.int32), (anchor - first).astype(np.int32)]
                cols = [k[text], o[text], fp.view(np.int64), context.view(np.int64), *small]
                for lo in range(0, len(text), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in cols], names=[x.split()[0] for x in _ANCHORS.split(", ")])

    return run


# --- contexts ---------------------------------------------------------------------------------------------

_FIELDS = ("gram", "o", "at", "windows", "pos", "open")


def _cut_contexts(length: int):
    """Rows (k, text, list of contexts) -> one row per context with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                data, _ = raw(b.column(1))
                own = b.column(2).flatten()
                own = own if isinstance(own, pa.StructArray) else pa.array(own)
                at, windows = own.field("at").to_numpy(), own.field("windows").to_numpy()
                blob = data.tobytes()
                for lo in range(0, len(at), 5000):
                    part = own.slice(lo, 5000)
                    bodies = [blob[s : s + n + length - 1] for s, n in zip(at[lo : lo + 5000].tolist(), windows[lo : lo + 5000].tolist())]
                    k = pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), len(bodies)))
                    yield pa.RecordBatch.from_arrays([k, *[part.field(x) for x in _FIELDS], pa.array(bodies, pa.binary())], names=["k", *_FIELDS, "body"])

    return run


def _split(length: int):
    """Contexts of groups that are too large -> at most two shorter ones each, under a core that is larger by half of
    the bytes that were not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "body", 1 << 20):
            col = dict(zip(b.schema.names, b.columns))
            data, offs = raw(col["body"])
            prefix = prefix_hash(data)
            at, windows, pos, core = (col[x].to_numpy().astype(np.int64) for x in ("at", "windows", "pos", "core"))
            gram = col["gram"].to_numpy().view(np.uint64)
            half = (length - core + 1) // 2
            cut = np.clip(pos - half + 1, 0, windows)  # windows before this have ``half`` bytes or more before the core
            for side, lo, hi in ((1, np.zeros_like(cut), cut), (2, cut, windows)):
                i = np.flatnonzero(hi > lo)
                if not len(i):
                    continue
                first, end = offs[i] + lo[i], offs[i] + hi[i] + length - 1
                inner = offs[i] + (pos - half if side == 1 else pos)[i]  # the new core starts here
                grown = (core + (half if side == 1 else length - core - half + 1))[i]
                group = mix(gram[i] * np.uint64(5) ^ span_hash(prefix, inner, inner + grown) ^ np.uint64(side))
                context = mix(span_hash(prefix, first, end) + (inner - first).astype(np.uint64))
                bodies = pa.array([data[x:y].tobytes() for x, y in zip(first.tolist(), end.tolist())], pa.binary())
                i32 = lambda x: pa.array(x.astype(np.int32))
                rows = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [col["k"].take(rows), col["o"].take(rows), pa.array(group.view(np.int64)), pa.array(context.view(np.int64)), i32(at[i] + lo[i]), i32((hi - lo)[i]), i32(inner - first), i32(grown), col["open"].take(rows), bodies],
                    names=_SPLIT_NAMES,
                )

    return run


_SPLIT = _ANCHORS + ", core int, open boolean, body binary"
_SPLIT_NAMES = [x.split()[0] for x in _SPLIT.split(", ")]


def _factor_block(length: int, keep_first: bool, piece_bytes: int):
    """Arrays over the contexts of a block, piece by piece; pieces hold whole groups, at most one that is larger than
    ``piece_bytes`` or any number that are not."""

    def run(table: pa.Table) -> pa.Table:
        k, o, gram, at, open_ = (table.column(c).to_numpy() for c in ("k", "o", "gram", "at", "open"))
        order = np.lexsort((at, k, o, gram))
        again = np.zeros(len(order), bool)  # a row of the table that is there twice comes twice
        again[1:] = np.all([x[order][1:] == x[order][:-1] for x in (gram, k, at)], axis=0)
        order = order[~again]
        bodies = table.column("body").to_pylist()
        size = np.array([len(bodies[i]) for i in order])
        ends = np.cumsum(size)
        group_end = np.append(np.flatnonzero(np.diff(gram[order])) + 1, len(order))
        out: list[tuple[np.ndarray, ...]] = []
        lo = 0
        while lo < len(order):
            base = ends[lo - 1] if lo else 0
            fits = group_end[(group_end > lo) & (ends[group_end - 1] - base <= piece_bytes)]
            hi = int(fits[-1]) if len(fits) else int(group_end[group_end > lo][0])
            own = order[lo:hi]
            data = np.frombuffer(b"".join([bodies[i] for i in own]), np.uint8)
            starts = ends[lo:hi] - size[lo:hi] - base
            position, factor, source = longest_previous_factors(data, starts, length)
            repeated = factor >= length
            marks = position[repeated]
            if not keep_first:  # an earlier match is repeated too
                marks = np.unique(np.concatenate([marks, source[repeated]]))
            row = np.searchsorted(starts, marks, "right") - 1
            todo = open_[own[row]].astype(bool)
            marks, row = marks[todo], row[todo]
            if len(marks):
                new = np.concatenate([[True], (np.diff(marks) != 1) | (np.diff(row) != 0)])
                a, z = marks[new], marks[np.append(np.flatnonzero(new)[1:], len(marks)) - 1]
                r = row[new]
                out.append((k[own[r]], at[own[r]] + a - starts[r], at[own[r]] + z - starts[r] + length))
            lo = hi
        cols = [np.concatenate(c) if out else np.empty(0) for c in (zip(*out) if out else [()] * 3)]
        return pa.table([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int32, np.int32))], names=["k", "lo", "hi"])

    return run


# --- the operator ---------------------------------------------------------------------------------------


def _merged(found: DataFrame, length: int, keep_first: bool, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the occurrences of contexts ``found``: the spans of contexts that occur again (but of the first occurrence, if
    that is to stay), the different contexts with the first occurrence of each, and the groups in which
    different contexts have to be compared (gram, contexts)."""
    first = F.min(F.struct(*[c for c in ("o", "k", "at", "windows", "pos", "core", "body") if c in found.columns])).alias("first")
    contexts = materialize(found.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), first, F.max("open").alias("any_open")), f"contexts{level}")
    again = contexts.where("n > 1 AND any_open").select("gram", "context", "n", F.col("first.o").alias("o1"), F.col("first.k").alias("k1"), F.col("first.at").alias("at1"))
    whole = join_hot(found.where("open").select("gram", "context", "o", "k", "at", "windows"), again, ["gram", "context"], "n")
    if keep_first:
        whole = whole.where("NOT (o <=> o1 AND k = k1 AND at = at1)")
    whole = whole.select("k", F.col("at").alias("lo"), (F.col("at") + F.col("windows") + (length - 1)).alias("hi"))
    contexts = contexts.select("gram", "first.*", (F.col("any_open") & (F.lit(keep_first) | (F.col("n") == 1))).alias("open"))
    groups = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts"), F.max("open").alias("todo")).where("contexts > 1 AND todo")
    return whole, contexts, materialize(groups.drop("todo"), f"groups{level}")


def repeated_spans(texts: DataFrame, *, length: int = 200, keep_first: bool = False, block_bytes: int = 8 << 20, piece_bytes: int = 1 << 20, group_bytes: int = 128 << 10) -> DataFrame:
    """``k, lo, hi``: byte ranges to remove from the texts (columns ``k`` long, ``o`` long, ``text``).

    Ranges may overlap. Rows with equal keys ``k`` must have equal texts. With ``keep_first`` the occurrence with the
    smallest (o, k, position) stays. ``block_bytes`` and ``piece_bytes`` bound a task's memory, ``group_bytes``
    the contexts of a k-gram that one task compares: a group that may exceed it is split. None changes the result.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    every = map_arrow(texts.select("k", "o", "text"), _cut_anchors(length), _ANCHORS)
    # most k-grams occur once; cutting anchors again costs less than keeping those of the whole corpus
    often = materialize(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    found = materialize(every.join(often.select("gram"), "gram", "left_semi"), "anchors").withColumn("open", F.lit(True))
    most = max(2, group_bytes // (2 * length))  # contexts of a group that surely fit
    spans, contexts, groups = _merged(found, length, keep_first, 0)
    wanted = join_hot(contexts, groups, ["gram"], "contexts")
    by_text = wanted.groupBy("k").agg(F.collect_list(F.struct(*_FIELDS, "contexts")).alias("own"))
    schema = "k long, gram long, o long, at int, windows int, pos int, open boolean, body binary"
    bodies = map_arrow(texts.join(by_text, "k").select("k", "text", "own"), _cut_contexts(length), schema).withColumn("core", F.lit(GRAM))
    for level in range(1, 2 + length.bit_length()):
        bodies = materialize(bodies, f"bodies{level}")
        large = groups.where(F.col("contexts") > most)
        n_large = large.count()
        small = bodies.join(maybe_broadcast(large.select("gram"), n_large), "gram", "left_anti") if n_large else bodies
        total = small.agg(F.sum(F.octet_length("body"))).first()[0] or 0
        block = F.pmod(F.xxhash64("gram"), F.lit(max(partitions(texts.sparkSession), -(-total // block_bytes)))).alias("block")
        blocks = small.select(block, "k", "o", "gram", "at", "open", "body").groupBy("block")
        spans = spans.unionByName(blocks.applyInArrow(_factor_block(length, keep_first, piece_bytes), "k long, lo int, hi int"))
        if not n_large:
            return spans
        parts = map_arrow(join_hot(bodies, large, ["gram"], "contexts").select(*[x for x in _SPLIT_NAMES if x != "context"]), _split(length), _SPLIT)
        spans = materialize(spans, "spans")  # keeps plans short
        whole, contexts, groups = _merged(materialize(parts, f"parts{level}"), length, keep_first, level)
        spans = spans.unionByName(whole)
        bodies = join_hot(contexts, groups, ["gram"], "contexts").select(*bodies.columns)
    raise AssertionError("a core of full length leaves no different contexts")


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    return lo[new], reach[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]


def _key(df: DataFrame, content: list[Column], bits: int = 64) -> Column:
    """A number for each row, equal only for rows of equal ``content``: the last ``bits`` bits of a hash. Rows of one number whose
    second hashes differ are found (narrow records, combined map-side) and get a number from both hashes instead, until none
    are left; so only texts that agree in all 128 bits are taken for one."""
    key, check = F.xxhash64(*content).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1)), F.xxhash64(F.lit(1), *content)
    for seed in range(2, 12):
        shared = df.select(key.alias("k"), check.alias("c")).groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi")
        again = [r[0] for r in shared.select("k").limit(_SHARED_KEYS + 1).collect()]
        if not again:
            return key
        # few keys are named; with more (only where few bits are asked for) all rows take their second hash
        other = F.xxhash64(F.lit(seed), check, *content)
        key = F.when(key.isin(again), other).otherwise(key) if len(again) <= _SHARED_KEYS else other
    raise RuntimeError("keys of different texts stay equal")


_SPANS = "array<struct<start: int, end: int>>"


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key_bits: int = 64, **options) -> DataFrame:
    """``df`` with ``kept_bytes`` (binary: the UTF-8 bytes that stay) and ``removed`` (maximal runs, start and end).

    Each byte goes that a string of ``length`` bytes covers which starts anywhere else too, in the same text or
    another. With ``keep_first`` each goes that is covered by a string which also starts earlier, by (id, position): the
    id must be a number then; null comes last, rows that repeat an id are in an order by a hash of their text. Texts are
    compared as UTF-8 bytes; a match never crosses texts; null counts as empty. Rows that repeat id and text are judged
    as one text that has itself as a copy, and give equal results (with ``keep_first`` the copy is not seen as one:
    they are one row written twice). Rows are told apart by ``key_bits`` bits of a hash, those that then share one by other
    hashes (:func:`_key`). Columns with the names of the results are replaced. An empty table gives an empty
    result.
    """
    made = ["kept_bytes", "removed"]
    others = [c for c in df.columns if c not in made]
    text, carry = quoted(text_col), [c for c in others if c != text_col]
    place = F.coalesce(quoted(id_col).cast("long"), F.lit(2**63 - 1)) if options.get("keep_first") else F.lit(0).cast("long")
    content = [quoted(id_col), F.coalesce(text, F.lit(""))]
    rows = df.select(_key(df, content, key_bits).alias("k"), place.alias("o"), text.alias("text"), carried(df, carry).alias("row"))
    spans = repeated_spans(rows.select("k", "o", F.coalesce("text", F.lit("")).alias("text")), **options)
    per_text = spans.groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20, 4000):
            data, offs = raw(b.column(1))
            kept, removed = [], []
            for i in range(b.num_rows):
                own = b.column(2)[i]
                body = data[offs[i] : offs[i + 1]]
                lo, hi = merge(own.values.field("lo").to_numpy(), own.values.field("hi").to_numpy()) if own.is_valid else (np.empty(0, np.int64),) * 2
                between = zip([0, *hi.tolist()], [*lo.tolist(), len(body)])
                kept.append(b"".join([body[x:y].tobytes() for x, y in between]))
                removed.append([{"start": x, "end": y} for x, y in zip(lo.tolist(), hi.tolist())])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.binary()), pa.array(removed, kind)], names=["row", "text", *made])

    joined = rows.join(per_text, "k", "left").select("row", "text", "spans")
    out = map_arrow(joined, run, with_row(rows, "row", f"text string, kept_bytes binary, removed {_SPANS}"))
    columns = dict(zip(carry, carried_columns(carry, "row"))) | {text_col: F.col("text").alias(text_col)}
    return out.select(*[columns[c] for c in others], *made)
