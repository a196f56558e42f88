"""Exact n-gram Jaccard join by prefix trees.

A document's set is its distinct word n-grams as 64-bit fingerprints. Documents with equal sets are one
class. Then:

1. *Screen.* Two sets that link differ, on either side, in at most a fifth of their n-grams (at 0.8). Every
   set posts its n-grams below a universal hash threshold; one that shares with other sets fewer of the
   posted n-grams than ``posted - n / 5`` can link to nothing and is settled. Postings travel as packed arrays,
   partitioned by n-gram. Each task combines them first: it posts equal sets once, and an n-gram that it has met in
   many sets once more, as shared, and never again. So a common n-gram or a large group of copies brings a few
   records of each task to one task, not one of each document. The documents' own records travel in the same groups,
   spread by id and task.
2. *Global order.* For the sets that remain, document frequencies are counted, and n-grams are ordered by the power
   of two of their frequency, then by fingerprint: rare ones first. Linked sets share an n-gram within their prefixes
   in this order; components over shared prefix n-grams are the blocks.
3. *Prefix trees.* The sets of a block are stored in a trie in the global order (frequent n-grams at the root); a walk
   carries the overlaps of all queries with the path so far and leaves a subtree when, with the n-grams that
   remain, no query can reach the threshold with any set in it.
4. *Large blocks* are dealt out to chunks, one task each, and a few sets of the block go to all its chunks. The links
   within chunks and to these sets join most near copies of a block. What is left to compare are pairs with a member
   that is not in the largest component of its block: these light members meet the whole block if they are few, else, for
   each prefix n-gram that they have, the sets of the block with that n-gram. So a block of near copies costs rows in proportion to its sets. Only where
   very many light members share one prefix n-gram with very many sets do copies grow, by the number of chunks.
5. Links give components by large-star and small-star steps (only where blocks were cut; in others the
   task that holds the block has settled them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracepairs.llm.common import give_back_memory, join_hot, map_arrow, materialize, maybe_broadcast, mix, partitions, prefix_hash, quoted, raw, slices, span_hash
from tracepairs.llm.components import connected_components

SLICE_BYTES = 1 << 20
#: Sets of a slice, and of a task, that share an n-gram before it counts as shared by many.
LOCAL_HOT, TASK_HOT = 8, 16
_COUNTERS, _REMEMBERED = 1 << 22, 1 << 20
_DOC = np.dtype([("id", "<i8"), ("d1", "<u8"), ("d2", "<u8"), ("n", "<i4"), ("posted", "<i4"), ("hot", "<i4")])


# --- sets ------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word n-grams of each text in a slice: (text index, fingerprint) sorted by both, and sizes.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A text with fewer than ``width``
    words has its whole sequence as one n-gram, one without words has none.
    """
    n_docs = len(offs) - 1
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(n_docs, np.int64)
    data = _LOWER[data]
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    w = span_hash(prefix_hash(data), start, end)
    doc = np.searchsorted(offs, start, "right") - 1
    words = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(words)])
    out_d, out_h = [], []
    if len(w) >= width:
        h = w[: len(w) - width + 1]
        for i in range(1, width):
            h = mix(h * np.uint64(3) + w[i : len(w) - width + 1 + i])
        ok = doc[: len(h)] == doc[width - 1 :]
        out_d.append(doc[: len(h)][ok])
        out_h.append(h[ok])
    short = np.flatnonzero((words > 0) & (words < width))
    if len(short):
        h = np.full(len(short), 11, np.uint64)
        for i in range(width - 1):
            has = words[short] > i
            h[has] = mix(h[has] * np.uint64(5) + w[first[short[has]] + i])
        out_d.append(short)
        out_h.append(h)
    if not out_d:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(n_docs, np.int64)
    d, h = np.concatenate(out_d), np.concatenate(out_h)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    d, h = d[new], h[new]
    return d, h, np.bincount(d, minlength=n_docs)


def set_digests(d: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit identities of the sets, equal for equal sets."""
    at = np.concatenate([[0], np.cumsum(n)])[:-1]
    out = []
    for salt in (0x1234567, 0x89ABCDEF01):
        total = np.zeros(len(n), np.uint64)
        if len(h):
            some = n > 0
            total[some] = np.add.reduceat(mix(h ^ np.uint64(salt)), at[some])
        out.append(mix(total + n.astype(np.uint64) * np.uint64(0x51ED270B)))
    return out[0], out[1]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


# --- 1: the screen ---------------------------------------------------------------------------------


def _in(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _add(known: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Sorted union; starts anew when it would be large, which only repeats records."""
    return np.union1d(known, new) if len(known) < _REMEMBERED else np.unique(new)


def _post(width: int, share: float, parts: int):
    limit = np.uint64(min(int(share * (1 << 63)) * 2, (1 << 64) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = mix(np.array([TaskContext.get().partitionId()], np.uint64))
        # what this task has met: sets by n-gram (n-grams that share a counter count too high, which only opens more sets),
        # posted sets, and n-grams posted as shared
        met, posted_sets, told = np.zeros(_COUNTERS, np.uint32), np.empty(0, np.uint64), np.empty(0, np.uint64)
        for b in slices(batches, "text", SLICE_BYTES):
            ids = _ids(b)
            d, h, n = shingle_sets(*raw(b.column(1)), width)
            d1, d2 = set_digests(d, h, n)
            low = h <= limit
            d, h = d[low], h[low]
            posted = np.bincount(d, minlength=len(ids))
            # equal sets are posted once by a task
            _, once = np.unique(d1, return_index=True)
            is_first = np.zeros(len(ids), bool)
            is_first[once] = True
            is_first &= ~_in(posted_sets, d1)
            posted_sets = _add(posted_sets, d1[is_first])
            keep = is_first[d]
            d, h = d[keep], h[keep]
            # n-grams that many sets have are known to be shared: posted once, counted here
            order = np.argsort(h, kind="stable")
            d, h = d[order], h[order]
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
            count = np.diff(np.append(begin, len(h)))
            slot = (h[begin] >> np.uint64(16)).astype(np.int64) % _COUNTERS
            np.add.at(met, slot, count.astype(np.uint32))
            many = (count >= LOCAL_HOT) | (met[slot] >= TASK_HOT)
            often = np.repeat(many, count)
            hot = np.bincount(d[often], minlength=len(ids))
            keep = ~often
            new = many & ~_in(told, h[begin])
            keep[begin[new]] = True
            told = _add(told, h[begin[new]])
            d, h, flag = d[keep], h[keep], often[keep]
            docs = np.zeros(len(ids), _DOC)
            docs["id"], docs["d1"], docs["d2"], docs["n"], docs["posted"], docs["hot"] = ids, d1, d2, n, posted, hot
            # nothing needs the records of a text together: rows of one id are spread by task, all others by id
            pid, doc_pid = (h >> np.uint64(8)) % np.uint64(parts), mix(ids.view(np.uint64) ^ task) % np.uint64(parts)
            order, doc_order = np.argsort(pid, kind="stable"), np.argsort(doc_pid, kind="stable")
            h, d, flag, docs = h[order], d[order], flag[order], docs[doc_order]
            cut = np.searchsorted(pid[order], np.arange(parts + 1, dtype=np.uint64))
            doc_cut = np.searchsorted(doc_pid[doc_order], np.arange(parts + 1, dtype=np.uint64))
            rows = []
            for p in np.flatnonzero((cut[1:] > cut[:-1]) | (doc_cut[1:] > doc_cut[:-1])).tolist():
                lo, hi = cut[p], cut[p + 1]
                who, own = np.unique(d[lo:hi], return_inverse=True)
                own = own.astype(np.uint16)
                own[flag[lo:hi]] = 0xFFFF  # shared by many already
                grams = h[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((p, grams.tobytes(), own.tobytes(), d1[who].tobytes(), docs[doc_cut[p] : doc_cut[p + 1]].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 4)], names=["pid", "grams", "own", "sets", "docs"]
                )

    return run


def _count_shared(table: pa.Table) -> pa.Table:
    """For one partition of the n-grams: how many of its posted n-grams each set shares with another."""
    grams, sets, many, docs = [], [], [], []
    for row in table.select(["grams", "own", "sets", "docs"]).to_batches():
        for g, o, s, x in zip(*[c.to_pylist() for c in row.columns]):
            own = np.frombuffer(o, np.uint16)
            wide = np.zeros((len(own), 8), np.uint8)
            wide[:, :6] = np.frombuffer(g, np.uint8).reshape(-1, 6)
            known, hot = np.frombuffer(s, np.uint64), own == 0xFFFF
            grams.append(wide.view("<u8").ravel())
            sets.append(np.where(hot, 0, known[np.where(hot, 0, own)]) if len(known) else np.zeros(len(own), np.uint64))
            many.append(hot)
            docs.append(np.frombuffer(x, _DOC))
    g, s, hot, doc = (np.concatenate(x) if x else np.empty(0) for x in (grams, sets, many, docs))
    shared_ids = shared_n = np.empty(0, np.uint64)
    if len(g):
        order = np.lexsort((s, g))
        g, s, hot = g[order], s[order], hot[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (hot[1:] != hot[:-1])
        g, s, hot = g[new], s[new], hot[new]
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        size = np.diff(np.append(begin, len(g)))
        shared = np.repeat((size > 1) | np.logical_or.reduceat(hot, begin), size) & ~hot
        shared_ids, shared_n = np.unique(s[shared], return_counts=True)
    k, m = len(shared_ids), len(doc)
    none = lambda n, t: pa.nulls(n, t)
    col = lambda x: pa.array(x.astype(np.int64))
    i32 = lambda x: pa.array(np.ascontiguousarray(x).astype(np.int32))
    first = [pa.array(shared_ids.view(np.int64)), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.int32()), none(k, pa.int32()), none(k, pa.int32()), i32(shared_n)]
    if not m:
        return pa.table(first, names=_SCREEN_NAMES)
    rest = [col(np.ascontiguousarray(doc["d1"]).view(np.int64)), col(doc["id"]), col(np.ascontiguousarray(doc["d2"]).view(np.int64)), i32(doc["n"]), i32(doc["posted"]), i32(doc["hot"]), none(m, pa.int32())]
    out = pa.table([pa.concat_arrays([a, b]) for a, b in zip(first, rest)], names=_SCREEN_NAMES)
    del grams, sets, many, docs, g, s, hot, doc
    give_back_memory()
    return out


_SCREEN = "d1 long, id long, d2 long, n int, posted int, hot int, shared int"
_SCREEN_NAMES = [x.split()[0] for x in _SCREEN.split(", ")]


# --- 2 and 3: sets of the remaining documents, tries -------------------------------------------------


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            ids = _ids(b)
            d, h, n = shingle_sets(*raw(b.column(1)), width)
            d1, d2 = set_digests(d, h, n)
            at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            grams = pa.LargeListArray.from_arrays(pa.array(at.astype(np.int64)), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), grams], names=["id", "d1", "d2", "grams"])

    return run


def trie_join(sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest index linked (directly or over others) with each set; Jaccard >= num / den, exactly.

    ``sets`` are numbers in the global order, rare ones low, and may leave out n-grams that no other set of the list
    has; ``sizes`` are the whole sizes.
    """
    m = len(sets)
    parent = np.arange(m)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if m < 2:
        return parent
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, rank, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank, df = len(df) - 1 - rank, df[::-1]  # frequent ones first
    order = np.lexsort((owner, rank))
    post, post_at = owner[order], np.concatenate([[0], np.cumsum(df)])
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    paths = [np.sort(x) for x in np.split(rank, cuts)]
    by_path = sorted(range(m), key=lambda i: paths[i].astype(">i4").tobytes())
    rows = [paths[i] for i in by_path]
    common = np.zeros(m, np.int64)  # n-grams that row i shares at its start with row i - 1
    for i in range(1, m):
        k = min(len(rows[i]), len(rows[i - 1]))
        differ = np.flatnonzero(rows[i][:k] != rows[i - 1][:k])
        common[i] = differ[0] if len(differ) else k
    lens = np.array([len(r) for r in rows])
    size_of = sizes[np.array(by_path)].astype(np.int64)
    sizes, total = sizes.astype(np.int64), num + den
    stack = [(0, m, 0, np.arange(m), np.zeros(m, np.int64))]
    while stack:
        lo, hi, depth, alive, overlap = stack.pop()
        to = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(lens[lo])
        if to > depth:
            path = rows[lo][depth:to]
            hits = np.concatenate([post[post_at[r] : post_at[r + 1]] for r in path])
            overlap = overlap + np.bincount(hits, minlength=m)[alive]
        left = int(lens[lo:hi].max()) - to
        least = int(size_of[lo:hi].min())
        may = total * np.minimum(overlap + left, sizes[alive]) >= num * (sizes[alive] + least)
        alive, overlap = alive[may], overlap[may]
        if not len(alive) or (hi - lo == 1 and len(alive) == 1 and alive[0] == by_path[lo]):
            continue
        ended = lo
        while ended < hi and lens[ended] == to:  # sets that end at this node
            x = by_path[ended]
            linked = alive[total * overlap >= num * (sizes[alive] + sizes[x])]
            for q in linked[parent[linked] != parent[x]].tolist():
                a, b = root(q), root(x)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            ended += 1
        if ended < hi:
            heads = np.array([rows[i][to] for i in range(ended, hi)])
            split = [ended, *(ended + 1 + np.flatnonzero(heads[1:] != heads[:-1])).tolist(), hi]
            stack += [(a, b, to, alive, overlap) for a, b in zip(split[:-1], split[1:])]
    return np.array([root(i) for i in range(m)])


def _join_block(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        nodes, once = np.unique(table.column("node").to_numpy(), return_index=True)
        sizes = table.column("n").to_numpy()[once]
        packed = table.column("keys").to_pylist()
        least = trie_join([np.frombuffer(packed[i], "<i8") for i in once], sizes, num, den)
        moved = least != np.arange(len(nodes))
        return pa.table([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], names=["a", "b"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(2)
        flat, offs = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        offs = offs - offs[0]
        packed = [flat[lo:hi].astype("<i8").tobytes() for lo, hi in zip(offs[:-1], offs[1:])]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["node", "n", "keys"])


# --- the operator ------------------------------------------------------------------------------------


#: A block goes to up to so many tasks of so many sets each before these get larger.
SPREAD_TASKS, SPREAD_SETS = 16, 128


def _chunks(m: str, g: str, chunk_sets: int, chunk_grams: int) -> Column:
    """Into how many chunks ``m`` sets of ``g`` n-grams are dealt."""
    spread = F.least(F.lit(SPREAD_TASKS), F.ceil(F.col(m) / SPREAD_SETS))
    return F.greatest(spread, F.ceil(F.col(m) / chunk_sets), F.ceil(F.col(g) / chunk_grams)).cast("int")


def _link_large(members: DataFrame, ordered: DataFrame, packed: DataFrame, links: DataFrame, join, chunk_sets: int, chunk_grams: int, few_chunks: int = 8) -> DataFrame:
    """The links of blocks that were cut (``members``: node, component, m) which ``links`` may lack: of pairs with a member
    outside the largest component of its block."""
    labels = connected_components(links).withColumnRenamed("component", "label")
    members = materialize(members.join(labels, "node", "left").select("node", "component", "m", F.coalesce("label", "node").alias("label")), "members")
    sizes = members.groupBy("component", "label").agg(F.count(F.lit(1)).alias("size"), F.first("m").alias("m"))
    largest = materialize(sizes.groupBy("component").agg(F.max_by("label", F.struct("size", "label")).alias("largest"), F.first("m").alias("m")), "largest")
    tagged = join_hot(members.drop("m"), largest, ["component"], "m").select("node", "component", (F.col("label") != F.col("largest")).alias("light"))
    tagged = materialize(tagged, "tagged")
    blocks = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.count_if("light").alias("r")).where("r > 0")
    tagged = join_hot(tagged, materialize(blocks, "cut"), ["component"], "m")
    # a few light members meet their whole block; many meet it by prefix n-gram, in as many copies as they have
    few = F.col("r") <= few_chunks * chunk_sets
    keys = F.when(few, F.array(F.lit(-1).cast("long"))).otherwise(F.slice("keys", 1, F.col("in_prefix")))
    postings = ordered.where("in_prefix > 0").join(tagged, "node")
    postings = postings.select("component", "node", "light", F.size("keys").alias("g"), F.explode(keys).alias("key"))
    postings = materialize(postings, "prefixes")
    groups = postings.groupBy("component", "key").agg(F.count(F.lit(1)).alias("m"), F.sum("g").alias("g"), F.count_if("light").alias("r"), F.sum(F.when(F.col("light"), F.col("g"))).alias("rg"))
    groups = materialize(groups.where("r > 0 AND m > 1"), "light")
    parts = F.greatest(F.ceil(F.col("r") / chunk_sets), F.ceil(F.col("rg") / chunk_grams)).cast("int")
    groups = groups.withColumns({"whole": _chunks("m", "g", chunk_sets, chunk_grams), "parts": parts})
    placed = join_hot(postings.drop("g"), groups, ["component", "key"], "m")
    i, j = (F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(x)).cast("int") for seed, x in ((1, "whole"), (2, "parts")))
    mine = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(i.alias("i"), x.alias("j")))
    all_ = F.transform(F.sequence(F.lit(0), F.col("whole") - 1), lambda x: F.struct(x.alias("i"), j.alias("j")))
    both = F.array_distinct(F.concat(mine, F.when(F.col("light"), all_).otherwise(F.array().cast("array<struct<i:int,j:int>>"))))
    placed = placed.select("component", "key", "node", F.explode(both).alias("t"))
    tasks = placed.join(packed, "node").groupBy("component", "key", "t").applyInArrow(join, "a long, b long")
    return materialize(tasks, "links")


def ngram_jaccard_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    width: int = 5,
    threshold: tuple[int, int] = (4, 5),
    posted_share: float = 0.5,
    chunk_sets: int = 2048,
    chunk_grams: int = 2_000_000,
    shared_share: float = 0.125,
) -> DataFrame:
    """``id_col, n_shingles, component_id``: one row per input row.

    Two documents link when ``den * |A & B| >= num * |A | B|``. ``component_id`` is the smallest id reachable
    by links, itself included. Null texts and texts without words have no n-grams and link with nothing;
    rows with a null id get a null component and take no part. Rows that repeat an id are judged each by
    its own text. Ids are whole numbers of 64 bits. ``posted_share`` (0 to 1) trades the volume of the screen for its
    sharpness, ``chunk_*`` bound the memory of a trie task, all tasks of a large block get as many sets more as
    ``shared_share`` of a chunk; none of them changes the result. An empty table gives an empty result.
    """
    spark = df.sparkSession
    num, den = threshold
    narrow = df.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    known = narrow.where("id is not null")
    volume = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(_DOC.itemsize))  # null and empty texts have records too
    parts = max(partitions(spark), int((known.agg(volume).first()[0] or 0) >> 25))
    posts = map_arrow(known, _post(width, posted_share, parts), "pid int, grams binary, own binary, sets binary, docs binary")
    screen = materialize(posts.groupBy("pid").applyInArrow(_count_shared, _SCREEN), "screen")
    docs = screen.where("id is not null").drop("shared")
    shared = screen.where("id is null").groupBy("d1").agg(F.sum("shared").alias("shared"))
    classes = docs.where("n > 0").groupBy("d1", "d2").agg(
        F.min("id").alias("rep"), F.min("n").alias("n"), F.min("posted").alias("posted"), F.max("hot").alias("hot"), F.count(F.lit(1)).alias("copies")
    )
    slack = F.floor(F.col("n") * (den - num) / den)
    may_link = F.coalesce("shared", F.lit(0)) + F.col("hot") >= F.col("posted") - slack
    classes = materialize(classes.join(shared, "d1", "left").select("rep", "d1", "d2", "n", "copies", may_link.alias("open")), "classes")
    open_ = materialize(classes.where("open").select("rep", "d1", "d2", "n", F.monotonically_increasing_id().alias("node")), "open")
    n_open = open_.count()

    wanted = maybe_broadcast(open_.select(F.col("rep").alias("id")).distinct(), n_open)
    sets = map_arrow(known.join(wanted, "id", "left_semi"), _full_sets(width), "id long, d1 long, d2 long, grams array<long>")
    sets = sets.join(maybe_broadcast(open_.select(F.col("rep").alias("id"), "d1", "d2", "n", "node"), n_open), ["id", "d1", "d2"])
    sets = materialize(sets.dropDuplicates(["node"]).select("node", "n", "grams"), "sets")

    postings = sets.select("node", "n", F.explode("grams").alias("gram"))
    often = materialize(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    # the global order as one number: the power of two of the frequency, then 58 bits of the fingerprint
    key = F.shiftleft(F.floor(F.log2("df")).cast("long"), 58).bitwiseOR(F.shiftrightunsigned("gram", 6))
    ordered = join_hot(postings, often, ["gram"], "df").groupBy("node", "n").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    ordered = ordered.where(F.size("keys") >= F.col("n") - slack)
    in_prefix = F.greatest(F.lit(0), slack + 1 - (F.col("n") - F.size("keys"))).cast("int")
    ordered = materialize(ordered.withColumn("in_prefix", in_prefix), "ordered")

    prefixes = ordered.where("in_prefix > 0").select("node", F.explode(F.slice("keys", 1, F.col("in_prefix"))).alias("key"))
    pivots = materialize(prefixes.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1"), "pivots")
    edges = join_hot(prefixes, pivots, ["key"], "members").where("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    blocks = materialize(connected_components(edges), "blocks")

    weight = blocks.join(ordered.select("node", F.size("keys").alias("g")), "node").groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("g").alias("g"))
    weight = weight.select("component", "m", _chunks("m", "g", chunk_sets, chunk_grams).alias("chunks"))
    placed = materialize(join_hot(blocks, materialize(weight, "weight"), ["component"], "m"), "placed")
    to_all = (F.col("chunks") > 1) & (F.pmod(F.xxhash64(F.lit(3), "node"), F.col("m")) < F.floor(F.col("m") * shared_share / F.col("chunks")))
    home = F.array(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = placed.select("component", "node", F.explode(F.when(to_all, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(home)).alias("chunk"))
    packed = map_arrow(ordered.select("node", "n", "keys"), _pack, "node long, n int, keys binary")
    links = materialize(dealt.join(packed, "node").groupBy("component", "chunk").applyInArrow(_join_block(num, den), "a long, b long"), "links")
    large = placed.where("chunks > 1")
    if large.limit(1).count():
        links = links.unionByName(_link_large(large.select("node", "component", "m"), ordered, packed, links, _join_block(num, den), chunk_sets, chunk_grams))
        labels = connected_components(links)
    else:
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        labels = labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())

    linked = materialize(open_.join(labels, "node").select("d1", "d2", "rep", "component"), "linked")
    least = materialize(linked.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("size")), "least")
    of_class = join_hot(linked, least, ["component"], "size").select("d1", "d2", "least")
    labelled = classes.join(of_class, ["d1", "d2"], "left").select("d1", "d2", "copies", F.coalesce("least", "rep").alias("c"))
    with_set = join_hot(docs.where("n > 0").select("id", "n", "d1", "d2"), materialize(labelled, "labelled"), ["d1", "d2"], "copies")
    result = with_set.select("id", "n", "c").unionByName(docs.where("n = 0").select("id", "n", F.col("id").alias("c")))
    nulls = map_arrow(narrow.where("id is null"), _full_sets_null(width), "n int").select(F.lit(None).cast("long").alias("id"), "n", F.lit(None).cast("long").alias("c"))
    result = result.unionByName(nulls)
    return result.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.col("c").alias("component_id"))


def _full_sets_null(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE_BYTES):
            _, _, n = shingle_sets(*raw(b.column(1)), width)
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32))], names=["n"])

    return run


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component. Rows with a null id stay, and all rows of an id of
    which some row is the smallest of its component."""
    found = ngram_jaccard_components(df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")), "id", "text", **options).where("id is not null")
    gone = found.groupBy("id").agg(F.every(F.col("component_id") != F.col("id")).alias("all")).where("all").select("id")
    gone = materialize(gone, "gone")
    rows = df.select(F.struct(*map(quoted, df.columns)).alias("row"), quoted(id_col).alias("id"))
    return rows.join(maybe_broadcast(gone, gone.count()), "id", "left_anti").select("row.*")
