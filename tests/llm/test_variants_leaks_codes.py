"""Spelling variants, benchmark decontamination and vector codes against brute force, on awkward rows and on the test tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracepairs.llm import queries as Q
from tracepairs.llm import spelling, vector_codes, winnowing
from tracepairs.llm.common import remove_tables
from tracepairs.llm.spelling import near_words, spelling_variants
from tracepairs.llm.vector_codes import compress_vectors, decompress
from tracepairs.llm.winnowing import contamination, decontaminate, item_digest

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module", autouse=True)
def tables(spark):
    yield
    remove_tables(spark)


# --- spelling variants --------------------------------------------------------------------------------------


def plain_variants(docs, min_length=6, min_count=5, ratio=5):
    counts = collections.Counter()
    for d, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    near = {w: {v for v in words if one_edit(w, v)} for w in words}
    form = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: f for w, f in form.items() if words[f] >= ratio * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root)
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def variants(df, **options):
    rows = spelling_variants(df, **options).collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


def _misspelt(seed, n_words, n_docs):
    rng = random.Random(seed)
    letters = "abcdefgéÀß÷"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(n_words)]
    pool = []
    for s in stems:
        pool += [s] * 60
        for _ in range(4):
            at = rng.randrange(len(s))
            v = rng.choice([s[:at] + s[at + 1 :], s[:at] + rng.choice(letters) + s[at:], s[:at] + rng.choice(letters) + s[at + 1 :]])
            pool += [v] * rng.choice([4, 6, 12])
            pool += [v[:-1] + "z"] * 2
    rng.shuffle(pool)
    cut = [pool[i::n_docs] for i in range(n_docs)]
    glue = [" ", ", ", "1", "\n", "日", "-"]
    return [(i, "".join((w.upper() if rng.random() < 0.3 and w.isascii() else w) + rng.choice(glue) for w in words)) for i, words in enumerate(cut)]


@pytest.mark.parametrize("group_words", [2048, 8, 1])
def test_variants(spark, group_words):
    rows = _misspelt(3, 60, 40)
    long = "abcdé" * 4000
    rows += [(None, None), (7, ""), (8, "  \n"), (None, "a b C " + "unnamedword " * 9), (None, "unnamedwords " * 2)]
    rows += [rows[0], rows[0]] + [(100 + i, f"{long} {long}x") for i in range(5)] + [(200 + i, f"{long[:-1]} pre{long}") for i in range(5)]
    rows += [(301, "qqqqqqaa " * 6), (302, "qqqqqqab " * 40), (303, "qqqqqqcb " * 250)]  # a chain of two forms
    got = variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), group_words=group_words)
    want = plain_variants(rows)
    assert got == want
    assert any(v[2] is not None for v in want.values()) and any(v[4] != v[2] and v[2] for v in want.values())


def test_variants_of_other_columns_and_nothing(spark):
    rows = [(f"k{i}", "wordword wordwird", 1, 2) for i in range(9)]
    df = spark.createDataFrame(rows, "`a.id` string, `a.text` string, word int, n int")
    assert variants(df, id_col="a.id", text_col="a.text") == plain_variants([r[:2] for r in rows])
    assert variants(df.limit(0), id_col="a.id", text_col="a.text") == {}
    assert variants(spark.createDataFrame([(1, None), (2, "so few")], "doc_id long, text string")) == {}


def test_variants_in_pieces(spark, monkeypatch):
    """A text's runs are not cut, and what a task passes on early is summed up."""
    text = " ".join(w for _, w in _misspelt(5, 20, 3))
    assert "".join(spelling._pieces(text)) == text
    monkeypatch.setattr(spelling, "_PIECE", 7)
    runs = re.compile(r"[A-Za-zÀ-ÿ]+")
    assert [w for p in spelling._pieces(text) for w in runs.findall(p)] == runs.findall(text)


def test_near_words_of_one_hot_band(spark):
    """Thousands of words under one key of a band: every pair still counts once, as brute force has it."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("aqz") for _ in range(9)) for _ in range(2500)})
    rows = [(w, i % 50 + 5) for i, w in enumerate(words)]
    have = dict(rows)
    want = {}
    for w in words:
        near = {w[:i] + c + w[i + 1 :] for i in range(9) for c in "aqz"} & have.keys() - {w}
        if near:
            best = min(near, key=lambda v: (-have[v], v))
            want[w] = (len(near), have[best], best)
    for limit in (100, 10_000):
        got = near_words(spark.createDataFrame(rows, "word string, n long"), limit).collect()
        assert {r.word: (r.n_near, r.best_n, r.best) for r in got} == want and len(got) == len(want)


def test_roots_of_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)]
    got = spelling.roots(spark.createDataFrame(chain, "word string, form string"), 5**13, 5)
    assert {r.word: r.root for r in got.collect()} == {w: "w13" for w, _ in chain}


def test_variants_on_the_test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = Q.op11_spelling_variants(spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == plain_variants(map(tuple, docs))


# --- decontamination ----------------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_hits(docs, items, window=10):
    windows = collections.defaultdict(set)
    for name, text in items:
        w = words_of(text)
        m = min(window, len(w))
        for a in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[a : a + m])].add("" if name is None else str(name))
    lengths, out = sorted({len(k) for k in windows}), []
    for d, text in docs:
        w, hit, found = words_of(text), set(), set()
        for m in lengths:
            for a in range(len(w) - m + 1):
                own = windows.get(tuple(w[a : a + m]))
                if own:
                    hit |= set(range(a, a + m))
                    found |= own
        out.append((d, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


def hits(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in df.collect()), key=repr)


def _leaks(seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijé0") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [prose(n) for n in (10, 11, 30, 60, 15, 9, 4, 1, 2, 25)]
    shared = texts[2][5:17]
    texts += [prose(12) + shared, shared + prose(3), ["same"] * 40, texts[0]]
    items = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(3, " ".join(prose(20))), (None, " ".join(texts[1])), (90, None), (91, " \n--"), (2, " ".join(texts[2]))]
    docs = []
    for i in range(60):
        w = prose(rng.randint(0, 80))
        own = texts[rng.randrange(len(texts))]
        at, m = rng.randrange(len(own)), rng.randint(1, 30)
        put = rng.randint(0, len(w))
        w[put:put] = own[at : at + m]
        docs.append((i, rng.choice([" ", "\n", "--", ", "]).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    docs += [(100, " ".join(prose(400) + texts[3] + prose(400) + texts[3])), (101, " ".join(["same"] * 500)), (102, None), (103, ""), (104, " .,- "), (None, " ".join(texts[0])), (None, None), docs[0], docs[1]]
    docs += [(200 + i, " ".join(prose(3) + texts[3] + prose(2))) for i in range(300)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"max_bits": 1 << 15, "broadcast_rows": 0}, {"window": 6, "k": 3}, {"window": 4, "k": 4}])
def test_leaks(spark, options):
    docs, items = _leaks()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(d, b, **options)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    assert hits(got) == plain_hits(docs, items, options.get("window", 10))
    assert all(r.n_items == len(r["items"]) for r in got.collect())


def test_leaks_in_steps(monkeypatch):
    """Long texts are worked on in steps that overlap by a window."""
    rng = np.random.default_rng(0)
    h = rng.integers(0, 40, 5000).astype(np.uint64)
    bounds = np.array([0, 0, 7, 1200, 1200, 4990, 5000])
    last = winnowing._last(bounds)
    assert winnowing.full(last, 10).tolist() == [i for i in range(5000) if i + 10 <= last[i]]
    starts = winnowing.full(last, 10)
    items = starts[::7]  # windows of the benchmark, and the fingerprint of each
    prints = [winnowing.winnow(h[s : s + 10], np.array([0]), 10, 5)[1] for s in items]
    bits = np.zeros(1 << 13, np.uint8)
    for x in np.concatenate([*prints, winnowing.grams(h, items, 10, 1), winnowing.grams(h, items, 3, 1)]):
        for cell in (int(x) & 65535, int(x) >> 32 & 65535):
            bits[cell >> 3] |= 1 << (cell & 7)
    for step in (16, 100, 999, 10**6):
        monkeypatch.setattr(winnowing, "_STEP", step)
        start, length, h1, h2 = winnowing.possible_hits(h, bounds, bits, 10, 5, [1, 3])
        assert len({*zip(start, length)}) == len(start)
        for m in (3, 10):
            assert {*items} <= {*start[length == m]}
            assert (h2[length == m] == winnowing.grams(h, start[length == m], m, 2)).all()
        text = b" ".join(b"%d" % i for i in h) + b" "
        data, offs = np.frombuffer(text, np.uint8), np.array([0, 3000, len(text)])
        got = winnowing.word_hashes(data, offs)
        monkeypatch.undo()
        assert (got[0] == winnowing.word_hashes(data, offs)[0]).all()


def test_every_shared_window_holds_a_common_fingerprint():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 300).astype(np.uint64), rng.integers(0, 9, 300).astype(np.uint64)
    b[50:80] = a[200:230]
    for window, k in ((10, 5), (7, 7), (12, 1)):
        prints = [dict(zip(*map(np.ndarray.tolist, winnowing.winnow(x, np.arange(301 - window), window, k)))) for x in (a, b)]
        for s in range(31 - window):
            assert any(prints[0].get(200 + s + j) == prints[1].get(50 + s + j) != None for j in range(window - k + 1))  # noqa: E711


def test_leaks_of_other_columns_and_nothing(spark):
    docs, items = _leaks(5)
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "`a.b` long, `t.x` string, id int, hits int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(docs, items)
    assert hits(contamination(d, b, "a.b", "t.x").withColumnRenamed("a.b", "doc_id")) == want
    clean = decontaminate(d, b, "t.x")
    assert clean.columns == d.columns
    assert sorted((r[0] for r in clean.collect()), key=repr) == sorted((d for d, *_, bad in want if not bad), key=repr)
    assert decontaminate(d, b, "t.x", max_share=1.0).count() == len(docs)
    none = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert hits(contamination(d, none)) == plain_hits(docs, [])
    assert contamination(d.limit(0), b).count() == 0
    one = contamination(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(items[2][1]).alias("text")), b)
    assert [r.contaminated for r in one.collect()] == [True] * 3


def test_leaks_in_a_very_long_text(spark):
    rng = random.Random(8)
    words = [f"{rng.randrange(10**6)}" for _ in range(600_000)]
    item = words[400_000:400_030]
    d = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = contamination(d, spark.createDataFrame([("a", " ".join(item))], "item_id string, text string")).first()
    assert (row.n_words, row.n_hit, row["items"]) == (600_000, 30, ["a"])


def test_leak_digest(spark):
    rows = spark.createDataFrame([([],), (["1", "10", "2"],)], "items array<string>")
    want = [hashlib.sha256(x).hexdigest() for x in (b"", b"1,10,2")]
    assert [r[0] for r in rows.select(item_digest(F.col("items"))).collect()] == want


# --- vector codes -------------------------------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2, dim=None):
    kept = [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    width = dim // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    vectors = [cut(v) for _, v, _ in kept]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (distance(v[p], books[p][e]), e)) for p in range(parts)] for v in vectors]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(vectors, codes) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = assign()
    errors = [sum(distance(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(vectors, codes)]
    by_label = collections.Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, bytes(c).hex(), e, by_label[label], sha) for (i, _, label), c, e in zip(kept, codes, errors)], key=repr)


def _vectors(n, dim, seed=0, centre=3):
    rng = random.Random(seed)
    return [[rng.gauss(rng.randrange(centre), 0.4) for _ in range(dim)] for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"parts": 4, "entries": 5, "rounds": 3}, {"parts": 8, "entries": 256, "rounds": 0}, {"parts": 1, "entries": 2, "rounds": 6}])
def test_codes(spark, options):
    rows = [(i, v, i % 3 or None) for i, v in zip(random.Random(1).sample(range(1000), 130), _vectors(130, 32))]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] * 32, 1), (2003, [1.0] * 31 + [math.nan], 1), (-5, [math.inf] * 32, 1), (2004, [1.0] * 16, 2), (None, rows[0][1], 9)]
    rows += [rows[3], (rows[4][0], rows[9][1], 2), (2005, rows[5][1], None), (2006, [70000.25] * 32, 4), (2007, [-0.0] * 32, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = vector_codes.vector_codes(df, **options)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(rows, dim=32, **options)


def test_codes_from_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label string, codes int, error int, row int"
    rows = [(i, v, None, 1, 2, 3) for i, v in enumerate([[0.5] * 16, [0.25] * 16, [0.5] * 16])]
    df = spark.createDataFrame(rows, kind)
    assert sorted(map(tuple, vector_codes.vector_codes(df).collect())) == plain_codes([r[:3] for r in rows], dim=16)
    coded, books = compress_vectors(df)
    assert coded.select("row.*").columns == ["vec_id", "label", "codes", "error", "row"] and books.entries.shape == (16, 3, 1)
    assert vector_codes.vector_codes(df.limit(0)).collect() == []
    assert vector_codes.vector_codes(df.withColumn("embedding", F.lit(None).cast("array<float>"))).collect() == []
    fixed = spark.range(4).select(F.col("id").alias("vec_id"), F.array(*[F.lit(1.5)] * 16).alias("embedding"), F.lit(1).alias("label"))
    assert [r.error for r in vector_codes.vector_codes(fixed).collect()] == [0] * 4
    with pytest.raises(ValueError):
        compress_vectors(df, entries=300)


def test_codes_stand_for_their_vectors(spark):
    rows = [(i, v) for i, v in enumerate(_vectors(300, 32, 4, 2))]
    coded, books = compress_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rounds=5)
    near = {r.id: r.v for r in coded.select("row.vec_id", decompress(F.col("codes"), books).alias("v")).toDF("id", "v").collect()}
    own = {r.id: r.error for r in coded.select("row.vec_id", "error").toDF("id", "error").collect()}
    for i, v in rows:
        cells = [math.floor(256 * x) for x in v]
        assert sum((c - (256 * y - 0.5)) ** 2 for c, y in zip(cells, near[i])) == pytest.approx(own[i])


def test_only_changed_parts_contribute(spark):
    rows = [(i, v) for i, v in enumerate(_vectors(400, 16))]
    df = spark.createDataFrame(rows, "row long, vector array<double>")
    start = vector_codes.integers(np.array([v for _, v in rows[:8]]).ravel(), 16, 256).astype(np.int64).reshape(8, 4, 4).transpose(1, 0, 2)
    books = vector_codes.Codebooks(np.ascontiguousarray(start), 256)
    first = vector_codes._assign(df, books)
    assert sum(r.n for r in vector_codes._contributions(first, books).collect()) == 400 * 4
    again = vector_codes._assign(first, books)  # the same codebooks: nothing changes
    assert vector_codes._contributions(again, books).collect() == []


def test_large_components_stay_exact(spark):
    big = vector_codes.largest(16)
    x = vector_codes.integers(np.array([1e30, -1e30] * 8 + [1e5] * 16), 16, 256)
    assert x.tolist() == [[big, -big] * 8, [25_600_000] * 16]
    codes, error = vector_codes.nearest(x, np.zeros((16, 1, 1), np.int64))
    assert error.tolist() == [16 * big * big, 16 * 25_600_000**2] and not codes.any()
