"""Language identification: known words first, shorter and shorter character n-grams for unseen ones.

The model holds, per language, log frequencies of all words and of all character n-grams (with word edges) of lengths
1 to 4 of the texts that it is fitted on. These are the different texts of labelled rows: all of them up to
``max_train_docs`` different texts. Beyond that each language has an equal share of this number, what small
languages leave goes to the others, and those texts are learned whose hash falls below the threshold of their
language. Each text counts once for a label, so a large group of copies neither outgrows that bound nor
outweighs other texts; and every language keeps at least one text, however rare it is.
Counting words and n-grams is a grouped aggregation; only the model, which the bound on its texts bounds, reaches the
driver and the workers.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracepairs.llm.common import map_arrow, materialize, quoted, slices, whole_row, with_row

UNDETERMINED = "und"
_RUN = re.compile(r"[^\W\d_]+")
MAX_GRAM = 4


class Table:
    """Smoothed log frequencies by key: one matrix with a column per language, and the row of each key."""

    def __init__(self, counted: pa.Table, langs: list[str]):
        """``counted``: columns (lang, key, n), one row for each language and key."""
        lang, key, n = (c.combine_chunks() for c in counted.columns)
        key = key.dictionary_encode()
        self.row: dict[str, int] = {k: i for i, k in enumerate(key.dictionary.to_pylist())}
        counts = np.zeros((len(self.row), len(langs)))
        counts[key.indices.to_numpy(), pc.index_in(lang, pa.array(langs, pa.string())).to_numpy()] = n.to_numpy()
        self.score = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts))).astype(np.float32) if len(counts) else counts


@dataclass
class Model:
    """Tables of words and of n-grams (by length, 1 first)."""

    langs: list[str]
    words: Table
    grams: list[Table] = field(default_factory=list)

    def score_word(self, word: str) -> np.ndarray:
        found = self.words.row.get(word)
        if found is not None:
            return self.words.score[found]
        edged = f"<{word}>"
        for n in range(MAX_GRAM, 0, -1):  # back off to the longest n-grams of which one is known
            table = self.grams[n - 1]
            hits = [table.row[g] for i in range(len(edged) - n + 1) if (g := edged[i : i + n]) in table.row]
            if hits:
                return table.score[hits].mean(axis=0)
        return np.zeros(len(self.langs))


def train_limits(counts: dict[str, int], most: int) -> dict[str, float]:
    """The share of the different texts of each language to learn from: ``most`` texts are dealt out evenly, and what
    a language does not have goes to the others."""
    shares, left = {}, float(most)
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left / (len(counts) - i))
        shares[lang] = take / n
        left -= take
    return shares


def _has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and other signs of words but digits, in lower case; those without a letter do not count."""
    return _RUN.findall(text.lower())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 1 << 20):
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for w in words_of(text):
                counts[lang, w] = counts.get((lang, w), 0) + 1
        counts = {k: n for k, n in counts.items() if _has_letter(k[1])}
        if counts:
            langs, words = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(words), pa.array(list(counts.values()), pa.int64())], names=["lang", "w", "n"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", *, max_train_docs: int = 2_000) -> Model:
    """Fit on rows with a text and a label, on ``max_train_docs`` different texts at most (or one for each language)."""
    rows = labelled.where(quoted(text_col).isNotNull() & quoted(lang_col).isNotNull()).select(quoted(lang_col).alias("lang"), quoted(text_col).alias("text"))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    texts = rows.select("lang", F.xxhash64("text").alias("h"), place.alias("place")).distinct()
    counts = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).collect()
    if sum(r.n for r in counts) > max_train_docs:
        shares = train_limits({r.lang: r.n for r in counts}, max_train_docs)
        limits = [(r.lang, max(math.floor(shares[r.lang] * (1 << 30)), r.first + 1)) for r in counts]
        limits = labelled.sparkSession.createDataFrame(limits, "lang string, below long")
        rows = rows.join(F.broadcast(limits), "lang").where(place < F.col("below")).select("lang", "text")
    words = map_arrow(rows.distinct(), _count_words, "lang string, w string, n long")
    words = materialize(words.groupBy("lang", "w").agg(F.sum("n").alias("n")), "words")
    found = words.toArrow()
    langs = sorted(found.column(0).unique().to_pylist())
    edged, start = F.concat(F.lit("<"), "w", F.lit(">")), F.sequence(F.lit(0), F.length("w") + 1)
    # every n-gram that starts at a character, with its length
    each = F.flatten(F.transform(start, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_GRAM), F.length("w") + 2 - i)), lambda k: F.substring(edged, i + 1, k))))
    grams = words.select("lang", "n", F.explode(each).alias("g")).groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()
    size = pc.utf8_length(grams.column(1))
    return Model(langs, Table(found, langs), [Table(grams.filter(pc.equal(size, k)), langs) for k in range(1, MAX_GRAM + 1)])


class Predictor:
    """Scores texts; keeps the scores of up to ``cache_size`` words."""

    def __init__(self, model: Model, cache_size: int = 60_000):
        self.model, self.size = model, cache_size
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.used = 0
        self.table = np.zeros((1024, len(self.model.langs)), np.float32)
        self.known = np.zeros(1024, bool)

    def _add(self, word: str) -> int:
        i = self.row[word] = self.used if _has_letter(word) else -1
        if i < 0:
            return i
        self.used += 1
        if i == len(self.table):
            self.table, self.known = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.known, np.zeros_like(self.known)])
        self.table[i], self.known[i] = self.model.score_word(word), word in self.model.words.row
        return i

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the share of the words that the model knows."""
        words = words_of(text) if text else []
        if not words or not self.model.langs:
            return UNDETERMINED, 0.0, 0.0
        if len(self.row) > self.size:
            self.clear()
        rows = list(map(self.row.get, words))
        if None in rows:
            row = self.row
            rows = [(row[w] if w in row else self._add(w)) if i is None else i for i, w in zip(rows, words)]
        at = np.array(rows)
        at = at[at >= 0]
        if not len(at):
            return UNDETERMINED, 0.0, 0.0
        mean = self.table[at].mean(axis=0, dtype=np.float64)
        best = int(mean.argmax())
        return self.model.langs[best], float(1 / np.exp(mean - mean[best]).sum()), float(self.known[at].mean())


_worker: dict[str, Predictor] = {}


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, known`` for each row, from its text alone.

    ``score`` is the softmax weight of the best language on mean log frequency per word, between 0 and 1. Of languages
    that score the same the first by code point is taken. ``known`` is the share of its words that the model has.
    ``und`` with score 0 if the text is null or has no letter, or if the model has no language.
    """
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    rows = df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _worker:
            _worker.clear()
            _worker[key] = Predictor(shared.value)
        predict = _worker[key].predict
        for b in slices(batches, "text", 1 << 20):
            found = list(zip(*[predict(t.as_py()) for t in b.column(1)]))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, t) for x, t in zip(found, (pa.string(), pa.float64(), pa.float64()))]], names=["id", "lang_pred", "score", "known"])
        _worker.clear()  # workers are reused by other stages

    out = map_arrow(rows, run, with_row(rows, "id", "lang_pred string, score double, known double"))
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """True for rows that the queries never learn from: crc32(id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(quoted(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """``id_col, held_out, lang_pred, score``: fitted on the rows of ``df`` that are not held out, applied to all."""
    model = fit(df.where(~held_out(id_col)), text_col, lang_col, **limits)
    return identify(df, model, id_col, text_col).withColumn("held_out", held_out(id_col)).select(quoted(id_col), "held_out", "lang_pred", "score")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, over_chance: float = 1.2, known_share: float = 0.5, **limits) -> DataFrame:
    """The rows of ``df`` whose language can be told, with their columns; one pass, no shuffle.

    Fitted as in :func:`identify_documents`. Rejected: texts that are null or have no letter, and texts with a
    score below ``over_chance`` times chance (one over the number of languages), unless the model knows ``known_share`` of
    their words: a text in several languages scores low for each, but is no junk.
    """
    model = fit(df.where(~held_out(id_col)), text_col, lang_col, **limits)
    found = identify(df.select(whole_row(df).alias("row"), quoted(text_col).alias("text")), model, "row", "text")
    told = (F.col("score") >= min(1.0, over_chance / max(1, len(model.langs)))) | (F.col("known") >= known_share)
    return found.where((F.col("lang_pred") != UNDETERMINED) & told).select("row.*")
