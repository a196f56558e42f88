"""Columns of any name, and columns that Spark knows not to be null, through every operator; wrong results that such rows once gave."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracepairs.llm.bpe_tree import bpe_decode, bpe_encode, bpe_round_trip, token_digests
from tracepairs.llm.common import remove_tables
from tracepairs.llm.exact_dedup import drop_copies, exact_dedup
from tracepairs.llm.langid import identify_documents, keep_identified
from tracepairs.llm.media import decode_avi, text_to_avi
from tracepairs.llm.mixing import mix, source_targets, take_mix
from tracepairs.llm.ngram_join import drop_near_copies, ngram_jaccard_components
from tracepairs.llm.shuffle_shards import shuffled_shards
from tracepairs.llm.spelling import spelling_variants
from tracepairs.llm.suffix_dedup import remove_repeats
from tracepairs.llm.token_counts import count_tokens, counts_by_piece
from tracepairs.llm.warc import read_archives, write_archives
from tracepairs.llm.winnowing import contamination, decontaminate

V = pytest.importorskip("public_tokenizers")
BPE, WORDS = V.path("byte_bpe_multi_50k.tiktoken"), V.path("word_bpe_49k.json")
ID, TEXT = "the.id", "its `text`, whole"
CLASHING = ["__id", "__n", "__times", "__gone", "__x", "__row", "row", "h", "__key", "__number", "none", "c0", "k", "__bucket", "a.b", "id", "text", "`", "__t", "__in"]


@pytest.fixture(scope="module", autouse=True)
def tables(spark):
    yield
    remove_tables(spark)


@pytest.fixture(scope="module")
def odd(spark):
    """Columns that are never null, nested ones too, under all these names."""
    nested = F.struct(F.lit(1).alias("x.y"), F.array(F.lit("v")).alias("`")).alias("nested.one")
    text = F.concat(F.lit("these are the words of a text that has a number, "), F.col("id"))
    columns = [F.col("id").alias(ID), text.alias(TEXT), F.lit("en").alias("lang"), F.lit("s").alias("source"), nested]
    df = spark.range(6).select(*columns, *[(F.col("id") * 100 + i).alias(c) for i, c in enumerate(CLASHING)])
    assert not any(f.nullable for f in df.schema)
    return df


CARRYING = {
    "bpe_encode": lambda df: bpe_encode(df, BPE, V.PATTERN, TEXT, "ids.of"),
    "bpe_decode": lambda df: bpe_decode(bpe_encode(df, BPE, V.PATTERN, TEXT, "ids.of"), BPE, V.PATTERN, "ids.of", "out"),
    "bpe_round_trip": lambda df: bpe_round_trip(df, BPE, V.PATTERN, TEXT, "ids.of", "out.of"),
    "avi": lambda df: decode_avi(text_to_avi(df, TEXT, "a film"), "a film"),
    "remove_repeats": lambda df: remove_repeats(df, ID, TEXT),
    "drop_copies": lambda df: drop_copies(df, ID, TEXT),
    "drop_near_copies": lambda df: drop_near_copies(df, ID, TEXT),
    "keep_identified": lambda df: keep_identified(df, ID, TEXT),
    "take_mix": lambda df: take_mix(df, ID, TEXT, weights=(1,)),
    "shuffled_shards": lambda df: shuffled_shards(df, 2, ID, TEXT),
    "decontaminate": lambda df: decontaminate(df, df.select(F.lit(1).alias("item_id"), F.lit("x").alias("text")), TEXT),
}


@pytest.mark.parametrize("name", CARRYING)
def test_columns_are_carried(odd, name):
    out = CARRYING[name](odd)
    assert out.columns[: len(odd.columns)] == odd.columns
    assert sorted(tuple(r)[: len(odd.columns)] for r in out.collect()) == sorted(map(tuple, odd.collect()))


NARROW = {
    "components": lambda df: ngram_jaccard_components(df, ID, TEXT),
    "digests": lambda df: token_digests(df, BPE, V.PATTERN, ID, TEXT),
    "exact_dedup": lambda df: exact_dedup(df, ID, TEXT),
    "identify": lambda df: identify_documents(df, ID, TEXT),
    "count_tokens": lambda df: count_tokens(df, WORDS, ID, TEXT),
    "mix": lambda df: mix(df, ID, TEXT),
    "contamination": lambda df: contamination(df, df.select(F.lit(1).alias("item_id"), F.lit("x").alias("text")), ID, TEXT),
}


@pytest.mark.parametrize("name", NARROW)
def test_ids_of_any_name(odd, name):
    out = NARROW[name](odd)
    assert sorted(r[0] for r in out.select(out[f"`{ID}`"]).collect()) == list(range(6))


def test_other_results_of_odd_columns(odd):
    words = spelling_variants(odd, ID, TEXT, min_length=4, min_count=2)
    assert {"these", "words", "text", "number"} <= {r.word for r in words.collect()}
    assert read_archives(write_archives(odd, ID, "source", TEXT)).count() == 6


# --- rows that once gave wrong results --------------------------------------------------------------------


@pytest.mark.parametrize("change", [{"normalizer": None}, {"normalizer": {"type": "NFC"}}, {}])
def test_tokens_of_a_tokenizer_that_keeps_case(spark, tmp_path, change):
    """The short cut for ASCII words holds only where the tokenizer lower-cases."""
    with open(WORDS, encoding="utf-8") as f:
        spec = json.load(f)
    path = tmp_path / "t.json"
    path.write_text(json.dumps({**spec, **change}))
    texts = ["Hello World", "IT'S HTTPServer ABC123", "plain words", "we'll We'LL X1Y2", "École ÉCOLE", None]
    rows = count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(path)).collect()
    tokenizer = Tokenizer.from_file(str(path))
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(tokenizer.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    assert counts_by_piece(path.read_text()) == (not change)


def test_counts_do_not_use_the_state_of_another_call(spark, tmp_path):
    df = spark.createDataFrame([(1, "one two Three")], "doc_id long, text string")
    with open(WORDS, encoding="utf-8") as f:
        spec = json.load(f)
    other = tmp_path / "o.json"
    other.write_text(json.dumps({**spec, "normalizer": None}))
    a = [count_tokens(df, p, cache_size=c).first().n_tokens for p, c in ((WORDS, 5), (str(other), 5), (WORDS, 1), (str(other), 1))]
    assert a[0] == a[2] and a[1] == a[3]


@pytest.mark.parametrize("id_of", [lambda i: None, lambda i: 7, lambda i: i % 40 or None, lambda i: i])
def test_mix_keeps_its_budget(spark, id_of):
    """Without ids, or with repeated ones, each row is taken by its own part: a source exceeds its target by less than one
    document."""
    rng = random.Random(3)
    rows = [(id_of(i), "w " * (9 if i % 3 else rng.randint(1, 30)), "abc"[i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = take_mix(df, weights=(1, 2, 6))
    taken = collections.Counter()
    for r in out.collect():
        taken[r.source] += len(r.text.split())
    sizes = df.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).cast("long").alias("source_size"))
    for t in source_targets(sizes, "source", (1, 2, 6), 3).collect():
        assert int(t.target) <= taken[t.source] < int(t.target) + 30 * 3, t


def test_null_texts_spread_over_buckets(spark):
    """Rows count for the size of buckets even if their texts are null."""
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("x" * 20).alias("more"))
    out = shuffled_shards(rows, 4, bucket_bytes=1 << 16)
    counts = {r["shard"]: (r["n"], r["lo"], r["hi"]) for r in out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()}
    assert counts == {i: (10_000, 0, 9999) for i in range(4)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__bucket" in plan
    from tracepairs.llm.shuffle_shards import row_bytes

    assert rows.agg(F.sum(row_bytes(rows))).first()[0] == 40_000 * 28
