"""Queries of seeded draws over a number of orders that their SQL does not list, each against Python's own generator."""

import random

import pytest
from pyspark.sql import functions as F

from tracepairs import queries as Q
from tracepairs import queries_training as QT


@pytest.fixture(scope="module")
def copied(spark, sf_dir, tmp_path_factory):
    """Three copies of the orders, the keys of which go on without gaps: their folder, and the rows by key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n, folder = orders.count(), str(tmp_path_factory.mktemp("copied"))
    copies = orders.crossJoin(spark.range(3).withColumnRenamed("id", "copy"))
    copies.withColumn("o_orderkey", F.col("o_orderkey") + n * F.col("copy")).drop("copy").repartition(5).write.parquet(f"{folder}/orders.parquet")
    rows = sorted(spark.read.parquet(f"{folder}/orders.parquet").collect(), key=lambda r: r.o_orderkey)
    assert [r.o_orderkey for r in rows] == list(range(3 * n))
    return folder, rows


def test_audit_sample(spark, copied):
    folder, orders = copied
    rng, want = random.Random(17), []
    for i, bucket in enumerate(QT._BUCKETS):
        keys = [r.o_orderkey for r in orders if r.o_orderkey % 3 == i]
        rng.shuffle(keys)
        want += [(bucket, place, key) for place, key in enumerate(keys[:40])]
    got = Q.queries()["audit_sample"](spark, folder).select("bucket", "place", "o_orderkey")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_gsm8k_prompts(spark, copied):
    folder, orders = copied
    want = []
    for out, key in enumerate(sorted(random.Random(42).sample(range(len(orders)), 100))):
        price, asked = int(orders[key].o_totalprice), f"What does order {key} cost?"
        prompt = f"{asked} Think Step by Step." if key % 2 == 0 else f"{asked}\nShow your reasoning step by step."
        answer, solution = [(str(price), None), (str(price), f"It costs {price} in all."), ("none given", None)][key % 3]
        want.append((f"train__1__{out:05d}", prompt, answer, solution, "train[:1]"))
    got = Q.queries()["gsm8k_prompts"](spark, folder).select("id", "prompt", "answer", "reference_solution", "source_split")
    assert sorted(map(tuple, got.collect())) == want


def test_prompt_samples(spark, copied):
    folder, orders = copied
    want = []
    for which, count, seed in (("train", 60, 5), ("eval", 40, 6)):
        want += [(which, f"p{key}", str(orders[key].o_custkey)) for key in random.Random(seed).sample(range(len(orders)), count)]
    got = Q.queries()["prompt_samples"](spark, folder).select("which", "id", "answer")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_seeded_sample(spark, copied):
    folder, orders = copied
    got = Q.queries()["seeded_sample"](spark, folder).select("ord", "o_orderkey")
    assert sorted(map(tuple, got.collect())) == [(key, key) for key in sorted(random.Random(42).sample(range(len(orders)), 100))]
