"""Queries of what comes before and after the pairs: prefix trees, training order, audits, batches, step figures, data sets,
synthetic gold rows; and the same in SQL. They are registered with those of :mod:`tracepairs.queries`."""

from __future__ import annotations

import dataclasses
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracepairs.config import RunConfig, TrainingConfig
from tracepairs.operators import pairs as P
from tracepairs.operators import process_rows as M
from tracepairs.operators import sampling as S
from tracepairs.operators import scoring as G
from tracepairs.operators import training as B
from tracepairs.queries import _KEPT_SQL, BASE, _dec, _query, _r, _scratch, _table, _with, scored_traces
from tracepairs.sources.datasets import load_dataset
from tracepairs.sources.stages import staged

# --- prefix trees -------------------------------------------------------------------------------------------

_PREFIXES_SQL = ", px AS (SELECT x.id, x.t, x.pos, string_agg(y.step, chr(10) ORDER BY y.pos) AS prefix FROM st x JOIN st y ON x.id = y.id AND x.t = y.t AND y.pos <= x.pos GROUP BY x.id, x.t, x.pos)"


@_query(_with(f"{_PREFIXES_SQL} SELECT id, count(*) AS prefixes, count(DISTINCT prefix) AS different FROM px GROUP BY id"))
def prefix_tree(spark, sf_dir):
    return G.prefix_counts(scored_traces(spark, sf_dir), ["id"])


@_query(_with(rf"{_PREFIXES_SQL} SELECT id, t AS trace_id, pos, round((1 + len(regexp_extract_all(prefix, '\d'))) / (2 + len(regexp_extract_all(prefix, '\d')) + length(prefix) / 100.0), 6) AS score FROM px"))
def score_prefixes_in_tree(spark, sf_dir):
    def make_scorer():
        def score(frames):
            for pdf in frames:
                digits = pdf["prefix"].str.count(r"\d")
                yield (1 + digits) / (2 + digits + pdf["prefix"].str.len() / 100)

        return score

    t = scored_traces(spark, sf_dir).select("id", "trace_id", "steps", F.concat(F.lit("user "), "id").alias("prompt"), F.lit("1").alias("answer"), F.lit("1").alias("final_answer"))
    return G.score_traces_in_batches(t, make_scorer).select("id", "trace_id", F.posexplode("step_scores").alias("pos", "score")).withColumn("score", F.round("score", 6))


# --- order and audits ---------------------------------------------------------------------------------------

_LAST = 1_000_000  # above all user ids: the file begins with the first trace of the last user


def _ordered_traces(spark, sf_dir):
    return scored_traces(spark, sf_dir).withColumn("ord", F.col("trace_id").cast("long") * _LAST + _LAST - F.col("id"))


@_query(_dec(BASE, f""" SELECT id, a AS a_id, b AS b_id, k, row_number() OVER (ORDER BY round(conf, 6) DESC, round(training_weight, 6) DESC, {_LAST} - id, a, b) AS training_rank FROM dec WHERE {_KEPT_SQL}"""))
def training_rank(spark, sf_dir):
    kept = P.pairs(P.decisions(_ordered_traces(spark, sf_dir), BASE)).withColumns({c: F.round(c, 6) for c in ("confidence", "training_weight")})
    # staged, as the ranges' sampling reads its input once more; and only what the order and the result need
    kept = staged(kept.select("id", "a_trace_id", "b_trace_id", "k", "confidence", "training_weight", "prompt_ord", "a_ord", "b_ord"), "kept")
    return P.training_order(kept).select("id", F.col("a_trace_id").alias("a_id"), F.col("b_trace_id").alias("b_id"), "k", "training_rank")


_REPEATED_SQL = """, pl AS (SELECT id, t, max(t) OVER (PARTITION BY id, t % 3) AS last_t FROM tr)
SELECT pl.id, pl.t AS ord, pl.t % 3 AS trace_id, cs.pos, round(cs.z, 6) AS z, sup.n, round(sup.p, 6) AS p
FROM pl JOIN cs ON cs.id = pl.id AND cs.t = pl.last_t LEFT JOIN cs own ON own.id = pl.id AND own.t = pl.t AND own.pos = cs.pos LEFT JOIN sup ON sup.id = own.id AND sup.pos = own.pos AND sup.c = own.c"""


@_query(_with(_REPEATED_SQL))
def repeated_traces(spark, sf_dir):
    """Traces with ids that occur again in a prompt: support by place, scores of the last one."""
    traces = scored_traces(spark, sf_dir).withColumn("ord", F.col("trace_id").cast("long")).withColumn("trace_id", F.col("trace_id") % 3)
    support = F.get(F.col("support"), F.col("pos"))
    return P.prepare(traces).select("id", "ord", "trace_id", "support", F.posexplode("z").alias("pos", "z")).select("id", "ord", "trace_id", "pos", _r("z"), support["n"].alias("n"), _r(support["p"], "p"))


_BUCKETS = ("low", "medium", "high")


def _audited_sql(seed: int, k: int) -> str:
    """The draws of Python's generator for the sizes of the test table: a third of the orders in each bucket."""
    cases = {}
    for n in (1500, 15_000, 150_000):
        rng, rows = random.Random(seed), []
        for i, bucket in enumerate(_BUCKETS):
            order = list(range(i, n, 3))
            rng.shuffle(order)
            rows += [(bucket, place, key) for place, key in enumerate(order[:k])]
        cases[n] = rows
    values = lambda i: " ".join(f"WHEN {n} THEN {[r[i] for r in rows]}" for n, rows in cases.items())
    columns = [f"unnest(CASE (SELECT count(*) FROM orders) {values(i)} END) AS {name}" for i, name in enumerate(("bucket", "place", "o_orderkey"))]
    return f"SELECT bucket, CAST(place AS INTEGER) AS place, CAST(o_orderkey AS BIGINT) AS o_orderkey FROM (SELECT {', '.join(columns)})"


@_query(_audited_sql(17, 40))
def audit_sample(spark, sf_dir):
    bucket = F.element_at(F.array(*map(F.lit, _BUCKETS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", bucket.alias("bucket"))
    return S.audit_sample(orders, "bucket", list(_BUCKETS), [F.col("o_orderkey")], 40, 17).select("bucket", "place", "o_orderkey")


# --- training -------------------------------------------------------------------------------------------------

#: Token ids of a conversation turn: the lengths of its words, of those of them that are long, and of its role.
_ENCODED_SQL = """e AS (
  SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INTEGER))[1:40] AS prefix_ids,
         list_filter(list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INTEGER)), lambda n: n > 4)[1:40] AS pref_ids, [CAST(length(role) AS INTEGER)] AS disp_ids FROM conversations
), o AS (
  SELECT *, md5('5:1:' || conv_id || ':' || turn) AS h, len(prefix_ids) + len(pref_ids) + len(disp_ids) AS tokens FROM e
)"""


def _encoded(spark, sf_dir):
    ids = F.transform(F.split("text", " ", -1), lambda w: F.length(w))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("prefix_ids"), F.filter(ids, lambda n: n > 4).alias("pref_ids"), F.array(F.length("role")).alias("disp_ids"), F.lit(0.5).alias("weight"))
    return B.truncated(rows, 40)


@_query(f"""WITH {_ENCODED_SQL}, b AS (SELECT *, (row_number() OVER (ORDER BY h, conv_id, turn) - 1) // 8 AS batch FROM o), m AS (
  SELECT *, (row_number() OVER (PARTITION BY batch ORDER BY h, conv_id, turn) - 1) AS place, max(len(prefix_ids)) OVER (PARTITION BY batch) AS m1, max(len(pref_ids)) OVER (PARTITION BY batch) AS m2 FROM b)
SELECT batch, string_agg(array_to_string(list_concat(prefix_ids, list_resize([]::INTEGER[], m1 - len(prefix_ids), 99)), ',') , ';' ORDER BY place) AS prefix_ids,
  string_agg(array_to_string(list_concat(pref_ids, list_resize([]::INTEGER[], m2 - len(pref_ids), 99)), ','), ';' ORDER BY place) AS pref_ids,
  string_agg(array_to_string(disp_ids, ','), ';' ORDER BY place) AS disp_ids,
  string_agg(repeat('1', len(pref_ids)) || repeat('0', m2 - len(pref_ids)), ';' ORDER BY place) AS pref_mask, CAST(sum(0.5) AS DOUBLE) AS weight FROM m GROUP BY batch""")  # fmt: skip
def training_batches(spark, sf_dir):
    batched = B.in_batches(_encoded(spark, sf_dir), B.epoch_order(5, 1, "conv_id", "turn"), batch_size=8)
    lists = lambda c, sep: F.array_join(F.transform(c, lambda x: F.array_join(x, sep)), ";")
    weight = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
    return B.collated(batched, 99).select("batch", *[lists(c, ",").alias(c) for c in B.SEQUENCES], lists("pref_ids_mask", "").alias("pref_mask"), weight.alias("weight"))


@_query(f"""WITH {_ENCODED_SQL}, c AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY h, conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 300 AS cut FROM o)
SELECT conv_id, turn, dense_rank() OVER (ORDER BY cut) - 1 AS batch, CAST(row_number() OVER (PARTITION BY cut ORDER BY h, conv_id, turn) - 1 AS INTEGER) AS place FROM c""")
def token_batches(spark, sf_dir):
    return B.in_batches(_encoded(spark, sf_dir), B.epoch_order(5, 1, "conv_id", "turn"), max_tokens=300).select("conv_id", "turn", "batch", "place")


#: Batch metrics: a run is a user, its events in order are batches, twenty an epoch (of those with three epochs or more).
TRAINING = dataclasses.replace(RunConfig(), training=TrainingConfig(grad_accum_steps=3, num_epochs=3, batch_size=2, lr=0.001, warmup_ratio=0.2))
_METRICS_SQL = """m AS (SELECT id AS run, CAST(rn // 20 + 1 AS INTEGER) AS epoch, CAST(rn % 20 + 1 AS INTEGER) AS batch, value / 500.0 AS loss, value / 1000.0 AS dpo_term, CASE WHEN event_type <> 'click' THEN value / 2000.0 END AS ref_pen
FROM ev WHERE rn < 60 AND id IN (SELECT id FROM ev GROUP BY id HAVING count(*) >= 60)), s AS (SELECT *, (epoch - 1) * 7 + (batch + 2) // 3 AS step FROM m)"""


def _metrics(spark, sf_dir):
    ev = _table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    ev = ev.withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).where("rn < 60 AND all >= 60")
    return ev.select(
        F.col("user_id").alias("run"), F.floor(F.col("rn") / 20 + 1).cast("int").alias("epoch"), (F.col("rn") % 20 + 1).cast("int").alias("batch"), (F.col("value") / 500.0).alias("loss"),
        (F.col("value") / 1000.0).alias("dpo_term"), F.when(F.col("event_type") != "click", F.col("value") / 2000.0).alias("ref_pen"),
    )


@_query(_with("""SELECT run, step, any_value(epoch) AS epoch, count(*) AS batches, round(arg_max(loss, batch), 6) AS loss, round(arg_max(dpo_term, batch), 6) AS dpo_term, round(arg_max(coalesce(ref_pen, 0), batch), 6) AS ref_pen, round(avg(loss), 6) AS mean_loss,
  round(avg(arg_max(loss, batch)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving_loss,
  round(0.001 * CASE WHEN step - 1 < 4 THEN (step - 1) / 4.0 ELSE greatest(0, 0.5 * (1 + cos(pi() * (step - 1 - 4) / 17.0))) END, 9) AS learning_rate FROM s GROUP BY run, step""", _METRICS_SQL))  # fmt: skip
def optimizer_steps(spark, sf_dir):
    steps = B.optimizer_steps(_metrics(spark, sf_dir), TRAINING, moving=4)
    return steps.select("run", "step", "epoch", "batches", *[_r(c) for c in ("loss", "dpo_term", "ref_pen", "mean_loss", "moving_loss")], F.round("learning_rate", 9).alias("learning_rate"))


@_query(_with(" SELECT run, CAST(max(batch) AS BIGINT) AS num_batches, CAST(count(DISTINCT step) AS BIGINT) AS num_steps, 6 AS effective_batch_size, round(avg(loss), 12) AS mean_loss, round(avg(dpo_term), 12) AS mean_dpo_term, round(coalesce(avg(ref_pen), 0), 12) AS mean_ref_pen FROM s GROUP BY run", _METRICS_SQL))
def training_summary(spark, sf_dir):
    out = B.training_summary(_metrics(spark, sf_dir), TRAINING)
    return out.select("run", "num_batches", "num_steps", "effective_batch_size", *[F.round(c, 12).alias(c) for c in ("mean_loss", "mean_dpo_term", "mean_ref_pen")])


# --- data -----------------------------------------------------------------------------------------------------

_FILE_ROWS = 500_000  # of a file; one task puts them in order

@_query("""WITH o AS (SELECT o_orderkey, 'q' || o_orderkey AS question, o_orderstatus AS answer, count(*) OVER () AS n FROM orders)
SELECT question, answer, o_orderkey - n // 10 AS ord FROM o WHERE o_orderkey >= n // 10 AND o_orderkey < n // 5 UNION ALL SELECT question, answer, n // 5 - n // 10 + o_orderkey - (n - 5) FROM o WHERE o_orderkey >= n - 5""")
def dataset_slices(spark, sf_dir):
    """A tenth of one split and the last rows of another, from several files, more of them the more rows there are."""
    root = _scratch(spark, "datasets")
    full = -(-_table(spark, sf_dir, "orders").count() // _FILE_ROWS)
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("q"), "o_orderkey").alias("question"), F.col("o_orderstatus").alias("answer"), F.lit("unused").alias("more"))
    rows.repartitionByRange(max(3, full), "o_orderkey").sortWithinPartitions("o_orderkey").drop("o_orderkey").write.parquet(f"{root}/sums/main/train")
    rows.repartitionByRange(max(2, full), "o_orderkey").sortWithinPartitions("o_orderkey").drop("o_orderkey").write.json(f"{root}/sums/main/test")
    return load_dataset(spark, root, "sums", "main", "train[10%:20%]+test[-5:]", "question string, answer string")


def _process_sql(table: str, key: str, seed: int) -> str:
    drawn = lambda name, n: f"CAST('0x' || substr(md5('{M.draw_key(seed, name)}' || {key}), 1, 8) AS BIGINT) % {n}"
    draws = ", ".join(f"{lo} + {step} * ({drawn(f'{i}.{n}', (hi - lo) // step + 1)}) AS d{i}_{n}" for i, t in enumerate(M.TEMPLATES) for n, (lo, hi, step) in t.draws.items())
    parts = []
    for i, t in enumerate(M.TEMPLATES):
        names = M.names_sql(i, t)
        lines = lambda xs: " || ' ## ' || ".join(M.text_sql(x, names) for x in xs)  # noqa: B023, E731
        parts.append(f"""SELECT id, {t.gold} AS gold_earliest_error_step, {M.text_sql(t.question, names)} AS prompt, CAST({names[t.answer]} AS VARCHAR) AS answer,
  {lines(M.answered(t.right, t.answer))} AS correct_steps, {lines(M.answered(t.wrong, t.other))} AS incorrect_steps, CAST({names[t.other]} AS VARCHAR) AS incorrect_final_answer FROM r WHERE which = {i}""")
    return f"WITH r AS (SELECT {key} AS id, {drawn('template', len(M.TEMPLATES))} AS which, {draws} FROM {table}) " + " UNION ALL ".join(parts)


@_query(_process_sql("orders", "CAST(o_orderkey AS VARCHAR)", 44))
def process_templates(spark, sf_dir):
    """A gold record for each order."""
    key = F.col("o_orderkey").cast("string")
    rows = M.process_rows_of(_table(spark, sf_dir, "orders"), key, key, 44)
    return rows.withColumns({c: F.array_join(c, " ## ") for c in ("correct_steps", "incorrect_steps")})
