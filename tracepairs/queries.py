"""One query per operator over the test tables, and the same in SQL.

Scored traces are a view of ``events``: a prompt is a user, a trace a run of up to six consecutive events, a step
an event put into words, its score the scaled value; a trace is right when it has a purchase at position 3 or later.
"""

from __future__ import annotations

import dataclasses
import random
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracepairs.config import ConfidenceConfig, MethodConfig, PairConfig, RunConfig, VerifierConfig, from_dict
from tracepairs.functions import arrays as A
from tracepairs.functions import text as T
from tracepairs.operators import pairs as P
from tracepairs.operators import process_eval as E
from tracepairs.operators import reports as R
from tracepairs.operators import sampling as S
from tracepairs.operators import scoring as G
from tracepairs.sources.jsonl import read_jsonl, write_jsonl
from tracepairs.sources.stages import shared_folder

#: No similarity counts as near identical here, so that SQL needs no matching; :data:`SIMILAR` is the same with it.
BASE = RunConfig(
    pair=PairConfig(tau_pair=0.08, min_weight=0.35, max_pairs_per_prompt=20, max_near_identical_similarity=1.01, semi_purified_min_confidence=0.6,
                    both_correct=dataclasses.replace(PairConfig().both_correct, min_confidence=0.62), both_wrong=dataclasses.replace(PairConfig().both_wrong, min_confidence=0.65)),
    confidence=ConfidenceConfig(),
    method=MethodConfig("confidence_weighted_step_dpo"),
)
SIMILAR = dataclasses.replace(BASE, pair=dataclasses.replace(BASE.pair, max_near_identical_similarity=0.94))


# --- inputs ------------------------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = _table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(order) - 1)
    pos = (F.col("rn") % 6).alias("pos")
    step = F.concat(F.lit("Step "), F.col("rn") % 6 + 1, F.lit(": The user did a "), "event_type", F.lit(" here!")).alias("step")
    one = F.struct(pos, step, (F.col("value") / 500.0).alias("score"))
    right = (F.col("event_type") == "purchase") & (F.col("rn") % 6 >= 3)
    by = ev.groupBy(F.col("user_id").alias("id"), F.floor(F.col("rn") / 6).cast("int").alias("trace_id")).agg(F.sort_array(F.collect_list(one)).alias("s"), F.max(right).alias("final_correct"))
    return by.select("id", "trace_id", F.transform("s", lambda x: x["step"]).alias("steps"), F.transform("s", lambda x: x["score"]).alias("step_scores"), "final_correct")


def gold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold positions: user id mod 3."""
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.col("user_id").alias("id"), (F.col("user_id") % 3).cast("int").alias("gold_earliest_error_step"))


_EVENTS_SQL = r"""ev AS (
  SELECT user_id AS id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events
), st AS (
  SELECT id, CAST(rn // 6 AS INTEGER) AS t, CAST(rn % 6 AS INTEGER) AS pos, 'Step ' || (rn % 6 + 1) || ': The user did a ' || event_type || ' here!' AS step,
         value / 500.0 AS score, event_type
  FROM ev
), tr AS (
  SELECT id, t, CAST(count(*) AS INTEGER) AS len, bool_or(event_type = 'purchase' AND pos >= 3) AS ok, avg(score) AS mean_score FROM st GROUP BY id, t
), gs AS (
  SELECT id, avg(score) AS mu, stddev_pop(score) AS sd FROM st GROUP BY id
), cs AS (
  SELECT st.id, st.t, st.pos, st.step, (score - mu) / (sd + 1e-6) AS z, ok,
         regexp_replace(regexp_replace(regexp_replace(trim(lower(step)), '^step\s*\d+[:.)-]?\s*', ''), '\s+', ' ', 'g'), '[^\w\s.+\-*/=]', '', 'g') AS c
  FROM st JOIN gs USING (id) JOIN tr USING (id, t)
), sup AS (
  SELECT id, pos, c, count(*) AS n, avg(CAST(ok AS INTEGER)) AS p FROM cs GROUP BY id, pos, c
), cmp AS (
  SELECT x.id, x.t AS a, y.t AS b, x.len AS la, y.len AS lb, x.ok AS oa, y.ok AS ob FROM tr x JOIN tr y ON x.id = y.id AND x.t < y.t
), dv AS (
  SELECT cmp.id, a, b, min(p.pos) AS kd FROM cmp JOIN cs p ON p.id = cmp.id AND p.t = a JOIN cs q ON q.id = cmp.id AND q.t = b AND q.pos = p.pos
  WHERE p.c <> q.c GROUP BY cmp.id, a, b
), kk AS (
  SELECT cmp.*, coalesce(kd, CASE WHEN la <> lb THEN least(la, lb) END) AS k FROM cmp LEFT JOIN dv USING (id, a, b)
)"""


_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _canon_sql(x: str) -> str:
    s = rf"regexp_replace(regexp_replace({_TRIM.format(x=f'lower({x})')}, '^step\s*\d+[:.)-]?\s*', ''), '\s+', ' ', 'g')"
    return rf"regexp_replace({s}, '[^\p{{L}}\p{{M}}\p{{N}}_\s.+\-*/=]', '', 'g')"


def _with(sql: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([_EVENTS_SQL, *more]) + sql


def _side(x: str, h: int) -> str:
    """Per comparison what one side has at the divergence."""
    return f"""s{x} AS (
  SELECT kk.id, kk.a, kk.b, avg(z) AS local, string_agg(c, ' ' ORDER BY pos) AS sig, string_agg(step, chr(10) ORDER BY pos) AS txt
  FROM kk JOIN cs ON cs.id = kk.id AND cs.t = kk.{x} AND cs.pos >= k AND cs.pos < k + {h} GROUP BY kk.id, kk.a, kk.b
), t{x} AS (
  SELECT kk.id, kk.a, kk.b, string_agg(c, '|' ORDER BY pos) AS tail FROM kk JOIN cs ON cs.id = kk.id AND cs.t = kk.{x} AND cs.pos > k AND cs.pos < k + {h} GROUP BY kk.id, kk.a, kk.b
), d{x} AS (
  SELECT kk.id, kk.a, kk.b, CASE WHEN k <= 0 OR k >= l{x} THEN 0 ELSE greatest(0, (SELECT z FROM cs WHERE cs.id = kk.id AND cs.t = kk.{x} AND cs.pos = k - 1) - (SELECT z FROM cs WHERE cs.id = kk.id AND cs.t = kk.{x} AND cs.pos = k)) END AS drop_at,
         sup.n, sup.p
  FROM kk LEFT JOIN cs ON cs.id = kk.id AND cs.t = kk.{x} AND cs.pos = kk.k LEFT JOIN sup ON sup.id = kk.id AND sup.pos = kk.k AND sup.c = cs.c
)"""


_ONE_SPACE = r"regexp_replace({x}, '\s+', ' ', 'g')"


def _words(sig: str) -> str:
    stop = ", ".join(f"'{w}'" for w in T.STOPWORDS)
    return f"list_sort(list_distinct(list_filter(string_split({sig}, ' '), lambda w: len(w) >= 3 AND w NOT IN ({stop}))))"


#: Ratio of matching blocks for each two signatures: runs of equal characters along the diagonals, then the longest one (the
#: first in x, then in y) within an interval, and the intervals left and right of it, again and again. Up to 199 characters
#: the library's rule for frequent characters does not apply; those of the test tables are shorter.
_SIMILAR_CTES = """sp AS (
  SELECT x, y, row_number() OVER () AS p FROM (SELECT DISTINCT sa.sig AS x, sb.sig AS y FROM sa JOIN sb USING (id, a, b)) WHERE x <> y
), eq AS (
  SELECT p, i, j, i - row_number() OVER (PARTITION BY p, i - j ORDER BY i) AS island
  FROM (SELECT p, x, y, unnest(range(length(x))) AS i FROM sp), LATERAL (SELECT unnest(range(length(y))) AS j) WHERE substr(x, i + 1, 1) = substr(y, j + 1, 1)
), runs AS (
  SELECT p, min(i) AS i, min(j) AS j, count(*) AS n FROM eq GROUP BY p, i - j, island
), blocks AS (
  SELECT p, 0 AS alo, length(x) AS ahi, 0 AS blo, length(y) AS bhi, 0 AS matched FROM sp
  UNION ALL
  SELECT p, CASE WHEN side = 0 THEN alo ELSE i + n END, CASE WHEN side = 0 THEN i ELSE ahi END, CASE WHEN side = 0 THEN blo ELSE j + n END, CASE WHEN side = 0 THEN j ELSE bhi END, CASE WHEN side = 0 THEN n ELSE 0 END
  FROM (
    SELECT p, alo, ahi, blo, bhi, best[1] AS n, -best[2] AS i, -best[3] AS j FROM (
      SELECT p, alo, ahi, blo, bhi, max([least(i + n, ahi, i + bhi - j) - greatest(i, alo, i + blo - j), -greatest(i, alo, i + blo - j), i - j - greatest(i, alo, i + blo - j)]) AS best
      FROM blocks JOIN runs USING (p) WHERE least(i + n, ahi, i + bhi - j) > greatest(i, alo, i + blo - j) GROUP BY p, alo, ahi, blo, bhi
    )
  ), (SELECT unnest([0, 1]) AS side)
), simil AS (
  SELECT x, y, 2.0::DOUBLE * sum(matched) / (any_value(length(x)) + any_value(length(y))) AS ratio FROM sp JOIN blocks USING (p) GROUP BY x, y
)"""


def _decisions_ctes(cfg: RunConfig) -> list[str]:
    p, c, mode = cfg.pair, cfg.confidence, cfg.pair.pair_mode
    similar = p.max_near_identical_similarity <= 1
    ratio = "CASE WHEN sa.sig = sb.sig THEN 1 ELSE simil.ratio END" if similar else "NULL::DOUBLE"
    preamble = " OR ".join(f"contains({{x}}, '{w}')" for w in T.PREAMBLE if "'" not in w)
    info = f"""inf AS (
  SELECT kk.*, sa.sig AS siga, sb.sig AS sigb, (k IS NOT NULL AND sa.sig IS NOT NULL AND sb.sig IS NOT NULL) AS ok,
         sa.local AS loca, sb.local AS locb, da.drop_at AS dra, db.drop_at AS drb, da.n AS na, db.n AS nb, da.p AS pa, db.p AS pb,
         {p.alpha_local} * sa.local + {1.0 - p.alpha_local} * CAST(oa AS INTEGER) AS ua, {p.alpha_local} * sb.local + {1.0 - p.alpha_local} * CAST(ob AS INTEGER) AS ub,
         {ratio} AS similarity, coalesce({ratio} >= {p.max_near_identical_similarity}, false) AS near,
         coalesce(ta.tail = tb.tail, false) AS reconv, {_canon_sql('sa.txt')} AS ca, {_canon_sql('sb.txt')} AS cb
  FROM kk LEFT JOIN sa USING (id, a, b) LEFT JOIN sb USING (id, a, b) LEFT JOIN ta USING (id, a, b) LEFT JOIN tb USING (id, a, b) LEFT JOIN da USING (id, a, b) LEFT JOIN db USING (id, a, b){" LEFT JOIN simil ON simil.x = sa.sig AND simil.y = sb.sig" if similar else ""}
), fl AS (
  SELECT *, abs(ua - ub) AS margin, abs(loca - locb) AS gap, least(length(siga), length(sigb)) AS chars,
         regexp_replace(ca, '[^a-z0-9]', '', 'g') = regexp_replace(cb, '[^a-z0-9]', '', 'g') AS fmt,
         regexp_matches(ca || cb, '[0-9+*/=-]') AS math, {_words(_ONE_SPACE.format(x='ca'))} = {_words(_ONE_SPACE.format(x='cb'))} AS same_words,
         ({preamble.format(x='ca')}) AND ({preamble.format(x='cb')}) AS both_pre
  FROM inf
), gg AS (
  SELECT *, chars < {p.min_divergent_chars} AS short, chars < {p.min_divergent_chars} OR (same_words AND NOT math) AS triv, both_pre AND NOT math AS boil FROM fl
), wk AS (
  SELECT *, short OR siga = sigb OR fmt OR near OR reconv OR triv OR boil AS weak FROM gg
)"""
    weak = "CASE WHEN fmt THEN 'dropped_formatting_only' WHEN near THEN 'dropped_near_identical' WHEN reconv THEN 'dropped_unstable_boundary' WHEN triv OR boil THEN 'dropped_trivial_segment_difference' WHEN weak THEN 'dropped_weak_divergence' END"
    tau = f"CASE WHEN margin < {p.tau_pair} THEN 'dropped_utility_margin_below_tau_pair' END"
    orient = {
        "current_utility": (tau, "'current_utility'", "ua >= ub"),
        "correctness_priority": (f"CASE WHEN oa = ob THEN {tau} END", "CASE WHEN oa <> ob THEN 'correctness_priority_final_correctness' ELSE 'correctness_priority_same_correctness_utility' END", "CASE WHEN oa <> ob THEN oa ELSE ua >= ub END"),
        "strict_purified": (f"coalesce({weak}, CASE WHEN oa = ob THEN CASE WHEN oa THEN 'dropped_both_correct_ambiguous' ELSE 'dropped_both_wrong_uninformative' END END)", "'strict_purified_final_correctness'", "oa"),
        "semi_purified": (f"coalesce({weak}, CASE WHEN oa = ob THEN {tau} END)", "CASE WHEN oa <> ob THEN 'semi_purified_final_correctness' ELSE 'semi_purified_same_correctness_utility_screening' END", "CASE WHEN oa <> ob THEN oa ELSE ua >= ub END"),
    }
    drop, reason, a_first = orient[mode]
    plain = "CASE WHEN oa <> ob THEN 'kept_mixed_correctness' ELSE 'kept_same_correctness_utility_oriented' END"
    keep = plain
    if mode == "semi_purified":
        gate = lambda g: f"margin >= {g.min_utility_margin} AND gap >= {g.min_local_gap} AND conf >= {g.min_confidence} AND sgap >= {g.min_support_gap}" + (f" AND adv >= {g.min_drop_advantage}" if g.min_drop_advantage is not None else "")
        keep = f"""CASE WHEN oa <> ob THEN 'kept_mixed_correctness' WHEN conf < {p.semi_purified_min_confidence} THEN 'dropped_same_correctness_low_confidence'
              WHEN oa THEN CASE WHEN {gate(p.both_correct)} THEN 'kept_both_correct_strong_local_preference' ELSE 'dropped_both_correct_ambiguous' END
              ELSE CASE WHEN {gate(p.both_wrong)} THEN 'kept_both_wrong_delayed_error' ELSE 'dropped_both_wrong_uninformative' END END"""
    terms = [f"{g} * {f}" for use, g, f in ((c.use_margin, c.gamma_margin, "f_margin"), (c.use_sharp, c.gamma_sharp, "f_sharp"), (c.use_agree, c.gamma_agree, "f_agree"), (c.use_out, c.gamma_out, "f_out")) if use]
    whole = sum(g for use, g in ((c.use_margin, c.gamma_margin), (c.use_sharp, c.gamma_sharp), (c.use_agree, c.gamma_agree), (c.use_out, c.gamma_out)) if use) or 1.0
    weight = "conf" if cfg.method.name == "confidence_weighted_step_dpo" else "CAST(1 AS DOUBLE)"
    rest = f"""ori AS (
  SELECT *, coalesce(CASE WHEN k IS NULL THEN 'dropped_no_divergence' WHEN NOT ok THEN 'dropped_empty_divergent_segment' END, {drop}) AS early, {a_first} AS afirst, {reason} AS why FROM wk
), o2 AS (
  SELECT *, CASE WHEN early IS NULL THEN CASE WHEN afirst THEN a ELSE b END END AS pref_trace_id, CASE WHEN early IS NULL THEN CASE WHEN afirst THEN b ELSE a END END AS disp_trace_id,
         CASE WHEN early IS NULL THEN CASE WHEN afirst THEN oa ELSE ob END END AS pref_ok, CASE WHEN early IS NULL THEN CASE WHEN afirst THEN ob ELSE oa END END AS disp_ok,
         CASE WHEN early IS NULL THEN why END AS orientation_reason,
         CASE WHEN afirst THEN na ELSE nb END AS n1, CASE WHEN afirst THEN nb ELSE na END AS n2, CASE WHEN afirst THEN pa ELSE pb END AS p1, CASE WHEN afirst THEN pb ELSE pa END AS p2,
         CASE WHEN afirst THEN dra ELSE drb END AS dr1, CASE WHEN afirst THEN drb ELSE dra END AS dr2
  FROM ori
), o3 AS (
  SELECT *, CASE WHEN early IS NULL THEN 1 / (1 + exp(-((margin - {c.tau_margin}) / {c.scale_margin}))) END AS f_margin, CASE WHEN early IS NULL THEN 1 / (1 + exp(-((dr2 - dr1) / {c.scale_drop}))) END AS f_sharp,
         CASE WHEN early IS NULL THEN n1 / (n1 + n2 + 1e-6) END AS f_agree, CASE WHEN early IS NULL THEN least(1, greatest(0, (1 + (p1 - p2)) / 2)) END AS f_out, p1 - p2 AS sgap, dr2 - dr1 AS adv
  FROM o2
), o4 AS (
  SELECT *, CASE WHEN early IS NULL THEN least(1, greatest(0, ({' + '.join(terms)}) / {whole})) END AS conf FROM o3
), o5 AS (
  SELECT *, coalesce(early, {keep}) AS status FROM o4
), o6 AS (
  SELECT *, CASE WHEN status LIKE 'kept%' AND row_number() OVER (PARTITION BY id, status LIKE 'kept%' ORDER BY conf DESC NULLS LAST, a, b) > {p.max_pairs_per_prompt} THEN 'dropped_prompt_pair_cap' ELSE status END AS capped FROM o5
), dec AS (
  SELECT *, CASE WHEN capped LIKE 'kept%' AND conf < {cfg.threshold} THEN 'dropped_low_confidence' ELSE capped END AS final_status,
         CASE WHEN pref_ok AND NOT disp_ok THEN 'correct_vs_incorrect' WHEN NOT pref_ok AND disp_ok THEN 'incorrect_vs_correct' WHEN pref_ok AND disp_ok THEN 'both_correct' WHEN NOT pref_ok AND NOT disp_ok THEN 'both_wrong' ELSE 'unresolved' END AS correctness_pattern,
         CASE WHEN oa <> ob THEN 'mixed_correctness' WHEN oa THEN 'both_correct' ELSE 'both_wrong' END AS correctness_bucket,
         CASE WHEN conf IS NULL THEN 'unknown' WHEN conf < {c.low_threshold} THEN 'low' WHEN conf >= {c.high_threshold} THEN 'high' ELSE 'medium' END AS confidence_bucket,
         CASE WHEN capped LIKE 'kept%' AND NOT conf < {cfg.threshold} THEN {weight} END AS training_weight,
         ok AND weak AS weak_f, ok AND (short OR siga = sigb) AS deg_f, ok AND fmt AS fmt_f, ok AND triv AS triv_f, ok AND boil AS boil_f, ok AND near AS near_f, ok AND reconv AS unst_f, CASE WHEN ok THEN chars END AS min_chars
  FROM o6
)"""
    return [_side("a", p.window_H), _side("b", p.window_H), *([_SIMILAR_CTES] if similar else []), info, rest]


def _dec(cfg: RunConfig, select: str) -> str:
    return _with(select, *_decisions_ctes(cfg))


def _r(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


# --- registry ----------------------------------------------------------------------------------------------

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- text --------------------------------------------------------------------------------------------------

_MARK = r"(?:step\s*\d+[:.)-]?|\d+[.)-])"


def _parts(split: str, clean: bool) -> str:
    x = rf"regexp_replace(x, '(?i)^\s*{_MARK}\s*', '')" if clean else "x"
    return f"list_filter(list_transform({split}, lambda x: {_TRIM.format(x=x)}), lambda x: x <> '')"


_STEPS_SQL = rf"""t AS (SELECT doc_id, {_TRIM.format(x="coalesce(text, '')")} AS t FROM documents), p AS (
  SELECT doc_id, {_parts(rf"string_split(regexp_replace(t, '(?im)^\s*{_MARK}\s*', chr(1), 'g'), chr(1))", True)} AS p1,
         {_parts(r"string_split(regexp_replace(t, '(?i)\s+(step\s*\d+)', chr(1) || '\1', 'g'), chr(1))", True)} AS p2,
         {_parts("string_split(t, chr(10))", False)} AS p3, {_parts(r"string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))", False)} AS p4
  FROM t
), s AS (SELECT doc_id, CASE WHEN len(p1) >= 2 THEN p1 WHEN len(p2) >= 2 THEN p2 WHEN len(p3) >= 2 THEN p3 ELSE p4 END AS steps FROM p)"""


def _document_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.split_steps(F.col("text")).alias("steps"))


@_query(f"WITH {_STEPS_SQL} SELECT doc_id, CAST(len(steps) AS INTEGER) AS n_steps, array_to_string(steps, ' ## ') AS steps FROM s")
def split_steps(spark, sf_dir):
    return _document_steps(spark, sf_dir).select("doc_id", F.size("steps").alias("n_steps"), F.array_join("steps", " ## ").alias("steps"))


@_query(rf"SELECT conv_id, turn, array_to_string({_parts('string_split(text, chr(10))', True)}, ' ## ') AS parts FROM conversations")
def clean_parts(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.clean_parts(F.split("text", "\n")), " ## ").alias("parts"))


_CANON_SQL = f"WITH {_STEPS_SQL}, c AS (SELECT doc_id, list_transform(steps, lambda x: {_canon_sql('x')}) AS canon FROM s)"


@_query(f"{_CANON_SQL} SELECT doc_id, array_to_string(canon, ' ## ') AS canon FROM c")
def canon_steps(spark, sf_dir):
    return _document_steps(spark, sf_dir).select("doc_id", F.array_join(T.canon_steps(F.col("steps")), " ## ").alias("canon"))


_NUM = r"[-+]?\d+(?:\.\d+)?"


@_query(rf"""SELECT conv_id, turn, coalesce({_TRIM.format(x=r"regexp_extract_all(text, '\\boxed\{([^}]+)\}', 1)[-1]")},
  regexp_extract_all(text, '(?i)answer\s*(?:is|=)\s*({_NUM})', 1)[-1], regexp_extract_all(text, '{_NUM}')[-1],
  nullif({_TRIM.format(x=f"string_split({_TRIM.format(x='text')}, chr(10))[-1]")}, '')) AS final_answer FROM conversations""")  # fmt: skip
def extract_final_answer(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.extract_final_answer(F.col("text")).alias("final_answer"))


_PRICE = "CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)"


def _normalized_sql(x: str) -> str:
    s = rf"regexp_replace(replace(lower({_TRIM.format(x=x)}), ',', ''), '\s+', ' ', 'g')"
    return rf"CASE WHEN regexp_full_match({s}, '[-+]?\d+\.0+') THEN regexp_replace({s}, '\.0+$', '') ELSE {s} END"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long").cast("string")
    forms = F.array(q, F.concat(F.lit(" "), q, F.lit(".00 ")), F.concat(q, F.lit(",000")), F.concat(F.lit("+"), q), F.concat(q, F.lit(".50")))
    return o.select("l_orderkey", "l_linenumber", q.alias("gold"), F.get(forms, F.col("l_linenumber") % 5).alias("answer"))


_ANSWERS_SQL = f"""a AS (SELECT l_orderkey, l_linenumber, {_PRICE} AS gold, CASE l_linenumber % 5 WHEN 0 THEN {_PRICE} WHEN 1 THEN ' ' || {_PRICE} || '.00 '
  WHEN 2 THEN {_PRICE} || ',000' WHEN 3 THEN '+' || {_PRICE} ELSE {_PRICE} || '.50' END AS answer FROM lineitem)"""


@_query(f"WITH {_ANSWERS_SQL} SELECT l_orderkey, l_linenumber, {_normalized_sql('answer')} AS normalized FROM a")
def normalize_answer(spark, sf_dir):
    return _answers(spark, sf_dir).select("l_orderkey", "l_linenumber", T.normalize_answer(F.col("answer")).alias("normalized"))


@_query(f"WITH {_ANSWERS_SQL} SELECT l_orderkey, l_linenumber, {_normalized_sql('answer')} = {_normalized_sql('gold')} AS correct FROM a")
def is_correct(spark, sf_dir):
    return _answers(spark, sf_dir).select("l_orderkey", "l_linenumber", T.is_correct_answer(F.col("answer"), F.col("gold")).alias("correct"))


def _gsm8k_source(spark, sf_dir) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    worked = F.concat(F.lit("It costs "), F.col("o_totalprice").cast("long").cast("string"), F.lit(" in all.\n#### "), F.format_number(F.floor("o_totalprice"), 0))
    plain = F.concat(F.lit("About "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" or so"))
    answer = F.when(F.col("o_orderkey") % 3 == 0, plain).when(F.col("o_orderkey") % 3 == 1, worked).otherwise("none given")
    question = F.concat(F.lit(" What does order "), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, " cost? Think Step by Step. ").otherwise(" cost? "))
    return o.select("o_orderkey", F.col("o_orderkey").alias("ord"), question.alias("question"), answer.alias("answer"))


_GSM_SQL = r"""g AS (SELECT o_orderkey, ' What does order ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ' cost? Think Step by Step. ' ELSE ' cost? ' END AS question,
  CASE o_orderkey % 3 WHEN 0 THEN 'About ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' or so'
    WHEN 1 THEN 'It costs ' || CAST(floor(o_totalprice) AS BIGINT) || ' in all.' || chr(10) || '#### ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) ELSE 'none given' END AS answer FROM orders)"""


_GSM_SOLUTION_SQL = "CASE WHEN contains(answer, '####') THEN nullif(trim(string_split(answer, '####')[1], chr(10) || ' '), '') END"
_GSM_ANSWER_SQL = r"""CASE WHEN contains(answer, '####') THEN replace(trim(string_split(answer, '####')[-1]), ',', '') ELSE coalesce(replace(regexp_extract_all(answer, '[-+]?\d[\d,]*(?:\.\d+)?')[-1], ',', ''), trim(answer)) END"""
_GSM_PROMPT_SQL = "CASE WHEN contains(lower(question), 'step by step') THEN trim(question) ELSE trim(question) || chr(10) || 'Show your reasoning step by step.' END"


@_query(f"WITH {_GSM_SQL} SELECT o_orderkey, {_GSM_SOLUTION_SQL} AS solution, {_GSM_ANSWER_SQL} AS answer FROM g")
def gsm8k_answer_parse(spark, sf_dir):
    return _gsm8k_source(spark, sf_dir).select("o_orderkey", T.gsm8k_answer(F.col("answer")).alias("a")).select("o_orderkey", "a.*")


@_query(f"WITH {_GSM_SQL} SELECT o_orderkey, {_GSM_PROMPT_SQL} AS prompt FROM g")
def prompt_suffix(spark, sf_dir):
    return _gsm8k_source(spark, sf_dir).select("o_orderkey", T.prompt_with_suffix(F.col("question")).alias("prompt"))


@_query(f"""SELECT conv_id, turn, array_to_string(CASE WHEN len({_parts('string_split(text, chr(10))', False)}) > 0 THEN {_parts('string_split(text, chr(10))', False)} ELSE [{_TRIM.format(x='text')}] END, ' ## ') AS lines FROM conversations""")
def prefix_lines(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.prefix_lines(F.col("text")), " ## ").alias("lines"))


@_query(_with(" SELECT x.id, x.t AS trace_id, x.pos, string_agg(y.step, chr(10) ORDER BY y.pos) AS prefix FROM st x JOIN st y ON x.id = y.id AND x.t = y.t AND y.pos <= x.pos GROUP BY x.id, x.t, x.pos"))
def cumulative_prefix(spark, sf_dir):
    return scored_traces(spark, sf_dir).select("id", "trace_id", F.posexplode(T.cumulative_prefixes(F.col("steps"))).alias("pos", "prefix"))


@_query(rf"""WITH {_STEPS_SQL} SELECT doc_id, {_TRIM.format(x=rf"regexp_replace(array_to_string(list_transform(steps, lambda x: {_canon_sql('x')}), ' '), '\s+', ' ', 'g')")} AS signature FROM s""")
def segment_signature(spark, sf_dir):
    return _document_steps(spark, sf_dir).select("doc_id", T.segment_signature(F.col("steps")).alias("signature"))


_DOC_CANON = f"WITH c AS (SELECT doc_id, {_canon_sql('text')} AS c FROM documents)"


@_query(rf"{_DOC_CANON} SELECT doc_id, regexp_replace(c, '[^\p{{L}}\p{{N}}]', '', 'g') AS signature FROM c")
def alnum_signature(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.alnum_signature(F.col("text")).alias("signature"))


@_query(rf"""{_DOC_CANON}, w AS (SELECT doc_id, {_words(r"regexp_replace(c, '\s+', ' ', 'g')")} AS w FROM c) SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, array_to_string(w, ' ') AS tokens FROM w""")
def content_tokens(spark, sf_dir):
    t = T.content_tokens(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@_query(f"{_DOC_CANON} SELECT doc_id, regexp_matches(c, '[0-9+*/=-]') AS has_math FROM c")
def math_signal(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.has_math(F.col("text")).alias("has_math"))


@_query("SELECT conv_id, turn, " + " OR ".join(f"contains({_canon_sql('text')}, '{w}')" for w in T.PREAMBLE if "'" not in w) + " AS is_preamble FROM conversations")
def generic_preamble(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_preamble(F.col("text")).alias("is_preamble"))


# --- arrays ------------------------------------------------------------------------------------------------


def _compared(spark, sf_dir) -> DataFrame:
    return P._infos(P.compared(scored_traces(spark, sf_dir), BASE), BASE).withColumns({"a_id": F.col("a.trace_id"), "b_id": F.col("b.trace_id")})


@_query(_with(" SELECT id, a AS a_id, b AS b_id, k FROM kk"))
def first_divergence(spark, sf_dir):
    return P.comparisons(P.prepare(scored_traces(spark, sf_dir))).select("id", F.col("a.trace_id").alias("a_id"), F.col("b.trace_id").alias("b_id"), "k")


@_query(_with(" SELECT kk.id, a AS a_id, b AS b_id, sa.txt AS a_text, sb.txt AS b_text FROM kk LEFT JOIN sa USING (id, a, b) LEFT JOIN sb USING (id, a, b) WHERE k IS NOT NULL", _side("a", 2), _side("b", 2)))
def segment_slice(spark, sf_dir):
    text = lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n"))
    return _compared(spark, sf_dir).where("k is not null").select("id", "a_id", "b_id", text(F.col("seg_a")).alias("a_text"), text(F.col("seg_b")).alias("b_text"))


@_query(_with(" SELECT id, t AS trace_id, pos, round(z, 6) AS z FROM cs"))
def znorm_scores(spark, sf_dir):
    return P.prepare(scored_traces(spark, sf_dir)).select("id", "trace_id", F.posexplode("z").alias("pos", "z")).withColumn("z", F.round("z", 6))


_ARRAY_SQL = (
    " SELECT kk.id, a AS a_id, b AS b_id, round(coalesce(sa.local, -1e9), 6) AS a_value, round(coalesce(sb.local, -1e9), 6) AS b_value FROM kk LEFT JOIN sa USING (id, a, b) LEFT JOIN sb USING (id, a, b) WHERE k IS NOT NULL"
)


@_query(_with(_ARRAY_SQL, _side("a", 2), _side("b", 2)))
def local_segment_score(spark, sf_dir):
    return _compared(spark, sf_dir).where("k is not null").select("id", "a_id", "b_id", _r("ia.local", "a_value"), _r("ib.local", "b_value"))


@_query(_with(" SELECT kk.id, a AS a_id, b AS b_id, round(da.drop_at, 6) AS a_value, round(db.drop_at, 6) AS b_value FROM kk JOIN da USING (id, a, b) JOIN db USING (id, a, b) WHERE k IS NOT NULL", _side("a", 2), _side("b", 2)))
def drop_at_k(spark, sf_dir):
    return _compared(spark, sf_dir).where("k is not null").select("id", "a_id", "b_id", _r("ia.drop", "a_value"), _r("ib.drop", "b_value"))


@_query(_dec(BASE, " SELECT id, a AS a_id, b AS b_id, round(ua, 6) AS a_value, round(ub, 6) AS b_value FROM dec WHERE ok"))
def utility(spark, sf_dir):
    return _compared(spark, sf_dir).where("there").select("id", "a_id", "b_id", _r("ia.utility", "a_value"), _r("ib.utility", "b_value"))


@_query(_dec(BASE, " SELECT id, a AS a_id, b AS b_id, na AS n_a, nb AS n_b, round(pa, 6) AS p_a, round(pb, 6) AS p_b FROM dec WHERE ok"))
def support_stats(spark, sf_dir):
    return _compared(spark, sf_dir).where("there").select("id", "a_id", "b_id", F.col("ia.n").alias("n_a"), F.col("ib.n").alias("n_b"), _r("ia.p", "p_a"), _r("ib.p", "p_b"))


@_query(_dec(BASE, " SELECT id, a AS a_id, b AS b_id, round(f_margin, 6) AS f_margin, round(f_sharp, 6) AS f_sharp, round(f_agree, 6) AS f_agree, round(f_out, 6) AS f_out, round(conf, 6) AS confidence FROM dec WHERE conf IS NOT NULL"))
def confidence_features(spark, sf_dir):
    d = P.local_decisions(scored_traces(spark, sf_dir), BASE).where("confidence is not null")
    return d.select("id", F.col("a_trace_id").alias("a_id"), F.col("b_trace_id").alias("b_id"), *[_r(f"features.{c}", c) for c in ("f_margin", "f_sharp", "f_agree", "f_out", "confidence")])


@_query(_dec(BASE, " SELECT id, a AS a_id, b AS b_id, reconv AS reconverges FROM dec WHERE k IS NOT NULL"))
def reconverges(spark, sf_dir):
    return _compared(spark, sf_dir).where("k is not null").select("id", "a_id", "b_id", "reconverges")


@_query(_dec(BASE, " SELECT id, a AS a_id, b AS b_id, short AS too_short, siga = sigb AS exact_match, fmt AS formatting_only, triv AS trivial_difference, boil AS boilerplate_only, chars AS min_chars FROM dec WHERE ok"))
def divergence_flags(spark, sf_dir):
    return _compared(spark, sf_dir).where("there").select("id", "a_id", "b_id", "too_short", "exact_match", "formatting_only", "trivial_difference", "boilerplate_only", "min_chars")


@_query(_dec(SIMILAR, " SELECT id, a AS a_id, b AS b_id, round(similarity, 6) AS similarity, near AS near_identical FROM dec WHERE ok"))
def similarity(spark, sf_dir):
    d = P.compared(scored_traces(spark, sf_dir), SIMILAR).where("there")
    return d.select("id", F.col("a.trace_id").alias("a_id"), F.col("b.trace_id").alias("b_id"), _r("similarity"), "near_identical")


# --- decisions and pairs -------------------------------------------------------------------------------------

_PAIR_SQL = " SELECT id, a AS a_id, b AS b_id, k, pref_trace_id, disp_trace_id, correctness_pattern, orientation_reason, round(conf, 6) AS confidence, round(training_weight, 6) AS weight, final_status FROM dec WHERE final_status LIKE 'kept%'"


def _decided(spark, sf_dir, cfg: RunConfig) -> DataFrame:
    return P.decisions(scored_traces(spark, sf_dir), cfg)


def _shown(d: DataFrame) -> DataFrame:
    return d.select("id", F.col("a_trace_id").alias("a_id"), F.col("b_trace_id").alias("b_id"), "k", "pref_trace_id", "disp_trace_id", "correctness_pattern", "orientation_reason", _r("confidence"), _r("training_weight", "weight"), "final_status")


def _mode_query(name: str, cfg: RunConfig) -> None:
    def run(spark, sf_dir):
        return _shown(P.pairs(_decided(spark, sf_dir, cfg)))

    run.__name__ = name
    _query(_dec(cfg, _PAIR_SQL))(run)


_mode_query("pairs_current_utility", BASE)
_mode_query("pairs_correctness_priority", BASE.with_mode("correctness_priority"))
_mode_query("pairs_strict_without_similarity", BASE.with_mode("strict_purified"))
_mode_query("pairs_semi_without_similarity", BASE.with_mode("semi_purified"))
_mode_query("pairs_strict_purified", SIMILAR.with_mode("strict_purified"))
_mode_query("pairs_semi_purified", SIMILAR.with_mode("semi_purified"))
_mode_query("method_step", BASE.with_method("step_dpo"))
_mode_query("method_filter", BASE.with_method("confidence_filter_only").with_mode("correctness_priority"))
_mode_query("method_weighted", BASE.with_mode("correctness_priority"))
ANSWER = BASE.with_method("answer_dpo")
_ANSWER_SQL = """ SELECT id, pref_trace_id, disp_trace_id, round(margin, 6) AS margin, rank, CASE WHEN rank <= 20 THEN 'kept_answer_level_mixed_correctness' ELSE 'dropped_prompt_pair_cap' END AS final_status
FROM (SELECT p.id, p.t AS pref_trace_id, d.t AS disp_trace_id, p.mean_score - d.mean_score AS margin,
             CAST(row_number() OVER (PARTITION BY p.id ORDER BY round(p.mean_score, 9) DESC, p.t, round(d.mean_score, 9), d.t) AS INTEGER) AS rank
      FROM tr p JOIN tr d ON p.id = d.id AND p.ok AND NOT d.ok)"""


@_query(_with(_ANSWER_SQL))
def pairs_answer_level(spark, sf_dir):
    return _decided(spark, sf_dir, ANSWER).select("id", "pref_trace_id", "disp_trace_id", _r("answer_score_margin", "margin"), "rank", "final_status")


@_query(_dec(BASE, " SELECT id, count(*) FILTER (status LIKE 'kept%') AS candidates, count(*) FILTER (status LIKE 'kept%' AND capped = status) AS within_cap FROM dec GROUP BY id"))
def pair_cap(spark, sf_dir):
    d = _decided(spark, sf_dir, BASE)
    return d.groupBy("id").agg(F.count_if("is_candidate").alias("candidates"), F.count_if(F.col("is_candidate") & ~F.col("is_capped")).alias("within_cap"))


_AUDIT_SQL = """ SELECT id, a AS a_id, b AS b_id, k, pref_trace_id, disp_trace_id, correctness_bucket, correctness_pattern, confidence_bucket, orientation_reason, round(conf, 6) AS confidence,
  CASE WHEN ok THEN round(margin, 6) END AS utility_margin, CASE WHEN ok THEN round(gap, 6) END AS local_score_gap, weak_f AS weak_divergence, deg_f AS degenerate_divergence, unst_f AS boundary_unstable,
  min_chars AS divergent_min_chars, final_status FROM dec"""


def _audit(spark, sf_dir, cfg) -> DataFrame:
    return _decided(spark, sf_dir, cfg).select(
        "id", F.col("a_trace_id").alias("a_id"), F.col("b_trace_id").alias("b_id"), "k", "pref_trace_id", "disp_trace_id", "correctness_bucket", "correctness_pattern", "confidence_bucket",
        "orientation_reason", _r("confidence"), _r("utility_margin"), _r("local_score_gap"), "weak_divergence", "degenerate_divergence", "boundary_unstable", "divergent_min_chars", "final_status",
    )


@_query(_dec(BASE, _AUDIT_SQL))
def decision_audit(spark, sf_dir):
    return _audit(spark, sf_dir, BASE)


@_query(_dec(BASE.with_mode("semi_purified"), _AUDIT_SQL))
def decision_audit_semi(spark, sf_dir):
    return _audit(spark, sf_dir, BASE.with_mode("semi_purified"))


@_query(_dec(BASE, " SELECT id, pref_trace_id, disp_trace_id, 'user ' || id || chr(10) || chr(10) || coalesce((SELECT string_agg(step, chr(10) ORDER BY pos) FROM cs WHERE cs.id = dec.id AND cs.t = pref_trace_id AND cs.pos < k), '') AS prefix_text FROM dec WHERE final_status LIKE 'kept%'"))
def training_texts(spark, sf_dir):
    t = scored_traces(spark, sf_dir)
    kept = P.pairs(P.decisions(t, BASE))
    prompts = t.select("id").distinct().select("id", F.concat(F.lit("user "), "id").alias("prompt"))
    return P.training_table(kept.join(prompts, "id", "left_semi"), prompts).join(kept.select("decision_id", "pref_trace_id", "disp_trace_id"), "decision_id").select("id", "pref_trace_id", "disp_trace_id", "prefix_text")


# --- reports ---------------------------------------------------------------------------------------------------


@_query(_dec(BASE, " SELECT final_status AS value, count(*) AS n FROM dec GROUP BY final_status"))
def value_counts(spark, sf_dir):
    return R.value_counts(_decided(spark, sf_dir, BASE), "final_status")


@_query(_dec(BASE.with_mode("correctness_priority"), " SELECT coalesce(orientation_reason, 'unknown') AS value, count(*) AS n FROM dec WHERE final_status LIKE 'kept%' GROUP BY ALL"))
def orientation_counts(spark, sf_dir):
    return R.orientation_counts(_decided(spark, sf_dir, BASE.with_mode("correctness_priority")))


_F = lambda c: f"count(*) FILTER ({c})"
_KEPT_SQL = "final_status LIKE 'kept%'"
_TAXONOMY_SQL = ", ".join([*[f"{_F(f'{_KEPT_SQL} AND correctness_pattern = {chr(39)}{p}{chr(39)}')} AS {p}" for p in ("correct_vs_incorrect", "incorrect_vs_correct", "both_correct", "both_wrong")],
    f"{_F(f'NOT {_KEPT_SQL}')} AS unresolved_or_skipped", f"{_F('weak_f')} AS same_prefix_but_weak_divergence",
    f"{_F(_KEPT_SQL + ' AND orientation_reason IN (' + ', '.join(repr(x) for x in R.UTILITY_DRIVEN) + ') AND correctness_pattern IN (' + repr('both_correct') + ', ' + repr('both_wrong') + ')')} AS same_correctness_but_utility_oriented"])


@_query(_dec(BASE, f" SELECT {_TAXONOMY_SQL} FROM dec"))
def taxonomy_counts(spark, sf_dir):
    return R.taxonomy_counts(_decided(spark, sf_dir, BASE))


@_query(_dec(BASE, f" SELECT {_F('weak_f')} AS weak_divergence, {_F('fmt_f')} AS formatting_only, 0::BIGINT AS near_identical, {_F('triv_f')} AS trivial_difference, {_F('boil_f')} AS boilerplate_only, {_F('unst_f')} AS unstable_boundary, {_F('deg_f')} AS degenerate_divergence FROM dec"))
def quality_counts(spark, sf_dir):
    return R.quality_counts(_decided(spark, sf_dir, BASE))


def _purity_sql(cfg: RunConfig) -> str:
    kept = f"nullif({_F(_KEPT_SQL)}, 0)"
    among = lambda names: "(" + ", ".join(repr(x) for x in names) + ")"
    share = lambda c, of: f"round(CAST({_F(c)} AS DOUBLE) / {of}, 6)"
    every = "greatest(count(*), 1)"
    return f""" SELECT count(*) AS num_trace_comparisons, {_F("status LIKE 'kept%' AND capped = status")} AS num_builder_candidates_before_method, {_F(_KEPT_SQL)} AS num_kept_pairs,
  {_F("final_status = 'dropped_low_confidence'")} AS num_dropped_by_confidence, {_TAXONOMY_SQL},
  {share(_KEPT_SQL + " AND correctness_pattern = 'correct_vs_incorrect'", kept)} AS fraction_strictly_instructional_pairs,
  {share(_KEPT_SQL + " AND correctness_pattern IN ('both_correct', 'both_wrong')", kept)} AS fraction_ambiguous_pairs,
  {share(_KEPT_SQL + " AND correctness_pattern = 'incorrect_vs_correct'", kept)} AS fraction_misoriented_mixed_correctness_pairs,
  {share(f"final_status IN {among(R.PURIFICATION_DROPS)}", every)} AS fraction_dropped_by_purification,
  {share(f"{_KEPT_SQL} AND orientation_reason IN {among(R.CORRECTNESS_DRIVEN)}", kept)} AS fraction_orientation_driven_by_correctness,
  {share(f"{_KEPT_SQL} AND orientation_reason IN {among(R.UTILITY_DRIVEN)}", kept)} AS fraction_orientation_driven_only_by_utility,
  {share("unst_f", every)} AS boundary_instability_rate, {share("weak_f", every)} AS weak_divergence_fraction, {share("deg_f", every)} AS degenerate_divergence_fraction,
  {share("near_f", every)} AS near_identical_divergence_fraction, {share(f"coalesce(min_chars, 0) < {cfg.pair.min_divergent_chars}", every)} AS very_short_divergent_region_fraction FROM dec"""


_IN = lambda names: "(" + ", ".join(repr(x) for x in names) + ")"
_SECTION_SQL = {
    "Kept, turned by the final answers": f"{_KEPT_SQL} AND orientation_reason IN {_IN(R.CORRECTNESS_DRIVEN)}",
    "Kept, turned by utility alone": f"{_KEPT_SQL} AND orientation_reason IN {_IN(R.UTILITY_DRIVEN)}",
    "Kept with equal final answers": f"final_status IN {_IN(['kept_both_correct_strong_local_preference', 'kept_both_wrong_delayed_error', 'kept_same_correctness_utility_oriented'])}",
    "Dropped for the divergence": f"final_status IN {_IN(['dropped_weak_divergence', 'dropped_trivial_segment_difference', 'dropped_near_identical', 'dropped_formatting_only', 'dropped_unstable_boundary'])}",
    "Dropped for equal final answers": f"final_status IN {_IN(['dropped_both_correct_ambiguous', 'dropped_both_wrong_uninformative', 'dropped_same_correctness_low_confidence'])}",
    "Dropped for low confidence": "final_status = 'dropped_low_confidence'",
}
SEMI = BASE.with_mode("semi_purified")


@_query(_dec(SEMI, " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{title}' AS section, count(*) AS n FROM dec WHERE {c}" for title, c in _SECTION_SQL.items()) + ") WHERE n > 0"))
def orientation_sections(spark, sf_dir):
    return R.in_sections(_decided(spark, sf_dir, SEMI)).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@_query(_with(f""", ans AS ({_ANSWER_SQL}) SELECT count(*) AS num_trace_comparisons, {_F("final_status LIKE 'kept%'")} AS num_builder_candidates_before_method, {_F("final_status LIKE 'kept%'")} AS num_kept_pairs,
  {_F("final_status LIKE 'kept%'")} AS correct_vs_incorrect, {_F("final_status NOT LIKE 'kept%'")} AS unresolved_or_skipped, 1.0::DOUBLE AS fraction_strictly_instructional_pairs,
  1.0::DOUBLE AS fraction_orientation_driven_by_correctness, 0.0::DOUBLE AS very_short_divergent_region_fraction FROM ans"""))  # fmt: skip
def answer_level_report(spark, sf_dir):
    found = _rounded(R.purity_report(_decided(spark, sf_dir, ANSWER), ANSWER))
    return found.select("num_trace_comparisons", "num_builder_candidates_before_method", "num_kept_pairs", "correct_vs_incorrect", "unresolved_or_skipped", "fraction_strictly_instructional_pairs",
                        "fraction_orientation_driven_by_correctness", "very_short_divergent_region_fraction")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_r(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


STRICT = BASE.with_mode("strict_purified")


@_query(_dec(STRICT, _purity_sql(STRICT)))
def purity_report(spark, sf_dir):
    return _rounded(R.purity_report(_decided(spark, sf_dir, STRICT), STRICT))


@_query(_dec(SIMILAR.with_mode("semi_purified"), _purity_sql(SIMILAR.with_mode("semi_purified"))))
def purity_report_semi(spark, sf_dir):
    cfg = SIMILAR.with_mode("semi_purified")
    return _rounded(R.purity_report(_decided(spark, sf_dir, cfg), cfg))


@_query(_with(" SELECT round(avg(len), 6) AS average_steps_per_trace FROM tr"))
def average_steps(spark, sf_dir):
    return _rounded(R.average_steps(scored_traces(spark, sf_dir)))


def _kept_pairs(spark, sf_dir, cfg: RunConfig = BASE) -> DataFrame:
    return P.pairs(_decided(spark, sf_dir, cfg))


_EDGES = [float(x) for x in np.linspace(0.0, 1.0, 11)]
_BINS_SQL = " UNION ALL ".join(f"SELECT {i} AS bin, {lo!r}::DOUBLE AS lo, {hi!r}::DOUBLE AS hi" for i, (lo, hi) in enumerate(zip(_EDGES[:-1], _EDGES[1:])))


@_query(_dec(BASE, f" SELECT CAST(bin AS INTEGER) AS bin, lo, hi, count(conf) AS n FROM ({_BINS_SQL}) LEFT JOIN (SELECT conf FROM dec WHERE {_KEPT_SQL}) ON conf >= lo AND (conf < hi OR bin = 9 AND conf = hi) GROUP BY bin, lo, hi"))
def histogram(spark, sf_dir):
    kept = _kept_pairs(spark, sf_dir)
    return R.histogram(kept, R.pair_confidence(kept))


@_query(_dec(BASE, f" SELECT count(*) AS num_pairs, round(avg(conf), 6) AS mean_confidence, round(median(conf), 6) AS median_confidence FROM dec WHERE {_KEPT_SQL}"))
def confidence_stats(spark, sf_dir):
    return _rounded(R.confidence_stats(_kept_pairs(spark, sf_dir)))


_LABEL_SQL = "CASE WHEN pref_ok <> disp_ok THEN CAST(pref_ok AS INTEGER) END"


@_query(_dec(BASE, f" SELECT round(corr(conf, {_LABEL_SQL}), 6) AS correlation FROM dec WHERE {_KEPT_SQL}"))
def pearson(spark, sf_dir):
    return _kept_pairs(spark, sf_dir).agg(_r(R.pearson(F.col("confidence"), R.reliability_label()), "correlation"))


_BRANCH_SQL = """count(*) AS eligible_pair_count, round(avg(CAST(pref_ok <> disp_ok AS INTEGER)), 6) AS decisive_pair_fraction, round(avg(CAST(pref_ok AS INTEGER)), 6) AS preferred_branch_final_correct_rate,
  round(avg(CAST(disp_ok AS INTEGER)), 6) AS dispreferred_branch_final_correct_rate, round(avg(CAST(NOT pref_ok AND NOT disp_ok AS INTEGER)), 6) AS both_branches_incorrect_fraction, round(avg(CAST(pref_ok AND disp_ok AS INTEGER)), 6) AS both_branches_correct_fraction"""


@_query(_dec(BASE, f" SELECT {_BRANCH_SQL} FROM dec WHERE {_KEPT_SQL}"))
def branch_stats(spark, sf_dir):
    return _rounded(_kept_pairs(spark, sf_dir).agg(*R.branch_stats()))


@_query(_dec(BASE, f""", kp AS (SELECT *, CASE WHEN pref_ok <> disp_ok THEN CAST(pref_ok AS INTEGER) END AS label, CASE WHEN k IS NOT NULL THEN CAST(k = id % 3 AS INTEGER) END AS hit FROM dec WHERE {_KEPT_SQL})
SELECT bucket, count(conf) AS n, round(count(conf) / greatest((SELECT count(*) FROM kp), 1), 6) AS fraction, round(avg(conf), 6) AS mean_confidence, round(avg(label), 6) AS preferred_branch_accuracy, round(avg(hit), 6) AS process_boundary_accuracy,
  {_BRANCH_SQL.replace("count(*)", "count(conf)")} FROM (VALUES ('low'), ('medium'), ('high')) v(bucket) LEFT JOIN kp ON kp.confidence_bucket = bucket GROUP BY bucket"""))  # fmt: skip
def bucket_summary(spark, sf_dir):
    return _rounded(R.bucket_summary(_kept_pairs(spark, sf_dir), BASE, gold_rows(spark, sf_dir)))


@_query(_dec(BASE, f" SELECT id, a AS a_id, b AS b_id, {_LABEL_SQL} AS label FROM dec WHERE {_KEPT_SQL}"))
def reliability_label(spark, sf_dir):
    return _kept_pairs(spark, sf_dir).select("id", F.col("a_trace_id").alias("a_id"), F.col("b_trace_id").alias("b_id"), R.reliability_label().alias("label"))


@_query(_dec(BASE, f""" SELECT {_F(_KEPT_SQL)} AS num_pairs, {_F("status LIKE 'kept%' AND capped = status")} AS num_raw_pairs, {_F("final_status = 'dropped_low_confidence'")} AS num_dropped_by_confidence,
  round({_F("final_status = 'dropped_low_confidence'")} / greatest({_F("status LIKE 'kept%' AND capped = status")}, 1), 6) AS fraction_dropped_by_threshold, round(avg(conf) FILTER ({_KEPT_SQL}), 6) AS mean_confidence,
  round(median(conf) FILTER ({_KEPT_SQL}), 6) AS median_confidence, count({_LABEL_SQL}) FILTER ({_KEPT_SQL}) AS decisive_pair_count, round(avg({_LABEL_SQL}) FILTER ({_KEPT_SQL}), 6) AS overall_decisive_pair_accuracy,
  round(corr(conf, {_LABEL_SQL}) FILTER ({_KEPT_SQL}), 6) AS confidence_correctness_correlation, round(avg({_LABEL_SQL}) FILTER ({_KEPT_SQL} AND conf >= 0.66), 6) AS high_confidence_pair_accuracy,
  round(avg(conf) FILTER ({_KEPT_SQL}) - avg({_LABEL_SQL}) FILTER ({_KEPT_SQL}), 6) AS confidence_calibration_proxy FROM dec"""))  # fmt: skip
def run_summary(spark, sf_dir):
    return _rounded(R.analysis(_decided(spark, sf_dir, BASE), BASE))


# --- earliest error ----------------------------------------------------------------------------------------------


def _predictions(spark, sf_dir) -> DataFrame:
    return E.predict(_kept_pairs(spark, sf_dir))


_PRED_SQL = f""", pr AS (SELECT id, k AS pred, conf AS score, count(*) OVER (PARTITION BY id) AS num_candidates, row_number() OVER (PARTITION BY id ORDER BY conf DESC, a, b) AS rn FROM dec WHERE {_KEPT_SQL}),
jd AS (SELECT g.id, g.gold, pr.pred, pr.score, coalesce(num_candidates, 0) AS num_candidates, coalesce(pr.pred = g.gold, false) AS correct, coalesce(abs(pr.pred - g.gold) <= 1, false) AS near_miss
  FROM (SELECT DISTINCT user_id AS id, CAST(user_id % 3 AS INTEGER) AS gold FROM events) g LEFT JOIN pr ON pr.id = g.id AND rn = 1)"""


@_query(_dec(BASE, _PRED_SQL + " SELECT id, pred, round(score, 6) AS score, num_candidates FROM pr WHERE rn = 1"))
def process_predict(spark, sf_dir):
    return _rounded(_predictions(spark, sf_dir))


def _judged(spark, sf_dir) -> DataFrame:
    return E.judge(_predictions(spark, sf_dir), gold_rows(spark, sf_dir))


@_query(_dec(BASE, _PRED_SQL + f""" SELECT round({_F('correct')} / greatest(count(*), 1), 6) AS earliest_error_exact, round({_F('near_miss')} / greatest(count(*), 1), 6) AS earliest_error_near_miss,
  round(count(pred) / greatest(count(*), 1), 6) AS coverage, count(*) AS num_evaluated_examples, {_F('correct')} AS num_correct, {_F('NOT correct')} AS num_incorrect FROM jd"""))  # fmt: skip
def process_metrics(spark, sf_dir):
    return _rounded(E.metrics(_judged(spark, sf_dir)))


@_query(_dec(BASE, _PRED_SQL + " SELECT gold, pred, count(*) AS n FROM jd GROUP BY gold, pred"))
def process_confusion(spark, sf_dir):
    return E.confusion(_judged(spark, sf_dir))


@_query(_dec(BASE, _PRED_SQL + " SELECT id, gold, pred, near_miss, num_candidates FROM jd WHERE NOT correct ORDER BY id LIMIT 15"))
def process_failures(spark, sf_dir):
    return E.failures(_judged(spark, sf_dir)).select("id", "gold", "pred", "near_miss", "num_candidates")


_GOLD = "SELECT 'q' || user_id AS id, 'user ' || user_id AS prompt, '7' AS answer, ['take 3', 'take 4', 'it is 7'] AS correct_steps, ['take 3', 'take 5', 'it is 8'] AS incorrect_steps, CASE WHEN user_id % 2 = 0 THEN '8' END AS wrong FROM (SELECT DISTINCT user_id FROM events)"


@_query(f"WITH g AS ({_GOLD}) SELECT id, 0 AS trace_id, array_to_string(correct_steps, chr(10)) AS reasoning, answer AS final_answer FROM g UNION ALL SELECT id, 1, array_to_string(incorrect_steps, chr(10)), coalesce(wrong, '') FROM g")
def process_expand(spark, sf_dir):
    u = _table(spark, sf_dir, "events").select("user_id").distinct()
    steps = lambda *s: F.array(*[F.lit(x) for x in s])
    gold = u.select(F.concat(F.lit("q"), "user_id").alias("id"), F.concat(F.lit("user "), "user_id").alias("prompt"), F.lit("7").alias("answer"), steps("take 3", "take 4", "it is 7").alias("correct_steps"),
                    steps("take 3", "take 5", "it is 8").alias("incorrect_steps"), F.when(F.col("user_id") % 2 == 0, "8").alias("incorrect_final_answer"))
    return E.expand_gold(gold).select("id", "trace_id", "reasoning", "final_answer")


# --- sampling, scoring, losses ------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_PROMPT_FILE_SQL = "p AS (SELECT 'p' || o_orderkey AS id, ' What does it cost? ' || chr(10) || '\"' || o_orderkey || '\" é' AS prompt, CAST(o_custkey AS VARCHAR) AS answer, NULL::VARCHAR AS reference_solution, CASE WHEN o_orderkey % 2 = 0 THEN 'train' END AS source_split, o_orderkey FROM orders)"


def _prompt_file(spark: SparkSession, sf_dir: str) -> str:
    o = _table(spark, sf_dir, "orders").orderBy("o_orderkey")
    prompt = F.concat(F.lit(' What does it cost? \n"'), "o_orderkey", F.lit('" é'))
    rows = o.select(F.concat(F.lit("p"), "o_orderkey").alias("id"), prompt.alias("prompt"), F.col("o_custkey").cast("string").alias("answer"), F.lit("x").alias("more"), F.when(F.col("o_orderkey") % 2 == 0, "train").alias("source_split"))
    path = _scratch(spark, "prompts")
    write_jsonl(rows, path)
    return path


@_query(f"WITH {_PROMPT_FILE_SQL} SELECT id, prompt, answer, reference_solution, source_split FROM p")
def jsonl_round_trip(spark, sf_dir):
    return read_jsonl(spark, _prompt_file(spark, sf_dir), "prompt")


@_query(f"""WITH {_PROMPT_FILE_SQL}, t AS (SELECT unnest(CASE (SELECT count(*) FROM orders) {" ".join(f"WHEN {n} THEN {sorted(random.Random(5).sample(range(n), 60))}" for n in (1500, 15_000, 150_000))} END) AS ord),
e AS (SELECT unnest(CASE (SELECT count(*) FROM orders) {" ".join(f"WHEN {n} THEN {sorted(random.Random(6).sample(range(n), 40))}" for n in (1500, 15_000, 150_000))} END) AS ord)
SELECT 'train' AS which, id, answer FROM p JOIN t ON o_orderkey = ord UNION ALL SELECT 'eval', id, answer FROM p JOIN e ON o_orderkey = ord""")
def prompt_samples(spark, sf_dir):
    cfg = from_dict({"paths": {"prompt_file": _prompt_file(spark, sf_dir)}, "data": {"max_train_prompts": 60, "max_eval_prompts": 40, "prompt_sampling_seed": 5}})
    train, evaluate = (S.load_prompts(spark, cfg, which).select(F.lit(which).alias("which"), "id", "answer") for which in ("train", "eval"))
    return train.unionByName(evaluate)


def _drawn_sql(count: int, seed: int) -> str:
    """The ordinals that the generator draws for the sizes of the test table, in rising order."""
    by_size = " ".join(f"WHEN {n} THEN {sorted(random.Random(seed).sample(range(n), count))}" for n in (1500, 15_000, 150_000))
    return f"drawn AS (SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS out FROM (SELECT unnest(CASE (SELECT count(*) FROM orders) {by_size} END) AS ord))"


@_query(f"WITH {_drawn_sql(100, 42)} SELECT ord, o_orderkey FROM drawn JOIN orders ON o_orderkey = ord")
def seeded_sample(spark, sf_dir):
    ordered = _gsm8k_source(spark, sf_dir)
    return S.sample_rows(ordered, 100, 42).select("ord", "o_orderkey")


@_query(rf"""WITH {_GSM_SQL}, {_drawn_sql(100, 42)} SELECT 'train__1__' || lpad(CAST(out AS VARCHAR), 5, '0') AS id, {_GSM_PROMPT_SQL} AS prompt, {_GSM_ANSWER_SQL} AS answer, {_GSM_SOLUTION_SQL} AS reference_solution, 'train[:1]' AS source_split
FROM drawn JOIN g ON o_orderkey = ord""")
def gsm8k_prompts(spark, sf_dir):
    return S.gsm8k_prompts(_gsm8k_source(spark, sf_dir), "train[:1]", 100, 42)


@_query(_with(r""", px AS (SELECT x.id, x.t, x.pos, string_agg(y.step, chr(10) ORDER BY y.pos) AS prefix FROM st x JOIN st y ON x.id = y.id AND x.t = y.t AND y.pos <= x.pos GROUP BY x.id, x.t, x.pos)
SELECT id, t AS trace_id, pos, round((1 + len(regexp_extract_all(prefix, '\d'))) / (2 + len(regexp_extract_all(prefix, '\d')) + length(prefix) / 100.0), 6) AS score FROM px"""))  # fmt: skip
def score_prefixes(spark, sf_dir):
    t = scored_traces(spark, sf_dir).select("id", "trace_id", "steps", F.lit("p").alias("prompt"), F.lit("1").alias("answer"), F.lit("1").alias("final_answer"))
    return G.score_traces(t, G.scorer("length")).select("id", "trace_id", F.posexplode("step_scores").alias("pos", "score")).withColumn("score", F.round("score", 6))


@_query("""SELECT l_orderkey, l_linenumber, round(d, 6) AS delta, round(greatest(-0.1 * d, 0) + ln(1 + exp(-abs(0.1 * d))), 6) AS dpo_term, round(l_tax * (greatest(-0.1 * d, 0) + ln(1 + exp(-abs(0.1 * d)))), 6) AS loss
FROM (SELECT *, (-l_quantity + l_discount * 100) - (-l_quantity / 2 + l_tax * 100) AS d FROM lineitem)""")  # fmt: skip
def dpo_loss_terms(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    terms = A.dpo_loss_terms(-F.col("l_quantity"), -F.col("l_discount") * 100, -F.col("l_quantity") / 2, -F.col("l_tax") * 100, F.col("l_tax"), 0.1)
    return li.select("l_orderkey", "l_linenumber", terms.alias("t")).select("l_orderkey", "l_linenumber", _r("t.delta", "delta"), _r("t.dpo_term", "dpo_term"), _r("t.loss", "loss"))


_TOKENS_SQL = """t AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: -abs(CAST(x AS DOUBLE))) AS p, list_transform(embedding[5:8], lambda x: -abs(CAST(x AS DOUBLE))) AS d,
  list_transform(embedding[9:12], lambda x: -abs(CAST(x AS DOUBLE))) AS rp, list_transform(embedding[13:16], lambda x: -abs(CAST(x AS DOUBLE))) AS rd, abs(CAST(embedding[17] AS DOUBLE)) AS w FROM embeddings),
u AS (SELECT vec_id, w, (list_sum(p) - list_sum(d)) - (list_sum(rp) - list_sum(rd)) AS delta,
  0.5 * (list_avg(list_transform(list_zip(p, rp), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) + list_avg(list_transform(list_zip(d, rd), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS pen FROM t)"""


@_query(f"WITH {_TOKENS_SQL} SELECT vec_id, round(delta, 5) AS delta, round(term, 5) AS dpo_term, round(w * term + 0.1 * (1 - w) * pen, 5) AS loss FROM (SELECT *, greatest(-0.2 * delta, 0) + ln(1 + exp(-abs(0.2 * delta))) AS term FROM u)")
def token_loss_terms(spark, sf_dir):
    tokens = lambda i: F.transform(F.slice("embedding", i, 4), lambda x: -F.abs(x.cast("double")))
    terms = A.token_loss_terms(tokens(1), tokens(5), tokens(9), tokens(13), F.abs(F.get("embedding", F.lit(16)).cast("double")), beta=0.2, lambda_ref=0.1)
    t = _table(spark, sf_dir, "embeddings").select("vec_id", terms.alias("t"))
    return t.select("vec_id", *[F.round(f"t.{c}", 5).alias(c) for c in ("delta", "dpo_term", "loss")])


@_query("""SELECT vec_id, round(exp(embedding[1]) / (exp(embedding[1]) + exp(embedding[2])), 5) AS judge, round(list_avg(list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE))), 5) AS log_prob,
  round(exp(embedding[4]) / (exp(embedding[3]) + exp(embedding[4])), 5) AS reward FROM embeddings""")
def verifier_scores(spark, sf_dir):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    outputs = {
        "judge_token": F.array(e(0), e(1)),
        "mean_logprob": F.array(*[e(i) for i in range(6)]),
        "process_reward_model": F.struct(F.array(F.array(e(0), e(1)), F.array(e(2), e(3)), F.array(e(4), e(5))).alias("logits"), F.array(F.lit(1), F.lit(1), F.lit(0)).alias("token_mask")),
    }
    scores = [F.round(G.verifier_score(VerifierConfig(mode=mode), x), 5).alias(name) for (mode, x), name in zip(outputs.items(), ("judge", "log_prob", "reward"))]
    return _table(spark, sf_dir, "embeddings").select("vec_id", *scores)


@_query("""SELECT conv_id, turn, 'Q: ' || text || ' {x} S: ' || role || '!' AS judge, 'Question:' || chr(10) || text || chr(10) || chr(10) || 'Partial solution:' || chr(10) || role AS log_prob,
  'be good' || chr(10) || chr(10) || 'Question:' || chr(10) || text || chr(10) || chr(10) || 'Partial solution:' || chr(10) || role || '<s>' AS reward FROM conversations""")
def verifier_prompts(spark, sf_dir):
    forms = {"judge": VerifierConfig(prompt_template="Q: {prompt} {x} S: {prefix}!"), "log_prob": VerifierConfig(mode="mean_logprob"), "reward": VerifierConfig(mode="process_reward_model", prm_system_prompt="be good", prm_step_token="<s>")}
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", *[G.verifier_text(cfg, F.col("text"), F.col("role")).alias(name) for name, cfg in forms.items()])


@_query("SELECT vec_id, round(exp(embedding[4]) / (exp(embedding[3]) + exp(embedding[4])), 5) AS reward FROM embeddings")
def process_reward_prob(spark, sf_dir):
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    logits = F.array(F.array(e(0), e(1)), F.array(e(2), e(3)), F.array(e(4), e(5)))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(A.process_reward(logits, F.array(F.lit(1), F.lit(1), F.lit(0))), 5).alias("reward"))


@_query(f"""WITH {_ANSWERS_SQL}, o AS (SELECT *, 'So the answer is ' || regexp_extract(answer, '{_NUM}') || '. Done' AS output FROM a)
SELECT count(*) AS num_examples, count(*) FILTER (ok) AS num_correct, round(count(*) FILTER (ok) / greatest(count(*), 1), 6) AS final_accuracy
FROM (SELECT {_normalized_sql(f"regexp_extract(output, '(?i)answer is ({_NUM})', 1)")} = {_normalized_sql('gold')} AS ok FROM o)""")  # fmt: skip
def final_eval_grading(spark, sf_dir):
    a = _answers(spark, sf_dir)
    output = F.concat(F.lit("So the answer is "), F.regexp_extract("answer", _NUM, 0), F.lit(". Done"))
    return _rounded(G.final_accuracy(G.grade(a.select(output.alias("output"), F.col("gold").alias("answer")))))
