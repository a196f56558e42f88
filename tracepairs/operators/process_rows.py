"""Synthetic gold rows for the earliest-error evaluation, as Columns over the rows of a table.

Each row draws its numbers from hashes of a seed, its own key and the number's name, so it does not depend on other rows,
on their order or on partitions, and there are as many as the table has. Templates are this library's own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``draws``: name to (least, largest, step). ``values``: name to an SQL expression of names before it. Texts name both in
    braces. ``gold``: the first step in which ``wrong`` differs from ``right``. Answers always differ."""

    draws: dict[str, tuple[int, int, int]]
    values: dict[str, str]
    question: str
    right: list[str]
    wrong: list[str]
    answer: str
    other: str
    gold: int
    texts: dict[str, str] = field(default_factory=dict)


def _ratio(a: str, b: str) -> str:
    return f"CAST(floor({a} / {b}) AS BIGINT)"


_LEVEL = ["Each minute the level changes by {inflow} {sign} {outflow} = {rate} litres.", "Over {minutes} minutes that is {minutes} * {rate} = {moved} litres.", "With the {start} litres from before there are {end} litres."]
_MARKS = ["The marks add up to {a} + {b} + {c} + {d} = {total}.", "Shared out over the tests this is {total} / {by} = {mean}."]
_FILM = ["The film starts {first} minutes after {start} o'clock.", "Its end is {first} + {second} = {minutes} minutes after {start} o'clock."]
_HOUR = ["An hour has {hour} minutes, so {full} full hours pass and {left} minutes are left.", "On the clock it is then {end}:{shown}."]
_COATS = ["Without any discount {pieces} coats cost {pieces} * {price} = {whole} euros.", "Ten percent of that are {tenth} euros.", "The discount of {percent} percent comes to {off} euros."]


def _with(lines: list[str], **names: str) -> list[str]:
    """``lines`` with some names replaced by others, or by plain text."""
    for old, new in names.items():
        lines = [x.replace("{" + old + "}", new) for x in lines]
    return lines


TEMPLATES = [
    Template(  # wrong sign of the outflow, in the first step
        {"inflow": (11, 19, 1), "minutes": (6, 15, 1), "start": (50, 120, 1), "outflow": (2, 9, 1)},
        {"net": "inflow - outflow", "sum_": "inflow + outflow", "moved": "minutes * net", "moved_": "minutes * sum_", "answer": "start + moved", "other": "start + moved_"},
        "A tank already holds {start} litres. A pipe brings {inflow} litres a minute while a crack loses {outflow} litres a minute. What does the tank hold {minutes} minutes later?",
        _with(_LEVEL, sign="-", rate="{net}", end="{answer}"),
        _with(_LEVEL, sign="+", rate="{sum_}", moved="{moved_}", end="{other}"),
        "answer", "other", 0,
    ),
    Template(  # division by one mark too few, in the second step
        {x: (12, 60, 12) for x in "abcd"},
        {"total": "a + b + c + d", "answer": _ratio("total", "4"), "other": _ratio("total", "3")},
        "Lena got {a}, {b}, {c} and {d} points in four tests. What is the mean?",
        _with(_MARKS, by="4", mean="{answer}"), _with(_MARKS, by="3", mean="{other}"),
        "answer", "other", 1,
    ),
    Template(  # hours of 100 minutes, in the third step
        {"start": (7, 11, 1), "first": (35, 55, 1), "second": (70, 95, 1)},
        {"minutes": "first + second", "full": _ratio("minutes", "60"), "full_": _ratio("minutes", "100"), "answer": "minutes % 60", "other": "minutes % 100", "end": "start + full", "end_": "start + full_"},
        "A film of {second} minutes begins at {start}:{first}. How many minutes past the full hour does it end?",
        _FILM + _with(_HOUR, hour="60", left="{answer}"),
        _FILM + _with(_HOUR, hour="100", full="{full_}", left="{other}", end="{end_}", shown="{shown_}"),
        "answer", "other", 2,
        {"shown": "lpad(CAST(answer AS STRING), 2, '0')", "shown_": "lpad(CAST(other AS STRING), 2, '0')"},
    ),
    Template(  # the discount instead of what is left to pay, in the last step before the answer
        {"price": (60, 280, 20), "percent": (5, 45, 5), "pieces": (2, 4, 1)},
        {"whole": "price * pieces", "tenth": _ratio("whole", "10"), "other": _ratio("whole * percent", "100"), "answer": "whole - other"},
        "A coat costs {price} euros. A shop takes {percent} percent off for {pieces} coats. What do they cost together?",
        _with(_COATS, off="{other}") + ["Left to pay are {whole} - {other} = {answer} euros."],
        _with(_COATS, off="{other}") + ["Left to pay are {other} euros."],
        "answer", "other", 3,
    ),
    Template(  # grams added for each guest instead of multiplied, in the second step
        {"serves": (2, 4, 1), "guests": (9, 16, 1), "grams": (60, 156, 12)},
        {"each": _ratio("grams", "serves"), "answer": "each * guests", "other": "each + guests"},
        "A recipe for {serves} guests takes {grams} grams of rice. How many grams does a party of {guests} guests take?",
        ["For one guest the cook takes {grams} / {serves} = {each} grams of rice.", "The party takes {each} * {guests} = {answer} grams."],
        ["For one guest the cook takes {grams} / {serves} = {each} grams of rice.", "The party takes {each} + {guests} = {other} grams."],
        "answer", "other", 1,
    ),
]


def names_sql(i: int, t: Template) -> dict[str, str]:
    """Each name of a template as an SQL expression of its draws, which are columns ``d<template>_<name>``."""
    out = {n: f"d{i}_{n}" for n in t.draws}
    for name, sql in {**t.values, **t.texts}.items():
        out[name] = "(" + re.sub(r"[a-z_]+\b(?!\()", lambda m: out.get(m[0], m[0]), sql) + ")"
    return out


def text_sql(text: str, names: dict[str, str], quote_mark: str = "''") -> str:
    """A text with names in braces as an SQL expression; ``quote_mark`` stands for a single quote in a literal."""
    parts = re.split(r"\{(\w+)\}", text)
    return "concat(" + ", ".join(f"CAST({names[x]} AS STRING)" if i % 2 else "'" + x.replace("'", quote_mark) + "'" for i, x in enumerate(parts)) + ")"


def draw_key(seed: int, name: str) -> str:
    return f"{seed}:{name}:"


def draw(seed: int, name: str, key: Column, n: int) -> Column:
    """A number from 0 to n - 1: 32 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(draw_key(seed, name)), key)), 1, 8), 16, 10).cast("long")
    return bits % n


def answered(lines: list[str], answer: str) -> list[str]:
    return [*lines, "The answer is {" + answer + "}."]


def process_rows_of(df: DataFrame, key: Column, id_: Column, seed: int) -> DataFrame:
    """A gold record for each row of ``df``: ``key`` (a text; equal ones give equal records, null counts as empty) decides its
    numbers, ``id_`` is its id. One pass, no shuffle."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    rows = df.select(id_.alias("id"), key.alias("key"))
    drawn = {f"d{i}_{n}": lo + step * draw(seed, f"{i}.{n}", F.col("key"), (hi - lo) // step + 1) for i, t in enumerate(TEMPLATES) for n, (lo, hi, step) in t.draws.items()}
    rows = rows.withColumns({"which": draw(seed, "template", F.col("key"), len(TEMPLATES)), **drawn})
    record = None
    for i, t in enumerate(TEMPLATES):
        names = names_sql(i, t)
        text = lambda x: F.expr(text_sql(x, names, "\\'"))  # noqa: B023, E731
        own = F.struct(
            F.lit(t.gold).alias("gold_earliest_error_step"),
            text(t.question).alias("prompt"),
            F.expr(names[t.answer]).cast("string").alias("answer"),
            F.array(*map(text, answered(t.right, t.answer))).alias("correct_steps"),
            F.array(*map(text, answered(t.wrong, t.other))).alias("incorrect_steps"),
            F.expr(names[t.other]).cast("string").alias("incorrect_final_answer"),
        )
        record = F.when(F.col("which") == i, own) if record is None else record.when(F.col("which") == i, own)
    return rows.select("id", record.alias("r")).select("id", "r.*")
