"""Text functions over reasoning traces, as Column expressions.

Regular expressions follow Unicode (``(?U)``) and take only ``\\n`` as a line end where lines matter (``(?d)``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
MARK = r"(?:step\s*\d+[:.)-]?|\d+[.)-])"
NUMBER = r"[-+]?\d+(?:\.\d+)?"

# Words that carry no content of a step.
STOPWORDS = [
    "the", "and", "for", "that", "with", "this", "from", "there", "then", "into", "have", "has", "had", "will", "would", "should", "could", "need",
    "needs", "show", "your", "reasoning", "step", "steps", "problem", "follow", "these", "solve", "determine", "calculate", "using", "after",
    "before", "each", "total",
]
# Phrases of a generic preamble.
PREAMBLE = [
    "let's break down", "lets break down", "let's solve", "lets solve", "step by step", "follow these steps", "we need to", "to determine", "let us",
    "first,", "first ",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def _non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def clean_parts(parts: Column) -> Column:
    """Without one leading step marker each, stripped, empty ones dropped."""
    return F.filter(F.transform(parts, lambda x: strip(F.regexp_replace(x, rf"(?Ui)\A{SPACE}*{MARK}{SPACE}*", ""))), lambda x: x != "")


def _several(steps: Column, other: Column) -> Column:
    """``steps`` if there are two or more, else ``other``."""
    return let(steps, lambda x: F.when(F.size(x) >= 2, x).otherwise(other))


def split_steps(text: Column) -> Column:
    """Steps of a trace: by markers at line starts, else markers within lines, else lines, else sentences; the
    first way that gives two steps counts, sentences in any case. Null and blank texts have no steps."""

    def ways(t: Column) -> Column:
        at_lines = clean_parts(F.split(t, rf"(?Uidm)^{SPACE}*{MARK}{SPACE}*"))
        inline = clean_parts(F.split(t, rf"(?Ui){SPACE}+(?=step\s*\d+[:.)-]?\s*)"))
        lines = _non_blank(F.split(t, "\n"))
        sentences = _non_blank(F.split(t, rf"(?U)(?<=[.!?]){SPACE}+"))
        return _several(at_lines, _several(inline, _several(lines, sentences)))

    return let(strip(F.coalesce(text, F.lit(""))), ways)


def canon(step: Column) -> Column:
    """Comparable form: lower case, no leading ``step N``, single spaces, only word characters and ``. + - * / =``."""
    s = F.regexp_replace(strip(F.lower(step)), rf"(?U)\Astep\s*\d+[:.)-]?{SPACE}*", "")
    s = F.regexp_replace(s, rf"(?U){SPACE}+", " ")
    return F.regexp_replace(s, r"(?U)[^\w\s.+\-*/=]", "")


def canon_steps(steps: Column) -> Column:
    return F.transform(steps, canon)


def extract_final_answer(text: Column) -> Column:
    """Last boxed answer, else last number after ``answer is``, else last number, else last line; null for blank texts."""

    def last(pattern: str, group: int) -> Column:
        return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))

    t = strip(text)
    line = F.when(t != "", strip(F.try_element_at(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), F.lit(-1))))
    boxed = strip(last(r"\\boxed\{([^}]+)\}", 1))
    return F.coalesce(boxed, last(rf"(?Ui)answer\s*(?:is|=)\s*({NUMBER})", 1), last(rf"(?U){NUMBER}", 0), line)


def normalize_answer(answer: Column) -> Column:
    s = F.regexp_replace(F.replace(F.lower(strip(answer)), F.lit(","), F.lit("")), rf"(?U){SPACE}+", " ")
    return F.when(s.rlike(r"(?U)\A[-+]?\d+\.0+\z"), F.regexp_replace(s, r"\.0+\z", "")).otherwise(s)


def is_correct_answer(predicted: Column, gold: Column) -> Column:
    return normalize_answer(predicted) == normalize_answer(gold)


def segment_text(steps: Column) -> Column:
    return strip(F.array_join(steps, "\n"))


def signature_of_canon(canonical: Column) -> Column:
    """Signature of a segment from its steps' canonical forms."""
    return strip(F.regexp_replace(F.array_join(canonical, " "), rf"(?U){SPACE}+", " "))


def segment_signature(steps: Column) -> Column:
    return signature_of_canon(canon_steps(F.filter(steps, lambda x: strip(x) != "")))


# Each of these has a form for a text and one, ``of_canon``, for its canonical form.


def alnum_of_canon(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\p{Alnum}]", "")


def alnum_signature(text: Column) -> Column:
    """Letters and digits of the canonical form alone, so that ``3+5`` equals ``35``."""
    return alnum_of_canon(canon(text))


def tokens_of_canon(c: Column) -> Column:
    words = F.split(strip(c), rf"(?U){SPACE}+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))))


def content_tokens(text: Column) -> Column:
    """Sorted set of the canonical words of three letters or more that carry content."""
    return tokens_of_canon(canon(text))


def math_of_canon(c: Column) -> Column:
    return c.rlike(r"(?U)[\d+\-*/=]")


def has_math(text: Column) -> Column:
    return math_of_canon(canon(text))


def preamble_of_canon(c: Column) -> Column:
    return c.rlike("|".join(rf"\Q{phrase}\E" for phrase in PREAMBLE))


def is_preamble(text: Column) -> Column:
    return preamble_of_canon(canon(text))


def prefix_lines(prefix: Column) -> Column:
    """Non-blank lines, or the stripped text as one."""
    lines = _non_blank(F.split(prefix, "\n"))
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(strip(prefix)))


def cumulative_prefixes(steps: Column) -> Column:
    """For each step the text up to and with it."""
    return F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: F.array_join(F.slice(steps, 1, i), "\n"))).otherwise(
        F.array().cast("array<string>")
    )


def training_prefix(prompt: Column, prefix_steps: Column) -> Column:
    return F.concat(strip(prompt), F.lit("\n\n"), segment_text(prefix_steps))


def judge_prompt(template: str, prompt: Column, prefix: Column) -> Column:
    """``template`` with {prompt} and {prefix} filled in (all other text is literal, that of the values too)."""
    out = [F.lit("")]
    for i, part in enumerate(re.split(r"\{(prompt|prefix)\}", template)):
        out.append(F.lit(part) if i % 2 == 0 else {"prompt": prompt, "prefix": prefix}[part])
    return F.concat(*out)


def log_prob_text(prompt: Column, prefix: Column) -> Column:
    """Fixed form of the text whose mean token log probability is a score."""
    return F.concat(F.lit("Question:\n"), prompt, F.lit("\n\nPartial solution:\n"), prefix)


def reward_turns(prompt: Column, prefix: Column, system: str, step_token: str) -> Column:
    """The conversation that a process reward model reads: array of (role, content); each step of the prefix ends with
    the step token."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    response = F.concat(F.array_join(prefix_lines(prefix), step_token), F.lit(step_token))
    return F.array(turn("system", F.lit(system)), turn("user", prompt), turn("assistant", response))


def reward_text(turns: Column) -> Column:
    """The turns as plain text, for models without a chat template."""
    own = lambda i: F.get(turns, F.lit(i))["content"]
    return F.concat(own(0), F.lit("\n\n"), log_prob_text(own(1), own(2)))


def gsm8k_answer(text: Column) -> Column:
    """Struct (solution, answer): around the last ``####``, else no solution and the last number or the text."""
    split = F.contains(text, F.lit("####"))
    tail = F.replace(strip(F.substring_index(text, "####", -1)), F.lit(","), F.lit(""))
    head = F.regexp_replace(text, r"(?s)####(?!.*####).*\z", "")
    number = F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?U)[-+]?\d[\d,]*(?:\.\d+)?"), F.lit(0)), F.lit(-1))
    answer = F.when(split, tail).otherwise(F.coalesce(F.replace(number, F.lit(","), F.lit("")), strip(text)))
    return F.struct(F.when(split, F.nullif(strip(head), F.lit(""))).alias("solution"), answer.alias("answer"))


def prompt_with_suffix(question: Column, append: bool = True) -> Column:
    q = strip(question)
    if not append:
        return q
    return F.when(F.contains(F.lower(q), F.lit("step by step")), q).otherwise(F.concat(q, F.lit("\nShow your reasoning step by step.")))
