"""Prompt construction and answer extraction as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from armada import config as C


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_unicode(c) -> Column:
    """Remove leading and trailing Unicode whitespace (Python ``str.strip``)."""
    ws = C.WS_CLASS
    return F.regexp_replace(_col(c), F.lit(rf"\A{ws}+|{ws}+\z"), F.lit(""))


def _letter(i: Column) -> Column:
    # chr(65 + i); Spark's char() wraps at 256, callers keep i small.
    return F.char(i + F.lit(65))


def mc_prompt(question, choices) -> Column:
    """Multiple-choice prompt from a question and an ``array<string>`` of
    choices: one ``X. choice`` line per choice (stripped), as many letters as
    choices. A NULL choices array gives the four placeholder lines; a NULL
    choice cannot be stripped and makes the whole prompt NULL (the caller
    flags the row)."""
    choices = _col(choices)
    lines = F.array_join(
        F.transform(choices, lambda c, i: F.concat(_letter(i), F.lit(". "), strip_unicode(c), F.lit("\n"))),
        "",
    )
    placeholder = F.lit("".join(f"{chr(65 + i)}. {t}\n" for i, t in enumerate(C.MC_PLACEHOLDER_CHOICES)))
    body = F.when(choices.isNull(), placeholder).when(~F.exists(choices, lambda c: c.isNull()), lines)
    return F.concat(F.lit(C.MC_PROMPT_HEAD), _col(question), F.lit(C.MC_PROMPT_OPTIONS), body, F.lit(C.MC_PROMPT_TAIL))


def mc_prompt_from_pairs(question, pairs) -> Column:
    """Same prompt for keyed choices given as ``array<struct<key,value>>``:
    keys are printed as given, in array order."""
    pairs = _col(pairs)
    lines = F.array_join(
        F.transform(pairs, lambda kv: F.concat(kv["key"], F.lit(". "), strip_unicode(kv["value"]), F.lit("\n"))),
        "",
    )
    return F.concat(F.lit(C.MC_PROMPT_HEAD), _col(question), F.lit(C.MC_PROMPT_OPTIONS), lines, F.lit(C.MC_PROMPT_TAIL))


def task_words(task) -> Column:
    """``high_school_physics`` -> ``high school physics``."""
    return F.replace(_col(task), F.lit("_"), F.lit(" "))


def instruct_prompt(task, question, choices, strict: bool = False) -> Column:
    """Instruction prompt for embedding. Choices are printed as ``A). text``
    without stripping, a NULL choice as ``None``; more than four choices
    gives NULL (the caller flags the row as rejected), or fails the job when
    ``strict``."""
    choices = _col(choices)
    lines = F.array_join(
        F.transform(choices, lambda c, i: F.concat(_letter(i), F.lit("). "), F.coalesce(c, F.lit("None")), F.lit("\n"))), ""
    )
    text = F.concat(
        F.lit(C.INSTRUCT_HEAD), task_words(task), F.lit(C.INSTRUCT_MID), _col(question),
        F.lit(C.INSTRUCT_CHOICES), lines,
    )
    ok = F.size(choices) <= len(C.INSTRUCT_LETTERS)
    if strict:
        return F.when(ok, text).otherwise(
            F.raise_error(F.lit("a question has more than four choices")).cast("string"))
    return F.when(ok, text)


def python_list_literal(arr) -> Column:
    """Render an ``array<string>`` as a Python list literal with single
    quotes (backslash, quote and newline escaped)."""
    def quote(s):
        s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
        s = F.replace(s, F.lit("'"), F.lit("\\'"))
        s = F.replace(s, F.lit("\n"), F.lit("\\n"))
        return F.concat(F.lit("'"), s, F.lit("'"))
    return F.concat(F.lit("["), F.array_join(F.transform(_col(arr), quote), ", "), F.lit("]"))


def parse_list_literal(s) -> Column:
    """Parse a Python list literal of strings/numbers into ``array<string>``.
    Single and double quotes, backslash escapes and numbers are accepted;
    anything not readable (tuples, bare None) gives NULL."""
    return F.from_json(
        _col(s), "array<string>",
        {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true", "mode": "PERMISSIVE"},
    )


def read_choices(s) -> Column:
    """``parse_list_literal``, and ``literal_list_exact`` for what it cannot read."""
    s = _col(s)
    fast = parse_list_literal(s)
    return F.coalesce(fast, literal_list_exact(F.when(fast.isNull(), s)))


def strip_echo(generated_text, prompt) -> Column:
    """Drop the echoed prompt by its length (no prefix check)."""
    return F.call_function("substring", _col(generated_text), F.length(_col(prompt)) + F.lit(1))


def parse_answer(text) -> Column:
    """First standalone capital A-D in ``text``; NULL when there is none."""
    return F.regexp_substr(_col(text), F.lit(C.ANSWER_PATTERN))


def answer_letter(answer) -> Column:
    """Answer index 0..25 -> letter; NULL outside that range."""
    a = _col(answer)
    return F.when(a.between(0, 25), _letter(a))


def short_model_name(model_id) -> Column:
    """Text after the last ``/``."""
    return F.substring_index(_col(model_id), "/", -1)


def literal_list_exact(s) -> Column:
    """Slow path of ``parse_list_literal`` for rows the JVM reader rejects
    (tuples, ``None`` items, ``\\x`` escapes): Python ``ast.literal_eval``
    in an Arrow-batched pandas UDF. Items become strings (``None`` stays
    NULL); anything that is not a list or tuple gives NULL. Apply it only to
    the rejected rows (e.g. ``where(parse_list_literal(c).isNull())``)."""
    global _literal_list_udf
    if _literal_list_udf is None:
        _literal_list_udf = F.pandas_udf(_literal_list_eval, "array<string>")
    return _literal_list_udf(_col(s))


def _literal_list_eval(series):
    import ast

    import pandas as pd

    def one(v):
        if v is None:
            return None
        try:
            out = ast.literal_eval(v)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None
        if not isinstance(out, (list, tuple)):
            return None
        return [None if x is None else str(x) for x in out]

    return pd.Series([one(v) for v in series])


_literal_list_udf = None
