"""Column expressions. Everything here returns a ``Column`` that stays inside
whole-stage code generation (no Python UDFs)."""

from armada.functions.text import (  # noqa: F401
    answer_letter, instruct_prompt, mc_prompt, mc_prompt_from_pairs, parse_answer,
    parse_list_literal, python_list_literal, short_model_name, strip_unicode,
    strip_echo, task_words,
)
from armada.functions.vectors import (  # noqa: F401
    as_double_array, l2_norm,
)
