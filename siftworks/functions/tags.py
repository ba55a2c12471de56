"""Named patterns over texts: which of them match, as an array column in a fixed order.

Words, digits and white space are those of Unicode: a letter beyond ASCII is part of a
word, so ``\\b`` stands between neither of its sides and another letter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column

# ---- Fixed values: name and pattern of each signal. ----
MANY_ANSWERS = (
    ("print_any", r"(?i)\bprint\s+any\b"),
    ("output_any", r"(?i)\boutput\s+any\b"),
    ("any_of_them", r"(?i)\b(?:print|output)\s+any\s+of\s+them\b"),
    ("any_valid_answer", r"(?i)\bany\s+(?:valid|correct|suitable)\s+(?:answer|solution|way|sequence|permutation|order|triple|set|arrangement)\b"),
    ("any_permutation", r"(?i)\b(?:print|output)\s+any\s+(?:permutation|sequence|arrangement)\b"),
    ("multiple_answers", r"(?i)\bmultiple\s+(?:answers|solutions|ways|possible\s+answers)\b"),
    ("several_answers", r"(?i)\b(?:if|when)\s+there\s+are\s+(?:several|multiple|many|more\s+than\s+one)\s+(?:\w+\s+){0,3}?(?:answers|solutions|ways|options|variants)\b"),
    ("any_order_output", r"(?i)\b(?:print|output)\b[^.\n]{0,100}?\bin\s+any\s+(?:arbitrary\s+)?order\b"),
)
INTERACTIVE = (
    ("interactive_keyword", r"(?i)\binteractive\b"),
    ("flush_output", r"(?i)\bflush(?:es|ing|ed)?\b"),
)
PYTHON2 = (
    ("raw_input", r"\braw_input\s*\("),
    ("xrange", r"\bxrange\s*\("),
    ("print_statement", r"(?m)^\s*print\s+[^(=\s]"),
    ("print_redirect", r"\bprint\s*>>"),
    ("iteritems", r"\.\s*iter(items|keys|values)\s*\("),
    ("has_key", r"\.\s*has_key\s*\("),
    ("basestring", r"\bbasestring\b"),
    ("unicode", r"\bunicode\s*\("),
    ("long_literal", r"\blong\s*\("),
    ("old_except", r"except\s+[\w.]+\s*,\s*\w+\s*:"),
    ("old_raise", r"\braise\s+\w+\s*,\s*"),
    ("backtick_repr", r"`[^`\n]+`"),
)


def matching(c: Column | str, patterns: tuple[tuple[str, str], ...]) -> Column:
    """Names of the patterns that the text matches; none for null."""
    text = F.coalesce(column(c), F.lit(""))
    return F.array_compact(F.array(*(F.when(text.rlike("(?U)" + p), F.lit(name)) for name, p in patterns)))


def many_answers(c: Column | str) -> Column:
    return matching(c, MANY_ANSWERS)


def interactive(c: Column | str) -> Column:
    return matching(c, INTERACTIVE)


def python2(c: Column | str) -> Column:
    return matching(c, PYTHON2)
