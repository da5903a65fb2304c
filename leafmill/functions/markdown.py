"""Markdown clean-up: an ordered table of rewrites, folded into one expression of the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is removed and what stays are fixed values, as results must be the same everywhere; the rest follows from rules.
_INNER = r"(\S(?:[^\n]*?\S)?)"


def _between(mark: str) -> tuple[str, str]:
    """Text between ``mark`` and its mirror image loses both."""
    return re.escape(mark) + _INNER + re.escape(mark[::-1]), "$1"


def _single(mark: str) -> tuple[str, str]:
    """The same of one mark that stands at no letter outside and is not in the text."""
    m = re.escape(mark)
    return rf"(?<!\w){m}(\S(?:[^{m}\n]*\S)?){m}(?!\w)", "$1"


def _line(content: str) -> tuple[str, str]:
    """Lines of nothing but ``content`` go."""
    return rf"(?m)^{content}$", ""


_EMPTY_NUMBER = _line(r"\d+\.\s*")

#: Step, pattern and replacement, in the order in which they are applied; each is applied once.
REWRITES: tuple[tuple[str, str, str], ...] = tuple(
    (step, *rewrite)
    for step, rewrites in {
        "code spans": [(r"(?<!`)`([^`\n]+)`(?!`)", "$1")],
        "emphasis": [*map(_between, ("***", "___", "**_", "__*", "**", "__")), *map(_single, "*_")],
        "missing spaces": [(r"([a-z][.:;!?])([A-Z][a-z])", "$1 $2")],
        "list leftovers": [
            _line(r"[\-\*\+]\s*"),
            _EMPTY_NUMBER,
            _line(r"[\-\*\+]\s+:\s*.*"),
            _line(r"\d+\.\s+:\s*.*"),
            _line(r"\s*\*\s*[×]*\s*"),
            (r"(?:\d+\.\s+){2,}", ""),
            _EMPTY_NUMBER,
        ],
        "orphan brackets": [(r"\(\s*\)", ""), (r"\[\s*\]", ""), (r"(?<=\s)\)", ""), (r"(?m)^\)", "")],
    }.items()
    for rewrite in rewrites
)
STEPS = tuple(dict.fromkeys(step for step, _, _ in REWRITES))


def clean_markdown(text: Column, steps: tuple[str, ...] = STEPS) -> Column:
    """``text`` after the rewrites of ``steps``, in the table's order; what a removal uncovers stays. Null stays null.

    Patterns are matched with line ends and letters as in Python.
    """
    chosen = [(pattern, by) for step, pattern, by in REWRITES if step in steps]
    return reduce(lambda left, rewrite: F.regexp_replace(left, "(?Ud)" + rewrite[0], rewrite[1]), chosen, text)
