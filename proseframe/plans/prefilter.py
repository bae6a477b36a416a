"""A cheap literal test in front of a pattern, derived from the pattern when a rule is built."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words that stand in most texts, so that it says little that one of them does.
COMMON = frozenset({"and", "for", "not", "that", "the", "this", "was", "with"})


def needed_literals(pattern: str, shortest: int = 2, most: int = 64) -> list[str] | None:
    """Lower-case strings of which every match holds at least one; None if there are no such strings.

    Of the parts of a sequence the one with the longest shortest string is taken. Only patterns that
    Python can parse are read; for others, as for letters beyond ASCII under (?i), the answer is None.
    """
    try:
        # classes that Python does not know hold no literal, so any class will do for them
        tree = _parser.parse(re.sub(r"\\[pP]\{\w+\}", r"\\w", pattern))
    except re.error:
        return None

    def of(items: list) -> list[str] | None:
        options, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is C.LITERAL and (chr(arg).isascii()):
                run += chr(arg).lower()
                continue
            if len(run) >= shortest:
                options.append([run])
            run = ""
            if op is C.SUBPATTERN:
                options.append(of(list(arg[3])))
            elif op is C.BRANCH:
                parts = [of(list(b)) for b in arg[1]]
                options.append(None if any(p is None for p in parts) else sorted({x for p in parts for x in p}))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                options.append(of(list(arg[2])))
        fit = [o for o in options if o and len(o) <= most and min(map(len, o)) >= shortest]
        return max(fit, key=lambda o: (min(map(len, o)), -len(o), COMMON.isdisjoint(o)), default=None)

    return of(list(tree))


def matches(text: Column, pattern: str) -> Column:
    """text matches pattern; texts without any needed literal are ruled out by plain search first."""
    literals = needed_literals(pattern)
    if not literals:
        return text.rlike(pattern)
    return holds_any(F.lower(text), literals) & text.rlike(pattern)


def holds_any(folded: Column, literals: Sequence[str]) -> Column:
    """Whether a text in lower case holds one of the strings; short ones, the likelier to stand there, are looked for first."""
    return functools.reduce(lambda a, b: a | b, [F.contains(folded, F.lit(x)) for x in sorted(literals, key=len)])
