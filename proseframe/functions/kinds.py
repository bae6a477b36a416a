"""Content kinds, clocks and small scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that mark a language.
MARKS = {
    "xml": r"^\s*<\?xml ",
    "html": r"(?i)^\s*<(!doctype html|html|head|body|div|p|span|script|a )",
    "sql": r"(?i)^\s*(select|insert into|create table|update|delete from|alter table) ",
    "python": r"^\s*(def \w+\(|import \w+|from \w+ import |class \w+[:(])",
    "javascript": r"^\s*(const |let |var |function \w+\(|export |import .* from )",
    "shell": r"^\s*(#!/bin/(ba)?sh|set -e|echo |if \[ |fi$|done$)",
    "yaml": r"^\s*(- )?[A-Za-z_][\w.-]*:( |$)",
    "markdown": r"^(#{1,6} |[-*+] |\d+\. |> |```)",
}


def mark_counts(lines: Column) -> dict[str, Column]:
    """Number of lines that mark each language."""
    return {k: F.size(F.filter(lines, _marked(p))) for k, p in MARKS.items()}


def _marked(pattern: str) -> Callable[[Column], Column]:
    return lambda s: s.rlike(pattern)


def content_kind(text: Column) -> Column:
    """The kind of a text; the first test that holds wins. Yaml and shell go by their share of lines."""
    ls = F.split(text, "\n", -1)
    n = mark_counts(ls)
    full = F.size(F.filter(ls, lambda s: s.rlike(r"\S")))
    return (
        F.when(n["xml"] > 0, "xml").when(n["html"] > 0, "html")
        .when(text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull(), "json")
        .when(n["sql"] > 0, "sql").when(n["python"] > 0, "python").when(n["javascript"] > 0, "javascript")
        .when((n["shell"] > 0) & (4 * n["shell"] >= full), "shell").when((n["yaml"] > 0) & (2 * n["yaml"] >= full), "yaml")
        .when(n["markdown"] > 0, "markdown").otherwise("text")
    )


#: A license notice: a copyright line or a license tag.
LICENSE = r"(?i)\bcopyright\b|\(c\)\s*(?:19|20)[0-9]{2}|SPDX-License-Identifier"


def is_license_notice(text: Column, pattern: str = LICENSE) -> Column:
    """A text that states a license; no rule measures it."""
    return text.rlike(pattern)


def twelve_hour(ts: Column, zone: str) -> Column:
    """A UTC time as a 12-hour clock of a zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "MMM d h:mm a")


def twelve_hour_text(text: Column) -> Column:
    """24-hour clocks in a text as 12-hour ones; durations (three parts, or a unit after them) stay."""
    clock = r"(?<![0-9:])([01]?[0-9]|2[0-3]):([0-5][0-9])(?![0-9:])(?!\s*(?:h|hours?|min|minutes?|s|seconds?|[AaPp]\.?[Mm])(?![A-Za-z]))"
    parts = F.split(F.regexp_replace(text, clock, "\u0001$1:$2\u0002"), "\u0001|\u0002", -1)

    def one(p: Column, i: Column) -> Column:
        hour = F.substring_index(p, ":", 1).try_cast("int")
        shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string")
        return F.when(i % 2 == 1, F.concat(shown, F.lit(":"), F.substring_index(p, ":", -1), F.when(hour < 12, " AM").otherwise(" PM"))).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def json_entries(text: Column) -> Column:
    """A flat JSON object as a map; null where the text is none."""
    return F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
