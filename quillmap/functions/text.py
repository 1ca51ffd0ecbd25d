"""Small text expressions: slugs, labels, front matter, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits become one hyphen, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def short_label(text: Column, n: int) -> Column:
    """White space made single, at most ``n`` characters, the last three dots if it was longer."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 3)), F.lit("..."))).otherwise(flat)


def with_prefix(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), text)


def arm(label: Column) -> Column:
    """The arm of a label like ``name_s42``; a label without a seed is its own arm."""
    return F.when(label.rlike(r"_s[0-9]+$"), F.regexp_extract(label, r"^(.*)_s[0-9]+$", 1)).otherwise(label)


def seed(label: Column) -> Column:
    return F.when(label.rlike(r"_s[0-9]+$"), F.regexp_extract(label, r"_s([0-9]+)$", 1).cast("int"))


def header_field(text: Column, name: str) -> Column:
    """A field of a flat ``key: value`` header."""
    found = F.regexp_extract(text, rf"(?m)^[ ]*{name}: *([^\n]*)$", 1)
    return F.when(found != "", F.trim(found))
