"""Version numbers: parsed, compared, and checked against a least one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(version: Column) -> Column:
    """The numbers of the first dotted number in a text, trailing zeros left out, so that they compare as arrays; null without one."""
    dotted = F.regexp_extract(version, r"(\d+(?:\.\d+)*)", 1)
    bare = F.regexp_replace(dotted, r"(\.0+)+$", "")
    return F.when(dotted != "", F.transform(F.split(bare, r"\."), lambda x: x.cast("bigint")))


def at_least(version: Column, least: Column) -> Column:
    """Whether a version is the least one or later; null where either has no number."""
    return parsed(version) >= parsed(least)
