"""Wording rules and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases and what stands for them, in order.
SOFTER = [(r"new\s+planets", "planet candidates"), (r"new\s+planet", "planet candidate"), ("undiscovered", "not yet catalogued"), ("discovered", "detected")]
BANNED = r"new\s+planets?|discovered"


def soften(text: Column) -> Column:
    return reduce(lambda out, rule: F.regexp_replace(out, f"(?i){rule[0]}", rule[1]), SOFTER, text)


def is_banned(text: Column) -> Column:
    return text.rlike(f"(?i){BANNED}")


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns' values, each with its name, in order of the names; null differs from empty."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("\0"))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
