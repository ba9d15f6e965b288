"""Case-insensitive name globs in which only ``*`` is special."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from toolwarden.functions.text import IGNORE_CASE, any_of


def glob_regex(pattern: str) -> str:
    """Expression of a glob in the dialect of the JVM."""
    body = ".*".join(re.escape(part) if part else "" for part in pattern.split("*"))
    return f"^{body}$"


def matches_glob(name: Column, pattern: str) -> Column:
    """Does the name match?  ``*`` alone matches everything, an empty pattern
    only the empty name."""
    if pattern == "*":
        return F.lit(True)
    if "*" not in pattern:
        return F.lower(name) == F.lit(pattern.lower())
    return F.rlike(name, F.lit(IGNORE_CASE + glob_regex(pattern)))


def matches_any_glob(name: Column, patterns: list[str]) -> Column:
    """Does the name match one of the globs?  Plain names become one hash set
    and all globs one expression, so the cost does not follow the rule count."""
    if "*" in patterns:
        return F.lit(True)
    plain = sorted({p.lower() for p in patterns if "*" not in p})
    globs = sorted({p for p in patterns if "*" in p})
    tests = []
    if plain:
        tests.append(F.lower(name).isin(plain))
    if globs:
        body = "|".join(glob_regex(p) for p in globs)
        tests.append(F.rlike(name, F.lit(f"{IGNORE_CASE}(?:{body})")))
    return any_of(tests)
