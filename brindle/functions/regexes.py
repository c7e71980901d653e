"""Regular expressions: match, search, captures, replacement, sets of patterns, combinators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What needs backtracking, so that the time may grow beyond the text's length: references, looking around, atoms, conditions.
_BACKTRACKS = re.compile(r"\\[1-9]|\\k[<{']|\(\?(?:[=!>(]|<[=!]|P=)|[*+?}]\+")


def safe(pattern: str) -> str:
    """The pattern itself, if it needs no backtracking; else it raises."""
    plain = re.sub(r"\\[^1-9k]|\[\^?\]?[^\]]*\]", "", pattern)
    if m := _BACKTRACKS.search(plain):
        raise ValueError(f"{m[0]} needs backtracking")
    return pattern


def match(c: Column, pattern: str) -> Column:
    """Whether the whole text matches."""
    return c.rlike(rf"^(?:{pattern})\z")


def search(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def capture(c: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match; null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def capture_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def replace(c: Column, pattern: str, new: str) -> Column:
    """Every match replaced; $1 stands for a group."""
    return F.regexp_replace(c, pattern, new)


def first_of(c: Column, patterns: list[str]) -> Column:
    """Index of the pattern that matches first in the text, the earlier of equals; -1 if none does."""
    found = [F.struct(F.nullif(F.regexp_instr(c, F.lit(p)), F.lit(0)).alias("at"), F.lit(i).alias("id")) for i, p in enumerate(patterns)]
    best = F.array_min(F.filter(F.array(*found), lambda x: x["at"].isNotNull()))
    return F.when(c.isNotNull(), F.coalesce(best["id"], F.lit(-1)))


def all_of_set(c: Column, patterns: list[str]) -> Column:
    """Indexes of all patterns that match somewhere."""
    return F.filter(F.array(*[F.when(c.rlike(p), F.lit(i)) for i, p in enumerate(patterns)]), lambda x: x.isNotNull())


def replace_set(c: Column, replacements: list[tuple[str, str]]) -> Column:
    """Patterns replaced one after another."""
    for p, new in replacements:
        c = F.regexp_replace(c, p, new)
    return c


def either(*p: str) -> str:
    return "(?:" + "|".join(p) + ")"


def seq(*p: str) -> str:
    return "".join(f"(?:{x})" for x in p)


def many(p: str) -> str:
    return f"(?:{p})*"


def some(p: str) -> str:
    return f"(?:{p})+"


def maybe(p: str) -> str:
    return f"(?:{p})?"


def between(p: str, lo: int, hi: int | None = None) -> str:
    return f"(?:{p}){{{lo},{'' if hi is None else hi}}}"


def group(p: str) -> str:
    return f"({p})"
