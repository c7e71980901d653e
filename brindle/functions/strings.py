"""String functions as column expressions; positions are 0-based and -1 means not found."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII character classes (fixed values).
CLASSES = {
    "cntrl": r"[\x00-\x1f\x7f]", "print": r"[\x20-\x7e]", "digit": r"[0-9]", "upper": r"[A-Z]", "lower": r"[a-z]", "alpha": r"[A-Za-z]",
    "alnum": r"[A-Za-z0-9]", "word": r"[A-Za-z0-9_]", "punct": r"[!-/:-@\[-`{-~]", "hex": r"[0-9A-Fa-f]", "space": r"[\x09-\x0d\x20]", "ascii": r"[\x00-\x7f]",
}
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quote(text: str) -> str:
    """A literal as a regular expression for Java."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def is_blank(c: Column) -> Column:
    return F.length(trim(c)) == 0


def byte_length(c: Column) -> Column:
    return F.octet_length(c)


def find(c: Column, part: str) -> Column:
    return F.instr(c, part) - 1


def rfind(c: Column, part: str) -> Column:
    at = F.instr(F.reverse(c), part[::-1])
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(c) - at - len(part) + 1)


def count_of(c: Column, part: str) -> Column:
    """Occurrences that do not overlap."""
    return F.regexp_count(c, F.lit(quote(part)))


def begins(c: Column, part: str) -> Column:
    return F.startswith(c, F.lit(part))


def ends(c: Column, part: str) -> Column:
    return F.endswith(c, F.lit(part))


def slice_text(c: Column, start: int, end: int | None = None) -> Column:
    """Characters from start up to end; negative numbers count from the end."""
    n = F.length(c)
    at = lambda i: F.greatest(F.lit(0), n + F.lit(i)) if i < 0 else F.least(F.lit(i), n)
    a = at(start)
    b = n if end is None else at(end)
    return F.substring(c, a + 1, F.greatest(F.lit(0), b - a))


def slice_to(c: Column, part: str) -> Column:
    """Up to the first occurrence of part, or all."""
    at = F.instr(c, part)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c)


def fold_ascii(c: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(c, _UP, _LOW)


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return fold_ascii(a) == fold_ascii(b)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def trim(c: Column) -> Column:
    """Without the characters up to the space at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def has_class(c: Column, name: str) -> Column:
    """Whether every character is of a class, and there is one."""
    return c.rlike(rf"^{CLASSES[name]}+\z")


def replace_all(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def parts(c: Column, sep: str, keep_empty: bool = False) -> Column:
    got = F.split(c, quote(sep))
    return got if keep_empty else F.filter(got, lambda x: x != "")


def parse_int(c: Column, base: int = 10) -> Column:
    """The number that a text begins with, 0 if none."""
    if base == 10:
        return F.coalesce(F.regexp_extract(c, r"^[\x00-\x20]*([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:base]
    body = F.regexp_extract(F.lower(c), rf"^[\x00-\x20]*[+-]?([{digits}]+)", 1)
    minus = c.rlike(r"^[\x00-\x20]*-")
    value = F.coalesce(F.conv(F.nullif(body, F.lit("")), base, 10).try_cast("long"), F.lit(0).cast("long"))
    return F.when(minus, -value).otherwise(value)


def parse_prefixed(c: Column) -> Column:
    """Like parse_int, in base 16, 2 or 8 after 0x, 0b or 0o."""
    rest = F.substring(c, 3, 1 << 30)
    return F.when(c.rlike(r"^0[xX]"), parse_int(rest, 16)).when(c.rlike(r"^0[bB]"), parse_int(rest, 2)).when(c.rlike(r"^0[oO]"), parse_int(rest, 8)).otherwise(parse_int(c))


def parse_float(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"^[\x00-\x20]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))


def parse_bool(c: Column) -> Column:
    t = fold_ascii(trim(c))
    return t.isin("true", "yes", "on") | (parse_int(t) != 0)


def parse_guid(c: Column) -> Column:
    """Canonical lower-case form of a GUID with or without braces and dashes; null if it is none."""
    h = F.regexp_replace(fold_ascii(trim(c)), r"[{}()\-]", "")
    return F.when(h.rlike(r"^[0-9a-f]{32}\z"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5"))


def format_int(c: Column, width: int = 0, zeros: bool = False) -> Column:
    return F.format_string(f"%{'0' if zeros and width else ''}{width or ''}d", c)


def format_float(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def justify(c: Column, width: int, how: str = "left", fill: str = " ") -> Column:
    """Padded to a width; longer texts stay whole."""
    n = F.greatest(F.length(c), F.lit(width))
    if how == "left":
        return F.rpad(c, n, fill)
    if how == "right":
        return F.lpad(c, n, fill)
    half = F.length(c) + F.floor((n - F.length(c)) / 2).cast("int")
    return F.rpad(F.lpad(c, half, fill), n, fill)


def transcode(c: Column, charset: str) -> Column:
    return F.encode(c, charset)


def from_bytes(c: Column, charset: str) -> Column:
    return F.decode(c, charset)


def tokens(c: Column, pattern: str = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|[^\s]") -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def repeat(c: Column, n: int) -> Column:
    return F.repeat(c, n)


def glob_pattern(glob: str) -> str:
    """A glob of * and ? as an anchored pattern."""
    return r"^(?s:" + "".join(".*" if ch == "*" else "." if ch == "?" else quote(ch) for ch in glob) + r")\z"


def glob_match(c: Column, glob: str, ignore_case: bool = False) -> Column:
    return fold_ascii(c).rlike(glob_pattern(glob.lower())) if ignore_case else c.rlike(glob_pattern(glob))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


@F.pandas_udf(T.IntegerType())
def edit_distance_swaps(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits with swaps of neighbours, each place edited once."""

    def one(s: str | None, t: str | None) -> int | None:
        if s is None or t is None:
            return None
        back, prev = None, list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            row = [i]
            for j, y in enumerate(t, 1):
                d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
                if i > 1 and j > 1 and x == t[j - 2] and s[i - 2] == y:
                    d = min(d, back[j - 2] + 1)
                row.append(d)
            back, prev = prev, row
        return prev[-1]

    return pd.Series([one(s, t) for s, t in zip(a, b, strict=True)], dtype="Int32")


def si_suffix(c: Column) -> Column:
    """A number with the suffix of its power of 1000 and three significant digits."""
    x = F.abs(c.cast("double"))
    out = F.format_string("%.3g", c.cast("double"))
    for p, s in ((1e-9, "n"), (1e-6, "u"), (1e-3, "m"), (1.0, ""), (1e3, "k"), (1e6, "M"), (1e9, "G"), (1e12, "T")):
        v = c.cast("double") / F.lit(p)
        text = F.when(F.abs(v) >= 100, F.format_string("%.0f", v)).when(F.abs(v) >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
        out = F.when(x >= p, F.concat(text, F.lit(s))).otherwise(out)
    return F.when(c == 0, F.lit("0")).otherwise(out)
