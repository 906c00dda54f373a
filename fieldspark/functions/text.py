"""Names, tags, paths and payloads as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldspark.functions.geo import col


#: fixed values: letters whose full case folding holds ASCII letters
FOLDS = {"\u00df": "ss", "\u017f": "s", "\u01f0": "j\u030c", "\u1e96": "h\u0331", "\u1e97": "t\u0308", "\u1e98": "w\u030a", "\u1e99": "y\u030a",
         "\u1e9a": "a\u02be", "\u1e9e": "ss", "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}


def strip(c) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), "(?U)^\\s+|\\s+$", "")


def casefold(c) -> Column:
    """Lower case with full folding where the result has ASCII letters."""
    out = F.lower(col(c))
    for letter, folded in FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(folded))
    return out


def canonical_name(c) -> Column:
    return F.regexp_replace(F.regexp_replace(casefold(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalise_class(c) -> Column:
    named = F.coalesce(F.nullif(col(c), F.lit("")), F.lit("unknown"))
    return F.translate(F.lower(strip(named)), " -", "__")


def normalise_tag(c) -> Column:
    return strip(F.regexp_replace(F.lower(col(c)), "(?U)\\s+", " "))


def clean_class_name(c) -> Column:
    bare = F.regexp_replace(strip(c), "^['\"]+|['\"]+$", "")
    return strip(F.regexp_replace(bare, "^[0-9]+ +", ""))


def base_name(path) -> Column:
    return F.regexp_extract(col(path), "([^/\\\\]+)$", 1)


def stem(path) -> Column:
    return F.regexp_replace(base_name(path), "\\.[^.]*$", "")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(col(path), "(\\.[^./\\\\]+)$", 1))


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def payload(c, path: str) -> Column:
    """One scalar of a JSON text; null when absent or malformed."""
    return F.get_json_object(col(c), path)


def expiry(expires, today: Column, soon_days: int = 30) -> Column:
    left = F.datediff(col(expires), today)
    return F.when(left < 0, "expired").when(left <= soon_days, "expiring").when(left.isNull(), "unknown").otherwise("valid")
