"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: action, host, path prefix; the longest rule that fits decides
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: words in a host name that put a page's URL on the list of the registered query
LISTED_TERMS = ("adult", "casino", "bets", "spam")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: fixed values: query parameters that do not change what a page shows
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without a trailing slash, and the query without tracking parameters; no scheme,
    no fragment. Empty for a url without host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&+", "")
    return F.when(host == "", F.lit("")).otherwise(F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, else null."""
    name = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _bits(canon: str) -> tuple[Column, Column]:
    """Block hash and the four bits within the block's 64-bit word."""
    h = F.xxhash64(canon)
    mask = F.lit(0).cast("long")
    for shift in (8, 20, 34, 48):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(63).cast("int")))
    return h, mask


def bloom_blocks(listed: DataFrame, canon: str, blocks: int) -> DataFrame:
    """``_block, _word``: at most ``blocks`` rows, however long the list is."""
    h, mask = _bits(canon)
    return listed.select(F.pmod(h, F.lit(blocks)).cast("int").alias("_block"), mask.alias("_mask")).groupBy("_block").agg(F.bit_or("_mask").alias("_word"))


def url_filter(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url",
               rules=RULES, blocks: int = 1 << 16, salts: int = 16) -> DataFrame:
    """``id, host, path, rule, verdict, listed`` of every row of ``pages``.

    ``verdict`` is the longest fitting rule's, else ``block`` if the canonical URL is on the list, else ``allow``.
    The filter is broadcast: it has at most ``blocks`` rows of 16 bytes, whatever the list's length; a longer list
    only lets more rows through to the exact join. Rows that it turns away never move. A URL that many pages share is
    spread over ``salts`` tasks.

    A null url, or one without ``://``, has empty host and path, fits no rule and is not listed. Null and repeated ids
    pass through, one row each; an empty list lists nothing; further columns of ``pages`` are not read.
    """
    known = listed.select(canonical(F.col(listed_col)).alias("_canon")).where("_canon <> ''").distinct()
    rows = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), canonical(F.col(url_col)).alias("_canon"))
    h, mask = _bits("_canon")
    seen = (rows.withColumn("_block", F.pmod(h, F.lit(blocks)).cast("int"))
            .join(F.broadcast(bloom_blocks(known, "_canon", blocks)), "_block", "left")
            .withColumn("_maybe", (F.col("_canon") != "") & F.coalesce(F.col("_word").bitwiseAND(mask) == mask, F.lit(False))))
    maybe = seen.where("_maybe").withColumn("_salt", F.pmod(F.xxhash64(id_col, "host", "path"), F.lit(salts)))
    exact = known.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).withColumn("_hit", F.lit(True))
    hits = maybe.join(exact, ["_canon", "_salt"], "left").select(id_col, "host", "path", F.coalesce("_hit", F.lit(False)).alias("listed"))
    rest = seen.where("NOT _maybe").select(id_col, "host", "path", F.lit(False).alias("listed"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return hits.unionByName(rest).select(
        id_col, "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")


def listed_pages(pages: DataFrame, url_col: str = "url", terms=LISTED_TERMS) -> DataFrame:
    """The list of the registered query: secure URLs on hosts whose name holds one of ``terms``."""
    return pages.where(F.col(url_col).startswith("https://") & host_of(F.col(url_col)).rlike("|".join(terms))).select(url_col)
