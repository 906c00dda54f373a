"""Divergence of sources by their terms, on cells of a cube (group block, group block, term block)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldspark.session import join_salted, scratch

SCALE = 1_000_000_000
#: fixed value: ASCII letters lower-cased and bytes of other characters make terms, the rest of ASCII separates them
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_counts(docs: DataFrame, text_col: str, group_col: str, source_col: str, held_terms: int = 300_000) -> DataFrame:
    """``lang, source, term, n, docs`` summed up per task: occurrences, and documents that hold the term. A row without a term
    stands for the group itself. Counts are handed on whenever a task holds ``held_terms`` of them."""
    schema = "lang string, source string, term binary, n long, docs long"
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(group_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"),
                       F.coalesce(F.col(text_col), empty).cast("binary").alias("text"))
    arrow = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def batch_of(held: dict) -> pa.RecordBatch:
        out: tuple = ([], [], [], [], [])
        for (lang, source), (n, d) in held.items():
            out[0].extend([lang] * (len(n) + 1))
            out[1].extend([source] * (len(n) + 1))
            out[2].extend([*n, None])
            out[3].extend([*n.values(), 0])
            out[4].extend([*(d[t] for t in n), 0])
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2]):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                words = text.as_py().translate(TERM_BYTES).split()
                size -= len(n)
                n.update(words)
                d.update(set(words))
                size += len(n)
                if size > held_terms:
                    yield batch_of(held)
                    held, size = {}, 0
        yield batch_of(held)

    return rows.mapInArrow(count, schema).groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + terms)), exact."""
    wide = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", wide, (total + terms).cast("decimal(20,0)"))


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def cell_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of the pairs of one cell, both ways.

    ``term`` null: one row per group with the share of a term that it lacks, and the number of terms of the block.
    """
    heads = pdf[pdf["term"].isna()].drop_duplicates("source")
    names, base, block = heads["source"].to_numpy(), heads["p"].to_numpy(np.int64), heads["gb"].to_numpy()
    at = {s: k for k, s in enumerate(names)}
    rows = pdf[pdf["term"].notna()]
    term, seen = pd.factorize(rows["term"])
    p = np.repeat(base[:, None], len(seen), axis=1)
    p[rows["source"].map(at).to_numpy(np.int64), term] = rows["p"].to_numpy(np.int64)
    absent = int(heads["m"].iloc[0]) - len(seen)
    lo, hi = pdf["g1"].iloc[0], pdf["g2"].iloc[0]
    out = []
    for i in range(len(names)):
        others = np.flatnonzero((block == (hi if block[i] == lo else lo)) & (np.arange(len(names)) != i))
        gap, gap0 = p[i] - p[others], base[i] - base[others]
        value = (gap * gap // p[others]).sum(axis=1) + absent * (gap0 * gap0 // base[others])
        out.append(pd.DataFrame({"source": names[i], "item": names[others], "value": value}))
    return pd.concat(out).assign(lang=pdf["lang"].iloc[0])[["lang", "source", "item", "value"]]


def source_divergence(docs: DataFrame, text_col: str = "text", group_col: str = "lang", source_col: str = "source", min_docs: int = 3,
                      top: int = 200, group_block: int = 32, term_block: int = 8192, folder: str | None = None) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source of a language is from each other one (``pair``) and the
    terms that it has more often than its language (``term``, ranks to ``top``).

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased; those of at least ``min_docs`` documents of
    the language are kept. Within a language sources and kept terms are dealt by hash into blocks of about ``group_block`` and
    ``term_block``; a task owns one cell of the cube of two source blocks and a term block, reads the slices replicated to
    it and gives the part of each pair's sum that lies in its terms; a sum along the term axis ends it. A term that
    neither source has counts with the shares of absent terms.

    Null text, language and source are ''. Every row is a document, repeated ones too. A language without kept terms has
    pairs of value 0 and no terms; a source alone in its language has no pair. Ties rank by item, bytewise. An empty table
    gives an empty result; further columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "divergence")
    counted = term_counts(docs, text_col, group_col, source_col)
    counted.write.parquet(f"{folder}/counts")
    counted = spark.read.schema(counted.schema).parquet(f"{folder}/counts")
    terms = counted.where("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("d")).where(F.col("d") >= min_docs).drop("d")
    kept.write.parquet(f"{folder}/kept")
    kept = spark.read.schema(kept.schema).parquet(f"{folder}/kept")
    rows = terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = counted.where("term IS NULL").select("lang", "source")
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("g"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v, g = F.coalesce("v", F.lit(0)), F.col("g")
    langs = sizes.join(langs, "lang", "left").select(
        "lang", v.alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        F.greatest(F.lit(1), F.ceil(v / term_block)).cast("int").alias("tbs"), F.ceil(g / group_block).cast("int").alias("gbs"))
    # one row per source; a language may have very many
    groups = (join_salted(groups, langs, ["lang"], ["source"], 4, "inner").join(totals, ["lang", "source"], "left")
              .withColumn("total", F.coalesce("total", F.lit(0))).withColumn("gb", F.pmod(F.xxhash64("source"), F.col("gbs")).cast("int")))
    groups.write.parquet(f"{folder}/groups")
    groups = spark.read.schema(groups.schema).parquet(f"{folder}/groups")
    shares = (join_salted(rows, groups, ["lang", "source"], ["term"], 8, "inner")
              .withColumn("p", share(F.col("n"), F.col("total"), F.col("v"))).withColumn("tb", F.pmod(F.xxhash64("term"), F.col("tbs")).cast("int")))

    listed = shares.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("v"))).where("p > q")
    listed = listed.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    ranked = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = listed.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # every slice goes to the cells of its source block, every source to all cells of its block
    blocks = join_salted(kept, langs.select("lang", "tbs"), ["lang"], ["term"], 8, "inner")
    blocks = blocks.groupBy("lang", F.pmod(F.xxhash64("term"), F.col("tbs")).cast("int").alias("tb")).agg(F.count(F.lit(1)).alias("m"))
    heads = (groups.withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("tbs") - 1))).join(blocks, ["lang", "tb"], "left")
             .withColumn("p", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)))).otherwise(F.lit(1))))
    cells = (shares.select("lang", "gbs", "gb", "tb", "source", "term", "p", F.lit(None).cast("long").alias("m"))
             .unionByName(heads.select("lang", "gbs", "gb", "tb", "source", F.lit(None).cast("string").alias("term"), "p", F.coalesce("m", F.lit(0)).alias("m")))
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("gbs") - 1)))
             .select("lang", F.least("gb", "_o").alias("g1"), F.greatest("gb", "_o").alias("g2"), "tb", "gb", "source", "term", "p", "m"))
    sums = cells.groupBy("lang", "g1", "g2", "tb").applyInPandas(cell_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(best)
