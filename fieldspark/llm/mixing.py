"""Mixing of sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldspark.llm.common import BLANKS, running_sum
from fieldspark.session import cut

#: fractional part of the golden ratio, and of 2**20 times it: a slot number is taken in two parts to keep digits
GOLDEN, GOLDEN_HIGH = 0.6180339887498949, math.fmod(0.6180339887498949 * 2**20, 1.0)
CYCLE = (1.0, 2.0, 3.0)
MAX_REPEATS = 3


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    body = F.regexp_replace(text, rf"^[{BLANKS}]+|[{BLANKS}]+$", "")
    return F.coalesce(F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, rf"[{BLANKS}]+"))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle=CYCLE, repeats: int = MAX_REPEATS) -> DataFrame:
    """``source, source_size, no, weight, target`` from ``source, source_size``, one row per source.

    Sources in code-point order, null last, weigh ``cycle`` in turn. A target stops at ``repeats`` times its source's
    size; what is cut off is shared again by weight among the rest, until none is above.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())  # one row per source
    weight = F.try_element_at(F.array(*[F.lit(float(w)) for w in cycle]), F.col("no") % len(cycle) + 1)
    src = cut(sizes.withColumn("no", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("limit", F.lit(float(repeats)) * F.col("source_size")))
    share = 0.0
    total = src.agg(F.sum("source_size")).first()[0] or 0
    while True:  # a source that is at its limit stays there, for the share of the others only rises
        full = F.col("weight") * F.lit(share) >= F.col("limit")
        fixed, weights = src.agg(F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).first()
        new = (total - (fixed or 0.0)) / weights if weights else share
        if new <= share:
            break
        share = new
    return src.withColumn("target", F.least(F.col("limit"), F.col("weight") * F.lit(share))).drop("limit")


def place_documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, chunk_docs: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """Documents with ``size`` and ``start``, their first word's place in their source's shuffled stream, and the
    sizes of sources. The shuffle is by hash of the id, so reruns agree."""
    sized = cut(docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
                .withColumn("_h", F.xxhash64("doc", F.lit(7))))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    targets = source_targets(sources)
    # chunks of the hash range that hold about chunk_docs documents of their source
    parts = F.greatest(F.lit(1), F.ceil(F.col("source_docs") / F.lit(chunk_docs))).cast("long")
    wide = sized.join(targets.select("no", F.col("source").alias("_s"), parts.alias("_parts")), F.expr("source <=> _s")).drop("_s")
    top = F.shiftrightunsigned("_h", 34)  # 30 bits, in the order of the unsigned hash
    wide = wide.withColumn("_u", top).withColumn("_chunk", F.floor(top * F.col("_parts") / F.lit(2**30)).cast("long"))
    placed = running_sum(wide, ["no"], "_chunk", ["_u", "_h", "doc", "size"], "size", "start")
    return placed.select("doc", "no", "size", "start"), targets


def schedule(targets: DataFrame, block: int, repeats: int = MAX_REPEATS) -> DataFrame:
    """``slot, no, rank, block, pass``: which block of which source each slot takes.

    Slot i has the point frac((i + 1) * golden ratio). The sources' cumulative shares cut the unit interval; the
    slots of a source, in order, take its blocks in the order of its shuffled stream, again and again.
    """
    spark = targets.sparkSession
    blocks = F.ceil(F.col("source_size") / F.lit(block)).cast("long")
    ideal = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * blocks).otherwise(0.0)
    src = cut(targets.select("no", blocks.alias("blocks"), ideal.alias("ideal"))
              .withColumn("hi", F.sum("ideal").over(W.orderBy("no"))).withColumn("lo", F.col("hi") - F.col("ideal")))
    whole, n_sources = src.agg(F.max("hi"), F.count(F.lit(1))).first()
    slots = max(0, round(whole or 0.0))
    cells = 4 * n_sources + 4096
    at = lambda c: F.floor(F.col(c) / F.lit(whole or 1.0) * F.lit(cells)).cast("long")
    in_cell = src.where("hi > lo").withColumn("_cell", F.explode(F.sequence(at("lo"), F.least(at("hi"), F.lit(cells - 1)))))
    number = F.col("slot") + 1
    point = F.pmod(F.shiftright(number, 20) * F.lit(GOLDEN_HIGH) + number.bitwiseAND((1 << 20) - 1) * F.lit(GOLDEN), F.lit(1.0))
    drawn = (spark.range(slots).withColumnRenamed("id", "slot").withColumn("_p", point)
             .withColumn("_cell", F.floor(F.col("_p") * F.lit(cells)).cast("long")).withColumn("_x", F.col("_p") * F.lit(whole or 0.0))
             .join(in_cell, "_cell").where("_x >= lo AND _x < hi")
             .select("slot", "no", "blocks", F.shiftright("slot", 14).alias("_chunk"), F.lit(1).alias("_one")))
    ranked = running_sum(drawn, ["no"], "_chunk", ["slot"], "_one", "rank")
    return (ranked.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("pass", F.floor(F.col("rank") / F.col("blocks")).cast("int"))
            .where(F.col("pass") < repeats).select("slot", "no", "rank", "block", "pass"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64) -> DataFrame:
    """``doc_id, source_no, size, source_size, target, taken`` of every row: how many words of it the mix takes, repeats
    counted.

    Sizes are words; targets see ``source_targets``. Each source's documents form a stream in hash order, cut in blocks of
    ``block`` words (the last may be shorter). The golden-ratio schedule says which source each slot draws from; the
    slots of a source take its blocks in turn, at most three times each. What a source gives differs from its target
    by a few blocks. Blocks of a document are counted by an equi-join on source and block, so a source with a third of all
    rows spreads over its blocks.

    Null or empty texts have size 0 and take 0; a null source is a source of its own, the last. Repeated rows are rows of
    their own with the same id. An empty table gives an empty result. Further columns are not read.
    """
    placed, targets = place_documents(docs, id_col, text_col, source_col)
    placed = cut(placed)
    plays = schedule(targets, block).groupBy("no", "block").agg(F.count(F.lit(1)).alias("plays"))
    first, last = F.floor(F.col("start") / block).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    taken = (pieces.join(plays, ["no", "block"]).groupBy("no", "start").agg(F.sum(overlap * F.col("plays")).alias("taken")))
    got = placed.where("size > 0").join(taken, ["no", "start"], "left").unionByName(placed.where("size = 0"), allowMissingColumns=True)
    return (got.join(targets.select("no", "source_size", "target"), "no")
            .select(F.col("doc").alias(id_col), F.col("no").alias("source_no"), "size", "source_size", F.col("target").cast("double").alias("target"),
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", block: int = 64) -> DataFrame:
    """The mix itself: each document as often as it is taken whole, plus its first words where the last pass ends in it.

    Columns as ``docs``; a cut text ends with its last taken word and its length in ``chars_col`` is counted anew. Rows
    that share an id share what the mix takes of them. Documents of which nothing is taken, empty ones among them, go.
    """
    mix = (mix_sources(docs, id_col, text_col, source_col, block).groupBy(id_col)
           .agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_all"), F.count(F.lit(1)).alias("_rows")).where("_taken > 0"))
    mix = mix.select(F.col(id_col).alias("_id"), F.ceil(F.col("_taken") / F.col("_rows")).cast("long").alias("_taken"))
    text = F.col("_r").getField(text_col)
    rows = (docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_r")).withColumn("_key", F.col("_r").getField(id_col))
            .join(mix, F.expr("_key <=> _id")).withColumn("_size", n_words(text)).where("_size > 0"))
    whole, part = F.floor(F.col("_taken") / F.col("_size")).cast("int"), F.col("_taken") % F.col("_size")
    lengths = F.concat(F.array_repeat(F.col("_size"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_take", F.explode(lengths))
    head = F.concat_ws(" ", F.slice(F.split(F.regexp_replace(text, rf"^[{BLANKS}]+", ""), rf"[{BLANKS}]+"), F.lit(1), F.col("_take").cast("int")))
    all_of_it = F.col("_take") >= F.col("_size")
    rows = rows.withColumn("_text", F.when(all_of_it, text).otherwise(head))
    made = {text_col: F.col("_text"), chars_col: F.when(all_of_it, F.col("_r").getField(chars_col) if chars_col in docs.columns else None).otherwise(F.length("_text").cast("long"))}
    return rows.select(*[made.get(c, F.col("_r").getField(c)).alias(c) for c in docs.columns])
