"""Chat formatting by quotation linking: quoted passages are joined to the messages they come from."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fieldspark.operators.ordered import block, with_previous, with_row_number
from fieldspark.session import cut, join_salted

_QUOTED = re.compile(r"((?:[ \t]*>)+)[ \t]?(.*)")
#: fixed values: what mail programs put above a quotation
_ATTRIBUTION = re.compile(r".{0,200}\b(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*")
LEAST_WORDS = 3  # shorter paragraphs and lines link nothing by themselves


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotations and the lines that announce them, and the passages: runs of lines of one level."""
    own, passages, before = [], [], 0
    for line in text.split("\n"):
        hit = _QUOTED.fullmatch(line.rstrip("\r"))
        level = hit[1].count(">") if hit else 0
        if not level:
            own.append(line)
        else:
            if before == 0:
                while own and not own[-1].strip() and len(own) > 1 and _ATTRIBUTION.fullmatch(own[-2]):
                    own.pop()
                if own and _ATTRIBUTION.fullmatch(own[-1]):
                    own.pop()
            if level == before:
                passages[-1] = (level, passages[-1][1] + "\n" + hit[2])
            else:
                passages.append((level, hit[2]))
        before = level
    return "\n".join(own).strip(), passages


def units(text: str) -> dict[int, int]:
    """Hash and number of words of a normalised passage, its paragraphs and its lines."""
    parts = [text, *re.split(r"\n\s*\n", text), *text.split("\n")]
    out = {}
    for k, part in enumerate(parts):
        words = part.casefold().split()
        if len(words) >= (LEAST_WORDS if k else 1):
            out[xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)] = len(words)
    return out


def parsed(messages: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = messages.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
                           F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    quoted = pa.list_(pa.struct([("level", pa.int32()), ("unit", pa.int64()), ("words", pa.int64())]))
    schema = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n_quotes", pa.int64()), ("own", pa.list_(pa.int64())), ("quoted", quoted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, own, seen = [], [], [], []
            for value in batch.column("_text"):
                text, passages = parse(value.as_py())
                texts.append(text)
                counts.append(len(passages))
                own.append(list(units(text)))
                seen.append([{"level": level, "unit": u, "words": n} for level, passage in passages for u, n in units(passage).items()])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), batch.column("role"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                                              pa.array(own, schema.field("own").type), pa.array(seen, quoted)], schema=schema)

    return cut(rows.mapInArrow(run, "conv long, turn long, role string, text string, n_quotes long, own array<long>, quoted array<struct<level int, unit long, words long>>"))


def quote_links(rows: DataFrame) -> DataFrame:
    """``conv, turn, from_conv, from_turn, linked``: the message that most quoted words of the lowest quote level come from.

    A passage comes from the first message of its conversation that says it, else from the first of all, and only from
    an earlier one by conversation and turn. Each unit's first message is one row, so quotations of a common line meet
    it in linear work; the units of common lines are salted.
    """
    said = rows.select("conv", "turn", F.explode("own").alias("unit"))
    here = said.groupBy("unit", "conv").agg(F.min("turn").alias("_here"))
    first = said.groupBy("unit").agg(F.min(F.struct("conv", "turn")).alias("_first"))
    quotes = rows.select("conv", "turn", F.explode("quoted").alias("_q")).select("conv", "turn", "_q.level", "_q.unit", "_q.words").distinct()
    found = join_salted(join_salted(quotes, here, ["unit", "conv"], ["turn"]), first, ["unit"], ["conv", "turn"])
    source = (F.when(F.col("_here") < F.col("turn"), F.struct("conv", F.col("_here").alias("turn")))
              .when(F.col("_first") < F.struct("conv", "turn"), F.col("_first")))
    found = found.withColumn("_from", source).where("_from IS NOT NULL")
    each = found.groupBy("conv", "turn", "_from").agg(F.min("level").alias("_level"), F.sum("words").alias("_words"))
    best = F.max_by("_from", F.struct(-F.col("_level"), F.col("_words"), F.col("_from")))
    return each.groupBy("conv", "turn").agg(best.alias("_from"), F.count(F.lit(1)).alias("linked")).select("conv", "turn", F.col("_from.conv").alias("from_conv"), F.col("_from.turn").alias("from_turn"), "linked")


def threads_of(links: DataFrame) -> DataFrame:
    """``conv, thread`` of conversations that answer another one: followed to the first one, by pointer jumping."""
    up = (links.where("from_conv <> conv").groupBy("conv").agg(F.min_by("from_conv", "turn").alias("thread")))
    up = cut(up)
    while True:  # every step goes to a smaller conversation, and doubles the distance covered
        further = up.select(F.col("conv").alias("thread"), F.col("thread").alias("_next"))
        new = cut(up.join(further, "thread", "left").select("conv", F.coalesce("_next", "thread").alias("thread"), F.col("_next").isNotNull().alias("_moved")))
        moved = new.where("_moved").limit(1).count()
        up = new.drop("_moved")
        if not moved:
            return up


def linked_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: ``conv, turn, role, text`` (without quotations), ``n_quotes, linked, parent_conv, parent_turn, thread, position``.

    The parent is the message most of whose words are quoted, else the message of the turn before. Conversations whose
    messages quote another conversation join its thread; ``position`` counts a thread's messages in an order in which
    every message follows its parent (conversation, then turn).

    A null text is empty, a null role ``unknown``. A message with a null conversation or turn stands alone: no parent,
    its conversation as thread, no position. Repeated rows are messages of their own. Further columns are not read.
    """
    rows = parsed(messages, conv_col, turn_col, role_col, text_col)
    whole, loose = rows.where("conv IS NOT NULL AND turn IS NOT NULL"), rows.where("conv IS NULL OR turn IS NULL")
    links = cut(quote_links(whole))
    turns = with_previous(whole.select("conv", "turn").distinct(), ["conv"], ["turn"], ["turn"], [block("turn", 512)])
    placed = (whole.select("conv", "turn", "role", "text", "n_quotes").join(turns, ["conv", "turn"]).join(links, ["conv", "turn"], "left")
              .join(threads_of(links), "conv", "left")
              .withColumn("parent_conv", F.coalesce("from_conv", F.when(F.col("prev_turn").isNotNull(), F.col("conv"))))
              .withColumn("parent_turn", F.coalesce("from_turn", "prev_turn"))
              .withColumn("thread", F.coalesce("thread", "conv")).withColumn("linked", F.coalesce("linked", F.lit(0)).cast("long")))
    out = ["conv", "turn", "role", "text", "n_quotes", "linked", "parent_conv", "parent_turn", "thread", "position"]
    placed = with_row_number(placed.drop("from_conv", "from_turn", "prev_turn"), ["thread"], ["conv", "turn", "role", "text"], [F.col("conv"), block("turn", 512)], "position")
    alone = loose.select("conv", "turn", "role", "text", "n_quotes", F.lit(0).cast("long").alias("linked"), F.lit(None).cast("long").alias("parent_conv"),
                         F.lit(None).cast("long").alias("parent_turn"), F.col("conv").alias("thread"), F.lit(None).cast("long").alias("position"))
    return placed.select(*out).unionByName(alone.select(*out))


def conversations(linked: DataFrame, size: int = 64) -> DataFrame:
    """``thread_id, part, n_messages, n_quotes, n_linked, chat``: threads as text, at most ``size`` messages a row, so that a
    thread of any length is dealt to many tasks. Messages without a position are rows of their own, with part null."""
    line = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    rows = linked.withColumn("part", F.floor((F.col("position") - 1) / size).cast("long")).withColumn("_line", line)
    sums = [F.count(F.lit(1)).alias("n_messages"), F.sum("n_quotes").alias("n_quotes"), F.sum("linked").alias("n_linked")]
    whole = (rows.where("position IS NOT NULL").groupBy("thread", "part").agg(*sums, F.sort_array(F.collect_list(F.struct("position", "_line"))).alias("_all"))
             .select(F.col("thread").alias("thread_id"), "part", "n_messages", "n_quotes", "n_linked", F.array_join("_all._line", "").alias("chat")))
    alone = rows.where("position IS NULL").select(F.col("thread").alias("thread_id"), "part", F.lit(1).cast("long").alias("n_messages"), "n_quotes", F.col("linked").alias("n_linked"), F.col("_line").alias("chat"))
    return whole.unionByName(alone)
