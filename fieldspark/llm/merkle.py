"""Merkle manifest of a dataset: a content-addressed DAG of digests, and proofs by descent from its root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldspark.llm.line_runs import LOWER, UPPER
from fieldspark.operators.ordered import with_row_number
from fieldspark.session import join_salted, scratch

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenation of texts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def sized(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(*[sized(f) for f in fields])


def placed(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """``rows`` (with ``grp``) plus ``idx``, the 0-based place in the group by ``order``, and ``n``, the group's size.

    Range partitions are the chunks, so no group is ever in one task.
    """
    spark = rows.sparkSession
    rows.repartitionByRange("grp", *order).withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    stored = spark.read.schema(rows.withColumn("_part", F.lit(0)).schema).parquet(folder)
    ranked = with_row_number(stored, ["grp"], order, [F.col("_part")], "_rank").withColumn("idx", F.col("_rank") - 1).drop("_rank", "_part")
    sizes = stored.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    return join_salted(ranked, sizes, ["grp"], ["idx"], 8, "inner")


class Dag:
    """Digest-to-children records of the trees over ``leaves`` (``grp, idx, n, digest``), one tree per group.

    Every ``fanout`` consecutive nodes of a level have one parent, until one node remains. The records of a height lie in
    ``folder/height`` and are found by digest alone; equal subtrees share one.
    """

    def __init__(self, leaves: DataFrame, folder: str, fanout: int = FANOUT):
        spark = leaves.sparkSession
        self.fanout, self.folder, self.spark = fanout, folder, spark
        nodes, height = leaves.select("grp", "idx", "n", "digest"), 0
        self.tops = nodes.where("n = 1").select("grp", "digest", F.lit(0).alias("height"))
        wide = nodes.agg(F.max("n")).first()[0] or 0
        while wide > 1:
            height, wide = height + 1, -(-wide // fanout)
            up = (nodes.where("n > 1").groupBy("grp", F.floor(F.col("idx") / fanout).cast("long").alias("up"))
                  .agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("_c"), F.first("n").alias("n")))
            up = up.select("grp", F.col("up").alias("idx"), F.ceil(F.col("n") / fanout).cast("long").alias("n"),
                           digest(F.array_join("_c.digest", "")).alias("digest"), F.col("_c.digest").alias("children"))
            up.write.parquet(f"{folder}/{height}")
            nodes = spark.read.schema(up.schema).parquet(f"{folder}/{height}")
            self.tops = self.tops.unionByName(nodes.where("n = 1").select("grp", "digest", F.lit(height).alias("height")))
        self.height = height

    def records(self, height: int) -> DataFrame:
        stored = self.spark.read.schema("digest string, children array<string>").parquet(f"{self.folder}/{height}")
        return stored.groupBy("digest").agg(F.first("children").alias("children"))

    def descend(self, starts: DataFrame, to: int = 0) -> DataFrame:
        """``grp, idx, digest, path`` of all nodes at height ``to`` below ``starts`` (``grp, digest, height, path``).

        Requests that share a prefix of rank digits share the visits to it: each record is met once per group, and a
        visit hands every child the path so far and the siblings that were not taken, left and right of it.
        """
        at = lambda h: starts.where(F.col("height") == h).select("grp", F.lit(0).cast("long").alias("idx"), "digest", "path")
        here = at(self.height)
        for height in range(self.height, to, -1):
            here = here.join(self.records(height), "digest").select("grp", "idx", "path", "children", F.posexplode("children").alias("_digit", "digest"))
            left, right = F.slice("children", F.lit(1), F.col("_digit")), F.slice("children", F.col("_digit") + 2, F.lit(self.fanout))
            step = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
            here = here.select("grp", (F.col("idx") * self.fanout + F.col("_digit")).alias("idx"), "digest", F.concat("path", F.array(step)).alias("path"))
            here = here.unionByName(at(height - 1))
        return here


def no_path() -> Column:
    return F.array().cast("array<struct<left: string, right: string>>")


def folded(leaf: Column, path: Column) -> Column:
    """Root that a leaf and its path (from the leaf upwards) lead to."""
    return F.aggregate(path, leaf, lambda acc, step: digest(step.getField("left"), acc, step.getField("right")))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple = FIELDS, text_col: str = "text",
             modulus: int = 3, folder: str | None = None) -> DataFrame:
    """``row, leaf, subroot, root, path, claimed`` of every row: its digests, its path from the leaf upwards (siblings left and
    right of it at each level) and the leaf that a reader claims to hold, altered where ``modulus`` divides the id's CRC-32.

    A group's leaves ascend by id, null first; rows of one id follow their digests, so repeated rows are neighbours with
    equal leaves. Groups ascend bytewise, null first, and their subroots form the tree above. A null field is ``-``. A
    group of one row has its leaf as subroot and no siblings; one group's subroot is the root. A changed text without
    upper-case letters stays what it was and is verified. An empty table gives an empty result. Further columns travel in
    ``row`` and enter no digest.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "merkle")
    cols = {c: F.col(c) for c in fields}
    changed = {**cols, text_col: F.translate(text_col, UPPER, LOWER)}
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 0, F.lit(False))
    leaves = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("row"), F.col(id_col).alias("id"),
                         F.coalesce(F.concat(F.lit("="), F.col(group_col)), F.lit("")).alias("grp"),
                         leaf_digest(list(cols.values())).alias("digest"),
                         F.when(hit, leaf_digest(list(changed.values()))).alias("altered"))
    leaves = placed(leaves, ["id", "digest"], f"{folder}/leaves")
    leaves.write.parquet(f"{folder}/placed")
    leaves = spark.read.schema(leaves.schema).parquet(f"{folder}/placed")
    trees = Dag(leaves, f"{folder}/trees")
    groups = placed(trees.tops.withColumnRenamed("grp", "name").withColumn("grp", F.lit("")), ["name"], f"{folder}/groups")
    groups.write.parquet(f"{folder}/subroots")
    groups = spark.read.schema(groups.schema).parquet(f"{folder}/subroots")
    above = Dag(groups, f"{folder}/above")
    root = above.tops.select("grp", F.col("digest").alias("root"))
    ways = above.descend(above.tops.withColumn("path", no_path())).select("idx", "path")
    starts = (groups.select("name", "idx", "digest", "height").join(ways, "idx")
              .select(F.col("name").alias("grp"), "digest", "height", "path"))
    starts.write.parquet(f"{folder}/starts")
    starts = spark.read.schema(starts.schema).parquet(f"{folder}/starts")
    # leaf requests of one run meet its record once, and only there does a path become one per leaf
    runs = trees.descend(starts.where("height > 0"), 1).join(trees.records(1), "digest") if trees.height else None
    step = F.struct(F.array_join(F.slice("children", F.lit(1), F.col("_digit")), "").alias("left"),
                    F.array_join(F.slice("children", F.col("_digit") + 2, F.lit(FANOUT)), "").alias("right"))
    asked = leaves.withColumn("up", F.floor(F.col("idx") / FANOUT).cast("long")).withColumn("_digit", (F.col("idx") % FANOUT).cast("int"))
    cols = ["row", "grp", "digest", "altered", "path"]
    lone = asked.where("n = 1").join(starts.where("height = 0").select("grp", "path"), "grp").select(*cols)
    found = lone if runs is None else lone.unionByName(
        asked.where("n > 1").join(runs.select("grp", F.col("idx").alias("up"), "children", "path"), ["grp", "up"])
        .withColumn("path", F.concat("path", F.array(step))).select(*cols))
    tops = groups.select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), F.lit("").alias("_all"))
    tops = tops.join(root.withColumnRenamed("grp", "_all"), "_all").drop("_all")
    return (join_salted(found, tops, ["grp"], ["digest"], 8, "inner")
            .select("row", F.col("digest").alias("leaf"), "subroot", "root", F.reverse("path").alias("path"), F.coalesce("altered", "digest").alias("claimed")))


def proofs(found: DataFrame) -> DataFrame:
    """``manifest`` rows plus ``proof`` (digest of all siblings from the leaf upwards), ``folded_root`` and ``verified``."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s.getField("left"), s.getField("right"))), "")
    return (found.withColumn("proof", digest(siblings)).withColumn("folded_root", folded(F.col("claimed"), F.col("path")))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
