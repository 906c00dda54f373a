"""Line dedup: document counts of line hashes in levelled, sorted, bucketed runs that are compacted as they pile up."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldspark.session import join_salted, scratch

#: fixed values: what is stripped at both ends of a line, and the letters that are folded
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FP = ["fp1", "fp2"]
TEXT = ["t1", "t2"]
STATE = "version long, name string, level int, path string, batches array<string>, buckets int"


def lines(text: Column) -> Column:
    """The lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def fingerprint(value: Column, names: list[str]) -> Column:
    """128 bits in two columns."""
    return F.struct(F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(7), value).alias(names[1]))


def line_hashes(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """``t1, t2, copies, keys``: each different text once, with the fingerprints of its lines in order (null: key shorter
    than ``min_chars``) and the number of rows that hold it."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= min_chars, fingerprint(key, FP))

    one = docs.select(fingerprint(text, TEXT).alias("_t"), F.transform(lines(F.col(text_col)), hashed).alias("keys"))
    return (one.groupBy(F.col("_t.t1").alias("t1"), F.col("_t.t2").alias("t2"))
            .agg(F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")))


@dataclass
class Run:
    name: str
    level: int
    path: str
    batches: list[str]


class LineRuns:
    """Runs of ``fp1, fp2, docs`` in ``folder``: how many documents hold a line.

    A batch's counts are anti-joined with the lines that any run holds as settled (``docs >= min_docs``), and what is left
    becomes a run of level 0. ``fan`` runs of a level are merged, by adding counts, into one of the next level, so a line
    is rewritten once per level and settled lines never again. A run is bucketed and sorted by fingerprint: the anti-join
    reads it where it lies. Every state is committed as a whole after its run; a batch whose name a committed run holds is
    not added again, so a job that was ended can be started anew on the same folder.
    """

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = 10, fan: int = 2, buckets: int | None = None):
        self.spark, self.folder, self.min_docs, self.fan = spark, folder, min_docs, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs, self.version = [], 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str, min_docs: int = 10, fan: int = 2) -> LineRuns:
        """The runs that the latest committed state of ``folder`` names."""
        state = spark.read.schema(STATE).parquet(f"{folder}/state")
        latest = state.join(state.agg(F.max("version").alias("version")), "version").collect()  # one row per run
        store = cls(spark, folder, min_docs, fan, latest[0]["buckets"])
        store.version = latest[0]["version"]
        for row in latest:
            name = f"run_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} (fp1 BIGINT, fp2 BIGINT, docs BIGINT) USING parquet CLUSTERED BY (fp1, fp2) "
                      f"SORTED BY (fp1, fp2) INTO {store.buckets} BUCKETS LOCATION '{row['path']}'")
            store.runs.append(Run(name, row["level"], row["path"], row["batches"]))
        return store

    def _write(self, rows: DataFrame, level: int, batches: list[str], replaced: list[Run] = ()) -> None:
        name = f"run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        (rows.select(*FP, "docs").write.format("parquet").bucketBy(self.buckets, *FP).sortBy(*FP).option("path", path).saveAsTable(name))
        self.runs = [r for r in self.runs if r not in replaced] + [Run(name, level, path, batches)]
        self.version += 1
        state = [(self.version, r.name, r.level, r.path, r.batches, self.buckets) for r in self.runs]
        self.spark.createDataFrame(state, STATE).coalesce(1).write.mode("append").parquet(f"{self.folder}/state")
        for run in replaced:
            self.spark.sql(f"DROP TABLE IF EXISTS {run.name}")

    def settled(self, run: Run) -> DataFrame:
        return self.spark.table(run.name).where(F.col("docs") >= self.min_docs).select(*FP)

    def add(self, hashes: DataFrame, batch: str) -> None:
        """Count the lines of a batch (rows of ``line_hashes``)."""
        if any(batch in r.batches for r in self.runs):
            return
        fresh = (hashes.select("copies", F.explode(F.array_distinct("keys")).alias("_k")).where("_k IS NOT NULL")
                 .groupBy(F.col("_k.fp1").alias("fp1"), F.col("_k.fp2").alias("fp2")).agg(F.sum("copies").alias("docs")))
        for run in self.runs:
            fresh = fresh.join(self.settled(run), FP, "left_anti")
        self._write(fresh, 0, [batch])
        self.compact()

    def merged(self, runs: list[Run]) -> DataFrame:
        """Merge joins of sorted runs; two of them need no shuffle."""
        rows = self.spark.table(runs[0].name)
        for run in runs[1:]:
            other = self.spark.table(run.name).withColumnRenamed("docs", "_docs")
            rows = rows.join(other, FP, "full").select(*FP, (F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))).alias("docs"))
        return rows

    def compact(self, whole: bool = False) -> None:
        """Merge every level that holds ``fan`` runs, or all runs into one."""
        if whole and len(self.runs) > 1:
            self._write(self.merged(self.runs), max(r.level for r in self.runs) + 1, sum((r.batches for r in self.runs), []), list(self.runs))
        level = 0
        while not whole and level <= max(r.level for r in self.runs):
            full = [r for r in self.runs if r.level == level]
            if len(full) >= self.fan:
                self._write(self.merged(full), level + 1, sum((r.batches for r in full), []), full)
            level += 1

    def frequent(self) -> DataFrame:
        """``fp1, fp2`` of the lines that at least ``min_docs`` documents of all batches hold."""
        self.compact(whole=True)
        return self.settled(self.runs[0])


def drop_lines(docs: DataFrame, hashes: DataFrame, frequent: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, n_lines, n_dropped, kept``: every row of ``docs`` and its text without the frequent lines.

    Each different text meets the frequent lines once. A line may be in most texts and a text in many rows, so both joins
    are salted.
    """
    listed = hashes.select(*TEXT, F.posexplode("keys").alias("pos", "_k")).select(*TEXT, "pos", "_k.fp1", "_k.fp2")
    marked = join_salted(listed.where("fp1 IS NOT NULL"), frequent.withColumn("gone", F.lit(True)), FP, [*TEXT, "pos"], 8)
    marked = marked.select(*TEXT, "pos", F.coalesce("gone", F.lit(False)).alias("gone")).unionByName(
        listed.where("fp1 IS NULL").select(*TEXT, "pos", F.lit(False).alias("gone")))
    flags = (marked.groupBy(*TEXT).agg(F.sort_array(F.collect_list(F.struct("pos", "gone"))).alias("_f"), F.max("gone").alias("_any"))
             .where("_any").select(*TEXT, F.col("_f.gone").alias("_gone")))
    rows = (docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
            .withColumn("_t", fingerprint(F.coalesce(F.col("row").getField(text_col), F.lit("")), TEXT))
            .select("row", "_t.t1", "_t.t2", F.xxhash64(*[F.col("row").getField(c) for c in docs.columns if c != text_col]).alias("_id")))
    text = lines(F.col("row").getField(text_col))
    kept = F.filter(F.zip_with(text, "_gone", lambda line, gone: F.when(~gone, line)), lambda line: line.isNotNull())
    return (join_salted(rows, flags, TEXT, ["_id"], 8)
            .select("row", F.size(text).cast("long").alias("n_lines"),
                    F.coalesce(F.size(F.filter("_gone", lambda gone: gone)), F.lit(0)).cast("long").alias("n_dropped"),
                    F.when(F.col("_gone").isNull(), F.coalesce(F.col("row").getField(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, min_docs: int = 10,
               batches: int = 4, fan: int = 2, folder: str | None = None) -> DataFrame:
    """Lines whose key at least ``min_docs`` rows of ``docs`` hold lose all their lines in every row; see ``drop_lines``.

    A key is the line without blanks at its ends, A-Z lower-cased; keys of fewer than ``min_chars`` code points stay. Texts
    are hashed once and dealt by hash into ``batches``, which enter ``LineRuns`` one after another. Every row is a
    document: rows that share an id, or repeat one another, count each. A null text is an empty line and stays one. A text
    that loses all lines becomes empty. An empty table gives an empty result; further columns travel in ``row``.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "lines")
    line_hashes(docs, text_col, min_chars).withColumn("batch", F.pmod("t1", F.lit(batches)).cast("int")).write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/hashes")
    hashes = spark.read.schema("t1 long, t2 long, copies long, keys array<struct<fp1: long, fp2: long>>, batch int").parquet(f"{folder}/hashes")
    runs = LineRuns(spark, f"{folder}/runs", min_docs, fan)
    for number in range(batches):
        runs.add(hashes.where(F.col("batch") == number), str(number))
    return drop_lines(docs, hashes, runs.frequent(), id_col, text_col)
