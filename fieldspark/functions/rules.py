"""Rule engine: named checks become a violations column, a status and a reason.

A check that fails never drops or repairs a row. ``require`` is the eager gate: one aggregate,
then an exception that states the first reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from fieldspark.functions.text import strip


class Refused(ValueError):
    """The input cannot support the result that was asked for."""


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column                 # true where the rule is violated; null counts as not violated
    message: str
    severity: str = "error"


def check(df: DataFrame, rules: list[Rule], column: str = "violations") -> DataFrame:
    """Add ``violations`` array<struct<rule, severity, message>>, ``blocking``, ``status``, ``reason``."""
    hits = [F.when(F.coalesce(r.broken, F.lit(False)),
                   F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"),
                            F.lit(r.message).alias("message"))) for r in rules]
    out = df.withColumn(column, F.array_compact(F.array(*hits)))
    out = out.withColumn("blocking", F.exists(column, lambda v: v["severity"] == "error"))
    first = F.element_at(F.filter(column, lambda v: v["severity"] == "error"), 1)["message"]
    return (out.withColumn("status", F.when(F.col("blocking"), "refused").otherwise("ok"))
            .withColumn("reason", F.when(F.col("blocking"), first)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(~F.col("blocking")), df.where(F.col("blocking"))


def require(df: DataFrame, status: str = "status", reason: str = "reason") -> DataFrame:
    row = df.where(F.col(status) == "refused").agg(F.count(F.lit(1)).alias("n"), F.min(reason).alias("why")).first()
    if row["n"]:
        raise Refused(f"{row['n']} refused: {row['why']}")
    return df


def required(column: str) -> Rule:
    blank = strip(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""
    return Rule(f"{column}_required", blank, f"{column} is required")


def in_range(column: str, lo: float, hi: float, severity: str = "error") -> Rule:
    value = F.col(column).cast("double")
    return Rule(f"{column}_range", F.isnan(value) | (value < lo) | (value > hi), f"{column} must be between {lo} and {hi}", severity)


def one_of(column: str, values: list[str], severity: str = "error") -> Rule:
    return Rule(f"{column}_choice", ~F.col(column).isin(*values) | F.col(column).isNull(),
                f"{column} must be one of {', '.join(values)}", severity)
