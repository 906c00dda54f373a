"""Ordered computations over groups of any size.

A plain ``Window.partitionBy(key)`` sends one key to one task. Here every group is cut into
consecutive chunks by ``chunk`` expressions that never decrease along the order (an hour of a
timestamp, a block of a sequence number). Windows run inside ``(key, chunk)``; what crosses a
chunk border travels in a summary of one row per chunk. Results equal the undivided window.

Key columns must not be null: give a missing key a name of its own first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def time_chunk(ts: str, seconds: int = 3600) -> Column:
    """Chunk number of a timestamp column."""
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)).cast("long")


def block(col: str | Column, width: float) -> Column:
    """Chunk number of a numeric column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(width)).cast("long")


def _chunked(df: DataFrame, chunk: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_k{i}" for i in range(len(chunk))]
    for name, expr in zip(names, chunk):
        df = df.withColumn(name, expr)
    return df, names


def with_previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str], chunk: list[Column],
                  prefix: str = "prev_") -> DataFrame:
    """Add ``prefix + col`` holding the value on the previous row of the group."""
    df, names = _chunked(df, chunk)
    inner = W.partitionBy(*keys, *names).orderBy(*order)
    tails = (df.groupBy(*keys, *names)
             .agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_tail"))
             .withColumn("_before", F.lag("_tail").over(W.partitionBy(*keys).orderBy(*names)))
             .drop("_tail"))
    out = (df.withColumn("_prev", F.lag(F.struct(*cols)).over(inner))
           .join(tails, keys + names, "left")
           .withColumn("_prev", F.coalesce("_prev", "_before")))
    for c in cols:
        out = out.withColumn(prefix + c, F.col(f"_prev.{c}"))
    return out.drop("_prev", "_before", *names)


def with_row_number(df: DataFrame, keys: list[str], order: list[Column | str], chunk: list[Column],
                    name: str = "rn") -> DataFrame:
    """Exact 1-based position in the group. ``chunk`` must sort like ``order`` (ascending)."""
    df, names = _chunked(df, chunk)
    before = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    sizes = (df.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__n"))
             .withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    inner = W.partitionBy(*keys, *names).orderBy(*order)
    return (df.withColumn("__rn", F.row_number().over(inner))
            .join(sizes, keys + names, "left")
            .withColumn(name, (F.col("__rn") + F.col("__off")).cast("long"))
            .drop("__rn", "__off", *names))


def carry(df: DataFrame, keys: list[str], order: list[str], chunk: list[Column],
          back: dict[str, str], forward: dict[str, str], running: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """Last non-null value at or before (``back``), first at or after (``forward``) each row,
    and running non-null counts (``running``). Mappings are ``new name -> source column``.
    The sweep runs in ``parts`` tasks if given: Spark's choice goes by bytes, and rows grow when they are decoded.

    Looking forward is looking back in the opposite order: a frame that runs to the end of its
    partition would be recomputed for every row.
    """
    running = running or {}
    df, names = _chunked(df, chunk)
    df = df.repartition(parts, *keys, *names) if parts else df
    inner = W.partitionBy(*keys, *names).orderBy(*order)
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    onward = W.partitionBy(*keys, *names).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    for new, src in back.items():
        df = df.withColumn(new, F.last(src, ignorenulls=True).over(upto))
    for new, src in forward.items():
        df = df.withColumn(new, F.last(src, ignorenulls=True).over(onward))
    for new, src in running.items():
        df = df.withColumn(new, F.count(src).over(upto))
    # the carried columns are complete on the last (back) / first (forward) row of the chunk
    edge = (df.withColumn("_first", F.row_number().over(inner) == 1)
            .withColumn("_last", F.lead(F.lit(1)).over(inner).isNull()))
    aggs = [F.first(F.when(F.col("_last"), F.col(new)), ignorenulls=True).alias(f"_b_{new}") for new in back]
    aggs += [F.first(F.when(F.col("_first"), F.col(new)), ignorenulls=True).alias(f"_f_{new}") for new in forward]
    aggs += [F.max(new).alias(f"_c_{new}") for new in running]
    border = edge.groupBy(*keys, *names).agg(*aggs)
    border = border.repartition(parts, *keys) if parts else border
    prior = W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)
    later = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in names]).rowsBetween(W.unboundedPreceding, -1)
    keep = []
    for new in back:
        keep.append(F.last(f"_b_{new}", ignorenulls=True).over(prior).alias(f"_pb_{new}"))
    for new in forward:
        keep.append(F.last(f"_f_{new}", ignorenulls=True).over(later).alias(f"_pf_{new}"))
    for new in running:
        keep.append(F.coalesce(F.sum(f"_c_{new}").over(prior), F.lit(0)).alias(f"_pc_{new}"))
    border = border.select(*keys, *names, *keep)
    out = df.join(border, keys + names, "left")
    for new in back:
        out = out.withColumn(new, F.coalesce(new, f"_pb_{new}")).drop(f"_pb_{new}")
    for new in forward:
        out = out.withColumn(new, F.coalesce(new, f"_pf_{new}")).drop(f"_pf_{new}")
    for new in running:
        out = out.withColumn(new, F.col(new) + F.col(f"_pc_{new}")).drop(f"_pc_{new}")
    return out.drop(*names)


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], kind: str = "linear", margin: float = 5e-4) -> DataFrame:
    """``quantiles_of`` of one column."""
    return quantiles_of(df, keys, {name: (value, p) for name, p in probs.items()}, kind, margin)


def quantiles_of(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], kind: str = "linear", margin: float = 5e-4) -> DataFrame:
    """Exact quantiles of groups of any size: one row per group, one column per entry ``name: (column, p)`` of ``wanted``.

    ``kind`` is ``linear`` (interpolated) or ``upper`` (element ``floor(p * n)`` of the sorted list; ``p=0.5`` is the upper
    median). Nulls and NaN are missing; infinities are the ends of the order, and meet no other value in an interpolation
    of weight 0. A group without values has null, one whose columns are all missing no row.

    Three passes over the rows, all columns in each, and no action: a sketch gives two splitters around each quantile; the
    rows below and between them are counted and the rows between sketched again; what lies in the few hundredths of these
    around the rank is grouped by value and ordered. Counts decide where a rank lies, so a sketch only bears on how many
    values are ordered, about ``margin / 15`` of a group.
    """
    names = list(wanted)
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    columns = sorted({c for c, _ in wanted.values()})
    vs = {c: f"_v{i}" for i, c in enumerate(columns)}
    rows = df.select(*keys, *[real(c).alias(v) for c, v in vs.items()]).where(F.coalesce(*vs.values()).isNotNull())
    of = {name: vs[c] for name, (c, _) in wanted.items()}
    low, high = (lambda p: max(0.0, p - margin)), (lambda p: min(1.0, p + margin))
    first = rows.groupBy(*keys).agg(
        *[F.count(v).alias(f"_n{v}") for v in vs.values()],
        *[F.percentile_approx(of[n], [low(p), high(p)], 10_000).alias(f"_s_{n}") for n, (_, p) in wanted.items()])
    ends = []
    for name, (_, p) in wanted.items():
        n = F.col(f"_n{of[name]}")
        at = (n - 1) * F.lit(float(p)) if kind == "linear" else F.least(F.floor(n * F.lit(float(p))), n - 1).cast("double")
        ends += [F.floor(at).cast("long").alias(f"_r_{name}"), F.ceil(at).cast("long").alias(f"_q_{name}"), (at - F.floor(at)).alias(f"_f_{name}"),
                 F.get(f"_s_{name}", F.lit(0)).alias(f"_a_{name}"), F.get(f"_s_{name}", F.lit(1)).alias(f"_b_{name}")]
    first = first.select(*keys, *ends)
    # pass two: exact counts around the splitters, and a sketch of what lies between
    seen = join_side(rows, first, keys)
    between = lambda n: (F.col(of[n]) >= F.col(f"_a_{n}")) & (F.col(of[n]) <= F.col(f"_b_{n}"))
    grid = [k / 100 for k in range(101)]
    counts = []
    for n in names:
        counts += [F.count_if(F.col(of[n]) < F.col(f"_a_{n}")).alias(f"_lo_{n}"), F.count_if(F.col(of[n]) < F.col(f"_b_{n}")).alias(f"_lt_{n}"),
                   F.count_if(F.col(of[n]) <= F.col(f"_b_{n}")).alias(f"_le_{n}"), F.percentile_approx(F.when(between(n), F.col(of[n])), grid, 1_000).alias(f"_g_{n}")]
    second = seen.groupBy(*keys).agg(*counts, *[F.first(c).alias(c) for c in first.columns if c not in keys])
    inf, spans = F.lit(float("inf")), []
    for n in names:
        r, q, a, b = (F.col(f"_{x}_{n}") for x in "rqab")
        lo, lt, le = (F.col(f"_{x}_{n}") for x in ("lo", "lt", "le"))
        left = F.when(r < lo, -inf).when(r >= le, b).otherwise(a)
        right = F.when(q >= le, inf).when(q < lo, a).otherwise(b)
        base = F.when(r < lo, F.lit(0).cast("long")).when(r >= le, lt).otherwise(lo)
        usual = (r >= lo) & (q < le)
        place = lambda x: F.floor((x - lo) * 100 / F.greatest(F.lit(1), le - lo)).cast("int")
        # the sketch of the middle may be off by a tenth of a step; two steps on either side are kept
        down, up = F.get(f"_g_{n}", place(r) - 2), F.get(f"_g_{n}", place(q) + 3)
        spans.append(F.struct(F.lit(n).alias("name"), left.alias("left"), right.alias("right"), base.alias("base"), r.alias("r"), q.alias("q"), F.col(f"_f_{n}").alias("f"),
                              F.when(usual, F.coalesce(down, a)).otherwise(left).alias("down"), F.when(usual, F.coalesce(up, b)).otherwise(right).alias("up")))
    spans = second.select(*keys, F.array(*spans).alias("_spans"))
    # pass three: values around the rank; what lies between the splitters but farther off is only counted
    value = F.array(*[F.struct(F.lit(n).alias("name"), F.col(of[n]).alias("v")) for n in names])
    listed = (join_side(rows, spans, keys).withColumn("_x", F.explode(F.arrays_zip(F.col("_spans").alias("s"), value.alias("x")))).select(*keys, F.col("_x.s").alias("s"), F.col("_x.x.v").alias("v"))
              .where("v >= s.left AND v <= s.right AND v <= s.up"))
    listed = listed.select(*keys, "s", F.when(F.col("v") >= F.col("s.down"), F.col("v")).alias("v"))  # null: before all that are ordered
    order = W.partitionBy(*keys, "s.name").orderBy(F.col("v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    tied = (listed.groupBy(*keys, "s", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("end", F.col("s.base") + F.sum("c").over(order))
            .withColumn("start", F.col("end") - F.col("c")))
    hit = lambda rank: (F.col(f"s.{rank}") >= F.col("start")) & (F.col(f"s.{rank}") < F.col("end"))
    got = tied.groupBy(*keys, F.col("s.name").alias("name"), F.col("s.f").alias("f")).agg(
        F.max(F.when(hit("r"), F.col("v"))).alias("v0"), F.max(F.when(hit("q"), F.col("v"))).alias("v1"))
    missed = F.raise_error(F.lit("a quantile lies outside the values that were ordered"))
    mixed = F.when(F.col("v0").isNull() | F.col("v1").isNull(), missed.cast("double")).when((F.col("f") == 0) | (F.col("v0") == F.col("v1")), F.col("v0")).otherwise(
        F.col("v0") * (1 - F.col("f")) + F.col("v1") * F.col("f"))
    return got.withColumn("q", mixed).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in names])


def join_side(rows: DataFrame, side: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Attach one row per key to rows whose key may be hot (salted by the row's own content).

    Sorted and merged: of two sides that look small, an inner join may broadcast the rows.
    """
    from fieldspark.session import join_salted, sorted_side
    others = [c for c in rows.columns if c not in keys] or keys
    return join_salted(rows, sorted_side(side), keys, others, salts, "inner")


def top_mean(df: DataFrame, keys: list[str], score: str, k_of_n: Column, name: str) -> DataFrame:
    """Mean of the k largest scores per group; ``k_of_n`` is an expression over the column ``n``.

    Works on counts per distinct score, so it never sorts the rows of a group. Meant for scores
    rounded to a fixed number of decimals, whose distinct values are bounded.
    """
    counts = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("_c"))
    above = W.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    take = F.greatest(F.lit(0), F.least(F.col("_c"), F.col("_k") - F.coalesce(F.col("_above"), F.lit(0))))
    return (counts.withColumn("n", F.sum("_c").over(whole)).withColumn("_k", k_of_n)
            .withColumn("_above", F.sum("_c").over(above)).withColumn("_take", take)
            .groupBy(*keys).agg(F.sum("_c").alias("n"),
                                (F.sum(F.col(score) * F.col("_take")) / F.sum("_take")).alias(name)))
