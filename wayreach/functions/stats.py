"""Weighted statistics by group.

Rows count where value and weight are not null and the weight is over 0.  Order
statistics need running sums in order of the value.  Groups may be cut into value
ranges first, at approximate quantiles: running sums then work within a range and
start from the sums of the ranges before it, so a group of any size (the whole
country) is no single task's work.  How many ranges goes by the size of the rows;
``spread`` is the number where that is unknown, and ``spread=1`` is for groups that
are known to be small (districts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of rows, as files hold them, that a value range aims at, and the most ranges.
RANGE_BYTES, MOST_RANGES = 16 << 20, 1024


def ranges(df: DataFrame, unknown: int) -> int:
    """Value ranges to cut ``df`` into by its size; ``unknown`` where the optimizer has no good estimate (joins multiply)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size >= 1 << 60 or "Join" in str(plan.toString()):
        return unknown
    return min(MOST_RANGES, -(-size // RANGE_BYTES))


def counted(value: Column, weight: Column) -> Column:
    return F.coalesce(value.isNotNull() & (weight > 0), F.lit(False))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null where no row counts."""
    ok = counted(value, weight)
    return F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight)))


def share(test: Column, weight: Column) -> Column:
    """The part of all weight where ``test`` holds; null tests don't hold."""
    return F.try_divide(F.sum(F.when(test, weight).otherwise(F.lit(0.0))), F.sum(weight))


def running(df: DataFrame, keys: list[str], value: str, weight: str, tie: str, spread: int = 1) -> DataFrame:
    """Counted rows with __v, __w, and running sums up to and with the row in order of value and ``tie``.

    Adds __cw and __cvw (weight, value times weight), __tw and __tvw (the group's
    sums), __n (its rows), __pv and __pc (value and running weight of the row before).
    """
    rows = df.where(counted(F.col(value), F.col(weight))).select(
        *keys, F.col(value).cast("double").alias("__v"), F.col(weight).cast("double").alias("__w"), F.col(tie).alias("__tie")
    )
    spread = spread if spread <= 1 else ranges(df, spread)
    totals = [F.sum("__w").alias("__tw"), F.sum(F.col("__v") * F.col("__w")).alias("__tvw"), F.count("*").alias("__n")]
    if spread <= 1:
        whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__v", "__tie")
        upto = order.rowsBetween(Window.unboundedPreceding, 0)
        out = rows.withColumns({"__cw": F.sum("__w").over(upto), "__cvw": F.sum(F.col("__v") * F.col("__w")).over(upto)})
        out = out.withColumns({"__pv": F.lag("__v").over(order), "__pc": F.lag("__cw").over(order)})
        return out.withColumns(
            {
                "__tw": F.sum("__w").over(whole),
                "__tvw": F.sum(F.col("__v") * F.col("__w")).over(whole),
                "__n": F.count("*").over(whole),
            }
        )
    keyed = rows.withColumn("__one", F.lit(1))
    group = [*keys, "__one"]
    cuts = F.percentile_approx("__v", [i / spread for i in range(1, spread)], 100 * spread).alias("__cuts")
    per_group = keyed.groupBy(*group).agg(cuts, *totals)
    keyed = _join_null_safe(keyed, per_group, group)
    keyed = keyed.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    sums = keyed.groupBy(*group, "__range").agg(
        F.sum("__w").alias("__rw"), F.sum(F.col("__v") * F.col("__w")).alias("__rvw"), F.max(F.struct("__v", "__tie")).alias("__last")
    )
    before = Window.partitionBy(*group).orderBy("__range")  # at most `spread` rows a group
    upto = before.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *group, "__range", F.coalesce(F.sum("__rw").over(upto), F.lit(0.0)).alias("__bw"),
        F.coalesce(F.sum("__rvw").over(upto), F.lit(0.0)).alias("__bvw"), F.lag("__last").over(before)["__v"].alias("__bv"),
    )
    keyed = _join_null_safe(keyed, sums, [*group, "__range"])
    order = Window.partitionBy(*group, "__range").orderBy("__v", "__tie")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumns(
        {
            "__cw": F.col("__bw") + F.sum("__w").over(upto),
            "__cvw": F.col("__bvw") + F.sum(F.col("__v") * F.col("__w")).over(upto),
        }
    )
    first = F.row_number().over(order) == 1
    return out.withColumns(
        {
            "__pv": F.when(first, F.col("__bv")).otherwise(F.lag("__v").over(order)),
            "__pc": F.when(first, F.when(F.col("__bv").isNotNull(), F.col("__bw"))).otherwise(F.lag("__cw").over(order)),
        }
    ).drop("__one", "__range", "__bw", "__bvw", "__bv")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys where null meets null; the keys come out once."""
    other = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return left.join(other, on).drop(*[f"__k_{k}" for k in keys])


def quantile(q: float) -> Column:
    """Aggregate over :func:`running` rows: linear interpolation of value over running weight, no lower than the first value."""
    at = F.lit(float(q)) * F.col("__tw")
    between = F.col("__pv") + (at - F.col("__pc")) / (F.col("__cw") - F.col("__pc")) * (F.col("__v") - F.col("__pv"))
    value = F.when(F.col("__pv").isNull(), F.col("__v")).otherwise(between)
    return F.coalesce(F.min_by(F.when(F.col("__cw") >= at, value), F.when(F.col("__cw") >= at, F.col("__cw"))), F.max("__v"))


def gini() -> Column:
    """Aggregate over :func:`running` rows without negative values; null under two rows or without any value."""
    area = F.sum(F.col("__w") * (F.col("__cvw") - F.col("__v") * F.col("__w") / 2))
    return F.when((F.count("*") >= 2) & (F.max("__tvw") > 0), 1 - 2 * area / (F.max("__tw") * F.max("__tvw")))


def ordered(df: DataFrame, keys: list[str], value: str, weight: str, tie: str, quantiles: dict, gini_name: str | None = None, spread: int = 1) -> DataFrame:
    """The keys with named weighted quantiles and, by name, the Gini index of the non-negative values."""
    rows = running(df, keys, value, weight, tie, spread)
    out = rows.groupBy(*keys).agg(*[quantile(q).alias(n) for n, q in quantiles.items()], *([gini().alias(gini_name)] if gini_name else []), F.min("__v").alias("__least"))
    if gini_name:
        # Where a group has negative values these stay out of its Gini index alone.
        out = out.withColumn(gini_name, F.when(F.col("__least") >= 0, F.col(gini_name)))
    return out.drop("__least")


def percentiles(df: DataFrame, keys: list[str], value: str, tie: str, quantiles: dict, spread: int = 32) -> DataFrame:
    """The keys with exact unweighted percentiles by name, interpolated between ranks; null values don't count.

    No task sees a group whole: ranks come from :func:`running` with weights of 1.
    """
    rows = running(df.withColumn("__even", F.lit(1.0)), keys, value, "__even", tie, spread)

    def at(q):
        place = F.lit(float(q)) * (F.max("__tw") - 1)
        v = lambda rank: F.max(F.when(F.col("__cw") == rank, F.col("__v")))
        lo = F.floor(F.lit(float(q)) * (F.col("__tw") - 1))
        below, above = v(lo + 1), v(F.least(lo + 2, F.col("__tw")))
        return below + (place - F.floor(place)) * (above - below)

    return rows.groupBy(*keys).agg(*[at(q).alias(n) for n, q in quantiles.items()])


def lorenz(df: DataFrame, value: str, weight: str, tie: str, n: int = 101, spread: int = 64) -> DataFrame:
    """share_poblacion, share_tiempo_acumulado at ``n`` even steps: running shares from (0, 0), interpolated.

    A row answers for the grid points between the running share before it and its own.
    """
    rows = running(df, [], value, weight, tie, spread)
    rows = rows.select(
        (F.coalesce("__pc", F.lit(0.0)) / F.col("__tw")).alias("p0"), (F.col("__cw") / F.col("__tw")).alias("p1"),
        ((F.col("__cvw") - F.col("__v") * F.col("__w")) / F.col("__tvw")).alias("l0"), (F.col("__cvw") / F.col("__tvw")).alias("l1"),
    )
    last = n - 1
    lo, hi = F.greatest(F.lit(0), F.floor(F.col("p0") * last).cast("int") - 1), F.least(F.lit(last), F.ceil(F.col("p1") * last).cast("int") + 1)
    grid = rows.select("*", F.explode(F.sequence(lo, hi)).alias("i")).withColumn("g", F.col("i") / last)
    inside = (F.col("g") <= F.col("p1")) & (F.col("g") > F.col("p0"))
    value_at = F.col("l0") + (F.col("g") - F.col("p0")) / (F.col("p1") - F.col("p0")) * (F.col("l1") - F.col("l0"))
    found = grid.where(inside).groupBy("i").agg(F.min(value_at).alias("y"))
    steps = df.sparkSession.range(n).select(F.col("id").cast("int").alias("i"))
    y = F.when(F.col("i") == 0, 0.0).otherwise(F.coalesce("y", F.lit(1.0)))
    return steps.join(found, "i", "left").select((F.col("i") / last).alias("share_poblacion"), y.alias("share_tiempo_acumulado"))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """The keys and rho: Pearson correlation of average ranks of the rows where both are known."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c, r in ((a, "__ra"), (b, "__rb")):
        ties = Window.partitionBy(*keys, c)
        rows = rows.withColumn(r, F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(ties) - 1) / 2)
    return rows.groupBy(*keys).agg(F.corr("__ra", "__rb").alias("rho"))


def rank_desc(x: Column) -> Column:
    """Competition rank from the largest; null stays null."""
    return F.when(x.isNotNull(), F.rank().over(Window.orderBy(x.desc_nulls_last())).cast("double"))


def ecdf(df: DataFrame, keys: list[str], value: str, weight: str, tie: str, spread: int = 32) -> DataFrame:
    """The keys, value and the group's running share of weight at each counted row."""
    rows = running(df, keys, value, weight, tie, spread)
    return rows.select(*keys, F.col("__v").alias(value), (F.col("__cw") / F.col("__tw")).alias("share_acumulada"))
