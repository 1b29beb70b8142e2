"""Stratified sampling of demand points with design weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, Settings


def uniform(seed: int, key):
    """A number in (0, 1] from md5 of seed and key: the same on every engine and run."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 1) / F.lit(4294967296.0)


def quota(strata: DataFrame, slots, floor: int = 1) -> DataFrame:
    """stratum, quota of (stratum, pop, size): ``slots`` places (a number or a one-row column) shared out.

    First ``floor`` places each in order of population while they last, then each
    further place to the largest pop / (2 q + 1), q the places held, up to the
    stratum's size.  All places of a stratum are ranked at once: the divisors fall,
    so the best ``slots`` of them are what one-by-one awarding picks.  The number of
    places left is fetched first, so that each task keeps its best so many only.
    Windows here see one row a stratum.
    """
    slots = F.lit(slots) if isinstance(slots, int) else slots
    by_people = Window.orderBy(F.col("pop").desc(), "stratum")
    able = F.col("size") >= floor
    rows = strata.withColumn("__before", F.coalesce(F.sum(F.when(able, floor).otherwise(0)).over(by_people.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("__slots", slots.cast("long")).withColumn("__base", F.when(able & (F.col("__before") < F.col("__slots")), floor).otherwise(0).cast("long"))
    rows = rows.withColumn("__left", F.col("__slots") - F.sum("__base").over(Window.partitionBy()))
    most = F.least(F.col("size"), F.col("__base") + F.col("__left"))
    left = rows.agg(F.max("__left")).first()[0] or 0
    more = rows.where((F.col("pop") > 0) & (most > F.col("__base"))).select("stratum", "pop", F.explode(F.sequence(F.col("__base"), most - 1)).alias("__q"))
    more = more.select("stratum", (F.col("pop") / (2 * F.col("__q") + 1)).alias("priority"))
    best = more.orderBy(F.col("priority").desc(), "stratum").limit(max(0, left))
    won = best.groupBy("stratum").agg(F.count("*").alias("__won"))
    return rows.join(won, "stratum", "left").select("stratum", "pop", "size", (F.col("__base") + F.coalesce("__won", F.lit(0))).cast("long").alias("quota"))


def certain(universe: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """The universe with __certain: capitals and large places, the most populous ``max_demand_points`` of them at most."""
    sure = F.coalesce(F.col("is_capital"), F.lit(False)) | (F.col("population") >= conf.certainty_population)
    order = Window.partitionBy("__sure").orderBy(F.col("population").desc(), "demand_id")
    top = universe.withColumn("__sure", sure).where("__sure").withColumn("__r", F.row_number().over(order))
    kept = top.where(F.col("__r") <= conf.max_demand_points).select(F.col("demand_id").alias("__id"))
    return universe.join(kept, F.col("demand_id") == F.col("__id"), "left").withColumn("__certain", F.col("__id").isNotNull()).drop("__id")


def sample_demand(universe: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """At most ``max_demand_points`` points with design_weight, sampling_stratum and inclusion_prob.

    A universe that fits is taken whole.  Else certain points stand for themselves,
    and within district and area type points are drawn without replacement with
    probability proportional to population, by exponential keys -ln(u) / population;
    each drawn point stands for its stratum's population over its quota.
    ``inclusion_prob`` is the nominal n p, which can exceed 1.
    """
    cap = conf.max_demand_points
    rows = certain(universe, conf).withColumn("stratum", F.concat_ws("|", "ubigeo", "area_type"))
    rest = rows.where(~F.col("__certain"))
    strata = rest.groupBy("stratum").agg(F.sum("population").alias("pop"), F.count("*").alias("size"))
    counts = rows.agg(F.count("*").alias("__all"), F.count_if("__certain").alias("__sure"))
    shares = quota(strata.crossJoin(F.broadcast(counts)), cap - F.col("__sure"))
    key = -F.log(uniform(conf.seed, F.col("demand_id"))) / F.col("population")
    order = Window.partitionBy("stratum").orderBy("__key", "demand_id")
    drawn = rest.where("population > 0").withColumn("__key", key).withColumn("__r", F.row_number().over(order)).join(shares, "stratum")
    drawn = drawn.where(F.col("__r") <= F.col("quota"))
    drawn = drawn.select(
        "demand_id", (F.col("pop") / F.col("quota")).alias("design_weight"), F.col("stratum").alias("sampling_stratum"),
        (F.col("quota") * F.col("population") / F.col("pop")).alias("inclusion_prob"),
    )
    own = lambda df, name: df.select("demand_id", F.col("population").cast("double").alias("design_weight"), F.lit(name).alias("sampling_stratum"), F.lit(1.0).alias("inclusion_prob"))
    sampled = own(rows.where("__certain"), "certeza").unionByName(drawn).crossJoin(F.broadcast(counts)).where(F.col("__all") > cap)
    whole = own(rows, "censo_completo").crossJoin(F.broadcast(counts)).where(F.col("__all") <= cap)
    picked = sampled.unionByName(whole).drop("__all", "__sure")
    kept = [c for c in universe.columns if c not in ("design_weight", "sampling_stratum", "inclusion_prob")]
    return universe.select(*kept).join(picked, "demand_id")


def thin_districts(sample: DataFrame, universe: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """The sample with n_points_district, direct_pop_coverage and high_variance_district.

    A district is of high variance with few points and little of its population in
    points that are certain to be drawn.
    """
    sure = F.col("sampling_stratum").isin("certeza", "censo_completo")
    per = sample.groupBy("ubigeo").agg(F.count("*").alias("n_points_district"), F.sum(F.when(sure, F.col("population"))).alias("__sure"))
    people = universe.groupBy("ubigeo").agg(F.sum("population").alias("__all"))
    per = per.join(people, "ubigeo", "left").select(
        "ubigeo", "n_points_district", F.coalesce(F.try_divide("__sure", "__all"), F.lit(0.0)).alias("direct_pop_coverage")
    )
    few = (F.col("n_points_district") < conf.min_points_per_district) & (F.col("direct_pop_coverage") < conf.min_direct_coverage)
    return sample.join(per, "ubigeo").withColumn("high_variance_district", few)
