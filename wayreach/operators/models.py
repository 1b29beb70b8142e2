"""Planning models: capacity-aware accessibility, coverage scenarios, greedy maximal coverage."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, Settings
from ..functions import stats as S
from ..plans.lineage import cut
from .od import small_side

#: Pairs of a greedy cover that the driver searches itself, some 50 MB.
LOCAL_POOL = 2_000_000
PLACE = ("ubigeo", "department", "province", "district", "area_type", "natural_region", "design_weight", "t_min")


def catchment_weight(minutes, conf: Settings = DEFAULT):
    """1 within the catchment, or a bell curve that falls to 0.05 at its edge; 0 beyond it and without a route."""
    d0 = conf.catchment_minutes
    if conf.decay == "gaussian":
        sigma = d0 / math.sqrt(2.0 * math.log(20.0))
        w = F.exp(F.lit(-0.5) * (minutes / sigma) * (minutes / sigma))
    else:
        w = F.lit(1.0)
    return F.when(F.coalesce(minutes <= d0, F.lit(False)), w).otherwise(F.lit(0.0))


def capacity(category, conf: Settings = DEFAULT):
    """Beds by category, the median of the table for others."""
    known = sorted(conf.capacity.values())
    mid = len(known) // 2
    median = float(known[mid]) if len(known) % 2 else (known[mid - 1] + known[mid]) / 2
    table = F.create_map(*[x for k, v in conf.capacity.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(table, category), F.lit(median))


def sfca_points(access: DataFrame, od: DataFrame, facilities: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """Two-step floating catchment by point: index, index per 10,000 and facilities within reach.

    Pairs are streamed into both steps, never kept or sorted: weights are joined by
    hash where the pairs are, by demand_id, and the facilities' ratios come from a
    small table.  Facilities that nobody reaches add nothing.
    """
    near = od.where(F.col("minutes") <= conf.catchment_minutes).select("demand_id", "facility_id", catchment_weight(F.col("minutes"), conf).alias("w"))
    near = near.join(access.select("demand_id", "design_weight").hint("shuffle_hash"), "demand_id")
    supply = small_side(facilities.select("facility_id", capacity(F.col("category"), conf).alias("s")))
    need = near.groupBy("facility_id").agg(F.sum(F.col("w") * F.col("design_weight")).alias("need")).join(supply, "facility_id")
    ratio = need.select("facility_id", F.when(F.col("need") > 0, F.col("s") / F.col("need")).otherwise(0.0).alias("ratio"))
    index = near.join(small_side(cut(ratio)), "facility_id").groupBy("demand_id").agg(
        F.sum(F.col("w") * F.col("ratio")).alias("sfca_index"), F.count_if(F.col("w") > 0).alias("n_facilities_in_catchment")
    )
    out = access.select("demand_id", *PLACE).join(index, "demand_id", "left").fillna(0, ["sfca_index", "n_facilities_in_catchment"])
    return out.withColumn("sfca_index_per_10k", F.col("sfca_index") * 10000)


def sfca_districts(points: DataFrame) -> DataFrame:
    """By district: population, weighted index, weighted time (unreached points at the district's longest), median count."""
    keys = ["department", "province", "district", "ubigeo"]
    rows = points.dropna(subset=keys)
    longest = rows.groupBy(*keys).agg(F.max("t_min").alias("__longest"))
    rows = rows.join(longest, keys)
    w, t = F.col("design_weight"), F.coalesce("t_min", "__longest")
    return rows.groupBy(*keys).agg(
        F.sum(w).alias("poblacion"),
        F.try_divide(F.sum(F.col("sfca_index_per_10k") * w), F.sum(w)).alias("sfca_index_per_10k"),
        F.try_divide(F.sum(t * w), F.sum(w)).alias("t_medio_min"),
        F.percentile("n_facilities_in_catchment", 0.5).alias("n_facilities_in_catchment"),
    )


def sfca_summary(districts: DataFrame) -> DataFrame:
    """One row: districts, those without a facility within reach, rho of index and time."""
    counts = districts.agg(F.count("*").alias("n_distritos"), F.count_if(F.col("n_facilities_in_catchment") == 0).alias("n_sin_cobertura"))
    rho = S.spearman(districts, [], "sfca_index_per_10k", "t_medio_min").select(F.round("rho", 4).alias("spearman_sfca_vs_tiempo"))
    return counts.crossJoin(F.broadcast(rho))  # one row each


def scenario_times(access: DataFrame, candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """demand_id, design_weight, t_base, t_new: the base time or a selected candidate's, whichever is less."""
    best = candidates.join(small_side(selected.select("facility_id").distinct()), "facility_id", "left_semi")
    best = best.groupBy("demand_id").agg(F.min("minutes").alias("__best"))
    rows = access.select("demand_id", "design_weight", F.col("t_min").alias("t_base")).join(best, "demand_id", "left")
    return rows.withColumn("t_new", F.least("t_base", "__best")).drop("__best")


def coverage(access: DataFrame, candidates: DataFrame, selected: DataFrame, threshold: float) -> DataFrame:
    """One row: population covered, its share, mean time, number selected, and the time up to which this is exact."""
    times = scenario_times(access, candidates, selected)
    w = F.col("design_weight")
    main = times.agg(
        F.sum(F.when(F.col("t_new") <= threshold, w).otherwise(0.0)).alias("poblacion_cubierta"),
        S.share(F.col("t_new") <= threshold, w).alias("share_cubierta"),
        S.weighted_mean(F.col("t_new"), w).alias("t_medio_min"),
    )
    chosen = selected.agg(F.count_distinct("facility_id").alias("n_seleccionados"))
    edge = candidates.groupBy("demand_id").agg(F.max("minutes").alias("m")).agg(F.min("m").alias("edge"))
    one = main.crossJoin(F.broadcast(chosen)).crossJoin(F.broadcast(edge))  # one row each
    exact = F.when((F.col("n_seleccionados") > 0) & F.col("edge").isNotNull(), F.col("edge")).otherwise(F.lit(float("inf")))
    return one.withColumn("exact_below_min", exact).drop("edge")


def cover_pool(access: DataFrame, candidates: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """demand_id, facility_id, design_weight: what each candidate would newly cover."""
    open_points = access.where(F.col("t_min").isNull() | (F.col("t_min") > conf.cover_minutes)).select("demand_id", "design_weight")
    near = candidates.where(F.col("minutes") <= conf.cover_minutes).select("demand_id", "facility_id").distinct()
    return near.join(open_points, "demand_id")


def greedy_cover(pool: DataFrame, budget: int, write, local_rows: int = LOCAL_POOL) -> list[tuple]:
    """(facility_id, gain) in order of choice; each the largest gain left, ties by least facility_id, until nothing is gained.

    A pool of at most ``local_rows`` pairs is searched by the driver.  Beyond that
    each step is one distributed aggregate that returns one row; what the choice
    covers leaves the pool by an anti-join.  ``write(df)`` cuts the pool's lineage.
    """
    left = write(pool)
    if left.limit(local_rows + 1).count() <= local_rows:
        return _greedy_here(left.select("demand_id", "facility_id", "design_weight").toPandas(), budget)
    chosen = []
    for step in range(budget):
        best = left.groupBy("facility_id").agg(F.sum("design_weight").alias("gain")).where("gain > 0")
        top = best.orderBy(F.col("gain").desc(), "facility_id").first()
        if top is None:
            break
        chosen.append((top.facility_id, top.gain))
        covered = left.where(F.col("facility_id") == top.facility_id).select("demand_id").distinct()
        left = left.join(covered, "demand_id", "left_anti")
        if step % 5 == 4:
            left = write(left)
    return chosen


def _greedy_here(pool, budget: int) -> list[tuple]:
    pool = pool.sort_values(["facility_id", "demand_id"])
    who, _ = pool["demand_id"].factorize()
    place, names = pool["facility_id"].factorize()
    weight, chosen = pool["design_weight"].to_numpy(float), []
    while len(who) and len(chosen) < budget:
        gain = np.bincount(place, weight, len(names))
        top = int(np.argmax(gain))
        if gain[top] <= 0:
            break
        chosen.append((names[top], float(gain[top])))
        rest = ~np.isin(who, who[place == top])
        who, place, weight = who[rest], place[rest], weight[rest]
    return chosen


def mclp(access: DataFrame, candidates: DataFrame, write, conf: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(frontier by budget, sequence of choices) of greedy maximal coverage.

    All budgets come from one pass: a point's least minutes among the first choices
    of each budget are conditional minima over the order of choice.
    """
    spark = access.sparkSession
    pool = write(cover_pool(access, candidates, conf))
    budgets = sorted(conf.budgets)
    chosen = greedy_cover(pool, budgets[-1], write)
    kind = dict(pool.dtypes)["facility_id"]
    steps = spark.createDataFrame(
        [(i + 1, f if kind == "string" else int(f), float(g)) for i, (f, g) in enumerate(chosen)], f"orden int, facility_id {kind}, poblacion_marginal double"
    )
    w = F.col("design_weight")
    base = access.agg(F.sum(F.when(F.col("t_min") <= conf.cover_minutes, w).otherwise(0.0)).alias("base"), F.sum(w).alias("total"))
    upto = Window.orderBy("orden").rowsBetween(Window.unboundedPreceding, 0)  # at most the largest budget's rows
    sequence = steps.crossJoin(F.broadcast(base)).withColumn(
        "poblacion_cubierta_acumulada", F.col("base") + F.sum("poblacion_marginal").over(upto)
    ).drop("base", "total")
    # The largest gains alone, at most as many as the largest budget.
    alone = pool.groupBy("facility_id").agg(F.sum("design_weight").alias("g")).orderBy(F.col("g").desc(), "facility_id").limit(budgets[-1]).collect()
    near = candidates.join(F.broadcast(steps.select("facility_id", "orden")), "facility_id")
    near = near.groupBy("demand_id").agg(*[F.min(F.when(F.col("orden") <= b, F.col("minutes"))).alias(f"m{b}") for b in budgets])
    rows = access.select("demand_id", "design_weight", "t_min").join(near, "demand_id", "left")
    rows = rows.select("design_weight", "t_min", *[F.least("t_min", f"m{b}").alias(f"t{b}") for b in budgets])
    covered = lambda t: F.sum(F.when(t <= conf.cover_minutes, w).otherwise(0.0))
    one = rows.agg(
        F.sum(w).alias("total"), covered(F.col("t_min")).alias("base"),
        *[covered(F.col(f"t{b}")).alias(f"c{b}") for b in budgets], *[S.weighted_mean(F.col(f"t{b}"), w).alias(f"a{b}") for b in budgets],
    )
    bound = {b: float(sum(r.g for r in alone[:b])) for b in budgets}
    made = F.array(
        *[F.struct(F.lit(b).alias("presupuesto"), F.lit(min(b, len(chosen))).cast("long").alias("n_ascendidos"), F.col(f"c{b}").alias("poblacion_cubierta"),
                   F.col(f"a{b}").alias("t_medio_min"), F.lit(bound[b]).alias("bound")) for b in budgets]
    )
    frontier = one.select("total", "base", F.explode(made).alias("r")).select("total", "base", "r.*")
    top = F.least(F.col("base") + F.col("bound"), F.col("total"))
    frontier = frontier.select(
        "presupuesto", "n_ascendidos", "poblacion_cubierta", F.try_divide("poblacion_cubierta", "total").alias("share_cubierta"),
        (F.col("poblacion_cubierta") - F.col("base")).alias("ganancia_vs_base"), "t_medio_min", top.alias("cota_superior_optimo"),
        F.lit(100 * (1 - 1 / math.e)).alias("garantia_voraz_pct_del_optimo"),
        F.greatest(F.lit(0.0), top - F.col("poblacion_cubierta")).alias("brecha_maxima_vs_cota"),
    )
    return frontier, sequence


def named(sequence: DataFrame, facilities: DataFrame) -> DataFrame:
    """The sequence with the facilities' names, places and categories."""
    return sequence.join(small_side(facilities.select("facility_id", "name", "ubigeo", "category")), "facility_id", "left")
