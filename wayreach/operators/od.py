"""Origin-destination tables, long: one row a demand point and facility."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, Settings
from ..functions import stats as S
from ..functions.geo import haversine_km
from ..plans.lineage import cut
from .nearby import nearby

#: A side of a pair join goes to every executor only up to this size by the optimizer's estimate.
BROADCAST_BYTES = 64 << 20


def is_small(df: DataFrame) -> bool:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def small_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint where its estimated size allows; otherwise as it is, for Spark to shuffle or block."""
    return F.broadcast(df) if is_small(df) else df


def _dealt(demand: DataFrame) -> DataFrame:
    """Demand points as a side of pairs, dealt out by demand_id."""
    spark = demand.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return demand.select("demand_id", F.col("lon").alias("o_lon"), F.col("lat").alias("o_lat"), "snap_m").repartition(tasks, "demand_id")


def all_pairs(demand: DataFrame, facilities: DataFrame, *extra: str) -> DataFrame:
    """demand_id, facility_id, o_lon, o_lat, d_lon, d_lat, snap_m and the ``extra`` facility columns of every pair.

    The pairs are streamed into whatever follows; aggregate or filter them at once.
    Demand points are dealt out by demand_id first, before they are multiplied: all
    tasks share the work however few files hold the points, and aggregates,
    windows and joins by demand_id need no exchange of pairs.
    """
    f = facilities.select("facility_id", F.col("lon").alias("d_lon"), F.col("lat").alias("d_lat"), *extra)
    return _dealt(demand).crossJoin(small_side(f))


def near_pairs(demand: DataFrame, facilities: DataFrame, k: int = 1, stretch: float = 1.0, reach_km: float | None = None, anchors: Column | None = None) -> DataFrame:
    """:func:`all_pairs` without those that can't be among an origin's ``k`` least, or can't be within ``reach_km``.

    For measures that lie between a and b times the straight distance on every pair,
    ``stretch`` is b / a: the k nearest by straight line are within b times the k-th
    distance, so what is farther than b / a times it comes after them all.  ``anchors``
    says which facilities the k-th is one of: the pairs then hold the k least of these
    and of any facilities that include them.  Points
    without coordinates keep a pair, so every origin comes out (with ``reach_km``
    only those that have a facility there).  Facilities too many to be broadcast make
    all pairs, as do none.
    """
    anchor = F.lit(True) if anchors is None else F.coalesce(anchors, F.lit(False))
    places = facilities.select("facility_id", "lon", "lat", F.col("lon").alias("d_lon"), F.col("lat").alias("d_lat"), anchor.alias("anchor"))
    d = _dealt(demand)
    near = nearby(places, F.col("o_lon"), F.col("o_lat"), k, stretch, reach_km, anchor="anchor") if is_small(places) else None
    if near is None:
        return all_pairs(demand, facilities)
    return d.withColumn("__f", F.explode(near)).select("demand_id", "o_lon", "o_lat", "snap_m", "__f.*")


def with_fallback(routed: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """Adds minutes, km and imputed by the policy for pairs without a route.

    An origin farther than ``no_road_access_m`` from the road has no time at all,
    even where a route was found; an unknown snap counts as near.  Else a missing
    time is imputed along the straight line.  Distances are never imputed.
    """
    line = F.col("straight_km") * F.lit(conf.fallback_detour) / F.lit(conf.fallback_speed_kmh) * F.lit(60.0)
    cut_off = F.coalesce(F.col("snap_m") > conf.no_road_access_m, F.lit(False))
    missing = F.col("route_minutes").isNull()
    return routed.withColumns(
        {
            "minutes": F.when(~cut_off, F.coalesce("route_minutes", line)),
            "km": F.when(~cut_off, F.col("route_km")),
            "imputed": missing & ~cut_off,
        }
    )


def nearest(od: DataFrame) -> DataFrame:
    """demand_id, t_min, nearest_facility, km_red: the least minutes, ties by facility_id; nulls where nothing is reached."""
    best = F.when(F.col("minutes").isNotNull(), F.struct("minutes", "facility_id"))
    return od.groupBy("demand_id").agg(
        F.min("minutes").alias("t_min"),
        F.min(best)["facility_id"].alias("nearest_facility"),
        F.min_by(F.when(F.col("minutes").isNotNull(), F.col("km")), best).alias("km_red"),
    )


def top_k(od: DataFrame, k: int) -> DataFrame:
    """demand_id, facility_id, minutes of each origin's ``k`` nearest reached facilities."""
    order = Window.partitionBy("demand_id").orderBy("minutes", "facility_id")
    rows = od.where(F.col("minutes").isNotNull()).select("demand_id", "facility_id", "minutes")
    return rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).drop("__k")


def imputation_report(od: DataFrame) -> DataFrame:
    """One row: pairs, pairs without a route, imputed pairs, origins without road access."""
    far = F.coalesce(F.col("snap_m") > DEFAULT.no_road_access_m, F.lit(False))
    return od.agg(
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("route_minutes").isNull()).alias("n_missing"),
        F.count_if("imputed").alias("n_imputed"),
        F.count_distinct(F.when(far, F.col("demand_id"))).alias("n_no_road_access"),
    )


def imputation_by_class(origins: DataFrame, destinations: DataFrame, has_route, odd: DataFrame) -> DataFrame:
    """:func:`imputation_report` of every pair of origins and destinations where their ``class`` columns alone say whether there is a route.

    ``has_route`` gives that from two classes, of which there have to be few.  Every pair is counted, by
    multiplying the classes' sizes; ``odd`` holds the pairs of a point without a class, after the fallback.
    """
    far = F.coalesce(F.col("snap_m") > DEFAULT.no_road_access_m, F.lit(False))
    a = origins.where("class is not null").groupBy(F.col("class").alias("__a"), far.alias("__far")).agg(F.count("*").alias("__m"))
    b = destinations.where("class is not null").groupBy(F.col("class").alias("__b")).agg(F.count("*").alias("__n"))
    missing = ~F.coalesce(has_route(F.col("__a"), F.col("__b")), F.lit(False))
    pairs = a.crossJoin(F.broadcast(b)).select((F.col("__m") * F.col("__n")).alias("n"), missing.alias("missing"), (missing & ~F.col("__far")).alias("imputed"))
    pairs = pairs.unionByName(odd.select(F.lit(1).cast("long").alias("n"), F.col("route_minutes").isNull().alias("missing"), "imputed"))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    counts = pairs.agg(total(F.lit(True)).alias("n_pairs"), total(F.col("missing")).alias("n_missing"), total(F.col("imputed")).alias("n_imputed"))
    cut_off = origins.where(far).agg(F.count_distinct("demand_id").alias("__cut_off"))
    one = counts.crossJoin(F.broadcast(cut_off))  # one row each
    return one.withColumn("n_no_road_access", F.when(F.col("n_pairs") > 0, F.col("__cut_off")).otherwise(F.lit(0))).drop("__cut_off")


def snap_report(points: DataFrame, profile: str, conf: Settings = DEFAULT) -> DataFrame:
    """Per point_set of (point_set, point_id, snap_m): count, unknown, mean, median, 95th percentile, maximum, over the limits."""
    points = cut(points)
    plain = points.groupBy(F.col("point_set").alias("conjunto")).agg(
        F.lit(profile).alias("profile"),
        F.count("*").alias("n_puntos"),
        F.count_if(F.col("snap_m").isNull()).alias("n_snap_desconocido"),
        F.avg("snap_m").alias("snap_medio_m"),
        F.max("snap_m").alias("snap_max_m"),
        F.count_if(F.col("snap_m") > conf.snap_limit_m).alias("n_sobre_limite"),
        F.count_if(F.col("snap_m") > conf.no_road_access_m).alias("n_sin_acceso_vial"),
    )
    order = S.percentiles(points.withColumnRenamed("point_set", "conjunto"), ["conjunto"], "snap_m", "point_id", {"snap_mediana_m": 0.5, "snap_p95_m": 0.95})
    return plain.join(order, "conjunto", "left")


def _figures(rows: DataFrame, values: dict, quantiles: dict) -> DataFrame:
    """One row: exact percentiles by name, (value's name, q), of the named columns of ``rows``, ties by demand_id."""
    long = F.array(*[F.struct(F.lit(n).alias("of"), c.cast("double").alias("x")) for n, c in values.items()])
    long = rows.select("demand_id", F.explode(long).alias("r")).select("demand_id", "r.*")
    levels = sorted({q for _, q in quantiles.values()})
    found = S.percentiles(long, ["of"], "x", "demand_id", {f"q{i}": q for i, q in enumerate(levels)})
    return found.agg(*[F.max(F.when(F.col("of") == v, F.col(f"q{levels.index(q)}"))).alias(n) for n, (v, q) in quantiles.items()])


def straight_vs_network(od: DataFrame, demand: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """metrica, valor: what straight lines would have said instead of the road."""
    reached = F.when(F.col("minutes").isNotNull(), F.struct("minutes", "facility_id"))
    per = od.groupBy("demand_id").agg(
        F.min("minutes").alias("t_net"),
        F.min(reached)["facility_id"].alias("near_net"),
        F.min_by(F.when(F.col("minutes").isNotNull(), F.col("km")), reached).alias("net_km"),
        F.min_by(F.when(F.col("minutes").isNotNull(), F.col("straight_km")), reached).alias("line_km"),
        (F.min("straight_km") / F.lit(conf.naive_speed_kmh) * F.lit(60.0)).alias("t_line"),
        F.min(F.struct("straight_km", "facility_id"))["facility_id"].alias("near_line"),
    )
    per = per.join(demand.select("demand_id", "design_weight"), "demand_id")
    valid = F.col("t_net").isNotNull() & F.col("t_line").isNotNull()
    far = F.coalesce(F.col("net_km").isNotNull() & (F.col("line_km") > 0.5), F.lit(False))
    detour = F.when(valid, F.col("t_net") / F.greatest(F.col("t_line"), F.lit(1e-6)))
    index = F.when(far, F.col("net_km") / F.col("line_km"))
    values = {
        "n_origenes": F.count_if(valid).cast("double"),
        "velocidad_naif_supuesta_kmh": F.max(F.lit(conf.naive_speed_kmh)),
        "n_con_distancia_de_red": F.count_if(far).cast("double"),
        "share_cambia_establecimiento_mas_cercano": F.avg(F.when(valid, (F.col("near_net") != F.col("near_line")).cast("double"))),
    }
    for b in conf.bands:
        moved = valid & (F.col("t_line") <= b) & (F.col("t_net") > b)
        values[f"poblacion_reclasificada_{b}min"] = F.sum(F.when(moved, F.col("design_weight")).otherwise(0.0))
    per = cut(per)  # one row an origin, read twice
    quantiles = {
        "mediana_min_red": ("net", 0.5), "mediana_min_linea_recta": ("line", 0.5), "factor_desvio_tiempo_mediano": ("detour", 0.5), "factor_desvio_tiempo_p90": ("detour", 0.9),
        "indice_desvio_distancia_mediano": ("index", 0.5), "indice_desvio_distancia_p90": ("index", 0.9),
    }
    parts = {"net": F.when(valid, F.col("t_net")), "line": F.when(valid, F.col("t_line")), "detour": detour, "index": index}
    one = per.agg(*[v.alias(k) for k, v in values.items()]).crossJoin(F.broadcast(_figures(per, parts, quantiles)))  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metrica"), F.col(k).alias("valor")) for k in (*values, *quantiles)])).alias("r")).select("r.*")


def secondary_points(demand: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """The points that slower profiles are run for: the most populous urban ones, filled up with rural ones.

    All points where they fit.  Ranks per area type see only that type's rows and
    keep the first so many, so the sort is a top-k.
    """
    n = conf.secondary_points
    n_urban = int(n * conf.secondary_urban_share)
    order = Window.partitionBy("area_type").orderBy(F.col("population").desc(), "demand_id")
    ranked = demand.where(F.col("area_type").isin("URBANO", "RURAL")).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n)
    sizes = demand.agg(F.count("*").alias("__all"), F.least(F.lit(n_urban), F.count_if(F.col("area_type") == "URBANO")).alias("__u"))
    picked = ranked.crossJoin(F.broadcast(sizes)).where(
        (F.col("__all") > n) & (F.col("__r") <= F.when(F.col("area_type") == "URBANO", F.col("__u")).otherwise(n - F.col("__u")))
    )
    everything = demand.crossJoin(F.broadcast(sizes)).where(F.col("__all") <= n)
    return picked.drop("__r", "__all", "__u").unionByName(everything.drop("__all", "__u"))


def secondary_destinations(od: DataFrame, points: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """facility_id of the union of the points' nearest ``secondary_top_k`` facilities."""
    near = od.join(small_side(points.select("demand_id")), "demand_id", "left_semi")
    return top_k(near, conf.secondary_top_k).select("facility_id").distinct()


def cross_mode(base: DataFrame, other: DataFrame, profile: str) -> DataFrame:
    """One row: how another mode's times and nearest facilities differ from the base mode's, over the common origins."""
    a = nearest(base).select("demand_id", F.col("t_min").alias("tb"), F.col("nearest_facility").alias("nb"))
    b = nearest(other).select("demand_id", F.col("t_min").alias("ta"), F.col("nearest_facility").alias("na"))
    both = a.join(b, "demand_id")
    ratio = F.col("ta") / F.nullif(F.col("tb"), F.lit(0.0))
    differs = F.coalesce((F.col("na") != F.col("nb")) & F.col("ta").isNotNull() & F.col("tb").isNotNull(), F.lit(False))
    both = cut(both.select("demand_id", "tb", "ta", ratio.alias("ratio"), differs.alias("differs")))  # one row an origin, read twice
    one = both.agg(
        F.lit(profile).alias("profile"),
        F.count("*").alias("n_origenes"),
        F.count_if("differs").alias("n_cambia_establecimiento_mas_cercano"),
        F.avg(F.col("differs").cast("double")).alias("share_cambia"),
    )
    quantiles = {"mediana_min_auto": ("tb", 0.5), f"mediana_min_{profile}": ("ta", 0.5), "ratio_mediano": ("ratio", 0.5), "ratio_p90": ("ratio", 0.9)}
    return one.crossJoin(F.broadcast(_figures(both, {c: F.col(c) for c in ("tb", "ta", "ratio")}, quantiles)))  # one row each


def straight_pairs(demand: DataFrame, facilities: DataFrame) -> DataFrame:
    """demand_id, facility_id, straight_km of every pair."""
    km = haversine_km(F.col("o_lon"), F.col("o_lat"), F.col("d_lon"), F.col("d_lat"))
    return all_pairs(demand, facilities).select("demand_id", "facility_id", km.alias("straight_km"))


def table_key(tag: str, *tables: DataFrame) -> str:
    """16 hex digits that name rows whatever their order: by all columns of the tables, and ``tag``."""
    each = [t.select(F.lit(i).alias("t"), F.xxhash64(*[F.col(c) for c in t.columns]).alias("h")) for i, t in enumerate(tables)]
    sums = reduce(DataFrame.unionByName, each).groupBy("t").agg(F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h"), F.count("*"))
    said = sorted(",".join(map(str, r)) for r in sums.collect())  # one row a table
    return hashlib.sha256("|".join([tag, *said]).encode()).hexdigest()[:16]


def request_key(engine: str, profile: str, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """One row, key: 16 hex digits that name an OD request whatever the rows' order."""
    points = origins.select(F.lit("o").alias("s"), "lon", "lat").unionByName(destinations.select(F.lit("d").alias("s"), "lon", "lat"))
    each = F.sha2(F.concat_ws(",", "s", F.format_string("%.6f", "lon"), F.format_string("%.6f", "lat")), 256)
    part = F.conv(F.substring(each, 1, 15), 16, 10).cast("decimal(38,0)")
    total = points.agg(F.sum(part).alias("a"), F.bit_xor(part.cast("long")).alias("b"), F.count("*").alias("n"))
    return total.select(F.substring(F.sha2(F.concat_ws("|", F.lit(engine), F.lit(profile), "a", "b", "n"), 256), 1, 16).alias("key"))
