"""The whole analysis from clean inputs to written tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import DEFAULT, Settings
from ..functions import stats
from ..operators import models, od, sampling
from ..sources.files import write_log, write_od, write_polygons, write_table
from . import metrics, views
from .lineage import cut


def snap_points(points: DataFrame, facilities: DataFrame) -> DataFrame:
    """point_set, point_id, snap_m of origins and destinations; unknown where a table has none."""
    named = lambda df, name, key: df.select(
        F.lit(name).alias("point_set"), F.col(key).cast("string").alias("point_id"),
        (F.col("snap_m") if "snap_m" in df.columns else F.lit(None)).cast("double").alias("snap_m"),
    )
    return named(points, "demanda", "demand_id").unionByName(named(facilities, "establecimientos", "facility_id"))


def run_secondary(sample: DataFrame, resolutive: DataFrame, times: DataFrame, roads, profile: str, conf: Settings = DEFAULT) -> dict[str, DataFrame]:
    """Another mode over fewer points and the facilities nearest to them in the first: od, snapping and cross_mode."""
    points = cut(od.secondary_points(sample, conf).join(times.select("demand_id").distinct(), "demand_id", "left_semi"))
    places = cut(resolutive.join(od.secondary_destinations(times, points, conf), "facility_id", "left_semi"))
    other = cut(roads(points, places))
    cross = od.cross_mode(times, other, profile).withColumnRenamed(f"mediana_min_{profile}", "mediana_min_modo")
    return {f"od_{profile}": other, f"snapping_{profile}": od.snap_report(snap_points(points, places), profile, conf), f"cross_mode_{profile}": cross}


def run_all(
    universe: DataFrame, facilities: DataFrame, districts: DataFrame, roads, folder: str, audit: DataFrame | None = None, conf: Settings = DEFAULT,
    modes: dict | None = None, counters: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Samples, routes, measures, plans and writes; returns the tables by name.

    ``roads(points, facilities)`` gives the long OD with minutes, km, imputed and
    straight_km; ``modes`` has such a function by name for each further profile.
    Each hand-over that several tables read is a table in the shared folder.  Empty
    tables aren't written; level tables are sorted by their keys.
    """
    folder = conf.folder(folder)
    sample = cut(sampling.thin_districts(sampling.sample_demand(universe, conf), universe, conf))
    resolutive = facilities.where("is_resolutive")
    times = cut(roads(sample, resolutive))
    upgrades = facilities.where("is_upgrade_candidate and is_operational and lon is not null and lat is not null")
    candidates = cut(od.top_k(roads(sample, upgrades), conf.k_candidates))
    access = cut(metrics.access_table(sample, times))
    out = {f"metrics_{level}": cut(metrics.level_metrics(access, level, conf)) for level in metrics.LEVELS}
    district = out["metrics_district"]
    context = cut(metrics.district_context(universe, facilities, districts, access, conf))
    points = cut(models.sfca_points(access, times, resolutive, conf))
    sfca = cut(models.sfca_districts(points))
    frontier, sequence = models.mclp(access, candidates, cut, conf)
    later = {
        "urban_rural": metrics.urban_rural(access, conf),
        "worst_districts": metrics.worst_districts(access, district, conf),
        "inequality": metrics.inequality(access),
        "lorenz": stats.lorenz(access, "t_min", "design_weight", "demand_id"),
        "cross_analysis": metrics.cross_analysis(district, context, conf),
        "temporal": metrics.temporal(sample, times, resolutive, conf),
        "snapping": od.snap_report(snap_points(sample, resolutive), "car", conf),
        "straight_vs_network": od.straight_vs_network(times, sample, conf),
        "sfca_summary": models.sfca_summary(sfca),
        "mclp_frontier": frontier,
        "mclp_sequence": models.named(sequence, facilities),
    }
    out |= {"access_points": access, "district_context": context, "sfca_points": points, "sfca_district": sfca} | {k: cut(v) for k, v in later.items()}
    crossed = []
    for profile, other in (modes or {}).items():
        found = run_secondary(sample, resolutive, times, other, profile, conf)
        write_od(_od_rows(found.pop(f"od_{profile}"), profile), f"{folder}/od_{profile}")
        crossed.append(found.pop(f"cross_mode_{profile}"))
        out |= {k: cut(v) for k, v in found.items()}
    if crossed:
        out["cross_mode"] = cut(reduce(DataFrame.unionByName, crossed))
    out["kpis"] = cut(views.kpis(
        out["metrics_national"], out["inequality"], out["urban_rural"], out["worst_districts"], out["straight_vs_network"], out["mclp_frontier"], out["temporal"], counters, conf
    ))
    for name, table in out.items():
        level = name.removeprefix("metrics_")
        write_table(table, f"{folder}/{conf.output_name(name, 'csv')}", metrics.LEVELS.get(level) if name != level else None)
    for name, table in (("facilities", facilities), ("demand_points", universe), ("demand_sample", sample)):
        table.write.mode("overwrite").parquet(f"{folder}/{conf.output_name(name)}")
    write_polygons(districts, f"{folder}/{conf.output_name('districts', 'json')}")
    write_od(_od_rows(times, "car"), f"{folder}/od")
    if audit is not None:
        write_log(audit, f"{folder}/data_quality_report")
    return out


def _od_rows(times: DataFrame, profile: str) -> DataFrame:
    return times.select(F.lit(profile).alias("profile"), *[c for c in ("demand_id", "facility_id", "minutes", "km", "imputed") if c in times.columns])
