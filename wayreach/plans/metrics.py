"""Access metrics: levels, contrasts, gaps, inequality, context and change over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, Settings
from ..functions import stats as S
from ..operators.od import nearest, small_side
from .lineage import cut

LEVELS = {
    "district": ["department", "province", "district", "ubigeo"],
    "province": ["department", "province"],
    "department": ["department"],
    "natural_region": ["natural_region"],
    "national": [],
}
#: Value ranges that running sums are cut into where the size of the rows is unknown: coarse levels have large groups.
SPREAD = {"district": 1, "province": 8, "department": 16, "natural_region": 32, "national": 64}


def with_access(demand: DataFrame, near: DataFrame) -> DataFrame:
    """The demand points with t_min, nearest_facility, km_red and unreachable, from :func:`nearest` rows."""
    return demand.join(near, "demand_id", "left").withColumn("unreachable", F.col("t_min").isNull())


def access_table(demand: DataFrame, od: DataFrame) -> DataFrame:
    return with_access(demand, nearest(od))


def _band_columns(conf: Settings) -> list:
    """Aggregates of the bands: population and share up to each, share between, beyond the last."""
    w, t, out, last = F.col("design_weight"), F.col("t_min"), [], None
    for b in conf.bands:
        now = S.share(t <= b, w)
        between = now if last is None else now - S.share(t <= last, w)
        out += [
            (now * F.sum(w)).alias(f"pob_hasta_{b}min"),
            now.alias(f"share_hasta_{b}min"),
            between.alias(f"share_banda_{last or 0}_{b}min"),
        ]
        last = b
    beyond = 1 - S.share(t <= last, w)
    return [*out, beyond.alias(f"share_mas_{last}min"), (F.sum(w) * beyond).alias(f"pob_mas_{last}min")]


def _with_order(rows: DataFrame, plain: DataFrame, keys: list[str]) -> DataFrame:
    """``plain`` with the order statistics of ``rows``; groups without counted rows keep nulls."""
    if not keys:
        return plain.crossJoin(F.broadcast(rows))  # one row each
    return plain.join(rows, keys, "left")


def level_metrics(access: DataFrame, level: str, conf: Settings = DEFAULT) -> DataFrame:
    """Population-weighted metrics by level; rows with a null key stay out."""
    keys = LEVELS[level]
    rows = access.dropna(subset=keys) if keys else access
    w = F.col("design_weight")
    plain = rows.groupBy(*keys).agg(
        F.sum(w).alias("poblacion"),
        F.count("*").alias("n_puntos"),
        F.sum(F.when(F.col("t_min").isNull(), w).otherwise(0.0)).alias("poblacion_sin_ruta"),
        S.weighted_mean(F.col("t_min"), w).alias("t_medio_min"),
        S.weighted_mean(F.col("km_red"), w).alias("km_medio_red"),
        *_band_columns(conf),
    )
    order = S.ordered(
        rows, keys, "t_min", "design_weight", "demand_id", {"t_mediano_min": 0.5, "t_p90_min": 0.9}, "gini_tiempo", SPREAD[level]
    )
    out = _with_order(order, plain, keys)
    return out if keys else out.withColumn("ambito", F.lit("PERÚ"))


def urban_rural(access: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """Area type by natural region, with the weighted median altitude."""
    keys, w = ["area_type", "natural_region"], F.col("design_weight")
    rows = access.dropna(subset=keys)
    plain = rows.groupBy(*keys).agg(
        F.sum(w).alias("poblacion"),
        F.sum(F.when(F.col("t_min").isNotNull(), w).otherwise(0.0)).alias("poblacion_con_ruta"),
        F.count("*").alias("n_puntos"),
        S.weighted_mean(F.col("t_min"), w).alias("t_medio_min"),
        *[S.share(F.col("t_min") <= b, w).alias(f"share_hasta_{b}min") for b in conf.bands],
    )
    time = S.ordered(rows, keys, "t_min", "design_weight", "demand_id", {"t_mediano_min": 0.5, "t_p90_min": 0.9}, "gini_tiempo", 32)
    height = S.ordered(rows, keys, "altitude_m", "design_weight", "demand_id", {"altitud_mediana_m": 0.5}, None, 32)
    return plain.join(time, keys, "left").join(height, keys, "left")


def urban_rural_ratio(access: DataFrame) -> DataFrame:
    """One row: rural over urban weighted mean time."""
    w, t = F.col("design_weight"), F.col("t_min")
    side = lambda a: S.weighted_mean(F.when(F.col("area_type") == a, t), w)
    one = access.agg(side("URBANO").alias("t_urbano"), side("RURAL").alias("t_rural"))
    return one.withColumn("ratio_rural_urbano", F.round(F.try_divide("t_rural", "t_urbano"), 3))


def worst_districts(access: DataFrame, district: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """The ``worst_n`` districts by population beyond the second band, with both ranks.

    The ranks see one row a district.
    """
    band, last = conf.bands[1], conf.bands[-1]
    flags = access.dropna(subset=["ubigeo"]).groupBy("ubigeo").agg(
        F.bool_or("high_variance_district").alias("high_variance"),
        F.count("demand_id").alias("n_puntos_muestra"),
        F.percentile("altitude_m", 0.5).alias("altitud_mediana_m"),
    )
    rows = district.join(flags, "ubigeo", "left")
    rows = rows.withColumn("pob_fuera_umbral", F.col("poblacion") * (1 - F.col(f"share_hasta_{band}min")))
    rows = rows.withColumns(
        {"rank_por_poblacion": S.rank_desc(F.col("pob_fuera_umbral")), "rank_por_tiempo": S.rank_desc(F.col("t_medio_min"))}
    )
    return rows.orderBy(F.col("pob_fuera_umbral").desc_nulls_last(), "ubigeo").limit(conf.worst_n).select(
        "ubigeo", "department", "province", "district", "poblacion", "n_puntos_muestra", "t_medio_min", "t_mediano_min", "t_p90_min",
        f"share_hasta_{band}min", "pob_fuera_umbral", f"pob_mas_{last}min", "altitud_mediana_m", "gini_tiempo", "high_variance",
        "rank_por_poblacion", "rank_por_tiempo",
    )


def inequality(access: DataFrame) -> DataFrame:
    """One row: Gini index of all, urban and rural points, and the 90th over the 50th percentile."""
    total = S.ordered(access, [], "t_min", "design_weight", "demand_id", {"p50": 0.5, "p90": 0.9}, "gini_total", 64)
    parts = []
    for area, name in (("URBANO", "gini_urbano"), ("RURAL", "gini_rural")):
        rows = access.where(F.col("area_type") == area)
        parts.append(S.ordered(rows, [], "t_min", "design_weight", "demand_id", {}, name, 64))
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, total)  # one row each
    ratio = F.col("p90") / F.greatest(F.col("p50"), F.lit(1e-9))
    return one.select(F.lit("gini").alias("medida"), F.col("gini_total").alias("gini_tiempo_acceso"), "gini_urbano", "gini_rural", ratio.alias("p90_p50_ratio"))


def district_context(universe: DataFrame, facilities: DataFrame, districts: DataFrame, access: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """Per ubigeo of places or primary care: sums, area, derived shares and the median altitude.

    A union of the tables' own aggregates and one more aggregate stand for the
    outer alignment: a ubigeo that any of them has comes out.
    """
    people = universe.dropna(subset=["ubigeo"]).groupBy("ubigeo").agg(
        F.sum("population").alias("population"),
        F.sum(F.when(F.col("area_type") == "RURAL", F.col("population"))).alias("rural_pop"),
        F.sum(F.when(F.col("is_capital"), F.col("population"))).alias("capital_pop"),
        F.count("*").alias("ccpp_count"),
    )
    first = facilities.dropna(subset=["ubigeo"]).where(
        F.coalesce("is_operational", F.lit(False)) & F.coalesce(F.col("category").isin(*conf.first_level), F.lit(False))
    )
    care = first.groupBy("ubigeo").agg(F.count("*").alias("primary_care_n"))
    stacked = people.unionByName(care, allowMissingColumns=True)
    ctx = stacked.groupBy("ubigeo").agg(*[F.sum(c).alias(c) for c in ("population", "rural_pop", "capital_pop", "ccpp_count", "primary_care_n")])
    ctx = ctx.fillna(0, ["rural_pop", "capital_pop", "primary_care_n"])
    ctx = ctx.join(districts.select("ubigeo", "area_sqkm", "department", "province", "district"), "ubigeo", "left")
    height = access.dropna(subset=["ubigeo"]).groupBy("ubigeo").agg(F.percentile("altitude_m", 0.5).alias("altitude_m"))
    people_or_null = F.nullif(F.col("population"), F.lit(0))
    return ctx.join(height, "ubigeo", "left").withColumns(
        {
            "rural_share": F.col("rural_pop") / people_or_null,
            "settlement_dispersion": 1 - F.col("capital_pop") / people_or_null,
            "population_density": F.col("population") / F.nullif(F.col("area_sqkm"), F.lit(0)),
            "primary_care_per_10k": F.col("primary_care_n") / people_or_null * 10000,
        }
    )


CROSS_VARIABLES = (
    "altitude_m", "rural_share", "population", "population_density", "settlement_dispersion", "ccpp_count", "primary_care_per_10k",
)

#: What an association with each variable may and may not be read as.
READINGS = {
    "altitude_m": "terrain slows roads, but height also goes with poverty and scattered settlement",
    "rural_share": "both follow from where people settled and where hospitals were put",
    "population": "hospitals are placed where people are, so the cause may run the other way",
    "population_density": "dense districts are short by construction, and hospitals follow people",
    "settlement_dispersion": "close to a definition of distance within the district",
    "ccpp_count": "mixes a district's size with its dispersion; a control only",
    "primary_care_per_10k": "primary care is put where hospitals are not",
}


def cross_analysis(district: DataFrame, ctx: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """Spearman rho of each context variable with the mean time, and the times of its outer quintiles.

    Variables with under ``min_districts`` complete districts are left out; where
    none is left the result is empty, with the same columns.
    """
    rows = district.select("ubigeo", "t_medio_min", "poblacion").join(ctx.select("ubigeo", *CROSS_VARIABLES), "ubigeo", "left")
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in CROSS_VARIABLES])
    long = rows.select("ubigeo", "t_medio_min", "poblacion", F.explode(pairs).alias("p")).select("ubigeo", "t_medio_min", "poblacion", "p.*")
    long = long.dropna(subset=["x", "t_medio_min", "poblacion"])
    edge = Window.partitionBy("variable")
    long = long.withColumns({"lo": F.percentile("x", 0.2).over(edge), "hi": F.percentile("x", 0.8).over(edge), "n": F.count("*").over(edge)})
    long = long.where(F.col("n") >= conf.min_districts)
    t, w = F.col("t_medio_min"), F.col("poblacion")
    means = long.groupBy("variable").agg(
        F.count("*").alias("n_distritos"),
        S.weighted_mean(F.when(F.col("x") <= F.col("lo"), t), w).alias("t_medio_quintil_inferior"),
        S.weighted_mean(F.when(F.col("x") >= F.col("hi"), t), w).alias("t_medio_quintil_superior"),
    )
    rho = S.spearman(long, ["variable"], "x", "t_medio_min").withColumnRenamed("rho", "spearman_rho")
    reading = F.create_map(*[F.lit(x) for kv in READINGS.items() for x in kv])[F.col("variable")]
    sign = F.when(F.col("spearman_rho") > 0, "longer").otherwise("shorter")
    return means.join(rho, "variable").withColumns(
        {
            "reportable": F.abs("spearman_rho") >= conf.min_rho,
            "interpretacion": F.concat(F.lit("More goes with "), sign, F.lit(" times; correlation only: "), reading),
        }
    ).orderBy(F.abs("spearman_rho").desc(), "variable")


def temporal(demand: DataFrame, od: DataFrame, facilities: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """Per year with any facility open by then: count, times and band shares if only those served.

    The OD is read once: a point's least minutes per year come from one aggregate
    over conditional minima.
    """
    opened = F.year(F.try_to_date(F.col("opened"), "dd/MM/yyyy"))
    dates = facilities.where("is_resolutive").select("facility_id", opened.alias("__year"))
    rows = od.join(small_side(dates), "facility_id")
    least = rows.groupBy("demand_id").agg(*[F.min(F.when(F.col("__year") <= y, F.col("minutes"))).alias(f"y{y}") for y in conf.years])
    open_by = dates.agg(*[F.count_if(F.col("__year") <= y).alias(f"n{y}") for y in conf.years])
    years = F.array(*[F.struct(F.lit(y).alias("anio"), F.col(f"y{y}").alias("t")) for y in conf.years])
    long = least.select("demand_id", F.explode(years).alias("p")).select("demand_id", "p.anio", "p.t").join(demand.select("demand_id", "design_weight"), "demand_id")
    long = cut(long)  # one row a point and year
    w = F.col("design_weight")
    plain = long.groupBy("anio").agg(
        F.sum(w).alias("poblacion"),
        S.weighted_mean(F.col("t"), w).alias("t_medio_min"),
        *[S.share(F.col("t") <= b, w).alias(f"share_hasta_{b}min") for b in conf.bands],
    )
    order = S.ordered(long, ["anio"], "t", "design_weight", "demand_id", {"t_mediano_min": 0.5}, None, 64)
    counts = open_by.select(F.explode(F.array(*[F.struct(F.lit(y).alias("anio"), F.col(f"n{y}").alias("n_resolutivas")) for y in conf.years])).alias("p")).select("p.*")
    return plain.join(order, "anio", "left").join(F.broadcast(counts.where("n_resolutivas > 0")), "anio")


def temporal_change(series: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """One row: facilities added and coverage gained between the first and last year."""
    band = f"share_hasta_{conf.bands[1]}min"
    ends = {"first": F.min_by, "last": F.max_by}
    one = series.agg(
        F.count("*").alias("n_anios"), F.min("anio").alias("anio_inicial"), F.max("anio").alias("anio_final"),
        *[f(c, "anio").alias(f"{n}_{c}") for n, f in ends.items() for c in ("n_resolutivas", band)],
    )
    return one.where("n_anios >= 2").select(
        "anio_inicial", "anio_final", (F.col("last_n_resolutivas") - F.col("first_n_resolutivas")).alias("resolutivas_nuevas"),
        (F.col(f"last_{band}") - F.col(f"first_{band}")).alias("cambio_cobertura"),
    )


def region_changes(access: DataFrame) -> DataFrame:
    """Per natural region: points, and points and population that altitude moved there."""
    moved = F.col("natural_region") != F.col("natural_region_proxy")
    return access.groupBy("natural_region").agg(
        F.count("*").alias("n_puntos"), F.count_if(moved).alias("n_reclasificados"),
        F.sum(F.when(moved, F.col("design_weight")).otherwise(0.0)).alias("poblacion_reclasificada"),
    )
