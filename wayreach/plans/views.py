"""The tables behind the dashboard, the figures and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, Settings
from ..functions import stats as S
from ..functions.text import title
from .metrics import LEVELS, SPREAD, temporal_change


def filtered(access: DataFrame, departments=(), provinces=(), areas=(), regions=(), reliable_only: bool = False) -> DataFrame:
    """The access table under the dashboard's filters; an empty choice filters nothing."""
    for column, chosen in (("department", departments), ("province", provinces), ("area_type", areas), ("natural_region", regions)):
        if chosen:
            access = access.where(F.col(column).isin(*chosen))
    return access.where(~F.coalesce("high_variance_district", F.lit(False))) if reliable_only else access


def beyond(threshold: float):
    return F.col("t_min").isNull() | (F.col("t_min") > threshold)


def band_class(minutes, conf: Settings = DEFAULT):
    """0 for the first band, 1 for the second and so on; the number of bands beyond them or without a time."""
    out = F.lit(len(conf.bands))
    for i in reversed(range(len(conf.bands))):
        out = F.when(minutes <= conf.bands[i], i).otherwise(out)
    return out


def band_label(minutes, conf: Settings = DEFAULT):
    """The map's class, open on the left: exactly 0 minutes and unknown have none."""
    b = conf.bands
    names = [f"≤ {b[0]}"] + [f"{x}–{y}" for x, y in zip(b, b[1:])]
    out = F.lit(f"> {b[-1]}")
    for edge, name in reversed(list(zip(b, names))):
        out = F.when(minutes <= edge, name).otherwise(out)
    return F.when(minutes > 0, out)


def kpi_header(access: DataFrame, threshold: float) -> DataFrame:
    """One row: population, covered share, population beyond, weighted median and mean, the worst district."""
    w = F.col("design_weight")
    one = access.agg(
        F.sum(w).alias("poblacion"), S.share(F.col("t_min") <= threshold, w).alias("share_cubierta"),
        F.sum(F.when(beyond(threshold), w).otherwise(0.0)).alias("poblacion_fuera"), S.weighted_mean(F.col("t_min"), w).alias("t_medio_min"),
    )
    median = S.ordered(access, [], "t_min", "design_weight", "demand_id", {"t_mediano_min": 0.5}, None, 64)
    worst = access.dropna(subset=["department", "district"]).groupBy("department", "district").agg(
        F.sum(F.when(beyond(threshold), w).otherwise(0.0)).alias("peor_fuera")
    ).orderBy(F.col("peor_fuera").desc(), "department", "district").limit(1)
    worst = worst.select(F.col("department").alias("peor_departamento"), F.col("district").alias("peor_distrito"), "peor_fuera")
    return one.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(worst))  # one row each


def choropleth(access: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """By ubigeo: population, mean time, whether of high variance, class and label of the band."""
    w = F.col("design_weight")
    out = access.dropna(subset=["ubigeo"]).groupBy("ubigeo").agg(
        F.sum(w).alias("poblacion"), S.weighted_mean(F.col("t_min"), w).alias("t_medio_min"), F.bool_or("high_variance_district").alias("alta_varianza")
    )
    return out.withColumns({"banda": band_class(F.col("t_medio_min"), conf), "clase": band_label(F.col("t_medio_min"), conf)})


def ecdf_by_group(access: DataFrame, key: str, top: int = 3) -> DataFrame:
    """Running share of population by time for the ``top`` groups by population."""
    rows = access.dropna(subset=[key])
    largest = rows.groupBy(key).agg(F.sum("design_weight").alias("p")).orderBy(F.col("p").desc(), key).limit(top)
    return S.ecdf(rows.join(F.broadcast(largest.select(key)), key, "left_semi"), [key], "t_min", "design_weight", "demand_id")


def coverage_by_group(access: DataFrame, key: str, conf: Settings = DEFAULT) -> DataFrame:
    """By group: population, mean, median, 90th percentile, Gini index, share within each band."""
    w, rows = F.col("design_weight"), access.dropna(subset=[key])
    plain = rows.groupBy(key).agg(
        F.sum(w).alias("poblacion"), S.weighted_mean(F.col("t_min"), w).alias("t_medio_min"),
        *[S.share(F.col("t_min") <= b, w).alias(f"share_hasta_{b}min") for b in conf.bands],
    )
    order = S.ordered(rows, [key], "t_min", "design_weight", "demand_id", {"t_mediano_min": 0.5, "t_p90_min": 0.9}, "gini_tiempo", 32)
    return plain.join(order, key, "left")


def ranked_gaps(access: DataFrame, threshold: float, n: int = 25, hide_thin: bool = False) -> DataFrame:
    """The ``n`` districts with most population beyond ``threshold``, with coverage."""
    keys, w = LEVELS["district"], F.col("design_weight")
    rows = access.dropna(subset=keys)
    plain = rows.groupBy(*keys).agg(
        F.sum(w).alias("poblacion"), S.weighted_mean(F.col("t_min"), w).alias("t_medio_min"),
        F.sum(F.when(beyond(threshold), w).otherwise(0.0)).alias("fuera"), F.count("*").alias("n_puntos"),
        F.bool_or("high_variance_district").alias("alta_varianza"), F.percentile("altitude_m", 0.5).alias("altitud_m"),
    )
    if hide_thin:
        plain = plain.where(~F.coalesce("alta_varianza", F.lit(False)))
    top = plain.orderBy(F.col("fuera").desc(), "ubigeo").limit(n)
    order = S.ordered(rows, keys, "t_min", "design_weight", "demand_id", {"t_p90_min": 0.9}, None, SPREAD["district"])
    return top.withColumn("cobertura", 1 - F.try_divide("fuera", "poblacion")).join(order, keys, "left")


def department_table(level: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """Coverage by department: mean, 90th percentile and the first two bands in per cent."""
    shares = [(F.col(f"share_hasta_{b}min") * 100).alias(f"pct_hasta_{b}min") for b in conf.bands[:2]]
    return level.select("department", "poblacion", "t_medio_min", "t_p90_min", *shares)


def access_vs_altitude(district: DataFrame, ctx: DataFrame, access: DataFrame) -> DataFrame:
    """Districts with mean time, altitude, rural share and the commonest natural region, the least of equals."""
    counts = access.groupBy("ubigeo", "natural_region").count().where("natural_region is not null and ubigeo is not null")
    modal = counts.groupBy("ubigeo").agg(F.min_by("natural_region", F.struct(-F.col("count"), "natural_region")).alias("natural_region"))
    rows = district.select("ubigeo", "t_medio_min", "poblacion").join(ctx.select("ubigeo", "altitude_m", "rural_share"), "ubigeo", "left")
    return rows.join(modal, "ubigeo", "left")


def lowest_sfca(districts: DataFrame, n: int = 20) -> DataFrame:
    return districts.orderBy("sfca_index_per_10k", "ubigeo").limit(n)


def quality_table(audit: DataFrame) -> DataFrame:
    """The checks that touched anything, the largest share first."""
    return audit.where("n_affected > 0").orderBy(F.col("share_affected").desc(), "check")


def kpis(
    national: DataFrame, inequality: DataFrame, contrast: DataFrame, worst: DataFrame, comparison: DataFrame | None = None,
    frontier: DataFrame | None = None, series: DataFrame | None = None, counters: DataFrame | None = None, conf: Settings = DEFAULT,
) -> DataFrame:
    """kpi, valor: the report's figures as formatted text; tables that aren't at hand leave theirs out.

    Urban and rural means weigh regions by their reached population, so they are
    the true means of the areas.
    """
    thousands = lambda c: F.format_number(F.round(c), 0)
    one = lambda c: F.format_string("%.1f", c)
    n, last = F.col, conf.bands[-1]
    items = {
        "PoblacionTotal": thousands(n("poblacion")), "TiempoMedio": one(n("t_medio_min")), "TiempoMediano": one(n("t_mediano_min")),
        "TiempoPnoventa": one(n("t_p90_min")), f"ShareMas{last}": one(n(f"share_mas_{last}min") * 100), f"PobMas{last}": thousands(n(f"pob_mas_{last}min")),
    }
    for b in conf.bands:
        items |= {f"ShareHasta{b}": one(n(f"share_hasta_{b}min") * 100), f"PobHasta{b}": thousands(n(f"pob_hasta_{b}min"))}
    first = _listed(national, items)
    second = _listed(inequality, {"Gini": F.format_string("%.3f", "gini_tiempo_acceso"), "GiniUrbano": F.format_string("%.3f", "gini_urbano"), "GiniRural": F.format_string("%.3f", "gini_rural")})
    reached = F.col("poblacion_con_ruta")
    side = contrast.groupBy("area_type").agg(F.try_divide(F.sum(F.col("t_medio_min") * reached), F.sum(F.when(F.col("t_medio_min").isNotNull(), reached))).alias("t"))
    third = side.select(F.concat(F.lit("TiempoMedio"), F.initcap(F.lower("area_type"))).alias("kpi"), one(F.col("t")).alias("valor"))
    top = worst.orderBy(F.col("pob_fuera_umbral").desc(), "ubigeo").limit(1)
    fourth = _listed(top, {"PeorDistrito": title(n("district")), "PeorDistritoDep": title(n("department")), "PeorDistritoPob": thousands(n("pob_fuera_umbral"))})
    out = first.unionByName(second).unionByName(third).unionByName(fourth)
    band = conf.bands[1]
    if comparison is not None:
        figure = lambda name: F.max(F.when(F.col("metrica") == name, F.col("valor")))
        one_row = comparison.agg(
            figure("indice_desvio_distancia_mediano").alias("i"), figure(f"poblacion_reclasificada_{band}min").alias("p"),
            figure("share_cambia_establecimiento_mas_cercano").alias("s"),
        )
        out = out.unionByName(_listed(one_row, {"IndiceDesvio": F.format_string("%.2f", "i"), "PobReclasificada": thousands(n("p")), "ShareCambiaCercano": one(n("s") * 100)}))
    if frontier is not None:
        ends = frontier.agg(
            F.min("presupuesto").alias("b0"), F.min_by("ganancia_vs_base", "presupuesto").alias("g0"), F.max("presupuesto").alias("b1"),
            F.max_by("ganancia_vs_base", "presupuesto").alias("g1"),
        )
        whole = lambda c: F.col(c).cast("long").cast("string")
        out = out.unionByName(_listed(ends, {"MclpPresupuesto": whole("b0"), "MclpGanancia": thousands(n("g0")), "MclpPresupuestoMax": whole("b1"), "MclpGananciaMax": thousands(n("g1"))}))
    if series is not None:
        change = temporal_change(series, conf)
        delta = F.format_string("%+.1f", n("cambio_cobertura") * 100)
        text = lambda c: F.col(c).cast("long").cast("string")
        out = out.unionByName(_listed(change, {"TemporalAnioIni": text("anio_inicial"), "TemporalAnioFin": text("anio_final"), "TemporalDelta": delta, "TemporalNuevos": text("resolutivas_nuevas")}))
    if counters is not None:
        names = {"Q" + "".join(x.capitalize() for x in c.split("_")): F.format_number(n(c), 0) for c in counters.columns}
        out = out.unionByName(_listed(counters, names))
    return out


def _listed(row: DataFrame, items: dict) -> DataFrame:
    made = F.array(*[F.struct(F.lit(k).alias("kpi"), v.alias("valor")) for k, v in items.items()])
    return row.select(F.explode(made).alias("r")).select("r.*")


def top_groups(access: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The ``n`` groups of most population with their rank."""
    rows = access.dropna(subset=[key]).groupBy(key).agg(F.sum("design_weight").alias("poblacion"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.col("poblacion").desc(), key)).cast("long")).where(F.col("rank") <= n)


def filtered_facilities(facilities: DataFrame, categories=(), institutions=()) -> DataFrame:
    """Facilities under the map's filters; an empty choice filters nothing."""
    for column, chosen in (("category", categories), ("institution", institutions)):
        if chosen:
            facilities = facilities.where(F.col(column).isin(*chosen))
    return facilities


def facility_markers(facilities: DataFrame, most: int = 3000) -> DataFrame:
    """The markers that a map draws: at most ``most`` located facilities, in order of their id."""
    return facilities.where("lon is not null and lat is not null").orderBy("facility_id").limit(most)
