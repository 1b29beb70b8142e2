"""Checks and repairs of facility and demand registers, with an audit of what each did."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import DEFAULT, Settings
from ..functions import geo, text


def first_by_key(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key by ``ordinal``; rows with null keys share a key."""
    order = Window.partitionBy(*keys).orderBy(ordinal)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def _listed(column: str, values) -> object:
    return F.coalesce(F.upper(F.col(column)).isin(*[v.upper() for v in values]), F.lit(False))


def check_districts(points: DataFrame, districts: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """Adds district_polygon_available and point_outside_declared_district to points with lat and lon.

    A point is held to its declared district's rings only, with a tolerance; it is
    flagged, never dropped.  The join is on the district's key.
    """
    rings = districts.select(F.col("ubigeo").alias("__u"), F.col("rings").alias("__rings"))
    rows = points.join(rings, F.col("ubigeo") == F.col("__u"), "left")
    here = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    available = here & F.col("__u").isNotNull()
    inside = geo.covered_by(F.col("__rings"), F.col("lon"), F.col("lat"), conf.polygon_tolerance_deg)
    return rows.withColumns({"district_polygon_available": available, "point_outside_declared_district": available & ~inside}).drop("__u", "__rings")


def recover_coordinates(points: DataFrame, districts: DataFrame) -> DataFrame:
    """Missing pairs become the declared district's centre; adds coord_recovered."""
    centre = districts.select(F.col("ubigeo").alias("__u"), "center_lat", "center_lon")
    rows = points.drop("center_lat", "center_lon").join(centre, F.col("ubigeo") == F.col("__u"), "left")
    need = (F.col("lat").isNull() | F.col("lon").isNull()) & F.col("__u").isNotNull()
    return rows.select(
        *[c for c in points.columns if c not in ("lat", "lon", "center_lat", "center_lon")],
        F.when(need, F.col("center_lat")).otherwise(F.col("lat")).alias("lat"),
        F.when(need, F.col("center_lon")).otherwise(F.col("lon")).alias("lon"),
        need.alias("coord_recovered"),
    )


def clean_facilities(raw: DataFrame, districts: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """A facility register (all text) with flags and repaired coordinates.

    Columns as in the register, with ``ordinal`` for its order.  Steps, in order: first row of
    each code, scope, status and category flags, coordinates, declared district,
    recovery by the district's centre (which is not held to the district again).
    """
    rows = first_by_key(raw, ["COD_IPRESS"], "ordinal")
    for c in ("DEPARTAMENTO", "PROVINCIA", "DISTRITO", "NOMBRE", "INSTITUCION"):
        rows = rows.withColumn(f"{c}_N", text.norm_name(F.col(c)))
    rows = rows.withColumnRenamed("UBIGEO", "ubigeo").withColumn("ubigeo", text.pad_id(F.col("ubigeo"), 6))
    rows = rows.where(F.col("DEPARTAMENTO_N").isin(*conf.departments()))
    operational = _listed("ESTADO", conf.estado) & _listed("SITUACION", conf.situacion) & _listed("CONDICION", conf.condicion)
    rows = rows.withColumns(
        {
            "is_operational": operational,
            "is_resolutive_category": F.coalesce(F.col("CATEGORIA").isin(*conf.resolutive), F.lit(False)),
            "is_upgrade_candidate": F.coalesce(F.col("CATEGORIA").isin(*conf.upgradable), F.lit(False)),
            "__c": geo.fixed_coordinates(text.coordinate(F.col("ESTE")), text.coordinate(F.col("NORTE")), conf),
        }
    )
    rows = rows.withColumns(
        {
            "lat": F.col("__c.lat"), "lon": F.col("__c.lon"), "coord_swapped": F.col("__c.swapped"),
            "coord_outside_bbox": F.col("__c.outside"), "coord_missing_raw": F.col("__c.missing"),
        }
    ).drop("__c")
    rows = recover_coordinates(check_districts(rows, districts, conf), districts)
    rows = rows.withColumn("has_coords", F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return rows.withColumn("is_resolutive", F.col("is_operational") & F.col("is_resolutive_category") & F.col("has_coords"))


def region_of(department, conf: Settings = DEFAULT):
    """The natural region that a whole department is first put in."""
    return F.when(department.isin(*conf.coast), "costa").when(department.isin(*conf.jungle), "selva").otherwise("sierra")


def refined_region(altitude, department, proxy, conf: Settings = DEFAULT):
    """Highland from ``highland_m`` up, else jungle or coast by department; the proxy without an altitude."""
    low = F.when(department.isin(*conf.jungle), "selva").otherwise("costa")
    return F.when(altitude.isNull(), proxy).when(altitude >= conf.highland_m, "sierra").otherwise(low)


def coordinate_columns(raw: DataFrame, a: str, b: str, conf: Settings = DEFAULT) -> DataFrame:
    """One row: lat_column, lon_column, and the scores of the labels as they are (a latitude, b longitude) and exchanged.

    A score is the part of values in the coordinate's range; exchanged must be better to win.
    """
    x0, y0, x1, y1 = conf.bbox
    part = lambda c, lo, hi: F.avg(F.coalesce(text.coordinate(F.col(c)).between(lo, hi), F.lit(False)).cast("double"))
    one = raw.agg((part(b, x0, x1) + part(a, y0, y1)).alias("as_labeled"), (part(a, x0, x1) + part(b, y0, y1)).alias("as_swapped"))
    swapped = F.col("as_swapped") > F.col("as_labeled")
    return one.select(
        F.when(swapped, F.lit(b)).otherwise(F.lit(a)).alias("lat_column"), F.when(swapped, F.lit(a)).otherwise(F.lit(b)).alias("lon_column"), "as_labeled", "as_swapped"
    )


def area_type(population, inei, conf: Settings = DEFAULT):
    """The official class where it is one, else by population."""
    official = text.norm_name(inei)
    return F.when(official.isin("URBANO", "RURAL"), official).when(population >= conf.urban_population, "URBANO").otherwise("RURAL")


def place_rows(raw: DataFrame, lat: str, lon: str, conf: Settings = DEFAULT) -> DataFrame:
    """Every row of a register of populated places (all text, with ``ordinal``), typed, with in_scope, has_class and the flags of its coordinates."""
    whole = lambda c: F.coalesce(F.floor(text.number(F.trim(F.col(c)))).cast("long"), F.lit(0))
    rows = raw.select(
        "ordinal",
        text.district_of(F.col("UBIGEO")).alias("ubigeo"),
        text.pad_id(F.col("UBIGEO"), 10).alias("ccpp_code"),
        text.norm_name(F.col("DEPARTAMENTO")).alias("department"),
        text.norm_name(F.col("PROVINCIA")).alias("province"),
        text.norm_name(F.col("DISTRITO")).alias("district"),
        text.norm_name(F.col("CCPP")).alias("name"),
        whole("Habitantes").alias("population"),
        whole("Viviendas").alias("dwellings"),
        (whole("CAPITAL") > 0).alias("is_capital"),
        area_type(whole("Habitantes"), F.col("CLASIFICACION INEI"), conf).alias("area_type"),
        text.norm_name(F.col("CLASIFICACION INEI")).isin("URBANO", "RURAL").alias("has_class"),
        geo.fixed_coordinates(text.coordinate(F.col(lon)), text.coordinate(F.col(lat)), conf).alias("c"),
    )
    scope = F.col("department").isin(*conf.departments())
    return rows.select(
        "*", F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"), F.col("c.swapped").alias("coord_swapped"), scope.alias("in_scope"),
        F.col("c.missing").alias("coord_missing"), F.col("c.outside").alias("coord_outside_bbox"),
    ).drop("c")


def _located():
    return F.col("in_scope") & ~F.col("coord_missing") & ~F.col("coord_outside_bbox")


def clean_places(raw: DataFrame, districts: DataFrame, lat: str, lon: str, conf: Settings = DEFAULT) -> DataFrame:
    """A register of populated places as demand points.

    Points without usable coordinates or population go.  demand_id numbers the rest
    in the register's order; numbers come from counts of ordinal ranges and a
    window within each, so no task sees all rows.
    """
    rows = place_rows(raw, lat, lon, conf).where(_located()).drop("in_scope", "has_class", "coord_missing", "coord_outside_bbox")
    rows = check_districts(rows, districts, conf).where("population > 0").withColumn("natural_region", region_of(F.col("department"), conf))
    return numbered(rows, "ordinal", "demand_id", "CP", 6)


def numbered(rows: DataFrame, ordinal: str, name: str, prefix: str, width: int, block: int = 100_000) -> DataFrame:
    """Rows with ``name``: prefix and the row's place by ``ordinal`` (whole numbers), filled to ``width``."""
    part = F.floor(F.col(ordinal) / block)
    sizes = rows.groupBy(part.alias("__b")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    sizes = sizes.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    out = rows.withColumn("__b", part).join(sizes, "__b")
    place = F.col("__base") + F.row_number().over(Window.partitionBy("__b").orderBy(ordinal))
    digits = place.cast("string")
    filled = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return out.withColumn(name, F.concat(F.lit(prefix), filled)).drop("__b", "__base")


def audit(rows: DataFrame, dataset: str, checks: dict) -> DataFrame:
    """check, dataset, n_affected, n_total, share_affected of named conditions, from one pass over ``rows``.

    A check is a condition over all rows, or a pair of one and the condition that
    says over which.
    """
    both = [c if isinstance(c, tuple) else (c, F.lit(True)) for c in checks.values()]
    one = rows.agg(
        *[F.count_if(F.coalesce(c & of, F.lit(False))).alias(f"c{i}") for i, (c, of) in enumerate(both)],
        *[F.count_if(F.coalesce(of, F.lit(False))).alias(f"n{i}") for i, (_, of) in enumerate(both)],
    )
    made = F.array(*[F.struct(F.lit(k).alias("check"), F.col(f"c{i}").alias("n_affected"), F.col(f"n{i}").alias("n_total")) for i, k in enumerate(checks)])
    out = one.select(F.explode(made).alias("r")).select("r.check", F.lit(dataset).alias("dataset"), "r.n_affected", "r.n_total")
    return out.withColumn("share_affected", F.round(F.try_divide("n_affected", "n_total"), 6))


def facility_audit(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """The register's checks, one row each, and the recovery rate of coordinates (of at least one needed)."""
    order = Window.partitionBy("COD_IPRESS").orderBy("ordinal")
    twice = raw.withColumn("__again", F.row_number().over(order) > 1)
    before = audit(
        twice, "renipress",
        {
            "encoding": text.looks_twice_encoded(F.col("NOMBRE")) | text.looks_twice_encoded(F.col("DIRECCION")),
            "lossy characters": text.looks_lossy(F.col("NOMBRE")),
            "duplicate codes": F.col("__again"),
        },
    )
    after = audit(
        clean, "renipress",
        {
            "not operational": ~F.col("is_operational"),
            "invalid category": F.col("CATEGORIA").isNull() | (F.col("CATEGORIA") == "0"),
            "missing coordinates": F.col("coord_missing_raw"),
            "swapped coordinates": F.col("coord_swapped"),
            "outside the box": F.col("coord_outside_bbox"),
            "outside the declared district": F.col("point_outside_declared_district"),
            "district without polygon": F.col("lat").isNotNull() & ~F.col("coord_recovered") & ~F.col("district_polygon_available"),
        },
    )
    needed = F.count_if(F.col("coord_missing_raw") | F.col("coord_outside_bbox"))
    rate = clean.agg(F.count_if("coord_recovered").alias("n_affected"), F.greatest(needed, F.lit(1)).alias("n_total")).select(
        F.lit("recovered coordinates").alias("check"), F.lit("renipress").alias("dataset"), "n_affected", "n_total",
        F.round(F.try_divide("n_affected", "n_total"), 6).alias("share_affected"),
    )
    return before.unionByName(after).unionByName(rate)


def places_audit(raw: DataFrame, districts: DataFrame, lat: str, lon: str, conf: Settings = DEFAULT) -> DataFrame:
    """The checks of the places' register, one row each; ``lat`` and ``lon`` as :func:`coordinate_columns` found them.

    Each check counts over the rows that earlier steps left: all, those in scope,
    those with a place on the map.
    """
    rows = check_districts(place_rows(raw, lat, lon, conf), districts, conf)
    scope, here = F.col("in_scope"), _located()
    # Headers are exchanged as a whole: where they are, every row is affected.
    turned = F.lit("latitud" not in lat.lower())
    return audit(
        rows, "ccpp",
        {
            "orientation of the columns": turned,
            "class by population": ~F.col("has_class"),
            "outside the scope": ~scope,
            "missing coordinates": (F.col("coord_missing"), scope),
            "swapped coordinates": (F.col("coord_swapped"), scope),
            "outside the box": (F.col("coord_outside_bbox"), scope),
            "outside the declared district": (F.col("point_outside_declared_district"), here),
            "district without polygon": (~F.col("district_polygon_available"), here),
            "no population": (F.col("population") <= 0, here),
        },
    )


def scope_audit(raw_facilities: DataFrame, districts: DataFrame, conf: Settings = DEFAULT) -> DataFrame:
    """What the scope leaves of the districts' polygons, and takes from the facilities' register (first rows of a code)."""
    inside = lambda c: text.norm_name(F.col(c)).isin(*conf.departments())
    first = first_by_key(raw_facilities.select("COD_IPRESS", "ordinal", "DEPARTAMENTO"), ["COD_IPRESS"], "ordinal")
    kept = audit(districts, "boundaries", {"polygons in scope": inside("department")})
    return kept.unionByName(audit(first, "renipress", {"outside the scope": ~inside("DEPARTAMENTO")}))


def sample_audit(sample: DataFrame, universe: DataFrame) -> DataFrame:
    """The sample's share of the universe, and its districts of high variance (``sample`` as thin_districts gives it)."""
    drawn = sample.agg(F.count("*").alias("n_affected")).crossJoin(F.broadcast(universe.agg(F.count("*").alias("n_total"))))  # one row each
    drawn = drawn.select(
        F.lit("sampled points").alias("check"), F.lit("demand_sample").alias("dataset"), "n_affected", "n_total",
        F.round(F.try_divide("n_affected", "n_total"), 6).alias("share_affected"),
    )
    per = sample.groupBy("ubigeo").agg(F.bool_or("high_variance_district").alias("thin"))
    return drawn.unionByName(audit(per, "demand_sample", {"districts of high variance": F.col("thin")}))


def register_counters(raw_facilities: DataFrame, raw_places: DataFrame, lat: str, lon: str, conf: Settings = DEFAULT) -> DataFrame:
    """One row: rows of both registers, population that has no place on the map, places and population that stay."""
    located, people = _located(), F.col("population")
    lost = F.sum(F.when(F.col("in_scope") & ~located, people).otherwise(0))
    places = place_rows(raw_places, lat, lon, conf).agg(
        F.count("*").alias("places_rows_raw"), F.coalesce(lost, F.lit(0)).alias("places_population_unlocatable"),
        F.count_if(located & (people > 0)).alias("places_valid"),
        F.coalesce(F.sum(F.when(located & (people > 0), people)), F.lit(0)).alias("places_population_total"),
    )
    return raw_facilities.agg(F.count("*").alias("facilities_rows_raw")).crossJoin(F.broadcast(places))  # one row each


def facility_counters(clean: DataFrame) -> DataFrame:
    """One row of counts: facilities, resolutive ones, what status and coordinates cost, candidates."""
    r, o, h = F.col("is_resolutive_category"), F.col("is_operational"), F.col("has_coords")
    return clean.agg(
        F.count("*").alias("facilities_in_scope"),
        F.count_if(r).alias("facilities_resolutive_by_category"),
        F.count_if("is_resolutive").alias("facilities_resolutive"),
        F.count_if(r & ~o).alias("resolutive_not_operational"),
        F.count_if(r & o & ~h).alias("resolutive_without_coordinates"),
        F.count_if(F.col("is_resolutive") & F.col("coord_recovered")).alias("resolutive_recovered"),
        F.count_if(F.col("is_upgrade_candidate") & o & h).alias("upgrade_candidates"),
    )


def with_elevation(points: DataFrame, lookup: DataFrame) -> DataFrame:
    """Points with altitude_m from a table of (point_key, elevation_m) by coordinates to five decimals; unknown ones null."""
    known = lookup.groupBy(F.col("point_key").alias("__key")).agg(F.max("elevation_m").cast("double").alias("altitude_m"))
    rows = points.drop("altitude_m").withColumn("__own", geo.point_key(F.col("lat"), F.col("lon")))
    return rows.join(known, F.col("__own") == F.col("__key"), "left").drop("__own", "__key")


def missing_elevations(points: DataFrame, lookup: DataFrame) -> DataFrame:
    """point_key of the different points that the lookup lacks: what an elevation service has to be asked."""
    keys = points.select(geo.point_key(F.col("lat"), F.col("lon")).alias("point_key")).distinct()
    return keys.join(lookup.select("point_key").distinct(), "point_key", "left_anti")
