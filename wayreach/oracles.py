"""SQL for DuckDB that checks the queries of the catalog over the same tables.

Built from shared common table expressions; the outer SELECT rounds like the
catalog does.
"""

from __future__ import annotations

import math

from .catalog import COLUMNS, SAMPLE, THIN
from .conf import DEFAULT
from .plans.metrics import READINGS

_R = "6371.0088e0"


def _km(x1, y1, x2, y2):
    return (
        f"2e0 * {_R} * asin(sqrt(least(1e0, greatest(0e0, sin(radians({y2} - {y1}) / 2) * sin(radians({y2} - {y1}) / 2)"
        f" + cos(radians({y1})) * cos(radians({y2})) * sin(radians({x2} - {x1}) / 2) * sin(radians({x2} - {x1}) / 2)))))"
    )


_BASE = {
    "dist": """SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS ubigeo, n_name AS district, 'P' || CAST(n_regionkey * 10 + n_nationkey % 3 AS VARCHAR) AS province,
      r_name AS department, 100e0 + n_nationkey * 37 % 400 AS area_sqkm, -81.4e0 + (n_nationkey % 5) * 2.56e0 AS x0, -18.4e0 + (n_nationkey // 5) * 3.672e0 AS y0
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "dem0": """SELECT c_custkey AS demand_id, lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS ubigeo, 1e0 + abs(c_acctbal) AS design_weight,
      CAST(floor(1e0 + abs(c_acctbal)) AS BIGINT) AS population, -81.4e0 + (c_custkey * 7919 % 10007) / 10007e0 * 12.8e0 AS lon,
      -18.4e0 + (c_custkey * 104729 % 10009) / 10009e0 * 18.36e0 AS lat,
      CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'AUTOMOBILE', 'BUILDING') THEN 'URBANO' ELSE 'RURAL' END AS area_type,
      CASE WHEN c_custkey % 50 <> 0 THEN CAST(c_custkey * 37 % 4500 AS DOUBLE) END AS altitude_m,
      CASE WHEN c_custkey % 40 = 0 THEN 25000e0 ELSE CAST(c_custkey % 3000 AS DOUBLE) END AS snap_m, c_custkey % 97 = 0 AS is_capital FROM customer""",
    "dem1": """SELECT d.*, t.district, t.province, t.department, CASE WHEN department IN ('AFRICA', 'EUROPE') THEN 'costa'
      WHEN department IN ('AMERICA', 'MIDDLE EAST') THEN 'selva' ELSE 'sierra' END AS natural_region_proxy FROM dem0 d JOIN dist t USING (ubigeo)""",
    "dem2": """SELECT *, CASE WHEN altitude_m IS NULL THEN natural_region_proxy WHEN altitude_m >= 500 THEN 'sierra'
      WHEN department IN ('AMERICA', 'MIDDLE EAST') THEN 'selva' ELSE 'costa' END AS natural_region FROM dem1""",
    "dem": f"""SELECT d.*, n_points_district, direct_pop_coverage, n_points_district < {THIN.min_points_per_district} AND direct_pop_coverage < {THIN.min_direct_coverage}e0 AS high_variance_district
      FROM dem2 d JOIN (SELECT ubigeo, count(*) AS n_points_district,
        coalesce(sum(CASE WHEN is_capital OR population >= 2000 THEN population END), 0) / CAST(sum(population) AS DOUBLE) AS direct_pop_coverage
        FROM dem2 GROUP BY ubigeo) USING (ubigeo)""",
    "cert": f"SELECT demand_id FROM dem0 WHERE is_capital OR population >= {SAMPLE.certainty_population} ORDER BY population DESC, demand_id LIMIT {SAMPLE.max_demand_points}",
    "fac": """SELECT s_suppkey AS facility_id, s_name AS name, lpad(CAST(s_nationkey AS VARCHAR), 6, '0') AS ubigeo,
      -81.4e0 + (s_suppkey * 6131 % 997) / 997e0 * 12.8e0 AS lon, -18.4e0 + (s_suppkey * 3571 % 991) / 991e0 * 18.36e0 AS lat,
      list_extract(['II-1','II-2','II-E','III-1','III-2','III-E','I-3','I-4','I-1','0'], CAST(s_suppkey % 10 + 1 AS INTEGER)) AS category,
      2004 + s_suppkey * 13 % 22 AS opened_year, CAST(s_suppkey * 17 % 2500 AS DOUBLE) AS snap_m FROM supplier""",
    "pairs": f"""SELECT demand_id, facility_id, d.snap_m, category, opened_year, {_km('d.lon', 'd.lat', 'f.lon', 'f.lat')} AS straight_km,
      demand_id * 31 + facility_id * 17 AS h FROM dem0 d CROSS JOIN fac f WHERE category LIKE 'II%' OR category IN ('I-3', 'I-4')""",
    "routed": "SELECT *, CASE WHEN h % 1000 >= 3 THEN straight_km * (1.2e0 + (h % 100) / 100e0) END AS route FROM pairs",
    "every": """SELECT demand_id, facility_id, snap_m, category, opened_year, straight_km, route,
      CASE WHEN snap_m > 20000 THEN NULL WHEN route IS NULL THEN straight_km * 1.35e0 / 25e0 * 60e0 ELSE route END AS minutes,
      CASE WHEN snap_m > 20000 THEN NULL ELSE route END AS km, route IS NULL AND NOT snap_m > 20000 AS imputed FROM routed""",
    "od": "SELECT * FROM every WHERE category LIKE 'II%'",
    "near": """SELECT * EXCLUDE (r) FROM (SELECT demand_id, minutes AS t_min, facility_id AS nearest_facility, km AS km_red,
      row_number() OVER (PARTITION BY demand_id ORDER BY minutes, facility_id) AS r FROM od WHERE minutes IS NOT NULL) WHERE r = 1""",
    "acc": "SELECT d.*, n.t_min, n.nearest_facility, n.km_red, n.t_min IS NULL AS unreachable FROM dem d LEFT JOIN near n USING (demand_id)",
    "cand": """SELECT demand_id, facility_id, minutes FROM (SELECT *, row_number() OVER (PARTITION BY demand_id ORDER BY minutes, facility_id) AS r
      FROM every WHERE category IN ('I-3', 'I-4') AND minutes IS NOT NULL) WHERE r <= 10""",
    "foot": "SELECT demand_id, facility_id, minutes * (5e0 + ((demand_id * 13 + facility_id * 7) % 40) / 20e0) AS minutes FROM od",
    "scen": """SELECT demand_id, design_weight, t_min AS t_base, least(t_min, best) AS t_new FROM acc LEFT JOIN (SELECT demand_id, min(minutes) AS best FROM cand
      WHERE facility_id % 6 = 0 GROUP BY demand_id) USING (demand_id)""",
}


def _ordered(name: str, source: str, keys: str, value: str = "t_min", where: str = "TRUE", weight: str = "design_weight", tie: str = "demand_id") -> dict:
    part = f"PARTITION BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    up = f"OVER ({part} ORDER BY {value}, {tie} ROWS UNBOUNDED PRECEDING)"
    return {
        f"{name}_c": f"SELECT {head}{value} AS v, {weight} AS w, {tie} AS i, sum({weight}) {up} AS cw, sum({value} * {weight}) {up} AS cvw,"
        f" sum({weight}) OVER ({part}) AS tw, sum({value} * {weight}) OVER ({part}) AS tvw FROM {source} WHERE {value} IS NOT NULL AND {weight} > 0 AND {where}",
        name: f"SELECT *, lag(v) OVER ({part} ORDER BY v, i) AS pv, lag(cw) OVER ({part} ORDER BY v, i) AS pc FROM {name}_c",
    }


def _q(q: str) -> str:
    return f"coalesce(min_by(CASE WHEN pv IS NULL THEN v ELSE pv + ({q}e0 * tw - pc) / (cw - pc) * (v - pv) END, cw) FILTER (WHERE cw >= {q}e0 * tw), max(v))"


_GINI = "CASE WHEN count(*) >= 2 AND max(tvw) > 0 THEN 1 - 2 * sum(w * (cvw - v * w / 2)) / (max(tw) * max(tvw)) END"
_MEAN = "sum(CASE WHEN t_min IS NOT NULL THEN t_min * design_weight END) / nullif(sum(CASE WHEN t_min IS NOT NULL THEN design_weight END), 0)"
_W = "sum(design_weight)"


def _upto(b, t="t_min"):
    return f"sum(CASE WHEN {t} <= {b} THEN design_weight ELSE 0 END)"


def _level(keys: str) -> tuple[dict, str]:
    ctes = _ordered("o", "acc", keys)
    group = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    ctes["oo"] = f"SELECT {head}{_q('0.5')} AS t_mediano_min, {_q('0.9')} AS t_p90_min, {_GINI} AS gini_tiempo FROM o {group}"
    ctes["p"] = f"""SELECT {head}{_W} AS poblacion, count(*) AS n_puntos, sum(CASE WHEN t_min IS NULL THEN design_weight ELSE 0 END) AS poblacion_sin_ruta,
      {_MEAN} AS t_medio_min, sum(CASE WHEN km_red IS NOT NULL THEN km_red * design_weight END) / nullif(sum(CASE WHEN km_red IS NOT NULL THEN design_weight END), 0) AS km_medio_red,
      {_upto(30)} AS pob_hasta_30min, {_upto(60)} AS pob_hasta_60min, {_upto(120)} AS pob_hasta_120min FROM acc {group}"""
    join = f"p LEFT JOIN oo USING ({keys})" if keys else "p, oo"
    return ctes, f"""SELECT *, {'' if keys else "'PERÚ' AS ambito,"} pob_hasta_30min / poblacion AS share_hasta_30min, pob_hasta_30min / poblacion AS share_banda_0_30min,
      pob_hasta_60min / poblacion AS share_hasta_60min, pob_hasta_60min / poblacion - pob_hasta_30min / poblacion AS share_banda_30_60min,
      pob_hasta_120min / poblacion AS share_hasta_120min, pob_hasta_120min / poblacion - pob_hasta_60min / poblacion AS share_banda_60_120min,
      1 - pob_hasta_120min / poblacion AS share_mas_120min, poblacion * (1 - pob_hasta_120min / poblacion) AS pob_mas_120min FROM {join}"""


_DIST = "department, province, district, ubigeo"


def _district_level() -> dict:
    ctes, body = _level(_DIST)
    return {**ctes, "dm": body}


_CTX = {
    "ctx0": """SELECT ubigeo, sum(population) AS population, coalesce(sum(rural), 0) AS rural_pop, coalesce(sum(cap), 0) AS capital_pop, sum(n) AS ccpp_count, coalesce(sum(care), 0) AS primary_care_n
      FROM (SELECT ubigeo, population, CASE WHEN area_type = 'RURAL' THEN population END AS rural, CASE WHEN is_capital THEN population END AS cap, 1 AS n, NULL AS care FROM dem0
      UNION ALL SELECT ubigeo, NULL, NULL, NULL, NULL, 1 FROM fac WHERE category IN ('I-1', 'I-2', 'I-3', 'I-4')) GROUP BY ubigeo""",
    "ctx": """SELECT c.ubigeo, CAST(population AS BIGINT) AS population, CAST(rural_pop AS BIGINT) AS rural_pop, CAST(capital_pop AS BIGINT) AS capital_pop, CAST(ccpp_count AS BIGINT) AS ccpp_count,
      CAST(primary_care_n AS BIGINT) AS primary_care_n, area_sqkm, department, province, district, rural_pop / CAST(nullif(population, 0) AS DOUBLE) AS rural_share,
      1 - capital_pop / CAST(nullif(population, 0) AS DOUBLE) AS settlement_dispersion, population / area_sqkm AS population_density,
      primary_care_n / CAST(nullif(population, 0) AS DOUBLE) * 10000 AS primary_care_per_10k, altitude_m
      FROM ctx0 c LEFT JOIN dist USING (ubigeo) LEFT JOIN (SELECT ubigeo, median(altitude_m) AS altitude_m FROM acc GROUP BY ubigeo) USING (ubigeo)""",
}

_SIGMA = 240.0 / math.sqrt(2.0 * math.log(20.0))
_SFCA = {
    "g": f"""SELECT demand_id, facility_id, design_weight, exp(-0.5e0 * (minutes / {_SIGMA!r}) * (minutes / {_SIGMA!r})) AS wt,
      CASE category WHEN 'II-1' THEN 30e0 WHEN 'II-2' THEN 120e0 WHEN 'II-E' THEN 60e0 WHEN 'III-1' THEN 300e0 WHEN 'III-2' THEN 400e0 WHEN 'III-E' THEN 200e0 ELSE 160e0 END AS s
      FROM od JOIN dem0 USING (demand_id) WHERE minutes <= 240""",
    "rj": "SELECT facility_id, max(s) / sum(wt * design_weight) AS ratio FROM g GROUP BY facility_id HAVING sum(wt * design_weight) > 0",
    "ai": "SELECT demand_id, sum(wt * ratio) AS a, count(*) AS n FROM g JOIN rj USING (facility_id) GROUP BY demand_id",
    "sp": "SELECT acc.*, coalesce(a, 0) * 10000 AS sfca_index_per_10k, coalesce(n, 0) AS n_facilities_in_catchment FROM acc LEFT JOIN ai USING (demand_id)",
    "sd": f"""SELECT {_DIST}, {_W} AS poblacion, sum(sfca_index_per_10k * design_weight) / {_W} AS sfca_index_per_10k, sum(coalesce(t_min, longest) * design_weight) / {_W} AS t_medio_min,
      median(n_facilities_in_catchment) AS n_facilities_in_catchment FROM (SELECT *, max(t_min) OVER (PARTITION BY {_DIST}) AS longest FROM sp) GROUP BY {_DIST}""",
}


def _avg_rank(x: str, part: str = "") -> str:
    p = f"PARTITION BY {part}" if part else ""
    both = f"PARTITION BY {part}, {x}" if part else f"PARTITION BY {x}"
    return f"rank() OVER ({p} ORDER BY {x}) + (count(*) OVER ({both}) - 1) / 2e0"


_MINUTES = f"{DEFAULT.cover_minutes:g}"
#: Greedy choices by recursion: a step has the points that earlier ones cover.
_POOL = {
    "pool": f"SELECT DISTINCT demand_id, facility_id, design_weight FROM cand JOIN acc USING (demand_id) WHERE minutes <= {_MINUTES} AND (t_min IS NULL OR t_min > {_MINUTES})",
    "greedy (orden, facility_id, gain, seen)": f"""SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0e0, CAST([] AS BIGINT[])
      UNION ALL SELECT orden, facility_id, gain, list_concat(seen, own) FROM (SELECT g.orden + 1 AS orden, p.facility_id, sum(design_weight) AS gain, list(p.demand_id) AS own, any_value(g.seen) AS seen
        FROM greedy g JOIN pool p ON NOT list_contains(g.seen, p.demand_id) WHERE g.orden < {max(DEFAULT.budgets)} GROUP BY g.orden, p.facility_id)
        QUALIFY row_number() OVER (ORDER BY gain DESC, facility_id) = 1""",
    "seq": "SELECT CAST(orden AS INTEGER) AS orden, facility_id, gain FROM greedy WHERE orden > 0",
    "base": f"SELECT {_upto(_MINUTES)} AS covered, {_W} AS total FROM acc",
}


def _frontier(b: int) -> str:
    t = f"least(t_min, (SELECT min(minutes) FROM cand c WHERE c.demand_id = acc.demand_id AND c.facility_id IN (SELECT facility_id FROM seq WHERE orden <= {b})))"
    return f"""SELECT {b} AS presupuesto, (SELECT count(*) FROM seq WHERE orden <= {b}) AS n_ascendidos, cov AS poblacion_cubierta, cov / total AS share_cubierta, cov - covered AS ganancia_vs_base,
      mean AS t_medio_min, least(covered + bound, total) AS cota_superior_optimo, {100 * (1 - 1 / math.e)!r} AS garantia_voraz_pct_del_optimo, greatest(0e0, least(covered + bound, total) - cov) AS brecha_maxima_vs_cota
      FROM base, (SELECT sum(CASE WHEN t <= {_MINUTES} THEN design_weight ELSE 0 END) AS cov, sum(CASE WHEN t IS NOT NULL THEN t * design_weight END) / sum(CASE WHEN t IS NOT NULL THEN design_weight END) AS mean
        FROM (SELECT design_weight, {t} AS t FROM acc)),
      (SELECT coalesce(sum(g), 0) AS bound FROM (SELECT sum(design_weight) AS g FROM pool GROUP BY facility_id ORDER BY g DESC, facility_id LIMIT {b}))"""


def _quota(strata: str, slots: str) -> dict:
    """Places by the one-by-one rule, all divisors ranked at once."""
    return {
        "st": strata,
        "q1": f"""SELECT *, CASE WHEN size >= 1 AND coalesce(sum(CASE WHEN size >= 1 THEN 1 ELSE 0 END) OVER (ORDER BY pop DESC, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {slots}
          THEN 1 ELSE 0 END AS b FROM st""",
        "q2": f"SELECT *, {slots} - sum(b) OVER () AS rest FROM q1",
        "q3": "SELECT stratum, rest, pop / CAST(2 * x + 1 AS DOUBLE) AS pr FROM (SELECT stratum, rest, pop, unnest(range(b, CAST(least(size, b + rest) AS BIGINT))) AS x FROM q2 WHERE rest > 0 AND pop > 0)",
        "q4": "SELECT stratum, count(*) AS won FROM (SELECT stratum, rest, row_number() OVER (ORDER BY pr DESC, stratum) AS r FROM q3) WHERE r <= rest GROUP BY stratum",
        "quo": "SELECT stratum, CAST(pop AS BIGINT) AS pop, size, CAST(b + coalesce(won, 0) AS BIGINT) AS quota FROM q2 LEFT JOIN q4 USING (stratum)",
    }


_STRATA = "SELECT ubigeo || '|' || area_type AS stratum, sum(population) AS pop, count(*) AS size FROM {} GROUP BY 1"
_CERTAIN = "demand_id IN (SELECT demand_id FROM cert)"
_U = f"(CAST(('0x' || substr(md5('{DEFAULT.seed}:' || CAST(demand_id AS VARCHAR)), 1, 8)) AS BIGINT) + 1) / 4294967296e0"

_WAYS = {
    "pts": """SELECT way_id, fclass, pos, -80e0 + x * 0.1e0 AS lon, -15e0 + y * 0.1e0 AS lat FROM (
      SELECT p_partkey AS way_id, list_extract(['primary','secondary','residential','footway','track_link'], CAST(p_size % 5 + 1 AS INTEGER)) AS fclass, pos,
        p_partkey % 40 + CASE pos WHEN 0 THEN 0e0 WHEN 1 THEN 0.5e0 ELSE 1e0 END AS x, p_partkey // 40 % 40 + CASE pos WHEN 3 THEN 1 ELSE 0 END AS y
      FROM part CROSS JOIN (VALUES (0), (1), (2), (3)) t(pos)) WHERE fclass <> 'footway'""",
    "vtx": "SELECT *, CAST(round(lon * 1e6) AS BIGINT) || ',' || CAST(round(lat * 1e6) AS BIGINT) AS node FROM pts",
    "crs": "SELECT *, count(*) OVER (PARTITION BY node) > 1 AS crossing FROM vtx",
    "stp": f"""SELECT *, lag(node) OVER w AS pn, {_km('lag(lon) OVER w', 'lag(lat) OVER w', 'lon', 'lat')} AS km, pos > 0 AND (crossing OR pos = 3) AS stop
      FROM crs WINDOW w AS (PARTITION BY way_id ORDER BY pos)""",
    "seg": "SELECT *, coalesce(sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM stp",
    "str": "SELECT way_id, fclass, s, sum(km) AS km, min_by(pn, pos) AS x, max_by(node, pos) AS y FROM seg WHERE pos > 0 GROUP BY way_id, fclass, s",
    "edges": "SELECT least(x, y) AS a, greatest(x, y) AS b, min(km / CASE fclass WHEN 'primary' THEN 70e0 WHEN 'secondary' THEN 60e0 WHEN 'residential' THEN 25e0 ELSE 30e0 END * 3600e0) AS seconds FROM str WHERE x <> y GROUP BY 1, 2",
}

_LON0, _LAT0 = "round(-81.4e0 + (c_custkey * 7919 % 10007) / 10007e0 * 12.8e0, 6)", "round(-18.4e0 + (c_custkey * 104729 % 10009) / 10009e0 * 18.36e0, 6)"
_PLACES = f"""SELECT c_custkey AS k, lpad(CAST(c_custkey + 101010000 AS VARCHAR), 10, '0') AS ccpp_code, c_custkey % 3 <> 2 AS has_class,
  CASE WHEN c_custkey % 31 = 0 THEN 'NOWHERE' ELSE list_extract(['TACNA', 'CUSCO', 'SAN MARTIN'], CAST(c_custkey % 3 + 1 AS INTEGER)) END AS department, upper(c_name) AS name, c_custkey % 4 = 1 AS is_capital,
  CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE c_custkey * 37 % 5000 END AS population,
  CASE c_custkey % 3 WHEN 0 THEN 'URBANO' WHEN 1 THEN 'RURAL' ELSE CASE WHEN (CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE c_custkey * 37 % 5000 END) >= 2000 THEN 'URBANO' ELSE 'RURAL' END END AS area_type,
  CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN {_LAT0} WHEN c_custkey % 29 = 0 THEN 55.5e0 ELSE {_LON0} END AS lon,
  CASE WHEN c_custkey % 23 = 0 THEN {_LON0} ELSE {_LAT0} END AS lat FROM customer"""


_LON, _LAT = "(-81e0 + (s_suppkey * 6131 % 997) / 997e0 * 12e0)", "(-18e0 + (s_suppkey * 3571 % 991) / 991e0 * 17e0)"


def _nth(k: str, *values: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({k} % {len(values)} + 1 AS INTEGER))"


_REGISTER = {
    "raw": f"""SELECT s_suppkey AS k, s_suppkey - s_suppkey % 9 % 2 AS code, s_name || {_nth('s_suppkey', '', ' Ã‘o', ' ?x a?b', '')} AS nombre,
      {_nth('s_suppkey', 'PIURA', 'LORETO', 'HUANCAVELICA', 'ANCASH', 'NOWHERE')} AS dep, {_nth('s_suppkey', 'II-1', 'I-3', 'II-2', 'I-1', '0', 'III-1', 'I-4')} AS cat,
      s_suppkey % 4 <> 3 AS operational, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN round({_LON}, 6) WHEN s_suppkey % 13 = 0 THEN 55.5e0 ELSE round({_LAT}, 6) END AS lat,
      CASE WHEN s_suppkey % 7 = 0 THEN round({_LAT}, 6) ELSE round({_LON}, 6) END AS lon, s_nationkey FROM supplier""",
    "uni": "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY k) AS r FROM raw) WHERE r = 1 AND dep <> 'NOWHERE'",
    "chk": """SELECT *, lat IS NULL OR lon IS NULL OR lat = 0 OR lon = 0 AS missing, coalesce({inside}, FALSE) AS direct, coalesce({swapped}, FALSE) AS other FROM uni""",
    "flg": "SELECT *, NOT missing AND NOT direct AND other AS swapped, NOT missing AND NOT direct AND NOT other AS outside FROM chk",
    "rec": """SELECT f.*, missing OR outside AS recovered, CASE WHEN swapped THEN lat ELSE lon END AS x, CASE WHEN swapped THEN lon ELSE lat END AS y, x0, y0,
      cat IN ('II-1', 'II-2', 'III-1') AS res, cat IN ('I-3', 'I-4') AS up FROM flg f JOIN dist d ON d.ubigeo = lpad(CAST(s_nationkey AS VARCHAR), 6, '0')""",
}


def _in(x, y):
    x0, y0, x1, y1 = DEFAULT.bbox
    return f"({x} BETWEEN {x0}e0 AND {x1}e0 AND {y} BETWEEN {y0}e0 AND {y1}e0)"


_REGISTER["chk"] = _REGISTER["chk"].format(inside=_in("lon", "lat"), swapped=_in("lat", "lon"))


def _bands(of: str = "t_min") -> str:
    return ", ".join(f"{_upto(b, of)} / {_W} AS share_hasta_{b}min" for b in DEFAULT.bands)


def _group_table(key: str, extra: str = "") -> tuple[dict, str]:
    ctes = {**_ordered("o", "acc", key), "oo": f"SELECT {key}, {_q('0.5')} AS t_mediano_min, {_q('0.9')} AS t_p90_min, {_GINI} AS gini_tiempo FROM o GROUP BY {key}"}
    body = f"""SELECT * FROM (SELECT {key}, {_W} AS poblacion, sum(CASE WHEN t_min IS NOT NULL THEN design_weight ELSE 0 END) AS poblacion_con_ruta, count(*) AS n_puntos, {_MEAN} AS t_medio_min, {_bands()} FROM acc GROUP BY {key})
      LEFT JOIN oo USING ({key})"""
    return ctes, body


def _year_rows() -> dict:
    return {
        "yr": "SELECT unnest([2010, 2015, 2020, 2026]) AS anio",
        "yt": "SELECT anio, demand_id, design_weight, min(CASE WHEN opened_year <= anio THEN minutes END) AS t FROM od JOIN dem0 USING (demand_id) CROSS JOIN yr GROUP BY ALL",
        **_ordered("yo", "yt", "anio", "t"),
        "ym": f"SELECT anio, {_q('0.5')} AS t_mediano_min FROM yo GROUP BY anio",
        "tmp": f"""SELECT anio, n_resolutivas, poblacion, t_medio_min, t_mediano_min, share_hasta_30min, share_hasta_60min, share_hasta_120min FROM (SELECT anio, {_W} AS poblacion,
          sum(CASE WHEN t IS NOT NULL THEN t * design_weight END) / sum(CASE WHEN t IS NOT NULL THEN design_weight END) AS t_medio_min, {_bands('t')} FROM yt GROUP BY anio) LEFT JOIN ym USING (anio)
          JOIN (SELECT anio, count(*) AS n_resolutivas FROM yr JOIN (SELECT * FROM fac WHERE category LIKE 'II%') f ON opened_year <= anio GROUP BY anio) USING (anio)""",
    }


def _queries() -> dict:
    out: dict[str, tuple[dict, str]] = {"access_points": ({}, "SELECT * FROM acc")}
    for name, keys in (("district", _DIST), ("province", "department, province"), ("department", "department"), ("natural_region", "natural_region"), ("nation", "")):
        out[f"access_by_{name}"] = _level(keys)
    ctes, body = _group_table("area_type, natural_region")
    ctes |= _ordered("ha", "acc", "area_type, natural_region", "altitude_m")
    ctes["hb"] = f"SELECT area_type, natural_region, {_q('0.5')} AS altitud_mediana_m FROM ha GROUP BY area_type, natural_region"
    out["urban_rural"] = ctes, f"SELECT * FROM ({body}) LEFT JOIN hb USING (area_type, natural_region)"
    side = lambda a: f"sum(CASE WHEN area_type = '{a}' AND t_min IS NOT NULL THEN t_min * design_weight END) / sum(CASE WHEN area_type = '{a}' AND t_min IS NOT NULL THEN design_weight END)"
    out["urban_rural_ratio"] = {}, f"SELECT *, round(t_rural / t_urbano, 3) AS ratio_rural_urbano FROM (SELECT {side('URBANO')} AS t_urbano, {side('RURAL')} AS t_rural FROM acc)"
    dm = _district_level()
    worst = {
        **dm,
        "wd": """SELECT dm.*, high_variance, n_puntos_muestra, altitud_mediana_m, poblacion * (1 - share_hasta_60min) AS pob_fuera_umbral FROM dm LEFT JOIN (SELECT ubigeo, bool_or(high_variance_district) AS high_variance,
          count(demand_id) AS n_puntos_muestra, median(altitude_m) AS altitud_mediana_m FROM acc GROUP BY ubigeo) USING (ubigeo)""",
        "wr": """SELECT *, CAST(rank() OVER (ORDER BY pob_fuera_umbral DESC NULLS LAST) AS DOUBLE) AS rank_por_poblacion,
          CASE WHEN t_medio_min IS NOT NULL THEN CAST(rank() OVER (ORDER BY t_medio_min DESC NULLS LAST) AS DOUBLE) END AS rank_por_tiempo FROM wd""",
    }
    out["worst_districts"] = worst, "SELECT * FROM wr ORDER BY pob_fuera_umbral DESC NULLS LAST, ubigeo LIMIT 25"
    ineq = {**_ordered("ga", "acc", ""), **_ordered("gu", "acc", "", where="area_type = 'URBANO'"), **_ordered("gr", "acc", "", where="area_type = 'RURAL'")}
    out["inequality"] = ineq, f"""SELECT 'gini' AS medida, a.g AS gini_tiempo_acceso, u.g AS gini_urbano, r.g AS gini_rural, p90 / greatest(p50, 1e-9) AS p90_p50_ratio
      FROM (SELECT {_GINI} AS g, {_q('0.5')} AS p50, {_q('0.9')} AS p90 FROM ga) a, (SELECT {_GINI} AS g FROM gu) u, (SELECT {_GINI} AS g FROM gr) r"""
    out["lorenz"] = _ordered("o", "acc", ""), """SELECT step / 100e0 AS share_poblacion, CASE WHEN step = 0 THEN 0e0 ELSE coalesce((SELECT min((cvw - v * w) / tvw + (step / 100e0 - coalesce(pc, 0) / tw) / (cw / tw - coalesce(pc, 0) / tw) * (v * w / tvw))
      FROM o WHERE step / 100e0 <= cw / tw AND step / 100e0 > coalesce(pc, 0) / tw), 1e0) END AS share_tiempo_acumulado FROM (SELECT unnest(range(0, 101)) AS step)"""
    out["district_context"] = _CTX, "SELECT * FROM ctx"
    variables = ("altitude_m", "rural_share", "population", "population_density", "settlement_dispersion", "ccpp_count", "primary_care_per_10k")
    union = " UNION ALL ".join(f"SELECT '{v}' AS variable, CAST({v} AS DOUBLE) AS x, t_medio_min AS t, poblacion AS w FROM dm LEFT JOIN (SELECT * EXCLUDE (department, province, district) FROM ctx) USING (ubigeo)" for v in variables)
    cross = {
        **dm, **_CTX, "lng": f"SELECT * FROM ({union}) WHERE x IS NOT NULL AND t IS NOT NULL AND w IS NOT NULL",
        "cut": "SELECT variable, quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi, count(*) AS n FROM lng GROUP BY variable HAVING count(*) >= 10",
        "rk": f"SELECT variable, {_avg_rank('x', 'variable')} AS ra, {_avg_rank('t', 'variable')} AS rb FROM lng",
    }
    readings = " ".join(f"WHEN '{k}' THEN '" + v.replace("'", "''") + "'" for k, v in READINGS.items())
    out["cross_analysis"] = cross, f"""SELECT variable, max(n) AS n_distritos, max(rho) AS spearman_rho, sum(CASE WHEN x <= lo THEN t * w END) / sum(CASE WHEN x <= lo THEN w END) AS t_medio_quintil_inferior,
      sum(CASE WHEN x >= hi THEN t * w END) / sum(CASE WHEN x >= hi THEN w END) AS t_medio_quintil_superior, abs(max(rho)) >= 0.15 AS reportable,
      'More goes with ' || CASE WHEN max(rho) > 0 THEN 'longer' ELSE 'shorter' END || ' times; correlation only: ' || CASE variable {readings} END AS interpretacion
      FROM lng JOIN cut USING (variable) JOIN (SELECT variable, corr(ra, rb) AS rho FROM rk GROUP BY variable) USING (variable) GROUP BY variable"""
    out["temporal"] = _year_rows(), "SELECT * FROM tmp"
    out["temporal_change"] = _year_rows(), """SELECT min(anio) AS anio_inicial, max(anio) AS anio_final, max_by(n_resolutivas, anio) - min_by(n_resolutivas, anio) AS resolutivas_nuevas,
      max_by(share_hasta_60min, anio) - min_by(share_hasta_60min, anio) AS cambio_cobertura FROM tmp HAVING count(*) >= 2"""
    moved = "natural_region <> natural_region_proxy"
    out["region_changes"] = {}, f"""SELECT natural_region, count(*) AS n_puntos, count(*) FILTER (WHERE {moved}) AS n_reclasificados,
      sum(CASE WHEN {moved} THEN design_weight ELSE 0 END) AS poblacion_reclasificada FROM acc GROUP BY natural_region"""
    out["od_topk"] = {}, "SELECT * FROM cand"
    out["od_fallback"] = {}, "SELECT * FROM od"
    out["od_imputation"] = {}, """SELECT count(*) AS n_pairs, count(*) FILTER (WHERE route IS NULL) AS n_missing, count(*) FILTER (WHERE imputed) AS n_imputed,
      count(DISTINCT CASE WHEN snap_m > 20000 THEN demand_id END) AS n_no_road_access FROM od"""
    out["snap_report"] = {}, """SELECT 'car' AS profile, conjunto, count(*) AS n_puntos, count(*) FILTER (WHERE snap_m IS NULL) AS n_snap_desconocido, avg(snap_m) AS snap_medio_m, median(snap_m) AS snap_mediana_m,
      quantile_cont(snap_m, 0.95) AS snap_p95_m, max(snap_m) AS snap_max_m, count(*) FILTER (WHERE snap_m > 2000) AS n_sobre_limite, count(*) FILTER (WHERE snap_m > 20000) AS n_sin_acceso_vial
      FROM (SELECT 'demanda' AS conjunto, snap_m FROM dem0 UNION ALL SELECT 'establecimientos', snap_m FROM fac WHERE category LIKE 'II%') GROUP BY conjunto"""
    svn = {
        "ln": "SELECT demand_id, min(straight_km) / 40e0 * 60e0 AS t_line, min_by(facility_id, straight_km * 1e6 + facility_id * 1e-9) AS near_line FROM od GROUP BY demand_id",
        "pp": """SELECT w.*, n.t_min AS t_net, n.nearest_facility, n.km_red AS net_km, o.straight_km AS line_km, d.design_weight, n.t_min IS NOT NULL AS valid, coalesce(n.km_red IS NOT NULL AND o.straight_km > 0.5, FALSE) AS far
          FROM ln w JOIN dem0 d USING (demand_id) LEFT JOIN near n USING (demand_id) LEFT JOIN od o ON o.demand_id = w.demand_id AND o.facility_id = n.nearest_facility""",
    }
    vals = {
        "n_origenes": "CAST(count(*) FILTER (WHERE valid) AS DOUBLE)", "velocidad_naif_supuesta_kmh": "max(40e0)", "mediana_min_red": "median(t_net)",
        "mediana_min_linea_recta": "median(CASE WHEN valid THEN t_line END)", "factor_desvio_tiempo_mediano": "median(t_net / greatest(t_line, 1e-6))",
        "factor_desvio_tiempo_p90": "quantile_cont(t_net / greatest(t_line, 1e-6), 0.9)", "indice_desvio_distancia_mediano": "median(CASE WHEN far THEN net_km / line_km END)",
        "indice_desvio_distancia_p90": "quantile_cont(CASE WHEN far THEN net_km / line_km END, 0.9)", "n_con_distancia_de_red": "CAST(count(*) FILTER (WHERE far) AS DOUBLE)",
        "share_cambia_establecimiento_mas_cercano": "avg(CASE WHEN valid THEN CASE WHEN nearest_facility <> near_line THEN 1e0 ELSE 0e0 END END)",
        **{f"poblacion_reclasificada_{b}min": f"sum(CASE WHEN valid AND t_line <= {b} AND t_net > {b} THEN design_weight ELSE 0 END)" for b in DEFAULT.bands},
    }
    out["straight_vs_network"] = svn, " UNION ALL ".join(f"SELECT '{k}' AS metrica, {v} AS valor FROM pp" for k, v in vals.items())
    out["cross_mode"] = {
        "nf": "SELECT * EXCLUDE (r) FROM (SELECT demand_id, minutes AS ta, facility_id AS na, row_number() OVER (PARTITION BY demand_id ORDER BY minutes, facility_id) AS r FROM foot WHERE minutes IS NOT NULL) WHERE r = 1"
    }, """SELECT 'foot' AS profile, count(*) AS n_origenes, median(t_min) AS mediana_min_auto, median(ta) AS mediana_min_foot, median(ta / nullif(t_min, 0)) AS ratio_mediano, quantile_cont(ta / nullif(t_min, 0), 0.9) AS ratio_p90,
      count(*) FILTER (WHERE na <> nearest_facility) AS n_cambia_establecimiento_mas_cercano, avg(CASE WHEN na <> nearest_facility THEN 1e0 ELSE 0e0 END) AS share_cambia
      FROM dem0 LEFT JOIN near USING (demand_id) LEFT JOIN nf USING (demand_id)"""
    sec = {
        "sz": "SELECT count(*) AS n, least(900, count(*) FILTER (WHERE area_type = 'URBANO')) AS u FROM dem0",
        "sec": """SELECT demand_id, area_type, population FROM (SELECT *, row_number() OVER (PARTITION BY area_type ORDER BY population DESC, demand_id) AS r FROM dem0), sz
          WHERE n <= 1200 OR r <= CASE WHEN area_type = 'URBANO' THEN u ELSE 1200 - u END""",
    }
    out["secondary_points"] = sec, "SELECT * FROM sec"
    out["secondary_destinations"] = sec, """SELECT DISTINCT facility_id FROM (SELECT facility_id, row_number() OVER (PARTITION BY demand_id ORDER BY minutes, facility_id) AS r FROM od JOIN sec USING (demand_id)
      WHERE minutes IS NOT NULL) WHERE r <= 15"""
    out["sfca_points"] = _SFCA, "SELECT * FROM sp"
    out["sfca_districts"] = _SFCA, "SELECT * FROM sd"
    out["sfca_summary"] = _SFCA, f"""SELECT (SELECT count(*) FROM sd) AS n_distritos, (SELECT count(*) FROM sd WHERE n_facilities_in_catchment = 0) AS n_sin_cobertura,
      (SELECT round(corr(ra, rb), 4) FROM (SELECT {_avg_rank('sfca_index_per_10k')} AS ra, {_avg_rank('t_medio_min')} AS rb FROM sd WHERE t_medio_min IS NOT NULL)) AS spearman_sfca_vs_tiempo"""
    out["sfca_lowest"] = _SFCA, "SELECT * FROM sd ORDER BY sfca_index_per_10k, ubigeo LIMIT 20"
    n_sel = "(SELECT count(*) FROM fac WHERE category IN ('I-3', 'I-4') AND facility_id % 6 = 0)"
    out["coverage_scenario"] = {}, f"""SELECT {_upto(120, 't_new')} AS poblacion_cubierta, {_upto(120, 't_new')} / {_W} AS share_cubierta, sum(CASE WHEN t_new IS NOT NULL THEN t_new * design_weight END) / sum(CASE WHEN t_new IS NOT NULL THEN design_weight END) AS t_medio_min,
      {n_sel} AS n_seleccionados, CASE WHEN {n_sel} > 0 THEN (SELECT min(m) FROM (SELECT max(minutes) AS m FROM cand GROUP BY demand_id)) ELSE 'Infinity'::DOUBLE END AS exact_below_min FROM scen"""
    out["scenario_times"] = {}, "SELECT * FROM scen"
    out["mclp_sequence"] = _POOL, """SELECT orden, facility_id, name, category, gain AS poblacion_marginal, covered + sum(gain) OVER (ORDER BY orden) AS poblacion_cubierta_acumulada FROM seq JOIN fac USING (facility_id), base"""
    out["mclp_frontier"] = _POOL, " UNION ALL ".join(_frontier(b) for b in DEFAULT.budgets)
    out["quota"] = _quota(_STRATA.format("dem0"), "300"), "SELECT * FROM quo"
    rest = f"(SELECT * FROM dem0 WHERE NOT ({_CERTAIN}))"
    slots = f"({SAMPLE.max_demand_points} - (SELECT count(*) FROM dem0 WHERE {_CERTAIN}))"
    fits = f"(SELECT count(*) FROM dem0) <= {SAMPLE.max_demand_points}"
    own = "SELECT demand_id, CAST(population AS DOUBLE) AS design_weight, '{}' AS sampling_stratum, 1e0 AS inclusion_prob FROM dem0 WHERE "
    out["pps_sample"] = _quota(_STRATA.format(rest), slots), f"""{own.format('censo_completo')} {fits} UNION ALL {own.format('certeza')} NOT {fits} AND ({_CERTAIN})
      UNION ALL SELECT demand_id, pop / CAST(quota AS DOUBLE), stratum, quota * population / CAST(pop AS DOUBLE) FROM (SELECT demand_id, population, ubigeo || '|' || area_type AS stratum,
        row_number() OVER (PARTITION BY ubigeo, area_type ORDER BY -ln({_U}) / population, demand_id) AS r FROM {rest}) JOIN quo USING (stratum) WHERE r <= quota AND NOT {fits}"""
    out["thin_districts"] = {}, "SELECT * FROM dem"
    beyond = "sum(CASE WHEN t_min IS NULL OR t_min > 60 THEN design_weight ELSE 0 END)"
    out["kpi_header"] = _ordered("o", "acc", ""), f"""SELECT * FROM (SELECT {_W} AS poblacion, {_upto(60)} / {_W} AS share_cubierta, {beyond} AS poblacion_fuera, {_MEAN} AS t_medio_min FROM acc),
      (SELECT {_q('0.5')} AS t_mediano_min FROM o), (SELECT department AS peor_departamento, district AS peor_distrito, {beyond} AS peor_fuera FROM acc GROUP BY department, district ORDER BY peor_fuera DESC, department, district LIMIT 1)"""
    out["choropleth"] = {}, f"""SELECT *, CASE WHEN t_medio_min <= 30 THEN 0 WHEN t_medio_min <= 60 THEN 1 WHEN t_medio_min <= 120 THEN 2 ELSE 3 END AS banda,
      CASE WHEN t_medio_min > 0 THEN CASE WHEN t_medio_min <= 30 THEN '≤ 30' WHEN t_medio_min <= 60 THEN '30–60' WHEN t_medio_min <= 120 THEN '60–120' ELSE '> 120' END END AS clase
      FROM (SELECT ubigeo, {_W} AS poblacion, {_MEAN} AS t_medio_min, bool_or(high_variance_district) AS alta_varianza FROM acc GROUP BY ubigeo)"""
    out["ecdf"] = _ordered("o", "acc", "natural_region"), "SELECT natural_region, v AS t_min, cw / tw AS share_acumulada FROM o"
    out["coverage_by_group"] = _group_table("area_type")
    gap_ctes = {**_ordered("o", "acc", _DIST), "oo": f"SELECT {_DIST}, {_q('0.9')} AS t_p90_min FROM o GROUP BY {_DIST}"}
    out["ranked_gaps"] = gap_ctes, f"""SELECT *, 1 - fuera / poblacion AS cobertura FROM (SELECT {_DIST}, {_W} AS poblacion, {_MEAN} AS t_medio_min, {beyond} AS fuera, count(*) AS n_puntos, bool_or(high_variance_district) AS alta_varianza,
      median(altitude_m) AS altitud_m FROM acc GROUP BY {_DIST} ORDER BY fuera DESC, ubigeo LIMIT 25) LEFT JOIN oo USING ({_DIST})"""
    ctes, body = _level("department")
    out["department_table"] = ctes, f"SELECT *, share_hasta_30min * 100 AS pct_hasta_30min, share_hasta_60min * 100 AS pct_hasta_60min FROM ({body})"
    out["access_vs_altitude"] = {**dm, **_CTX}, """SELECT dm.ubigeo, t_medio_min, poblacion, altitude_m, rural_share, r.natural_region FROM dm LEFT JOIN (SELECT ubigeo, altitude_m, rural_share FROM ctx) USING (ubigeo)
      LEFT JOIN (SELECT ubigeo, natural_region, row_number() OVER (PARTITION BY ubigeo ORDER BY count(*) DESC, natural_region) AS k FROM acc GROUP BY ubigeo, natural_region) r ON r.ubigeo = dm.ubigeo AND k = 1"""
    out["top_groups"] = {}, f"SELECT * FROM (SELECT province, {_W} AS poblacion, row_number() OVER (ORDER BY {_W} DESC, province) AS rank FROM acc GROUP BY province) WHERE rank <= 3"
    out["filtered_view"] = {}, "SELECT * FROM acc WHERE department IN ('ASIA', 'EUROPE') AND area_type = 'RURAL' AND NOT high_variance_district"
    raw = "CAST(p_partkey AS VARCHAR)"
    pad = lambda n: f"CASE WHEN length({raw}) < {n} THEN lpad({raw}, {n}, '0') ELSE {raw} END"
    dot = "  ·  "
    out["padded_ids"] = {}, f"""SELECT p_partkey, {pad(6)} AS ubigeo, {pad(8)} AS code, substr({pad(10)}, 1, 6) AS district,
      array_to_string(list_transform(string_split(lower(p_name), ' '), lambda x: upper(x[1]) || x[2:]), ' ') || '{dot}' || CASE WHEN p_partkey % 5 <> 0 THEN p_type ELSE 'sin dato' END || '{dot}' || p_brand || ', sin dato{dot}' || {raw} AS label FROM part"""
    k = "demand_id"
    lon0, lat0 = f"CASE WHEN {k} % 5 = 0 THEN lat WHEN {k} % 7 = 0 THEN 0e0 WHEN {k} % 11 = 0 THEN 10e0 ELSE lon END", f"CASE WHEN {k} % 5 = 0 THEN lon WHEN {k} % 13 = 0 THEN NULL ELSE lat END"
    fix = {
        "c0": f"SELECT demand_id, {lon0} AS x, {lat0} AS y FROM dem0",
        "c1": f"SELECT *, x IS NULL OR y IS NULL OR coalesce(x = 0, FALSE) OR coalesce(y = 0, FALSE) AS missing, coalesce({_in('x', 'y')}, FALSE) AS direct, coalesce({_in('y', 'x')}, FALSE) AS other FROM c0",
        "c2": "SELECT *, NOT missing AND NOT direct AND other AS swapped, NOT missing AND NOT direct AND NOT other AS outside FROM c1",
    }
    out["coordinates"] = fix, "SELECT demand_id, CASE WHEN NOT missing AND NOT outside THEN CASE WHEN swapped THEN y ELSE x END END AS lon, CASE WHEN NOT missing AND NOT outside THEN CASE WHEN swapped THEN x ELSE y END END AS lat, missing, swapped, outside FROM c2"
    out["coordinate_columns"] = {"pl": _PLACES}, """SELECT CASE WHEN s > l THEN 'Longitud (coord Y)' ELSE 'Latitud (coord X)' END AS lat_column, CASE WHEN s > l THEN 'Latitud (coord X)' ELSE 'Longitud (coord Y)' END AS lon_column, l AS as_labeled, s AS as_swapped
      FROM (SELECT avg(CASE WHEN lat BETWEEN -81.4e0 AND -68.6e0 THEN 1e0 ELSE 0e0 END) + avg(CASE WHEN lon BETWEEN -18.4e0 AND -0.04e0 THEN 1e0 ELSE 0e0 END) AS l,
        avg(CASE WHEN lon BETWEEN -81.4e0 AND -68.6e0 THEN 1e0 ELSE 0e0 END) + avg(CASE WHEN lat BETWEEN -18.4e0 AND -0.04e0 THEN 1e0 ELSE 0e0 END) AS s FROM pl)"""
    tol = f"{DEFAULT.polygon_tolerance_deg}e0"
    dx, dy = "greatest(x0 - lon, lon - x0 - 2.56e0, 0e0)", "greatest(y0 - lat, lat - y0 - 3.672e0, 0e0)"
    out["point_in_district"] = {}, f"SELECT demand_id, TRUE AS district_polygon_available, NOT sqrt({dx} * {dx} + {dy} * {dy}) <= {tol} AS point_outside_declared_district FROM dem0 JOIN dist USING (ubigeo)"
    pl = {
        "pl": _PLACES,
        "pl1": f"""SELECT *, lon IS NULL OR lat IS NULL OR lon = 0 OR lat = 0 AS missing, coalesce({_in('lon', 'lat')}, FALSE) AS direct, coalesce({_in('lat', 'lon')}, FALSE) AS other,
          department <> 'NOWHERE' AS scope FROM pl""",
        "plf": """SELECT *, NOT missing AND NOT direct AND other AS swapped, NOT missing AND NOT direct AND NOT other AS outside, scope AND NOT missing AND (direct OR other) AS located,
          substr(ccpp_code, 1, 6) IN (SELECT ubigeo FROM dist) AS polygon FROM pl1""",
    }
    out["clean_places"] = pl, f"""SELECT 'CP' || lpad(CAST(row_number() OVER (ORDER BY k) AS VARCHAR), 6, '0') AS demand_id, ccpp_code, substr(ccpp_code, 1, 6) AS ubigeo, name, population, is_capital, area_type,
      CASE department WHEN 'SAN MARTIN' THEN 'selva' ELSE 'sierra' END AS natural_region FROM plf WHERE population > 0 AND located"""
    out["register_counters"] = pl, """SELECT (SELECT count(*) FROM supplier) AS facilities_rows_raw, count(*) AS places_rows_raw,
      CAST(coalesce(sum(CASE WHEN scope AND NOT located THEN population END), 0) AS BIGINT) AS places_population_unlocatable, count(*) FILTER (WHERE located AND population > 0) AS places_valid,
      CAST(coalesce(sum(CASE WHEN located THEN population END), 0) AS BIGINT) AS places_population_total FROM plf"""
    out["haversine_pairs"] = {}, "SELECT * FROM od"
    out["road_edges"] = _WAYS, "SELECT * FROM edges"
    out["scope_box"] = {}, """SELECT min(lat) - 0.15e0 AS south, min(lon) - 0.15e0 AS west, max(lat) + 0.15e0 AS north, max(lon) + 0.15e0 AS east
      FROM (SELECT lon, lat FROM dem0 UNION ALL SELECT lon, lat FROM fac WHERE category LIKE 'II%')"""
    out["facility_markers"] = {}, "SELECT * FROM fac WHERE category IN ('II-1', 'I-3') ORDER BY facility_id LIMIT 3000"
    key = "printf('%.5f,%.5f', lat, lon)"
    height = {"ele": f"SELECT {key} AS pk, max(CAST(demand_id % 4000 AS DOUBLE)) AS m FROM dem0 WHERE demand_id % 5 <> 0 GROUP BY 1"}
    out["elevations"] = height, f"SELECT demand_id, m AS altitude_m FROM (SELECT demand_id, {key} AS pk FROM dem0) LEFT JOIN ele USING (pk)"
    out["missing_elevations"] = height, f"SELECT DISTINCT {key} AS point_key FROM dem0 WHERE {key} NOT IN (SELECT pk FROM ele)"
    every = {**_WAYS, "pts": _WAYS["pts"].replace(" WHERE fclass <> 'footway'", "")}
    out["ways_in_scope"] = every, """SELECT DISTINCT way_id, fclass FROM pts, (SELECT min(lat) - 0.15e0 AS a, min(lon) - 0.15e0 AS b, max(lat) + 0.15e0 AS c, max(lon) + 0.15e0 AS d FROM fac WHERE category LIKE 'II%')
      WHERE lon BETWEEN b AND d AND lat BETWEEN a AND c"""
    out["geojson_ways"] = every, "SELECT way_id, fclass, 4 AS n, lon, lat FROM pts WHERE pos = 3"
    out["geojson_polygons"] = {}, "SELECT ubigeo, department, district, area_sqkm, 4 AS n, x0 + 2.56e0 AS x, y0 + 3.672e0 AS y FROM dist"
    out["csv_register"] = {}, "SELECT CAST(n_nationkey AS VARCHAR) AS clave, n_name || ' Ñandú; \"x\"' AS nombre FROM nation"
    out["header_register"] = {}, "SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS ubigeo, CAST(n_nationkey * 7 AS VARCHAR) AS habitantes FROM nation"
    out["output_ids"] = {}, "SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS ubigeo, CAST(n_nationkey % 3 AS VARCHAR) AS n FROM nation"
    out["od_sink"] = {}, "SELECT 'car' AS profile, demand_id, facility_id, CAST(minutes AS FLOAT) AS minutes, CAST(km AS FLOAT) AS km, imputed FROM od"
    out["line_codec"] = every, "SELECT way_id, string_agg(printf('%.6f,%.6f', lon, lat), ';' ORDER BY pos) AS line, 4 AS n_points FROM pts GROUP BY way_id"
    out["snapped"] = {
        **_WAYS, "nds": "SELECT node, CAST(split_part(node, ',', 1) AS DOUBLE) / 1e6 AS nlon, CAST(split_part(node, ',', 2) AS DOUBLE) / 1e6 AS nlat FROM (SELECT a AS node FROM edges UNION SELECT b FROM edges)",
        "prx": "SELECT demand_id, lon, lat, node, nlon, nlat, row_number() OVER (PARTITION BY demand_id ORDER BY (lon - nlon) ** 2 + (lat - nlat) ** 2, node) AS r FROM dem0 CROSS JOIN nds",
    }, f"SELECT demand_id, node, {_km('lon', 'lat', 'nlon', 'nlat')} * 1000 AS snap_m FROM prx WHERE r = 1"
    out["facility_counters"] = _REGISTER, """SELECT count(*) AS facilities_in_scope, count(*) FILTER (WHERE res) AS facilities_resolutive_by_category, count(*) FILTER (WHERE res AND operational) AS facilities_resolutive,
      count(*) FILTER (WHERE res AND NOT operational) AS resolutive_not_operational, CAST(0 AS BIGINT) AS resolutive_without_coordinates, count(*) FILTER (WHERE res AND operational AND recovered) AS resolutive_recovered,
      count(*) FILTER (WHERE up AND operational) AS upgrade_candidates FROM rec"""
    ax, ay = "greatest(x0 - x, x - x0 - 2.56e0, 0e0)", "greatest(y0 - y, y - y0 - 3.672e0, 0e0)"
    before = {"encoding": "nombre LIKE '%Ã%'", "lossy characters": "nombre LIKE '%a?b%'", "duplicate codes": "k <> first"}
    after = {
        "not operational": "NOT operational", "invalid category": "cat = '0'", "missing coordinates": "missing", "swapped coordinates": "swapped", "outside the box": "outside",
        "outside the declared district": f"NOT recovered AND NOT sqrt({ax} * {ax} + {ay} * {ay}) <= {tol}", "district without polygon": "FALSE",
    }
    line = "SELECT '{}' AS \"check\", 'renipress' AS dataset, count(*) FILTER (WHERE {}) AS n_affected, count(*) AS n_total FROM {}"
    rows = [line.format(c, t, "(SELECT *, min(k) OVER (PARTITION BY code) AS first FROM raw)") for c, t in before.items()] + [line.format(c, t, "rec") for c, t in after.items()]
    rows.append("SELECT 'recovered coordinates', 'renipress', count(*) FILTER (WHERE recovered), greatest(count(*) FILTER (WHERE missing OR outside), 1) FROM rec")
    facility_rows = list(rows)
    line2 = "SELECT '{}' AS \"check\", '{}' AS dataset, count(*) FILTER (WHERE {}) AS n_affected, count(*) AS n_total FROM {}"
    places_rows = [
        line2.format("polygons in scope", "boundaries", "FALSE", "dist"), line2.format("outside the scope", "renipress", "dep = 'NOWHERE'", "(SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY code ORDER BY k) = 1)"),
        line2.format("orientation of the columns", "ccpp", "TRUE", "plf"), line2.format("class by population", "ccpp", "NOT has_class", "plf"), line2.format("outside the scope", "ccpp", "NOT scope", "plf"),
        *[line2.format(n, "ccpp", c, "plf WHERE scope") for n, c in (("missing coordinates", "missing"), ("swapped coordinates", "swapped"), ("outside the box", "outside"))],
        *[line2.format(n, "ccpp", c, "plf WHERE located") for n, c in (("outside the declared district", "polygon AND FALSE"), ("district without polygon", "NOT polygon"), ("no population", "population <= 0"))],
        "SELECT 'sampled points', 'demand_sample', (SELECT count(*) FROM smp), (SELECT count(*) FROM dem0)",
        line2.format("districts of high variance", "demand_sample", f"n < {THIN.min_points_per_district} AND share < {THIN.min_direct_coverage}e0", "thn"),
    ]
    drawn, body = out["pps_sample"]
    places_ctes = {
        **_REGISTER, **pl, **drawn, "smp": body,
        "thn": """SELECT ubigeo, count(*) AS n, coalesce(sum(CASE WHEN sampling_stratum IN ('certeza', 'censo_completo') THEN population END), 0) / max(pop_all) AS share
          FROM smp JOIN dem0 USING (demand_id) JOIN (SELECT ubigeo, CAST(sum(population) AS DOUBLE) AS pop_all FROM dem0 GROUP BY ubigeo) USING (ubigeo) GROUP BY ubigeo""",
    }
    share = "SELECT *, round(CASE WHEN n_total > 0 THEN n_affected / CAST(n_total AS DOUBLE) END, 6) AS share_affected FROM ({})"
    out["places_audit"] = places_ctes, share.format(" UNION ALL ".join(places_rows))
    out["quality_table"] = places_ctes, share.format(" UNION ALL ".join(facility_rows + places_rows)) + " WHERE n_affected > 0"
    out["facility_audit"] = _REGISTER, f"SELECT *, round(CASE WHEN n_total > 0 THEN n_affected / CAST(n_total AS DOUBLE) END, 6) AS share_affected FROM ({' UNION ALL '.join(rows)})"
    relax = {
        **_WAYS, "arc": "SELECT a, b, seconds FROM edges UNION ALL SELECT b, a, seconds FROM edges",
        "src": "SELECT unnest(['-80000000,-15000000', '-78000000,-14500000']) AS target",
        "sp (target, node, seconds) USING KEY (target, node)": """SELECT target, target, 0e0 FROM src WHERE target IN (SELECT a FROM arc)
          UNION SELECT * FROM (SELECT s.target, arc.b AS node, min(s.seconds + arc.seconds) AS seconds FROM sp s JOIN arc ON s.node = arc.a GROUP BY s.target, arc.b) n
          WHERE NOT EXISTS (SELECT 1 FROM recurring.sp o WHERE o.target = n.target AND o.node = n.node AND o.seconds <= n.seconds)""",
    }
    snaps = {
        **out["snapped"][0], "osn": out["snapped"][1],
        "fsn": """SELECT facility_id, node AS target FROM (SELECT facility_id, node, row_number() OVER (PARTITION BY facility_id ORDER BY (lon - nlon) ** 2 + (lat - nlat) ** 2, node) AS r
          FROM fac CROSS JOIN nds WHERE category LIKE 'II%') WHERE r = 1""",
        "src": "SELECT DISTINCT target FROM fsn",
    }
    reach = {**snaps, **{k: v for k, v in relax.items() if k not in snaps}}
    out["graph_od"] = {
        **reach, "knw": "SELECT demand_id, facility_id, seconds / 60 AS route, snap_m FROM sp JOIN osn USING (node) JOIN fsn USING (target)",
        "ksn": "SELECT demand_id, min(snap_m) AS s FROM knw GROUP BY demand_id",
    }, f"""SELECT d.demand_id, f.facility_id, 'car' AS profile, k.route IS NULL AND NOT coalesce(s > 20000, FALSE) AS imputed,
      CASE WHEN s > 20000 THEN NULL WHEN k.route IS NULL THEN {_km('d.lon', 'd.lat', 'f.lon', 'f.lat')} * 1.35e0 / 25e0 * 60e0 ELSE k.route END AS minutes
      FROM dem0 d CROSS JOIN fac f LEFT JOIN knw k ON k.demand_id = d.demand_id AND k.facility_id = f.facility_id LEFT JOIN ksn ON ksn.demand_id = d.demand_id WHERE f.category LIKE 'II%'"""  # fmt: skip
    out["road_times"] = out["road_times_relaxed"] = relax, "SELECT * FROM sp"
    x = "text"
    pieces = f"regexp_extract_all(lower({x}), '[\\p{{L}}]+|[^\\p{{L}}]+')"
    out["text_names"] = {}, f"""SELECT doc_id, trim(regexp_replace(upper(replace(strip_accents({x}), 'ß', 'SS')), '\\s+', ' ', 'g')) AS norm,
      array_to_string(list_transform({pieces}, lambda p: CASE WHEN p[1] = 'ß' THEN 'Ss' ELSE upper(p[1]) END || p[2:]), '') AS titled, regexp_matches(text, 'Ã.|Â.|ï¿½|�') AS twice_encoded, regexp_matches(text, '[A-Za-z]\\?[A-Za-z]|^\\?[A-Za-z]') AS lossy FROM documents"""
    return out


def _needed(ctes: dict, body: str) -> dict:
    """The shared expressions that a query uses, in order."""
    import re

    everything = {**_BASE, **ctes}
    todo, seen = [body], set()
    while todo:
        for word in set(re.findall(r"[a-z_0-9]+", todo.pop())):
            if word in everything and word not in seen:
                seen.add(word)
                todo.append(everything[word])
    return {k: v for k, v in everything.items() if k in seen}


def _sql(name: str, ctes: dict, body: str, exact: bool = False) -> str:
    """A query's SQL; ``exact`` leaves its doubles unrounded."""
    needed = _needed({k.split(" ")[0]: v for k, v in ctes.items()}, body)
    full = {k.split(" ")[0]: k for k in ctes}
    head = ",\n".join(f"{full.get(k, k)} AS ({v})" for k, v in needed.items())
    if any("(" in k for k in ctes):
        head = f"RECURSIVE {head}"
    columns = []
    for item in COLUMNS[name].split():
        c, _, digits = item.partition(":")
        quoted = f'"{c}"' if c == "check" else c
        columns.append(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" if digits and not exact else quoted)
    return (f"WITH {head}\n" if head else "") + f"SELECT {', '.join(columns)} FROM ({body}) result"


def _kpis(queries: dict) -> str:
    """The formatted figures from the other queries' results, these not rounded before."""
    thousands, one = "format('{{:,}}', CAST(round({}) AS BIGINT))".format, "printf('%.1f', {})".format
    whole, title = "CAST(CAST({} AS BIGINT) AS VARCHAR)".format, "array_to_string(list_transform(regexp_extract_all(lower({}), '[\\p{{L}}]+|[^\\p{{L}}]+'), lambda p: upper(p[1]) || p[2:]), '')".format
    parts = {
        "nat": "access_by_nation", "ine": "inequality", "con": "urban_rural", "wor": "worst_districts", "com": "straight_vs_network", "fro": "mclp_frontier",
        "cha": "temporal_change", "cou": "facility_counters", "reg": "register_counters",
    }
    rows = [("nat", k, v) for k, v in {
        "PoblacionTotal": thousands("poblacion"), "TiempoMedio": one("t_medio_min"), "TiempoMediano": one("t_mediano_min"), "TiempoPnoventa": one("t_p90_min"),
        "ShareMas120": one("share_mas_120min * 100"), "PobMas120": thousands("pob_mas_120min"),
        **{f"ShareHasta{b}": one(f"share_hasta_{b}min * 100") for b in DEFAULT.bands}, **{f"PobHasta{b}": thousands(f"pob_hasta_{b}min") for b in DEFAULT.bands},
    }.items()]
    rows += [("ine", k, f"printf('%.3f', {c})") for k, c in (("Gini", "gini_tiempo_acceso"), ("GiniUrbano", "gini_urbano"), ("GiniRural", "gini_rural"))]
    top = "(SELECT * FROM wor ORDER BY pob_fuera_umbral DESC, ubigeo LIMIT 1)"
    rows += [(top, "PeorDistrito", title("district")), (top, "PeorDistritoDep", title("department")), (top, "PeorDistritoPob", thousands("pob_fuera_umbral"))]
    figure = "(SELECT valor FROM com WHERE metrica = '{}')".format
    rows += [
        ("(SELECT 1)", "IndiceDesvio", f"printf('%.2f', {figure('indice_desvio_distancia_mediano')})"), ("(SELECT 1)", "PobReclasificada", thousands(figure("poblacion_reclasificada_60min"))),
        ("(SELECT 1)", "ShareCambiaCercano", one(figure("share_cambia_establecimiento_mas_cercano") + " * 100")),
    ]
    for f, end in (("min", ""), ("max", "Max")):
        row = f"(SELECT * FROM fro WHERE presupuesto = (SELECT {f}(presupuesto) FROM fro))"
        rows += [(row, f"MclpPresupuesto{end}", whole("presupuesto")), (row, f"MclpGanancia{end}", thousands("ganancia_vs_base"))]
    rows += [
        ("cha", "TemporalAnioIni", whole("anio_inicial")), ("cha", "TemporalAnioFin", whole("anio_final")), ("cha", "TemporalDelta", "printf('%+.1f', cambio_cobertura * 100)"),
        ("cha", "TemporalNuevos", whole("resolutivas_nuevas")),
    ]
    rows += [(t, "Q" + "".join(x.capitalize() for x in c.split("_")), thousands(c)) for t, q in (("cou", "facility_counters"), ("reg", "register_counters")) for c in COLUMNS[q].split()]
    said = " UNION ALL ".join(f"SELECT '{k}' AS kpi, {v} AS valor FROM {t}" for t, k, v in rows)
    reached = "sum(t_medio_min * poblacion_con_ruta) / sum(CASE WHEN t_medio_min IS NOT NULL THEN poblacion_con_ruta END)"
    said += f" UNION ALL SELECT 'TiempoMedio' || upper(area_type[1]) || lower(area_type[2:]), {one(reached)} FROM con GROUP BY area_type"
    return "WITH " + ", ".join(f"{k} AS MATERIALIZED ({_sql(q, *queries[q], exact=True)})" for k, q in parts.items()) + f" SELECT kpi, valor FROM ({said}) x"


_QUERIES = _queries()
ORACLES = {name: _sql(name, *parts) for name, parts in _QUERIES.items()} | {"kpis": _kpis(_QUERIES)}
