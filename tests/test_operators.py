"""Operators on small tables: invariants and re-derivations."""

import heapq
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayreach import catalog
from wayreach.conf import DEFAULT
from wayreach.operators import graph, models, od, sampling, validation
from wayreach.plans import metrics, views
from wayreach.plans.lineage import cut
from wayreach.sources import files, star


def shares(spark, strata, slots):
    df = spark.createDataFrame(strata, "stratum string, pop long, size long")
    return {r.stratum: r.quota for r in sampling.quota(df, slots).collect()}


def one_by_one(strata, slots):
    held, left = {s: 0 for s, _, _ in strata}, slots
    for s, _, size in sorted(strata, key=lambda x: (-x[1], x[0])):
        if left > 0 and size >= 1:
            held[s], left = 1, left - 1
    heap = [(-p / (2 * held[s] + 1), s, p, z) for s, p, z in strata if held[s] < z and p > 0]
    heapq.heapify(heap)
    while left > 0 and heap:
        _, s, p, z = heapq.heappop(heap)
        held[s], left = held[s] + 1, left - 1
        if held[s] < z:
            heapq.heappush(heap, (-p / (2 * held[s] + 1), s, p, z))
    return held


def test_quota_equals_awarding_one_by_one(spark):
    r = random.Random(5)
    for slots in (2, 10, 37, 400):
        strata = [(f"s{i:02d}", r.choice([0, 1, 10, 500, 1000, 7777]), r.randint(1, 30)) for i in range(20)]
        assert shares(spark, strata, slots) == one_by_one(strata, slots)


def test_quota_invariants(spark):
    got = shares(spark, [("a", 1000, 50), ("b", 500, 50), ("c", 10, 50)], 100)
    assert sum(got.values()) == 100 and got["a"] >= got["b"] >= got["c"] >= 1
    assert sum(shares(spark, [("a", 9, 3), ("b", 9, 2), ("c", 9, 1)], 100).values()) == 6
    assert shares(spark, [("a", 10000, 5), ("b", 100, 5), ("c", 1, 5)], 2)["c"] == 0


def test_sample_weights_stand_for_the_universe(spark, sf):
    universe = star.demand(spark, sf)
    conf = replace(DEFAULT, max_demand_points=90, certainty_population=9000)
    sample = sampling.sample_demand(universe, conf).cache()
    total = universe.agg(F.sum("population")).first()[0]
    assert sample.count() == 90 and sample.agg(F.sum("design_weight")).first()[0] == pytest.approx(total, rel=0.2)
    whole = sampling.sample_demand(universe, DEFAULT)
    assert whole.agg(F.sum("design_weight")).first()[0] == total and {r[0] for r in whole.select("sampling_stratum").distinct().collect()} == {"censo_completo"}


@pytest.fixture(scope="module")
def access(spark, sf):
    return cut(catalog.access(spark, sf))


def test_levels_add_up(access):
    nation = metrics.level_metrics(access, "national").first()
    for level in ("district", "province", "department", "natural_region"):
        rows = metrics.level_metrics(access, level).collect()
        for c in ("poblacion", "n_puntos", "poblacion_sin_ruta", "pob_hasta_60min", "pob_mas_120min"):
            assert sum(r[c] for r in rows) == pytest.approx(nation[c])
        reached = [(r.t_medio_min, r.poblacion - r.poblacion_sin_ruta) for r in rows if r.t_medio_min is not None]
        assert sum(t * w for t, w in reached) / sum(w for _, w in reached) == pytest.approx(nation.t_medio_min)


def test_worst_districts_are_ranked(access):
    worst = metrics.worst_districts(access, metrics.level_metrics(access, "district")).collect()
    assert [r.rank_por_poblacion for r in worst] == sorted(r.rank_por_poblacion for r in worst) and worst[0].rank_por_poblacion == 1


def test_nearest_takes_the_first_of_equals_and_null_rows(spark):
    rows = [(1, 20, 30.0, 1.0), (1, 10, 12.0, 2.0), (2, 10, None, 3.0), (2, 20, None, 4.0), (3, 20, 5.0, None), (3, 10, 5.0, 9.0)]
    got = {r.demand_id: tuple(r)[1:] for r in od.nearest(spark.createDataFrame(rows, "demand_id int, facility_id int, minutes double, km double")).collect()}
    assert got == {1: (12.0, 10, 2.0), 2: (None, None, None), 3: (5.0, 10, 9.0)}


def test_fallback_policy(spark):
    rows = [(1, 100.0, None, None), (2, 30000.0, 50.0, 40.0), (3, None, None, 7.0), (4, 10.0, 60.0, 55.0)]
    df = spark.createDataFrame(rows, "demand_id int, snap_m double, route_minutes double, route_km double").withColumn("straight_km", F.lit(25.0))
    got = {r.demand_id: (r.minutes, r.km, r.imputed) for r in od.with_fallback(df).collect()}
    assert got == {1: (81.0, None, True), 2: (None, None, False), 3: (81.0, 7.0, True), 4: (60.0, 55.0, False)}


SCENARIO = ([("p1", 90.0, 100.0), ("p2", 120.0, 200.0), ("p3", 20.0, 300.0), ("p4", None, 50.0)], [("p1", "A", 40.0), ("p1", "B", 80.0), ("p2", "A", 25.0), ("p4", "B", 15.0)])


@pytest.fixture(scope="module")
def scenario(spark):
    a = spark.createDataFrame(SCENARIO[0], "demand_id string, t_min double, design_weight double")
    return a, spark.createDataFrame(SCENARIO[1], "demand_id string, facility_id string, minutes double")


def covered(spark, scenario, chosen, threshold):
    picked = spark.createDataFrame([(c,) for c in chosen], "facility_id string")
    return models.coverage(*scenario, picked, threshold).first()


def test_scenarios_only_gain(spark, scenario):
    got = [covered(spark, scenario, c, 60.0).poblacion_cubierta for c in ([], ["B"], ["A", "B"])]
    assert got == [300.0, 350.0, 650.0] and covered(spark, scenario, ["A"], 30.0).poblacion_cubierta == 500.0
    assert covered(spark, scenario, [], 60.0).exact_below_min == float("inf") and covered(spark, scenario, ["A"], 60.0).exact_below_min == 15.0


def test_greedy_cover_gains_fall(spark, scenario):
    frontier, sequence = models.mclp(*scenario, cut, replace(DEFAULT, budgets=(1, 2, 5)))
    steps = sequence.orderBy("orden").collect()
    assert [(r.facility_id, r.poblacion_marginal) for r in steps] == [("A", 300.0), ("B", 50.0)]
    rows = frontier.orderBy("presupuesto").collect()
    assert [r.ganancia_vs_base for r in rows] == [300.0, 350.0, 350.0] and all(r.cota_superior_optimo >= r.poblacion_cubierta for r in rows)


def test_catchment_shares_out_supply(spark, access, sf):
    roads = catalog.road_table(spark, sf)
    conf = replace(DEFAULT, catchment_minutes=400.0)
    points = models.sfca_points(access, roads, star.facilities(spark, sf), conf).collect()
    near = [r for r in roads.where("minutes <= 400").collect()]
    supply = {r.facility_id: DEFAULT.capacity[r.category] for r in star.facilities(spark, sf).where("is_resolutive").collect()}
    reached = {r.facility_id for r in near}
    assert sum(r.sfca_index * r.design_weight for r in points) == pytest.approx(sum(supply[f] for f in reached))


def lattice(spark, n=6):
    ways, k = [], 0
    rng = np.random.default_rng(1)
    classes = ["primary", "secondary", "residential", "unheard_of"]
    for i in range(n):
        for j in range(n):
            for di, dj in ((1, 0), (0, 1)):
                if i + di < n and j + dj < n:
                    a, b = (i * 0.1, j * 0.1), ((i + di) * 0.1, (j + dj) * 0.1)
                    middle = ((a[0] + b[0]) / 2 + 0.01, (a[1] + b[1]) / 2)
                    ways.append((k, classes[int(rng.integers(4))], [a, middle, middle, b]))
                    k += 1
    ways.append((k, "footway", [(0.0, 0.0), (0.5, 0.5)]))
    ways.append((k + 1, "primary", [(9.0, 9.0)]))
    ways.append((k + 2, "primary", ways[0][2]))
    return spark.createDataFrame(ways, "way_id long, fclass string, coords array<struct<lon: double, lat: double>>")


def test_road_graph_and_shortest_times(spark):
    edges = cut(graph.road_edges(graph.clean_ways(lattice(spark))))
    rows = edges.collect()
    # Doubled vertices are crossings too: each way has a node in its middle.
    assert len({x for r in rows for x in (r.a, r.b)}) == 36 + 60 and all(r.a < r.b for r in rows)
    near = {}
    for r in rows:
        near.setdefault(r.a, []).append((r.b, r.seconds))
        near.setdefault(r.b, []).append((r.a, r.seconds))
    best, heap = {"0,0": 0.0}, [(0.0, "0,0")]
    while heap:
        t, u = heapq.heappop(heap)
        for v, s in near[u]:
            if t + s < best.get(v, 1e18):
                best[v] = t + s
                heapq.heappush(heap, (t + s, v))
    target = spark.createDataFrame([("0,0",), ("nowhere",)], "target string")
    for limit in (5_000_000, 0):
        got = {r.node: r.seconds for r in graph.shortest_times(edges, target, limit).collect()}
        assert got.keys() == best.keys() and all(got[k] == pytest.approx(best[k]) for k in best)


def test_snap_finds_the_nearest_node(spark):
    rng = np.random.default_rng(0)
    nodes = [(f"n{i:03d}", float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5, 5, (60, 2)))]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-40, 40, (40, 2)))]
    got = graph.snap(spark.createDataFrame(points, "demand_id long, lon double, lat double"), spark.createDataFrame(nodes, "node string, lon double, lat double"), "demand_id")
    expected = {i: min(nodes, key=lambda n: ((n[1] - x) ** 2 + (n[2] - y) ** 2, n[0]))[0] for i, x, y in points}
    assert {r.demand_id: r.node for r in got.collect()} == expected


def test_od_from_graph_has_every_reached_pair(spark):
    edges = cut(graph.road_edges(graph.clean_ways(lattice(spark))))
    o = spark.createDataFrame([(1, 0.01, 0.0), (2, 0.5, 0.49)], "demand_id long, lon double, lat double")
    d = spark.createDataFrame([(7, 0.0, 0.0)], "facility_id long, lon double, lat double")
    got = {r.demand_id: r.route_minutes for r in graph.od_from_graph(o, d, edges).collect()}
    assert got[1] == 0 and got[2] > 0


def test_register_keeps_the_first_of_a_code(spark, sf):
    rows = validation.first_by_key(catalog.register(spark, sf), ["COD_IPRESS"], "ordinal").collect()
    assert len({r.COD_IPRESS for r in rows}) == len(rows)


def test_facility_register_on_known_rows(spark, sf):
    base = {"DIRECCION": "x", "INSTITUCION": "MINSA", "PROVINCIA": "p", "DISTRITO": "d", "SITUACION": "REGISTRADO", "CONDICION": "ACTIVO"}
    rows = [
        {"ordinal": 1, "COD_IPRESS": "1", "NOMBRE": "a", "DEPARTAMENTO": " piura", "UBIGEO": "0", "CATEGORIA": "II-1", "ESTADO": "activo", "NORTE": "-18,0", "ESTE": "-81.0"},
        {"ordinal": 2, "COD_IPRESS": "1", "NOMBRE": "again", "DEPARTAMENTO": "PIURA", "UBIGEO": "0", "CATEGORIA": "II-1", "ESTADO": "ACTIVO", "NORTE": "1", "ESTE": "1"},
        {"ordinal": 3, "COD_IPRESS": "3", "NOMBRE": "b", "DEPARTAMENTO": "LORETO", "UBIGEO": "1", "CATEGORIA": "I-3", "ESTADO": "CERRADO", "NORTE": "0", "ESTE": "-81.0"},
        {"ordinal": 4, "COD_IPRESS": "4", "NOMBRE": "c", "DEPARTAMENTO": "LORETO", "UBIGEO": "99", "CATEGORIA": "II-2", "ESTADO": None, "NORTE": "-80", "ESTE": "-10"},
        {"ordinal": 5, "COD_IPRESS": "5", "NOMBRE": "d", "DEPARTAMENTO": "ELSEWHERE", "UBIGEO": "1", "CATEGORIA": "II-2", "ESTADO": "ACTIVO", "NORTE": "1", "ESTE": "1"},
    ]
    raw = spark.createDataFrame([{**base, **r} for r in rows], "ordinal long, " + ", ".join(f"{c} string" for c in [*base, *[k for k in rows[0] if k != "ordinal"]]))
    got = {r.COD_IPRESS: r for r in validation.clean_facilities(raw, star.districts(spark, sf)).collect()}
    assert set(got) == {"1", "3", "4"}
    assert got["1"].is_resolutive and got["1"].NOMBRE == "a" and not got["1"].point_outside_declared_district
    assert got["3"].coord_missing_raw and got["3"].coord_recovered and got["3"].has_coords and not got["3"].is_operational
    assert got["4"].coord_swapped and (got["4"].lon, got["4"].lat) == (-80.0, -10.0) and not got["4"].district_polygon_available


def test_swapped_headers_are_noticed(spark):
    raw = spark.createDataFrame([("-77.0", "-12.0"), ("-76.5", "-11,5"), ("x", "-10")], "a string, b string")
    got = validation.coordinate_columns(raw, "a", "b").first()
    assert (got.lat_column, got.lon_column) == ("b", "a")


def test_numbers_follow_the_order_across_blocks(spark):
    df = spark.createDataFrame([(i * 7,) for i in range(50)], "ordinal long").repartition(4)
    got = validation.numbered(df, "ordinal", "n", "CP", 6, block=40).orderBy("ordinal").collect()
    assert [r.n for r in got] == [f"CP{i + 1:06d}" for i in range(50)]


def test_bands_and_filters(spark, access):
    df = spark.createDataFrame([(0.0,), (30.0,), (30.1,), (120.0,), (500.0,), (None,)], "t double")
    got = df.select(views.band_class(F.col("t")).alias("i"), views.band_label(F.col("t")).alias("c")).collect()
    assert [r.i for r in got] == [0, 0, 1, 2, 3, 3] and [r.c for r in got] == [None, "≤ 30", "30–60", "60–120", "> 120", None]
    assert views.filtered(access).count() == access.count()
    assert {r[0] for r in views.filtered(access, areas=("RURAL",)).select("area_type").distinct().collect()} == {"RURAL"}


def test_csv_encodings_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("UBIGEO;NOMBRE\n010101;Ñandú\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("﻿UBIGEO;NOMBRE\n010101;Ñandú\n".encode())
    for name, encoding in (("a.csv", "latin-1"), ("b.csv", "utf-8")):
        path = str(tmp_path / name)
        assert files.find_encoding(spark, path) == encoding
        assert files.read_csv(spark, path).collect()[0].asDict() == {"UBIGEO": "010101", "NOMBRE": "Ñandú"}
    raw = spark.createDataFrame([(0, "Título", None), (1, "UBIGEO", "  Habitantes\ntotal"), (2, "0101", "5")], "ordinal long, c0 string, c1 string")
    assert files.with_header(raw, "ordinal").collect()[0].asDict() == {"ordinal": 2, "UBIGEO": "0101", "Habitantes total": "5"}


def test_sinks_round_trip(spark, tmp_path, sf):
    roads = catalog.road_table(spark, sf).withColumn("profile", F.lit("car"))
    files.write_od(roads.select("profile", "demand_id", "facility_id", "minutes", "km", "imputed"), str(tmp_path / "od"))
    assert spark.read.parquet(str(tmp_path / "od")).count() == roads.count()
    rows = spark.createDataFrame([("10101", 1)], "ubigeo string, n int")
    assert files.write_table(rows, str(tmp_path / "t")) and not files.write_table(rows.limit(0), str(tmp_path / "none"))
    assert files.read_output(spark, str(tmp_path / "t")).first().ubigeo == "010101"
    listed = files.manifest(spark, str(tmp_path / "t" / "*.csv"))
    source = {"filename": listed.first().filename, "key": "t", "url": "http://example.org/t.csv"}
    entry = files.manifest(spark, str(tmp_path / "t" / "*.csv"), [source]).first()
    assert listed.count() == 1 and (entry.key, entry.license, entry.origin, entry.bytes > 0) == ("t", "no declarada", "cache_local", True)
    with pytest.raises(ValueError):
        files.manifest(spark, str(tmp_path / "t" / "*.csv"), [{**source, "origin": "hearsay"}])
    files.write_log(validation.audit(rows, "x", {"many": F.col("n") > 5}), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log.json")).first().n_affected == 0


def test_geojson_sources(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"properties": {"way_id": 1, "fclass": "primary"}, "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}}\n')
    assert files.read_ways(spark, str(tmp_path / "w.json")).first().coords[1].lon == 3.0
    (tmp_path / "p.json").write_text('{"properties": {"adm3_pcode": "PE010101"}, "geometry": {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]]}}\n')
    assert files.read_polygons(spark, str(tmp_path / "p.json")).first().ubigeo == "010101"


def test_request_key_ignores_the_order_of_points(spark):
    a = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "lon double, lat double")
    key = lambda o, d, p="car": od.request_key("graph", p, o, d).first().key
    assert key(a, a) == key(a.orderBy(F.desc("lon")), a) != key(a, a, "foot")


def test_backends_share_a_contract(spark):
    from wayreach.operators import backends

    o = spark.createDataFrame([(1, 0.01, 0.0, 5.0), (2, 0.5, 0.49, 5.0)], "demand_id long, lon double, lat double, snap_m double")
    d = spark.createDataFrame([(7, 0.0, 0.0), (8, 9.0, 9.0)], "facility_id long, lon double, lat double")
    known = spark.createDataFrame([("car", 1, 7, 3.0, 2.0, 10.0), ("foot", 1, 7, 99.0, 2.0, 10.0)], "profile string, demand_id long, facility_id long, route_minutes double, route_km double, snap_m double")
    rows = {(r.demand_id, r.facility_id): r for r in backends.routed_pairs(backends.get_backend("precomputed", known), o, d, "car").collect()}
    assert len(rows) == 4 and rows[1, 7].minutes == 3.0 and not rows[1, 7].imputed and rows[2, 8].imputed
    graph_rows = backends.routed_pairs(backends.get_backend("graph", lattice(spark)), o, d, "car").collect()
    assert len(graph_rows) == 4 and all(r.minutes is not None for r in graph_rows)
    with pytest.raises(ValueError):
        backends.get_backend("carrier pigeon")


def test_elevation_lookup(spark):
    p = spark.createDataFrame([(1, -77.123456, -12.0), (2, -70.0, -10.0)], "demand_id int, lon double, lat double")
    known = spark.createDataFrame([("-12.00000,-77.12346", 150.0)], "point_key string, elevation_m double")
    assert {r.demand_id: r.altitude_m for r in validation.with_elevation(p, known).collect()} == {1: 150.0, 2: None}
    assert [r.point_key for r in validation.missing_elevations(p, known).collect()] == ["-10.00000,-70.00000"]


def test_whole_run_writes_its_tables(spark, sf, tmp_path):
    from wayreach.plans.run import run_all

    roads = lambda points, facilities: od.with_fallback(star.routed(od.all_pairs(points, facilities)))
    conf = replace(DEFAULT, budgets=(1, 2), cover_minutes=400.0)
    walk = lambda points, facilities: roads(points, facilities).withColumn("minutes", F.col("minutes") * 6)
    out = run_all(star.demand(spark, sf), star.facilities(spark, sf), star.districts(spark, sf), roads, str(tmp_path), conf=conf, modes={"foot": walk})
    assert out["metrics_national"].first().n_puntos == 150
    assert {"lorenz", "sfca_summary", "snapping", "kpis", "snapping_foot", "cross_mode"} <= out.keys() and out["cross_mode"].first().profile == "foot"
    written = next((tmp_path / "metrics_district_national.csv").glob("*.csv")).read_text().splitlines()
    assert len(written) == 1 + out["metrics_district"].count() and written[1:] == sorted(written[1:], key=lambda x: x.split(",")[:4])
    assert files.read_polygons(spark, str(tmp_path / "districts_national.json")).count() == 25 and (tmp_path / "od_foot").is_dir()
    assert spark.read.parquet(str(tmp_path / "demand_sample_national.parquet")).count() == 150
    assert replace(DEFAULT, scope="dev").folder("a/out/") == "a/out_dev" and replace(DEFAULT, testing=True).folder("out") == "out_test"
    assert (tmp_path / "metrics_district_national.csv").is_dir() and (tmp_path / "od").is_dir()
    gains = [r.poblacion_marginal for r in out["mclp_sequence"].orderBy("orden").collect()]
    assert gains == sorted(gains, reverse=True)
