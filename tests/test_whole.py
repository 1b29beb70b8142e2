"""Queries do the whole of their job, by brute force on small tables."""

import heapq
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wayreach import catalog
from wayreach.conf import DEFAULT
from wayreach.functions import stats
from wayreach.functions.geo import haversine_km
from wayreach.operators import backends, models
from wayreach.plans.lineage import cut
from wayreach.sources import star


def test_graph_od_routes_every_point(spark, sf):
    points = {r.demand_id: (r.lon, r.lat) for r in star.demand(spark, sf).collect()}
    places = {r.facility_id: (r.lon, r.lat) for r in star.facilities(spark, sf).where("is_resolutive").collect()}
    arcs = defaultdict(list)
    for r in catalog.edges(spark, sf).collect():
        arcs[r.a].append((r.b, r.seconds))
        arcs[r.b].append((r.a, r.seconds))
    at = {n: tuple(int(x) / 1e6 for x in n.split(",")) for n in arcs}
    near = lambda p: min(at, key=lambda n: ((p[0] - at[n][0]) ** 2 + (p[1] - at[n][1]) ** 2, n))

    def minutes_from(start):
        best, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            t, u = heapq.heappop(heap)
            for v, s in arcs[u] if t <= best[u] else ():
                if t + s < best.get(v, float("inf")):
                    best[v] = t + s
                    heapq.heappush(heap, (t + s, v))
        return {n: t / 60 for n, t in best.items()}

    snapped = spark.createDataFrame([(i, *p, *at[near(p)]) for i, p in points.items()], "id long, lon double, lat double, x double, y double")
    off = {r.id: r.m for r in snapped.select("id", (haversine_km(*[snapped[c] for c in ("lon", "lat", "x", "y")]) * 1000).alias("m")).collect()}
    got = {(r.demand_id, r.facility_id): r for r in catalog.QUERIES["graph_od"](spark, sf).collect()}
    assert len(points) == 150 and got.keys() == {(i, f) for i in points for f in places}
    routed = 0
    for f, p in places.items():
        reach = minutes_from(near(p))
        for i, q in points.items():
            r, known = got[i, f], reach.get(near(q))
            if known is None:
                assert r.imputed or r.minutes is None
            elif off[i] > DEFAULT.no_road_access_m:
                assert r.minutes is None and not r.imputed
            else:
                assert r.minutes == pytest.approx(known, abs=1e-3) and not r.imputed
                routed += 1
    assert routed


def test_text_names_take_the_whole_text(spark, tmp_path):
    texts = {1: "año " * 40 + "Íñigo o'higgins", 2: "x" * 70 + "  élan", 3: ""}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.norm, r.titled) for r in catalog.QUERIES["text_names"](spark, str(tmp_path)).collect()}
    assert got == {1: ("ANO " * 40 + "INIGO O'HIGGINS", "Año " * 40 + "Íñigo O'Higgins"), 2: ("X" * 70 + " ELAN", "X" + "x" * 69 + "  Élan"), 3: ("", "")}


@pytest.mark.parametrize("conf", [DEFAULT, replace(DEFAULT, budgets=(1, 2, 3), cover_minutes=120.0), replace(DEFAULT, cover_minutes=300.0)])
def test_plans_reach_the_largest_budget(spark, sf, conf):
    access, candidates = catalog.access(spark, sf), catalog.candidates(spark, sf)
    pool = models.cover_pool(access, candidates, conf)
    covers, weight = defaultdict(set), {}
    for r in pool.collect():
        covers[r.facility_id].add(r.demand_id)
        weight[r.demand_id] = r.design_weight
    gains, seen = [], set()
    for _ in range(max(conf.budgets)):
        gain, f = max(((sum(weight[i] for i in sorted(covers[f] - seen)), -f) for f in covers), default=(0.0, 0))
        if gain <= 0:
            break
        gains.append((-f, gain))
        seen |= covers[-f]
    got = catalog.sequence(spark, sf, conf).orderBy("orden").collect()
    assert [r.facility_id for r in got] == [f for f, _ in gains]
    assert [r.poblacion_marginal for r in got] == pytest.approx([g for _, g in gains], abs=0.01)
    rows = catalog.frontier(spark, sf, conf).orderBy("presupuesto").collect()
    assert [(r.presupuesto, r.n_ascendidos) for r in rows] == [(b, min(b, len(gains))) for b in conf.budgets]
    # The distributed steps choose as the driver does, and a budget's cover is that of the scenario with its choices.
    far = models.greedy_cover(pool, 3, cut, local_rows=0)
    assert [f for f, _ in far] == [f for f, _ in gains[:3]] and [g for _, g in far] == pytest.approx([g for _, g in gains[:3]])
    first = spark.createDataFrame([(f,) for f, _ in gains[: conf.budgets[0]]], "facility_id long")
    one = models.coverage(access, candidates, first, conf.cover_minutes).first()
    assert (rows[0].poblacion_cubierta, rows[0].t_medio_min) == pytest.approx((one.poblacion_cubierta, one.t_medio_min))


def test_every_marker_is_drawn(spark):
    sf = "/root/testdata/sf0.1"
    ids = [r.facility_id for r in star.facilities(spark, sf).where("category in ('II-1', 'I-3')").select("facility_id").collect()]
    got = [r.facility_id for r in catalog.QUERIES["facility_markers"](spark, sf).collect()]
    assert len(got) == 200 and sorted(got) == sorted(ids)


def test_scope_spans_the_resolutive_facilities(spark, sf):
    at = [(r.lon, r.lat) for r in star.facilities(spark, sf).where("is_resolutive").collect()]
    west, east = min(x for x, _ in at) - DEFAULT.scope_pad_deg, max(x for x, _ in at) + DEFAULT.scope_pad_deg
    south, north = min(y for _, y in at) - DEFAULT.scope_pad_deg, max(y for _, y in at) + DEFAULT.scope_pad_deg
    inside = {r.way_id for r in catalog.ways(spark, sf).collect() if any(west <= p.lon <= east and south <= p.lat <= north for p in r.coords)}
    assert {r.way_id for r in catalog.QUERIES["ways_in_scope"](spark, sf).collect()} == inside


def test_percentiles_are_those_of_the_sorted_values(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(int(i), "ab"[int(i) % 2], None if i % 9 == 0 else float(round(x, 1))) for i, x in enumerate(rng.gamma(2, 3, 300))] + [(900, "c", 4.0)]
    df = spark.createDataFrame(rows, "i int, k string, x double")
    for spread in (1, 8):
        got = {r.k: (r.m, r.p) for r in stats.percentiles(df, ["k"], "x", "i", {"m": 0.5, "p": 0.9}, spread).collect()}
        for k in "abc":
            own = [x for _, g, x in rows if g == k and x is not None]
            assert got[k] == pytest.approx((np.percentile(own, 50), np.percentile(own, 90)))


def test_tables_are_kept_by_their_inputs(spark):
    o = spark.createDataFrame([(1, 0.1, 0.0)], "demand_id long, lon double, lat double")
    d = spark.createDataFrame([(7, 0.0, 0.0)], "facility_id long, lon double, lat double")
    asked = []

    class Engine:
        def table(self, origins, destinations, profile):
            asked.append(profile)
            return origins.crossJoin(destinations.select("facility_id")).select("demand_id", "facility_id", (F.col("lon") * 60).alias("route_minutes"))

    backend = backends.KeptBackend("engine", Engine())
    first = backend.table(o, d, "car").collect()
    assert not backend.was_kept and backend.table(o, d, "car").collect() == first and backend.was_kept
    backend.table(o.withColumn("lon", F.col("lon") + 1), d, "car")
    backend.table(o, d, "foot")
    assert asked == ["car", "car", "foot"]
