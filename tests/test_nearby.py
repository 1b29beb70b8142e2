"""Searches by distance make the pairs that they need, no others, and find what all pairs give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayreach import catalog
from wayreach.functions.geo import haversine_km
from wayreach.operators import od
from wayreach.plans.lineage import cut
from wayreach.sources import star

MID = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_access_makes_few_pairs(spark):
    near = catalog.near_table(spark, MID)
    assert "NestedLoop" not in plan(near) and "Cartesian" not in plan(near)
    assert near.count() < 90_000 / 3
    assert rows(od.nearest(near)) == rows(od.nearest(catalog.road_table(spark, MID)))
    assert "NestedLoop" not in plan(catalog.candidates(spark, MID)) and rows(catalog.candidates(spark, MID)) == rows(od.top_k(catalog.road_table(spark, MID, "is_upgrade_candidate"), 10))


@pytest.mark.parametrize("k", [1, 3, 10, 50])
def test_near_pairs_on_odd_places(spark, k):
    rng = np.random.default_rng(k)
    spots = np.round(rng.normal([0.0, 0.0], [0.01, 0.01], (150, 2)), 3).tolist() + np.round(rng.uniform([-180, -90], [180, 90], (150, 2)), 2).tolist()
    spots += [[179.999, 0.0], [-179.999, 0.001], [0.0, 90.0], [120.0, 89.99], [-60.0, -90.0], [5.0, 5.0], [5.0, 5.0], [5.0, 5.0]]
    at = [(i, float(x), float(y)) for i, (x, y) in enumerate(spots)] + [(900, None, 1.0), (901, float("nan"), 2.0)]
    demand = spark.createDataFrame(at + [(5, *at[5][1:])], "demand_id long, lon double, lat double").withColumn("snap_m", F.lit(0.0))
    places = spark.createDataFrame([r for r in at if r[0] % 2] + [(5, *at[5][1:]), (902, None, None)], "facility_id long, lon double, lat double")
    turn = F.lit(1.5) + (F.col("demand_id") * 7 + F.col("facility_id") * 13) % 100 / F.lit(66.0)
    timed = lambda pairs: pairs.withColumn("km", haversine_km(*[F.col(c) for c in ("o_lon", "o_lat", "d_lon", "d_lat")])).withColumn("minutes", F.col("km") * turn)
    plain = lambda df: df.withColumn("minutes", F.when(~F.isnan("minutes"), F.col("minutes")))
    near, every = (plain(timed(p)) for p in (od.near_pairs(demand, places, k, 3.0 / 1.5), od.all_pairs(demand, places)))
    assert rows(od.top_k(near, k)) == rows(od.top_k(every, k))
    if k == 1:
        key = F.col("demand_id") < 900
        assert rows(od.nearest(near).where(key).drop("km_red")) == rows(od.nearest(every).where(key).drop("km_red")) and od.nearest(near).count() == len(at)
        reach = timed(od.near_pairs(demand, places, reach_km=300.0)).where("km <= 300").select("demand_id", "facility_id")
        assert rows(reach) == rows(timed(od.all_pairs(demand, places)).where("km <= 300").select("demand_id", "facility_id"))


def test_many_at_one_place_and_none(spark):
    demand = spark.range(6000).select(F.col("id").alias("demand_id"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), F.lit(0.0).alias("snap_m"))
    places = demand.where("demand_id < 2000").select(F.col("demand_id").alias("facility_id"), "lon", "lat")
    assert od.near_pairs(demand, places).count() == 6000 * 2000
    assert od.near_pairs(demand, places.limit(0)).count() == 0


def test_repeated_points_keep_their_rows(spark, sf, tmp_path):
    for t in ("nation", "region", "supplier", "customer"):
        part = spark.read.parquet(f"{sf}/{t}.parquet")
        (part.unionByName(part.limit(40)) if t in ("supplier", "customer") else part).write.parquet(f"{tmp_path}/{t}.parquet")
    d = str(tmp_path)
    assert rows(catalog.candidates(spark, d)) == rows(od.top_k(catalog.road_table(spark, d, "is_upgrade_candidate"), 10))
    assert rows(od.nearest(catalog.near_table(spark, d))) == rows(od.nearest(catalog.road_table(spark, d)))


def test_the_roads_keep_their_bounds(spark, sf):
    least, most = star.minutes_per_km()
    ratio = F.col("minutes") / F.col("straight_km")
    one = catalog.road_table(spark, sf).where("minutes is not null and straight_km > 0").agg(F.min(ratio).alias("a"), F.max(ratio).alias("b")).first()
    assert least * (1 - 1e-12) <= one.a and one.b <= most * (1 + 1e-12)


def test_years_modes_and_secondary_facilities_make_few_pairs(spark):
    dated, every = catalog.dated_table(spark, MID), catalog.road_table(spark, MID)
    assert "NestedLoop" not in plan(dated) and dated.count() < 90_000 / 2
    places, points = star.facilities(spark, MID), catalog.demand(spark, MID)
    shaped = lambda name, df: rows(catalog.shaped(name, df))
    assert shaped("temporal", catalog.metrics.temporal(points, dated, places)) == shaped("temporal", catalog.metrics.temporal(points, every, places))
    assert shaped("straight_vs_network", od.straight_vs_network(catalog.near_table(spark, MID), points)) == shaped("straight_vs_network", od.straight_vs_network(every, points))
    turn = F.lit(5.0) + ((F.col("demand_id") * 13 + F.col("facility_id") * 7) % 40) / F.lit(20.0)
    assert rows(od.nearest(catalog.walk_table(spark, MID)).drop("km_red")) == rows(od.nearest(every.withColumn("minutes", F.col("minutes") * turn)).drop("km_red"))
    found = catalog.secondary_destinations(spark, MID)
    assert "NestedLoop" not in plan(found) and rows(found) == rows(od.secondary_destinations(every, od.secondary_points(points)))


def test_imputation_counts_every_pair_without_making_any(spark, sf, tmp_path):
    for t in ("nation", "region", "supplier", "customer"):
        part = spark.read.parquet(f"{sf}/{t}.parquet")
        if t in ("supplier", "customer"):
            key = f"{t[0]}_{t[:4]}key"
            part = part.unionByName(part.limit(5)).unionByName(part.withColumn(key, F.col(key) + 987_654))
            part = part.unionByName(part.withColumn(key, -F.col(key))) if t == "customer" else part
        part.write.parquet(f"{tmp_path}/{t}.parquet")
    for d in (sf, MID, str(tmp_path)):
        assert catalog.od_imputation(spark, d).first().asDict() == od.imputation_report(catalog.road_table(spark, d)).first().asDict()
    none = star.facilities(spark, sf).withColumn("class", star.route_class(F.col("facility_id"))).limit(0)
    points = star.demand(spark, sf).withColumn("class", star.route_class(F.col("demand_id")))
    empty = od.with_fallback(star.routed(od.all_pairs(points, none)))
    assert od.imputation_by_class(points, none, star.has_route, empty).first().asDict() == od.imputation_report(empty).first().asDict()


def test_catchments_stream_their_pairs(spark):
    access, places = catalog.access(spark, MID), star.facilities(spark, MID)
    wide = catalog.replace(catalog.DEFAULT, catchment_minutes=240.0)
    near = catalog.models.sfca_points(access, catalog.reach_table(spark, MID, 240.0), places, wide)
    assert "NestedLoop" not in plan(near)
    shaped = lambda df: rows(catalog.shaped("sfca_points", df))
    assert shaped(near) == shaped(catalog.models.sfca_points(access, catalog.road_table(spark, MID), places, wide))


def test_snapping_by_tree_is_that_by_cells(spark, sf, monkeypatch):
    graph = catalog.graph
    nodes = cut(graph.node_points(catalog.edges(spark, sf)))
    points = star.demand(spark, sf).select("demand_id", "lon", "lat").unionByName(spark.createDataFrame([(900, -79.95, -15.0), (901, -79.95, -14.95), (902, None, 1.0)], "demand_id long, lon double, lat double"))
    found = graph.snap(points, nodes, "demand_id")
    assert "NestedLoop" not in plan(found)
    got = rows(found)
    monkeypatch.setattr(graph, "WHOLE_GRAPH_EDGES", 0)
    assert got == rows(graph.snap(points, nodes, "demand_id"))


def test_graph_pairs_are_not_joined(spark, sf, monkeypatch):
    backends, graph = catalog.backends, catalog.graph
    points, places = star.demand(spark, sf).drop("snap_m"), star.facilities(spark, sf).where("is_resolutive")
    monkeypatch.setattr(graph, "BLOCK_TARGETS", 2)
    made = backends.routed_pairs(backends.get_backend("graph", catalog.ways(spark, sf)), points, places, "car")
    known = backends.get_backend("graph", catalog.ways(spark, sf))

    class Table:
        table = staticmethod(known.table)

    columns = ["demand_id", "facility_id", "minutes", "km", "imputed", "snap_m", "straight_km", "profile"]
    assert rows(made.select(columns)) == rows(backends.routed_pairs(Table(), points, places, "car").select(columns))
