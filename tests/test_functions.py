"""Column expressions and statistics on small inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayreach.conf import DEFAULT, Settings
from wayreach.functions import geo, stats, text


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def table(spark, values, weights):
    rows = [(i, None if v is None else float(v), None if w is None else float(w)) for i, (v, w) in enumerate(zip(values, weights))]
    return spark.createDataFrame(rows, "i long, v double, w double")


def ref_quantile(v, w, q):
    order = np.argsort(v, kind="stable")
    cw = np.cumsum(np.array(w)[order])
    return float(np.interp(q * cw[-1], cw, np.array(v)[order]))


def ref_gini(v, w):
    order = np.argsort(v)
    v, w = np.array(v)[order], np.array(w)[order]
    cvw = np.cumsum(v * w)
    return 1 - 2 * np.sum(w * (cvw - v * w / 2)) / (w.sum() * cvw[-1])


def gini(spark, v, w, spread=1):
    return stats.ordered(table(spark, v, w), [], "v", "w", "i", {}, "g", spread).first().g


def test_weighted_mean(spark):
    mean = lambda v, w: table(spark, v, w).agg(stats.weighted_mean(F.col("v"), F.col("w")).alias("m")).first().m
    assert mean([10, 20, None, 30], [1, 3, 100, 0]) == 17.5
    assert mean([1, 2, 3, 4], [2] * 4) == 2.5
    assert mean([None], [1]) is None and mean([5], [0]) is None


@pytest.mark.parametrize("spread", [1, 5, 64])
def test_ordered_statistics_against_numpy(spark, spread):
    r = np.random.default_rng(1)
    v, w = r.gamma(2, 20, 300), r.gamma(2, 300, 300)
    got = stats.ordered(table(spark, v, w), [], "v", "w", "i", {"a": 0.1, "m": 0.5, "z": 0.999}, "g", spread).first()
    assert [got.a, got.m, got.z] == pytest.approx([ref_quantile(v, w, q) for q in (0.1, 0.5, 0.999)])
    assert got.g == pytest.approx(ref_gini(v, w))


def test_quantile_known_answer(spark):
    q = lambda x: stats.ordered(table(spark, [10, 1000], [99, 1]), [], "v", "w", "i", {"q": x}).first().q
    assert q(0.5) == 10 and q(0.999) > 10


def test_ties_in_one_range_and_null_keys(spark):
    df = spark.createDataFrame([(i, float(i % 3), 1.0, None if i < 20 else "k") for i in range(60)], "i long, v double, w double, g string")
    for spread in (1, 8):
        got = {r.g: r.m for r in stats.ordered(df, ["g"], "v", "w", "i", {"m": 0.5}, None, spread).collect()}
        if spread > 1:  # a null group is a group
            assert set(got) == {None, "k"}
        assert got["k"] == pytest.approx(1.0)


def test_gini_properties(spark):
    r = np.random.default_rng(2)
    v, w = r.gamma(2, 20, 50), r.random(50) + 0.1
    assert gini(spark, [42] * 50, w) == pytest.approx(0, abs=1e-9)
    assert gini(spark, v * 7.5, w) == pytest.approx(gini(spark, v, w))
    even, uneven = gini(spark, [50] * 100, [1] * 100), gini(spark, [1] * 99 + [10000], [1] * 100)
    assert 0 <= even < uneven <= 1
    assert gini(spark, [1], [1]) is None and gini(spark, [0, 0], [1, 1]) is None


def test_lorenz_lies_under_the_diagonal(spark):
    r = np.random.default_rng(3)
    v, w = r.gamma(2, 20, 300), r.gamma(2, 300, 300)
    rows = stats.lorenz(table(spark, v, w), "v", "w", "i").orderBy("share_poblacion").collect()
    x, y = [q.share_poblacion for q in rows], [q.share_tiempo_acumulado for q in rows]
    order = np.argsort(v)
    pop = np.concatenate([[0], np.cumsum(w[order]) / w.sum()])
    load = np.concatenate([[0], np.cumsum((v * w)[order]) / (v * w).sum()])
    assert len(rows) == 101 and y == pytest.approx(np.interp(x, pop, load).tolist()) and all(b <= a + 1e-12 for a, b in zip(x, y))
    assert 1 - 2 * np.trapezoid(y, x) <= ref_gini(v, w)


def test_spearman_with_ties(spark):
    import pandas as pd

    a, b = [1, 2, 2, 3, 5, 8], [3.0, 1.0, 4.0, 4.0, 2.0, 9.0]
    df = spark.createDataFrame([(float(x), y) for x, y in zip(a, b)] + [(None, 1.0)], "a double, b double")
    expected = pd.Series(a).rank().corr(pd.Series(b).rank())
    assert stats.spearman(df, [], "a", "b").first().rho == pytest.approx(expected)


def test_haversine(spark):
    km = lambda *p: one(spark, geo.haversine_km(*[F.lit(x) for x in p]))
    assert km(-77.04, -12.05, -71.98, -13.53) == pytest.approx(572, rel=0.01)
    assert km(0.0, 0.0, 0.0, 1.0) == pytest.approx(111.2, rel=0.005) and km(5.0, 5.0, 5.0, 5.0) == 0
    assert one(spark, geo.haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0))) is None


def test_box_and_coordinates(spark):
    inside = lambda x, y: one(spark, geo.in_bbox(F.lit(x), F.lit(y)))
    assert inside(-77.04, -12.05) and not inside(-6.48, -77.83)
    fix = lambda x, y: one(spark, geo.fixed_coordinates(F.lit(x).cast("double"), F.lit(y).cast("double")))
    assert tuple(fix(-77.0, -12.0)) == (-77.0, -12.0, False, False, False)
    assert tuple(fix(-12.0, -77.0)) == (-77.0, -12.0, False, True, False)
    assert tuple(fix(10.0, 10.0)) == (None, None, False, False, True)
    assert tuple(fix(0.0, -12.0)) == (None, None, True, False, False) and fix(None, -12.0).missing


def test_rings(spark):
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    shape = F.array(ring((0, 0), (10, 0), (10, 10), (5, 5), (0, 10)), ring((1, 1), (2, 1), (2, 2), (1, 2)))
    inside = lambda x, y: one(spark, geo.inside_rings(shape, F.lit(float(x)), F.lit(float(y))))
    assert inside(3, 3) and not inside(5, 8) and not inside(1.5, 1.5) and not inside(11, 1)
    far = one(spark, geo.ring_distance(shape, F.lit(13.0), F.lit(-4.0)))
    assert far == pytest.approx(5.0)
    near = lambda x, tol: one(spark, geo.covered_by(shape, F.lit(x), F.lit(4.0), tol))
    assert near(10.01, 0.02) and not near(10.03, 0.02) and near(10.0, 0.0)


def test_lines_round_trip(spark):
    line = geo.decode_line(F.lit("-77.100000,-12.000000;-77.200000,-12.100000;"))
    assert [(p.lon, p.lat) for p in one(spark, line)] == [(-77.1, -12.0), (-77.2, -12.1)]
    assert one(spark, geo.encode_line(line)) == "-77.100000,-12.000000;-77.200000,-12.100000"


def test_text(spark):
    names = spark.createDataFrame([("  Ñahuinpuquio ",), ("SAN  JOSÉ",), (None,)], "x string")
    assert [r.n for r in names.select(text.norm_name(F.col("x")).alias("n")).collect()] == ["NAHUINPUQUIO", "SAN JOSE", ""]
    numbers = spark.createDataFrame([("-77,0428",), ("  -12.0464 ",), ("",), ("n/d",), ("NaN",)], "x string")
    assert [r.n for r in numbers.select(text.coordinate(F.col("x")).alias("n")).collect()] == [-77.0428, -12.0464, None, None, None]
    pad = lambda x, n: one(spark, text.pad_id(F.lit(x), n))
    assert [pad("10109", 6), pad("150101.0", 6), pad(1101, 6), pad("1234567", 6)] == ["010109", "150101", "001101", "1234567"]
    assert one(spark, text.title(F.lit("o'higgins san-juan 2do"))) == "O'Higgins San-Juan 2Do"
    assert text.header_name("CATEGORÍA\n  INEI") == "CATEGORIA INEI"
    odd = spark.createDataFrame([("CAÃ‘AVERAL",), ("NORMAL",), ("a?b",), ("?x",), ("why?",), (None,)], "x string")
    got = odd.select(F.count_if(text.looks_twice_encoded(F.col("x"))).alias("a"), F.count_if(text.looks_lossy(F.col("x"))).alias("b")).first()
    assert (got.a, got.b) == (1, 2)


def test_labels_are_whole_and_unique(spark):
    df = spark.createDataFrame([("hospital", "II-1", None, "lima", "1"), ("hospital", "II-1", None, "lima", "2"), (None, None, None, None, None)], "n string, c string, d string, p string, k string")
    got = [r.x for r in df.select(text.facility_label(F.col("n"), F.col("c"), F.col("d"), F.col("p"), F.col("k")).alias("x")).collect()]
    assert len(set(got)) == 3 and all("sin dato" in x for x in got) and got[0].startswith("Hospital")


def test_settings_hold_together():
    assert not set(DEFAULT.resolutive) & set(DEFAULT.upgradable) and list(DEFAULT.bands) == sorted(DEFAULT.bands)
    assert set(DEFAULT.departments()) == {*DEFAULT.coast, *DEFAULT.highland, *DEFAULT.jungle} and len(DEFAULT.departments()) == 25
    assert DEFAULT.fallback_speed_kmh != DEFAULT.naive_speed_kmh and DEFAULT.output_name("m", "csv") == "m_national.csv"
    assert Settings(scope="dev").departments() == ("TUMBES",)
    with pytest.raises(ValueError):
        Settings(bands=(60, 30))
    assert math.isclose(DEFAULT.bbox[0], -81.4)
