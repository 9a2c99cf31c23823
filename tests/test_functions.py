import hashlib
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skylattice.functions import calendar as cal
from skylattice.functions import geodesy as geo
from skylattice.functions import hashing
from skylattice.functions import values as val
from skylattice.functions.special import with_emg, with_erfc


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


def test_season_edges(spark):
    days = {"a": "2021-09-30", "b": "2021-10-01", "c": "2021-12-31", "d": "2099-11-01"}
    r = one(spark, **{k: cal.season_label(ts(v)) for k, v in days.items()})
    assert tuple(r) == ("2020-21", "2021-22", "2021-22", "2099-00")


def test_half_hours_go_to_the_even_hour(spark):
    r = one(spark, a=cal.round_to_hour(ts("2024-01-01 11:30:00")), b=cal.round_to_hour(ts("2024-01-01 12:30:00")),
            c=cal.round_to_hour(ts("2024-01-01 12:30:00.000001")), d=cal.round_to_hour(ts("2024-01-01 23:45:00")))
    assert [x.strftime("%d %H") for x in r] == ["01 12", "01 12", "01 13", "02 00"]


def test_wind_direction(spark):
    r = one(spark, w=geo.wind_from_deg(F.lit(1.0), F.lit(0.0)), n=geo.wind_from_deg(F.lit(0.0), F.lit(-1.0)), s=geo.wind_from_deg(F.lit(0.0), F.lit(1.0)))
    assert r["w"] == pytest.approx(270) and r["n"] % 360 == pytest.approx(0, abs=1e-9) and r["s"] == pytest.approx(180)


def test_utm_round_trip_and_meridian(spark):
    pts = spark.createDataFrame([(18.53, 73.85), (0.0, 75.0), (19.0, 73.0)], "lat double, lon double")
    x, y = geo.utm_forward("lat", "lon")
    p = pts.select("lat", "lon", x.alias("x"), y.alias("y"))
    la, lo = geo.utm_inverse("x", "y")
    for r in p.select("*", la.alias("la"), lo.alias("lo")).collect():
        assert r["la"] == pytest.approx(r["lat"], abs=5e-9) and r["lo"] == pytest.approx(r["lon"], abs=5e-9)  # half a millimetre
        if r["lon"] == 75.0:
            assert (r["x"], r["y"]) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))
    # meridian arc: one degree of latitude near the equator, scaled by 0.9996
    n = one(spark, y=geo.utm_forward(F.lit(1.0), F.lit(75.0))[1])["y"]
    assert n == pytest.approx(110574.4 * 0.9996, abs=1.0)


@pytest.mark.parametrize("seg, want", [((0.2, 0.2, 0.8, 0.2), 0.6), ((-1, 0.5, 2, 0.5), 1.0), ((-1, 0, 0, 1), 0.0), ((0, 0, 1, 0), 1.0),
                                       ((2, 2, 3, 3), 0.0), ((0.5, 0.5, 0.5, 0.5), 0.0), ((1, -1, 1, 3), 1.0)])
def test_clipped_length(spark, seg, want):
    s = [F.lit(float(v)) for v in seg]
    got = one(spark, l=geo.clipped_length(*s, F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)))["l"]
    assert got == pytest.approx(want, abs=1e-12)


def test_bins_are_half_open(spark):
    x = [0.0, 1.999, 2.0, 10.0, -0.1, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(geo.bin_index("x", 0.0, 2.0, 5)).collect()]
    assert got == [0, 0, 1, None, None, None]


def test_erfc_and_profile(spark):
    z = [-4.0, -1.0, 0.0, 1e-3, 0.5, 1.0, 2.0, 5.0, 9.0]
    df = with_erfc(spark.createDataFrame([(v,) for v in z], "z double"), "z", "e")
    for r in df.collect():
        assert r["e"] == pytest.approx(math.erfc(r["z"]), rel=1e-9)
    # unit area, and no overflow for a narrow tail
    g = spark.range(-4000, 12000).selectExpr("id / 20D AS x", "20D AS x0", "2D AS mu", "6D AS s")
    assert with_emg(g, "x", "x0", "mu", "s", "f").agg(F.sum("f") / 20).first()[0] == pytest.approx(1, abs=1e-6)
    far = with_emg(spark.sql("SELECT -60D AS x, 2D AS x0, 15D AS mu, 30D AS s"), "x", "x0", "mu", "s", "f").first()["f"]
    assert 0 <= far < 1 and math.isfinite(far)


def test_versions(spark):
    got = one(spark, a=val.version_number(F.lit("11.3r")), b=val.version_number(F.lit("11.")), c=val.version_number(F.lit("beta")), d=val.version_number(F.lit("1.2.3")))
    assert tuple(got) == (11.3, 11.0, -1.0, -1.0)


def test_ring_and_corridor(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0))])
    r = one(spark, inside=geo.in_ring(F.lit(0.5), F.lit(1.0), ring), notch=geo.in_ring(F.lit(2.0), F.lit(3.0), ring),
            near=geo.in_corridor(F.lit(5.0), F.lit(3.0), [(0.0, 0.0), (4.0, 0.0)], 3.5), far=geo.in_corridor(F.lit(9.0), F.lit(0.0), [(0.0, 0.0), (4.0, 0.0)], 3.5))
    assert tuple(r) == (True, False, True, False)


def test_digest_heads_are_those_of_md5():
    texts = ["", "7", "abc", "é" * 9, "x" * 43, "y" * 44, "z" * 90, None]
    for some in (texts[:5], texts[:7], texts[1:2] * 3, []):
        got = hashing.digest_heads("42:1:donor:", *hashing.side_by_side(pa.array(some, pa.string())))
        assert [f"{h:016x}" for h in got] == [hashlib.md5(f"42:1:donor:{t}".encode()).hexdigest()[:16] for t in some]
