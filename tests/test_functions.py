import math
import random

from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.functions import text as X


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_text(spark):
    lit = F.lit
    assert one(spark, X.padded(lit(7), 3), X.padded(lit(12345), 3), X.padded(lit(7), 3, " "), X.fixed_text(lit(1e-7), 3), X.fixed_text(lit(123456789012.0), 1)) == ("007", "12345", "  7", "0.000", "123456789012.0")
    assert one(spark, X.ends_with(lit("a.json"), ".json"), X.joined(F.array(lit(1), lit(None), lit(3))), X.latex_text(lit("5% of {a_b} \\ <x>"))) == (True, "1;3", "5\\% of \\{a\\_b\\} \\textbackslash \\textless" + "x\\textgreater")
    versions = [("1.2", "1.2.0", 0), ("1.10", "1.9", -1), ("0.7.1", "0.8", 1)]
    assert one(spark, *(X.version_order(lit(a), lit(b)) for a, b, _ in versions)) == tuple(v for *_, v in versions)


def test_positions_as_text(spark):
    got = one(spark, *(X.degrees_of(F.lit(t)) for t in ("481230.5000N", "0163000.0000W", "481230S", "0481230N", "486030N", "910000N", "x", None)))
    assert math.isclose(got[0], 48 + 12 / 60 + 30.5 / 3600) and got[1] == -16.5 and math.isclose(got[2], -(48 + 12 / 60 + 30 / 3600)) and got[3:] == (None,) * 5


def test_numbers(spark):
    assert one(spark, *(X.nearest_power_of_10(F.lit(v)) for v in (0.0, 4.0, 31.0, 320.0, -0.02))) == (0.0, 10.0, 10.0, 1000.0, -0.01)
    assert one(spark, *(X.n_decimals(F.lit(v)) for v in (3.0, 2.5, 0.125, 1e-12))) == (0, 1, 3, 0)
    packed = S.source_id(F.lit(17), F.lit(203))
    number = S.record_number(F.lit(123456), F.lit(7))
    assert one(spark, *X.split_source_id(packed), *X.split_record_number(number)) == (17, 203, 123456, 7)
    t = 1_704_164_645_678_901
    assert one(spark, X.date_text(F.lit(t)), X.day_time_text(F.lit(t)), X.date_text(F.lit(-1)), X.day_time_text(F.lit(-1))) == ("2024-01-02", "03:04:05.678", "1969-12-31", "23:59:59.999")


def test_bearings(spark):
    """Against the stated rule, and back and forth."""

    def rebased(a, base=0.0):
        return (a - base + 180) % 360 - 180

    random.seed(5)
    rows = [tuple(random.uniform(-180, 180) for _ in range(4)) + (random.random(),) for _ in range(300)] + [(0.0, 0.0, 33.0, 99.0, 0.5)]
    df = spark.createDataFrame(rows, "e double, n double, a double, b double, s double")
    speed, bearing = X.speed_and_bearing(F.col("e"), F.col("n"))
    east, north = S.bearing_vector(speed, bearing)
    for r in df.select("*", X.interpolated_bearing(*map(F.col, "enabs")).alias("got"), bearing.alias("way"), east.alias("e2"), north.alias("n2")).collect():
        if r.way is None:
            assert r.got == r.a
            continue
        assert math.isclose(r.e, r.e2, abs_tol=1e-9) and math.isclose(r.n, r.n2, abs_tol=1e-9)
        x, y = rebased(r.a, r.way), rebased(r.b, r.way)
        want = rebased(x + (y - x) * r.s + r.way) if (x >= 0) != (y >= 0) else rebased(r.a + rebased(r.b, r.a) * r.s)
        assert abs(rebased(r.got, want)) < 1e-9 and -180 <= r.got < 180
