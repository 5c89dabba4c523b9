import datetime as dt

import pytest
from pyspark.sql import functions as F

from orbitspark.functions import dates, names, orbit, text


def one(spark, expr, **values):
    kinds = {str: "string", float: "double", int: "double", type(None): "string"}
    df = spark.createDataFrame([tuple(float(v) if isinstance(v, int) else v for v in values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(expr.alias("x")).first()[0]


def many(spark, f, rows):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, c string")
    got = [r[0] for r in df.orderBy("i").select(f(F.col("c")).alias("x")).collect()]
    assert got == [e for _, e in rows]


def test_norm_name(spark):
    many(spark, names.norm_name, [("STARLINK-30042", "starlink 30042"), ("STARLINK 30042 (v2)", "starlink 30042"), ("STARLINK30042", "starlink 30042"), ("Starlink-30042 [+]", "starlink 30042"), ("  a  b ", "a b"), ("Спутник-1", "спутник 1"), ("", ""), (None, "")])
    many(spark, names.name_key, [("", None), ("A-1", "a 1")])


def test_designators(spark):
    many(spark, names.norm_cospar, [("2023-54A", "2023-054A"), ("2023 054 a", "2023-054A"), ("1998-067AB", "1998-067AB"), ("1961 Alpha 1", "1961 ALPHA 1"), ("", None), (None, None)])
    many(spark, names.is_standard_cospar, [("2023-054A", True), ("1961 Alpha 1", False), (None, False)])
    many(spark, names.launch_key, [("2023-54A", "2023-054"), ("junk", None)])


def test_object_types(spark):
    many(spark, names.object_type, [("PAY", "PAYLOAD"), ("  R/B", "ROCKET_BODY"), ("D  P", "DEBRIS"), ("C  F", "DEBRIS"), ("S", "PAYLOAD"), ("Z", "UNKNOWN"), ("TBA", "UNKNOWN"), ("  ", "UNKNOWN"), (None, "UNKNOWN")])


def test_dates(spark):
    d = dt.date
    many(spark, dates.parse_date_loose, [("2023-03-15", d(2023, 3, 15)), ("2023 Mar 15", d(2023, 3, 15)), ("2023 Mar", d(2023, 3, 1)), ("3/15/2023", d(2023, 3, 15)), ("2023", d(2023, 1, 1)), ("1957 Dec  1 1000?", d(1957, 12, 1)), ("1971?", d(1971, 1, 1)), ("2000s?", None), ("2023-02-30", None), ("-", None), ("", None), (None, None), ("1958 Xyz 4", None)])
    many(spark, dates.legacy_datetime, [("Jun  8 2025  4:50:24:023PM", d(2025, 6, 8)), ("nonsense", None)])
    got = [tuple(r) for r in dates.month_windows(spark, d(2024, 1, 15), d(2024, 3, 10)).orderBy("window_start").collect()]
    assert got == [(d(2024, 1, 15), d(2024, 2, 1)), (d(2024, 2, 1), d(2024, 3, 1)), (d(2024, 3, 1), d(2024, 3, 10))]


@pytest.mark.parametrize("p,a,expected", [(500, 550, "LEO"), (2000, 2000, "MEO"), (35286, 36286, "GEO"), (35285, 36286, "MEO"), (200, 40000, "HEO"), (None, 5, "UNKNOWN")])
def test_regime(spark, p, a, expected):
    assert spark.range(1).select(orbit.regime(F.lit(p).cast("double"), F.lit(a).cast("double"))).first()[0] == expected


def test_orbit(spark):
    sma = spark.range(1).select(orbit.semi_major_axis(F.lit(1.00273791))).first()[0]
    assert abs(sma - 42164) < 1
    assert spark.range(1).select(orbit.percent(F.lit(1), F.lit(0))).first()[0] is None
    assert spark.range(1).select(orbit.percent_or_zero(F.lit(1), F.lit(0))).first()[0] == 0.0
    assert [spark.range(1).select(orbit.storm_level(F.lit(k))).first()[0] for k in (49, 50, 69, 90)] == [None, "G1", "G2", "G5"]


def test_codes_and_slugs(spark):
    many(spark, names.slugify, [("BSS-702MP+", "bss-702mp"), ("--", None), ("A  b", "a-b")])
    many(spark, lambda c: names.slugify(c, plus=True), [("BSS-702MP+", "bss-702mp-plus")])
    many(spark, names.certain, [("'Agena?", "Agena"), ("unk", None), ("?", None)])
    many(spark, names.codes, [("RAYM?/GSFC", ["RAYM", "GSFC"]), ("A//B", ["A", None, "B"])])
    many(spark, names.country, [("USA", "US"), ("Atlantis", None)])


def test_support_and_similarity(spark):
    df = spark.createDataFrame([("at 525.0 km", 25.0), ("at 25 km", 25.0), ("x", None)], "p string, v double")
    assert [r[0] for r in df.select(text.page_supports_number("p", "v")).collect()] == [False, True, False]
    assert spark.range(1).select(text.page_supports_text(F.lit("band (Ku)"), F.lit("(Ku)"))).first()[0] is True
    import difflib

    a, b = "starlink 30042", "starlnik 3042"
    assert spark.range(1).select(text.similarity(F.lit(a), F.lit(b))).first()[0] == difflib.SequenceMatcher(None, a, b).ratio()


def test_near_earth_model():
    """The report's own test case, whose figures are of single precision."""
    import numpy as np
    import pandas as pd

    from orbitspark.functions import propagate as g

    e = pd.DataFrame({"norad_id": [88888], "mean_motion": [16.05824518], "eccentricity": [0.0086731], "inclination": [72.8435], "ra_of_asc_node": [115.9689], "arg_of_pericenter": [52.6988], "mean_anomaly": [110.5714], "bstar": [0.66816e-4]})
    want = [[2328.97048951, -5995.22076416, 1719.97067261], [2456.10705566, -6071.93853760, 1222.89727783], [2567.56195068, -6112.50384522, 713.96397400], [2663.09078980, -6115.48229980, 196.39640427], [2742.55133057, -6079.67144775, -326.38095856]]
    assert np.abs(g.positions(e, np.array([[0.0, 360, 720, 1080, 1440]]))[0] - want).max() < 0.02
    many = pd.concat([e] * 3, ignore_index=True).assign(eccentricity=[0.0086731, 0.0, 0.7], mean_motion=[16.05824518, 15.0, 2.0], bstar=[0.66816e-4, None, 1e-4])
    got = g.positions(many, np.array([[0.0, 1440]] * 3))
    assert np.isfinite(got).all() and np.allclose(got[0, 0], want[0], atol=0.02) and abs(np.linalg.norm(got[1, 0]) - 6945) < 20


def test_sky(spark):
    """An object on the equator's geostationary ring stands still, due south of a northern observer on its meridian."""
    import numpy as np
    import pandas as pd

    from orbitspark.functions import propagate as g

    epoch = np.datetime64("2024-03-20T00:00:00")
    lon = np.degrees(g.sidereal(np.array([epoch])))[0]
    e = pd.DataFrame({"norad_id": [1], "epoch": [epoch], "mean_motion": [1.00273791], "eccentricity": [0.0], "inclination": [0.0], "ra_of_asc_node": [lon], "arg_of_pericenter": [0.0], "mean_anomaly": [0.0]})
    when = epoch + np.arange(3) * np.timedelta64(6, "h")
    el, az, dist = g.look(g.positions(e, g._minutes(e, when)), when[None, :], 45.0, 0.0, 0.0)
    assert abs(az[0, 0] - 180) < 0.5 and 37 < el[0, 0] < 39 and np.ptp(el[0]) < 0.2 and abs(dist[0, 0] - 38000) < 500
    df = spark.createDataFrame(e)
    assert g.visible_now(df, dt.datetime(2024, 3, 20), 45.0, 0.0).count() == 1
    assert g.passes(df, dt.datetime(2024, 3, 20), 1, 45.0, 0.0).first()["duration_s"] == 3600.0
    with pytest.raises(ValueError):
        g.passes(df, dt.datetime(2024, 3, 20), 73, 45.0, 0.0)
