"""Scalar helpers against Python's own mathematics and hand-picked requests."""

import math

from pyspark.sql import functions as F

from tracewarden.functions import calibration as C
from tracewarden.functions import maths as M
from tracewarden.functions import signatures as S


def column(spark, values, ddl, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normal_tail(spark):
    zs = [-40.0, -8.5, -7.1, -3.0, -1.0, -0.1, 0.0, 0.5, 1.96, 4.0, 7.0, 7.2, 12.0]
    for z, got in zip(zs, column(spark, zs, "double", M.normal_tail), strict=True):
        want = math.erfc(z / math.sqrt(2)) / 2
        assert abs(got - want) <= 1e-12 * max(want, 1e-300) + 1e-14


def test_tail_direction(spark):
    upper = column(spark, [-1.0, 0.0, 3.0], "double", C.tail_probability)
    lower = column(spark, [-1.0, 0.0, 3.0], "double", lambda c: C.tail_probability(c, "lower"))
    assert upper[0] > upper[1] > upper[2]
    assert all(abs(u + lo - 1) < 1e-12 for u, lo in zip(upper, lower, strict=True))


def test_kolmogorov_tail(spark):
    got = column(spark, [0.1, 0.5, 1.0, 1.36, 2.0], "double", M.kolmogorov_tail)
    assert got[0] == 1.0 and abs(got[2] - 0.26999967) < 1e-6 and abs(got[3] - 0.0494) < 1e-3 and got[4] < 1e-3


def test_levels_and_regimes(spark):
    assert column(spark, [0.85, 0.65, 0.4, 0.2, 0.1], "double", C.alert_level) == ["critical", "high", "medium", "low", "none"]
    assert column(spark, [0.0, 0.3, 0.64, 0.65], "double", C.drift_regime) == ["stable", "moderate", "moderate", "high_drift"]
    assert column(spark, ["none", "low", "critical"], "string", C.level_rank) == [0, 1, 4]


ATTACKS = [
    "/a?id=1 UNION SELECT x FROM y", "/a?id=1' OR '1'='1", "/a?q=1; DROP TABLE t;--", "/a?q=%27", "/a?q=SLEEP(3)", "/a?q=EXEC x",
    "/a?q=INFORMATION_SCHEMA", "/a?q=INSERT INTO t",
]


def test_injection_signature(spark):
    got = column(spark, [*ATTACKS, "/products?id=12", "/unions/selected", None], "string", lambda c: S.sqli_signature(c, F.lit("-")))
    assert all(v is not None and v.confidence >= 0.67 for v in got[: len(ATTACKS)])
    assert got[-3:] == [None, None, None]
    assert got[0].hits == 2 and got[0].severity == "high" and abs(got[0].confidence - 0.84) < 1e-9


def test_traversal_signature(spark):
    def verdict(status):
        return column(spark, ["/x/../../etc/passwd"], "string", lambda c: S.traversal_signature(c, F.lit(status)))[0]

    assert verdict(200).succeeded and verdict(200).confidence == 1.0
    assert not verdict(404).succeeded and abs(verdict(404).confidence - 0.9) < 1e-9 and verdict(404).hits == 3


def test_classifier_takes_first_match(spark):
    uris = ["/a?q=union  select <script", "/<script>", "/../x", "/.env", "/index"]
    got = column(spark, uris, "string", lambda c: S.classify_request(c, F.lit("Mozilla"), F.lit(404)))
    assert [g and g.attack_type for g in got] == ["SQL Injection", "XSS", "Path Traversal", "Brute Force", None]
    assert got[3].severity == "MEDIUM"


def test_agent_suspicion(spark):
    agents = ["sqlmap/1", "curl/8", "", "-", "Go-http-client/1.1", "wget/1", "Mozilla Chrome/120.0", "Chrome/50.0", None]
    assert column(spark, agents, "string", S.agent_suspicion) == [1.0, 1.0, 0.8, 0.8, 0.5, 0.3, 0.0, 0.2, 0.5]


def test_normaliser_reveals_disguises(spark):
    disguised = ["/a?q=%2527%20UnIoN/**/SeLeCt", "/a?t=%26lt;ScRiPt", "/%252e%252e/x", "/a?q=100%"]
    got = column(spark, disguised, "string", S.normalise_uri)
    assert got == ["/a?q=' union select", "/a?t=<script", "/../x", "/a?q=100%"]


def test_node_type(spark):
    assert column(spark, ["10.0.0.1", "a.example", "...", ""], "string", S.node_type) == ["host", "domain", "domain", "domain"]


def test_student_tail(spark):
    """Against Simpson's rule over the angle, from 1 to a million degrees of freedom."""
    cases = [(t, v) for v in (1.0, 2.5, 3.0, 18.0, 100.0, 5000.0, 1e6) for t in (0.0, 0.1, 0.7, 1.96, -2.5, 4.0, 9.0)]
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(cases)], "i int, t double, v double")
    got = {r.i: r.p for r in df.select("i", M.student_two_sided(F.col("t"), F.col("v")).alias("p")).collect()}
    for i, (t, v) in enumerate(cases):
        top, n = min(math.atan(abs(t) / math.sqrt(v)), 14 / math.sqrt(v)), 4000
        area = sum((1 if k in (0, n) else 4 if k % 2 else 2) * math.cos(top * k / n) ** (v - 1) for k in range(n + 1)) * top / n / 3
        want = 1 - 2 * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi) * area
        assert abs(got[i] - want) < 2e-9, (t, v)
    odd = spark.createDataFrame([(None, 3.0), (1.0, None), (math.inf, 3.0)], "t double, v double")
    assert [r.p for r in odd.select(M.student_two_sided(F.col("t"), F.col("v")).alias("p")).collect()] == [None, None, 0.0]
