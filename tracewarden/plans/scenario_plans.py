"""What-if edits of windowed features."""

from pyspark.sql import functions as F

from tracewarden.operators import features, scenarios
from tracewarden.plans.registry import query
from tracewarden.plans.sql_views import DAY

TARGET = "10.0.0.5"


def windows(t):
    return features.flow_windows(t.flows, DAY)


@query(
    "sc01_high_entropy_dns",
    f"""SELECT src_ip, bucket, CASE WHEN src_ip = '{TARGET}' THEN domain_nunique + 50 ELSE domain_nunique END AS domain_nunique,
          round(CASE WHEN src_ip = '{TARGET}' THEN least(domain_entropy + 2.5, 8.0) ELSE domain_entropy END, 6) AS domain_entropy,
          CASE WHEN src_ip = '{TARGET}' THEN bytes_out_sum + 15000 ELSE bytes_out_sum END AS bytes_out_sum FROM flow_days""",
    ("flow_days",),
)
def _(t):
    df = scenarios.high_entropy_dns(windows(t), TARGET)
    return df.select("src_ip", "bucket", "domain_nunique", F.round("domain_entropy", 6).alias("domain_entropy"), "bytes_out_sum")


@query(
    "sc02_sparse_beacon",
    f"""SELECT src_ip, bucket, bytes_in_sum + CASE WHEN src_ip = '{TARGET}' THEN 1000 ELSE 0 END AS bytes_in_sum, bytes_out_sum + CASE WHEN src_ip = '{TARGET}' THEN 200 ELSE 0 END AS bytes_out_sum,
          round(CASE WHEN src_ip = '{TARGET}' THEN greatest(domain_entropy - 2.0, 0.0) ELSE domain_entropy END, 6) AS domain_entropy FROM flow_days""",
    ("flow_days",),
)
def _(t):
    df = scenarios.sparse_beacon(windows(t), TARGET, 2.0)
    return df.select("src_ip", "bucket", "bytes_in_sum", "bytes_out_sum", F.round("domain_entropy", 6).alias("domain_entropy"))


_SHRINK = ", ".join(f"round({c} * CASE WHEN src_ip = '{TARGET}' THEN 0.85::DOUBLE ELSE 1.0 END, 6) AS {c}" for c in ("bytes_in_sum", "bytes_out_sum", "dst_port_nunique"))


@query("sc03_bounded_shrink", f"SELECT src_ip, bucket, {_SHRINK}, CASE WHEN src_ip = '{TARGET}' THEN 0.0::DOUBLE ELSE 5.0 END AS ip_reputation_score FROM flow_days", ("flow_days",))
def _(t):
    df = scenarios.bounded_shrink(windows(t).withColumn("ip_reputation_score", F.lit(5.0)), TARGET)
    return df.select("src_ip", "bucket", *[F.round(c, 6).alias(c) for c in ("bytes_in_sum", "bytes_out_sum", "dst_port_nunique")], "ip_reputation_score")


@query("sc04_extra_ports", f"SELECT src_ip, bucket, dst_port_nunique + CASE WHEN src_ip = '{TARGET}' THEN 10 ELSE 0 END AS dst_port_nunique FROM flow_days", ("flow_days",))
def _(t):
    return scenarios.extra_edges(windows(t), TARGET).select("src_ip", "bucket", "dst_port_nunique")


@query(
    "sc04_extra_edges",
    f"SELECT src_ip, n + CASE WHEN src_ip = '{TARGET}' THEN 10 ELSE 0 END AS flows, CASE WHEN src_ip = '{TARGET}' THEN 10 ELSE 0 END::BIGINT AS to_hubs FROM (SELECT src_ip, count(*) AS n FROM flows GROUP BY 1)",
    ("flows",),
)
def _(t):
    df = scenarios.extra_edges(t.flows, TARGET)
    return df.groupBy("src_ip").agg(F.count(F.lit(1)).alias("flows"), F.count_if(F.col("dst_ip").isin(*scenarios.HUBS)).alias("to_hubs"))
