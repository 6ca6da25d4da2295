"""Enrichment joins, overlays, block list and set operations."""

from pyspark.sql import functions as F

from tracewarden.operators import lookups
from tracewarden.plans.registry import query
from tracewarden.plans.sql_views import search
from tracewarden.functions import signatures as S


@query(
    "jn01_intel_enrichment",
    """WITH reports AS (SELECT '10.' || (c_custkey // 65536) || '.' || (c_custkey // 256 % 256) || '.' || (c_custkey % 256) AS ip, 'r' || (c_custkey % 3) AS source, CAST(floor(c_acctbal / 100) AS BIGINT) AS raw_score FROM customer),
       intel AS (SELECT ip, max(raw_score) AS raw_score, arg_max(source, (raw_score, source)) AS source FROM reports GROUP BY 1)
       SELECT alert_id, source_ip, source AS intel_source, raw_score, raw_score > CASE source WHEN 'r0' THEN 75 ELSE 50 END AS malicious FROM alerts LEFT JOIN intel ON ip = source_ip""",
    ("alerts",),
)
def _(t):
    key = F.col("c_custkey")
    reports = t.read("customer").select(
        F.concat_ws(".", F.lit("10"), *[F.floor(key / n % 256).cast("string") for n in (65536, 256, 1)]).alias("ip"),
        F.concat(F.lit("r"), (key % 3).cast("string")).alias("source"),
        F.floor(F.col("c_acctbal") / 100).alias("raw_score"),
        F.floor(F.col("c_acctbal") / 100).alias("confidence"),
        F.array(F.lit("customer")).alias("tags"),
    )
    intel = lookups.normalised_intel(reports, {"r0": 75}).withColumnRenamed("source", "intel_source")
    return lookups.enrich(t.alerts, intel, "source_ip").select("alert_id", "source_ip", "intel_source", "raw_score", "malicious")


CHANGES = """changes AS (SELECT alert_id, CASE WHEN event_id % 3 = 0 THEN 'RESOLVED' ELSE 'INVESTIGATING' END AS status, us AS updated_us FROM alerts WHERE severity = 'CRITICAL'
  UNION ALL SELECT alert_id, 'BLOCKED', us + event_id % 2 - 1 FROM alerts WHERE attack_type = 'SQL Injection' OR attack_type = 'XSS')"""


def changes(t):
    a, e = t.alerts, F.col("event_id")
    first = a.filter("severity = 'CRITICAL'").select("alert_id", F.when(e % 3 == 0, "RESOLVED").otherwise("INVESTIGATING").alias("status"), F.col("us").alias("updated_us"))
    second = a.filter(F.col("attack_type").isin("SQL Injection", "XSS")).select("alert_id", F.lit("BLOCKED").alias("status"), (F.col("us") + e % 2 - 1).alias("updated_us"))
    return first, second


@query(
    "jn02_status_overlay",
    f"WITH {CHANGES} SELECT a.alert_id, coalesce(c.status, 'ACTIVE') AS status FROM alerts a LEFT JOIN (SELECT alert_id, arg_max(status, (updated_us, status)) AS status FROM changes GROUP BY 1) c USING (alert_id)",
    ("alerts",),
)
def _(t):
    first, second = changes(t)
    return lookups.overlay_status(t.alerts.drop("status"), first.unionByName(second)).select("alert_id", "status")


@query(
    "jn03_status_upsert",
    f"WITH {CHANGES} SELECT alert_id, arg_max(status, (updated_us, status)) AS status, max(updated_us) AS updated_us FROM changes GROUP BY 1",
    ("alerts",),
)
def _(t):
    return lookups.upsert_status(*changes(t))


BLOCKED = "blocked AS (SELECT remote_addr AS ip, max(us) AS blocked_us, 'repeat attacker' AS reason FROM log WHERE is_attack GROUP BY 1 HAVING count(*) > 25)"


def blocklist(t):
    hits = t.log.filter("is_attack").groupBy(F.col("remote_addr").alias("ip")).agg(F.max("us").alias("blocked_us"), F.count(F.lit(1)).alias("n"))
    return hits.filter("n > 25").select("ip", "blocked_us", F.lit("repeat attacker").alias("reason"))


@query("jn04_blocklist_listing", f"WITH {BLOCKED} SELECT * FROM blocked ORDER BY blocked_us DESC", ("log",))
def _(t):
    return lookups.newest_first(blocklist(t), "blocked_us")


@query(
    "jn05_blocklist_insert_absent",
    f"""WITH {BLOCKED} SELECT * FROM blocked UNION ALL SELECT source_ip, min(us), 'manual' FROM alerts WHERE source_ip NOT IN (SELECT ip FROM blocked) AND attack_type = 'Port Scan' GROUP BY 1""",
    ("alerts",),
)
def _(t):
    new = t.alerts.filter("attack_type = 'Port Scan'").select(F.col("source_ip").alias("ip"), F.col("us").alias("blocked_us"), F.lit("manual").alias("reason"))
    return lookups.add_absent(blocklist(t), new, "ip")


@query("jn06_blocklist_delete", f"WITH {BLOCKED} SELECT * FROM blocked WHERE ip NOT IN (SELECT remote_addr FROM log WHERE status = 301)", ("log",))
def _(t):
    return lookups.remove_keys(blocklist(t), t.log.filter("status = 301").select(F.col("remote_addr").alias("ip")), "ip")


@query(
    "jn07_attribute_by_source",
    f"SELECT event_id, remote_addr IN (SELECT remote_addr FROM log WHERE {search('request_uri', S.LOOP_XSS)}) AS flagged FROM log",
    ("log",),
)
def _(t):
    found = t.log.filter(S.matches(F.col("request_uri"), S.LOOP_XSS))
    return lookups.flag_by_source(t.log, found, "remote_addr").select("event_id", "flagged")


@query(
    "jn08_thresholds_on_events",
    "SELECT event_id, round(6 * error_rate, 6) AS error_rate_threshold, round(6 * rate_4xx, 6) AS rate_4xx_threshold FROM log, status_mix",
    ("log", "status_mix"),
)
def _(t):
    from tracewarden.operators import baseline

    s = baseline.status_distribution(t.log)
    profile = s.select(F.round("threshold_error_rate", 6).alias("error_rate_threshold"), F.round("threshold_4xx_rate", 6).alias("rate_4xx_threshold"))
    return lookups.with_thresholds(t.log.select("event_id"), profile, ["error_rate_threshold", "rate_4xx_threshold"])


def digest(vector="vector"):
    """Width, first element and sum of a vector column."""
    v = F.col(vector)
    return [
        F.size(v).alias("width"),
        F.round(F.element_at(v, 1), 6).alias("first"),
        F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    ]


@query(
    "jn09_embedding_or_zero",
    """SELECT doc_id, CAST(coalesce(len(embedding), 64) AS INTEGER) AS width, round(coalesce(CAST(embedding[1] AS DOUBLE), 0), 6) AS first,
         round(coalesce(list_sum(CAST(embedding AS DOUBLE[])), 0), 6) AS total FROM documents LEFT JOIN embeddings ON vec_id = doc_id""",
)
def _(t):
    vectors = t.read("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return lookups.embedding_or_zero(t.read("documents").select("doc_id"), vectors, "doc_id", "vector", 64).select("doc_id", *digest())


@query(
    "jn10_concat_encodings",
    """SELECT vec_id, 112 AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(list_sum(CAST(embedding AS DOUBLE[])) + list_sum(CAST(embedding[1:32] AS DOUBLE[])) + list_sum(CAST(embedding[1:16] AS DOUBLE[])), 6) AS total FROM embeddings""",
)
def _(t):
    e = t.read("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    parts = [e, e.select("vec_id", F.slice("a", 1, 32).alias("b")), e.select("vec_id", F.slice("a", 1, 16).alias("c"))]
    return lookups.concat_encodings(parts, "vec_id", ["a", "b", "c"], [64, 32, 16]).select("vec_id", *digest("encoding"))


@query("jn11_row_union", "SELECT 'attack' AS part, event_id FROM log WHERE is_attack UNION ALL SELECT 'normal', event_id FROM log WHERE NOT is_attack", ("log",))
def _(t):
    part = lambda name, cond: t.log.filter(cond).select(F.lit(name).alias("part"), "event_id")
    return part("attack", F.col("is_attack")).unionByName(part("normal", ~F.col("is_attack")))
