"""Signatures and string functions over whole request texts."""

from pyspark.sql import functions as F

from tracewarden.functions import signatures as S
from tracewarden.operators import lookups
from tracewarden.plans.registry import query
from tracewarden.plans.sql_views import classify, search, suspicion, text


def hits(column: str, patterns) -> str:
    return " + ".join(f"CAST({search(column, p)} AS INTEGER)" for p in patterns)


def found(column: str, patterns) -> str:
    return "concat_ws(' & ', " + ", ".join(f"CASE WHEN {search(column, p)} THEN {text(p)} END" for p in patterns) + ")"


@query(
    "sig01_sqli_signature",
    f"""SELECT event_id, hits, round(least(0.5::DOUBLE + 0.17 * hits, 1.0), 4) AS confidence,
          CASE WHEN 0.5::DOUBLE + 0.17 * hits >= 0.85 THEN 'critical' ELSE 'high' END AS severity, matched
        FROM (SELECT event_id, {hits('target', S.SQLI_SIGNATURES)} AS hits, {found('target', S.SQLI_SIGNATURES)} AS matched
          FROM (SELECT event_id, request_uri || ' ' || http_referer AS target FROM log)) WHERE hits > 0""",
    ("log",),
)
def _(t):
    return (
        S.keep_hits(t.log, S.sqli_signature(F.col("request_uri"), F.col("http_referer")), "v")
        .select("event_id", "v.hits", "v.confidence", "v.severity", F.array_join("v.matched", " & ").alias("matched"))
    )


@query(
    "sig02_traversal_signature",
    f"""SELECT event_id, hits, round(least(c, 1.0), 4) AS confidence, CASE WHEN c >= 0.85 THEN 'critical' ELSE 'high' END AS severity, succeeded, matched
        FROM (SELECT *, CASE WHEN succeeded THEN least(0.6::DOUBLE + 0.1 * hits + 0.25, 1.0) ELSE 0.6::DOUBLE + 0.1 * hits END AS c FROM (
          SELECT event_id, {hits('request_uri', S.TRAVERSAL_SIGNATURES)} AS hits, status = 200 AS succeeded,
            {found('request_uri', S.TRAVERSAL_SIGNATURES)} AS matched FROM log) WHERE hits > 0)""",
    ("log",),
)
def _(t):
    return (
        S.keep_hits(t.log, S.traversal_signature(F.col("request_uri"), F.col("status")), "v")
        .select("event_id", "v.hits", "v.confidence", "v.severity", "v.succeeded", F.array_join("v.matched", " & ").alias("matched"))
    )


@query(
    "sig03_request_classifier",
    "SELECT event_id, "
    + ", ".join(f"{classify('request_uri', 'http_user_agent', 'status', f)} AS {f}" for f in ("attack_type", "severity", "rule", "risk"))
    + " FROM log",
    ("log",),
)
def _(t):
    hit = S.classify_request(F.col("request_uri"), F.col("http_user_agent"), F.col("status"))
    return t.log.select("event_id", hit.alias("h")).select("event_id", "h.attack_type", "h.severity", "h.rule", "h.risk")


def _pattern_query(name, column, pattern, out):
    @query(name, f"SELECT event_id, {search(column, pattern)} AS {out} FROM log", ("log",))
    def _(t):
        return t.log.select("event_id", S.matches(F.col(column), pattern).alias(out))


_pattern_query("sig04_loop_sqli", "request_uri", S.LOOP_SQLI, "sqli")
_pattern_query("sig06_loop_traversal", "request_uri", S.LOOP_TRAVERSAL, "traversal")
_pattern_query("sig07_scanner_agent", "http_user_agent", S.SCANNER_AGENTS, "scanner")
_pattern_query("sig09_auth_endpoint", "request_uri", S.AUTH_ENDPOINTS, "auth_endpoint")


@query(
    "sig05_loop_xss",
    f"""SELECT 'page' AS origin, page_id AS id, {search('html', S.LOOP_XSS.replace('.*', '[^\\n]*'))} AS xss FROM pages
        UNION ALL SELECT 'event', event_id, {search('request_uri', S.LOOP_XSS)} FROM log""",
    ("log",),
)
def _(t):
    pages = t.read("pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), S.matches(F.col("html"), S.LOOP_XSS).alias("xss"))
    return pages.unionByName(t.log.select(F.lit("event").alias("origin"), F.col("event_id").alias("id"), S.matches(F.col("request_uri"), S.LOOP_XSS).alias("xss")))


@query(
    "sig08_suspicious_path",
    f"""SELECT event_id, CASE WHEN {search('request_uri', S.SUSPICIOUS_PATHS)} THEN CASE WHEN status IN (200, 301, 302) THEN 'HIGH' ELSE 'MEDIUM' END END AS severity
        FROM log""",
    ("log",),
)
def _(t):
    return t.log.select("event_id", S.suspicious_path_severity(F.col("request_uri"), F.col("status")).alias("severity"))


@query(
    "sig10_agent_suspicion",
    f"SELECT http_user_agent, max({suspicion('http_user_agent')}) AS score, count(*) AS n FROM log GROUP BY 1",
    ("log",),
)
def _(t):
    return t.log.groupBy("http_user_agent").agg(F.max(S.agent_suspicion(F.col("http_user_agent"))).alias("score"), F.count(F.lit(1)).alias("n"))


@query(
    "sig11_baseline_suspicious_agents",
    f"SELECT count(*) FILTER (WHERE regexp_matches(lower(http_user_agent), {text(S.BASELINE_SUSPICIOUS_AGENTS)})) AS suspicious, count(*) AS total FROM log",
    ("log",),
)
def _(t):
    return t.log.agg(
        F.count_if(F.lower("http_user_agent").rlike(S.BASELINE_SUSPICIOUS_AGENTS)).alias("suspicious"), F.count(F.lit(1)).alias("total")
    )


@query("sig12_uri_path", "SELECT 'event' AS origin, event_id AS id, split_part(request_uri, '?', 1) AS path FROM log UNION ALL SELECT 'page', page_id, split_part(url, '?', 1) FROM pages", ("log",))
def _(t):
    events = t.log.select(F.lit("event").alias("origin"), F.col("event_id").alias("id"), S.uri_path(F.col("request_uri")).alias("path"))
    return events.unionByName(t.read("pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), S.uri_path(F.col("url")).alias("path")))


def _undisguised() -> str:
    sql = "url_decode(url_decode(raw))"
    for entity, char in (
        (r"&#x0*3c;|&#0*60;|&lt;", "<"), (r"&#x0*3e;|&#0*62;|&gt;", ">"), (r"&#x0*27;|&#0*39;|&apos;", "'"),
        (r"&#x0*22;|&#0*34;|&quot;", '"'), (r"&#x0*2f;|&#0*47;|&sol;", "/"), (r"&#x0*26;|&#0*38;|&amp;", "&"),
    ):
        sql = f"regexp_replace({sql}, {text(entity)}, {text(char)}, 'gi')"
    sql = f"regexp_replace(lower({sql}), '/\\*.*?\\*/', ' ', 'g')"
    return f"regexp_replace(regexp_replace({sql}, '\\s+', ' ', 'g'), '--', '', 'g')"


@query(
    "sig13_normalised_uri",
    f"""SELECT event_id, n AS normalised, {search('n', S.LOOP_SQLI)} AS sqli, {search('n', S.LOOP_XSS)} AS xss, {search('n', S.LOOP_TRAVERSAL)} AS traversal
        FROM (SELECT event_id, {_undisguised()} AS n FROM (
          SELECT event_id, replace(request_uri, ' ', CASE WHEN k % 2 = 0 THEN '/**/' ELSE '%2509' END) || CASE WHEN k % 3 = 0 THEN '&t=%26lt;SCRIPT&#x3e;' ELSE '' END AS raw FROM log))""",
    ("log",),
)
def _(t):
    k = F.col("k")
    disguised = F.concat(
        F.replace("request_uri", F.lit(" "), F.when(k % 2 == 0, "/**/").otherwise("%2509")),
        F.when(k % 3 == 0, "&t=%26lt;SCRIPT&#x3e;").otherwise(""),
    )
    n = t.log.select("event_id", S.normalise_uri(disguised).alias("normalised"))
    c = F.col("normalised")
    return n.select("event_id", "normalised", S.matches(c, S.LOOP_SQLI).alias("sqli"), S.matches(c, S.LOOP_XSS).alias("xss"), S.matches(c, S.LOOP_TRAVERSAL).alias("traversal"))


@query(
    "sig14_node_type",
    """SELECT name, CASE WHEN regexp_matches(replace(name, '.', ''), '^[0-9]+$') THEN 'host' ELSE 'domain' END AS type
       FROM (SELECT dst_ip AS name FROM flows UNION SELECT domain FROM flows)""",
    ("flows",),
)
def _(t):
    names = t.flows.select(F.col("dst_ip").alias("name")).union(t.flows.select("domain")).distinct()
    return names.select("name", S.node_type(F.col("name")).alias("type"))


@query("sig15_internal_address", "SELECT event_id, starts_with(src_ip, '10.') AS source_internal, starts_with(dst_ip, '10.') AS target_internal FROM flows", ("flows",))
def _(t):
    return t.flows.select("event_id", S.is_internal(F.col("src_ip")).alias("source_internal"), S.is_internal(F.col("dst_ip")).alias("target_internal"))


@query(
    "sig16_technique_coverage",
    """WITH dim(technique, attack_type, covered) AS (VALUES ('T1046', 'Port Scan', 1), ('T1110', 'Brute Force', 1), ('T1190', 'SQL Injection', 1),
         ('T1190', 'Path Traversal', 1), ('T1499', 'DoS Flood', 1), ('T1071', 'C2', 0), ('T1059', 'Command', 0))
       SELECT technique, max(covered) AS covered, count(alert_id) AS alerts, CAST((SELECT count(DISTINCT technique) FROM dim WHERE covered = 1) AS DOUBLE) /
         (SELECT count(DISTINCT technique) FROM dim) AS coverage FROM dim LEFT JOIN alerts USING (attack_type) GROUP BY 1""",
    ("alerts",),
)
def _(t):
    return lookups.technique_coverage(t.alerts)
