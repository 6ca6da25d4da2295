"""The derived tables again, as ANSI SQL text, so results can be checked in another engine."""

from __future__ import annotations

from tracewarden.functions import calibration as C
from tracewarden.functions import maths as M
from tracewarden.functions import signatures as S
from tracewarden.sources import tables as T

DAY = T.DAY


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def search(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {text(pattern)}, 'i'), false)"


def tail(z: str) -> str:
    """P(Z > z); ``z`` should be a column name, it is repeated."""

    def horner(coefficients):
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out} * abs({z}) + {c!r})"
        return out

    near = f"{horner(M.TAIL_NUMERATOR)} / {horner(M.TAIL_DENOMINATOR)}"
    far = f"1.0::DOUBLE / (abs({z}) + 1.0 / (abs({z}) + 2.0 / (abs({z}) + 3.0 / (abs({z}) + 4.0 / (abs({z}) + 0.65))))) / 2.506628274631"
    upper = f"exp(-abs({z}) * abs({z}) / 2.0) * CASE WHEN abs({z}) < 7.07106781186547 THEN {near} ELSE {far} END"
    return f"(CASE WHEN {z} >= 0 THEN {upper} ELSE 1.0 - {upper} END)"


def classify(uri: str, agent: str, status: str, field: str) -> str:
    tests = (
        search(uri, S.LOOP_SQLI), search(uri, S.LOOP_XSS), search(uri, S.LOOP_TRAVERSAL),
        search(agent, S.SCANNER_AGENTS), search(uri, S.SUSPICIOUS_PATHS),
    )
    arms = []
    for test, (kind, severity, rule, risk) in zip(tests, S.REQUEST_CLASSES, strict=True):
        value = {"attack_type": text(kind), "severity": text(severity), "rule": text(rule), "risk": f"{risk}::DOUBLE"}[field]
        if field == "severity" and rule == "ADMIN_PROBE_RULE":
            value = f"CASE WHEN {status} IN (200, 301, 302) THEN 'HIGH' ELSE 'MEDIUM' END"
        arms.append(f"WHEN {test} THEN {value}")
    return "CASE " + " ".join(arms) + " END"


def bands(score: str, floors=C.LEVEL_FLOORS, other: str = "none") -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {f} THEN '{n}'" for n, f in floors) + f" ELSE '{other}' END"


def regime(drift: str, index: int | None = None) -> str:
    def value(name):
        return text(name) if index is None else f"{C.REGIME_WEIGHTS[name][index]}::DOUBLE"

    return (
        f"CASE WHEN {drift} >= 0.65 THEN {value('high_drift')} WHEN {drift} >= 0.3 THEN {value('moderate')}"
        f" ELSE {value('stable')} END"
    )


def suspicion(agent: str) -> str:
    a = f"lower({agent})"
    return (
        f"CASE WHEN {agent} IS NULL THEN 0.5::DOUBLE WHEN regexp_matches({a}, {text(S.ATTACK_TOOL_AGENTS)}) THEN 1.0"
        f" WHEN {agent} IN ('', '-') THEN 0.8 WHEN regexp_matches({a}, {text(S.SCRIPT_RUNTIME_AGENTS)}) THEN 0.5"
        f" WHEN regexp_matches({a}, {text(S.FETCH_TOOL_AGENTS)}) THEN 0.3"
        f" WHEN regexp_matches({a}, {text(S.MODERN_BROWSER_AGENTS)}) THEN 0.0 ELSE 0.2 END"
    )


def pick(values) -> str:
    return f"{listed(values)}[(k // 20) % {len(values)} + 1]"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

VIEWS["log"] = ((), f"""
  SELECT event_id, user_id, event_type, value, k, ts, epoch_us(ts) AS us,
    '10.' || (user_id // 65536) || '.' || ((user_id // 256) % 256) || '.' || (user_id % 256) AS remote_addr,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' WHEN event_type = 'error' AND k % 5 = 2 THEN 'PUT'
         WHEN event_type = 'error' AND k % 5 = 3 THEN 'OPTIONS' ELSE 'GET' END AS request_method,
    CASE WHEN event_type = 'error' AND k % 5 IN (0, 1) THEN '/login'
         WHEN k % 20 = 7 THEN {pick(T.SQLI_REQUESTS)}
         WHEN k % 20 = 13 THEN {pick(T.TRAVERSAL_REQUESTS)}
         WHEN k % 20 = 17 THEN {pick(T.SCRIPT_REQUESTS)}
         WHEN k % 20 = 19 THEN '/.env'
         ELSE '/' || event_type || '/' || (k % 12) || '?id=' || event_id END AS request_uri,
    CASE WHEN event_type = 'error' THEN [401, 403, 404, 500, 503][k % 5 + 1] WHEN event_type = 'signup' THEN 201
         WHEN event_type = 'click' AND k % 10 = 0 THEN 301 ELSE 200 END AS status,
    CAST(floor(value * 20) AS BIGINT) AS body_bytes_sent, value / 1000 AS request_time,
    CASE user_id % 10 WHEN 0 THEN 'sqlmap/1.7' WHEN 1 THEN 'curl/8.0' WHEN 2 THEN 'Go-http-client/1.1' WHEN 3 THEN '-'
         ELSE 'Mozilla/5.0 Chrome/120.0' END AS http_user_agent,
    '-' AS http_referer, (event_type = 'error' OR k % 20 IN (7, 13, 17, 19)) AS is_attack
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""")

VIEWS["flows"] = (("log",), """
  SELECT event_id, us, ts, remote_addr AS src_ip, '172.16.' || (k % 4) || '.' || (k % 25) AS dst_ip,
    1000 + k % 7 AS dst_port, event_type || (k % 12) || '.example' AS domain, body_bytes_sent,
    body_bytes_sent AS bytes_in, CAST(floor(value * 3) AS BIGINT) AS bytes_out,
    CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS is_nxdomain, CASE WHEN status IN (401, 403) THEN 1 ELSE 0 END AS failed_login,
    CASE WHEN k % 20 = 7 THEN 1 ELSE 0 END AS fortiguard_hit, (k % 11) * 0.5::DOUBLE AS cvss_score,
    CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS is_vuln
  FROM log""")

VIEWS["scored"] = (("log",), f"""
  SELECT event_id, us, remote_addr AS entity_id, value / 50 - 1 AS ml_raw, (value - 50) / 50 AS z,
    {classify('request_uri', 'http_user_agent', 'status', 'rule')} IS NOT NULL AS rule_triggered,
    (user_id % 10) / 10 AS drift, event_type AS category, is_attack, user_id FROM log""")

VIEWS["alerts"] = (("log",), f"""
  SELECT 'a' || event_id AS alert_id, event_id, us, remote_addr AS source_ip, attack_type, severity, 'ACTIVE' AS status, rule, risk AS risk_score,
    round(risk * 0.9 + 0.05, 3) AS ml_score,
    attack_type || ' from ' || remote_addr || ' → ' || substr(request_uri, 1, 80) AS message, request_uri
  FROM (SELECT *, {classify('request_uri', 'http_user_agent', 'status', 'attack_type')} AS attack_type,
    {classify('request_uri', 'http_user_agent', 'status', 'severity')} AS severity,
    {classify('request_uri', 'http_user_agent', 'status', 'rule')} AS rule,
    {classify('request_uri', 'http_user_agent', 'status', 'risk')} AS risk FROM log) WHERE rule IS NOT NULL""")

VIEWS["judged"] = (("scored",), f"""
  SELECT event_id, us, entity_id, user_id, category, rule_triggered, z, ml_raw, y_true, ml_score, rule_score, behavior_score, score,
    CASE WHEN rule_triggered THEN 1 ELSE 0 END AS y_rules, CASE WHEN ml_score >= 0.5 THEN 1 ELSE 0 END AS y_ml,
    CASE WHEN score >= 0.45 THEN 1 ELSE 0 END AS y_hybrid
  FROM (SELECT *, CAST(is_attack AS INTEGER) AS y_true, round(p_ml, 4) AS ml_score, p_rule AS rule_score,
      round(p_behavior, 4) AS behavior_score, round(0.35 * p_ml + 0.35 * p_rule + 0.30 * p_behavior, 4) AS score
    FROM (SELECT *, 1.0 / (1.0 + exp(-ml_raw)) AS p_ml, CASE WHEN rule_triggered THEN 0.9::DOUBLE ELSE 0.0 END AS p_rule,
        {tail('zs')} AS p_behavior FROM (SELECT *, z - 1.5 AS zs FROM scored)))""")

# windowed flow features, one row per source and day
VIEWS["flow_days"] = (("flows",), f"""
  SELECT b.src_ip, b.bucket, bytes_in_sum, bytes_out_sum, conn_count, dst_port_nunique, domain_nunique, domain_entropy,
    is_nxdomain_mean, failed_login_sum, fortiguard_hit_sum, cvss_score_max, is_vuln_sum
  FROM (SELECT src_ip, us // {DAY} AS bucket, CAST(sum(bytes_in) AS BIGINT) AS bytes_in_sum, CAST(sum(bytes_out) AS BIGINT) AS bytes_out_sum,
      count(*) AS conn_count, count(DISTINCT dst_port) AS dst_port_nunique, avg(is_nxdomain) AS is_nxdomain_mean,
      CAST(sum(failed_login) AS BIGINT) AS failed_login_sum, CAST(sum(fortiguard_hit) AS BIGINT) AS fortiguard_hit_sum,
      max(cvss_score) AS cvss_score_max, CAST(sum(is_vuln) AS BIGINT) AS is_vuln_sum FROM flows GROUP BY 1, 2) b
  JOIN (SELECT src_ip, bucket, count(*) AS domain_nunique, -sum(p * log2(p + 1e-9)) AS domain_entropy
    FROM (SELECT src_ip, bucket, n / sum(n) OVER (PARTITION BY src_ip, bucket) AS p
      FROM (SELECT src_ip, us // {DAY} AS bucket, domain, count(*) AS n FROM flows GROUP BY 1, 2, 3)) GROUP BY 1, 2) d
  USING (src_ip, bucket)""")

# the ten behavioural features, one row per address and day
VIEWS["features"] = (("log",), f"""
  SELECT a.ip, a.bucket, a.event_count, a.is_attack,
    CAST(a.event_count AS DOUBLE) AS f1_request_frequency,
    round(CASE WHEN a.event_count < 2 THEN 0.0 ELSE p.h / CASE WHEN p.n > 1 THEN log2(p.n) ELSE 1.0 END END, 6) AS f2_endpoint_entropy,
    round(a.f3, 6) AS f3_failed_request_ratio, round(c.h, 6) AS f4_uri_char_entropy, round(a.f5, 6) AS f5_timing_variance,
    CAST(p.n AS DOUBLE) AS f6_unique_endpoints_per_min, round(m.g, 6) AS f7_http_method_gini, a.f8 AS f8_ua_suspicion_score,
    round(a.f9, 6) AS f9_session_length, round(abs(a.body - 1024) / 512, 6) AS f10_payload_size_zscore
  FROM (SELECT remote_addr AS ip, us // {DAY} AS bucket, count(*) AS event_count, max(CAST(is_attack AS INTEGER)) AS is_attack,
      avg(CASE WHEN status >= 400 THEN 1.0 ELSE 0.0 END) AS f3,
      CASE WHEN count(*) < 2 THEN 0.0 ELSE stddev_pop(request_time) END AS f5, max({suspicion('http_user_agent')}) AS f8,
      (max(us) - min(us)) / 1e6 AS f9, avg(body_bytes_sent) AS body FROM log GROUP BY 1, 2) a
  JOIN (SELECT ip, bucket, count(*) AS n, -sum(s * log2(s + 1e-12)) AS h FROM (
      SELECT ip, bucket, n / sum(n) OVER (PARTITION BY ip, bucket) AS s FROM (
        SELECT remote_addr AS ip, us // {DAY} AS bucket, split_part(request_uri, '?', 1) AS path, count(*) AS n FROM log GROUP BY 1, 2, 3))
    GROUP BY 1, 2) p USING (ip, bucket)
  JOIN (SELECT ip, bucket, -sum(s * log2(s + 1e-12)) AS h FROM (
      SELECT ip, bucket, n / sum(n) OVER (PARTITION BY ip, bucket) AS s FROM (
        SELECT ip, bucket, ch, count(*) AS n FROM (
          SELECT remote_addr AS ip, us // {DAY} AS bucket, unnest(string_split(request_uri, '')) AS ch FROM log) GROUP BY 1, 2, 3))
    GROUP BY 1, 2) c USING (ip, bucket)
  JOIN (SELECT ip, bucket, 1 - sum(s * s) AS g FROM (
      SELECT ip, bucket, n / sum(n) OVER (PARTITION BY ip, bucket) AS s FROM (
        SELECT remote_addr AS ip, us // {DAY} AS bucket, request_method, count(*) AS n FROM log GROUP BY 1, 2, 3))
    GROUP BY 1, 2) m USING (ip, bucket)""")

# requests per address and day, and the profile learned from them
VIEWS["daily"] = (("log",), f"SELECT remote_addr AS ip, us // {DAY} AS bucket, count(*) AS n FROM log GROUP BY 1, 2")
VIEWS["freq"] = (("daily",), """
  SELECT count(*) AS n, avg(n) AS mean, stddev_samp(n) AS std, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90,
    quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, quantile_cont(n, 0.999) AS p999,
    avg(power(n - m, 3)) / power(avg(power(n - m, 2)), 1.5) AS skewness, avg(power(n - m, 4)) / power(avg(power(n - m, 2)), 2) - 3 AS kurtosis
  FROM (SELECT CAST(n AS DOUBLE) AS n, avg(n) OVER () AS m FROM daily)""")
VIEWS["status_mix"] = (("log",), """
  SELECT count(*) AS total, avg(CASE WHEN status >= 400 THEN 1.0 ELSE 0.0 END) AS error_rate,
    avg(CASE WHEN status BETWEEN 400 AND 499 THEN 1.0 ELSE 0.0 END) AS rate_4xx,
    avg(CASE WHEN status BETWEEN 500 AND 599 THEN 1.0 ELSE 0.0 END) AS rate_5xx FROM log""")


def compose(views: tuple[str, ...], body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the views it needs, in dependency order."""
    done: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in done:
            done.append(name)

    for v in views:
        add(v)
    if not done:
        return body.strip()
    head = ",\n".join(f"{v} AS ({VIEWS[v][1]})" for v in done)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[len('WITH '):]}"
    return f"WITH {head}\n{body}"
