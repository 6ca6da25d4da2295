"""Request signatures as Column functions.  All of them stay inside JVM code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The signature pattern sets, matched case-insensitively.
SQLI_SIGNATURES = (
    r"(\bUNION\b.*\bSELECT\b)",
    r"(\bSELECT\b.*\bFROM\b)",
    r"(\bINSERT\b.*\bINTO\b)",
    r"(\bDROP\b.*\bTABLE\b)",
    r"(\bOR\b\s+['\"]?\d+['\"]?\s*=\s*['\"]?\d+)",
    r"(--\s*$|;--)",
    r"(\bEXEC\b|\bEXECUTE\b)",
    r"(xp_cmdshell|sp_executesql)",
    r"(\bINFORMATION_SCHEMA\b)",
    r"(\bSLEEP\s*\(|WAITFOR\s+DELAY)",
    r"(%27|%22|%3B)",
)
TRAVERSAL_SIGNATURES = (
    r"\.\./",
    r"\.\.\\",
    r"%2e%2e%2f",
    r"%2e%2e/",
    r"\.%2e/",
    r"%2e\./",
    r"%00",
    r"\.\./\.\./",
    r"(etc/passwd|etc/shadow|win\.ini|boot\.ini)",
    r"(proc/self|sys/class)",
)
LOOP_SQLI = (
    r"(union\s+select|drop\s+table|'.*or.*'.*=|sleep\s*\(|benchmark\s*\(|information_schema|%27|%3D|--\s*$)"
)
LOOP_XSS = r"(<script|javascript:|onerror\s*=|onload\s*=|<iframe|<img\s.*src\s*=)"
LOOP_TRAVERSAL = r"\.\./|\.\.\\|%2e%2e|%252e%252e"
SCANNER_AGENTS = r"(nikto|sqlmap|nmap|masscan|dirbuster|gobuster|wfuzz|burp)"
SUSPICIOUS_PATHS = (
    r"(/\.env|/\.git|/wp-login|/phpmyadmin|/admin|/backup|/config\.php|/server-status|/actuator)"
)
AUTH_ENDPOINTS = r"(/login|/admin|/auth|/signin|/password|/token|/api/token|/wp-login)"
ATTACK_TOOL_AGENTS = (
    r"sqlmap|nikto|nmap|masscan|zgrab|dirbuster|gobuster|wfuzz|hydra|medusa|metasploit|curl/"
    r"|python-requests|libwww|lwp-trivial|nuclei|acunetix|openvas"
)
SCRIPT_RUNTIME_AGENTS = r"python|go-http|java/|ruby|perl"
FETCH_TOOL_AGENTS = r"curl/|wget/"
MODERN_BROWSER_AGENTS = r"(chrome|firefox|safari|edge)/[1-9][0-9]{2}"
BASELINE_SUSPICIOUS_AGENTS = r"curl|python-requests|wget|scrapy|bot|spider"
# Attack type, severity, rule name and risk of the first-match classifier, in its order.
REQUEST_CLASSES = (
    ("SQL Injection", "CRITICAL", "SQLI_RULE", 0.95),
    ("XSS", "HIGH", "XSS_RULE", 0.85),
    ("Path Traversal", "HIGH", "PATH_TRAVERSAL_RULE", 0.88),
    ("Port Scan", "MEDIUM", "SCANNER_UA_RULE", 0.75),
    ("Brute Force", "HIGH", "ADMIN_PROBE_RULE", 0.80),
)


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search; a null text never matches."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def matched_patterns(text: Column, patterns: Sequence[str]) -> Column:
    """The patterns found in ``text``, in list order."""
    return F.filter(F.array(*[F.when(matches(text, p), F.lit(p)) for p in patterns]), lambda p: p.isNotNull())


def keep_hits(df: DataFrame, verdict: Column, name: str) -> DataFrame:
    """Rows with a verdict, added as column ``name``.

    A filter on the verdict would be pushed below it and every pattern evaluated twice; the generator
    evaluates the verdict once per row.
    """
    return df.withColumn(name, F.explode(F.array_compact(F.array(verdict))))


def sqli_signature(uri: Column, referer: Column, threshold: float = 0.5) -> Column:
    """SQL-injection verdict: ``struct(hits, confidence, severity, matched)``, null below the threshold."""
    matched = matched_patterns(F.concat(F.coalesce(uri, F.lit("")), F.lit(" "), F.coalesce(referer, F.lit(""))), SQLI_SIGNATURES)
    hits = F.size(matched)
    confidence = F.least(F.lit(0.5) + 0.17 * hits, F.lit(1.0))
    verdict = F.struct(
        hits.alias("hits"),
        F.round(confidence, 4).alias("confidence"),
        F.when(confidence >= 0.85, "critical").otherwise("high").alias("severity"),
        matched.alias("matched"),
    )
    return F.when((hits > 0) & (confidence >= threshold), verdict)


def traversal_signature(uri: Column, status: Column) -> Column:
    """Traversal verdict; an answered (200) attempt is raised by 0.25 and marked ``succeeded``."""
    matched = matched_patterns(uri, TRAVERSAL_SIGNATURES)
    hits = F.size(matched)
    answered = F.coalesce(status, F.lit(200)) == 200
    base = F.lit(0.6) + 0.1 * hits
    confidence = F.when(answered, F.least(base + 0.25, F.lit(1.0))).otherwise(base)
    verdict = F.struct(
        hits.alias("hits"),
        F.round(F.least(confidence, F.lit(1.0)), 4).alias("confidence"),
        F.when(confidence >= 0.85, "critical").otherwise("high").alias("severity"),
        answered.alias("succeeded"),
        matched.alias("matched"),
    )
    return F.when(hits > 0, verdict)


def is_auth_endpoint(uri: Column) -> Column:
    return matches(uri, AUTH_ENDPOINTS)


def suspicious_path_severity(uri: Column, status: Column) -> Column:
    """HIGH when a probed path answered, MEDIUM when it did not, null for other paths."""
    return F.when(
        matches(uri, SUSPICIOUS_PATHS),
        F.when(F.coalesce(status, F.lit(200)).isin(200, 301, 302), "HIGH").otherwise("MEDIUM"),
    )


def classify_request(uri: Column, agent: Column, status: Column) -> Column:
    """First matching class as ``struct(attack_type, severity, rule, risk)``; null when benign."""
    tests = (
        matches(uri, LOOP_SQLI),
        matches(uri, LOOP_XSS),
        matches(uri, LOOP_TRAVERSAL),
        matches(agent, SCANNER_AGENTS),
        matches(uri, SUSPICIOUS_PATHS),
    )
    chain = None
    for test, (attack_type, severity, rule, risk) in zip(tests, REQUEST_CLASSES, strict=True):
        answered = F.coalesce(status, F.lit(200)).isin(200, 301, 302)
        level = F.when(answered, severity).otherwise("MEDIUM") if rule == "ADMIN_PROBE_RULE" else F.lit(severity)
        verdict = F.struct(
            F.lit(attack_type).alias("attack_type"),
            level.alias("severity"),
            F.lit(rule).alias("rule"),
            F.lit(risk).alias("risk"),
        )
        chain = F.when(test, verdict) if chain is None else chain.when(test, verdict)
    return chain


def agent_suspicion(agent: Column) -> Column:
    """Suspicion of one user agent, 0 (current browser) to 1 (attack tool); 0.5 when unknown."""
    low = F.lower(agent)
    return (
        F.when(agent.isNull(), 0.5)
        .when(low.rlike(ATTACK_TOOL_AGENTS), 1.0)
        .when(agent.isin("", "-"), 0.8)
        .when(low.rlike(SCRIPT_RUNTIME_AGENTS), 0.5)
        .when(low.rlike(FETCH_TOOL_AGENTS), 0.3)
        .when(low.rlike(MODERN_BROWSER_AGENTS), 0.0)
        .otherwise(0.2)
    )


def uri_path(uri: Column) -> Column:
    return F.substring_index(uri, "?", 1)


def normalise_uri(uri: Column) -> Column:
    """Undo common disguises: URL and HTML encoding, case, white space, SQL comments.

    The URL decoding runs twice for double encoding; text that is not valid encoding is kept as is.
    """
    once = F.coalesce(F.try_url_decode(uri), uri)
    text = F.coalesce(F.try_url_decode(once), once)
    # The HTML entities that matter to the signatures.
    for entity, char in (
        (r"&#x0*3c;|&#0*60;|&lt;", "<"),
        (r"&#x0*3e;|&#0*62;|&gt;", ">"),
        (r"&#x0*27;|&#0*39;|&apos;", "'"),
        (r"&#x0*22;|&#0*34;|&quot;", '"'),
        (r"&#x0*2f;|&#0*47;|&sol;", "/"),
        (r"&#x0*26;|&#0*38;|&amp;", "&"),
    ):
        text = F.regexp_replace(text, f"(?i)({entity})", char)
    text = F.regexp_replace(F.lower(text), r"/\*.*?\*/", " ")
    text = F.regexp_replace(text, r"\s+", " ")
    return F.regexp_replace(text, r"--", "")


def node_type(name: Column) -> Column:
    """``host`` for dotted digits, ``domain`` for everything else."""
    return F.when(F.regexp_replace(name, r"\.", "").rlike("^[0-9]+$"), "host").otherwise("domain")


def is_internal(ip: Column) -> Column:
    return ip.startswith("10.")
