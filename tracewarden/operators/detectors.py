"""Rate, burst, error and signature detectors in event time, one row per firing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewarden.functions import signatures as S
from tracewarden.functions.maths import ratio
from tracewarden.operators.features import bucket_of
from tracewarden.operators.folds import anchored_groups, ema_before
from tracewarden.operators.scale import prefix_sums, trailing_counts, trailing_rows

MINUTE_US = 60_000_000
# Window in minutes, requests that may fall into it, label and severity.
MULTI_WINDOWS = ((1, 6, "1m", "critical"), (5, 20, "5m", "high"), (60, 80, "60m", "high"))
# Names of the five rules, cheapest first.
RULES = ("sql_injection", "path_traversal", "login_brute_force", "rate_limit", "error_rate_spike")


def login_brute_force(log: DataFrame, *, threshold: float = 10, width_us: int = MINUTE_US) -> DataFrame:
    """Failed logins of one address above the threshold within the window, left edge included."""
    failed = log.filter(F.col("status").isin(401, 403) & S.is_auth_endpoint(F.col("request_uri")))
    fired = trailing_counts(failed, "remote_addr", "us", {width_us: threshold}).drop("n", "width_us")
    confidence = F.least(F.col("frame_count") / F.lit(threshold), F.lit(1.0))
    return failed.select("event_id", "remote_addr", "us").join(fired, ["remote_addr", "us"]).select(
        "event_id",
        "remote_addr",
        "us",
        F.lit("login_brute_force").alias("rule"),
        F.col("frame_count").alias("failures"),
        F.round(confidence, 4).alias("confidence"),
        F.when(confidence >= 0.9, "critical").otherwise("high").alias("severity"),
    )


def rate_limit(log: DataFrame, threshold: Column | float = 30.0, *, width_us: int = MINUTE_US, minute_us: int = MINUTE_US) -> DataFrame:
    """Requests per minute above the learned threshold.  The capped confidence never reaches critical; the
    uncapped ``rate_ratio`` is reported beside it."""
    per_minute = minute_us / width_us
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    fired = trailing_counts(log, "remote_addr", "us", {width_us: limit / per_minute}).drop("n", "width_us")
    rate = F.col("frame_count") * per_minute
    return (
        log.select("event_id", "remote_addr", "us")
        .join(fired, ["remote_addr", "us"])
        .withColumn("_limit", limit)
        .select(
            "event_id",
            "remote_addr",
            "us",
            F.lit("rate_limit").alias("rule"),
            F.round(rate, 2).alias("req_per_min"),
            F.round(F.least(rate / F.col("_limit"), F.lit(1.0)), 4).alias("confidence"),
            (rate / F.col("_limit")).alias("rate_ratio"),
            F.lit("high").alias("severity"),
            F.col("frame_count").alias("window_requests"),
        )
    )


def flood_or_classify(log: DataFrame, limit: Column | float = 30.0, *, width_us: int = MINUTE_US) -> DataFrame:
    """Flooding events become flood alerts; every other event goes through the request classifier.

    An event exactly one window old no longer counts here.
    """
    bound = limit if isinstance(limit, Column) else F.lit(float(limit))
    fired = trailing_counts(log, "remote_addr", "us", {width_us: bound}, inclusive=False).select("remote_addr", "us", "frame_count")
    n, lim = F.col("frame_count"), F.col("_limit")
    flood = F.struct(
        F.lit("DoS Flood").alias("attack_type"),
        F.when(n > lim * 3, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.lit("RATE_LIMIT_RULE").alias("rule"),
        F.least(F.lit(0.99), 0.6 + n / (lim * 5)).alias("risk"),
    )
    hit = S.classify_request(F.col("request_uri"), F.col("http_user_agent"), F.col("status"))
    joined = log.join(fired, ["remote_addr", "us"], "left").withColumn("_limit", bound)
    judged = S.keep_hits(joined, F.when(n.isNotNull(), flood).otherwise(hit), "h")
    return judged.select(
        "event_id",
        "remote_addr",
        "us",
        "h.attack_type",
        "h.severity",
        "h.rule",
        F.col("h.risk").alias("risk_score"),
        F.when(n.isNotNull(), F.least(F.lit(0.99), 0.65 + n / (lim * 5))).otherwise(F.round(F.col("h.risk") * 0.9 + 0.05, 3)).alias("ml_score"),
    )


def error_rate_spike(
    log: DataFrame,
    *,
    size: int = 100,
    overall: Column | float = 0.30,
    limit_4xx: Column | float = 0.25,
    limit_5xx: Column | float = 0.10,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Error shares over the last ``size`` events, of all sources or per ``keys``."""
    floor = lambda v: F.greatest(v if isinstance(v, Column) else F.lit(float(v)), F.lit(0.001))
    s = F.coalesce(F.col("status"), F.lit(200))
    framed = trailing_rows(
        log.select("event_id", "us", "remote_addr", "status"),
        list(keys),
        ["us", "event_id"],
        size,
        {"e4": F.when(s.between(400, 499), 1).otherwise(0), "e5": F.when(s >= 500, 1).otherwise(0)},
    ).withColumns({"_lo": floor(overall), "_l4": floor(limit_4xx), "_l5": floor(limit_5xx)})
    rows = F.col("frame_rows")
    rates = framed.filter(rows >= max(10, size // 10)).withColumns(
        {"error_rate": (F.col("e4") + F.col("e5")) / rows, "rate_4xx": F.col("e4") / rows, "rate_5xx": F.col("e5") / rows}
    )
    breach = lambda r, lim: F.when(F.col(r) > F.col(lim), F.col(r) / F.col(lim))
    worst = F.greatest(breach("error_rate", "_lo"), breach("rate_4xx", "_l4"), breach("rate_5xx", "_l5"))
    return rates.withColumn("_worst", worst).filter(F.col("_worst").isNotNull()).select(
        "event_id",
        "remote_addr",
        "us",
        F.lit("error_rate_spike").alias("rule"),
        F.when(F.col("rate_5xx") > F.col("_l5") * 2, "critical").otherwise("high").alias("severity"),
        F.round(F.least(F.col("_worst") / 2, F.lit(1.0)), 4).alias("confidence"),
        *[F.round(c, 4).alias(c) for c in ("error_rate", "rate_4xx", "rate_5xx")],
        F.col("frame_rows").alias("window_size"),
    )


def multi_window(log: DataFrame, *, minute_us: int = MINUTE_US, windows=MULTI_WINDOWS) -> DataFrame:
    """Requests above the limit of a short, a medium or a long window; one row per event and window."""
    fired = trailing_counts(log, "remote_addr", "us", {m * minute_us: limit for m, limit, _, _ in windows})
    dim = F.array(
        *[
            F.struct(F.lit(m * minute_us).cast("long").alias("w"), F.lit(limit).alias("threshold"), F.lit(label).alias("window_label"), F.lit(sev).alias("severity"))
            for m, limit, label, sev in windows
        ]
    )
    named = fired.withColumn("d", F.explode(dim)).filter(F.col("d.w") == F.col("width_us"))
    return (
        log.select("event_id", "remote_addr", "us")
        .join(named.select("remote_addr", "us", F.col("frame_count").alias("requests"), "d.threshold", "d.window_label", "d.severity"), ["remote_addr", "us"])
    )


def window_state(log: DataFrame, at: Column, *, minute_us: int = MINUTE_US, windows=MULTI_WINDOWS) -> DataFrame:
    """Requests of every address in each window ending at ``at``."""
    age = F.col("_at") - F.col("us")
    return log.withColumn("_at", at).filter(age >= 0).groupBy("remote_addr").agg(
        *[F.count_if(age <= m * minute_us).alias(f"count_{label}") for m, _, label, _ in windows],
        *[F.lit(limit).alias(f"threshold_{label}") for _, limit, label, _ in windows],
    )


def event_estimates(log: DataFrame) -> DataFrame:
    """Per-event estimates of rate, error and entropy the adaptive layers work on."""
    error = F.coalesce(F.col("status"), F.lit(200)) >= 400
    slashes = F.length("request_uri") - F.length(F.replace("request_uri", F.lit("/"), F.lit("")))
    return log.select(
        "event_id", "remote_addr", "us",
        F.when(error, 3.1).otherwise(2.1).alias("rate"),
        F.when(error, 1.0).otherwise(0.0).alias("err"),
        F.when(slashes > 2, 0.3).otherwise(1.8).alias("ent"),
    )


def behavioural_fingerprint(observed: DataFrame, *, threshold: float = 5.0) -> DataFrame:
    """Distance of each observation from its own entity's moving baseline, scored before the update."""
    df = ema_before(observed, ["remote_addr"], ["us", "event_id"], {"rate": 2.1, "err": 0.05, "ent": 1.8}, 0.1)
    rate_z = (F.col("rate") - F.col("rate_before")) / (F.col("rate_before") * 0.3 + 0.1)
    error_z = (F.col("err") - F.col("err_before")) / 0.1
    entropy_z = F.abs(F.col("ent") - F.col("ent_before")) / 0.5
    return (
        df.withColumns({"rate_z": rate_z, "error_z": error_z, "entropy_z": entropy_z})
        .withColumn("composite", 0.5 * F.col("rate_z") + 0.3 * F.col("error_z") + 0.2 * F.col("entropy_z"))
        .withColumn("anomalous", F.col("composite") > threshold)
        .withColumn("baseline_rate", 0.1 * F.col("rate") + 0.9 * F.col("rate_before"))
    )


def dynamic_threshold(observed: DataFrame, *, rate: str = "rate", k: float = 3.0, seed_mean: float = 2.1, seed_m2: float = 0.49) -> DataFrame:
    """Running mean + k sigma over all events so far, never below 1.

    The first observation replaces the seed mean, so the running state has a closed form in three prefix
    sums; they are taken around the seed mean, which keeps the difference of squares small.
    """
    x = F.col(rate) - F.lit(seed_mean)
    df = prefix_sums(observed, [], ["us", "event_id"], {"_n": F.lit(1), "_s1": x, "_s2": x * x})
    n = F.col("_n")
    mean = F.lit(seed_mean) + F.col("_s1") / n
    m2 = F.lit(seed_m2) + F.greatest(F.col("_s2") - F.col("_s1") * F.col("_s1") / n, F.lit(0.0))
    sigma = F.sqrt(F.when(n > 1, m2 / (n - 1)).otherwise(seed_m2))
    return df.withColumn("dynamic_threshold", F.greatest(mean + k * sigma, F.lit(1.0))).drop("_n", "_s1", "_s2")


def adaptive_decision(log: DataFrame, ml_score: Column, *, minute_us: int = MINUTE_US) -> DataFrame:
    """Combine window correlation, fingerprint and model score into one decision per event."""
    observed = event_estimates(log)
    firing = multi_window(log, minute_us=minute_us).groupBy("event_id").agg(F.count(F.lit(1)).alias("windows"))
    prints = behavioural_fingerprint(observed).select("event_id", "composite", "anomalous")
    limits = dynamic_threshold(observed).select("event_id", "dynamic_threshold")
    df = (
        log.select("event_id", "remote_addr", ml_score.alias("ml"))
        .join(prints, "event_id")
        .join(limits, "event_id")
        .join(firing, "event_id", "left")
        .withColumn("windows", F.coalesce("windows", F.lit(0)))
    )
    behaviour = F.when(F.col("anomalous"), F.least(F.col("composite") / 10, F.lit(1.0))).otherwise(0.0)
    risk = (
        0.4 * F.least(F.col("windows") * 0.3, F.lit(1.0)) + 0.3 * behaviour + 0.3 * F.least(F.greatest(F.col("ml"), F.lit(0.0)), F.lit(1.0))
    )
    r = F.col("risk")
    signals = F.array_compact(
        F.array(
            F.when(F.col("windows") > 0, F.format_string("multi_window (%d windows)", "windows")),
            F.when(F.col("anomalous"), F.format_string("behavioral (score=%.1f)", "composite")),
            F.when(F.col("ml") > 0.5, F.format_string("ml_score=%.2f", "ml")),
        )
    )
    return df.withColumn("risk", risk).select(
        "event_id",
        "remote_addr",
        (r > 0.7).alias("alerted"),
        F.when(r > 0.9, "critical").when(r > 0.7, "high").when(r > 0.5, "medium").otherwise("info").alias("severity"),
        F.round("risk", 3).alias("risk_score"),
        F.round("dynamic_threshold", 2).alias("dynamic_threshold"),
        signals.alias("signals"),
    )


def confirm(df: DataFrame, flag: Column, *, entity: str = "entity_id", order: Sequence[str] = ("us", "event_id"), size: int = 10, needed: int = 4) -> DataFrame:
    """Escalate once ``needed`` of the entity's last ``size`` events were anomalous, the window being full."""
    framed = trailing_rows(df, [entity], list(order), size, {"hits": F.when(flag, 1).otherwise(0)})
    return framed.withColumns(
        {
            "escalated": (F.col("frame_rows") == size) & (F.col("hits") >= needed),
            "anomaly_rate": F.col("hits") / F.col("frame_rows"),
        }
    ).drop("position")


def suppress(alerts: DataFrame, *, keys: Sequence[str], order: Sequence[str], suppress_after: int = 3, quiet_us: int = 300_000_000) -> DataFrame:
    """Mark the ``suppress_after``-th and later alerts of a key; memory restarts once more than the quiet
    period has passed since its *first* alert."""
    df = anchored_groups(alerts, keys, order, quiet_us, closes=False)
    return df.withColumn("suppressed", F.col("group_seq") >= suppress_after)


def suppression_stats(suppressed: DataFrame, keys: Sequence[str], suppress_after: int = 3) -> DataFrame:
    state = suppressed.groupBy(*keys).agg(F.max(F.struct("anchor_us", "group_seq")).alias("s"))
    return state.agg(
        F.count(F.lit(1)).alias("total_tracked"), F.count_if(F.col("s.group_seq") >= suppress_after).alias("currently_suppressed")
    )


def incidents(alerts: DataFrame, *, entity: str, category: str, order: Sequence[str], score: str, level_rank: Column, names: Sequence[str], span_us: int = 120_000_000) -> DataFrame:
    """Group an entity's alerts of one category; the alert at or beyond the span closes its incident and
    belongs to it.  Groups still open at the end are incidents too."""
    df = anchored_groups(alerts.withColumn("_rank", level_rank.cast("int")), [entity, category], order, span_us, closes=True)
    grouped = df.groupBy(entity, category, "anchor_us").agg(
        F.max(order[0]).alias("last_seen_us"),
        F.count(F.lit(1)).alias("alert_count"),
        F.max(score).alias("max_score"),
        F.max("_rank").alias("_rank"),
    )
    severity = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_rank") + 1)
    return grouped.select(
        F.concat(F.lit("INC-"), F.substring(F.md5(F.concat_ws("|", entity, category, F.col("anchor_us").cast("string"))), 1, 12)).alias("incident_id"),
        entity,
        category,
        F.col("anchor_us").alias("first_seen_us"),
        "last_seen_us",
        "alert_count",
        "max_score",
        severity.alias("severity"),
        (F.col("last_seen_us") - F.col("anchor_us") >= span_us).alias("closed"),
    )


def slow_and_low(df: DataFrame, hybrid: Column, ml: Column, rule: Column, behaviour: Column, malicious: Column) -> DataFrame:
    """How often each component, and the confirmed hybrid flag, caught an entity's malicious events."""
    c = confirm(df.withColumns({"_h": hybrid, "_m": ml, "_r": rule, "_b": behaviour, "_bad": malicious}), F.col("_h"))
    bad = F.col("_bad")
    found = F.col("escalated") & bad
    row = c.groupBy("entity_id").agg(
        F.count_if(bad).alias("true_attacks"),
        F.count_if(F.col("_m") & bad).alias("ml"),
        F.count_if(F.col("_r") & bad).alias("rule"),
        F.count_if(F.col("_b") & bad).alias("behavior"),
        F.count_if(found).alias("hybrid"),
        F.min(F.when(bad, F.col("us"))).alias("_first"),
        F.min(F.when(found, F.col("us"))).alias("_found"),
    )
    return row.withColumns(
        {
            "detection_rate": F.col("hybrid") / F.greatest(F.col("true_attacks"), F.lit(1)),
            "delay_seconds": (F.col("_found") - F.col("_first")) / 1e6,
        }
    ).drop("_first", "_found")


def cross_source(log: DataFrame, *, width_us: int = MINUTE_US, min_sources: int = 10) -> DataFrame:
    """Many addresses of one /24 on the same path in one window."""
    g = log.groupBy(
        F.substring_index("remote_addr", ".", 3).alias("subnet"), S.uri_path(F.col("request_uri")).alias("path"), bucket_of(F.col("us"), width_us).alias("bucket")
    ).agg(F.count_distinct("remote_addr").alias("sources"), F.count(F.lit(1)).alias("requests"))
    return g.filter(F.col("sources") >= min_sources)


def assembled_requests(log: DataFrame, *, fragments: int = 5, span_us: int = 5 * MINUTE_US) -> DataFrame:
    """Re-run the injection signature on the address' last ``fragments`` requests joined together.

    The sliding assembly finds payloads split over consecutive requests without ever holding a session.
    """
    framed = trailing_rows(
        log.select("event_id", "remote_addr", "us", "request_uri"), ["remote_addr"], ["us", "event_id"], fragments, {},
        lists={"recent": F.struct("us", "request_uri")},
    )
    near = F.filter("recent", lambda x: F.col("us") - x["us"] <= F.lit(span_us))
    text = F.array_join(F.transform(near, lambda x: x["request_uri"]), "")
    return (
        S.keep_hits(framed.withColumn("assembled", text), S.sqli_signature(F.col("assembled"), F.lit("-")), "v")
        .select("event_id", "remote_addr", "assembled", "v.hits", "v.confidence", "v.severity")
    )


def _session_starts(log: DataFrame, gap_us: int) -> DataFrame:
    """``log`` with ``start_us`` of the session of its address, from one row per address and gap-wide cell."""
    cell = F.floor(F.col("us") / F.lit(gap_us))
    cells = log.groupBy(F.col("remote_addr").alias("_a"), cell.alias("_c")).agg(F.min("us").alias("_first"), F.max("us").alias("_last"))
    w = Window.partitionBy("_a").orderBy("_c")
    fresh = F.coalesce(F.col("_first") - F.lag("_last").over(w) > F.lit(gap_us), F.lit(True))
    opened = cells.withColumn("_o", F.when(fresh, F.col("_first")))
    starts = opened.select("_a", "_c", F.last("_o", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("start_us"))
    dated = log.withColumn("_cell", cell)
    return dated.join(starts, F.col("remote_addr").eqNullSafe(F.col("_a")) & F.col("_cell").eqNullSafe(F.col("_c"))).drop("_a", "_c", "_cell")


def session_payloads(log: DataFrame, *, gap_us: int = 30 * MINUTE_US, piece: int = 4096, reach: int = 1024) -> DataFrame:
    """The injection signature over all requests of a session joined together, however many they are.

    Rows: ``remote_addr, start_us, end_us, requests, hits, confidence, severity`` of the sessions with a hit.  A session
    is never gathered: running lengths place every request in its session's text, the text is cut into pieces that
    overlap by ``reach`` characters, and a piece is matched on its own.  A signature with an open gap (``A.*B``) holds
    if the first A of the session ends before its last B starts.  Line ends count as spaces, a run of spaces in a
    request as one, a run of digits by its ends; no other signature is longer than ``reach``.  Rows without an address
    are an address of their own; a missing request adds nothing.
    """
    text = F.regexp_replace(F.coalesce("request_uri", F.lit("")), r"[\s\u0085\u2028\u2029]+", " ")
    text = F.regexp_replace(text, r"([0-9]{32})[0-9]+([0-9]{32})", "$1$2")
    dated = _session_starts(log.select("event_id", "remote_addr", "us", text.alias("_text")), gap_us)
    keys = ["remote_addr", "start_us"]
    placed = prefix_sums(dated, keys, ["us", "event_id"], {"_end": F.length("_text")}, totals=True).filter("_text <> ''")
    start, end = F.col("_end") - F.length("_text"), F.col("_end")
    # piece k holds the characters from k * piece - 1 (context only) to (k + 1) * piece + reach
    low, high = lambda k: k * piece - 1, lambda k: (k + 1) * piece + reach
    part = lambda k: F.struct(
        k.alias("k"),
        F.greatest(start, low(k)).alias("at"),
        F.substring("_text", (F.greatest(start, low(k)) - start + 1).cast("int"), (F.least(end, high(k)) - F.greatest(start, low(k))).cast("int")).alias("s"),
    )
    numbers = F.sequence(F.greatest(F.lit(0), F.floor((start - reach) / piece)), F.floor(end / piece))
    parts = placed.select(*keys, F.col("_end_total").alias("_total"), F.explode(F.transform(numbers, part)).alias("p")).select(*keys, "_total", "p.*")
    pieces = parts.filter("s <> ''").groupBy(*keys, "k").agg(
        F.first("_total").alias("_total"), F.array_sort(F.collect_list(F.struct("at", "s"))).alias("_parts")
    )
    joined = F.concat(
        F.when(F.col("k") == 0, " ").otherwise(""),
        F.array_join(F.transform("_parts", lambda x: x["s"]), ""),
        F.when(high(F.col("k")) >= F.col("_total"), " -").otherwise(""),
    )
    cut = pieces.select(*keys, "k", joined.alias("t"))
    closed = [p for p in S.SQLI_SIGNATURES if ".*" not in p]
    gaps = [p.strip("()").split(".*") for p in S.SQLI_SIGNATURES if ".*" in p]

    def place(word: str, last: bool) -> Column:
        """Where ``word`` starts in the session, first or last time in the piece; a character stands on both sides."""
        before = F.length(F.regexp_extract("t", f"(?is)^(.+{'' if last else '?'}){word}.", 1))
        return F.when(before > 0, before + low(F.col("k")))

    aggs = [F.bool_or(F.col("t").rlike(rf"(?i)(?<=[\s\S])(?:{p})(?=[\s\S])")).alias(f"_c{i}") for i, p in enumerate(closed)]
    for i, (a, b) in enumerate(gaps):
        size = len(a.replace(r"\b", ""))
        aggs += [F.min(place(a, False) + size).alias(f"_a{i}"), F.max(place(b, True)).alias(f"_b{i}")]
    flags = [F.col(f"_c{i}") for i in range(len(closed))] + [F.coalesce(F.col(f"_a{i}") <= F.col(f"_b{i}"), F.lit(False)) for i in range(len(gaps))]
    hits = sum((f.cast("int") for f in flags), F.lit(0))
    hit = cut.groupBy(*keys).agg(*aggs).select(F.col("remote_addr").alias("_a"), F.col("start_us").alias("_s"), hits.alias("hits")).filter("hits > 0")
    whole = dated.groupBy(*keys).agg(F.max("us").alias("end_us"), F.count(F.lit(1)).alias("requests"))
    confidence = F.least(F.lit(0.5) + 0.17 * F.col("hits"), F.lit(1.0))
    return whole.join(hit, F.col("remote_addr").eqNullSafe(F.col("_a")) & F.col("start_us").eqNullSafe(F.col("_s"))).select(
        *keys, "end_us", "requests", "hits", F.round(confidence, 4).alias("confidence"), F.when(confidence >= 0.85, "critical").otherwise("high").alias("severity")
    )


def rule_set(log: DataFrame, *, rate_threshold: Column | float = 30.0, auth_threshold: float = 10, width_us: int = MINUTE_US, minute_us: int = MINUTE_US, spike: dict | None = None) -> DataFrame:
    """Detections of all five rules as ``event_id, remote_addr, rule, confidence, severity``."""
    cols = ["event_id", "remote_addr", "rule", "confidence", "severity"]
    verdicts = (
        ("sql_injection", S.sqli_signature(F.col("request_uri"), F.col("http_referer"))),
        ("path_traversal", S.traversal_signature(F.col("request_uri"), F.col("status"))),
    )
    signed = [
        S.keep_hits(log, v, "v").select("event_id", "remote_addr", F.lit(name).alias("rule"), "v.confidence", "v.severity") for name, v in verdicts
    ]
    framed = [
        login_brute_force(log, threshold=auth_threshold, width_us=width_us),
        rate_limit(log, rate_threshold, width_us=width_us, minute_us=minute_us),
        error_rate_spike(log, **(spike or {})),
    ]
    out = signed[0].unionByName(signed[1])
    for d in framed:
        out = out.unionByName(d.select(*cols))
    return out


def any_rule(log: DataFrame, detections: DataFrame) -> DataFrame:
    """One verdict per event: flagged by any rule, and the highest confidence."""
    per = detections.groupBy("event_id").agg(F.max("confidence").alias("_c"), F.count_distinct("rule").alias("_n"))
    return log.select("event_id").join(per, "event_id", "left").select(
        "event_id", F.col("_c").isNotNull().alias("detected"), F.coalesce("_c", F.lit(0.0)).alias("score"), F.coalesce("_n", F.lit(0)).alias("rules")
    )


def threat_rules(windows: DataFrame) -> DataFrame:
    """Documented window rules, one row per firing (columns of the feature and extra windows joined)."""
    rules = (
        ("port_scan", F.col("f6_unique_endpoints_per_min") > 50),
        ("brute_force", (F.col("f3_failed_request_ratio") > 0.6) & (F.col("f1_request_frequency") > F.col("frequency_limit"))),
        ("slow_and_low", F.col("baseline_deviation") > 2.5),
        ("credential_stuffing", (F.col("f1_request_frequency") > F.col("frequency_limit")) & (F.col("auth_failure_rate") > F.col("auth_limit"))),
    )
    fired = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])))
    return windows.select("ip", "bucket", fired.alias("rule"))
