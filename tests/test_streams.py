"""Keyed streams against a fold in event order: rows out of order, rows too late, keys that leave the state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_scale import reference_groups
from tracewarden.operators.folds import ema_path
from tracewarden.streaming import jobs

SECOND = 1_000_000
END = 9_183_110_400_000_000
SCHEMA = "event_id long, us long, source_ip string, attack_type string, risk_score double, flag int"


def feed(spark, folder, batches, build, schema=SCHEMA):
    """Each list of rows is a file and a micro-batch of its own; a last row ends the input."""
    shape = spark.createDataFrame([], schema).schema
    last = tuple({"us": END, "event_id": -1, "source_ip": "end", "attack_type": "end", "risk_score": 0.0, "flag": 0}[f.name] for f in shape)
    for rows in [*batches, [last]]:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    with jobs.ProgressLog(spark, f"{folder}/progress", held=2) as log:
        stream = jobs.read_pages(spark, f"{folder}/in", shape, 1).withColumn("ts", F.timestamp_micros("us"))
        query = jobs.start(build(stream), f"{folder}/out", f"{folder}/checkpoint", poll=None)
        query.awaitTermination()
        progress = log.table([query]).orderBy("batch_id").collect()
    return spark.read.parquet(f"{folder}/out"), progress


def made(seed, n=400, keys=4):
    """Rows in order of time and, drawn from up to 30 s later, their order of arrival in six batches."""
    rng, t, rows = random.Random(seed), 1000 * SECOND, []  # the first watermark is 1970
    for i in range(n):
        t += rng.choice([0, 0, 1, 2, 25 if rng.random() < 0.05 else 1]) * SECOND
        rows.append((i, t, f"ip{rng.randrange(keys)}", "x", float(rng.randrange(100)), rng.randrange(2)))
    arrival = sorted(rows, key=lambda r: r[1] + rng.random() * 30 * SECOND)
    return rows, [arrival[k * n // 6 : (k + 1) * n // 6] for k in range(6)]


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[2], []).append(r)
    return out


@pytest.mark.parametrize("seed", [1])
def test_suppression_and_confirmation_in_event_order(spark, tmp_path, seed):
    rows, batches = made(seed)
    assert [r for b in batches for r in b] != rows
    found, progress = feed(spark, f"{tmp_path}/s", batches, lambda s: jobs.suppression(s, "31 seconds", suppress_after=3, quiet_us=20 * SECOND))
    got = {r.event_id: r.suppressed for r in found.collect()}
    assert sum(p.rows > 0 for p in progress) == 7 and sum(p.dropped_late for p in progress) == 0
    for group in by_key(rows).values():
        for r, (_, seq) in zip(group, reference_groups([x[1] for x in group], 20 * SECOND, False), strict=True):
            assert got[r[0]] == (seq >= 3)
    found, _ = feed(spark, f"{tmp_path}/c", batches, lambda s: jobs.confirmations(s.withColumnRenamed("source_ip", "entity_id"), "31 seconds", size=4, needed=3, keep_ms=10**9))
    got = {r.event_id: r.escalated for r in found.collect()}
    for group in by_key(rows).values():
        for i, r in enumerate(group):
            window = [x[5] for x in group[max(0, i - 3) : i + 1]]
            assert got[r[0]] == (len(window) == 4 and sum(window) >= 3)


def test_incidents_in_event_order(spark, tmp_path):
    rows, batches = made(3)
    found, _ = feed(spark, str(tmp_path), batches, lambda s: jobs.incident_stream(s, "31 seconds", span_us=15 * SECOND))
    got = sorted((r.source_ip, r.first_seen_us, r.last_seen_us, r.alert_count, r.max_score) for r in found.where("source_ip <> 'end'").collect())
    want = []
    for key, group in by_key(rows).items():
        current = []
        for r in group:
            current.append(r)
            if r[1] - current[0][1] >= 15 * SECOND:
                want.append(current)
                current = []
        want += [current] if current else []
    assert got == sorted((g[0][2], g[0][1], g[-1][1], len(g), max(x[4] for x in g)) for g in want)


def test_rows_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    row = lambda i, s: (i, s * SECOND, "a", "x", 1.0, 1)
    batches = [[row(0, 100), row(1, 101)], [row(2, 300)], [row(6, 301)], [row(3, 102), row(4, 295)], [row(5, 310)]]
    found, progress = feed(spark, str(tmp_path), batches, lambda s: jobs.suppression(s, "10 seconds", suppress_after=2, quiet_us=60 * SECOND))
    got = {r.event_id: r.suppressed for r in found.collect()}
    assert got == {0: False, 1: True, 4: False, 2: True, 6: True, 5: True}  # row 3 is too late, row 4 comes before row 2
    assert sum(p.dropped_late for p in progress) == 1


def test_silent_keys_leave_the_state(spark, tmp_path):
    """A key forgotten after its quiet period starts anew; an incident closes by its timer."""
    row = lambda i, s, ip="a": (i, (10_000 + s) * SECOND, ip, "x", float(i), 1)
    batches = [[row(0, 0), row(1, 1)], [row(2, 1000, "b")], [row(3, 1001, "b")], [row(4, 2000)], [row(5, 2001)]]
    build = lambda s: jobs.confirmations(s.withColumnRenamed("source_ip", "entity_id"), "1 second", size=2, needed=2, keep_ms=100_000)
    found, _ = feed(spark, f"{tmp_path}/c", batches, build)
    assert {r.event_id: r.escalated for r in found.collect()} == {0: False, 1: True, 2: False, 3: True, 4: False, 5: True}
    found, _ = feed(spark, f"{tmp_path}/i", batches, lambda s: jobs.incident_stream(s, "1 second", span_us=3600 * SECOND, close_after_us=60 * SECOND))
    got = sorted((r.source_ip, r.first_seen_us // SECOND - 10_000, r.alert_count) for r in found.where("source_ip <> 'end'").collect())
    assert got == [("a", 0, 2), ("a", 2000, 2), ("b", 1000, 2)]


def test_ema_blocks_keep_the_digits():
    rng = np.random.default_rng(1)
    for alpha in (0.001, 0.1, 0.5, 0.9, 0.999, 1.0, 0.0):
        for n in (0, 1, 5, 1000, 3001):
            x = rng.normal(0, 10.0 ** rng.integers(-3, 6), n)
            state, want = 2.1, []
            for v in x:
                want.append(state)
                state = alpha * v + (1 - alpha) * state
            before, after = ema_path(x, alpha, 2.1)
            assert np.allclose(before, want, rtol=1e-10, atol=1e-10 * max(1.0, np.abs(x).max(initial=0))) and abs(after - state) <= 1e-10 * max(1.0, np.abs(x).max(initial=0))


def test_keys_share_groups(spark, tmp_path):
    """A thousand keys take no more calls and rows of state than there are groups, null and empty keys stay apart."""
    keys = [f"ip{k}" for k in range(1000)] + [None, ""]
    row = lambda i, s, ip: (i, (10_000 + s) * SECOND, ip, "x", 0.0, 1)
    batches = [[row(3 * k, 0, ip) for k, ip in enumerate(keys)], [row(3 * k + 1, 5, ip) for k, ip in enumerate(keys)], [row(3 * k + 2, 200, ip) for k, ip in enumerate(keys[:500])]]
    shape = spark.createDataFrame([], SCHEMA).schema
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.read_pages(spark, f"{tmp_path}/in", shape, 1).withColumn("ts", F.timestamp_micros("us"))
    found = jobs.suppression(stream, "20 seconds", suppress_after=2, quiet_us=60 * SECOND)
    jobs.start(found, f"{tmp_path}/out", f"{tmp_path}/checkpoint", poll=None).awaitTermination()
    assert {(r.event_id, r.suppressed) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(3 * k + j, j == 1) for k in range(len(keys)) for j in (0, 1)}
    # what is held: the keys with a row that the watermark has not passed
    assert sorted(r.source_ip for r in jobs.held_keys(spark, f"{tmp_path}/checkpoint").collect()) == sorted(keys[:500])
    assert spark.read.format("statestore").load(f"{tmp_path}/checkpoint").count() < 500


def test_characters_share_rows_of_state(spark, tmp_path):
    """Characters are counted exactly, of any plane, but do not take a row of state each."""
    uris = ["/", "", None, "/é?x=1", "/" + "".join(chr(c) for c in range(0x21, 0x7F)), "/\U0001f600\U0001f600中", "/aab"]
    schema = "event_id long, us long, ts timestamp, remote_addr string, request_uri string, request_method string, http_user_agent string, status int, body_bytes_sent long, request_time double"
    shape = spark.createDataFrame([], schema).schema
    row = lambda i, us, ip, uri: (i, us, None, ip, uri, "GET", "-", 200, 1024, 0.0)
    rows = [row(i, 10_000 * SECOND + i, f"ip{i}", u) for i, u in enumerate(uris)] + [row(20 + i, 10_001 * SECOND + i, "all", u) for i, u in enumerate(uris)]
    stamped = lambda rows: spark.createDataFrame(rows, shape).withColumn("ts", F.timestamp_micros("us"))
    for part in (rows[::2], rows[1::2], [row(99, END, "end", "/")]):
        stamped(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.read_pages(spark, f"{tmp_path}/in", shape, 1)
    query = jobs.start(jobs.behaviour_windows(stream, "1 day", "1 day"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", poll=None)
    query.awaitTermination()
    got = {r.remote_addr: r.f4_uri_char_entropy for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    def entropy(text):
        n = np.array([text.count(c) for c in set(text)], float)
        return float(-(n / n.sum() * np.log2(n / n.sum())).sum()) if len(n) else 0.0

    texts = ["/" if u is None else u for u in uris]
    want = {f"ip{i}": entropy(u) for i, u in enumerate(texts)} | {"all": entropy("".join(texts)), "end": 0.0}
    assert set(got) - {"end"} == set(want) - {"end"}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    held = max(p.stateOperators[-1].numRowsTotal for p in query.recentProgress)
    distinct = sum(len(set(u)) for u in texts) + len(set("".join(texts)))
    assert held < distinct


def test_held_keys_classify_requests_once(spark, tmp_path):
    """The pages, the newest time and the keys come from one table of alerts; the events are not read again for the result."""
    from tracewarden.plans import all_queries
    from tracewarden.sources.tables import Tables

    day = 86_400 * SECOND
    rows = [(i, 1_704_067_200 * SECOND + i * day // 10, i % 7 * 10 if i < 250 else 0, ("click", "error")[i % 2], float(i % 90), "{}") for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double, props string")
    events.select("event_id", F.timestamp_micros("us").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    found = all_queries()["win19_held_keys"](spark, str(tmp_path))
    assert not [f for f in found.inputFiles() if "events.parquet" in f]
    last = {}
    for r in Tables(spark, str(tmp_path)).alerts.collect():
        key = r.source_ip, r.attack_type or ""
        last[key] = max(last.get(key, 0), r.us)
    passed = max(last.values()) // 1000 - 2 * 86_400_000
    want = {(*k, us // 1000 + 600_001 > passed, False) for k, us in last.items()}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want and len({w[2] for w in want}) == 2
