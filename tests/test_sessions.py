"""Payloads over whole sessions against the joined text of each session."""

import random
import re

import pytest

from tracewarden.functions import signatures as S
from tracewarden.operators import detectors

SCHEMA = "event_id long, remote_addr string, us long, request_uri string"


def brute(rows, gap):
    by_key = {}
    for i, a, us, uri in sorted(rows, key=lambda r: (r[2], r[0])):
        of = by_key.setdefault(a, [])
        if not of or us - of[-1][1] > gap:
            of.append([us, us, 0, ""])
        of[-1][1] = us
        of[-1][2] += 1
        of[-1][3] += re.sub(r"\s+", " ", uri or "")
    out = set()
    for a, sessions in by_key.items():
        for first, last, n, text in sessions:
            hits = sum(re.search(p, text + " -", re.I) is not None for p in S.SQLI_SIGNATURES)
            if hits:
                out.add((a, first, last, n, hits))
    return out


def found(spark, rows, gap, **sizes):
    df = detectors.session_payloads(spark.createDataFrame(rows, SCHEMA), gap_us=gap, **sizes)
    return {(r.remote_addr, r.start_us, r.end_us, r.requests, r.hits) for r in df.collect()}


def test_random_sessions(spark):
    """Short pieces, so that payloads lie across many of them."""
    rng = random.Random(9)
    bits = ["UNION", "union ", "SEL", "ECT", "FROM", " OR ", "1", "=1", "'", ";-", "-", "--", "EXEC", "UTE", "x", " ", "_", "%2", "7", "sleep", " (", "\n", "", None, "INSERT", "INTO", "waitfor", "delay", "xp_", "cmdshell"]
    rows = []
    for i in range(4000):
        rows.append((i, rng.choice(["a", "b", "c", "d", None]), rng.randrange(400_000), rng.choice(bits + ["/p/" + "q" * rng.randrange(30)])))
    for gap in (100, 1_000, 20_000):
        assert found(spark, rows, gap, piece=48, reach=40) == brute(rows, gap)


@pytest.mark.parametrize("fragments", [2, 7, 40])
def test_split_payload_is_found_once(spark, fragments):
    """A payload in many requests, one address with most rows, slices in between."""
    payload = "1 UNION ALL SELECT password FROM users"
    step = -(-len(payload) // fragments)
    cuts = [payload[k * step : (k + 1) * step] for k in range(fragments)]
    rows = [(i, "hot", 10 * i, "/index") for i in range(3000)]
    for k, c in enumerate(cuts):
        rows.append((10_000 + k, "hot", 600 * (k + 1) + 5, c))
        rows.append((20_000 + k, "cold", 600 * (k + 1), c))
    assert found(spark, rows, 1_000) == brute(rows, 1_000)
    assert ("cold", 600, 600 * fragments, fragments, 2) in found(spark, rows, 1_000)


def test_order_and_silence(spark):
    rows = [(1, "a", 0, "SELECT"), (2, "a", 10, " x UNION"), (3, "b", 0, "UNION "), (4, "b", 5_000, " SELECT"), (5, "c", 0, "UNION"), (6, "c", 1, "SELECT")]
    assert found(spark, rows, 100) == set()


def test_long_texts_and_empty_tables(spark):
    long = "/" + "y" * 300_000
    rows = [(1, "a", 0, "UNION"), (2, "a", 1, " " + long), (3, "a", 2, " SELECT"), (4, "n", 0, "or " + "7" * 5000 + " " * 3000 + "= 1"), (5, "e", 0, None), (6, "e", 0, "")]
    assert found(spark, rows, 100) == {("a", 0, 2, 3, 1), ("n", 0, 0, 1, 1)}
    assert found(spark, [], 100) == set()
