"""The detectors as streaming queries.

Windows and joins use the built-in streaming operators.  Per-key recursions fold rows in event order, whatever
the order in which they arrive: a row waits in the state until the watermark has passed it, a timer then takes
all such rows of the key in order through the same small helpers as the batch jobs.  So the state of a key holds a
few numbers and its rows within the watermark's delay, and idle keys leave it by timer.  Keys share groups by their
hash: a call of Python and a row of state serve many of them.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewarden.functions import signatures as S
from tracewarden.operators.features import BASELINE_DEFAULTS, BLOCK, letter_blocks, summed
from tracewarden.operators.folds import walk_groups
from tracewarden.sources import files


def read_pages(spark, path: str, schema, files: int) -> DataFrame:
    """A growing folder of tables as a stream, at most ``files`` new files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def start(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append", poll: str | None = "5 seconds"):
    """Parquet sink polled every ``poll``; ``poll=None`` processes what is available and ends."""
    writer = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if poll is None else writer.trigger(processingTime=poll)).start()


def start_alert_sink(df: DataFrame, path: str, checkpoint: str, *, poll: str | None = "5 seconds"):
    """Idempotent alert sink: a replayed batch rewrites exactly its own partition."""
    writer = df.writeStream.foreachBatch(lambda batch, batch_id: files.write_alert_batch(batch, path, batch_id)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if poll is None else writer.trigger(processingTime=poll)).start()


def classified_alerts(log: DataFrame, watermark: str) -> DataFrame:
    """Classifier alerts with stable ids, repeats within the watermark dropped."""
    hit = S.classify_request(F.col("request_uri"), F.col("http_user_agent"), F.col("status"))
    fired = S.keep_hits(log, hit, "h")
    rows = fired.select(
        "event_id", "ts", "us", F.col("remote_addr").alias("source_ip"), F.col("h.attack_type").alias("attack_type"), F.col("h.severity").alias("severity"), F.col("h.rule").alias("rule")
    )
    return files.with_alert_key(rows, "event_id", "rule").withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["alert_id"])


def sliding_rate(log: DataFrame, width: str, slide: str, watermark: str, floor: float) -> DataFrame:
    """Sources above ``floor`` requests in any sliding window."""
    w = log.withWatermark("ts", watermark).groupBy(F.window("ts", width, slide), "remote_addr").agg(F.count(F.lit(1)).alias("requests"))
    return w.filter(F.col("requests") > floor).select("remote_addr", F.unix_micros("window.start").alias("start_us"), "requests")


def feature_windows(log: DataFrame, width: str, watermark: str) -> DataFrame:
    """Tumbling feature windows.  Distinct paths and their entropy come from chained aggregations: counts per
    path first, whose weighted logarithms give the entropy without holding the paths."""
    path = S.uri_path(F.col("request_uri"))
    per_path = (
        log.withWatermark("ts", watermark)
        .groupBy(F.window("ts", width), "remote_addr", path.alias("path"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("status") >= 400).alias("failed"),
            F.sum("body_bytes_sent").alias("bytes"),
            F.max(S.agent_suspicion(F.col("http_user_agent"))).alias("suspicion"),
        )
    )
    whole = per_path.groupBy("window", "remote_addr").agg(
        F.sum("n").alias("requests"),
        F.sum("failed").alias("failed"),
        F.sum("bytes").alias("bytes"),
        F.max("suspicion").alias("ua_suspicion"),
        F.count(F.lit(1)).alias("unique_endpoints"),
        F.sum(F.col("n") * F.log2("n")).alias("_x"),
    )
    return whole.select(
        "remote_addr", F.unix_micros("window.start").alias("start_us"), "requests", "bytes", "ua_suspicion", "unique_endpoints",
        (F.col("failed") / F.col("requests")).alias("failed_ratio"), (F.log2("requests") - F.col("_x") / F.col("requests")).alias("endpoint_entropy"),
    )


def behaviour_windows(log: DataFrame, width: str, watermark: str, *, body_mean: float = BASELINE_DEFAULTS["mean_body_bytes"], body_std: float = BASELINE_DEFAULTS["std_body_bytes"]) -> DataFrame:
    """The ten behavioural features of every closed window, in append mode.

    A first aggregate counts the values of several grains (events, paths, methods, characters) under one key each; a
    second one, chained to it, reduces them to the moments that entropies and impurity need.  So no state holds a list,
    and a hot address is spread over its values before they meet.  Characters are counted in their task first and go by
    blocks of ``BLOCK`` neighbours, a column each: a row of state for each one would be most of the state.
    """
    counts = "array<bigint>"
    grain = lambda kind, v, n: F.struct(F.lit(kind).alias("kind"), v.alias("value"), n.cast(counts).alias("n"))
    uri = F.coalesce("request_uri", F.lit("/"))
    plain = log.select("ts", "us", "remote_addr", "request_method", "status", "body_bytes_sent", "request_time", "http_user_agent", uri.alias("uri"))
    grains = F.concat(
        F.array(
            grain("event", F.lit(""), F.lit(None)), grain("path", S.uri_path(F.col("uri")), F.lit(None)),
            grain("method", F.coalesce("request_method", F.lit("GET")), F.lit(None)),
        ),
        F.transform("letters", lambda x: grain("char", x["first"].cast("string"), x["counts"])),
    )
    rows = letter_blocks(plain, "uri").withWatermark("ts", watermark).select(
        "ts", "us", "remote_addr", "status", "body_bytes_sent", "request_time", "http_user_agent", F.explode(grains).alias("g")
    )
    of = lambda c: F.when(F.col("g.kind") == "event", c)
    letters = [f"n{i}" for i in range(BLOCK)]
    counted = rows.groupBy(F.window("ts", width), "remote_addr", F.col("g.kind").alias("kind"), F.col("g.value").alias("value")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(of(F.when(F.coalesce("status", F.lit(200)) >= 400, 1.0).otherwise(0.0))).alias("failed"),
        F.stddev_pop(of(F.coalesce("request_time", F.lit(0.0)))).alias("spread"),
        F.max(of(S.agent_suspicion(F.col("http_user_agent")))).alias("suspicion"),
        F.min(of(F.col("us"))).alias("first_us"),
        F.max(of(F.col("us"))).alias("last_us"),
        F.avg(of(F.coalesce("body_bytes_sent", F.lit(0)))).alias("body"),
        *[F.sum(F.col("g.n")[i]).alias(c) for i, c in enumerate(letters)],
    )
    n = F.col("n").cast("double")
    at = lambda kind, c: F.when(F.col("kind") == kind, c)
    # a character that does not occur has no logarithm
    char_x = summed([F.coalesce(F.col(c) * F.log2(F.col(c).cast("double")), F.lit(0.0)) for c in letters])
    moments = counted.groupBy("window", "remote_addr").agg(
        F.sum(at("event", F.col("n"))).alias("events"),
        *[F.max(c).alias(c) for c in ("failed", "spread", "suspicion", "first_us", "last_us", "body")],
        F.count(at("path", n)).alias("paths"),
        F.sum(at("path", n * F.log2(n))).alias("path_x"),
        F.sum(at("method", n * n)).alias("method_q"),
        F.sum(at("char", summed([F.col(c) for c in letters]))).alias("chars"),
        F.sum(at("char", char_x)).alias("char_x"),
    )
    events = F.col("events")
    path_entropy = F.log2(events) - F.col("path_x") / events
    return moments.select(
        "remote_addr",
        F.unix_micros("window.start").alias("start_us"),
        F.col("events").alias("event_count"),
        events.cast("double").alias("f1_request_frequency"),
        F.when(F.col("paths") > 1, path_entropy / F.log2("paths")).otherwise(0.0).alias("f2_endpoint_entropy"),
        F.col("failed").alias("f3_failed_request_ratio"),
        F.coalesce(F.log2("chars") - F.col("char_x") / F.col("chars"), F.lit(0.0)).alias("f4_uri_char_entropy"),
        F.when(events < 2, 0.0).otherwise(F.col("spread")).alias("f5_timing_variance"),
        F.col("paths").cast("double").alias("f6_unique_endpoints_per_min"),
        (1.0 - F.col("method_q") / (events * events)).alias("f7_http_method_gini"),
        F.col("suspicion").alias("f8_ua_suspicion_score"),
        F.coalesce((F.col("last_us") - F.col("first_us")) / 1e6, F.lit(0.0)).alias("f9_session_length"),
        (F.lit(0.0) if body_std == 0 else F.abs(F.col("body") - body_mean) / body_std).alias("f10_payload_size_zscore"),
    )


def session_windows(log: DataFrame, gap: str, watermark: str) -> DataFrame:
    s = log.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "remote_addr").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("requests")
    )
    return s.select("remote_addr", "first_us", "last_us", "requests")


def enriched(events: DataFrame, intel: DataFrame, ip: str) -> DataFrame:
    """Stream joined to a lookup table; Spark broadcasts the table only when its size allows."""
    return events.join(intel.withColumnRenamed("ip", ip), ip, "left")


#: A row dated later than this (2200-01-01) ends a finite input: every key still held is flushed.
END_OF_INPUT_MS = 7_258_118_400_000


#: Groups that the keys of a keyed stream share.  A group is one call of Python and one row of state.
BUCKETS = 512


def _keyed(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], watermark: str, output: str, state: str, fold: Callable,
    on_timeout: Callable | None = None, keep_ms: int | None = 600_000, buckets: int = BUCKETS,
) -> DataFrame:
    """Stateful map per key in the order of ``us`` and ``event_id``.

    ``fold(columns, state)`` gets the rows of a key that the watermark has passed, as arrays by name, and the state that
    it left; it gives columns by name and the new state.  A key silent for ``keep_ms`` of event time is flushed and
    forgotten; with ``keep_ms=None`` it is held until the end of the input.

    Keys are dealt by hash to ``buckets`` groups, as a call costs far more than the fold of a key.  A group's state
    lists its keys and their waiting rows; its timer is that of the key that is due first.
    """
    names = ["us", "event_id", *values]
    types = dict(df.select(*names, *keys).dtypes)
    kinds = {n: np.float64 if types[n] in ("double", "float") else np.int64 for n in names}
    states = [c.split(" ", 1) for c in state.split(", ")]
    shown = [c.split(" ")[0] for c in output.split(", ")]

    def run(_, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        number, last_us, had, at = {}, [], [], []  # of a key: its place in the lists that follow; of a row: its key's place
        parts = {n: [] for n in names}
        old = held.getOption
        if old is not None:
            fields = iter(old)
            number = {k: i for i, k in enumerate(zip(*[next(fields) for _ in keys], strict=True))}
            known, last_us = next(fields), list(next(fields))
            had = [x if k else None for k, x in zip(known, zip(*[next(fields) for _ in states], strict=True), strict=True)]
            at.append(np.asarray(next(fields), np.int64))
            for n in names:
                parts[n].append(np.asarray(next(fields), kinds[n]))
        fresh = np.zeros(len(number), bool)
        if not held.hasTimedOut:
            for pdf in batches:
                columns = [pdf[k].astype(object).where(pdf[k].notna(), None) for k in keys]
                at.append(np.fromiter((number.setdefault(k, len(number)) for k in zip(*columns, strict=True)), np.int64, len(pdf)))
                for n in names:
                    parts[n].append(pdf[n].to_numpy(kinds[n]))
                fresh = np.r_[fresh, np.zeros(len(number) - len(fresh), bool)]
                fresh[at[-1]] = True
        last_us += [0] * (len(number) - len(last_us))
        had += [None] * (len(number) - len(had))
        now = held.getCurrentWatermarkMs()
        rows = {n: np.concatenate(x or [np.zeros(0, kinds[n])]) for n, x in parts.items()}
        owner = np.concatenate(at or [np.zeros(0, np.int64)])
        order = np.lexsort((rows["event_id"], rows["us"], owner))
        rows, owner = {n: x[order] for n, x in rows.items()}, owner[order]
        begin = np.searchsorted(owner, np.arange(len(number) + 1))
        passed = np.r_[0, np.cumsum(rows["us"] < now * 1000)]  # later rows may still arrive at or beyond the watermark
        ready = (passed[begin[1:]] - passed[begin[:-1]]).tolist()
        begin = begin.tolist()
        everyone = list(number)
        found, owners, staying, due, rest = [], [], [], [], []
        silence = lambda last: END_OF_INPUT_MS if keep_ms is None else last // 1000 + keep_ms

        def emit(i, out):
            found.append(out)
            owners.append((i, len(out[next(iter(out))])))

        for i, key in enumerate(everyone):
            lo, middle, hi = begin[i], begin[i] + ready[i], begin[i + 1]
            timer = int(rows["us"][lo]) // 1000 + 1 if hi > lo else silence(last_us[i])
            if fresh[i] or timer < now:
                if middle > lo:
                    out, had[i] = fold({n: x[lo:middle] for n, x in rows.items()}, had[i])
                    last_us[i] = int(rows["us"][middle - 1])
                    emit(i, out)
                if middle == hi and silence(last_us[i]) <= now:
                    if on_timeout is not None and had[i] is not None:
                        for out in on_timeout(had[i]):
                            emit(i, out)
                    continue
                timer = int(rows["us"][middle]) // 1000 + 1 if hi > middle else silence(last_us[i])
                lo = middle
            rest.append(np.arange(lo, hi))
            staying.append(i)
            due.append(timer)
        if found:
            columns = {n: np.concatenate([np.asarray(f[n]) for f in found]) for n in found[0]}
            for k, name in enumerate(keys):
                columns[name] = [everyone[i][k] for i, n in owners for _ in range(n)]
            yield pd.DataFrame({n: columns[n] for n in shown})
        if not staying:
            if held.exists:
                held.remove()
            return
        of = [had[i] if had[i] is not None else (None,) * len(states) for i in staying]
        waits = np.concatenate(rest)
        held.update((
            *([everyone[i][k] for i in staying] for k in range(len(keys))),
            [had[i] is not None for i in staying], [last_us[i] for i in staying], *([x[s] for x in of] for s in range(len(states))),
            np.repeat(np.arange(len(staying)), [len(r) for r in rest]).tolist(), *(rows[n][waits].tolist() for n in names),
        ))
        held.setTimeoutTimestamp(max(now + 1, min(due)))

    schema = ", ".join([
        *(f"k_{k} array<{types[k]}>" for k in keys), "known array<boolean>", "last_us array<long>", *(f"s_{n} array<{kind}>" for n, kind in states),
        "w_key array<int>", *(f"w_{n} array<{types[n]}>" for n in names),
    ])
    dealt = df.withWatermark("ts", watermark).select("ts", *names, *keys, F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandasWithState(run, output, schema, "append", GroupStateTimeout.EventTimeTimeout)


def fingerprints(observed: DataFrame, watermark: str, *, alpha: float = 0.1, keep_ms: int = 600_000) -> DataFrame:
    """Composite deviation of each observation from its entity's moving averages."""
    from tracewarden.operators.folds import ema_path

    seeds = (("rate", 2.1), ("err", 0.05), ("ent", 1.8))

    def fold(rows, state):
        current = list(state) if state else [s for _, s in seeds]
        before = {}
        for i, (c, _) in enumerate(seeds):
            before[c], current[i] = ema_path(rows[c], alpha, float(current[i]))
        score = (
            0.5 * (rows["rate"] - before["rate"]) / (before["rate"] * 0.3 + 0.1)
            + 0.3 * (rows["err"] - before["err"]) / 0.1
            + 0.2 * np.abs(rows["ent"] - before["ent"]) / 0.5
        )
        return {"event_id": rows["event_id"], "composite": score}, tuple(float(c) for c in current)

    doubles = observed.withColumns({c: F.col(c).cast("double") for c, _ in seeds})
    return _keyed(doubles, ["remote_addr"], [c for c, _ in seeds], watermark, "event_id long, remote_addr string, composite double", "rate double, err double, ent double", fold, keep_ms=keep_ms)


def suppression(alerts: DataFrame, watermark: str, *, suppress_after: int = 3, quiet_us: int = 300_000_000) -> DataFrame:
    """Suppressed flag per alert; the state is the anchor of the current group and its size."""

    def fold(rows, state):
        anchor, seq = state if state else (None, 0)
        _, seqs, anchor, seq = walk_groups(rows["us"], quiet_us, False, anchor, seq)
        return {"event_id": rows["event_id"], "suppressed": seqs >= suppress_after}, (anchor, seq)

    return _keyed(
        alerts, ["source_ip", "attack_type"], [], watermark, "event_id long, source_ip string, attack_type string, suppressed boolean", "anchor long, seq long", fold,
        keep_ms=quiet_us // 1000 + 1,
    )


def incident_stream(alerts: DataFrame, watermark: str, *, span_us: int = 120_000_000, close_after_us: int | None = None) -> DataFrame:
    """Incidents as they close: on a later alert of the key or at the end of the input, as in the batch operator.

    ``close_after_us`` also closes an open one after so long a silence of its key; it is off by default.
    """

    def table(first, last, count, score):
        return {"first_seen_us": first, "last_seen_us": last, "alert_count": count, "max_score": score}

    def fold(rows, state):
        held = state if state and state[2] > 0 else None  # first, last, count, score
        t = rows["us"]
        anchors, seqs, _, _ = walk_groups(t, span_us, True, *((int(held[0]), int(held[2])) if held else (None, 0)))
        begin = np.unique(np.append(np.flatnonzero(seqs == 1), 0))
        end = np.append(begin[1:], len(t)) - 1
        score = np.maximum.reduceat(rows["risk_score"], begin)
        if held:
            score[0] = max(score[0], held[3])
        closed = t[end] - anchors[end] >= span_us  # all but the last
        done = table(anchors[end][closed], t[end][closed], seqs[end][closed], score[closed])
        return done, (0, 0, 0, 0.0) if closed[-1] else (int(anchors[-1]), int(t[-1]), int(seqs[-1]), float(score[-1]))

    def flush(state):
        if state[2] > 0:
            yield table(*([x] for x in state))

    return _keyed(
        alerts.withColumn("risk_score", F.col("risk_score").cast("double")), ["source_ip", "attack_type"], ["risk_score"], watermark,
        "source_ip string, attack_type string, first_seen_us long, last_seen_us long, alert_count long, max_score double",
        "first_us long, last_us long, n long, score double", fold, flush, keep_ms=None if close_after_us is None else close_after_us // 1000,
    )


def confirmations(flagged: DataFrame, watermark: str, *, size: int = 10, needed: int = 4, keep_ms: int = 600_000) -> DataFrame:
    """k-of-n escalation; the state is the last n - 1 flags."""

    def fold(rows, state):
        past = np.asarray(state[0] if state else [], np.int64)
        flags = np.concatenate([past, rows["flag"]])
        total = np.r_[0, np.cumsum(flags)]
        end = np.arange(len(past) + 1, len(flags) + 1)
        begin = np.maximum(end - size, 0)
        escalated = (end - begin == size) & (total[end] - total[begin] >= needed)
        return {"event_id": rows["event_id"], "escalated": escalated}, (flags[-(size - 1):].tolist(),)

    return _keyed(flagged, ["entity_id"], ["flag"], watermark, "event_id long, entity_id string, escalated boolean", "flags array<int>", fold, keep_ms=keep_ms)


class ProgressLog(StreamingQueryListener):
    """Progress of the streaming queries started while it listens, a small row a micro-batch.

    Rows go to a table in ``folder`` whenever ``held`` of them have come together, so the driver never holds more.
    """

    SCHEMA = "run_id string, batch_id long, rows long, input_rate double, processed_rate double, batch_ms double, dropped_late long"

    def __init__(self, spark, folder: str, held: int = 1000):
        self.spark, self.folder, self.held = spark, folder, held
        self.rows: list[tuple] = []
        self.ended: dict[str, threading.Event] = defaultdict(threading.Event)
        self.lock = threading.Lock()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rate = lambda x: float(x) if x is not None and np.isfinite(x) else 0.0
        row = (
            str(p.runId), p.batchId, p.numInputRows, rate(p.inputRowsPerSecond), rate(p.processedRowsPerSecond), float(p.durationMs.get("triggerExecution", 0)),
            sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
        )
        with self.lock:
            self.rows.append(row)
            if len(self.rows) >= self.held:
                self._write()

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()

    def _write(self) -> None:
        if self.rows:
            self.spark.createDataFrame(self.rows, self.SCHEMA).write.mode("append").parquet(self.folder)
            self.rows = []

    def table(self, queries, patience: float = 60.0) -> DataFrame:
        """The rows of ended queries; events may come a little after the end of a query."""
        for query in queries:
            if not self.ended[str(query.runId)].wait(patience):
                raise TimeoutError(f"no end of query {query.runId} was heard")
        with self.lock:
            self._write()
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder).where(F.col("run_id").isin([str(q.runId) for q in queries]))


def throughput_report(progress: DataFrame) -> DataFrame:
    busy = F.col("rows") > 0
    at = lambda p: F.percentile("batch_ms", F.lit(p))
    return progress.filter(busy).agg(
        F.sum("rows").alias("events"), F.sum("batch_ms").alias("elapsed_ms"), (F.sum("rows") * 1000 / F.sum("batch_ms")).alias("events_per_second"),
        at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms"), F.sum("dropped_late").alias("dropped_late"),
    )


def held_keys(spark, checkpoint: str) -> DataFrame:
    """Keys that a keyed stream holds after its last batch, as columns, read from its state store."""
    value = spark.read.format("statestore").load(checkpoint).select("value.groupState.*")
    named = [c for c in value.columns if c.startswith("k_")]
    return value.select(F.explode(F.arrays_zip(*named)).alias("held")).select(*[F.col(f"held.{c}").alias(c[2:]) for c in named])
