"""Operational event jobs (R1-R6) over usage/request logs and object listings.

R1/R2 are filters and windowed aggregates that run the same way in batch and
in Structured Streaming (watermark on ``ts``). R3, the sliding-window rate
limiter, is sequential per (client, group) by definition (an admission depends
on the earlier admissions), so it is keyed state: ``applyInPandasWithState``
in a stream, and in batch a per-partition scan of rows range-partitioned by
(key, time) (``mapInPandas``), which never holds more than one Arrow batch
plus at most ``limit`` timestamps per key in memory; a hot key is split over
partitions and the state at each split is resolved exactly (see rate_limit).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values of the product ------------------------------------------------
USAGE_EVENTS = ("view", "share", "export", "compare", "shot_chart")
USAGE_VIEWS = ("standings", "leaders", "games", "shots", "players", "compare", "player", "game", "team")
SLOW_REQUEST_MS = 1000
BACKUP_SUFFIX = ".dump"
MINIMUM_COPIES = 7
MAX_BACKUP_AGE_HOURS = 36
MAX_DRILL_AGE_DAYS = 40
# -----------------------------------------------------------------------------


def usage_allowlist(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) usage events; only listed (event, view) pairs are accepted."""
    ok = F.col("event").isin(*USAGE_EVENTS) & F.col("view").isin(*USAGE_VIEWS)
    ok = F.coalesce(ok, F.lit(False))
    return events.where(ok), events.where(~ok)


def usage_counts(accepted: DataFrame, watermark: str | None = None) -> DataFrame:
    """R1 counts by (event, view, hour); with ``watermark`` usable on a stream (append mode)."""
    df = accepted.withWatermark("ts", watermark) if watermark else accepted
    return df.groupBy("event", "view", F.window("ts", "1 hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("events")).select(
        "event", "view", F.col("hour.start").alias("hour_start"), "events")


def request_metrics(requests: DataFrame, window: str = "1 hour", watermark: str | None = None,
                    approximate: bool = False) -> DataFrame:
    """R2: per (path, time window): requests, server errors, slow (>= 1000 ms) and p50/p95 latency.

    Batch: exact percentiles by the distributed rank lookup of
    ``operators.quantiles`` (a hot path's latencies are spread over many tasks),
    joined to the counts aggregate. On a stream: one windowed aggregate with
    the built-in exact ``percentile`` (its state keeps each open window's
    distinct latencies; ``watermark`` bounds how long windows stay open). ``approximate=True`` uses the
    mergeable ``percentile_approx`` sketch in either form.
    """
    from statlake.operators.joins import null_safe_join
    from statlake.operators.quantiles import exact_percentiles

    df = requests.withWatermark("ts", watermark) if watermark else requests
    d = F.col("duration_ms")
    counts = [
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") >= 500).alias("server_errors"),
        F.count_if(d >= SLOW_REQUEST_MS).alias("slow_requests"),
    ]
    cols = ["path", "window_start", "requests", "server_errors", "slow_requests",
            F.round("p50_ms", 3).alias("p50_ms"), F.round("p95_ms", 3).alias("p95_ms")]
    if approximate or requests.isStreaming:
        if approximate:
            p50, p95 = F.percentile_approx(d, 0.5, 10000), F.percentile_approx(d, 0.95, 10000)
        else:
            p50, p95 = F.percentile(d, F.lit(0.5)), F.percentile(d, F.lit(0.95))
        return (df.groupBy("path", F.window("ts", window).alias("w"))
                .agg(*counts, p50.alias("p50_ms"), p95.alias("p95_ms"))
                .withColumn("window_start", F.col("w.start")).select(*cols))
    keyed = df.select("path", F.window("ts", window).start.alias("window_start"), "status", "duration_ms")
    pct = exact_percentiles(keyed, ["path", "window_start"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return null_safe_join(keyed.groupBy("path", "window_start").agg(*counts), pct, ["path", "window_start"],
                          "left").select(*cols)


# --- R3 sliding-window rate limiter -------------------------------------------------
# Output: client, group, ts, request_id, allowed, retry_after. Python steps see epoch microseconds computed in the JVM: pandas timestamps are wall-clock
# times in the session zone, which would shift window arithmetic at daylight-saving changes
_DECISIONS_US = T.StructType([
    T.StructField("client", T.StringType()), T.StructField("group", T.StringType()),
    T.StructField("ts_us", T.LongType()), T.StructField("request_id", T.LongType()),
    T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.IntegerType()),
])
_DECISION_COLS = ["client", "group", "ts_us", "request_id", "allowed", "retry_after"]


def _with_ts(decisions: DataFrame) -> DataFrame:
    return decisions.select("client", "group", F.timestamp_micros("ts_us").alias("ts"), "request_id", "allowed",
                            "retry_after")


def _decide(admitted: deque, now: float, window_seconds: float, limit: int) -> tuple[bool, int]:
    """One limiter decision: expire admissions at or before now - window; deny when full
    (retry_after = max(1, int(window - (now - oldest)) + 1)); otherwise admit and record."""
    cutoff = now - window_seconds
    while admitted and admitted[0] <= cutoff:
        admitted.popleft()
    if len(admitted) >= limit:
        return False, max(1, int(window_seconds - (now - admitted[0])) + 1)
    admitted.append(now)
    return True, 0


SUMMARY_SCHEMA = T.StructType([
    T.StructField("pid", T.IntegerType()),
    T.StructField("first_client", T.StringType()), T.StructField("first_group", T.StringType()),
    T.StructField("last_client", T.StringType()), T.StructField("last_group", T.StringType()),
    T.StructField("admitted", T.ArrayType(T.DoubleType())),
])


class _LimiterWalk:
    """Sequential decisions over one partition sorted by (client, group, ts, request_id).

    ``carried`` is ``(client, group, admitted)``: the state the partition's first
    key brings from the previous partition (a key split across partitions), or
    None. Memory: at most ``limit`` admitted timestamps for the current key.
    """

    def __init__(self, carried, window_seconds: float, limit_of):
        self.carried, self.window, self.limit_of = carried, window_seconds, limit_of
        self.first = self.key = None
        self.admitted: deque = deque()

    def decide(self, pdf: pd.DataFrame) -> tuple[list, list]:
        allowed, retry = [], []
        secs = pdf["ts_us"].to_numpy() / 1e6
        for client, group, now in zip(pdf["client"], pdf["group"], secs):
            if (client, group) != self.key:
                self.key, self.admitted = (client, group), deque()
                if self.first is None:
                    self.first = self.key
                    if self.carried is not None and tuple(self.carried[:2]) == self.key:
                        self.admitted = deque(self.carried[2])
            limit = self.limit_of(group)
            if limit is None:  # exempt group: not limited, not recorded
                ok, after = True, 0
            else:
                ok, after = _decide(self.admitted, float(now), self.window, limit)
            allowed.append(ok)
            retry.append(after)
        return allowed, retry


def rate_limit(requests: DataFrame, window_seconds: float, limits: dict[str, int] | int,
               partitions: int | None = None) -> DataFrame:
    """R3 in batch: one decision per request, in time order per (client, group).

    Rows are range-partitioned on (client, group, ts, request_id) and sorted in
    each partition, so a hot key is split over several partitions by time
    instead of landing in one task; the layout is checkpointed so partition
    ids stay fixed across the passes. ``mapInPandas`` walks each partition
    carrying only the current key's admitted timestamps (at most ``limit``).

    A key continued from the previous partition needs that partition's final
    state. The carried states are resolved by a fixed-point iteration over
    partition boundaries: pass 0 runs every partition from an empty state and
    reports (first key, last key, last key's admitted timestamps); each further
    pass re-runs only the partitions whose incoming state changed. The true
    boundary states are the unique fixed point (the first partition of a key
    always starts empty), so decisions are exact; a key's state normally
    settles within one window of a boundary, so this takes two or three
    passes. Only one summary row per partition (at most ``limit`` timestamps)
    reaches the driver, and the same bounded map is shipped with the final pass.
    Denied requests are not recorded; groups without a limit are exempt.
    """
    from statlake.session import checkpoint_dir

    spark = requests.sparkSession
    limit_of = (lambda g: limits) if isinstance(limits, int) else (lambda g: limits.get(g))
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["client", "group", "ts_us", "request_id"]
    ordered = (requests.select("client", "group", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
                               "request_id")
               .repartitionByRange(n, *keys)
               .sortWithinPartitions(*keys)
               .withColumn("pid", F.spark_partition_id())
               .checkpoint(eager=True))

    def summaries(carry: dict, only: set | None) -> dict:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            walk, pid = None, None
            for pdf in batches:
                if not len(pdf):
                    continue
                if walk is None:
                    pid = int(pdf["pid"].iloc[0])
                    if only is not None and pid not in only:
                        return
                    walk = _LimiterWalk(carry.get(pid), window_seconds, limit_of)
                walk.decide(pdf)
            if walk is not None:
                yield pd.DataFrame({"pid": [pid], "first_client": [walk.first[0]], "first_group": [walk.first[1]],
                                    "last_client": [walk.key[0]], "last_group": [walk.key[1]],
                                    "admitted": [[float(x) for x in walk.admitted]]})

        return {r.pid: r for r in ordered.mapInPandas(run, SUMMARY_SCHEMA).collect()}

    carry: dict = {}
    summary = summaries(carry, None)
    while True:
        pids = sorted(summary)
        incoming = {}
        for prev, cur in zip(pids, pids[1:]):
            a, b = summary[prev], summary[cur]
            if (a.last_client, a.last_group) == (b.first_client, b.first_group):
                incoming[cur] = (b.first_client, b.first_group, list(a.admitted))
        changed = {p for p in incoming if incoming[p] != carry.get(p)}
        carry = incoming
        if not changed:
            break
        summary.update(summaries(carry, changed))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        walk = None
        for pdf in batches:
            if not len(pdf):
                continue
            if walk is None:
                walk = _LimiterWalk(carry.get(int(pdf["pid"].iloc[0])), window_seconds, limit_of)
            allowed, retry = walk.decide(pdf)
            out = pdf.assign(allowed=allowed, retry_after=retry)
            out["retry_after"] = out["retry_after"].astype("int32")
            yield out[_DECISION_COLS]

    return _with_ts(ordered.mapInPandas(scan, _DECISIONS_US))


STATE_SCHEMA = T.StructType([T.StructField("admitted", T.ArrayType(T.DoubleType()))])


def rate_limit_stream(requests: DataFrame, window_seconds: float, limits: dict[str, int] | int,
                      watermark: str = "1 hour") -> DataFrame:
    """R3 on a stream: keyed state per (client, group) with an event-time timeout.

    The state is the list of admitted timestamps still inside the window; when
    the watermark passes the last admission + window the key's state is dropped.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    limit_of = (lambda g: limits) if isinstance(limits, int) else (lambda g: limits.get(g))

    def step(key, batches, state):
        client, group = key
        if state.hasTimedOut:
            state.remove()
            return
        admitted = deque(state.get[0] if state.exists else [])
        frames = list(batches)
        pdf = pd.concat(frames).sort_values(["ts_us", "request_id"]) if frames else pd.DataFrame()
        allowed, retry = [], []
        for now in (pdf["ts_us"].to_numpy() / 1e6 if len(pdf) else []):
            limit = limit_of(group)
            ok, after = (True, 0) if limit is None else _decide(admitted, float(now), window_seconds, limit)
            allowed.append(ok)
            retry.append(after)
        state.update((list(admitted),))
        if admitted:
            state.setTimeoutTimestamp(int((admitted[-1] + window_seconds) * 1000))
        if len(pdf):
            out = pdf[["ts_us", "request_id"]].assign(client=client, group=group, allowed=allowed, retry_after=retry)
            out["retry_after"] = out["retry_after"].astype("int32")
            yield out[_DECISION_COLS]

    keyed = requests.withWatermark("ts", watermark).select(
        "client", "group", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "request_id")
    return _with_ts(keyed.groupBy("client", "group").applyInPandasWithState(
        step, _DECISIONS_US, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout))


# --- R4 client address ----------------------------------------------------------------
IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
_H16 = "[0-9A-Fa-f]{1,4}"
_LS32 = f"({_H16}:{_H16}|{IPV4[1:-1]})"
#: RFC 3986's forms: the groups before '::' and the groups after it.
IPV6 = "^(" + "|".join([f"({_H16}:){{6}}{_LS32}", *(
    (f"(({_H16}:){{0,{before - 1}}}{_H16})?::" if before else "::") + (f"({_H16}:){{{5 - before}}}{_LS32}" if before <= 5 else _H16 if before == 6 else "")
    for before in range(8))]) + ")$"


def client_key(edge_header: Column, forwarded_for: Column, peer: Column, trusted_hops: int = 1,
               trust_edge: bool = False) -> Column:
    """The edge's attributed address if trusted and a valid IP; else the hop appended by
    the trusted proxy (``trusted_hops`` from the right) when the chain is long enough; else
    the peer; else 'unknown'. Values are kept whole, so two clients never share a key."""
    attributed = F.trim(edge_header)
    valid = attributed.rlike(IPV4) | attributed.rlike(IPV6)
    hops = F.filter(F.transform(F.split(F.coalesce(forwarded_for, F.lit("")), ","), lambda h: F.trim(h)),
                    lambda h: F.length(h) > 0)
    from_chain = F.when((F.size(hops) >= trusted_hops) & F.lit(trusted_hops >= 1),
                        F.element_at(hops, -trusted_hops))
    fallback = F.when(F.coalesce(F.length(peer), F.lit(0)) > 0, peer).otherwise(F.lit("unknown"))
    chosen = F.coalesce(from_chain, fallback)
    if trust_edge:
        return F.when(F.coalesce(valid, F.lit(False)), attributed).otherwise(chosen)
    return chosen


# --- R5/R6 snapshot retention and freshness ---------------------------------------------
def expired_snapshots(objects: DataFrame, pointers: DataFrame, now: Column, retention_days: int,
                      minimum_copies: int = MINIMUM_COPIES) -> DataFrame:
    """Per prefix, `.dump` objects beyond the newest ``minimum_copies`` (newest first,
    key order on ties), not the proven copy, and older than the retention cutoff.

    The newest copies are found with a per-prefix ``row_number() <= n`` (planned
    with a partial group limit, so no task sorts a whole prefix) and removed by
    an anti join.
    """
    if retention_days <= 0 or minimum_copies <= 0:
        raise ValueError("retention days and minimum copies must be positive")
    dumps = objects.where(F.col("key").endswith(BACKUP_SUFFIX))
    w = Window.partitionBy("prefix").orderBy(F.col("modified").desc(), F.col("key").asc())
    newest = dumps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= minimum_copies).select("prefix", "key")
    cutoff = now - F.make_interval(days=F.lit(retention_days))
    protected = pointers.select("prefix", F.col("key").alias("protected_key"))
    return (dumps.join(newest, ["prefix", "key"], "left_anti").join(protected, "prefix", "left")
            .where(~F.col("key").eqNullSafe(F.col("protected_key")) & (F.col("modified") < cutoff))
            .select("prefix", "key", "modified"))


def snapshot_freshness(objects: DataFrame, pointers: DataFrame, now: Column,
                       max_age_hours: float = MAX_BACKUP_AGE_HOURS, max_drill_age_days: float = MAX_DRILL_AGE_DAYS) -> DataFrame:
    """Per prefix, newest backup age (h) <= 36 and last proven drill age (days) <= 40."""
    dumps = objects.where(F.col("key").endswith(BACKUP_SUFFIX))
    newest = dumps.groupBy("prefix").agg(
        F.max_by("key", F.struct("modified", "key")).alias("newest_backup"), F.max("modified").alias("newest_modified"),
        F.count(F.lit(1)).alias("backup_count"))
    # whole seconds between wall-clock values; no session time zone is involved
    age_h = F.timestamp_diff("SECOND", F.col("newest_modified"), now) / 3600.0
    drill_d = F.timestamp_diff("SECOND", F.col("proven_at"), now) / 86400.0
    j = newest.join(pointers.select("prefix", "proven_at"), "prefix", "left")
    return j.select(
        "prefix", "newest_backup", "backup_count", F.round(age_h, 3).alias("newest_backup_age_hours"),
        F.round(drill_d, 3).alias("drill_age_days"),
        ((age_h <= max_age_hours) & F.coalesce(drill_d <= max_drill_age_days, F.lit(False))).alias("fresh"))
