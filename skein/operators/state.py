"""Keyed state in batch: credit ledgers, rate limits, expiring caches, coalesced requests, circuit breakers.

Where a rule needs the running state of a key, rows are hash-partitioned by key and sorted within partitions, and a fold reads the
partition as a stream of Arrow batches: it holds the state of one key, never a whole group. The rest is plain aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import ship

WEEK = 7 * 86_400 * 1_000_000
LIMIT = 6


def fold_sorted(df: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], result: str) -> DataFrame:
    """df with further columns: step(state, row) for the rows of every key in order, from start() on. step changes the state."""
    ship(df.sparkSession)
    names = [f.split()[0] for f in result.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + result

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start()
        for b in batches:
            out = []
            for k, *row in zip(b.column(key).to_pylist(), *(b.column(c).to_pylist() for c in columns), strict=True):
                if (k,) != last:
                    last, state = (k,), start()
                out.append(step(state, tuple(row)))
            if out:
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, zip(*out, strict=True))], [*b.schema.names, *names])

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class Ledger:
    """ST3: credits of one user. The week starts anew at the first event at or after its end."""

    __slots__ = ("used", "reset")

    def __init__(self, used: int = 0, reset: int | None = None):
        self.used, self.reset = used, reset

    def apply(self, at: int, kind: str, pro: bool = False, limit: int = LIMIT, period: int = WEEK) -> tuple[bool, int]:
        """(accepted, credits left) of a reserve or refund at a time in microseconds."""
        if pro:
            return True, 999_999
        if self.reset is None or at >= self.reset:
            self.used, self.reset = 0, at + period
        if kind == "refund":
            self.used = max(0, self.used - 1)
            return True, max(0, limit - self.used)
        if self.used >= limit:
            return False, 0
        self.used += 1
        return True, max(0, limit - self.used)


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def credit_ledger(events: DataFrame, limit: int = LIMIT, period: int = WEEK) -> DataFrame:
    """ST3, R24-R28: events (user_id, ts, event_id, kind, pro) with accepted and remaining; kind is reserve or refund."""
    d = events.withColumn("at", micros(F.col("ts")))
    step = lambda s, r: s.apply(r[0], r[1] or "reserve", bool(r[2]), limit, period)
    return fold_sorted(d, "user_id", ["at", "event_id"], ["at", "kind", "pro"], Ledger, step, "accepted boolean, remaining bigint").drop("at")


def rate_limited(events: DataFrame, key: list[str], seconds: int, most: int, offset: int = 0) -> DataFrame:
    """ST2: window_start (epoch seconds), n_in_window and allowed for every request, counted in fixed windows per key."""
    start = (F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - offset) / seconds) * seconds + offset).cast("long")
    d = events.withColumn("window_start", start)
    n = F.row_number().over(Window.partitionBy(*key, "window_start").orderBy("ts", "event_id")).cast("long")
    return d.withColumn("n_in_window", n).withColumn("allowed", F.col("n_in_window") <= most)


class _Cache:
    __slots__ = ("until",)

    def __init__(self):
        self.until = None

    def get(self, at: int, ttl: int) -> tuple[bool]:
        """A hit does not lengthen an entry's life; a miss stores the entry anew."""
        if self.until is not None and at <= self.until:
            return (True,)
        self.until = at + ttl
        return (False,)


def ttl_cache(events: DataFrame, key: str, ttl_seconds: int) -> DataFrame:
    """ST1: hit for every look-up of a cache that is filled on a miss."""
    d = events.withColumn("at", micros(F.col("ts")))
    return fold_sorted(d, key, ["at", "event_id"], ["at"], _Cache, lambda s, r: s.get(r[0], ttl_seconds * 1_000_000), "hit boolean").drop("at")


def lru_cache(events: DataFrame, key: str, ttl_seconds: int, capacity: int, shards: int = 1) -> DataFrame:
    """ST1 with a capacity: every shard of keys is a cache of `capacity` entries; the one unused longest goes. One shard is one
    cache with one order of all look-ups; more shards run side by side. hit and size."""
    ttl = ttl_seconds * 1_000_000

    def step(cache: dict, row: tuple) -> tuple[bool, int]:
        at, k = row
        until = cache.pop(k, None)
        hit = until is not None and at <= until
        if not hit and len(cache) >= capacity:
            del cache[next(iter(cache))]
        cache[k] = until if hit else at + ttl
        return hit, len(cache)

    d = events.withColumn("at", micros(F.col("ts"))).withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    return fold_sorted(d, "shard", ["at", "event_id"], ["at", key], dict, step, "hit boolean, size bigint").drop("at", "shard")


def coalesced(events: DataFrame, key: list[str]) -> DataFrame:
    """ST4: leader_id (the first request of the key) and already_exists for every request."""
    first = events.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("leader_id"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]  # requests without a key are one key too
    return events.join(first, same).drop(*[f"_{k}" for k in key]).withColumn("already_exists", F.col("event_id") != F.col("leader_id"))


def circuit_breaker(calls: DataFrame, key: list[str], failed: Column) -> DataFrame:
    """ST5: skipped for every call after the first quota failure of its key; it never recovers."""
    trip = calls.where(failed).groupBy(*key).agg(F.min(F.struct("ts", "event_id")).alias("trip"))
    return calls.join(trip, key, "left").withColumn("skipped", F.coalesce(F.struct("ts", "event_id") > F.col("trip"), F.lit(False))).drop("trip")
