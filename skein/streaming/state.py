"""The stateful operators on streams. They use the same rules as the batch forms in operators.state.

Events of a key are applied in order of (ts, event_id) within a micro-batch; an event that arrives after a later one of its key was
applied is applied at its arrival. Results equal the batch ones for input in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.state import LIMIT, WEEK, Ledger, micros
from skein.session import ship


def credit_ledger(events: DataFrame, limit: int = LIMIT, period: int = WEEK) -> DataFrame:
    """ST3: streaming events (user_id, ts, event_id, kind, pro) to (user_id, event_id, accepted, remaining)."""
    ship(events.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, reset = state.get if state.exists else (0, -1)
        ledger = Ledger(used, None if reset < 0 else reset)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")  # the rows of one key in one micro-batch
        got = [ledger.apply(int(r.at_us), r.kind or "reserve", bool(r.pro), limit, period) for r in rows.rename(columns={"at": "at_us"}).itertuples()]
        state.update((ledger.used, -1 if ledger.reset is None else ledger.reset))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "accepted": [a for a, _ in got], "remaining": [b for _, b in got]})

    d = events.select("user_id", "event_id", micros(F.col("ts")).alias("at"), "kind", "pro")
    return d.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, accepted boolean, remaining long", "used long, reset long", "append", GroupStateTimeout.NoTimeout)


def rate_counts(events: DataFrame, key: list[str], seconds: int, most: int, late: str = "10 minutes") -> DataFrame:
    """ST2: requests of every key and fixed window, with how many are above the limit; a window is final once it is `late` behind."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    n = d.groupBy(F.window("ts", f"{seconds} seconds"), *key).agg(F.count("*").alias("n"))
    return n.select(*key, F.unix_seconds(F.col("window.start")).alias("window_start"), "n", F.greatest(F.lit(0), F.col("n") - most).alias("refused"))


def coalesced(events: DataFrame, key: list[str], within: str = "1 minute") -> DataFrame:
    """ST4: the first request of every key; repeats within the time are dropped, and the state of a key goes after it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", within).dropDuplicatesWithinWatermark(key)


def extracted(pages: DataFrame, **options) -> DataFrame:
    """EX1 on a stream of pages: metadata of each page, without the deduplication that needs all of them."""
    from skein.operators.pages import metadata, parsed

    return metadata(parsed(pages), **options)


def admissible(d: DataFrame, blocked: Column | str = "blocked") -> DataFrame:
    """ST7: records that may be cached."""
    return d.where(~(F.col(blocked) if isinstance(blocked, str) else blocked) & F.coalesce("title", "description").isNotNull())
