"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours. A sample, drawn with odds in proportion to a
row's size, gives quantile boundaries of many ranges, far more than shards. Ranges that turn out overfull are cut again with
boundaries sampled from them alone; as doc_id is part of the key, a text that a third of all rows share is cut as well. Exact
totals of the ranges and running sums within them then give every row its place in the whole order, and shards are cut from
that order at equal bytes: their sizes differ by about one row.

Only the sample and one row for each range come to the driver; both depend on the number of ranges, which grows by one for
`range_rows` rows.

Defined cases: a null text has size `overhead` and checksum 0; ties of the whole key (repeated rows) stand in any order but
never leave a gap; a row without doc_id sorts first; an empty table gives no rows; columns other than doc_id and text are not
read.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import map_batches
from skein.session import drop, materialize, ship

OVERHEAD = 8
RANGE_ROWS = 1_000_000
#: Sampled keys for each range.
OVERSAMPLE = 24


def _sample(rows: DataFrame, weight_total: float, keys: int, salt: int) -> list[tuple[int, int]]:
    """About `keys` keys, each row drawn with odds in proportion to its size."""
    chance = F.lit(keys) * F.col("size") / F.lit(float(max(1, weight_total)))
    draw = F.pmod(F.xxhash64("h", "doc_id", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return sorted((r["h"], r["doc_id"]) for r in rows.where(draw < chance).select("h", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")).collect())


def _quantiles(keys: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    return sorted({keys[len(keys) * k // n] for k in range(1, n)}) if keys else []


def _into(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """rng: the number of splitters up to the key."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        low = -(1 << 63)
        got = [bisect_right(splitters, (h, low if d is None else d)) for h, d in zip(b.column("h").to_pylist(), b.column("doc_id").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int32())], [*b.schema.names, "rng"])

    return map_batches(rows, run, "doc_id long, h long, size long, text_crc32 long, rng int")


def shard_by_bytes(spark: SparkSession, docs: DataFrame, shards: int = 24, text: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    ship(spark)
    raw = F.coalesce(F.col("text") if text is None else text, F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(raw).alias("h"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).cast("long").alias("text_crc32"))
    rows = materialize(rows, "sizes")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(8 * shards, -(-n // RANGE_ROWS))
    splitters = _quantiles(_sample(rows, total, ranges * OVERSAMPLE, 0), ranges)
    for again in range(1, 4):
        placed = _into(rows, splitters)
        sums = placed.groupBy("rng").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()  # one row for each range
        most = 2 * max(1, -(-n // ranges)), 2 * max(1, total // ranges)
        over = {r["rng"]: max(-(-2 * r["n"] // most[0]), -(-2 * r["bytes"] // most[1])) for r in sums if r["n"] > most[0] or r["bytes"] > most[1]}
        if not over:
            break
        inside = placed.where(F.col("rng").isin(list(over)))
        weight = sum(r["bytes"] + r["n"] for r in sums if r["rng"] in over)
        keys = _sample(inside.drop("rng").withColumn("size", F.col("size") + 1), weight, sum(over.values()) * OVERSAMPLE, again)
        fresh: dict[int, list] = {}
        for k in keys:
            fresh.setdefault(bisect_right(splitters, k), []).append(k)
        new = sorted({*splitters, *(q for r, ks in fresh.items() for q in _quantiles(ks, over.get(r, 1)))})
        if new == splitters:
            break  # nothing can be cut further: single rows, or repeats of one row
        splitters = new
    placed = _into(rows, splitters)
    sums = sorted(tuple(r) for r in placed.groupBy("rng").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect())
    starts, at_row, at_byte = [], 0, 0
    for rng, k, b in sums:
        starts.append((rng, at_row, at_byte))
        at_row, at_byte = at_row + k, at_byte + b
    offsets = F.broadcast(spark.createDataFrame(starts, "rng int, row0 long, byte0 long"))  # one row for each range
    w = Window.partitionBy("rng").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = placed.select("*", F.count(F.lit(1)).over(w).alias("r"), F.sum("size").over(w).alias("cum")).join(offsets, "rng")
    middle = F.col("byte0") + F.col("cum") - F.col("size") / 2
    ordered = ordered.select("doc_id", "size", "text_crc32", (F.col("row0") + F.col("r") - 1).alias("at"), F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(1, total))))).cast("int").alias("shard"))
    ordered = materialize(ordered, "ordered")
    drop(rows)
    first = F.broadcast(ordered.groupBy("shard").agg(F.min("at").alias("first")))  # one row for each shard
    return ordered.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
