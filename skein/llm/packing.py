"""Packing: shortest-pack-first over the length histogram.

Every document's ids, closed by id 0, are cut at multiples of the capacity. Pieces that fill a sequence stand alone. The
lengths of all other pieces make a histogram of at most capacity-1 bins, which is all that the driver sees: lengths are
placed longest first, each into the shortest open pack that still has room, by counts of packing patterns rather than by
piece. Patterns are then joined back to pieces by the rank of a piece among those of its length.

Defined cases: a null or empty text is one piece with the closing id; repeated rows are packed each on their own (doc_id and
start need not be unique); an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import doc_bytes, map_batches
from skein.llm.tokens import encoder
from skein.session import materialize, ship

CAPACITY = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing_id: int = 0) -> DataFrame:
    """One row for each piece of each document: where it starts, its length and the checksum of its ids."""
    end = np.asarray([closing_id], dtype="<u4").tobytes()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, enc = b.column(0).to_pylist(), encoder(tokenizer)
        texts = b.column(1)
        rows: list[tuple[int, int, int, int, int]] = []
        for at in range(0, len(ids), 500):
            got = enc.encode(texts[at : at + 500].to_pylist())
            for doc, raw in zip(ids[at : at + 500], got, strict=True):
                raw += end
                n = len(raw) // 4
                for s in range(0, n, capacity):
                    part = raw[4 * s : 4 * (s + capacity)]
                    rows.append((doc, s, len(part) // 4, zlib.crc32(part), n))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    ship(docs.sparkSession)
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES, "tokens")


def shortest_pack_first(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pattern, how often it occurs). The work depends on the number of different lengths, not of pieces."""
    open_packs: dict[int, dict[tuple[int, ...], int]] = {}  # free room -> pattern -> count
    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left = counts[length]
        for room in range(capacity - 1, length - 1, -1):  # the shortest packs first; those just lengthened come up again further down
            for pattern, n in sorted(open_packs.get(room, {}).items()):
                if left and (n := min(n, left)):
                    _move(open_packs, room, pattern, n, length)
                    left -= n
        if left:
            times = capacity // length
            whole, rest = divmod(left, times)
            for n, k in ((whole, times), (1, rest)):
                if n and k:
                    packs = open_packs.setdefault(capacity - length * k, {})
                    packs[(length,) * k] = packs.get((length,) * k, 0) + n
    return sorted((p, n) for packs in open_packs.values() for p, n in packs.items())


def _move(open_packs: dict, room: int, pattern: tuple, n: int, length: int) -> None:
    here = open_packs[room]
    here[pattern] -= n
    if not here[pattern]:
        del here[pattern]
    there = open_packs.setdefault(room - length, {})
    there[pattern + (length,)] = there.get(pattern + (length,), 0) + n


def _intervals(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, end rank, first sequence, offset): pieces of these ranks take consecutive sequences. Also the number of sequences."""
    rank: dict[int, int] = {}
    out, base = [], 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            r = rank.get(length, 0)
            out.append((length, r, r + n, base, offset))
            rank[length] = r + n
            offset += length
        base += n
    return out, base


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, rows_per_salt: int = 200_000) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    pieces = materialize(token_pieces(docs, tokenizer, capacity), "pieces")
    total = pieces.count()
    salts = max(8, -(-total // rows_per_salt))
    keyed = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    # a length may hold most pieces, so a piece is ranked within (length, salt); the counts give each salt's first rank
    cells = keyed.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first_rank", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = keyed.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")))
    ranked = ranked.join(cells.drop("n"), ["length", "salt"]).withColumn("rank", F.col("r") - 1 + F.col("first_rank"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    full = histogram.pop(capacity, 0)
    rows, _ = _intervals(shortest_pack_first(histogram, capacity))
    rows = [(a, b, c, d + full, e) for a, b, c, d, e in rows]
    if full:
        rows.append((capacity, 0, full, 0, 0))
    # a few rows for each length whatever the number of pieces, so this side is safe to broadcast
    places = spark.createDataFrame(rows, "p_length long, r0 long, r1 long, base long, offset long")
    return ranked.join(F.broadcast(places), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1"))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("r0")).alias("sequence_id"), "offset"
    )
