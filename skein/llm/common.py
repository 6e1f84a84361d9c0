"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in UTF-8 after A-Z became a-z: digits, letters and all bytes from 0x80 stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Only A-Z become a-z; bytes.split() then gives the words of [^\x20\x09-\x0D]+.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of digits, letters and non-ASCII characters; a null text has none."""
    return text.translate(WORD_BYTES).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words between ASCII white space; a null text has none."""
    return text.translate(LOWER_BYTES).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_bytes(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), the text's UTF-8 bytes, and further columns; whatever else a table has is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


#: Caches that a Python worker keeps for its next tasks: name -> how to empty it.
CACHES: dict[str, Callable[[], None]] = {}


def keep_cache(name: str | None) -> None:
    """Empties all caches but this one: workers are shared by all operators of an application, and only one works at a time."""
    for k, empty in CACHES.items():
        if k != name:
            empty()


def give_back() -> None:
    """Returns what a worker has freed to the system; idle workers would keep it beside those that work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of text that a function of map_batches() sees at once, beside a single longer text.
PIECE_BYTES = 8 << 20


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch, in parts of about PIECE_BYTES of its column `text`, so that what is made of them stays bounded."""
    if "text" not in b.schema.names or b.nbytes <= PIECE_BYTES:
        yield b
        return
    sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
    for i, k in slices(sizes, PIECE_BYTES):
        yield b.slice(i, k - i)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, cache: str | None = None) -> DataFrame:
    """mapInArrow with a function of one batch. cache: the one that the function uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_cache(cache)
        for b in batches:
            for part in _pieces(b) if b.num_rows else ():
                if (out := f(part)) is not None and out.num_rows:
                    yield out
            b = part = out = None  # not kept beside the next batch, nor at the end
        give_back()

    return df.mapInArrow(run, schema)


def join_spread(left: DataFrame, right: DataFrame, on: str, rows: str, total: int) -> DataFrame:
    """Inner join with right, whose keys are unique and whose column `rows` says how many rows left has of each (it is dropped).

    A key with over a thousandth of the total would fill a task; there are at most a thousand of them, so they are sent to every task
    and the rows of left stay where they are. The others are joined by a shuffle."""
    most = max(1000, total // 1000)
    hot = F.broadcast(right.where(F.col(rows) > most).drop(rows))
    cold = right.where(F.col(rows) <= most).drop(rows)
    return left.join(hot, on).unionByName(left.join(hot.select(on), on, "left_anti").join(cold, on))


def columns_of(df: DataFrame) -> str:
    """The schema of a frame as text."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring items whose sizes add up to about `most`; an item is never cut."""
    start = total = 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            yield start, i
            start, total = i, 0
        total += s
    if start < len(sizes):
        yield start, len(sizes)
