"""Suffix-array duplicate removal: bytes covered by a string of `length` bytes that also starts anywhere else, by a difference cover.

A match of `length` bytes needs suffixes ordered by that many bytes only, so the difference-cover algorithm is run to that depth:

1. Sample: offsets of a document whose remainder by a period v lies in a difference cover of v, and the last possible start. For
   any two starts i and j there is a d below v with both i + d and j + d sampled. Samples are named by their next w = length - v + 1
   bytes (the tuples of the algorithm), names are sorted in ranges of their hash and neighbours compared.
2. Recursion on names: samples that share a name are named again, at the full length. A unique name ends the recursion.
3. Merge of the remaining suffixes: starts between two repeated samples at most `length` apart are covered anyway. Where a run of
   these ends, all starts up to v before the samples there, and before the samples of the same name in all other documents, are
   named at the full length too. Two equal strings have equal names at i + d and j + d, so both get here.
4. Neighbours of equal names are starts of strings that occur twice; their bytes are the removed ones.

Names at the full length are hashes of 96 bits from polynomials with two odd bases (two of 10**13 different strings agree with a chance below
1 in 1,000); those of step 1 only choose candidates, so they are as short as the number of bytes allows.

Texts are written once, as blocks of documents in a bucketed table of the shared folder; each step reads them where they lie. A
step sends the sorted distinct names of a block, packed by range, to the range's task, and gets a byte of marks a name back, so that
what is shuffled is names alone and a passage in a third of all documents is one name a block. Equal texts are found first, by a digest: only
one of them is sampled.

Defined cases: a null text is empty; texts shorter than `length` stay whole and match nothing; strings never cross documents; a null or repeated doc_id is
a row like any other, and equal rows cover one another; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import doc_bytes, keep_cache, slices
from skein.session import materialize, scratch_path, ship

#: Perfect difference sets: every remainder of the period is a difference of two members.
COVERS = {
    1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63), 91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
}
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Bytes of text hashed at once.
CHUNK = 1 << 20
#: Marks of a name: two blocks have it; this block is the first that has it; a block that has it set its flag.
REPEATED, FIRST, FLAGGED = 1, 2, 4
NAMES = "block_id long, bucket int, names binary, flags binary"
MARKS = "block_id long, step int, bucket int, marks binary"


def period(length: int) -> int:
    return max(v for v in COVERS if v <= max(1, length * 3 // 10))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        a = np.full(n, b, np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, k in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(k)
    return x


def hashes(text: np.ndarray, starts: np.ndarray, n: int, base: int) -> np.ndarray:
    """64-bit hashes of the n bytes from each of the sorted starts on."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers(base, CHUNK + n + 1)
    for c in range(0, len(text), CHUNK):
        a, b = np.searchsorted(starts, (c, c + CHUNK))
        if a < b:
            part = text[c : c + CHUNK + n]
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=total[1:])
            p = starts[a:b] - c
            out[a:b] = (total[p + n] - total[p]) * down[p]
    return _mixed(out)


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals, sorted by start, as disjoint intervals; those that touch are joined."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([new[1:], [True]])
    return starts[new], reach[last]


class Block:
    """The documents of a block, laid end to end, and what the marks so far say about them."""

    def __init__(self, t: pa.Table, length: int, v: int, shift: int):
        t = t.sort_by("seq")
        self.length, self.v, self.shift = length, v, shift
        self.ids = t.column("doc_id")
        self.texts = [x or b"" for x in t.column("text").to_pylist()] if "text" in t.column_names else []
        self.digests = t.column("digest").to_pylist()
        self.sizes = np.array(t.column("size").to_pylist(), np.int64)
        self.whole = np.zeros(len(self.sizes), bool)
        self.skip = self.sizes < length

    # step 0: equal texts

    def copies(self) -> tuple[np.ndarray, ...]:
        d = np.frombuffer(b"".join(self.digests), np.uint8).reshape(-1, 12)
        hi = np.ascontiguousarray(d[:, :8]).view(">u8").ravel().astype(np.uint64)
        lo = np.ascontiguousarray(d[:, 8:]).view(">u4").ravel().astype(np.uint32)
        keep = np.flatnonzero(~self.skip)
        return keep, hi[keep], lo[keep]

    def skip_copies(self, marks: np.ndarray) -> None:
        """Of equal texts only the first row of the first block is sampled."""
        keep, hi, lo = self.copies()
        first, of, many = _distinct(hi, lo)
        self.whole[keep] = (many[of] > 1) | (marks[of] & REPEATED > 0)
        self.skip[keep] = (marks[of] & FIRST == 0) | (first[of] != np.arange(len(keep)))

    # step 1: samples

    def sample(self) -> None:
        used = np.flatnonzero(~self.skip)
        self.text = np.frombuffer(b"".join(self.texts[i] for i in used), np.uint8)
        sizes = self.sizes[used]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(used) else np.zeros(0, np.int64)
        w = self.length - self.v + 1
        grid = (np.arange(0, int(sizes.max(initial=0)) + 1, self.v)[:, None] + np.array(COVERS[self.v])).ravel()
        parts, docs = [], []
        for k, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            g = grid[: np.searchsorted(grid, n - w, "right")]
            last = n - self.length
            i = np.searchsorted(g, last)
            if i == len(g) or g[i] != last:
                g = np.insert(g, i, last)
            parts.append(g + s)
            docs.append(np.full(len(g), k))
        self.used, self.begin, self.end = used, starts, starts + sizes
        self.at = np.concatenate([np.zeros(0, np.int64), *parts])
        self.doc = np.concatenate([np.zeros(0, np.int64), *docs])
        self.key = hashes(self.text, self.at, w, BASES[0]) >> np.uint64(self.shift)

    def keep_repeated(self, marks: np.ndarray) -> None:
        """Leaves the samples whose name occurs again."""
        _, of, many = _distinct(self.key)
        rep = (many[of] > 1) | (marks[of] & REPEATED > 0)
        self.at, self.doc, self.key = self.at[rep], self.doc[rep], self.key[rep]

    # step 2: the same at full length

    def strings(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return hashes(self.text, starts, self.length, BASES[0]), (hashes(self.text, starts, self.length, BASES[1]) >> np.uint64(32)).astype(np.uint32)

    def full(self) -> np.ndarray:
        return self.at[self.at + self.length <= self.end[self.doc]]

    def repeated_strings(self, starts: np.ndarray, marks: np.ndarray) -> np.ndarray:
        _, of, many = _distinct(*self.strings(starts))
        return starts[(many[of] > 1) | (marks[of] & REPEATED > 0)]

    # step 3: starts where runs end

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of a string that holds the sample's name at most v - 1 bytes after its start."""
        return np.maximum(self.at - self.v + 1, self.begin[self.doc]), np.minimum(self.at, self.end[self.doc] - self.length)

    def open_names(self, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct names, and whether starts before one of a name's samples lie outside of the runs of repeated strings."""
        a, b = _runs(twice, twice + self.length)
        lo, hi = self.before()
        # strings from a to b - length lie in the run: their bytes are covered. Runs may touch across documents: then the string does not fit
        i = np.searchsorted(a, lo, "right") - 1
        inside = (i >= 0) & (b[np.maximum(i, 0)] - self.length >= hi) if len(a) else np.zeros(len(lo), bool)
        first, of, _ = _distinct(self.key)
        flags = np.zeros(len(first), bool)
        flags[of[(lo <= hi) & ~inside]] = True
        return self.key[first], flags

    def candidates(self, marks: np.ndarray) -> np.ndarray:
        _, of, _ = _distinct(self.key)
        lo, hi = self.before()
        use = (marks[of] & FLAGGED > 0) & (lo <= hi)
        lo, hi = lo[use], hi[use] + 1
        order = np.argsort(lo, kind="stable")
        a, b = _runs(lo[order], hi[order])
        n = b - a
        return np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(a) else a, n) + np.arange(n.sum())

    # step 4: what is removed

    def removed(self, starts: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Row number and spans of every document."""
        spans: dict[int, list[tuple[int, int]]] = {}
        cuts = np.searchsorted(starts, np.append(self.begin, len(self.text)))
        for d in np.flatnonzero(np.diff(cuts)):
            s = starts[cuts[d] : cuts[d + 1]] - self.begin[d]
            a, b = _runs(s, s + self.length)
            spans[int(self.used[d])] = list(zip(a.tolist(), b.tolist(), strict=True))
        for i, n in enumerate(self.sizes.tolist()):
            yield i, [(0, n)] if self.whole[i] else spans.get(i, [])


def _distinct(hi: np.ndarray, lo: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys (or pairs of them): for each distinct one in order the index of its first, for each key the number of its distinct one, and how often each occurs."""
    order = np.argsort(hi, kind="stable") if lo is None else np.lexsort((lo, hi))
    h = hi[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if lo is not None:
        x = lo[order]
        new[1:] |= x[1:] != x[:-1]
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return order[at], of, np.diff(np.append(at, len(h)))


def _pack(block_id: int, hi: np.ndarray, lo: np.ndarray | None, bits: int, buckets: int, flags: np.ndarray | None = None) -> pa.RecordBatch:
    """The distinct names of a block, sorted, a row a range of the first 32 bits. A name takes as many bytes as its bits need."""
    first, of, _ = _distinct(hi, lo)
    hi = hi[first]
    width = -(-bits // 8)
    raw = np.ascontiguousarray(hi.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    if lo is not None:
        raw = np.hstack([raw, np.ascontiguousarray(lo[first].astype(">u4")).view(np.uint8).reshape(-1, 4)])
    top = (hi >> np.uint64(bits - 32)).astype(np.uint64)
    bucket = ((top * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    a, b = np.concatenate([[0], cut]), np.concatenate([cut, [len(hi)]])
    rows = [(int(bucket[i]), raw[i:j].tobytes(), flags[first[i:j]].tobytes() if flags is not None else None) for i, j in zip(a.tolist(), b.tolist(), strict=True) if j > i]
    cols = [pa.array([block_id] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())]
    return pa.record_batch(cols, names=["block_id", "bucket", "names", "flags"])


def _compare(names: DataFrame, step: int, bits: int, low: bool) -> DataFrame:
    """Sorts the names of every range, compares neighbours and sends the marks back. A range is bounded: their number follows the bytes."""
    width = -(-bits // 8)

    def marks(t: pa.Table) -> pa.Table:
        t = t.sort_by("block_id")
        raw = [np.frombuffer(x, np.uint8).reshape(-1, width + 4 * low) for x in t.column("names").to_pylist()]
        sizes = [len(x) for x in raw]
        every = np.concatenate(raw)
        wide = np.zeros((len(every), 8), np.uint8)
        wide[:, 8 - width :] = every[:, :width]
        hi = wide.view(">u8").ravel().astype(np.uint64)
        lo = np.ascontiguousarray(every[:, width:]).view(">u4").ravel().astype(np.uint32) if low else None
        first, of, many = _distinct(hi, lo)
        out = np.where(many > 1, REPEATED, 0).astype(np.uint8)
        flags = [x for x in t.column("flags").to_pylist() if x is not None]
        if flags:
            out[of[np.frombuffer(b"".join(flags), bool)]] |= FLAGGED
        out = out[of]
        out[first] |= FIRST
        cuts = np.cumsum([0, *sizes]).tolist()
        data = [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([t.column("block_id"), pa.array([step] * len(data), pa.int32()), t.column("bucket"), pa.array(data, pa.binary())], names=["block_id", "step", "bucket", "marks"])

    return materialize(names.groupBy("bucket").applyInArrow(marks, MARKS), f"suffix-marks-{step}")


def _marks(t: pa.Table) -> list[np.ndarray]:
    """Marks of each step, in the order of a block's sorted names."""
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("step", "bucket", "marks")), strict=True))
    return [np.frombuffer(b"".join(m for s, _, m in rows if s == k), np.uint8) for k in range(5)]


def blocks_of(spark: SparkSession, docs: DataFrame, block_bytes: int) -> DataFrame:
    """Documents as blocks of about block_bytes, in a table that is bucketed by block, so later steps need no shuffle of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_cache(None)
        for b in batches:
            texts = [x or b"" for x in b.column(1).to_pylist()]
            sizes = [len(x) for x in texts]
            for i, k in slices(sizes, block_bytes):
                n = k - i
                block = uuid.uuid4().int >> 65  # the table is written once: which id a block has does not matter
                digests = [hashlib.blake2b(x, digest_size=12).digest() for x in texts[i:k]]
                cols = [pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), b.column(0).slice(i, n), pa.array(sizes[i:k], pa.int64()), pa.array(digests, pa.binary()), pa.array(texts[i:k], pa.binary())]
                yield pa.record_batch(cols, names=["block_id", "seq", "doc_id", "size", "digest", "text"])

    rows = doc_bytes(docs).mapInArrow(run, "block_id long, seq int, doc_id long, size long, digest binary, text binary")
    name, path = f"skein_blocks_{uuid.uuid4().hex}", scratch_path(spark, "suffix-blocks")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "block_id").sortBy("block_id").saveAsTable(name)
    return spark.table(name)


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = 200, block_bytes: int = 4 << 20, range_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end of maximal runs of removed bytes) and kept (the other bytes), a row a document."""
    if length < 1:
        raise ValueError("length must be positive")
    ship(spark)
    v = period(length)
    blocks = blocks_of(spark, docs, block_bytes)
    total = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    samples = max(2, total * len(COVERS[v]) // v)
    bits = min(64, max(32, 8 * -(-(samples.bit_length() + 8) // 8)))  # one sample in 256 passes step 1 by chance
    buckets = max(1, -(-2 * total // range_bytes))
    new = lambda t: Block(t, length, v, 64 - bits)
    small = [F.col(c) for c in ("block_id", "seq", "doc_id", "size", "digest")]
    done: list[DataFrame] = []

    def step(f: Callable[[Block, list[np.ndarray]], tuple], width: int, low: bool) -> None:
        """f: the names of a block from the marks of all steps before."""

        def alone(t: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_pack(t.column("block_id")[0].as_py(), *f(new(t), []), width, buckets)])

        def both(t: pa.Table, m: pa.Table) -> pa.Table:
            if not t.num_rows:
                return pa.Table.from_batches([_pack(0, np.zeros(0, np.uint64), None, width, buckets)])
            hi, lo, *flags = f(new(t), _marks(m))
            return pa.Table.from_batches([_pack(t.column("block_id")[0].as_py(), hi, lo, width, buckets, *flags)])

        if done:
            names = blocks.groupBy("block_id").cogroup(_union(done).groupBy("block_id")).applyInArrow(both, NAMES)
        else:
            names = blocks.select(*small).groupBy("block_id").applyInArrow(alone, NAMES)
        done.append(_compare(names, len(done), width, low))

    def sampled(b: Block, m: list[np.ndarray]) -> Block:
        b.skip_copies(m[0])
        b.sample()
        return b

    def repeated(b: Block, m: list[np.ndarray]) -> Block:
        sampled(b, m).keep_repeated(m[1])
        return b

    step(lambda b, m: b.copies()[1:], 64, True)
    step(lambda b, m: (sampled(b, m).key, None), bits, False)
    step(lambda b, m: b.strings(repeated(b, m).full()), 64, True)

    def open_names(b: Block, m: list[np.ndarray]) -> tuple:
        repeated(b, m)
        key, flags = b.open_names(b.repeated_strings(b.full(), m[2]))
        return key, None, flags

    step(open_names, bits, False)
    step(lambda b, m: b.strings(repeated(b, m).candidates(m[3])), 64, True)

    def result(t: pa.Table, m: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "spans", "kept"]
        types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        if not t.num_rows:
            return pa.table([pa.array([], x) for x in types], names=names)
        b, marks = new(t), _marks(m)
        repeated(b, marks)
        starts = np.union1d(b.repeated_strings(b.full(), marks[2]), b.repeated_strings(b.candidates(marks[3]), marks[4]))
        spans, kept = [], []
        for i, runs in b.removed(starts):
            edges = [0, *(x for r in runs for x in r), len(b.texts[i])]
            kept.append(b"".join(b.texts[i][x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([{"start": x, "end": y} for x, y in runs])
        cols = [b.ids.combine_chunks(), pa.array(b.sizes), *(pa.array(x, k) for x, k in zip((spans, kept), types[2:], strict=True))]
        return pa.table(cols, names=names)

    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return blocks.groupBy("block_id").cogroup(_union(done).groupBy("block_id")).applyInArrow(result, schema)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
