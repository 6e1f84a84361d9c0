"""Near-duplicates by an LSH forest over MinHash signatures.

1. Every text becomes its set of word shingles (64-bit hashes) and a MinHash signature. Equal sets are one class.
2. Classes are put in several sorted orders of the signature: order t starts at component t*STEP and goes round. Rows whose first
   STEP components agree form a region. Only rows that have company in a region go on; most texts of a corpus have none.
3. In each order, every row looks at the rows that follow it within the region, so those of the longest common prefix come first: a
   sparse region is searched at its least depth, a crowded one only as deep as NARROW rows reach. A two-bit sketch and the sizes
   rank what is seen; of these candidates each row has its smallest and its most alike one compared on full shingle sets. Confirmed
   links give first components, which settle most regions: rows of one component need no more comparisons.
4. Regions that still hold several components are searched whole if they have at most WIDE rows: all pairs of different components.
   Sizes and parities (a bit for each of PARITY slots, whether an odd number of shingles falls into it) drop only pairs that cannot
   be links, as parities differ in at most as many bits as the sets do in shingles. What is left is compared on full sets.
5. Rows of larger regions that still hold several components are joined exactly by the rarest shingles of their sets (prefix, size
   and position filters), again only between different components, so a crowd of any size loses no pair to a window.

So a link is lost only if its texts agree in no region at all: at the threshold of 0.8 that has a chance of (1 - 0.8**STEP)**ORDERS,
5 in 100 million, and less above it. Exact copies never meet here: they share one class. Regions are sorted by range and so spread
over many tasks; keys that hold many rows are joined apart from the others (join_spread).

Defined cases: a text with fewer words than a shingle is one shingle of all its words; null texts and texts without words
have an empty set and are linked with nothing; repeated rows are equal sets; rows of one doc_id with different texts are each compared
and keep their own component; a row without doc_id takes part in links but never represents others (without other company its
component is null); an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import CACHES, doc_bytes, join_spread, map_batches, slices, space_words
from skein.session import drop, materialize, ship

STEP = 4
ORDERS = 32
SIZE = STEP * ORDERS
#: Components of the signature in a sort key, after those of the region; two bytes of each.
DEEP = 6
PARITY = 2048
NARROW, WIDE = 32, 256
#: Slots in which shingles are counted, in chunks: their order needs only to be the same for all sets, so that counts may collide.
BUCKETS, CHUNK = 1 << 16, 1 << 10
#: Rows of one shingle that a block of the exact join holds.
BLOCK = 2000
#: Words whose hashes a worker keeps, some 20 MB; each worker of an executor has its own.
WORDS = 1 << 17
#: Edges that a task contracts at once, 4 MB: what is left of so few is settled by one task, more by rounds over all.
EDGES = 1 << 18
_MUL = [np.uint64(x | 1) for x in np.random.default_rng(20240901).integers(0, 2**63, SIZE, dtype=np.int64).astype(np.uint64)]
_ADD = list(np.random.default_rng(20240902).integers(0, 2**63, SIZE, dtype=np.int64).astype(np.uint64))


class _Hashes(dict):
    """Word -> 64-bit hash; emptied when it grows large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_HASHES = _Hashes()
CACHES["shingles"] = _HASHES.clear


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of `size` words; with fewer words, of the whole sequence."""
    w = space_words(text)
    if not w:
        return np.empty(0, dtype=np.uint64)
    if len(w) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, w), dtype=np.uint64, count=len(w))
    s = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s += h[k : len(h) - size + 1 + k]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SIZE components for each non-empty set."""
    out = np.empty((len(sets), SIZE), dtype=np.uint32)
    for a, b in slices([len(s) for s in sets], 60_000):
        flat = np.concatenate(sets[a:b])
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets[a:b]])[:-1]))
        for j in range(SIZE):
            v = flat * _MUL[j]
            v += _ADD[j]
            v >>= np.uint64(32)
            out[a:b, j] = np.minimum.reduceat(v, at)
    return out


def parity(shingles: np.ndarray) -> bytes:
    """A bit for each slot: whether an odd number of shingles falls into it."""
    return np.packbits(np.bincount((shingles >> np.uint64(40)) % np.uint64(PARITY), minlength=PARITY) & 1).tobytes()


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, set_key (128 bits of the set), sig; a document without words has neither of the last two."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t.as_py(), shingle) for t in b.column("text")]
        sig = iter(_signatures([s for s in sets if len(s)]))
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "th", "n_shingles", "set_key", "sig"])

    return map_batches(doc_bytes(docs).withColumn("th", F.xxhash64("text")), run, "doc_id long, th long, n_shingles long, set_key binary, sig binary", "shingles")


def _sig(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint32).reshape(b.num_rows, SIZE)


def regions(sig: np.ndarray) -> np.ndarray:
    """The region of each row in each order: a hash of its STEP components, with the order's number in the lowest bits."""
    h = np.broadcast_to(np.arange(ORDERS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(sig), ORDERS)).copy()
    for k in range(STEP):
        h ^= sig[:, k::STEP]
        h *= np.uint64(0xD1342543DE82EF95)
        h ^= h >> np.uint64(29)
    return (h & ~np.uint64(ORDERS - 1)) | np.arange(ORDERS, dtype=np.uint64)


def company(classes: DataFrame) -> DataFrame:
    """(region, node) of all rows that are not alone in a region."""

    def stubs(b: pa.RecordBatch) -> pa.RecordBatch:
        r = regions(_sig(b))
        return pa.RecordBatch.from_arrays([pa.array(r.view(np.int64).ravel()), pa.array(np.repeat(b.column("node").to_numpy(), ORDERS))], ["region", "node"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, region, node, has = ["region", "node"], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        for b in batches:
            start = not len(region)
            region = np.concatenate((region, b.column(0).to_numpy()))
            node = np.concatenate((node, b.column(1).to_numpy()))
            has = np.concatenate((has, np.zeros(b.num_rows, bool)))
            if not len(region):
                continue
            same = region[1:] == region[:-1]
            has[:-1] |= same
            has[1:] |= same
            has[0] |= start  # the region may have begun in the task before
            if (out := has[:-1]).any():
                yield pa.RecordBatch.from_arrays([pa.array(region[:-1][out]), pa.array(node[:-1][out])], names)
            region, node, has = region[-1:], node[-1:], has[-1:]
        if len(region):  # and this one may go on in the next
            yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(node)], names)

    rows = map_batches(classes.select("node", "sig"), stubs, "region long, node long")
    return rows.repartitionByRange("region", "node").sortWithinPartitions("region", "node").mapInArrow(several, "region long, node long")


def forest(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """A sorted entry for each row with company: key (region, the next components of its order, a random part against ties), id, size, sketch."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, sig = b.num_rows, _sig(b)
        bits = (sig & 3).astype(np.uint8).reshape(n, SIZE // 4, 4)
        sketch = (bits << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
        counts = b.column("regions").value_lengths().to_numpy()
        region = b.column("regions").flatten().to_numpy().view(np.uint64)
        at = np.repeat(np.arange(n), counts)
        order = (region & np.uint64(ORDERS - 1)).astype(np.int64)
        deeper = (order * STEP + STEP)[:, None] + np.arange(DEEP)
        ids = b.column("node").to_numpy()[at]
        tie = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ region) * np.uint64(0xD1342543DE82EF95) >> np.uint64(32)
        key = np.concatenate(
            (region.astype(">u8").view(np.uint8).reshape(-1, 8), (sig[at[:, None], deeper % SIZE] >> np.uint32(16)).astype(">u2").view(np.uint8).reshape(len(at), -1), tie.astype(">u4").view(np.uint8).reshape(-1, 4)), axis=1
        )
        return pa.RecordBatch.from_pydict({
            "key": pa.array([r.tobytes() for r in key], pa.binary()), "id": pa.array(ids), "n": pa.array(b.column("n_shingles").to_numpy()[at]),
            "sketch": pa.array([r.tobytes() for r in sketch], pa.binary()).take(pa.array(at)),
        })

    mine = rows.groupBy("node").agg(F.collect_list("region").alias("regions"))  # at most ORDERS
    return map_batches(classes.select("node", "n_shingles", "sig").join(mine, "node"), run, "key binary, id long, n long, sketch binary")


def _pairs(code: np.ndarray, n: np.ndarray, window: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one region (equal codes, which stand together) up to `window` rows apart whose sizes may reach the threshold, nearest first."""
    rows = len(code)
    group = np.concatenate(([0], np.cumsum(code[1:] != code[:-1])))
    live = np.arange(rows)
    for o in range(1, min(window, rows - 1) + 1):
        live = live[live + o < rows]
        live = live[group[live] == group[live + o]]
        if not len(live):
            return
        i, j = live, live + o
        ok = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
        yield i[ok], j[ok]


PAIR = "u long, v long"


def neighbours(trees: DataFrame, threshold: float, window: int = NARROW) -> DataFrame:
    """(u, v, far): for each row of each order the nearest on either side that may reach the threshold; far counts sketch differences."""
    match = threshold + (1 - threshold) / 4
    most = int(SIZE * (1 - match) + 5 * (SIZE * match * (1 - match)) ** 0.5)
    width = 8 + 2 * DEEP + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            # the last rows come again with the next batch; their pairs among each other then repeat, which the aggregate below mends
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            held = t.slice(max(0, t.num_rows - window))
            key = np.frombuffer(b"".join(t.column("key").to_pylist()), dtype=np.uint8).reshape(-1, width)
            code = np.ascontiguousarray(key[:, :8]).view(np.uint64).ravel()
            sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint64).reshape(t.num_rows, -1)
            ids, later, before, out = t.column("id").to_numpy(), np.zeros(t.num_rows, bool), np.zeros(t.num_rows, bool), []
            for i, j in _pairs(code, t.column("n").to_numpy(), window, threshold):
                open_ = ~later[i] | ~before[j]
                i, j = i[open_], j[open_]
                x = sk[i] ^ sk[j]
                far = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
                good = far <= most
                i, j, far = i[good], j[good], far[good]
                later[i] = True
                before[j] = True
                if len(i):
                    out.append(np.stack((np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), far.astype(np.int64))))
            if out:
                u, v, far = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(far)], ["u", "v", "far"])

    # tasks are cut by sampled key ranges, so a crowded region is spread over many
    found = trees.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, PAIR + ", far long")
    return found.groupBy("u", "v").agg(F.min("far").alias("far"))


def with_regions(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows (region, node) of the regions that hold several components, and how many rows these have as n. comps: node, comp."""
    seen = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    seen = seen.groupBy("region").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    # regions of one component stay in, so that the rows of large ones are kept out of the shuffle
    seen = materialize(seen.select("region", "n", F.col("n").alias("rows"), (F.col("low") != F.col("high")).alias("mixed")), "regions")
    out = materialize(join_spread(rows, seen, "region", "rows", rows.count()).where("mixed").select("region", "node", "n"), "mixed")
    drop(seen)
    return out


def across(rows: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(u, v): all pairs of different components in a region that may be links. rows: (region, node), at most WIDE of a region; nodes: node, n_shingles, comp, parity."""
    #: A link's sets differ in at most this share of both sizes together.
    differ = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            region = t.column("region").to_numpy()
            last = int(np.searchsorted(region, region[-1]))  # a region that may go on
            held = t.slice(last)
            if last:
                yield from found(t.slice(0, last))
        if held is not None:
            yield from found(held)

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n, comp, ids = (t.column(c).to_numpy() for c in ("n_shingles", "comp", "node"))
        odd = np.frombuffer(b"".join(t.column("parity").to_pylist()), dtype=np.uint64).reshape(t.num_rows, -1)
        for i, j in _pairs(t.column("region").to_numpy(), n, WIDE, threshold):
            other = comp[i] != comp[j]
            i, j = i[other], j[other]
            good = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1) <= differ * (n[i] + n[j]) + 1e-9
            i, j = i[good], j[good]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["u", "v"])

    full = rows.join(nodes.select("node", "n_shingles", "comp", "parity"), "node")
    return full.repartition("region").sortWithinPartitions("region").mapInArrow(run, PAIR).distinct()


def shingle_counts(rows: DataFrame, shingle: int) -> np.ndarray:
    """How many sets of the rows (text) have a shingle in each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(n, (shingle_set(t.as_py(), shingle) % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = [k for k in range(BUCKETS // CHUNK) if n[k * CHUNK : (k + 1) * CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([n[k * CHUNK : (k + 1) * CHUNK].tobytes() for k in at], pa.binary())], ["chunk", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n in zip(b.column("chunk").to_pylist(), b.column("n").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(n, dtype=np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([n.tobytes() for n in total.values()], pa.binary())], ["chunk", "n"])

    got = rows.select("text").mapInArrow(count, "chunk int, n binary").repartition(BUCKETS // CHUNK, "chunk").mapInArrow(add, "chunk int, n binary")
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in got.collect():  # BUCKETS counts in all
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["n"], dtype=np.int64)
    return counts


def rare_pairs(rows: DataFrame, shingle: int, threshold_percent: int) -> DataFrame:
    """(u, v): all pairs of rows (node, text, comp, members: rows of that comp) of different components whose sets may reach the threshold.

    Sets are ordered by the counts of their shingles, rarest first. Two sets that reach the threshold share a shingle among the
    first of both: of n, all but `needed` and one more, and in the smaller set all but its part of the least common share."""
    q = threshold_percent
    counts = shingle_counts(rows, shingle)

    def prefixes(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, t, c, m in zip(b.column("node").to_pylist(), b.column("text"), b.column("comp").to_pylist(), b.column("members").to_pylist(), strict=True):
            s = shingle_set(t.as_py(), shingle)
            n = len(s)
            often = counts[(s % np.uint64(BUCKETS)).astype(np.int64)]
            order = np.lexsort((s, often))[: n + (-q * n // 100) + 1]
            pos = np.flatnonzero(often[order] > 1)  # a shingle alone in its slot is in no other set
            out.append((s[order[pos]].view(np.int64), pos, *(np.full(len(pos), x) for x in (i, n, c, m))))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["token", "pos", "node", "n", "comp", "members"])

    post = map_batches(rows.select("node", "text", "comp", "members"), prefixes, "token long, pos long, node long, n long, comp long, members long", "shingles")
    # as the smaller set: the common part is at least 2q/(100+q) of its size
    post = materialize(post.withColumn("small", (100 + q) * (F.col("n") - F.col("pos")) >= 2 * q * F.col("n")), "prefixes")
    stats = post.groupBy("token").agg(F.count("*").alias("rows"), F.max_by("comp", "members").alias("main"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.max("small").alias("any"))
    stats = materialize(stats.where("c0 != c1 and any").select("token", "main", "rows", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "tokens")
    known = join_spread(post, stats, "token", "rows", post.count()).withColumn("minor", F.col("comp") != F.col("main"))
    post, old = materialize(known.select("token", "blocks", "minor", "small", "node", "n", "pos", "comp"), "postings"), post
    drop(old, stats)

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of a frequent shingle are cut into blocks, and each left one meets every block."""
        a = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", "block", *[F.col(c).alias(f"a_{c}") for c in ("node", "n", "pos", "comp")])
        b = right.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        shared = F.least(F.col("a_n") - F.col("a_pos"), F.col("n") - F.col("pos"))
        d = a.join(b, ["token", "block"]).where((F.col("a_comp") != F.col("comp")) & (F.col("a_n") <= F.col("n")) & (100 * F.col("a_n") >= q * F.col("n")) & ((100 + q) * shared >= q * (F.col("a_n") + F.col("n"))))
        return d.select(F.least("a_node", "node").alias("u"), F.greatest("a_node", "node").alias("v"))

    # rows of a shingle's main component need not meet each other
    short = post.where("small")
    pairs = materialize(joined(short.where("minor"), post).unionByName(joined(short.where("not minor"), post.where("minor"))).distinct(), "pairs")
    drop(post)
    return pairs


def may_link(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose parities differ in no more bits than the sets of a link."""
    differ = (1 - threshold) / (1 + threshold)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bits = [np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint64).reshape(b.num_rows, -1) for c in ("a", "b")]
        good = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1) <= differ * b.column("n").to_numpy() + 1e-9
        return b.select(["u", "v"]).filter(pa.array(good))

    one = lambda k, p: nodes.select(F.col("node").alias(k), F.col("parity").alias(p), F.col("n_shingles").alias(f"n{p}"))
    both = pairs.join(one("u", "a"), "u").join(one("v", "b"), "v").select("u", "v", "a", "b", (F.col("na") + F.col("nb")).alias("n"))
    return map_batches(both, run, PAIR)


def links(pairs: DataFrame, texts: DataFrame, shingle: int, threshold_percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold: 100 * intersection >= percent * union. texts: node, text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep, last, last_set = [], None, None
        for u, a, c in zip(b.column("u").to_pylist(), b.column("a"), b.column("text"), strict=True):
            if u != last:
                last, last_set = u, shingle_set(a.as_py(), shingle)
            s, t = last_set, shingle_set(c.as_py(), shingle)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(both > 0 and 100 * both >= threshold_percent * (len(s) + len(t) - both))
        return pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], ["u", "v"]).filter(pa.array(keep))

    left = texts.select(F.col("node").alias("u"), F.col("text").alias("a"))
    right = texts.select(F.col("node").alias("v"), "text")
    both = pairs.select("u", "v").join(right, "v").join(left, "u")
    return map_batches(both.select("u", "v", "a", "text"), run, PAIR, "shingles")


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, ascending, and the smallest node that each reaches by them."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(ids))
    while True:
        new, x, y = low.copy(), low[a], low[b]
        np.minimum.at(new, x, y)
        np.minimum.at(new, y, x)
        while len(open_ := np.flatnonzero(new[new] != new)):
            new[open_] = new[new[open_]]
        if (new == low).all():
            return ids, ids[low]
        low = new


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v): the edges of each task, EDGES at a time, as stars around the smallest node that each node reaches by them; components stay the same."""

    def star(t: pa.Table) -> pa.RecordBatch:
        u, v = roots(t.column("u").to_numpy(), t.column("v").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= EDGES:
                yield star(pa.Table.from_batches(held))
                held = []
        if held:
            yield star(pa.Table.from_batches(held))

    return edges.select("u", "v").mapInArrow(run, PAIR)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its smallest node): tasks contract what edges they have, then alternating stars; each round is a table in the shared folder.
    Where contraction leaves no more than a task contracts at once, one does the rest."""
    e = materialize(contracted(edges), "edges")
    if e.count() <= EDGES:
        e, old = materialize(contracted(e.coalesce(1)), "edges"), e
        drop(old)
        return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    e, old = materialize(e.distinct(), "edges"), e
    drop(old)
    state = None

    def to_least(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
        """Each row's v with the least neighbour of its u."""
        return join_spread(rows, low, "u", "rows", total).select(F.col("v").alias("u"), F.col("m").alias("v"))

    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")).select("u", F.least("u", "m").alias("m"), "rows"), "least")
        total = 2 * e.count()
        large = materialize(to_least(both.where("v > u"), low, total).distinct(), "edges")
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")), "least")
        small = to_least(large, low2, total).where("u != v").unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "edges")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v") % 1000003)).first()
        drop(e, low, low2, large)
        e = new
        if now == state or not now[0]:
            break
        state = now
    own = e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("comp"))
    return e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, threshold_percent: int = 80, hashes: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (that one); with hashes also th, xxhash64 of the text."""
    ship(spark)
    threshold = threshold_percent / 100
    sigs = materialize(signatures(docs, shingle), "signatures")
    # a class is represented by a row of it: a document and its text's hash; nodes are numbered once, in a table
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "th"))
    classes = sigs.where("set_key is not null").groupBy("set_key").agg(rep.alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "set_key", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"), "copies", "n_shingles", "sig"), "classes")
    rows = materialize(company(classes), "company")

    def with_parity(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = (shingle_set(t.as_py(), shingle) for t in b.column("text"))
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "n_shingles", "text")), pa.array([parity(s) for s in sets], pa.binary())], ["node", "n_shingles", "text", "parity"])

    wanted = classes.select("node", "n_shingles", F.col("doc_id").alias("d"), F.col("th").alias("h")).join(rows.select("node").distinct(), "node", "left_semi")
    texts = doc_bytes(docs).withColumn("th", F.xxhash64("text")).join(wanted, (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")))
    texts = texts.select("node", "n_shingles", "text").dropDuplicates(["node"])
    nodes = materialize(map_batches(texts, with_parity, "node long, n_shingles long, text binary, parity binary", "shingles"), "texts")

    found = materialize(neighbours(forest(classes, rows), threshold), "chain")
    near = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"), "far")).groupBy("u").agg(F.min("v").alias("low"), F.min(F.struct("far", "v")).alias("best"))
    first = near.select("u", F.explode(F.array("low", "best.v")).alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    first = materialize(first, "pairs")
    # written before they are contracted: one stage of both would need two Python workers a core
    sure = materialize(links(first, nodes, shingle, threshold_percent), "links")
    comps = materialize(components(sure), "components")
    drop(found, sure)

    def with_more(comps: DataFrame, more: DataFrame) -> DataFrame:
        """Components with more links, given between nodes."""
        more = materialize(more, "links")
        out = comps
        if not more.isEmpty():
            out = materialize(components(comps.select(F.col("node").alias("u"), F.col("comp").alias("v")).unionByName(more)), "components")
            drop(comps)
        drop(more)
        return out

    with_comp = lambda d: d.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = with_regions(rows, comps)
    rest = across(mixed.where(F.col("n") <= WIDE).select("region", "node"), with_comp(nodes), threshold).join(first, ["u", "v"], "left_anti")
    comps = with_more(comps, links(rest, nodes, shingle, threshold_percent))

    crowded = with_regions(mixed.where(F.col("n") > WIDE).select("region", "node"), comps)
    packed = materialize(with_comp(nodes.join(crowded.select("node").distinct(), "node", "left_semi").select("node", "text")), "packed")
    drop(rows, first, mixed, crowded)
    if not packed.isEmpty():
        sizes = packed.groupBy("comp").agg(F.count("*").alias("members")).withColumn("rows", F.col("members"))
        packed, old = materialize(join_spread(packed, sizes, "comp", "rows", packed.count()), "packed"), packed
        drop(old)
        last = rare_pairs(packed, shingle, threshold_percent)
        comps = with_more(comps, links(may_link(last, nodes, threshold), nodes, shingle, threshold_percent))
        drop(last)
    drop(nodes, packed)

    linked = materialize(classes.select("node", "set_key", "doc_id", "copies").join(comps, "node"), "linked")
    roots = materialize(linked.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")), "roots")
    known = join_spread(linked, roots, "comp", "rows", linked.count()).select("set_key", "component_id", "copies")
    alone = classes.join(comps, "node", "left_anti").where("copies > 1").select("set_key", F.col("doc_id").alias("component_id"), "copies")
    member = materialize(known.unionByName(alone), "members")
    drop(linked, roots, comps, classes)
    out = sigs.select("doc_id", "n_shingles", "set_key", *(more := ["th"] if hashes else []))
    shared = join_spread(out, member, "set_key", "copies", out.count()).select("doc_id", "n_shingles", "component_id", *more)
    single = out.join(member, "set_key", "left_anti").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *more)
    return shared.unionByName(single).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), *more)


def keep_first(spark: SparkSession, docs: DataFrame, shingle: int = 5, threshold_percent: int = 80) -> DataFrame:
    """All columns of the rows that stay: of each group that of the smallest doc_id. Rows without doc_id stay, as do texts without words."""
    drop_ = near_duplicates(spark, docs, shingle, threshold_percent, hashes=True).where("doc_id is not null and not kept").select(F.col("doc_id").alias("_gone"), F.col("th").alias("_gone_th")).distinct()
    return docs.join(drop_, (F.col("doc_id").cast("long") == F.col("_gone")) & (F.xxhash64(F.col("text").cast("binary")) == F.col("_gone_th")), "left_anti")
