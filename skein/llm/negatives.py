"""Hard-negative mining by a dual-tree search with inner products.

Rows are the queries (anchors) and the candidates. Rows of equal vector and label have equal scores, so they form one class that keeps
its few smallest ids; whatever a third of all rows is, it is one class. Then:

1. A tree of bounded size is fitted on a sample of at most `sample` classes: median cuts along the direction of most variance.
   Every class, of anchors and of candidates, is routed to a cell of it; cells are cut into leaves of at most `leaf` classes in the order of
   a projection. A node knows the box of its vectors, and a centre with a radius; these are of all its rows, not of the sample.
2. Node pairs: the box and the ball of an anchor node and of a candidate node bound all inner products between them from both sides. From the
   roots down, a pair is dropped with its whole anchor group as soon as its interval cannot hold a wanted score.
3. Leaves of the cells that are left are joined with the anchor leaf; a pair of leaves is bounded once more, then scored exactly.

Positives are searched in the anchors' own cell first, which gives every anchor leaf the score that another cell must reach;
negatives are searched where intervals meet the window between 80 % of the least and 100 % of the largest positive score. Pruning
never drops a wanted row, so the results are those of brute force; the sample only decides how well cells fit.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part. Shorter vectors are filled up
with zeros. Scaled components are cut at +-2**b, b = (62 - bits of the dimension) / 2 (2**27 for 64 components), so that scores fit a long.
A row without vec_id is never an anchor and comes after all others of its score. Rows that repeat are rows of their own, also as each other's
positives; ties of vec_id have equal results. Negative positive scores have an empty window. Columns other than vec_id, embedding and label are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import join_spread, keep_cache
from skein.session import materialize, ship

SCALE = 256.0
#: Id of a row without one: after all others.
NAMELESS = (1 << 63) - 1
NOTHING = -(1 << 62)
PARTIAL = "class_id long, positive long, score long, id long"


def clean_rows(vectors: DataFrame, dim: int, relabel: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label and vec: the scaled vector as packed 32-bit integers, of the rows that take part."""
    most = float(1 << (62 - max(1, dim).bit_length()) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_cache(None)
        for b in batches:
            e = b.column(1)
            flat = e.flatten()
            x = np.floor(SCALE * flat.to_numpy(zero_copy_only=False).astype(np.float64))
            sizes = np.diff(e.offsets.to_numpy())
            row = np.repeat(np.arange(len(e)), sizes)
            ok = np.ones(len(e), bool)
            ok[row[~np.isfinite(x)]] = False  # nulls are NaN here
            m = np.zeros((len(e), dim), np.int32)
            place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            m[row, place] = np.clip(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0), -most, most).astype(np.int32)
            keep = np.flatnonzero(ok)
            yield pa.record_batch([b.column(0).take(pa.array(keep)), b.column(2).take(pa.array(keep)), pa.array([m[i].tobytes() for i in keep], pa.binary())], names=["vec_id", "label", "vec"])

    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("int")
    d = vectors.select(vec_id.alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.when(vec_id % relabel == 0, (label + 1) % labels).otherwise(label).alias("label"))
    return d.where("e IS NOT NULL AND label IS NOT NULL").mapInArrow(run, "vec_id long, label int, vec binary")


def classes_of(rows: DataFrame, anchors: DataFrame, ids: int) -> DataFrame:
    """class_id, vec, label, ids (the smallest of the class) and anchors (how many of its rows are anchors), a row a vector and label."""
    few = rows.withColumn("id", F.coalesce("vec_id", F.lit(NAMELESS))).withColumn("r", F.row_number().over(Window.partitionBy("vec", "label").orderBy("id"))).where(F.col("r") <= ids)
    few = few.groupBy("vec", "label").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    of = anchors.groupBy("vec", "label").agg(F.count("*").alias("anchors"))
    d = few.join(of, ["vec", "label"], "left").select("vec", "label", "ids", F.coalesce("anchors", F.lit(0)).cast("long").alias("anchors"))
    return materialize(d.withColumn("class_id", F.monotonically_increasing_id()), "negatives-classes")


class Tree:
    """A complete binary tree of cuts; node k has the children 2 k and 2 k + 1, the root is 1, and cells are the nodes of the last level."""

    def __init__(self, sample: np.ndarray, depth: int):
        n = 1 << depth
        dim = sample.shape[1]
        self.depth, self.direction, self.cut = depth, np.zeros((n, dim)), np.zeros(n)
        own = {1: sample.astype(np.float64)}
        for k in range(1, n):
            x = own.pop(k)
            if len(x) > 1:
                _, vectors = np.linalg.eigh(np.cov(x.T).reshape(dim, dim))
                self.direction[k] = vectors[:, -1]
            y = x @ self.direction[k]
            self.cut[k] = np.median(y) if len(y) else 0.0
            own[2 * k], own[2 * k + 1] = x[y <= self.cut[k]], x[y > self.cut[k]]

    def cell(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and the place along the last cut, which orders the classes of a cell."""
        at, y = np.ones(len(x), np.int64), x[:, 0].astype(np.float64) if x.shape[1] else np.zeros(len(x))
        for _ in range(self.depth):
            y = np.einsum("ij,ij->i", x, self.direction[at])
            at = 2 * at + (y > self.cut[at])
        return at, y


class Nodes:
    """Boxes and balls of nodes, one a row; the inner products of two nodes lie within between()."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, centre: np.ndarray, radius: np.ndarray):
        self.lo, self.hi, self.centre, self.radius = lo, hi, centre, radius

    @staticmethod
    def of(x: np.ndarray) -> tuple[bytes, bytes, bytes, float]:
        """The node of the vectors x, packed."""
        x = x.astype(np.float64)
        centre = x.mean(0)
        return x.min(0).tobytes(), x.max(0).tobytes(), centre.tobytes(), float(np.sqrt(((x - centre) ** 2).sum(1).max()))

    @staticmethod
    def read(t, dim: int) -> Nodes:
        rows = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.float64).reshape(-1, dim)
        return Nodes(rows("lo"), rows("hi"), rows("centre"), np.array(t.column("radius").to_pylist(), np.float64))

    def take(self, i) -> Nodes:
        return Nodes(self.lo[i], self.hi[i], self.centre[i], self.radius[i])

    def joined(self) -> Nodes:
        """One node around all of these."""
        centre = self.centre.mean(0)
        radius = (np.sqrt(((self.centre - centre) ** 2).sum(1)) + self.radius).max()
        return Nodes(self.lo.min(0)[None], self.hi.max(0)[None], centre[None], np.array([radius]))

    def between(self, i: int, other: Nodes, j: int) -> tuple[float, float]:
        a, b, c, d = self.lo[i], self.hi[i], other.lo[j], other.hi[j]
        products = np.stack([a * c, a * d, b * c, b * d])
        box = products.min(0).sum(), products.max(0).sum()
        middle, ra, rb = self.centre[i] @ other.centre[j], self.radius[i], other.radius[j]
        apart = np.linalg.norm(self.centre[i]) * rb + np.linalg.norm(other.centre[j]) * ra + ra * rb
        slack = 1 + 1e-9 * (abs(middle) + apart)  # centres and radii are rounded
        return max(box[0], middle - apart - slack), min(box[1], middle + apart + slack)


class CellTree:
    """The nodes of a tree over cells, from the cells that hold rows up to the root."""

    def __init__(self, cells: list[int], nodes: Nodes, depth: int):
        self.first, self.nodes = 1 << depth, {}
        level = {c: nodes.take([i]) for i, c in enumerate(cells)}
        while level:
            self.nodes.update(level)
            up: dict[int, list[Nodes]] = {}
            for c, x in level.items():
                if c > 1:
                    up.setdefault(c // 2, []).append(x)
            level = {c: Nodes(*(np.concatenate([getattr(x, k) for x in xs]) for k in ("lo", "hi", "centre", "radius"))).joined() for c, xs in up.items()}

    def pairs(self, anchors: Nodes, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, int]]:
        """Anchor leaf and cell of all pairs that may have a score between the leaf's least and most; both trees are walked down together."""

        def visit(i: int, j: int, group: Nodes, k: int) -> Iterator[tuple[int, int]]:
            lo, hi = group.between(0, self.nodes[k], 0)
            if hi < least[i:j].min() or lo > most[i:j].max():
                return
            if j - i > 1 and (k >= self.first or group.radius[0] > self.nodes[k].radius[0]):
                m = (i + j) // 2
                for a, b in ((i, m), (m, j)):
                    yield from visit(a, b, anchors.take(slice(a, b)).joined() if b - a > 1 else anchors.take([a]), k)
            elif k >= self.first:
                yield i, k
            else:
                for c in (2 * k, 2 * k + 1):
                    if c in self.nodes:
                        yield from visit(i, j, group, c)

        if len(anchors.radius) and 1 in self.nodes:
            yield from visit(0, len(anchors.radius), anchors.joined(), 1)


def leaves_of(classes: DataFrame, tree: Tree, dim: int, leaf: int, ids: int, name: str) -> DataFrame:
    """Leaves in the order of cells and of a projection within, cut as they stream by: leaf_id, cell, the packed classes and the node."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_cache(None)
        for b in batches:
            if b.num_rows:
                cell, y = tree.cell(np.frombuffer(b"".join(b.column("vec").to_pylist()), np.int32).reshape(-1, dim))
                yield pa.record_batch([*b.columns, pa.array(cell), pa.array(y)], names=[*b.schema.names, "cell", "along"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            own = np.full((len(rows), ids), NAMELESS, np.int64)
            for i, r in enumerate(rows):
                own[i, : len(r[3])] = r[3]
            x = np.frombuffer(b"".join(r[1] for r in rows), np.int32).reshape(-1, dim)
            out = (rows[0][0], rows[0][4], x.tobytes(), np.array([r[2] for r in rows], np.int32).tobytes(), own.tobytes(), np.array([len(r[3]) for r in rows], np.int32).tobytes(), np.array([r[0] for r in rows], np.int64).tobytes(), *Nodes.of(x))
            return pa.record_batch([pa.array([v], t) for v, t in zip(out, [pa.int64(), pa.int64(), *[pa.binary()] * 8, pa.float64()], strict=True)], names=list(LEAF))

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("class_id", "vec", "label", "ids", "cell")), strict=True):
                if rows and (len(rows) >= leaf or rows[0][4] != r[4]):
                    yield packed()
                    rows.clear()
                rows.append(r)
        if rows:
            yield packed()

    d = classes.select("class_id", "vec", "label", "ids").mapInArrow(route, "class_id long, vec binary, label int, ids array<long>, cell long, along double")
    d = d.repartitionByRange("cell", "along", "class_id").sortWithinPartitions("cell", "along", "class_id")
    return materialize(d.mapInArrow(cut, ", ".join(f"{k} {v}" for k, v in LEAF.items())), name)


LEAF = {"leaf_id": "long", "cell": "long", "vecs": "binary", "labels": "binary", "ids": "binary", "counts": "binary", "classes": "binary", "lo": "binary", "hi": "binary", "centre": "binary", "radius": "double"}


def cell_tree(leaves: DataFrame, dim: int, depth: int) -> CellTree:
    """The node of every cell is made where its leaves are; at most 2**depth of them come to the driver."""

    def joined(t: pa.Table) -> pa.Table:
        x = Nodes.read(t, dim).joined()
        return pa.table([pa.array([t.column("cell")[0].as_py()]), *(pa.array([getattr(x, c)[0].tobytes()], pa.binary()) for c in ("lo", "hi", "centre")), pa.array([float(x.radius[0])])], names=["cell", "lo", "hi", "centre", "radius"])

    schema = "cell long, lo binary, hi binary, centre binary, radius double"
    nodes = ["lo", "hi", "centre", "radius"]
    # two levels, so that no task sees all leaves of a cell that holds many
    d = leaves.select("cell", (F.col("leaf_id") % 64).alias("part"), *nodes).groupBy("cell", "part").applyInArrow(lambda t: joined(t), schema)
    got = d.groupBy("cell").applyInArrow(lambda t: joined(t), schema).toArrow()
    return CellTree(got.column("cell").to_pylist(), Nodes.read(got, dim), depth)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if a.size and b.size and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def window(positive):
    """The least score s with 100 s >= 80 positive, for positive >= 0."""
    return positive - positive // 5


class Best:
    """The first k (score, then smaller id) of several lists, as rows stream by."""

    def __init__(self, lists: int, k: int):
        self.k, self.score, self.id = k, np.full((lists, k), NOTHING, np.int64), np.full((lists, k), NAMELESS, np.int64)

    def add(self, rows: np.ndarray, s: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """s: a row for each of the lists `rows`, a column for each class; NOTHING is no score."""
        least = self.score[rows, -1]
        if s.shape[1] > self.k:
            least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
        hit = (s >= least[:, None]) & (s > NOTHING)
        for i in np.flatnonzero(hit.any(1)):
            j = np.flatnonzero(hit[i])
            n = counts[j]
            more = ids[j][np.arange(ids.shape[1]) < n[:, None]]
            score, own = np.concatenate([self.score[rows[i]], np.repeat(s[i, j], n)]), np.concatenate([self.id[rows[i]], more])
            o = np.lexsort((own, -score))[: self.k]
            self.score[rows[i]], self.id[rows[i]] = score[o], own[o]


def _search(pairs: DataFrame, leaves: DataFrame, dim: int, ids: int, k: int, state_lists: int = 1 << 16) -> DataFrame:
    """Scores anchor leaves against the leaves of the cells they are paired with: the first k of each wanted list.

    pairs: leaf_id, cell, and of the anchor leaf vecs, labels, classes, its node and `wanted`: for each class 0 or more positive scores (else the
    search is for the class's own label). A task keeps the lists of the anchor leaves it meets, at most about state_lists of them, then sends
    them on."""
    width = ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_cache(None)
        held: dict[int, tuple] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for classes, wanted, best in held.values():
                for r, b in enumerate(best):
                    i, c = np.nonzero(b.score > NOTHING)
                    cols = [classes[i], wanted[i, r] if wanted is not None else np.zeros(len(i), np.int64), b.score[i, c], b.id[i, c]]
                    yield pa.record_batch([pa.array(x) for x in cols], names=["class_id", "positive", "score", "id"])
            held.clear()

        for b in batches:
            for r in range(b.num_rows):
                v = {c: b.column(c)[r].as_py() for c in b.schema.names}
                x = np.frombuffer(v["vecs"], np.int32).reshape(-1, dim)
                if v["leaf_id"] not in held:
                    if sum(len(h[0]) * len(h[2]) for h in held.values()) > state_lists:
                        yield from out()
                    wanted = np.frombuffer(v["wanted"], np.int64).reshape(len(x), -1) if v["wanted"] is not None else None
                    lists = 1 if wanted is None else wanted.shape[1]
                    held[v["leaf_id"]] = (np.frombuffer(v["classes"], np.int64), wanted, [Best(len(x), k) for _ in range(lists)])
                _, wanted, best = held[v["leaf_id"]]
                lo, hi = _node(v, "").between(0, _node(v, "c_"), 0)
                y = np.frombuffer(v["c_vecs"], np.int32).reshape(-1, dim)
                own, other = np.frombuffer(v["labels"], np.int32), np.frombuffer(v["c_labels"], np.int32)
                candidate = (np.frombuffer(v["c_ids"], np.int64).reshape(-1, width), np.frombuffer(v["c_counts"], np.int32))
                if wanted is None:
                    use = np.flatnonzero(best[0].score[:, -1] <= hi)
                    if len(use):
                        best[0].add(use, np.where(own[use, None] == other, scores(x[use], y), NOTHING), *candidate)
                    continue
                s = None
                for n in range(wanted.shape[1]):
                    p = wanted[:, n]
                    use = np.flatnonzero((p >= 0) & (p >= lo) & (window(p) <= hi) & (best[n].score[:, -1] <= hi))
                    if len(use):
                        s = np.where(own[:, None] != other, scores(x, y), NOTHING) if s is None else s
                        part, q = s[use], p[use, None]
                        best[n].add(use, np.where((part <= q) & (part >= window(q)), part, NOTHING), *candidate)
        yield from out()

    c = leaves.select("cell", *[F.col(x).alias(f"c_{x}") for x in ("vecs", "labels", "ids", "counts", "lo", "hi", "centre", "radius")])
    return pairs.join(c, "cell").mapInArrow(run, PARTIAL)


def _node(v: dict, prefix: str) -> Nodes:
    rows = [np.frombuffer(v[prefix + c], np.float64)[None] for c in ("lo", "hi", "centre")]
    return Nodes(*rows, np.array([v[prefix + "radius"]]))


def _first(partial: DataFrame, k: int) -> DataFrame:
    """The first k of every list; a task has sent k rows of a list at most."""
    w = Window.partitionBy("class_id", "positive").orderBy(F.desc("score"), "id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _members(anchor_leaves: DataFrame, dim: int) -> DataFrame:
    """class_id, leaf_id, its place in the leaf, and the class's inner product with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for leaf, vecs, classes in zip(*(b.column(c).to_pylist() for c in ("leaf_id", "vecs", "classes")), strict=True):
                x, own = np.frombuffer(vecs, np.int32).reshape(-1, dim).astype(np.int64), np.frombuffer(classes, np.int64)
                yield pa.record_batch([pa.array(own), pa.array(np.full(len(own), leaf)), pa.array(np.arange(len(own))), pa.array((x * x).sum(1))], names=["class_id", "leaf_id", "place", "itself"])

    return anchor_leaves.select("leaf_id", "vecs", "classes").mapInArrow(run, "class_id long, leaf_id long, place long, itself long")


def _pairs(anchor_leaves: DataFrame, cells: CellTree, dim: int, lists: int) -> DataFrame:
    """Anchor leaves with the cells that may hold wanted scores. `least` has the score to reach (cells but its own are paired), or
    `scores` the positive scores of each class (all cells are)."""
    columns = ["leaf_id", "vecs", "labels", "classes", "lo", "hi", "centre", "radius"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_cache(None)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                b = batch.slice(start, 256)
                if "least" in b.schema.names:
                    wanted = [None] * b.num_rows
                    least, most = np.array(b.column("least").to_pylist(), np.float64), np.full(b.num_rows, np.inf)
                else:
                    wanted, least, most = [], np.full(b.num_rows, np.inf), np.full(b.num_rows, -np.inf)
                    for i, of in enumerate(b.column("scores").to_pylist()):
                        m = np.full((len(of), lists), -1, np.int64)
                        for j, ps in enumerate(of):
                            m[j, : len(ps)] = ps
                        if (m >= 0).any():
                            least[i], most[i] = window(m[m >= 0]).min(), m.max()
                        wanted.append(m.tobytes())
                own = b.column("cell").to_pylist()
                got = [(i, c) for i, c in cells.pairs(Nodes.read(b, dim), least, most) if wanted[i] is not None or c != own[i]]
                if got:
                    i = pa.array([x for x, _ in got])
                    yield pa.record_batch([*(b.column(c).take(i) for c in columns), pa.array([c for _, c in got], pa.int64()), pa.array([wanted[x] for x, _ in got], pa.binary())], names=[*columns, "cell", "wanted"])

    return anchor_leaves.mapInArrow(run, ", ".join(f"{c} {LEAF[c]}" for c in columns) + ", cell long, wanted binary")


def hard_negatives(
    spark: SparkSession, vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, sample: int = 16_384, most_depth: int = 10, leaf: int = 256, anchor_leaf: int = 64
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for each anchor, positive and negative."""
    ship(spark)
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0]
    dim = max(1, dim or 0)
    ids = max(positives + 1, negatives)  # a class's first ids: an anchor's own row is passed over
    rows = clean_rows(vectors, dim)
    anchors = materialize(rows.where(F.col("vec_id") % anchor_every == 0), "negatives-anchors")
    classes = classes_of(rows, anchors, ids)
    n, n_anchors = classes.agg(F.count("*"), F.coalesce(F.sum("anchors"), F.lit(0))).first()
    depth = min(most_depth, (n // (4 * leaf)).bit_length())
    drawn = classes.select("vec").orderBy(F.xxhash64("vec", "label")).limit(sample).toArrow().column("vec").to_pylist()  # at most `sample` rows
    tree = Tree(np.frombuffer(b"".join(drawn), np.int32).reshape(-1, dim), depth)
    leaves = leaves_of(classes, tree, dim, leaf, ids, "negatives-leaves")
    of_anchors = leaves_of(classes.where("anchors > 0"), tree, dim, anchor_leaf, ids, "negatives-anchor-leaves")
    cells = cell_tree(leaves, dim, depth)
    members = materialize(_members(of_anchors, dim), "negatives-members")

    k = positives + 1
    at_home = of_anchors.drop("ids", "counts").withColumn("wanted", F.lit(None).cast("binary"))
    near = materialize(_first(_search(at_home, leaves, dim, ids, k), k), "negatives-home")
    reached = members.join(near.where(F.col("rank") == k).select("class_id", "score"), "class_id", "left")
    reached = reached.groupBy("leaf_id").agg(F.min(F.coalesce("score", F.lit(NOTHING))).alias("least"))
    far = _search(_pairs(of_anchors.join(reached, "leaf_id"), cells, dim, k), leaves, dim, ids, k)
    found = materialize(_first(near.drop("rank").unionByName(far), k).drop("positive"), "negatives-positives")

    lists = found.where("score >= 0").groupBy("class_id").agg(F.collect_set("score").alias("scores"))  # k scores at most
    wanted = members.join(lists, "class_id", "left").groupBy("leaf_id").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("scores", F.array().cast("array<long>")).alias("scores")))).alias("of"))
    wanted = wanted.select("leaf_id", F.col("of.scores").alias("scores"))
    against = _first(_search(_pairs(of_anchors.join(wanted, "leaf_id"), cells, dim, k), leaves, dim, ids, negatives), negatives)

    first = found.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct("score", "id").alias("x")))).alias("p")).select("class_id", F.col("p.x").alias("p"))
    second = against.groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("positive", "rank", "score", "id"))).alias("n"))
    key = F.concat("vec", F.col("label").cast("string").cast("binary")).alias("key")
    told = members.join(first, "class_id").join(second, "class_id").join(classes.where("anchors > 0").select("class_id", key, "anchors"), "class_id")
    d = join_spread(anchors.select("vec_id", key), told.select("key", "itself", "p", "n", "anchors"), "key", "anchors", n_anchors)
    own = F.array_position("p", F.struct(F.col("itself").alias("score"), F.col("vec_id").alias("id")))
    d = d.withColumn("own", own)
    d = d.select("vec_id", "n", F.explode(F.slice(F.filter("p", lambda p, i: i != F.col("own") - 1), 1, positives)).alias("p"))
    d = d.select("vec_id", "p", F.explode(F.filter("n", lambda x: x["positive"] == F.col("p.score"))).alias("x"))
    name = lambda c: F.when(F.col(c) != NAMELESS, F.col(c))
    return d.select(
        F.col("vec_id").alias("anchor_id"), name("p.id").alias("positive_id"), F.col("x.rank").alias("rank"), name("x.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("x.score").alias("negative_score"),
    )


#: The contract in SQL: every anchor against all rows.
NEGATIVES_SQL = """
WITH raw AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
             WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT r, vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS q FROM raw WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
          FROM ok a JOIN ok b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS k FROM pairs WHERE same) WHERE k <= 5),
neg AS (SELECT p.a, p.anchor_id, p.b, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
               row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id) AS rank
        FROM pos p JOIN pairs n ON p.a = n.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""
