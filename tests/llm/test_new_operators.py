"""Hard negatives, suffix-array duplicate removal and the filter audit against brute force, on the small tables and on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import filter_audit, negatives, suffixes
from skein.llm.queries import queries

ODD_TEXTS = [
    (1, None, "en"), (2, "", "en"), (3, None, None), (4, "x" * 450, "de"), (5, "ab" * 300, None), (5, "ab" * 300, "fr"), (None, "ab" * 300, "fr"),
    (None, "lost one", ""), (None, "lost one", "en"), (6, "lost one", "en"), (9, "ünïcode 😀 " * 60 + "A B C", "en"), (10, "…" + "ünïcode 😀 " * 60, "en"),
    (11, "w " * 99 + "W#", "en"), (12, " ".join(f"Word{i}" for i in range(120)), "en"), (12, " ".join(f"Word{i}" for i in range(120)), "en"), (8, " ".join(f"Word{i}" for i in range(120)), "fr"),
    (13, "é" * 99 + "q" + "é" * 50, "en"), (14, "é" * 99, "en"), (15, "long " * 30_000, "en"), (16, " \n\t\x0b\x0c\r ", "en"),
]
CLASHING = "doc_id long, text string, lang string, part string, block_id long, seq int, size long, digest string, names string, E int, rows int, k int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "p", 1, 2, 3, "d", "n", 1, 7, 8) for r in ODD_TEXTS], CLASHING)


# suffixes


def repeated_by_hand(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", covered)]
        yield len(t), spans, bytes(b for b, c in zip(t, covered, strict=True) if not c)


def spans_of(spark, df, length, **sizes):
    got = suffixes.repeated_spans(spark, df, length, **sizes).collect()
    return sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in got), key=repr)


def spans_by_hand(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    return sorted(((i, *x) for (i, _), x in zip(rows, repeated_by_hand(texts, length), strict=True)), key=repr)


def test_covers():
    for v, cover in suffixes.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert suffixes.period(200) == 57 and suffixes.period(1) == 1


def test_hashes_of_equal_strings(monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 64)
    text = np.frombuffer(random.Random(3).randbytes(90) * 3, np.uint8)
    h = suffixes.hashes(text, np.arange(len(text) - 20), 20, suffixes.BASES[0])
    assert len(set(h.tolist())) == 90 and (h[:90] == h[90:180]).all()


@pytest.mark.parametrize(("length", "letters"), [(1, 5), (10, 3), (48, 2), (200, 26)])
def test_repeated_spans_of_random_texts(spark, length, letters):
    """Passages cut at random places, of many and of few letters, in blocks and ranges of a few rows."""
    r = random.Random(length)
    letter = lambda n: "".join(chr(97 + r.randrange(letters)) for _ in range(n))
    pool = [letter(r.randrange(3 * length + 1)) for _ in range(8)]
    rows = []
    for i in range(70):
        parts = [r.choice(pool)[r.randrange(length) :] if r.random() < 0.6 else letter(r.randrange(2 * length)) for _ in range(r.randrange(6))]
        rows.append((r.choice([i, i, None, 3]), "".join(parts)))
    rows += rows[:5] + [(900, "a" * 3 * length), (901, ""), (902, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert spans_of(spark, df, length, block_bytes=2000, range_bytes=500) == spans_by_hand(rows, length)


def test_repeated_spans_of_odd_texts(spark, odd):
    rows = [(i, t) for i, t, _ in ODD_TEXTS]
    assert spans_of(spark, odd, 200) == spans_by_hand(rows, 200)
    assert spans_of(spark, odd.limit(0), 200) == []
    with pytest.raises(ValueError):
        suffixes.repeated_spans(spark, odd, 0)


def test_op12_on_the_small_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries()["op12_suffix_dedup"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == sorted((i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(kept).hexdigest()) for i, n, s, kept in spans_by_hand(rows, 200))


def test_texts_are_not_shuffled(spark, odd):
    plan = suffixes.repeated_spans(spark, odd, 200)._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.split("\n") if "FileScan" in line and "text" in line]
    assert scan and "Bucketed: true" in scan[0]
    above = plan.split("\n")[: plan.split("\n").index(scan[0])]
    assert not any("Exchange" in line for line in above)


# hard negatives


def vectors_by_hand(rows, every=100):
    dim = max([len(e) for _, e, _ in rows if e is not None], default=0)
    ok = []
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        ok.append((i, [math.floor(256 * x) for x in e] + [0] * (dim - len(e)), label))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, x, label) in enumerate(ok):
        if i is None or i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), last(j), j, m) for b, (j, y, m) in enumerate(ok) if b != a]
        scored.sort(key=lambda t: t[:2])
        for s, _, p, _ in [t for t in scored if t[3] == label][:5]:
            fits = [t for t in scored if t[3] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:5]
            out += [(i, p, k + 1, t[2], -s, -t[0]) for k, t in enumerate(fits)]
    return sorted(out, key=repr)


def mined(spark, df, **sizes):
    got = negatives.hard_negatives(spark, df, **sizes).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, got.collect()), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, vec string, cell int, ids string, score double, key int"


def vector_rows(n, dim, seed, copies=0):
    """Clusters, copies of one vector, repeated and missing ids, and whatever must be passed over."""
    r = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    centres = [[f32(r.gauss(0, 0.3)) for _ in range(dim)] for _ in range(6)]
    near = lambda c: [f32(x + r.gauss(0, 0.05)) for x in c]
    rows = [(r.choice([i, i, i, i, 100 * (i % 7), None]), near(r.choice(centres)), r.randrange(4)) for i in range(n)]
    rows += [(n + i, centres[0], r.choice([1, 1, 2])) for i in range(copies)]
    nan, inf = float("nan"), float("inf")
    rows += [(700, None, 1), (800, centres[1], None), (900, [nan] * dim, 1), (1000, [inf] + [0.0] * (dim - 1), 1), (1100, [None] + [0.5] * (dim - 1), 2), (1200, [], 3), (1300, [0.5], 3), (1400, [0.0] * dim, 1), (-200, centres[2], -3)]
    return rows


@pytest.mark.parametrize(("n", "dim", "copies"), [(400, 8, 300), (900, 3, 0)])
def test_hard_negatives_of_random_vectors(spark, n, dim, copies):
    rows = vector_rows(n, dim, n, copies)
    df = spark.createDataFrame([(*x, "v", 1, "i", 0.5, 3) for x in rows], VECTORS)
    want = vectors_by_hand(rows)
    assert len(want) > 100
    assert mined(spark, df) == want
    # a deep tree with leaves of few rows, fitted on a few, and tasks that send their lists on again and again
    assert mined(spark, df, sample=50, leaf=4, anchor_leaf=2, most_depth=6) == want


def test_hard_negatives_of_large_components_and_of_nothing(spark):
    big = [(100 * i, [3e5 + i, -7e4 * i, 1.5], i % 2) for i in range(8)]
    rows = [(i, [float(np.float32(x)) for x in e], m) for i, e, m in big]
    df = spark.createDataFrame([(*x, "v", 1, "i", 0.5, 3) for x in rows], VECTORS)
    assert mined(spark, df) == vectors_by_hand(rows)
    assert mined(spark, df.limit(0)) == []
    assert mined(spark, df.where("vec_id = 100")) == []


def test_node_intervals_hold_all_scores_and_prune():
    r = np.random.default_rng(5)
    sets = [np.floor(r.normal(c, 9, (20, 6))).astype(np.int32) for c in (0, 60, -60, 200)]
    read = lambda x: negatives.Nodes(*(np.frombuffer(b)[None] for b in negatives.Nodes.of(x)[:3]), np.array([negatives.Nodes.of(x)[3]]))
    nodes = [read(x) for x in sets]
    for (x, a), (y, b) in itertools.product(zip(sets, nodes, strict=True), repeat=2):
        lo, hi = a.between(0, b, 0)
        s = negatives.scores(x, y)
        assert lo <= s.min() and s.max() <= hi
    cells = negatives.CellTree([4, 5, 6, 7], negatives.Nodes(*(np.concatenate([getattr(n, k) for n in nodes]) for k in ("lo", "hi", "centre", "radius"))), 2)
    both = negatives.Nodes(*(np.concatenate([getattr(nodes[i], k) for i in (1, 3)]) for k in ("lo", "hi", "centre", "radius")))
    least = np.array([negatives.scores(sets[1], sets[3]).max() - 5000.0, negatives.scores(sets[3], sets[3]).min() - 5000.0])
    assert sorted(cells.pairs(both, least, np.full(2, np.inf))) == [(0, 7), (1, 7)]


# filter audit


def failing_by_hand(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t])
        yield lang or "", {f for f, b in zip("ABCDE", bad, strict=True) if b}, i


def audit_by_hand(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts = collections.defaultdict(list)
    for part, bad, i in failing_by_hand(rows):
        parts[part].append((bad, i in good and i is not None, i in toxic and i is not None))
    out = []
    for part, own in parts.items():
        total = collections.Counter()
        mine = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                mine.append([part, order, step, len(left), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)])
        out += [(*m, total[m[1][m[2] - 1]]) for m in mine]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark, odd):
    labels = [(5, 1, 0), (5, 0, 1), (6, 1, 1), (12, 1, 0), (12, 1, 0), (None, 1, 1), (99, 1, 1), (15, None, 1), (8, 0, None)]
    marks = spark.createDataFrame([(*x, 1, "p") for x in labels], "doc_id long, quality int, toxic int, rows int, digest string")
    got = filter_audit.audit(odd, marks)
    assert got.columns == AUDIT
    assert sorted(map(tuple, got.collect())) == audit_by_hand(ODD_TEXTS, labels)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop|Python|Arrow|Pandas", plan)
    assert filter_audit.audit(odd.limit(0), marks).count() == 0
    assert sorted(map(tuple, filter_audit.audit(odd, marks.limit(0)).collect())) == audit_by_hand(ODD_TEXTS, [])


def test_joint_failures_are_sums_of_flag_products(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = filter_audit.flagged_rows(odd, labels)
    got = {r["part"]: list(r["rows"]) for r in filter_audit.joint_failures(rows).collect()}
    want = collections.defaultdict(lambda: [0] * 32)
    for part, bad, _ in failing_by_hand(ODD_TEXTS):
        for s in range(32):
            want[part][s] += {f for i, f in enumerate("ABCDE") if s >> i & 1} <= bad
    assert got == dict(want)
    assert rows.agg(F.sum("rows")).first()[0] == len(ODD_TEXTS)
