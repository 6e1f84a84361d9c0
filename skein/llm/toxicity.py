"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order; every model after the first also gets the earlier categories' probabilities. In
training these are out-of-fold predictions, so later models learn from probabilities as honest as those they meet in use.
Features are the presence of words that speak for or against a category (chi-squared, for each fold over the other folds only)
and some ratios of the text. The threshold of each category is the one of best F1 on out-of-fold predictions.

The models are fitted on a bounded sample of labelled rows (`sample`, drawn by a hash of doc_id), so the sample, the
vocabulary and the weights stay small; scoring covers every whole text.

Defined cases: null and empty texts are scored by the ratios alone; labels that are null are left out; of repeated labels or
rows each counts; without labels of both kinds a category's probability is the share of positives (0 without any labels) and
no document is positive; columns other than doc_id, text and the labels are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import columns_of, doc_bytes, map_batches, words
from skein.session import drop, materialize, ship

SAMPLE, VOCABULARY, FOLDS = 20_000, 192, 4
DENSE = 6


def categories() -> dict[str, Column]:
    """The chain, in order, from the columns quality and toxic; severe is toxic in a text of low quality."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"low_quality": low.cast("int"), "toxic": toxic.cast("int"), "severe": (low & toxic).cast("int")}


def ratios(text: bytes, w: list[bytes]) -> list[float]:
    n, k = max(1, len(text)), max(1, len(w))
    lines = text.split(b"\n")
    return [
        float(np.log1p(len(w))),
        len(set(w)) / k,
        sum(map(len, w)) / n,
        len(w) and sum(map(len, w)) / k / 10,
        1 - len(set(lines)) / len(lines),
        sum(map(text.count, (b"!", b"|", b"%", b"#", b"*", b"$"))) / n,
    ]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_linear(row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int, l2: float = 5.0, steps: int = 200) -> np.ndarray:
    """Logistic regression on sparse 0/1 columns and dense ones; weights of sparse, dense, and the constant."""
    n, d = dense.shape
    w, m, v = np.zeros(width + d + 1), np.zeros(width + d + 1), np.zeros(width + d + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], n) + dense @ w[width:-1] + w[-1]
        e = sigmoid(z) - y
        g = np.concatenate((np.bincount(col, e[row], width), dense.T @ e, [e.sum()]))
        g[:-1] += l2 * w[:-1]
        g /= n
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - (t - 1) / steps)
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    cut = np.append(p[order][1:] < p[order][:-1], True)  # never between equal predictions
    k = int(np.argmax(np.where(cut, f1, -1)))
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + low) / 2)


@dataclass
class Chain:
    names: list[str]
    vocabulary: dict[bytes, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray | None]
    base: list[float]
    thresholds: list[float]

    def probabilities(self, cols: list[int], dense: list[float]) -> list[float]:
        x = (np.asarray(dense) - self.mean) / self.scale
        out: list[float] = []
        for w, base in zip(self.weights, self.base, strict=True):
            if w is None:
                out.append(base)
                continue
            k = len(self.vocabulary)
            z = w[cols].sum() + x @ w[k : k + DENSE] + np.dot(out, w[k + DENSE : -1]) + w[-1]
            out.append(float(1 / (1 + np.exp(-min(35.0, max(-35.0, z))))))
        return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, vocabulary: int = VOCABULARY, folds: int = FOLDS) -> Chain:
    ship(spark)
    cats = categories()
    known = labels.where("quality is not null and toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), *[c.alias(k) for k, c in cats.items()])
    # drawn by a hash of doc_id, so the same rows whatever their order; `sample` at most, so they can be sent to every task
    drawn = known.orderBy(F.xxhash64("id"), "id", *cats).limit(sample)
    fold = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(folds)).cast("int").alias("fold")
    # a label stands for one row of its doc_id, that of the least hash, so `sample` also bounds what is fitted where doc_ids repeat
    texts = doc_bytes(docs).join(F.broadcast(drawn.select("id").distinct()), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = texts.join(F.broadcast(drawn.select("*", fold)), F.col("doc_id") == F.col("id")).drop("id")
    rows = materialize(rows, "labelled")
    names = list(cats)

    def word_lists(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = pa.array([[w.decode() for w in set(words(t.as_py()))] for t in b.column("text")], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([lists, *(b.column(c) for c in ("fold", *names))], ["word", "fold", *names])

    each = map_batches(rows.select("text", "fold", *names), word_lists, f"word array<string>, fold int, {', '.join(f'{k} int' for k in names)}")
    each = each.select(F.explode("word").alias("word"), "fold", *names)
    stats = materialize(each.groupBy("word", "fold").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in names]), "words")
    totals = rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in names]).collect()  # a row a fold

    def chosen_words(without: int | None) -> set[bytes]:
        """The words of most chi-squared for each category, over all folds but one."""
        seen = stats if without is None else stats.where(F.col("fold") != without)
        seen = seen.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in names]).where("n >= 3")
        used = [t for t in totals if t["fold"] != without]
        out: set[bytes] = set()
        for k in names:
            s = sum(t[k] for t in used) / max(1, sum(t["n"] for t in used))
            chi = F.pow(F.col(k) - F.col("n") * s, 2) / (F.col("n") * F.lit(max(1e-9, s * (1 - s))))
            out |= {r["word"].encode() for r in seen.orderBy(chi.desc(), "word").limit(vocabulary // len(names)).collect()}
        return out

    final, of_fold = chosen_words(None), [chosen_words(f) for f in range(folds)]
    chosen = sorted(final.union(*of_fold))
    vocab = {w: i for i, w in enumerate(chosen)}

    data = map_batches(rows.select("doc_id", "text", "fold", *names), _featurizer(vocab, ["fold", *names]), f"doc_id long, cols array<int>, dense array<double>, fold int, {', '.join(f'{k} int' for k in names)}").collect()
    drop(rows, stats)
    data.sort(key=lambda r: (r["doc_id"], r["cols"], r["dense"]))
    if not data:
        return Chain(names, {}, np.zeros(DENSE), np.ones(DENSE), [None] * len(names), [0.0] * len(names), [2.0] * len(names))
    row = np.repeat(np.arange(len(data)), [len(r["cols"]) for r in data])
    col = np.fromiter((c for r in data for c in r["cols"]), dtype=np.int64, count=len(row))
    dense = np.array([r["dense"] for r in data])
    mean, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    x = (dense - mean) / scale
    fold = np.array([r["fold"] for r in data])
    known_to = [np.array([w in v for w in chosen], dtype=bool) for v in [*of_fold, final]]  # columns that a fold's model, and the last, may use
    final_at = np.flatnonzero(known_to[-1])
    weights, base, cuts = [], [], []
    for k in names:
        y = np.array([r[k] for r in data], dtype=float)
        base.append(float(y.mean()))
        if y.min() == y.max():
            weights.append(None)
            cuts.append(2.0)
            x = np.column_stack((x, np.full(len(y), base[-1])))
            continue
        out = np.full(len(y), base[-1])
        for f in range(folds):
            a, b = fold != f, fold == f
            if not b.any() or y[a].min() == y[a].max():
                continue
            mine = known_to[f][col]
            keep, at = a[row] & mine, np.cumsum(a) - 1
            w = fit_linear(at[row[keep]], col[keep], x[a], y[a], len(vocab))
            out[b] = sigmoid(np.bincount(row[mine], w[col[mine]], len(y)) + x @ w[len(vocab) : -1] + w[-1])[b]
        mine = known_to[-1][col]
        w = fit_linear(row[mine], col[mine], x, y, len(vocab))
        weights.append(np.concatenate((w[final_at], w[len(vocab) :])))
        cuts.append(best_threshold(out, y))
        x = np.column_stack((x, out))
    return Chain(names, {chosen[c]: i for i, c in enumerate(final_at.tolist())}, mean, scale, weights, base, cuts)


def _featurizer(vocab: dict[bytes, int], names: list[str]):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols, dense = [], []
        for t in b.column("text"):
            text = t.as_py() or b""
            w = words(text)
            cols.append(sorted(vocab[x] for x in vocab.keys() & w))
            dense.append(ratios(text, w))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols, pa.list_(pa.int32())), pa.array(dense, pa.list_(pa.float64())), *(b.column(k) for k in names)], ["doc_id", "cols", "dense", *names])

    return run


def _probabilities(texts: pa.Array, chain: Chain) -> list[list[float]]:
    rows, vocab = [], chain.vocabulary
    for t in texts:
        text = t.as_py() or b""
        w = words(text)
        rows.append(chain.probabilities(sorted(vocab[x] for x in vocab.keys() & w), ratios(text, w)))
    return rows


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability for each category, and toxic."""
    names = [f"p_{k}" for k in chain.names]
    at = chain.names.index("toxic")
    ship(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = _probabilities(b.column(1), chain)
        cols = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([r[at] >= chain.thresholds[at] for r in rows], pa.bool_())], ["doc_id", *names, "toxic"])

    return map_batches(doc_bytes(docs), run, f"doc_id long, {', '.join(f'{k} double' for k in names)}, toxic boolean")


def keep_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """All rows and columns of the documents that are not toxic, in one pass: a row's own text decides."""
    at = chain.names.index("toxic")
    ship(docs.sparkSession)
    plain = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])  # names with dots can't be mapped

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = _probabilities(b.column("text").cast(pa.binary()), chain)
        return b.filter(pa.array([r[at] < chain.thresholds[at] for r in rows], pa.bool_()))

    return map_batches(plain, run, columns_of(plain)).toDF(*docs.columns)
