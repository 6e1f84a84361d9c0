"""Benchmark decontamination with a distributed positional inverted index.

Benchmark items are cut into windows of `width` consecutive words (an item of fewer words is one window). The corpus frequency of
every benchmark term is counted over all documents. Each window is looked up by its rarest terms: postings (term, text, position) of
those terms are stored as a table in the shared folder, the rarest term's list gives candidate starts (position less the term's
offset), and the lists of the next rarest terms, adjusted by their offsets, are intersected with them. What is left is compared word
for word with the text, which is cut into blocks of BLOCK words that meet only their own candidates. The same postings give
proximity matches: items whose ANCHORS rarest terms stand near each other in any order.

A text is known by its MD5 sum in all of this, so equal texts are looked up once for each task that meets them, and rows with one
doc_id and different texts, or without doc_id, have each their own result. What is sent to all tasks is measured in bytes first
(SEND_BYTES); beyond that the same tables are joined by shuffles, in which the postings of frequent terms are salted.

Defined cases: null or empty texts have no words and are never contaminated; an item without words has no window; an item without
item_id counts as one with an empty name; items of one item_id count once, repeated documents each have their row; an empty corpus or
benchmark gives no hits; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import doc_bytes, map_batches, words
from skein.session import drop, materialize, ship

WIDTH = 13
#: Terms looked up for each window, rarest first.
ANCHORS = 3
#: Up to this many bytes are sent to every task; beyond it tables are joined by a shuffle.
SEND_BYTES = 16 << 20
#: Words of a text that are compared with candidates at once.
BLOCK = 1024
#: Texts that a task remembers, so as not to post their copies again.
SEEN = 100_000


def _sent(df: DataFrame, each: Column) -> bool:
    """Whether a table is small enough to be sent to every task, by the sum of its rows' bytes."""
    return (df.agg(F.sum(each)).first()[0] or 0) <= SEND_BYTES


def _text_bytes(*cols: str) -> Column:
    """A row's bytes with about what Python or the JVM adds to each value."""
    return sum((F.octet_length(c) + 64 for c in cols), F.lit(64))


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """window_id, the window's words (joined by blanks) and the item's id; equal windows have equal ids."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, grams, item = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = words(t)
            for g in {b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else ():
                ids.append(hashlib.md5(g).hexdigest())
                grams.append(g.decode())
                item.append(i)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(grams, pa.string()), pa.array(item, pa.string())], ["window_id", "gram", "item_id"])

    src = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    return map_batches(src, run, "window_id string, gram string, item_id string")


def _keyed(docs: DataFrame) -> DataFrame:
    return doc_bytes(docs).withColumn("key", F.unhex(F.md5("text")))


def _chosen(terms: DataFrame) -> frozenset[bytes] | None:
    """The terms as a set that is sent to every task; None if they are too many for that."""
    return frozenset(r[0].encode() for r in terms.collect()) if _sent(terms, _text_bytes("term")) else None


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each term occurs in all documents."""
    chosen = _chosen(terms)

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter = Counter()
        for t in b.column("text"):
            w = words(t.as_py())
            total.update(w if chosen is None else filter(chosen.__contains__, w))
        return pa.RecordBatch.from_arrays([pa.array([k.decode() for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    got = map_batches(doc_bytes(docs), count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return got if chosen is not None else got.join(terms, "term", "left_semi")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, key, pos) of the terms, and of each row of docs (doc_id) one with term null and its number of words as pos."""
    chosen = _chosen(terms)
    seen: set[bytes] = set()  # of one task

    def post(b: pa.RecordBatch) -> pa.RecordBatch:
        term, key, pos, doc = [], [], [], []
        for i, t, k in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("key").to_pylist(), strict=True):
            w = words(t.as_py())
            term.append(None)
            key.append(k)
            pos.append(len(w))
            doc.append(i)
            if k in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(k)
            at = range(len(w)) if chosen is None else [p for p, x in enumerate(w) if x in chosen]
            term += [w[p] for p in at]
            key += [k] * len(at)
            pos += at
            doc += [None] * len(at)
        return pa.RecordBatch.from_arrays([pa.array(term, pa.binary()).cast(pa.string()), pa.array(key, pa.binary()), pa.array(pos, pa.int32()), pa.array(doc, pa.int64())], ["term", "key", "pos", "doc_id"])

    got = map_batches(_keyed(docs), post, "term string, key binary, pos int, doc_id long")
    return got if chosen is not None else got.where("term is null").unionByName(got.where("term is not null").join(terms, "term", "left_semi"))


def _rarest(parts: DataFrame, by: str, counts: DataFrame, anchors: int) -> DataFrame:
    """The rarest terms of each group with their offsets: t0, o0, t1, o1, ... and n0. Of fewer terms the last one stands again."""
    parts = parts.join(counts, "term", "left").groupBy(by, "term").agg(F.coalesce(F.first("n"), F.lit(0)).alias("n"), F.min("o").alias("o"))
    order = F.array_sort(F.collect_list(F.struct("n", "term", "o")))  # the terms of one window or item
    got = parts.groupBy(by).agg(order.alias("terms"))
    at = lambda k: F.element_at("terms", F.least(F.lit(k + 1), F.size("terms")))
    return got.where(F.element_at("terms", 1)["n"] > 0).select(by, at(0)["n"].alias("n0"), *[c for k in range(anchors) for c in (at(k)["term"].alias(f"t{k}"), at(k)["o"].alias(f"o{k}"))])


def looked_up(post: DataFrame, ways: DataFrame, counts: DataFrame) -> DataFrame:
    """postings ⋈ ways on the rarest term t0; a frequent term's postings are dealt over salts, with a copy of its ways for each."""
    if _sent(ways, _text_bytes(*[c for c, t in ways.dtypes if t == "string"])):
        return post.join(F.broadcast(ways), F.col("term") == F.col("t0"))
    most = max(100_000, (counts.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot = F.broadcast(counts.where(F.col("n") > most).select("term", F.ceil(F.col("n") / most).cast("int").alias("salts")))  # at most a thousand terms
    p = post.join(hot, "term", "left").withColumn("salt", F.pmod(F.xxhash64("key", "pos"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    w = ways.join(hot.withColumnRenamed("term", "t0"), "t0", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return p.join(w, (F.col("term") == F.col("t0")) & (F.col("salt") == F.col("part"))).drop("salt", "part")


def candidates(post: DataFrame, ways: DataFrame, counts: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """(key, start, window_id): the lists of a window's rarest terms, adjusted by offset and intersected."""
    p = post.where("term is not null").select("term", "key", "pos")
    got = looked_up(p, ways, counts).withColumn("start", F.col("pos") - F.col("o0")).where("start >= 0")
    for k in range(1, anchors):
        other = p.select(F.col("key").alias("d"), F.col("term").alias("t"), F.col("pos").alias("q"))
        got = got.join(other, (F.col("key") == F.col("d")) & (F.col(f"t{k}") == F.col("t")) & (F.col("start") + F.col(f"o{k}") == F.col("q")), "left_semi")
    return got.select("key", "start", "window_id").distinct()


def confirmed(docs: DataFrame, cand: DataFrame, grams: DataFrame, width: int = WIDTH) -> DataFrame:
    """What stands in the texts, for each block of words: key, block, n (hit words in it), first (bits of the hit ones among its first
    words), over (bits of those that windows of the block before reach), windows (ids)."""
    keys = cand.select("key").distinct()
    keys = F.broadcast(keys) if _sent(keys, F.octet_length("key") + 64) else keys
    seen: set[bytes] = set()  # of one task

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for k, t in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
            if k in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(k)
            w = words(t.as_py())
            out += [(k, n, b" ".join(w[n * BLOCK : (n + 1) * BLOCK + width - 1])) for n in range(-(-len(w) // BLOCK))]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.binary()), strict=True)], ["key", "block", "words"])

    blocks = map_batches(_keyed(docs).join(keys, "key", "left_semi").select("key", "text"), cut, "key binary, block int, words binary")
    wanted = cand.join(grams, "window_id").select("key", F.floor(F.col("start") / BLOCK).cast("int").alias("block"), F.struct((F.col("start") % BLOCK).alias("at"), "window_id", "gram").alias("c"))
    wanted = wanted.groupBy("key", "block").agg(F.collect_list("c").alias("c"))  # those that start in one block

    def compare(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for k, n, text, cs in zip(*(b.column(c).to_pylist() for c in ("key", "block", "words", "c")), strict=True):
            w = text.split()
            hit, found = np.zeros(BLOCK + width, dtype=bool), set()
            for c in cs:
                g = c["gram"].encode().split()
                if w[c["at"] : c["at"] + len(g)] == g:
                    hit[c["at"] : c["at"] + len(g)] = True
                    found.add(c["window_id"])
            if found:
                bits = lambda a: sum(1 << i for i in np.flatnonzero(a).tolist())
                out.append((k, n, int(hit[:BLOCK].sum()), bits(hit[:width]), 0, sorted(found)))
                if over := bits(hit[BLOCK:]):
                    out.append((k, n + 1, 0, 0, over, []))
        cols = list(zip(*out, strict=True)) or [()] * 6
        types = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["key", "block", "n", "first", "over", "windows"])

    return map_batches(blocks.join(wanted, ["key", "block"]), compare, "key binary, block int, n long, first long, over long, windows array<string>")


def hit_words(blocks: DataFrame) -> DataFrame:
    """key, n_hit: words in any window, each once. Rows of one block may repeat, as copies of a text do."""
    each = blocks.groupBy("key", "block").agg(F.max("n").alias("n"), F.bit_or("first").alias("first"), F.bit_or("over").alias("over"))
    return each.groupBy("key").agg(F.sum(F.col("n") + F.bit_count(F.col("over").bitwiseAND(F.bitwise_not("first")))).cast("long").alias("n_hit"))


def _near(got: DataFrame, p: DataFrame, k: int, within: int) -> DataFrame:
    """Rows of got (key, pos, t1, t2, ...) that have their term tk within `within` words of pos, by an equality join on neighbouring blocks of positions."""
    other = p.select(F.col("key").alias("d"), F.col("term").alias("t"), F.col("pos").alias("q"))
    other = other.withColumn("block", F.explode(F.array(*[F.floor(F.col("q") / within) + i for i in (-1, 0, 1)])))
    return got.join(other, (F.col("key") == F.col("d")) & (F.col(f"t{k}") == F.col("t")) & (F.floor(F.col("pos") / within) == F.col("block")) & (F.abs(F.col("pos") - F.col("q")) <= within), "left_semi")


def near_items(post: DataFrame, items: DataFrame, counts: DataFrame, within: int, anchors: int = ANCHORS) -> DataFrame:
    """key, n_near: items whose rarest terms all stand within `within` words of a place of the rarest one. items: item_id, t0, t1, ..."""
    p = post.where("term is not null").select("term", "key", "pos")
    got = looked_up(p, items, counts)
    for k in range(1, anchors):
        got = _near(got, p, k, within)
    return got.select("key", "item_id").distinct().groupBy("key").agg(F.count("*").alias("n_near"))


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = WIDTH, anchors: int = ANCHORS, near: bool = False, keys: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; with near also n_near, the items whose
    rarest terms stand within `width` words of the rarest one, in any order; with keys also key, the MD5 sum of the text."""
    ship(spark)
    wins = materialize(windows(items, width), "windows")
    grams = wins.groupBy("window_id").agg(F.first("gram").alias("gram"))
    parts = grams.select("window_id", F.posexplode(F.split("gram", " ")).alias("o", "term"))
    counts = materialize(term_counts(docs, parts.select("term").distinct()), "terms")
    ways = materialize(_rarest(parts, "window_id", counts, anchors), "ways")
    posted = materialize(ways.select(F.explode(F.array(*[f"t{k}" for k in range(anchors)])).alias("term")).distinct(), "anchors")
    post = materialize(postings(docs, posted), "postings")
    cand = materialize(candidates(post, ways, counts, anchors), "candidates")
    blocks = materialize(confirmed(docs, cand, grams, width), "hits")
    drop(cand, ways, posted)

    found = blocks.select("key", F.explode("windows").alias("window_id")).distinct().join(wins.select("window_id", "item_id"), "window_id")
    found = found.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))  # at most all items
    known = hit_words(blocks).join(found, "key")
    if near:
        # an item's rarest terms are among the rarest of the windows that hold them, so they are posted
        of_items = wins.select("item_id", F.posexplode(F.split("gram", " ")).alias("o", "term"))
        known = known.join(near_items(post, _rarest(of_items, "item_id", counts, anchors), counts, width, anchors), "key", "full")
    known = materialize(known, "known")
    drop(blocks, wins, counts)
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        post.where("term is null")
        .select("doc_id", "key", F.col("pos").cast("long").alias("n_words"))
        .join(known, "key", "left")
        .select(
            "doc_id",
            "n_words",
            hit.alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
            *([F.coalesce("n_near", F.lit(0)).alias("n_near")] if near else []),
            *(["key"] if keys else []),
        )
    )


def keep_clean(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """All rows and columns of the documents that are not contaminated; a row's own text decides."""
    bad = contamination(spark, docs, items, keys=True).where("contaminated").select("key").distinct()
    return docs.join(bad, F.unhex(F.md5(F.col("text").cast("binary"))) == bad["key"], "left_anti")


def proximity(docs: DataFrame, terms: list[str], within: int) -> DataFrame:
    """Documents where all terms stand within `within` words of the rarest one, in any order: doc_id, and that term's position."""
    spark = docs.sparkSession
    ship(spark)
    keys = spark.createDataFrame([(t.lower(),) for t in sorted(set(terms))], "term string")
    post = materialize(postings(docs, keys), "postings")
    p = post.where("term is not null")
    counts = {r["term"]: r["n"] for r in p.groupBy("term").agg(F.count("*").alias("n")).collect()}  # as many rows as terms
    order = sorted({t.lower() for t in terms}, key=lambda t: (counts.get(t, 0), t))
    got = p.where(F.col("term") == order[0]).select("key", "pos", *[F.lit(t).alias(f"t{k}") for k, t in enumerate(order)])
    for k in range(1, len(order)):
        got = _near(got, p, k, within)
    return post.where("term is null").select("doc_id", "key").join(got.select("key", "pos").distinct(), "key").select("doc_id", "pos")
