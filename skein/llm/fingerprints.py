"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A text is a multiset of paragraphs: its lines, cut further after sentence ends. SHA-256 of a paragraph gives 60 digits of 0 to
15, each added up over all paragraphs in a counter of its own: 32 words hold two counters (32 and 31 bits) or one. A fingerprint is these
sums and the number of paragraphs; as text it is written as 20 words of three digits' sums, 20 bits apart, modulo 2**60. So it does not depend on the order, and a paragraph is inserted or deleted by
adding or subtracting its words. No counter overflows below 143 million paragraphs in a text, so the difference of two fingerprints also tells how far
the texts are apart: its squared length, each digit less its mean of 7.5, grows by 21.25 a counter for every paragraph that
only one of them has.

Defined cases: null and empty texts have no paragraphs and the fingerprint of zeros; two texts without paragraphs are alike
(1), one with and one without are not (0); repeated rows and ties of doc_id are taken in the order of a hash of their
texts; a row without doc_id comes first; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.strings import let

LANE_BITS = 60
MASK = (1 << LANE_BITS) - 1
#: Digits 0, 5 and 10 of fifteen: those of a word of the text.
PICK = 0xF | 0xF << 20 | 0xF << 40
#: Words for each fifteen digits: digits m and m + 8 in word m, digit 7 alone.
WIDE, HIGH = 8, 32
WIDE_PICK, WIDE_MASK = 0xF | 0xF << HIGH, (1 << 63) - 1
MEAN, VARIANCE = 7.5, 21.25
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Numbers of ranges are this far apart, to leave room for parts.
PARTS = 1 << 24


def paragraphs(text: Column) -> Column:
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?;|]) +", "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: p != "")


def digits(text: Column) -> Column:
    """For each paragraph four numbers of fifteen hexadecimal digits."""
    four = lambda h: F.array(*[F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(4)])
    return F.transform(F.transform(paragraphs(text), lambda p: F.sha2(p, 256)), four)


def fingerprint(text: Column) -> Column:
    """array<bigint>: the words, then the number of paragraphs."""
    return fingerprint_of(digits(text))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """As fingerprint(), with the paragraphs hashed once for all words of the sum."""
    return df.withColumn("_parts", digits(F.col(text))).withColumn(name, fingerprint_of(F.col("_parts"))).drop("_parts")


def fingerprint_of(parts: Column) -> Column:
    """The fingerprint of paragraphs given by their digits."""

    def lane(k: int, m: int) -> Column:
        bits = 0xF if m == WIDE - 1 else WIDE_PICK
        pick = lambda d: F.shiftright(F.element_at(d, k + 1), 4 * m).bitwiseAND(F.lit(bits))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, d: (acc + pick(d)).bitwiseAND(F.lit(WIDE_MASK)))

    return F.array(*[lane(k, m) for k in range(4) for m in range(WIDE)], F.size(parts).cast("long"))


def counter(fp: Column, k: int, digit: int) -> Column:
    word = F.element_at(fp, 1 + WIDE * k + digit % WIDE)
    return F.shiftrightunsigned(word, HIGH) if digit >= WIDE else word.bitwiseAND(F.lit((1 << HIGH) - 1))


def inserted(fp: Column, text: Column) -> Column:
    """The fingerprint of a text with more paragraphs."""
    return _combined(fp, fingerprint(text), 1)


def deleted(fp: Column, text: Column) -> Column:
    """The fingerprint of a text without these of its paragraphs."""
    return _combined(fp, fingerprint(text), -1)


def _combined(a: Column, b: Column, sign: int) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(WIDE_MASK)))


def as_text(fp: Column) -> Column:
    def word(x: Column, k: int, j: int) -> Column:
        return sum((F.shiftleft(counter(x, k, j + 5 * i), 20 * i).bitwiseAND(F.lit(MASK)) for i in range(3)), F.lit(0).cast("long")).bitwiseAND(F.lit(MASK))

    # bound once, else an expression would be computed for each of its uses
    words = let(fp, lambda x: F.array(*[word(x, k, j) for k in range(4) for j in range(5)], F.element_at(x, -1)))
    return F.array_join(F.transform(words, lambda x: F.lpad(F.lower(F.hex(x)), LANE_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, about the share of common paragraphs otherwise: 1 - |a-b|^2 / (|a|^2 + |b|^2)."""
    na, nb = F.element_at(a, -1), F.element_at(b, -1)

    # a word's two counters, less their means; a word of one digit has none in its upper half
    low = lambda x, n: x.bitwiseAND(F.lit((1 << HIGH) - 1)) - n * MEAN
    high = lambda x, i, n: F.when(i % WIDE == WIDE - 1, 0.0).otherwise(F.shiftrightunsigned(x, HIGH) - n * MEAN)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    square = lambda x: x * x
    words = lambda fp: F.slice(fp, 1, 4 * WIDE)

    def length(fp: Column, n: Column) -> Column:
        return total(F.transform(words(fp), lambda x, i: square(low(x, n)) + square(high(x, i, n))))

    pairs = words(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    apart = total(F.transform(pairs, lambda p, i: square(low(p["x"], na) - low(p["y"], nb)) + square(high(p["x"], i, na) - high(p["y"], i, nb))))
    both = length(a, na) + length(b, nb)
    return F.when(a == b, F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / both)))


def _cuts(d: DataFrame, n: int, range_rows: int) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
    """Cuts of the order (k, h) into ranges of about range_rows rows, and of the equal rows that fill a range the number of parts.

    Cuts are quantiles of k. One that is met several times has many rows and is cut on at equal parts of h, a hash; (k, h) of equal
    rows that alone fill a range get one of their own. The rows of a range grow as the root of n beyond some 10**8, and so does what the driver sees."""
    m = max(96, min(n // range_rows, int(3 * n**0.5)))
    share = max(range_rows, n // m)
    seen = Counter(int(c) for c in d.approxQuantile("k", [i / m for i in range(1, m)], 0.2 / m)) if n else {}
    out = set()
    for k, times in seen.items():
        out |= {(k, LEAST + (part << 64) // (times + 1)) for part in range(times + 1 if times > 1 else 1)}
        if times > 1 and k < MOST:
            out.add((k + 1, LEAST))
    hot = {(r["k"], r["h"]): -(-r["n"] // share) for r in d.groupBy("k", "h").agg(F.count("*").alias("n")).where(F.col("n") > 2 * share).collect()}  # under m of them
    for k, h in hot:
        out |= {(k, h), (k, h + 1) if h < MOST else (min(k + 1, MOST), LEAST)}
    return sorted(out), hot


def _place(cuts: list[tuple[int, int]]) -> Column:
    """How many cuts are not after (k, h), in two levels: about twice the root of their number is compared."""
    if not cuts:
        return F.lit(0).cast("long")
    step = max(1, int(len(cuts) ** 0.5))
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  folded to one constant
    pairs = lambda xs: F.arrays_zip(longs([k for k, _ in xs]).alias("k"), longs([h for _, h in xs]).alias("h"))
    reached = lambda xs: F.size(F.filter(xs, lambda c: (c["k"] < F.col("k")) | ((c["k"] == F.col("k")) & (c["h"] <= F.col("h")))))
    g = reached(pairs(cuts[::step]))
    return F.when(g == 0, 0).otherwise((g - 1) * step + reached(F.slice(pairs(cuts), (g - 1) * step + 1, F.lit(step)))).cast("long")


def with_next(docs: DataFrame, range_rows: int = 4_000) -> DataFrame:
    """doc_id, text ('' for null), fp, next_text and next_fp: those of the next row by doc_id; after the last, of the first.

    Rows are dealt into ranges of (doc_id, hash of the text). Every range also gets the first row of the range after it, so
    one window within ranges sees every next row. Equal rows that fill more than a range are dealt into parts in any order: the row after is
    an equal one for all but one of them."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.withColumn("k", F.coalesce("doc_id", F.lit(LEAST))).withColumn("h", F.xxhash64("text"))
    cuts, hot = _cuts(d, d.count(), range_rows)
    d = d.withColumn("rng", _place(cuts))
    # a row a range
    heads = sorted((r["rng"], r["f"]["k"], r["f"]["h"]) for r in d.groupBy("rng").agg(F.min(F.struct("k", "h")).alias("f")).collect())
    after = []
    for i, (rng, k, h) in enumerate(heads):
        parts = hot.get((k, h), 1)
        after += [(rng * PARTS + p, k, h) for p in range(parts - 1)]
        after.append((rng * PARTS + parts - 1, *heads[(i + 1) % len(heads)][1:]))
    split = [(rng, hot[k, h]) for rng, k, h in heads if (k, h) in hot]
    d = d.withColumn("rng", F.col("rng") * PARTS)
    if split:
        split = F.broadcast(spark.createDataFrame([(rng * PARTS, parts) for rng, parts in split], "of long, parts long"))
        part = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(0))
        dealt = d.join(split, F.col("rng") == F.col("of"), "left").withColumn("rng", F.col("rng") + part).drop("of", "parts")
    else:
        dealt = d
    after = spark.createDataFrame(after, "to long, k long, h long")
    first = d.join(F.broadcast(after.select("k", "h").distinct()), ["k", "h"]).groupBy("k", "h").agg(F.first("text").alias("text"))
    extra = first.join(F.broadcast(after), ["k", "h"]).select(F.lit(None).cast("long").alias("doc_id"), "text", "k", "h", F.col("to").alias("rng"), F.lit(1).alias("last"))
    d = with_fingerprint(dealt.select("doc_id", "text", "k", "h", "rng", F.lit(0).alias("last")).unionByName(extra), "text", "fp")
    w = Window.partitionBy("rng").orderBy("last", "k", "h")
    return d.withColumn("next", F.lead(F.struct("text", "fp")).over(w)).where("last = 0").select("doc_id", "text", "fp", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document against an edited text (its last quarter replaced by the start of the next document) and the next one."""
    d = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    d = d.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - quarter), F.left("next_text", quarter)))
    d = with_fingerprint(d.drop("text", "next_text"), "edited", "edited_fp")
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
