"""Filter interaction audit: what every order of a set of filters keeps, removes and loses, by inclusion and exclusion.

Rows are summed once into joint-failure counts: for each part and each of the 2**n sets of filters, the rows that fail all filters of the
set, as sums of products of the filters' flags. All else is arithmetic on these counts: with J(T) the joint failures of T,

* survivors of S are the alternating sum of J over the subsets of S (Moebius inversion),
* rows that only f fails are the alternating sum of J over the sets that hold f,
* the game "rows that S removes" has the Harsanyi dividend d(T) = -(-1)**|T| J(T), and the Shapley value of f is the sum of
  d(T) / |T| over the sets T that hold f; times n!, a whole number, it is the sum of what f removes over all orders.

Defined cases: a null text is empty: it has no words (A fails), 0 distinct of 0 words and 0 capitals of 0 characters, which fail
neither B nor C, and equals other null or empty texts. A null part is the empty string. A row without doc_id is not after any other and no other is after it, so it
neither fails E nor makes another fail; rows of equal text and equal doc_id do not fail through one another. Of several labels of a doc_id one that is 1 counts. An empty
table gives no parts and so no rows. Columns other than doc_id, text and the part are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
WEIGHTS = ("rows", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """The filters that a text fails by itself; text must not be null."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    total, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": total < 100,
        "B": 100 * distinct.cast("long") < 80 * total.cast("long"),
        "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged_rows(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, a flag (0 or 1) a filter, and rows, good and toxic: how many such rows there are.

    Rows of equal text, part and doc_id are added up before anything is joined, and equal texts are compared by their digest, so a text or a
    doc_id in a third of all rows is a few rows after the first step."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    d = d.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), *[f.cast("int").alias(k) for k, f in text_flags(F.col("text")).items()])
    own = list(FILTERS[:4])
    d = d.groupBy("digest", "part", "doc_id", *own).agg(F.count("*").alias("rows"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("g"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    d = d.join(marks, "doc_id", "left")
    d = d.withColumn("good", F.col("rows") * F.coalesce("g", F.lit(0))).withColumn("toxic", F.col("rows") * F.coalesce("t", F.lit(0)))
    counts = F.struct(*[F.col(w) for w in WEIGHTS])
    # of a text in a part: its rows that cannot fail E (the least doc_id's, if no other part has a smaller one; those without a doc_id), and all its rows
    nameless = [F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col(w))), F.lit(0)).alias(f"n_{w}") for w in WEIGHTS]
    d = d.groupBy("digest", "part", *own).agg(
        *[F.sum(w).alias(w) for w in WEIGHTS], *nameless, F.min("doc_id").alias("least"), F.min_by(counts, "doc_id").alias("first")
    )
    d = d.withColumn("least_of_all", F.min("least").over(Window.partitionBy("digest")))  # a text has at most a row a part
    spared = lambda w: F.col(f"n_{w}") + F.when(F.col("least") == F.col("least_of_all"), F.col(f"first.{w}")).otherwise(0)
    two = [F.struct(F.lit(0).alias("E"), *[spared(w).alias(w) for w in WEIGHTS]), F.struct(F.lit(1).alias("E"), *[(F.col(w) - spared(w)).alias(w) for w in WEIGHTS])]
    d = d.select("part", *own, F.explode(F.array(*two)).alias("x")).select("part", *own, "x.*")
    # zero rows stay: a part is listed even if nothing fails
    return d.groupBy("part", *FILTERS).agg(*[F.sum(w).alias(w) for w in WEIGHTS])


def joint_failures(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, and for each weight an array with the joint failures of every set of filters; bit i of a place stands for filter i."""
    sums = lambda w: F.array(*[F.sum(_product([F.col(f) for i, f in enumerate(filters) if s >> i & 1], F.col(w))) for s in range(1 << len(filters))])
    return rows.groupBy("part").agg(*[sums(w).alias(w) for w in WEIGHTS])


def _product(flags: list[Column], w: Column) -> Column:
    for f in flags:
        w = w * f
    return w


def _weighted(joint: Column, n: int, weights: list[int], use) -> Column:
    """The sum over all sets t with use(t) of a weight for each size of a set, times the joint failures."""
    by_set = F.lit([weights[t.bit_count()] for t in range(1 << n)])
    term = lambda t: F.when(use(t), F.element_at(by_set, t + 1) * F.element_at(joint, t + 1)).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("long"), lambda acc, t: acc + term(t))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: a row a part, order and step."""
    n = len(FILTERS)
    joint = joint_failures(flagged_rows(docs, labels, part))
    signs = [(-1) ** k for k in range(n + 1)]
    every_set, every_filter = F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit([1 << i for i in range(n)])
    survivors = lambda w: F.transform(every_set, lambda s: _weighted(F.col(w), n, signs, lambda t: t.bitwiseAND(F.bitwise_not(s)) == 0))
    each = lambda weights: F.transform(every_filter, lambda f: _weighted(F.col("rows"), n, weights, lambda t: t.bitwiseAND(f) != 0))
    dividends = [0, *(-((-1) ** k) * factorial(n) // k for k in range(1, n + 1))]
    values = joint.select(
        "part", *[survivors(w).alias(f"s_{w}") for w in WEIGHTS], each([-x for x in signs]).alias("unique"), each(dividends).alias("shapley"),
        F.transform(every_filter, lambda f: F.element_at(F.col("rows"), f + 1)).alias("fails"),
    )
    # before and after: the sets of a prefix of the order without and with its last filter
    steps = [
        ("".join(FILTERS[f] for f in order), k + 1, order[k], sum(1 << f for f in order[:k]), sum(1 << f for f in order[: k + 1]))
        for order in permutations(range(n))
        for k in range(n)
    ]
    # n * n! steps, whatever the tables hold: a part is exploded to their numbers, which choose from literal arrays
    columns = dict(zip(("filter_order", "step", "f", "before", "after"), zip(*steps, strict=True), strict=True))
    literal = lambda v, kind: F.split(F.lit(",".join(map(str, v))), ",").cast(f"array<{kind}>")  # noqa: E731  folded to one constant
    chosen = [F.element_at(literal(v, "string" if name == "filter_order" else "int"), F.col("k")).alias(name) for name, v in columns.items()]
    d = values.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(steps)))).alias("k")).select("*", *chosen)
    lost = lambda w: F.col(f"s_{w}")[F.col("before")] - F.col(f"s_{w}")[F.col("after")]
    return d.select(
        "part", "filter_order", "step", F.col("s_rows")[F.col("after")].alias("kept"), lost("rows").alias("removed"), (F.col("fails")[F.col("f")] - lost("rows")).alias("redundant"),
        F.col("unique")[F.col("f")].alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("shapley")[F.col("f")].alias("shapley"),
    )


#: The same from the contract's words: every order is walked, row by row.
AUDIT_SQL = r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM base),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT r, part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
             len(words) < 100 AS A, 100 * len(list_distinct(words)) < 80 * len(words) AS B,
             100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS C,
             regexp_matches(text, '[#$%&*|]') AS D, coalesce(w.doc_id > least, false) AS E
      FROM w LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
failing AS (SELECT part, good, toxic, (CASE WHEN A THEN 'A' ELSE '' END || CASE WHEN B THEN 'B' ELSE '' END || CASE WHEN C THEN 'C' ELSE '' END || CASE WHEN D THEN 'D' ELSE '' END || CASE WHEN E THEN 'E' ELSE '' END) AS bad FROM f),
sums AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY part, bad),
walk AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS own, bad, n, good, toxic,
                (SELECT min(i) FROM range(1, 6) t(i) WHERE contains(bad, substr(filter_order, i, 1))) AS hit
         FROM sums, orders, (SELECT unnest(range(1, 6)) AS step)),
told AS (SELECT part, filter_order, step::INT AS step, own,
                sum(CASE WHEN hit IS NULL OR hit > step THEN n ELSE 0 END)::BIGINT AS kept,
                sum(CASE WHEN hit = step THEN n ELSE 0 END)::BIGINT AS removed,
                sum(CASE WHEN contains(bad, own) AND hit < step THEN n ELSE 0 END)::BIGINT AS redundant,
                sum(CASE WHEN bad = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
                sum(CASE WHEN hit = step THEN good ELSE 0 END)::BIGINT AS good_lost,
                sum(CASE WHEN hit = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
         FROM walk GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM told
"""
