"""Badges beside names and escapes of texts against plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from skein.functions import posts

NAMES, MARKS = r"@[a-z]\b", r"\*\*"


def nearest(text, own, within):
    """Every mark goes to the nearest name; of equally near ones to that before."""
    names = [(m.start(), m.end(), m.group()) for m in re.finditer(NAMES, text)]
    for m in re.finditer(MARKS, text):
        near = sorted((m.start() - e, 0, n) if e <= m.start() else (s - m.end(), 1, n) for s, e, n in names)
        if near and near[0][0] <= within and near[0][2] == own:
            return True
    return False


def test_badges_go_to_the_nearest_name(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(["@a", "@b", "**", "   ", " ", "😀 "]) + " " * r.randrange(3) for _ in range(r.randrange(12)))) for i in range(600)]
    d = spark.createDataFrame(rows, "id int, t string")
    got = {x["id"]: x["v"] for x in d.select("id", posts.badge_beside(F.col("t"), NAMES, lambda m: m == "@a", MARKS, 4).alias("v")).collect()}
    want = {i: nearest(t, "@a", 4) for i, t in rows}
    assert got == want
    assert 50 < sum(want.values()) < 550


def test_badges_of_long_pages(spark):
    """Many names and marks in one page, in time in proportion to them."""
    text = '{"username":"zed","is_verified":true},' * 20_000
    d = spark.createDataFrame([(0, text), (1, text + '{"username":"ann","is_verified":true}'), (2, text + '{"username":"ann","is_verified":false}')], "id int, t string")
    got = d.select("id", posts.instagram_verified(F.col("t"), F.lit("ann"), F.lit(None).cast("string")).alias("v"))
    assert {r["id"]: r["v"] for r in got.collect()} == {0: False, 1: True, 2: False}


def test_escapes_and_long_texts(spark):
    r = random.Random(6)
    texts = ["".join(r.choices(["a", "é", "😀", "\n", "𐐷", "—", " "], k=60)) for _ in range(50)] + ["x" * 500_000 + "😀"]
    d = spark.createDataFrame([(i, '"text":' + json.dumps(t)) for i, t in enumerate(texts)], "id int, t string")
    got = {x["id"]: x["v"] for x in d.select("id", posts.longest_text(F.col("t"), F.lit(None).cast("string")).alias("v")).collect()}
    assert got == {i: t.strip() for i, t in enumerate(texts)}


def test_empty_tables_and_nulls(spark):
    d = spark.createDataFrame([(None, None)], "a string, b string")
    one = d.select(posts.facebook_author(F.col("a"), F.col("a"), F.col("a")).alias("author"), posts.longest_text(F.col("a"), F.col("b")).alias("text"), posts.x_verified(F.col("a")).alias("x")).first()
    assert tuple(one) == ("Facebook User", None, False)
    assert d.where("a = ''").select(posts.facebook_author(F.col("a"), F.col("a"), F.col("a"))).count() == 0
